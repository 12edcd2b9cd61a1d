"""Pages of posts as a stream whose offset is the cursor.

A crawler leaves each page as a folder named after the last post on it
(``upto=<date>_<id>``, in order of date and id), with the posts as a JSON array.
The stream's offset is that name, so Spark's checkpoint is the high-water cursor:
what was read is the posts up to it, a restart goes on behind it, and a batch that
failed is read again between the same two cursors. A page is a partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

POST = "id long, date string, link string, title string, content string"
_UPTO = "upto="
#: Digits of an id in a cursor, so that cursors sort as text.
_DIGITS = 19


def cursor(date: str, number: int) -> str:
    return f"{date}_{number:0{_DIGITS}d}"


@dataclass
class Page(InputPartition):
    path: str
    after: str
    upto: str


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str, after: str):
        self.path, self.after = path, after

    @staticmethod
    def _open(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _pages(self) -> list[str]:
        """Last cursors of all pages, in order."""
        from pyarrow import fs

        files, root = self._open(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(i.base_name.removeprefix(_UPTO).replace("%3A", ":") for i in found if i.base_name.startswith(_UPTO))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max([self.after, *self._pages()])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high = start["after"], end["after"]
        # The last page may have been cut by a newer one since: it is read up to the end.
        names = self._pages()
        wanted = [n for n in names if low < n <= high] + [n for n in names if n > high][:1]
        return [Page(f"{self.path}/{_UPTO}{n.replace(':', '%3A')}", low, high) for n in wanted]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        files, root = self._open(partition.path)
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.base_name.startswith(("_", ".")) or not info.is_file:
                continue
            with files.open_input_stream(info.path) as stream:
                posts = json.loads(stream.read().decode())
            for p in posts:
                if partition.after < cursor(p["date"], p["id"]) <= partition.upto:
                    yield p["id"], p["date"], p.get("link"), p.get("title"), p.get("content")

    def commit(self, end: dict) -> None:
        """Pages stay: the cursor alone moves on."""


class PagedPosts(DataSource):
    """Options: path of the pages; after, the cursor to begin behind (none: all)."""

    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return POST

    def streamReader(self, schema) -> PageReader:  # noqa: N802
        return PageReader(self.options["path"].rstrip("/"), self.options.get("after", ""))


def paged_posts(spark: SparkSession, path: str, after: str = "") -> DataFrame:
    """The posts behind a cursor as a stream."""
    spark.dataSource.register(PagedPosts)
    return spark.readStream.format("paged_posts").option("after", after).load(path)


def write_pages(posts: DataFrame, page: str, path: str) -> None:
    """POST rows as pages, one for each value of column ``page``; pages must not overlap in the order of date and id."""
    names = [f.split()[0] for f in POST.split(", ")]
    upto = F.max(F.concat("date", F.lit("_"), F.lpad(F.col("id").cast("string"), _DIGITS, "0"))).alias("upto")
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*names)))).alias("value")
    posts.groupBy(page).agg(upto, body).select("upto", "value").repartition("upto").write.mode("append").partitionBy("upto").text(path)
