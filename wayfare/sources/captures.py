"""Captured pages: the engine reads bytes that something else has fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.sources import markup


def read_captures(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as captures: the path is the url, the whole file the body."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("url"), F.lit("ok").alias("kind"), F.lit(200).alias("status"), F.col("value").alias("body"))


def captures(spark: SparkSession, pages: dict[str, str | int | None]) -> DataFrame:
    """Captures from url to body, to a status, or to None for a fetch that never got an answer."""
    rows = [(u, "ok", 200, p) if isinstance(p, str) else (u, outcome(p), p, None) for u, p in pages.items()]
    return spark.createDataFrame(rows, schemas.CAPTURE)


def outcome(status: int | None) -> str:
    """ok for 2xx, http-4xx (never tried again) for 4xx, else transient."""
    return "ok" if status is not None and 200 <= status < 300 else "http-4xx" if status is not None and 400 <= status < 500 else "transient"


def retried(first: DataFrame, second: DataFrame) -> DataFrame:
    """First pass, with transient failures replaced by what a second and last pass got; dropped: those it didn't get."""
    again = second.select(F.col("url"), F.struct("kind", "status", "body").alias("again"))
    joined = first.join(again, "url", "left")
    use = (F.col("kind") == "transient") & F.col("again").isNotNull()
    picked = {c: F.when(use, F.col(f"again.{c}")).otherwise(F.col(c)) for c in ("kind", "status", "body")}
    result = joined.select("url", *[v.alias(c) for c, v in picked.items()])
    return result.withColumn("dropped", F.col("kind") == "transient")


def parsed(pages: DataFrame, parser: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """Rows of all pages. parser: url and body to rows; what it raises fails the query."""
    names = schemas.column_names(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for url, body in zip(frame["url"], frame["body"], strict=True) for row in parser(url, body)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return pages.select("url", "body").mapInPandas(run, schema)


def computed_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with columns that each row has computed once. A filter on them stays above the generator; below a projection it would compute them again for each time that it names them."""
    return frame.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def main_text(html: Column, element: str = "main") -> Column:
    """Text of the page's element, null if it has none. A page is parsed once: filters on its text don't move below it, where they would parse it again."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            node = markup.parse(page).find(markup.tag(element))
            return None if node is None else node.text()

        return pages.map(one)

    return text.asNondeterministic()(html)


def class_text(html: Column, name: str) -> Column:
    """Text of all outermost elements of a class, joined; empty if there are none. Parsed once, as in ``main_text``."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str:
            found = markup.parse(page).find_all(lambda n: n.has_class(name))
            return "".join(n.text() for n in found)

        return pages.map(one)

    return text.asNondeterministic()(html)


def plain_text(html: Column) -> Column:
    """Text of the page. Parsed once, as in ``main_text``."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: markup.parse(page).text())

    return text.asNondeterministic()(html)


def ld_json(html: Column) -> Column:
    """Contents of the page's linked-data scripts, in order."""
    pattern = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda b: F.trim(b))
