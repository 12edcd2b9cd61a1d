"""Tables as Parquet folders with a pointer to those that are current.

A table is a base (``v-…``) and the change sets (``c=…``) written since: rows
that take the place of those of the same key, or come anew. A merge writes a
change set of the rows it touches, so what is written follows the batch and not
the table; change sets are folded into a new base once they are many or large.
The first rows of a table become its base at once.

*Pointers* are files ``_CURRENT-00000042`` that are made once, never renamed and
never written again: the highest whole one counts. A write makes its folder, then
the next pointer, so readers see the old rows or the new at any time, and a failed
write changes nothing, nor does one that breaks off while it writes its pointer.
A table whose folders have no pointer is damaged and raises. What a pointer
names stays for ``RETAIN_S`` after the next pointer was made, and that of the
last but one in any case.

*Layout.* Folders of large tables are dealt into cells by a hash of the key, a
partition column, so a merge reads the cells of its batch alone. Within a cell
rows are clustered by hidden columns (a class of duration, a month, a place), on
which filters skip row groups.

*Schemas* change by steps that add or rename a column. A folder keeps the version
it was written in; its columns are followed by their number through the steps.

Files are reached by Hadoop's file systems: the root may be in any store Spark
knows. One writer at a time holds the table's lock file, which lapses if its
holder is lost.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions.geo import place_cell
from wayfare.operators.dedup import last_wins
from wayfare.operators.filters import duration_class


@dataclass(frozen=True)
class Layout:
    """schema: the columns by now. steps: from the first version on, ("add", "name type") or ("rename", old, new); versions before them lack what they add."""

    schema: str
    key: Sequence[str]
    cells: bool = False
    hidden: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    cluster: Sequence[str] = ()
    steps: Sequence[tuple[str, ...]] = ()

    def version(self) -> int:
        return len(self.steps)

    def names_at(self, version: int) -> list[tuple[str, str, str | None]]:
        """(name now, type, name in ``version``, or None before it was added) of all columns."""
        types = {f: t for f, t in schemas.columns(self.schema)}
        then: dict[str, str | None] = {n: n for n in types}
        for step in reversed(self.steps[version:]):
            if step[0] == "rename":
                then = {n: step[1] if old == step[2] else old for n, old in then.items()}
            else:
                then = {n: None if old == step[1].split()[0] else old for n, old in then.items()}
        return [(n, t, then[n]) for n, t in types.items()]


def _month() -> Column:
    return F.floor(F.unix_seconds("start_at") / (30 * 86400)).cast("int")


#: What the engine stores. Steps of the events: a source's address, the region's name, the keys of news, venues.
LAYOUT = {
    "events": Layout(
        schemas.EVENTS, ("source_id", "external_id"), cells=True,
        hidden={"_class": lambda: duration_class(F.col("start_at"), F.col("end_at")), "_month": _month, "_place": lambda: place_cell(F.col("location"))},
        cluster=("_class", "_month", "_place", "start_at"),
        steps=(("add", "source_url string"), ("rename", "city_id", "region_id"), ("add", "dedup_key string"), ("add", "venue_name string")),
    ),
    "regions": Layout(schemas.REGIONS, ("country_code", "level", "slug")),
    "ingest_state": Layout(schemas.INGEST_STATE, ("source_id",)),
    "ingest_quarantine": Layout(schemas.INGEST_QUARANTINE, ("source_id", "external_id"), cells=True),
    "road_alerts": Layout(schemas.ROAD_ALERTS, ("id",)),
}
#: Change sets are folded into the base beyond this number, or beyond a quarter of its bytes (and this many).
MOST_CHANGES = 16
FOLD_BYTES = 32 << 20
#: Bytes of a row group, as the writer holds it, and of what a task of a change set writes, as it is shuffled: a file of one large row group is one task for whoever reads it.
GROUP_BYTES = 16 << 20
TASK_BYTES = 16 << 20
#: Seconds for which a folder stays for readers after the pointer that no longer names it was made.
RETAIN_S = 3600
#: Seconds after which a lock counts as left behind, and a folder that no pointer names: longer than any write takes.
LEASE_S = 6 * 3600
#: Bytes of a cell, and most cells of a table: what a merge broadcasts is one number for each cell.
CELL_BYTES = 1 << 30
MOST_CELLS = 1 << 16


class StoreError(RuntimeError):
    """A table whose files contradict each other."""


@dataclass(frozen=True)
class Folder:
    name: str
    version: int
    cells: int


@dataclass(frozen=True)
class Pointer:
    """What is current: the base, then its change sets from old to new. last_id: the largest id that was given, if known."""

    number: int = -1
    folders: tuple[Folder, ...] = ()
    at: float = 0.0
    last_id: int | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, layout: Mapping[str, Layout] = LAYOUT):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout
        self.jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        path = self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    # ---- locks ----

    @contextmanager
    def locked(self, table: str, wait_s: float = 60, lease_s: float = LEASE_S) -> Iterator[None]:
        """Hold the table's lock file. One whose holder was lost is taken over once it is older than ``lease_s``."""
        fs, path = self._path(table, "_LOCK")
        end = time.time() + wait_s
        while not fs.createNewFile(path):
            if self._expired(fs, path, lease_s):
                # Only one of those that wait can rename it away; the others find it gone or new.
                stale = self._path(table, f"._LOCK-{uuid.uuid4().hex}")[1]
                if fs.rename(path, stale):
                    fs.delete(stale, False)
                continue
            if time.time() > end:
                raise TimeoutError(f"{table} is locked")
            time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(path, False)

    @staticmethod
    def _expired(fs, path, lease_s: float) -> bool:
        found = [s for s in fs.globStatus(path) or ()]
        return bool(found) and time.time() - found[0].getModificationTime() / 1000 > lease_s

    # ---- pointers ----

    def _listed(self, table: str) -> dict[str, float]:
        """Names in the table's folder, and when they were last written."""
        fs, path = self._path(table)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    def _load(self, table: str, name: str) -> Pointer | None:
        """A pointer's content; None if its writer broke off."""
        fs, path = self._path(table, name)
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return Pointer(int(name.split("-")[1]), tuple(Folder(*f) for f in found["folders"]), found["at"], found["last_id"])

    def pointer(self, table: str) -> Pointer:
        listed = self._listed(table)
        for name in sorted((n for n in listed if n.startswith("_CURRENT-")), reverse=True):
            found = self._load(table, name)
            if found:
                return found
        if any(n[:2] in ("v-", "c=") for n in listed):
            raise StoreError(f"{table}: there are folders, but no pointer to them")
        return Pointer()

    def version(self, table: str) -> list[str]:
        """The folders that are current: the base, then its change sets from old to new; none of a table that isn't there."""
        return [f.name for f in self.pointer(table).folders]

    def _point(self, table: str, folders: Sequence[Folder], last_id: int | None) -> None:
        """Make the next pointer. Only one writer can make it; what is no longer needed goes."""
        listed = self._listed(table)
        number = max((int(n.split("-")[1]) for n in listed if n.startswith("_CURRENT-")), default=-1) + 1
        fs, path = self._path(table, f"_CURRENT-{number:08d}")
        stream = fs.create(path, False)
        stream.write(json.dumps({"folders": [[f.name, f.version, f.cells] for f in folders], "at": time.time(), "last_id": last_id}).encode())
        stream.close()
        self._clean(table)

    def _clean(self, table: str) -> None:
        listed, now = self._listed(table), time.time()
        names = sorted(n for n in listed if n.startswith("_CURRENT-"))
        found = [(n, p) for n in names if (p := self._load(table, n))]
        # A pointer is superseded when the next one is made.
        old = {n for (n, _), (_, following) in list(zip(found, found[1:], strict=False))[:-1] if now - following.at > RETAIN_S}
        broken = {n for n in names[:-1] if n not in {x for x, _ in found}}
        needed = {f.name for n, p in found if n not in old for f in p.folders}
        gone = {f.name for n, p in found if n in old for f in p.folders} - needed
        lost = {n for n, at in listed.items() if n[:2] in ("v-", "c=") and n not in needed and now - at > LEASE_S}
        for name in (*gone, *lost, *old, *broken):
            fs, path = self._path(table, name)
            fs.delete(path, True)

    # ---- reading ----

    def _scan(self, table: str, folders: Sequence[Folder], hidden: bool) -> DataFrame:
        """Rows of folders of one version, in one scan, under the names of now; of several with ``_at``, the number of each row's folder."""
        layout = self.layout[table]
        columns = layout.names_at(folders[0].version)
        stored = [f"`{then}` {t}" for _, t, then in columns if then] + [f"{n} {'long' if n == '_place' else 'int'}" for n in layout.hidden] + (["_cell int"] if layout.cells else [])
        is_base = folders[0].name.startswith("v-")
        paths = [f"{self.root}/{table}/{f.name}" for f in folders]
        # The names of change sets are values of a partition column.
        rows = self.spark.read.schema(", ".join(stored + ([] if is_base else ["c string"]))).option("basePath", paths[0] if is_base else f"{self.root}/{table}").parquet(*paths)
        names = [F.col(then).alias(n) if then else F.lit(None).cast(t).alias(n) for n, t, then in columns]
        more = [*(layout.hidden if hidden else ()), *(["_cell"] if hidden and layout.cells else [])]
        at = [] if is_base else [F.col("c").alias("_at")]
        return rows.select(*names, *more, *at)

    def read(self, table: str, hidden: bool = False, within: DataFrame | None = None) -> DataFrame:
        """The table's rows. hidden: with the columns that rows are clustered by. within: only of the keys in it."""
        layout, folders = self.layout[table], self.pointer(table).folders
        if not folders:
            rows = self.spark.createDataFrame([], layout.schema)
            return rows.withColumns({n: e() for n, e in layout.hidden.items()} if hidden else {})
        keys = None if within is None else within.select(*layout.key).distinct()
        names = [*schemas.column_names(layout.schema), *(layout.hidden if hidden else ())]

        def rows_of(some: Sequence[Folder]) -> DataFrame:
            rows = self._scan(table, some, hidden or keys is not None)
            return rows if keys is None else self._keyed(layout, rows, some[0].cells, keys)

        base = rows_of(folders[:1]).select(*names)
        if len(folders) == 1:
            return base
        # Change sets have the cells of their base.
        changes = reduce(DataFrame.unionByName, [rows_of([f for f in folders[1:] if f.version == v]).select(*names, "_at") for v in sorted({f.version for f in folders[1:]})])
        # Within one change set no two rows share a key.
        newest = (changes if len(folders) == 2 else last_wins(changes, layout.key, [F.col("_at")])).drop("_at")
        # Filters on the table reach the base's scan through the anti-join.
        return base.join(newest.select(*layout.key), list(layout.key), "left_anti").select(*names).unionByName(newest)

    def _keyed(self, layout: Layout, rows: DataFrame, cells: int, keys: DataFrame) -> DataFrame:
        """rows of some keys. Only the cells of these keys are read: Spark prunes the partitions by the broadcast numbers of cells."""
        if layout.cells:
            wanted = keys.select(self._cell(layout, cells).alias("_cell")).filter("_cell >= 0").distinct()
            rows = rows.join(F.broadcast(wanted), "_cell", "left_semi")
        return rows.join(keys, list(layout.key), "left_semi")

    @staticmethod
    def _cell(layout: Layout, cells: int) -> Column:
        return F.pmod(F.xxhash64(*layout.key), F.lit(cells)).cast("int")

    # ---- writing ----

    def replace(self, table: str, rows: DataFrame, last_id: int | None = None) -> DataFrame:
        """Make rows the table's content; returns them as read back. Rows are clustered for range filters where the layout says so. last_id: their largest id, if known."""
        before = self._begun(table)
        size = sum(self._bytes(table, f.name) for f in before.folders)
        cells = 1
        while cells * CELL_BYTES < size and cells < MOST_CELLS:
            cells *= 2
        self._point(table, [self._write(table, "v", rows, cells)], last_id)
        return self.read(table)

    def change(self, table: str, rows: DataFrame, counters: Mapping[str, Column] | None = None, new_ids: str | None = None) -> dict[str, int]:
        """Put rows, of which no two share a key, in the place of those of their keys.

        counters: aggregates over the rows, which the job that writes them brings
        along and which are returned; if all are zero, the table is left alone.
        new_ids: the counter of rows that came with ids after the last; other rows have ids that are stored.
        """
        before = self._begun(table)
        if not before.folders:
            self.replace(table, self.spark.createDataFrame([], self.layout[table].schema), 0)
            before = self.pointer(table)
        # Of cells that hold nothing there are no files.
        first = self.layout[table].cells and len(before.folders) == 1 and not self._bytes(table, before.folders[0].name)
        seen = Observation()
        written = self._write(table, "v" if first else "c", rows, before.folders[0].cells, lambda df: df.observe(seen, *[c.alias(n) for n, c in counters.items()]) if counters else df)
        counts = dict(seen.get) if counters else {}
        if counters and not any(counts.values()):
            fs, path = self._path(table, written.name)
            fs.delete(path, True)
            return counts
        now = (written,) if first else (*before.folders, written)
        last_id = before.last_id if new_ids is None or before.last_id is None else before.last_id + counts[new_ids]
        self._point(table, now, last_id)
        base, *changes = (self._bytes(table, f.name) for f in now)
        # A first base that is larger than its cells should be is dealt into more.
        if len(changes) > MOST_CHANGES or sum(changes) > max(base // 4, FOLD_BYTES) or (first and base > written.cells * CELL_BYTES):
            self.replace(table, self.read(table), last_id)
        return counts

    def last_id(self, table: str) -> int:
        """The largest id: from the pointer, or else from the ids that are stored."""
        known = self.pointer(table).last_id
        return self.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if known is None else known

    def _begun(self, table: str) -> Pointer:
        """The current pointer; a new table gets an empty one before its first folder."""
        found = self.pointer(table)
        if found.number < 0:
            self._point(table, (), None)
        return found

    def _write(self, table: str, kind: str, rows: DataFrame, cells: int, watch: Callable[[DataFrame], DataFrame] = lambda df: df) -> Folder:
        layout = self.layout[table]
        number = max((int(n[2:10]) for n in self.version(table)), default=0) + 1
        folder = Folder(f"{kind}{'-' if kind == 'v' else '='}{number:08d}-{uuid.uuid4().hex[:8]}", layout.version(), cells if layout.cells else 1)
        columns = [*schemas.column_names(layout.schema), *layout.hidden, *(["_cell"] if layout.cells else [])]
        rows = rows.withColumns({n: e() for n, e in layout.hidden.items()})
        order = list(layout.cluster)
        if layout.cells:
            rows, order = rows.withColumn("_cell", self._cell(layout, cells)), ["_cell", *order]
        if order and kind == "v":
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        elif order:
            # A batch's rows by cell, in tasks of even size; they are sorted by ranges once they are folded.
            rows = rows.hint("rebalance", *order[: int(layout.cells)]).sortWithinPartitions(*order)
        # Counted behind the exchange: what is before it runs once more, for the samples of its ranges.
        rows = watch(rows).select(*columns)
        # Parquet keeps no statistics of the older form of timestamps, so no row group could be skipped by them.
        form, size, conf = "spark.sql.parquet.outputTimestampType", "spark.sql.adaptive.advisoryPartitionSizeInBytes", self.spark.conf
        before, sized = conf.get(form), conf.get(size, None)
        conf.set(form, "TIMESTAMP_MICROS")
        if sized is None:
            conf.set(size, str(TASK_BYTES))
        try:
            (rows.write.partitionBy("_cell") if layout.cells else rows.write).option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/{table}/{folder.name}")
        finally:
            conf.set(form, before)
            if sized is None:
                conf.unset(size)
        return folder

    def _bytes(self, table: str, name: str) -> int:
        fs, path = self._path(table, name)
        return fs.getContentSummary(path).getLength()

    def migrate(self) -> None:
        """Tables that aren't there yet are made, and the regions seeded."""
        for table, layout in self.layout.items():
            if not self.version(table):
                self.replace(table, self.spark.createDataFrame([], layout.schema), 0)
        if "regions" in self.layout:
            seed_regions(self)


def seed_regions(store: Store) -> tuple[int, int]:
    """Insert the regions that are missing; how many were, and how many were there."""
    spark = store.spark
    rows = [(None, schemas.COUNTRY, 1, None, slug, name, iso, (lng, lat), schemas.TIMEZONE) for slug, name, iso, lng, lat in schemas.PERU_REGIONS]
    with store.locked("regions"):
        existing = store.read("regions")
        fresh = spark.createDataFrame(rows, schemas.REGIONS).join(existing.select("country_code", "level", "slug"), ["country_code", "level", "slug"], "left_anti")
        from wayfare.operators.merge import with_new_ids

        start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        inserted = fresh.count()
        if inserted:
            store.replace("regions", existing.unionByName(with_new_ids(fresh.drop("id"), ["country_code", "level", "slug"], start).select(*existing.columns)))
    return inserted, len(rows) - inserted


def region_id(store: Store, slug: str = "lima", country: str = schemas.COUNTRY, level: int = 1) -> int:
    found = store.read("regions").filter((F.col("slug") == slug) & (F.col("country_code") == country) & (F.col("level") == level)).select("id").take(2)
    if len(found) != 1:
        raise LookupError(f"region {country}/{level}/{slug}: {len(found)} found")
    return found[0].id
