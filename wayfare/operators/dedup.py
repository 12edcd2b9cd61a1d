"""Identity: last row of a key in a batch, and copies of news across channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of a headline by other sources within so many days are the same news.
SUPPRESSION_DAYS = 14
_DAY_MS = 86_400_000
#: Rows of a task that sorts stored rows and bounds: some 250 MB.
TASK_ROWS = 250_000


def last_wins(batch: DataFrame, keys: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """The last row of each key in the order of ``position``, which must be total among a key's rows."""
    newest = Window.partitionBy(*keys).orderBy(*[p.desc() for p in position])
    return batch.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def _least_other(rows: DataFrame, group: Sequence[str], time: Column, name: str) -> DataFrame:
    """rows with ``name``: for a row that asks, the stored row of the least id and another source so far, in the order of ``time``.

    All are running minima over one sorted group: m1 is the least stored row, m2 the
    least of another source than m1's. A stored row that isn't of m1's source, and
    an m1 that a row of another source took over from, are all that m2 can be: what
    was taken over from was the least of all before it.
    """
    order = Window.partitionBy(*group).orderBy(time, F.col("row").isNull().cast("int"), F.col("row.id"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("m1", F.min("row").over(running))
    found = found.withColumn("before", F.lag("m1").over(order))
    lost = F.when(F.col("row.source_id") != F.col("m1.source_id"), F.col("row"))
    taken = F.when(F.col("before.source_id") != F.col("m1.source_id"), F.col("before"))
    found = found.withColumn("m2", F.min(F.least(lost, taken)).over(running))
    return found.withColumn(name, F.when(F.col("m1.source_id") != F.col("asks"), F.col("m1")).otherwise(F.col("m2"))).drop("m1", "m2", "before")


def told_before(incoming: DataFrame, existing: DataFrame, days: int = SUPPRESSION_DAYS, n_rows: int | None = None) -> DataFrame:
    """incoming with ``told``: the stored row (id, source_id, external_id) of the smallest id that tells the same news, null if there is none.

    It has the key, another source, and a start at most ``days`` away. No pair of
    rows is made. Time is cut in stretches of ``days``; the rows of a window are the
    end of one stretch, a whole one, and the beginning of a third. In each stretch
    stored rows and the incoming ones' bounds are sorted together, and running
    minima answer each bound: forwards for beginnings, backwards for ends. Rows of
    one key, source and start are one on both sides, so a headline that comes a
    hundred thousand times is sorted, at most, once for each start. There are as
    many tasks as hold ``TASK_ROWS`` each. n_rows: about how many rows are stored,
    and three for each incoming one; they are counted where it isn't given.
    """
    width = days * _DAY_MS
    start = F.unix_millis(F.col("start_at"))
    row = F.struct(F.col("id"), F.col("source_id"), F.col("external_id"))
    existing, asking = (rows.filter("dedup_key is not null and start_at is not null") for rows in (existing, incoming))
    if n_rows is None:
        n_rows = existing.count() + 3 * asking.count()
    n_tasks = max(-(-n_rows // TASK_ROWS), min(int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 10_000 + 1))
    stored = existing.groupBy("dedup_key", start.alias("at"), "source_id").agg(F.min(row).alias("row"))
    stored = stored.select("dedup_key", "at", F.floor(F.col("at") / width).alias("stretch"), "row")
    asked = asking.select("dedup_key", "source_id", start.alias("t")).distinct()
    here = F.floor(F.col("t") / width)
    none = F.lit(None).cast(stored.schema["row"].dataType)
    # A whole stretch is one whose beginning ends where it ends.
    bounds = F.array(*[F.struct(at.alias("at"), (here + shift).alias("stretch"), F.lit(back).alias("back")) for shift, at, back in ((-1, F.col("t") - width, True), (0, (here + 1) * width, False), (1, F.col("t") + width, False))])
    probes = asked.select("dedup_key", F.col("source_id").alias("asks"), "t", F.inline(bounds)).withColumn("row", none)
    group = ["dedup_key", "stretch"]
    both = stored.withColumns({"asks": F.lit(None).cast("string"), "t": F.lit(None).cast("long"), "back": F.lit(None).cast("boolean")}).unionByName(probes)
    both = both.repartition(n_tasks, *group)
    both = _least_other(_least_other(both, group, F.col("at").asc(), "since"), group, F.col("at").desc(), "until")
    answers = both.filter("asks is not null").select("dedup_key", F.col("asks").alias("source_id"), "t", F.when(F.col("back"), F.col("until")).otherwise(F.col("since")).alias("told"))
    answers = answers.filter("told is not null").groupBy("dedup_key", "source_id", "t").agg(F.min("told").alias("told"))
    n, a = incoming.withColumn("_t", start).alias("n"), answers.alias("a")
    same = (F.col("n.dedup_key") == F.col("a.dedup_key")) & (F.col("n.source_id") == F.col("a.source_id")) & (F.col("n._t") == F.col("a.t"))
    return n.join(a, same, "left").select(*[F.col(f"n.{c}") for c in incoming.columns], F.col("a.told").alias("told"))


def not_suppressed(incoming: DataFrame, existing: DataFrame, days: int = SUPPRESSION_DAYS) -> DataFrame:
    """Incoming rows that no stored row of another source has already told. Only what was stored before the batch is consulted; rows without a key are never told."""
    return told_before(incoming, existing, days).filter("told is null").drop("told")


def listing(told: DataFrame) -> DataFrame:
    """Of ``told_before``'s rows those that were told, each with the stored row."""
    return told.filter("told is not null").select("source_id", "external_id", "dedup_key", F.col("told.source_id").alias("of_source_id"), F.col("told.external_id").alias("of_external_id"), F.col("told.id").alias("of_id"))


def suppressed(incoming: DataFrame, existing: DataFrame, days: int = SUPPRESSION_DAYS) -> DataFrame:
    """Incoming rows that were told before, each with the stored row of the smallest id."""
    return listing(told_before(incoming, existing, days))
