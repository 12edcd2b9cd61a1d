"""Keyed merges over DataFrames: upserts, inserts, sweeps and replacements.

A merge is a full outer join on the key. A matched row takes the incoming value
of each updated column, nulls included: presence of the row decides, never
coalesce of the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of key hashes within which new ids are counted, at least; a session of many shuffle partitions has four to each.
ID_CELLS = 256


def with_new_ids(rows: DataFrame, keys: Sequence[str], start: int, column: str = "id", cells: int | None = None, cell: Column | None = None) -> DataFrame:
    """Gapless ids after ``start``, by hash of the key: counted per cell of hashes, so no task numbers all rows. cell: cells in the keys' own order, for ids in that order."""
    cells = cells or max(ID_CELLS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells)) if cell is None else cell
    rows = rows.withColumn("_cell", cell)
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_cell", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*keys))
    return rows.withColumn("_rank", rank).join(F.broadcast(offsets), "_cell").withColumn(column, F.lit(start) + F.col("_before") + F.col("_rank")).drop("_cell", "_rank", "_before")


def merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], on_match: Mapping[str, Column], on_insert: Mapping[str, Column], how: str = "full_outer") -> DataFrame:
    """existing after the merge, with ``_change``: inserted, updated or kept. how: right_outer gives what is inserted or updated alone.

    on_match and on_insert give columns in terms of ``e`` (existing) and ``n``
    (incoming); a column that on_match leaves out keeps its stored value, one
    that on_insert leaves out comes from incoming, or is null. Keys must be
    unique on both sides and not null.
    """
    e, n = existing.withColumn("_here", F.lit(True)).alias("e"), incoming.withColumn("_here", F.lit(True)).alias("n")
    joined = e.join(n, [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys], how)
    was, comes = F.col("e._here").isNotNull(), F.col("n._here").isNotNull()

    def value(c: str) -> Column:
        old = F.col(f"e.{c}")
        new = on_insert[c] if c in on_insert else F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        return F.when(was & comes, on_match.get(c, old)).when(was, old).otherwise(new).cast(existing.schema[c].dataType).alias(c)

    change = F.when(was & comes, F.lit("updated")).when(was, F.lit("kept")).otherwise(F.lit("inserted"))
    return joined.select(*[value(c) for c in existing.columns], change.alias("_change"))


def change_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if(F.col("_change") == "inserted").alias("inserted"), F.count_if(F.col("_change") == "updated").alias("updated"))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and those incoming rows whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def cancel_missing(events: DataFrame, source: str, now: Column, window_end: Column, seen: DataFrame, on: str = "external_id") -> DataFrame:
    """events after the sweep, with ``_flipped``.

    Scheduled events of the source that start after now and before the window's
    end, and that the source no longer lists, are cancelled. seen: the ids it
    lists, in column ``on``.
    """
    listed = seen.select(F.col(on)).filter(F.col(on).isNotNull()).distinct().withColumn("_listed", F.lit(True))
    due = (F.col("source_id") == source) & (F.col("state") == "scheduled") & (F.col("start_at") > now) & (F.col("start_at") < window_end)
    flip = F.coalesce(due, F.lit(False)) & F.col("_listed").isNull()
    swept = events.join(listed, on, "left").withColumn("_flipped", flip)
    state = F.when(F.col("_flipped"), F.lit("cancelled")).otherwise(F.col("state"))
    updated = F.when(F.col("_flipped"), now).otherwise(F.col("updated_at"))
    return swept.withColumns({"state": state, "updated_at": updated}).select(*events.columns, "_flipped")
