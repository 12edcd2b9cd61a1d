"""Rankings, groups and roll-ups that a client of the engine shows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity(level: Column) -> Column:
    """Closed roads first, restricted ones next, all others last."""
    return F.when(level == "interrumpido", 0).when(level == "restringido", 1).otherwise(2)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank, and how many more it has."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    # The rank's bound alone stands over the window, so that each task keeps k rows of a group before the exchange.
    top = rows.withColumn("rank", rank).filter(F.col("rank") <= k).alias("t")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group])
    return top.join(sizes, same).select("t.*", F.greatest(F.col("s.n") - k, F.lit(0)).alias("more"))


def by_point(rows: DataFrame, order: Sequence[Column], point: str = "location", first: str = "venue_name") -> DataFrame:
    """Located rows by point: how many, and the first row's venue."""
    lead = F.min_by(F.col(first), F.struct(*order))
    located = rows.filter(F.col(point).isNotNull())
    return located.groupBy(F.col(f"{point}.lng").alias("lng"), F.col(f"{point}.lat").alias("lat")).agg(F.count("*").alias("n"), lead.alias(first))


def facets(rows: DataFrame, column: str, selected: str | None = None) -> DataFrame:
    """Different values in order, and the selected one even if no row has it."""
    found = rows.select(F.col(column).alias("value")).filter(F.col(column).isNotNull())
    if selected is not None:
        found = found.unionAll(rows.sparkSession.createDataFrame([(selected,)], "value string"))
    return found.distinct().orderBy("value")


def freshness(state: DataFrame, label: Column) -> DataFrame:
    """One row: the newest success, the number of sources, how many fail, and their labels."""
    failing = F.col("consecutive_failures") > 0
    return state.agg(
        F.max("last_success_at").alias("newest_success"),
        F.count("*").alias("sources"),
        F.count_if(failing).alias("failing"),
        F.array_sort(F.collect_list(F.when(failing, label))).alias("failing_labels"),
    )


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
