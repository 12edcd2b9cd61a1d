"""Queries over the driver's tables, one module per group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Group:
    """Queries and their SQL, collected by decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[name or query.__name__] = query
            if sql is not None:
                self.oracles[name or query.__name__] = sql
            return query

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt evenly by keys, before work whose cost is in its rows and not in their bytes: a few MB of keys that become pages are one split of a file, so one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
