"""Shared pieces of the training-data operators.

Every operator selects the columns it needs by name before it adds its own, so
columns of the input that happen to share a name with an output column never
clash with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, one machine (tests)
    makes and sets a local one, for the session and its context; a cluster
    raises, as its executors could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext.getCheckpointDir()
        if not made and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = os.path.dirname(made) if made else f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/wayfare-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and every executor can read it.

    The result is lazy, so the files stay until the session's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}.parquet"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Shuffle partitions for ``size`` units of which a task can hold ``each``: the session's number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``budget`` bytes of text; a null text counts as empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > budget:
                yield _slice(batch, at, start, i)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield _slice(batch, at, start, len(lengths))


def _slice(batch: pa.RecordBatch, at: int, start: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(start, end - start)
    column = part.column(at)
    as_binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return part, [x or b"" for x in column.cast(as_binary).to_pylist()]


def whole_text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))
