"""Incremental delivery: files of scraped events as a stream, merged batch by batch.

The stream's checkpoint is the cursor. A batch is written before the checkpoint
moves on, so after a failure it comes again, and the keyed merge makes that
harmless: nothing is inserted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wayfare import schemas
from wayfare.operators.validate import validated
from wayfare.plans.ingest import record_failure, record_success, upsert_events
from wayfare.plans.store import Store


def event_files(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schemas.SCRAPED_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merge_into(store: Store, source: str, clock: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                upsert_events(store, validated(batch), clock())
                record_success(store, source, clock())
        except Exception as error:
            record_failure(store, source, clock(), error)
            raise
        finally:
            batch.unpersist()

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, then stop: an external scheduler calls this every day."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
