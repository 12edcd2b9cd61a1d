"""Keyed state in a stream: what is known of each source, kept from its runs' outcomes.

An outcome says that a source ran, whether it went well, with which cursor or which
error. The state is what ``ingest_state`` holds: a success forgets the streak of
failures and may bring a cursor; a failure leaves the cursor. A timer tells when a
source has been silent for too long, once for each silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: One run of a source; error null: it went well. has_cursor: the run brings a cursor, which may be null.
OUTCOME = "source_id string, at timestamp, error string, has_cursor boolean, cursor string"
#: What the state says after a row, or, with ``stale``, when a source was silent for too long.
STATUS = "source_id string, cursor string, last_run_at timestamp, last_success_at timestamp, last_error_at timestamp, last_error string, consecutive_failures int, stale boolean"
#: A source runs daily; two hours more are allowed.
SILENCE = timedelta(hours=26)
#: What is held of a source; a worker without a session can't read DDL.
HELD = StructType([StructField(n, t()) for n, t in (("cursor", StringType), ("run", LongType), ("success", LongType), ("failed", LongType), ("error", StringType), ("failures", IntegerType))])
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _moment(ms: int | None) -> pd.Timestamp:
    return pd.NaT if ms is None else pd.Timestamp(ms, unit="ms")


class SourceState(StatefulProcessor):
    def __init__(self, silence: timedelta = SILENCE):
        self.silence_ms = int(silence.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Times in milliseconds.
        self.state = handle.getValueState("status", HELD)

    def _row(self, source: str, held: tuple, stale: bool) -> pd.DataFrame:
        cursor, run, success, failed, error, failures = held
        row = {"source_id": source, "cursor": cursor, "last_run_at": _moment(run), "last_success_at": _moment(success), "last_error_at": _moment(failed), "last_error": error, "consecutive_failures": failures, "stale": stale}
        return pd.DataFrame([row]).astype({"last_run_at": "datetime64[us]", "last_success_at": "datetime64[us]", "last_error_at": "datetime64[us]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values("at", kind="stable")
        held = tuple(self.state.get()) if self.state.exists() else (None, None, None, None, None, 0)
        for r in got.itertuples(index=False):
            cursor, run, success, failed, error, failures = held
            at = int(pd.Timestamp(r.at).timestamp() * 1000)
            if run is not None and at <= run:
                continue  # A run that came before, or comes again.
            if pd.isna(r.error):
                held = (None if pd.isna(r.cursor) else r.cursor) if r.has_cursor else cursor, at, at, failed, None, 0
            else:
                held = cursor, at, success, at, r.error, failures + 1
        self.state.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[1] + self.silence_ms)
        yield self._row(key[0], held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            yield self._row(key[0], tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def source_status(outcomes: DataFrame, silence: timedelta = SILENCE, late: str = "2 days") -> DataFrame:
    """STATUS rows of a stream of OUTCOME rows: one per source and batch, and one per silence. Outcomes that come twice change nothing; those later than ``late`` behind the newest are dropped."""
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return outcomes.withWatermark("at", late).groupBy("source_id").transformWithStateInPandas(SourceState(silence), STATUS, "Update", "EventTime")
