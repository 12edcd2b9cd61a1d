"""Predicates of the serving and ingest paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.vocabulary import GATED_SOURCES


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Their conjunction; what is absent asks nothing."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def overlaps(start: Column, end: Column, from_: Column | None = None, to: Column | None = None) -> Column:
    """Whether [start, end] meets [from, to], bounds included; without an end it is an instant, without a bound it is open.

    The upper bound stays on the bare start, which Parquet statistics can serve.
    """
    return all_of([None if from_ is None else F.coalesce(end, start) >= from_, None if to is None else start <= to])


#: Longest duration of each class, in seconds; rows of the last one may take any time.
DURATION_CLASSES = (0, 3600, 6 * 3600, 86400, 7 * 86400, 31 * 86400, 366 * 86400)


def duration_class(start: Column, end: Column) -> Column:
    """The class of an interval's duration, 0 for an instant; a row without a start is of the last class."""
    seconds = F.unix_micros(F.coalesce(end, start)) - F.unix_micros(start)
    found = F.lit(len(DURATION_CLASSES))
    for k in range(len(DURATION_CLASSES) - 1, -1, -1):
        found = F.when(seconds <= DURATION_CLASSES[k] * 1_000_000, k).otherwise(found)
    return found.cast("int")


def overlaps_by_class(start: Column, end: Column, kind: Column, from_: Column | None = None, to: Column | None = None) -> Column:
    """``overlaps`` of rows whose class of duration is at hand, with a lower bound that Parquet statistics can serve too.

    What meets the window started after its begin less the longest duration of the
    class. Bounds are instants with literals on one side, so they reach the scan.
    """
    exact = overlaps(start, end, from_, to)
    if from_ is None:
        return exact
    classes = [(kind == k) & (start >= from_ - F.make_dt_interval(secs=F.lit(longest))) for k, longest in enumerate(DURATION_CLASSES)]
    # Rows of the last class have an end, or no start.
    return exact & reduce(or_, [*classes, (kind == len(DURATION_CLASSES)) & (end >= from_)])


def visible(source: Column, now: datetime, exposed: bool = False, exposed_until: datetime | None = None, gated: Sequence[str] = GATED_SOURCES) -> Column | None:
    """Hides gated sources unless they are exposed, or now is before the time they are exposed until. Decided when the plan is built."""
    if exposed or (exposed_until is not None and now < exposed_until):
        return None
    return ~source.isin(*gated)


def disrupted(level: Column) -> Column:
    """Alerts that anyone has to know of: all but normal ones."""
    return level != "normal"


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``seen``, safe for nulls."""
    return rows.join(seen.select(F.col(key)).distinct(), key, "left_anti")


def after(rows: DataFrame, column: str, high_water: object | None) -> DataFrame:
    return rows if high_water is None else rows.filter(F.col(column) > F.lit(high_water))
