"""Contracts at the engine's edges, as columns of violations and batch checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions.dates import instant, is_instant
from wayfare.functions.geo import is_valid_point
from wayfare.functions.text import is_web_url


class ContractError(ValueError):
    """A source or batch breaks its contract; nothing of it is stored."""


def violations(**checks: Column) -> Column:
    """Names of the checks that a row fails; a check that is null counts as passed."""
    return F.array_compact(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()]))


def filled(name: str) -> Column:
    return F.coalesce(F.length(F.col(name)) > 0, F.lit(False))


def scraped_event_violations() -> Column:
    start, end = instant(F.col("startAt")), instant(F.col("endAt"))
    return violations(
        sourceId=filled("sourceId"),
        externalId=filled("externalId"),
        title=filled("title"),
        category=filled("category"),
        startAt=F.coalesce(is_instant(F.col("startAt")) & start.isNotNull(), F.lit(False)),
        endAt=F.col("endAt").isNull() | (is_instant(F.col("endAt")) & end.isNotNull()),
        endAfterStart=end > start,
        location=is_valid_point(F.col("location")),
        state=F.coalesce(F.col("state").isin(*schemas.EVENT_STATES), F.lit(False)),
        venueName=F.length("venueName") > 0,
        dedupKey=F.length("dedupKey") > 0,
        sourceUrl=is_web_url(F.col("sourceUrl")),
    )


def event_body_violations(prefix: str = "e.") -> Column:
    """What an event's body breaks, as a client reads it: ids, texts that must be there, the state, instants in UTC with milliseconds, the point, the address."""
    at = lambda c: F.col(prefix + c)
    instant_text = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"
    given = {c: F.coalesce(F.length(at(c)) > 0, F.lit(False)) for c in ("sourceId", "externalId", "title", "category")}
    return violations(
        id=F.coalesce(at("id") > 0, F.lit(False)),
        **given,
        state=F.coalesce(at("state").isin(*schemas.EVENT_STATES), F.lit(False)),
        startAt=F.coalesce(at("startAt").rlike(instant_text), F.lit(False)),
        endAt=at("endAt").rlike(instant_text),
        location=at("location").isNull() | F.coalesce(is_valid_point(at("location")), F.lit(False)),
        sourceUrl=is_web_url(at("sourceUrl")),
    )


def validated(events: DataFrame) -> DataFrame:
    """The batch, if no row of it breaks the contract: one bad row fails the whole batch. All tasks look at once; a search for a first row would take them in turns."""
    bad = events.withColumn("violations", scraped_event_violations()).filter(F.size("violations") > 0)
    if found := bad.agg(F.min(F.struct("sourceId", "externalId", "violations")).alias("first")).first().first:
        raise ContractError(f"invalid event {found.sourceId}/{found.externalId}: {', '.join(found.violations)}")
    return events


def single_source(events: DataFrame, reserved: tuple[str, ...] = ()) -> str:
    """The batch's only sourceId, which must not be one of ``reserved``."""
    found = events.agg(F.count_distinct("sourceId").alias("n"), F.min("sourceId").alias("first"), F.count("*").alias("rows")).first()
    if not found.rows:
        raise ContractError("import: empty batch")
    if found.n != 1:
        raise ContractError(f"import: a batch has one sourceId, this one has {found.n}")
    if found.first in reserved:
        raise ContractError(f'import: sourceId "{found.first}" belongs to a registered source')
    return found.first


def region_violations() -> Column:
    level, parent = F.col("level"), F.col("parent_id")
    return violations(hierarchy=((level == 1) & parent.isNull()) | ((level > 1) & parent.isNotNull()))


def alert_violations() -> Column:
    return violations(estado=F.coalesce(F.col("estado").isin(*schemas.ALERT_LEVELS), F.lit(False)), location=F.col("location").isNotNull() & is_valid_point(F.col("location")))


def orphans(rows: DataFrame, key: str, referenced: DataFrame, by: str = "id") -> DataFrame:
    """Rows whose key isn't null and isn't there."""
    return rows.filter(F.col(key).isNotNull()).join(referenced.select(F.col(by).alias(key)), key, "left_anti")


def query_arguments(from_: str | None, to: str | None, category: str | None, source: str | None, limit: int | str) -> tuple[datetime | None, datetime | None, int]:
    def moment(name: str, value: str | None) -> datetime | None:
        if value is None:
            return None
        try:
            at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            at = None
        if at is None or at.tzinfo is None or "T" not in value:
            raise ValueError(f"{name} must be an ISO date and time with an offset")
        return at

    for name, value in (("category", category), ("source", source)):
        if value == "":
            raise ValueError(f"{name} must not be empty")
    limit = int(limit)
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    return moment("from", from_), moment("to", to), limit


def event_id_argument(event_id: int | str) -> int:
    value = int(event_id)
    if not 1 <= value <= 2147483647:
        raise ValueError("id must be a positive integer")
    return value
