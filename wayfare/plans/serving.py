"""Serving queries over stored tables: what the read routes return, as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.dates import iso_utc
from wayfare.functions.geo import distance_m, point, within
from wayfare.functions.text import category_label, joined_parts, source_label, state_label
from wayfare.operators.filters import all_of, overlaps, overlaps_by_class, visible
from wayfare.operators.summaries import by_point, facets, freshness, severity
from wayfare.operators.validate import event_body_violations, event_id_argument, query_arguments
from wayfare.schemas import POINT

DEFAULT_LIMIT = 100


def event_shape(events: DataFrame) -> DataFrame:
    """The response's columns: instants as UTC text, a location only if both coordinates are there."""
    return events.select(
        "id", F.col("source_id").alias("sourceId"), F.col("external_id").alias("externalId"), F.col("region_id").alias("regionId"), "title", "category", "state",
        iso_utc(F.col("start_at")).alias("startAt"), iso_utc(F.col("end_at")).alias("endAt"), point(F.col("location.lng"), F.col("location.lat")).alias("location"),
        F.col("venue_name").alias("venueName"), F.col("source_url").alias("sourceUrl"),
    )


def events_query(
    events: DataFrame, now: datetime, from_: str | None = None, to: str | None = None, category: str | None = None, source: str | None = None,
    limit: int | str = DEFAULT_LIMIT, exposed: bool = False, exposed_until: datetime | None = None,
) -> DataFrame:
    """Events that meet [from, to], earliest first. Cancelled ones are among them; gated sources are not, whatever source says."""
    begin, end, limit = query_arguments(from_, to, category, source, limit)
    literal: list[Column | None] = [None if x is None else F.lit(x).cast("timestamp") for x in (begin, end)]
    # With the store's class of duration, both bounds can skip row groups.
    kind = [F.col("_class")] if "_class" in events.columns else []
    overlap = (overlaps_by_class if kind else overlaps)(F.col("start_at"), F.col("end_at"), *kind, *literal)
    condition = all_of(
        [
            visible(F.col("source_id"), now, exposed, exposed_until),
            overlap,
            None if category is None else F.col("category") == category,
            None if source is None else F.col("source_id") == source,
        ]
    )
    return event_shape(events.filter(condition).orderBy("start_at", "id").limit(limit))


def as_json(response: DataFrame) -> DataFrame:
    """A response's rows as the JSON bodies that clients get: every field is there, null or not."""
    return response.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))


#: What a client reads an event's body as.
EVENT_BODY = f"id long, sourceId string, externalId string, regionId long, title string, category string, state string, startAt string, endAt string, location {POINT}, venueName string, sourceUrl string"


def revalidated(bodies: DataFrame) -> DataFrame:
    """Bodies as a client reads them: typed columns, and ``violations`` of the response's contract; a body that isn't such an object has ``body`` alone."""
    read = bodies.select(F.from_json("body", EVENT_BODY).alias("e"), F.try_parse_json("body").isNotNull().alias("is_json"))
    return read.select("e.*", F.when(F.col("is_json"), event_body_violations()).otherwise(F.array(F.lit("body"))).alias("violations"))


def event_query(events: DataFrame, event_id: int | str, now: datetime, exposed: bool = False, exposed_until: datetime | None = None) -> DataFrame:
    """The event of an id: no row if there is none, or if it is gated."""
    condition = all_of([F.col("id") == event_id_argument(event_id), visible(F.col("source_id"), now, exposed, exposed_until)])
    return event_shape(events.filter(condition).limit(1))


def sources_query(state: DataFrame) -> DataFrame:
    """Freshness per source, without the text of errors."""
    times = [iso_utc(F.col(c)).alias(a) for c, a in (("last_run_at", "lastRunAt"), ("last_success_at", "lastSuccessAt"), ("last_error_at", "lastErrorAt"))]
    return state.select(F.col("source_id").alias("sourceId"), *times, F.col("consecutive_failures").alias("consecutiveFailures")).orderBy("sourceId")


def road_alerts_query(alerts: DataFrame) -> DataFrame:
    """The snapshot, most severe first."""
    return alerts.orderBy(severity(F.col("estado")), "id").select(
        "id", "estado", "location", F.col("codigo_via").alias("codigoVia"), F.col("nombre_carretera").alias("nombreCarretera"), "afectacion", "evento", "motivo", "fuente", "ubigeo",
        iso_utc(F.col("reported_at")).alias("reportedAt"), F.date_format("event_started_on", "yyyy-MM-dd").alias("eventStartedOn"), iso_utc(F.col("dataset_updated_at")).alias("datasetUpdatedAt"),
    )


def event_pins(events: DataFrame) -> DataFrame:
    return by_point(events, [F.col("start_at"), F.col("id")])


def category_facets(events: DataFrame, selected: str | None = None) -> DataFrame:
    return facets(events, "category", selected)


def freshness_query(state: DataFrame) -> DataFrame:
    return freshness(state, source_label(F.col("source_id")))


def labelled(events: DataFrame) -> DataFrame:
    """Events with the labels that people read."""
    labels = {"category_label": category_label(F.col("category")), "source_label": source_label(F.col("source_id")), "state_label": state_label(F.col("state"))}
    return events.withColumns(labels).withColumn("subtitle", joined_parts(F.col("category_label"), F.col("venue_name")))


def events_near(events: DataFrame, lng: float, lat: float, metres: float) -> DataFrame:
    return events.filter(within(F.col("location"), lng, lat, metres, F.col("_place") if "_place" in events.columns else None))


#: Half of the largest distance of two points, in metres; a ring beyond it holds all.
FARTHEST_M = 10_000_000.0


def nearest_events(events: DataFrame, lng: float, lat: float, k: int, first_m: float = 2000.0) -> DataFrame:
    """The k located events nearest to a point, with their distance in metres.

    Rings widen fourfold until one holds k events, so of the store's rows (read with
    ``hidden``) only the cells of that ring are read; a top-k per task is then that
    of the ring. Fewer than k in all are all returned.
    """
    centre = F.struct(F.lit(lng).alias("lng"), F.lit(lat).alias("lat"))
    located = events.filter(F.col("location.lng").isNotNull() & F.col("location.lat").isNotNull())
    metres = first_m
    while metres < FARTHEST_M and events_near(located, lng, lat, metres).limit(k).count() < k:
        metres *= 4
    ring = events_near(located, lng, lat, metres) if metres < FARTHEST_M else located
    return ring.withColumn("distance_m", distance_m(F.col("location"), centre)).orderBy("distance_m", "id").limit(k)


def region_tree(regions: DataFrame, levels: int = 1000) -> DataFrame:
    """Each region with the slugs from its root down, whatever its depth. Regions under a loop have no root and aren't listed; more than ``levels`` levels raise."""
    query = f"""WITH RECURSIVE tree(id, path) MAX RECURSION LEVEL {levels} AS (
      SELECT id, array(slug) FROM {{regions}} WHERE parent_id IS NULL
      UNION ALL SELECT r.id, concat(t.path, array(r.slug)) FROM {{regions}} r JOIN tree t ON r.parent_id = t.id)
    SELECT id, path FROM tree"""
    return regions.sparkSession.sql(query, regions=regions)
