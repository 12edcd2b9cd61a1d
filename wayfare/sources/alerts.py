"""The road-alert snapshot: three arrays of features, one per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions.dates import dmy_text, dmy_time_text, instant
from wayfare.functions.text import require, without_bom

ALERTS = "sutran-alerts"
_PROPERTIES = "map<string,string>"
_FEATURE = f"struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:{_PROPERTIES}>"
SNAPSHOT = f"struct<{','.join(f'{level}:array<{_FEATURE}>' for level in schemas.ALERT_LEVELS)},fecha_hora_actualizacion:string>"
FIELDS = ("codigo_via", "nombre_carretera", "afectacion", "evento", "motivo", "fuente", "ubigeo")


def road_alerts(pages: DataFrame) -> DataFrame:
    """Rows of the alert table but for id and fetched_at. The array's name is the level; bad dates of an alert are null, a bad one of the snapshot fails the query."""
    text = without_bom(F.col("body"))
    frame = pages.select(text.alias("body")).withColumn("s", F.from_json("body", SNAPSHOT)).withColumn("at", dmy_time_text(F.col("s.fecha_hora_actualizacion")))
    arrays = [F.col(f"s.{level}").isNotNull() for level in schemas.ALERT_LEVELS]
    fault = (
        F.when(F.try_parse_json("body").isNull(), F.lit("response is not JSON"))
        .when(~reduce(lambda a, b: a & b, arrays), F.lit("a level is missing"))
        .when(F.col("at").isNull(), F.concat(F.lit("unparseable dataset timestamp "), F.coalesce(F.col("s.fecha_hora_actualizacion"), F.lit("none"))))
    )
    frame = frame.withColumn("at", require(fault.isNull(), F.col("at"), F.concat(F.lit(f"{ALERTS}: "), fault)))
    # One read of the pages for all levels; the check comes with it, so the fault shows even where a level is empty.
    placed = lambda level: F.transform(F.col(f"s.{level}"), lambda f, i: F.struct(F.lit(level).alias("estado"), i.alias("place"), f.alias("f")))
    rows = frame.select("at", F.inline(F.when(F.col("at").isNotNull(), F.concat(*map(placed, schemas.ALERT_LEVELS)))))
    bad = (F.col("f.type") != "Feature") | (F.col("f.geometry.type") != "Point") | (F.size("f.geometry.coordinates") != 2)
    p = F.col("f.properties")
    point = F.struct(F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))
    return rows.select(
        require(~F.coalesce(bad, F.lit(True)), F.col("estado"), f"{ALERTS}: not a point feature").alias("estado"),
        "place",
        point.alias("location"),
        *[F.try_element_at(p, F.lit(name)).alias(name) for name in FIELDS],
        instant(dmy_time_text(F.try_element_at(p, F.lit("fecha_actualizacion")))).alias("reported_at"),
        dmy_text(F.try_element_at(p, F.lit("fecha_evento"))).try_cast("date").alias("event_started_on"),
        instant(F.col("at")).alias("dataset_updated_at"),
        F.to_json(p).alias("source_payload"),
    )
