"""Manual imports: JSON arrays of events, and CSV of fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions.geo import point
from wayfare.functions.text import blank_to_null
from wayfare.operators.validate import ContractError, validated

CSV_COLUMNS = ("sourceId", "externalId", "title", "category", "state", "startAt", "endAt", "lng", "lat", "sourceUrl")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of events; payloads of any shape are kept as their JSON text."""
    element = f"array<struct<{', '.join(f'{c}: {t}' for c, t in _fields())}>>"
    files = spark.read.text(path, wholetext=True).withColumn("rows", F.from_json("value", element))
    if files.filter(F.col("rows").isNull()).head(1):
        raise ContractError(f"import: {path} is not a JSON array of events")
    return validated(files.select(F.explode("rows").alias("r")).select("r.*"))


def _fields() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in _schema(schemas.SCRAPED_EVENT)]


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 rows under exactly the expected header. Cells are trimmed, empty ones are absent; a point needs both coordinates."""
    options = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    head = spark.read.csv(path, header=False, schema=", ".join(f"c{i} string" for i in range(len(CSV_COLUMNS) + 1)), mode="PERMISSIVE", **options).first()
    got = [v for v in (head or ()) if v is not None]
    if tuple(got) != CSV_COLUMNS:
        raise ContractError(f'import: CSV header must be exactly "{",".join(CSV_COLUMNS)}" (got "{",".join(got)}")')
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CSV_COLUMNS), enforceSchema=False, **options)
    cells = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in CSV_COLUMNS}
    rows = rows.filter(F.concat_ws("", *CSV_COLUMNS) != "")
    payload = F.to_json(F.struct(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("importedFrom"), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in CSV_COLUMNS]).alias("raw")))
    lng, lat = blank_to_null(cells["lng"]), blank_to_null(cells["lat"])
    values = {c: cells[c] for c in ("sourceId", "externalId", "title", "category", "state", "startAt")}
    values |= {"endAt": F.nullif(cells["endAt"], F.lit("")), "sourceUrl": F.nullif(cells["sourceUrl"], F.lit("")), "location": point(lng.try_cast("double"), lat.try_cast("double")), "sourcePayload": payload}
    bad = rows.filter((lng.isNotNull() & lng.try_cast("double").isNull()) | (lat.isNotNull() & lat.try_cast("double").isNull()))
    if bad.head(1):
        raise ContractError("import: a coordinate is not a number")
    return validated(rows.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _fields()]))


def read_import(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path) if path.lower().endswith(".json") else read_csv(spark, path)
