"""Gate audit: the live gates over past posts, with the stage each one reaches. Writes no table of the engine."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import gates
from wayfare.functions import vocabulary as V
from wayfare.functions.dates import date_range, ends_before
from wayfare.functions.text import fold
from wayfare.operators.cursors import backfill_start
from wayfare.sources.captures import main_text
from wayfare.sources.posts import MUNICIPAL, municipal_gated

DETAILS_MOST = 40
AUDIT = (
    "source string, id long, postDate string, url string, title string, stage string, keywords array<string>, matchedDate string, pastHits array<string>, endsBeforePost boolean, limaHit boolean, desc string"
)


def _rows(frame: DataFrame, **values) -> DataFrame:
    from pyspark.sql.types import StructType

    return frame.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(AUDIT)])


def audit_municipal(posts: DataFrame, now: datetime, days: int = 60) -> DataFrame:
    frame = municipal_gated(posts.filter(F.col("date") > backfill_start(now, days)))
    passed = F.col("stage").isin("past-event", "extracted")
    # An empty title skips a live post; the audit judges its text all the same.
    stage = (
        F.when(F.size("keywords") == 0, F.lit("no-trigger"))
        .when(~gates.near_road(F.col("folded")), F.lit("no-road-context"))
        .when(F.col("found").isNull(), F.lit("no-date"))
        .when(ends_before(F.col("found"), F.col("posted")), F.lit("past-event"))
        .otherwise(F.lit("extracted"))
    )
    frame = frame.withColumn("stage", stage)
    gated = F.col("stage").isin("no-trigger", "no-road-context")
    return _rows(
        frame, source=F.lit(MUNICIPAL), id=F.col("id"), postDate=F.col("date"), url=F.col("link"), title=F.col("headline"), stage=F.col("stage"),
        keywords=F.when(~gated, F.col("keywords")), matchedDate=F.when(passed, F.col("found.raw")), pastHits=gates.past_hits(F.col("folded")),
        endsBeforePost=F.when(passed, F.col("stage") == "past-event"),
    )


def audit_institution(listed: DataFrame, details: DataFrame, institution: str, now: datetime, days: int = 60) -> DataFrame:
    """listed: rows of the HTML listing; details: captures by link. A page is judged for the first ``DETAILS_MOST`` items with a trigger."""
    source = F.lit(f"gob-pe-{institution}")
    cutoff = (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S")
    once = Window.partitionBy("id").orderBy("url")
    items = listed.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n").filter(F.col("datetime") >= cutoff)
    items = items.withColumn("hit", gates.passes_listing(F.col("title"), F.col("description")))
    # Forty rows: with them at hand, the pages of all other items are neither moved nor joined.
    judged = items.filter("hit").orderBy(F.col("datetime").desc(), F.col("id").desc()).limit(DETAILS_MOST).select("id", "link").collect()
    judged_ids = listed.sparkSession.createDataFrame([(r.id, True) for r in judged], "id long, within_cap boolean")
    items = items.join(F.broadcast(judged_ids), "id", "left").withColumn("posted", F.substring("datetime", 1, 10).try_cast("date"))
    pages = F.broadcast(details.select(F.col("url").alias("link"), "kind", "body").filter(F.col("link").isin([r.link for r in judged])))
    frame = items.join(pages, "link", "left").withColumn("main", F.when(F.col("within_cap"), main_text(F.col("body"))))
    frame = frame.withColumn("text", F.concat("title", F.lit("\n"), F.coalesce("main", F.lit("")))).withColumn("folded", fold(F.col("text")))
    frame = frame.withColumn("keywords", gates.trigger_keywords(F.col("folded"))).withColumn("found", date_range(F.col("text"), F.col("posted")))
    kind, lima = F.coalesce("kind", F.lit("transient")), gates.in_lima(F.col("folded"))
    past = F.coalesce(ends_before(F.col("found"), F.col("posted")), F.lit(False))
    stage = (
        F.when(~F.col("hit"), F.lit("no-trigger-listing"))
        .when(F.col("within_cap").isNull(), F.lit("detail-cap-skipped"))
        .when(kind != "ok", F.concat(F.lit("detail-fetch-failed-"), kind))
        .when(F.size("keywords") == 0, F.lit("no-trigger"))
        .when(~gates.near_road(F.col("folded")), F.lit("no-road-context"))
        .when(F.lit(institution in V.NATIONAL_INSTITUTIONS) & ~lima, F.lit("non-lima"))
        .when(past, F.lit("past-event"))
        .otherwise(F.lit("extracted"))
    )
    frame = frame.withColumn("stage", stage)
    read = ~F.col("stage").startswith("no-trigger-listing") & ~F.col("stage").startswith("detail-")
    gated, judged = F.col("stage").isin("non-lima", "past-event", "extracted"), F.col("stage").isin("past-event", "extracted")
    return _rows(
        frame, source=source, id=F.col("id"), postDate=F.col("datetime"), url=F.col("link"), title=F.col("title"), desc=F.col("description"), stage=F.col("stage"),
        keywords=F.when(gated, F.col("keywords")), matchedDate=F.when(judged, F.col("found.raw")), pastHits=F.when(read, gates.past_hits(F.col("folded"))).otherwise(F.array().cast("array<string>")),
        limaHit=F.when(gated, lima), endsBeforePost=F.when(judged, past),
    )


#: Tasks that write one source at most.
WRITERS = 16


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "stage").agg(F.count("*").alias("n")).orderBy("source", "stage")


def write(rows: DataFrame, path: str) -> None:
    """JSON lines, one folder per source; a large source is written by several tasks."""
    rows.repartition("source", F.pmod(F.xxhash64("id"), F.lit(WRITERS))).write.mode("overwrite").partitionBy("source").json(path)
