"""Incremental delivery over the events table, as a stream of files with keyed merges."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from wayfare.operators.patterns import first_match
from wayfare.plans.queries import Group, table
from wayfare.plans.store import Store
from wayfare.sources.paged import paged_posts, write_pages
from wayfare.streaming import state
from wayfare.streaming.incremental import event_files, merge_into, run_available

group = Group()


@group("SELECT 's' || user_id % 3 AS source_id, count(*) AS n, count(*) AS ids FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """All events arrive as files, the first third twice; the store ends with each of them once."""
    from wayfare.plans.queries.rules import shared_root

    root = shared_root(spark, "stream")
    events = table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = events.select(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("sourceId"), F.col("event_id").cast("string").alias("externalId"), F.col("event_type").alias("title"), iso.alias("startAt"),
        F.lit("scheduled").alias("state"), F.col("event_type").alias("category"), F.col("props").alias("sourcePayload"), "event_id",
    )
    n = F.expr("event_id % 3")
    rows.filter(n == 0).drop("event_id").write.json(f"{root}/in/first")
    store = Store(spark, f"{root}/store")
    store.migrate()
    write = merge_into(store, "stream", lambda: datetime(2024, 2, 1, tzinfo=UTC))
    stream = lambda: event_files(spark, f"{root}/in/*")
    run_available(stream(), write, f"{root}/checkpoint")
    rows.drop("event_id").write.json(f"{root}/in/second")
    run_available(stream(), write, f"{root}/checkpoint")
    return store.read("events").groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@group("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) AS ids FROM orders GROUP BY 1")
def stream_paged_posts(spark, sf_dir):
    """Orders as posts on monthly pages: the stream reads half of them, stops, and goes on from its checkpoint when the others are there."""
    from wayfare.plans.queries.rules import shared_root

    root = shared_root(spark, "pages")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), date.alias("date"), F.lit("l").alias("link"), F.col("o_orderpriority").alias("title"), F.lit("").alias("content"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    for part in ("month < '1995-01'", "month >= '1995-01'"):
        write_pages(posts.filter(part), "month", f"{root}/pages")
        query = paged_posts(spark, f"{root}/pages").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


#: Runs of a source are the days of its orders; a day whose least key is divisible by three failed.
SQL_RUNS = """(SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS k FROM orders GROUP BY ALL)"""


@group(f"""SELECT source AS source_id, strftime(max(day), '%Y-%m-%d') AS last_run, strftime(max(day) FILTER (k % 3 > 0), '%Y-%m-%d') AS last_success, strftime(max(day) FILTER (k % 3 = 0), '%Y-%m-%d') AS last_failure,
  count(*) FILTER (k % 3 = 0 AND day > coalesce(success, DATE '1900-01-01')) AS consecutive_failures, CAST(max(k) FILTER (day = success) AS VARCHAR) AS "cursor"
  FROM (SELECT *, max(day) FILTER (k % 3 > 0) OVER (PARTITION BY source) AS success FROM {SQL_RUNS}) GROUP BY source""")
def stream_source_state(spark, sf_dir):
    """Cursors and streaks of failures as keyed state of a stream, over two deliveries of which the second brings part of the first again."""
    from wayfare.plans.queries.rules import shared_root

    root = shared_root(spark, "status")
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source_id"), F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("k"))
    failed = F.col("k") % 3 == 0
    runs = runs.select("source_id", F.col("day").cast("timestamp").alias("at"), F.when(failed, "no page").alias("error"), (~failed).alias("has_cursor"), F.when(~failed, F.col("k").cast("string")).alias("cursor"))
    for part in ("at < timestamp'1995-01-01'", "at >= timestamp'1994-06-01'"):
        runs.filter(part).coalesce(4).write.mode("append").parquet(f"{root}/in")
        status = state.source_status(spark.readStream.schema(state.OUTCOME).parquet(f"{root}/in"))
        # A status is written whole, and a later one of the source takes its place.
        query = status.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{root}/out"))
        query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{root}/out").groupBy("source_id").agg(F.max_by(F.struct("*"), F.struct("last_run_at", "epoch")).alias("s")).select("s.*")
    day = lambda c, a: F.date_format(c, "yyyy-MM-dd").alias(a)
    return newest.select("source_id", day("last_run_at", "last_run"), day("last_success_at", "last_success"), day("last_error_at", "last_failure"), F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "cursor")


@group("""SELECT k AS id, CASE WHEN k % 7 = 0 THEN k % 10 WHEN k % 11 = 0 THEN 10 END AS place FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 7 = 0 OR k % 11 = 0""")
def venue_pattern_join(spark, sf_dir):
    """Venue names against a table of patterns: the first one that a name has."""
    names = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "CASE WHEN o_orderkey % 7 = 0 THEN concat('gran estadio numero', o_orderkey % 10, ' de lima') WHEN o_orderkey % 11 = 0 THEN 'plaza mayor' ELSE concat('casa numero', o_orderkey) END name")
    patterns = [(i, rf"estadios?\s+numero{i}\b|coliseo {i}") for i in range(10)] + [(10, "plaza (mayor|de armas)"), (11, "estadio")]
    return first_match(names, "name", spark.createDataFrame(patterns, "place long, pattern string"))
