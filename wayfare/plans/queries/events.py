"""Filters, shapes and summaries over the events table, read as events with an end and a place.

An event lasts k minutes, or has no end where k is divisible by 3; every fifth
user has no place.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import dates
from wayfare.functions.geo import point, point_text
from wayfare.functions.text import category_label, joined_parts, looked_up
from wayfare.operators import cursors, filters, summaries
from wayfare.plans import serving
from wayfare.plans.queries import Group, table

group = Group()

SQL_EVENTS = """(SELECT event_id AS id, ts AS start_at, user_id, event_type AS category, value, k,
    CASE WHEN k % 3 <> 0 THEN ts + to_minutes(k) END AS end_at,
    CASE WHEN user_id % 5 <> 0 THEN (user_id % 7) * 0.5 - 77.5 END AS lng,
    CASE WHEN user_id % 5 <> 0 THEN (user_id % 11) * 0.25 - 13.0 END AS lat
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    placed = F.col("user_id") % 5 != 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("start_at"),
        "user_id",
        F.col("event_type").alias("category"),
        "value",
        k.alias("k"),
        F.when(k % 3 != 0, F.col("ts") + F.make_dt_interval(mins=k)).alias("end_at"),
        F.when(placed, (F.col("user_id") % 7) * 0.5 - 77.5).alias("lng"),
        F.when(placed, (F.col("user_id") % 11) * 0.25 - 13.0).alias("lat"),
    )


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def overlap(events: DataFrame, from_: str | None, to: str | None) -> DataFrame:
    bounds = [None if b is None else ntz(b) for b in (from_, to)]
    return events.filter(filters.overlaps(F.col("start_at"), F.col("end_at"), *bounds)).orderBy("start_at", "id").limit(100)


SHOWN = "id, strftime(start_at, '%Y-%m-%d %H:%M:%S.%f') AS start_at, strftime(end_at, '%Y-%m-%d %H:%M:%S.%f') AS end_at, category"


def shown(events: DataFrame) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return events.select("id", F.date_format("start_at", form).alias("start_at"), F.date_format("end_at", form).alias("end_at"), "category")


@group(
    f"SELECT {SHOWN} FROM {SQL_EVENTS} WHERE coalesce(end_at, start_at) >= TIMESTAMP '2024-01-10 00:00:00' AND start_at <= TIMESTAMP '2024-01-12 00:00:00' ORDER BY 2, id LIMIT 100"
)
def events_overlap_window(spark, sf_dir):
    return shown(overlap(read_events(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))


@group(f"SELECT {SHOWN} FROM {SQL_EVENTS} WHERE coalesce(end_at, start_at) >= TIMESTAMP '2024-01-20 12:00:00' ORDER BY 2, id LIMIT 100")
def events_open_from(spark, sf_dir):
    return shown(overlap(read_events(spark, sf_dir), "2024-01-20 12:00:00", None))


@group(f"SELECT {SHOWN} FROM {SQL_EVENTS} WHERE start_at <= TIMESTAMP '2024-01-03 06:00:00' ORDER BY 2, id LIMIT 100")
def events_to_only(spark, sf_dir):
    return shown(overlap(read_events(spark, sf_dir), None, "2024-01-03 06:00:00"))


@group(f"SELECT {SHOWN} FROM {SQL_EVENTS} WHERE category = 'purchase' AND user_id = 17 AND coalesce(end_at, start_at) >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY 2, id LIMIT 100")
def events_filter_category_source(spark, sf_dir):
    events = read_events(spark, sf_dir).filter(filters.all_of([F.col("category") == "purchase", None, F.col("user_id") == 17]))
    return shown(overlap(events, "2024-01-05 00:00:00", None))


@group(f"SELECT {SHOWN} FROM {SQL_EVENTS} WHERE id = 42")
def event_by_id(spark, sf_dir):
    return shown(read_events(spark, sf_dir).filter(F.col("id") == 42))


GATED = ("error", "signup")


def gated(spark, sf_dir, **how) -> DataFrame:
    rule = filters.visible(F.col("category"), datetime(2024, 2, 1), gated=GATED, **how)
    return read_events(spark, sf_dir).filter(filters.all_of([rule])).groupBy("category").agg(F.count("*").alias("n"))


@group("SELECT event_type AS category, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1")
def visibility_gate(spark, sf_dir):
    return gated(spark, sf_dir)


@group("SELECT event_type AS category, count(*) AS n FROM events WHERE TIMESTAMP '2024-02-01' < TIMESTAMP '2024-03-01' OR event_type NOT IN ('error', 'signup') GROUP BY 1")
def visibility_gate_timed(spark, sf_dir):
    return gated(spark, sf_dir, exposed_until=datetime(2024, 3, 1))


@group("SELECT event_type AS category, count(*) AS n FROM events WHERE TIMESTAMP '2024-02-01' < TIMESTAMP '2024-02-01' OR event_type NOT IN ('error', 'signup') GROUP BY 1")
def visibility_gate_expired(spark, sf_dir):
    return gated(spark, sf_dir, exposed_until=datetime(2024, 2, 1))


@group(f"SELECT id, lng, lat, CASE WHEN lng IS NULL THEN 'Sin ubicación' ELSE printf('%.5f, %.5f', lat, lng) END AS place FROM {SQL_EVENTS}")
def event_shape_nullable_point(spark, sf_dir):
    events = read_events(spark, sf_dir).withColumn("location", point(F.col("lng"), F.col("lat")))
    return events.select("id", "location.lng", "location.lat", point_text(F.col("location")).alias("place"))


CENTRE = (-76.1, -11.9)
SQL_DISTANCE = f"""2 * 6371008.8 * asin(sqrt(pow(sin((radians({CENTRE[1]}) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians({CENTRE[1]})) * pow(sin((radians({CENTRE[0]}) - radians(lng)) / 2), 2)))"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, sf_dir).withColumn("location", point(F.col("lng"), F.col("lat")))


@group(f"SELECT id FROM {SQL_EVENTS} WHERE lng IS NOT NULL AND {SQL_DISTANCE} <= 60000")
def events_near_point(spark, sf_dir):
    return serving.events_near(located(spark, sf_dir), *CENTRE, 60000).select("id")


@group(f"SELECT id, round({SQL_DISTANCE}, 3) AS distance_m FROM {SQL_EVENTS} WHERE lng IS NOT NULL ORDER BY {SQL_DISTANCE}, id LIMIT 25")
def events_nearest(spark, sf_dir):
    return serving.nearest_events(located(spark, sf_dir), *CENTRE, 25).select("id", F.round("distance_m", 3).alias("distance_m"))


@group(f"""SELECT lng, lat, count(*) AS n, arg_min(category, struct_pack(s := start_at, i := id)) AS first_category
FROM {SQL_EVENTS} WHERE lng IS NOT NULL GROUP BY 1, 2""")
def group_by_point(spark, sf_dir):
    events = read_events(spark, sf_dir).withColumn("location", point(F.col("lng"), F.col("lat")))
    pins = summaries.by_point(events, [F.col("start_at"), F.col("id")], first="category")
    return pins.withColumnRenamed("category", "first_category")


@group("""SELECT n_name AS nation, c_custkey, rank, more FROM (
  SELECT n_name, c_custkey, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY n_name) - 10, 0) AS more
  FROM customer JOIN nation ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey))
WHERE rank <= 10""")
def group_top10(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    top = summaries.top_per_group(named, ["n_name"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 10)
    return top.select(F.col("n_name").alias("nation"), "c_custkey", F.col("rank").cast("long").alias("rank"), "more")


@group("SELECT DISTINCT event_type AS value FROM events UNION SELECT 'refund' ORDER BY 1")
def facets(spark, sf_dir):
    return summaries.facets(table(spark, sf_dir, "events"), "event_type", selected="refund")


@group(f"""SELECT count(*) AS total, count(*) FILTER (lng IS NULL) AS unpinned, count(*) FILTER (end_at IS NULL) AS without_end,
  count(*) FILTER (category = 'error') AS incidents, count(*) = count(*) FILTER (lng IS NULL) AS all_unpinned FROM {SQL_EVENTS}""")
def conditional_counts(spark, sf_dir):
    counts = summaries.counters(read_events(spark, sf_dir), unpinned=F.col("lng").isNull(), without_end=F.col("end_at").isNull(), incidents=F.col("category") == "error")
    return counts.withColumn("all_unpinned", F.col("total") == F.col("unpinned"))


#: State per kind of event: successes are values of 10 or more, failures since the last success are counted.
SQL_STATE = """(SELECT event_type AS source_id, max(ts) AS last_run_at, max(ts) FILTER (value >= 10) AS last_success_at,
    count(*) FILTER (value < 10 AND ts > coalesce(ok, TIMESTAMP '1970-01-01')) AS consecutive_failures
  FROM (SELECT *, max(CASE WHEN value >= 10 THEN ts END) OVER (PARTITION BY event_type) AS ok FROM events) GROUP BY 1)"""


def read_state(spark, sf_dir) -> DataFrame:
    events, good = table(spark, sf_dir, "events"), F.col("value") >= 10
    ok = events.filter(good).groupBy("event_type").agg(F.max("ts").alias("ok"))
    since = events.join(ok, "event_type", "left")
    late = ~good & (F.col("ts") > F.coalesce("ok", F.lit("1970-01-01").cast("timestamp_ntz")))
    return since.groupBy(F.col("event_type").alias("source_id")).agg(F.max("ts").alias("last_run_at"), F.max(F.when(good, F.col("ts"))).alias("last_success_at"), F.count_if(late).alias("consecutive_failures"))


@group(f"""SELECT source_id, strftime(last_run_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_run_at, strftime(last_success_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_success_at, consecutive_failures
FROM {SQL_STATE} ORDER BY 1""")
def source_status_projection(spark, sf_dir):
    state = read_state(spark, sf_dir)
    return state.select("source_id", dates.iso_utc(F.col("last_run_at")).alias("last_run_at"), dates.iso_utc(F.col("last_success_at")).alias("last_success_at"), "consecutive_failures").orderBy("source_id")


@group(f"""SELECT strftime(max(last_success_at), '%Y-%m-%d %H:%M:%S.%f') AS newest_success, count(*) AS sources, count(*) FILTER (consecutive_failures > 0) AS failing,
  coalesce(string_agg(source_id, ',' ORDER BY source_id) FILTER (consecutive_failures > 0), '') AS failing_labels FROM {SQL_STATE}""")
def freshness_rollup(spark, sf_dir):
    found = summaries.freshness(read_state(spark, sf_dir), F.col("source_id"))
    return found.select(F.date_format("newest_success", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest_success"), "sources", "failing", F.array_join("failing_labels", ",").alias("failing_labels"))


@group("""SELECT user_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR (ts, event_id) > (ok.t, ok.i))) AS consecutive_failures, count(*) AS runs
FROM (SELECT e.*, o.ok FROM events e LEFT JOIN (SELECT user_id, max(struct_pack(t := ts, i := event_id)) AS ok FROM events WHERE event_type <> 'error' GROUP BY 1) o USING (user_id)) GROUP BY 1""")
def failure_streak(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    at = F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i"))
    bad = F.col("event_type") == "error"
    ok = events.filter(~bad).groupBy("user_id").agg(F.max(at).alias("ok"))
    streak = F.count_if(bad & (F.col("ok").isNull() | (at > F.col("ok"))))
    return events.join(ok, "user_id", "left").groupBy("user_id").agg(streak.alias("consecutive_failures"), F.count("*").alias("runs"))


@group("SELECT greatest(max(event_id), 500) AS high_water FROM events WHERE event_type = 'click'")
def cursor_high_water(spark, sf_dir):
    return cursors.high_water(table(spark, sf_dir, "events").filter("event_type = 'click'"), "event_id", 500)


@group("SELECT event_id, event_type FROM events WHERE event_id > 750")
def incremental_delta(spark, sf_dir):
    return filters.after(table(spark, sf_dir, "events"), "event_id", 750).select("event_id", "event_type")


@group("""SELECT id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'O')
ORDER BY CAST(id AS BIGINT) DESC LIMIT 800""")
def seen_set_bounded_numeric(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("id"))
    return cursors.largest_seen(ids.filter("o_orderstatus = 'O'"), ids.filter("o_orderstatus <> 'O'"), "id")


@group("""SELECT path, row_number() OVER (ORDER BY part, pos) AS place FROM (SELECT * FROM (
  SELECT 'p' || o_orderkey AS path, 0 AS part, o_orderkey AS pos FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-25' UNION ALL
  SELECT 'p' || o_orderkey, 1, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-25') ORDER BY part DESC, pos DESC LIMIT 200)""")
def seen_set_bounded_recent(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("pos"), (F.col("o_orderdate") < ntz("1998-07-25")).alias("old"))
    kept = cursors.latest_seen(rows.filter("old"), rows.filter("not old"), "path", "pos")
    return kept.withColumn("place", F.col("place").cast("long"))


@group("""SELECT id, strftime(start_at, '%H:%M') IN ('05:00', '04:59') AS whole_day FROM (
  SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 5 HOUR WHEN 1 THEN date_trunc('day', ts) + INTERVAL 299 MINUTE ELSE ts END AS start_at FROM events)""")
def whole_day_boundary(spark, sf_dir):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    at = F.when(F.col("event_id") % 3 == 0, day + F.expr("interval 5 hours")).when(F.col("event_id") % 3 == 1, day + F.expr("interval 299 minutes")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), dates.is_whole_day(at).alias("whole_day"))


@group("""SELECT id, CASE WHEN m < 1 THEN 'hace un momento' WHEN m < 60 THEN 'hace ' || m || ' min' WHEN h < 48 THEN 'hace ' || h || ' h'
  ELSE 'hace ' || CAST(floor(h / 24.0 + 0.5) AS BIGINT) || ' días' END AS age
FROM (SELECT id, m, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM (
  SELECT event_id AS id, greatest(CAST(floor((epoch_us(TIMESTAMP '2024-01-25 12:00:00') - epoch_us(ts)) / 6e7 + 0.5) AS BIGINT), 0) AS m FROM events))""")
def relative_age(spark, sf_dir):
    age = dates.relative_age(F.col("ts").cast("timestamp"), F.lit("2024-01-25 12:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), age.alias("age"))


@group("""SELECT event_type AS code, CASE event_type WHEN 'click' THEN 'Clic' WHEN 'view' THEN 'Vista' ELSE upper(left(event_type, 1)) || substr(event_type, 2) END AS label,
  count(*) AS n FROM events GROUP BY 1, 2""")
def label_fallback(spark, sf_dir):
    label = looked_up(F.col("event_type"), {"click": "Clic", "view": "Vista"}, category_label(F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), label.alias("label")).agg(F.count("*").alias("n"))


@group("SELECT p_partkey, concat_ws(' · ', nullif(p_name, ''), CASE WHEN p_size % 2 = 0 THEN p_brand END) AS line FROM part")
def joined_parts_line(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", joined_parts(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("line"))


@group("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS is_json FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.try_parse_json("props").isNotNull().alias("is_json")
    )


@group("SELECT count(DISTINCT event_type) AS sources, count(*) AS n, count(DISTINCT event_type) = 1 AS homogeneous FROM events WHERE user_id = 3")
def batch_homogeneity(spark, sf_dir):
    batch = table(spark, sf_dir, "events").filter("user_id = 3")
    return batch.agg(F.count_distinct("event_type").alias("sources"), F.count("*").alias("n")).withColumn("homogeneous", F.col("sources") == 1)


@group("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate < TIMESTAMP '1996-01-01')""")
def never_run_sources(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < ntz("1996-01-01")).select(F.col("o_custkey").alias("c_custkey"))
    return filters.unseen(table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey", "c_mktsegment")
