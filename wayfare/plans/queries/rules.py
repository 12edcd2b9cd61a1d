"""Contracts, labels, shapes, imports and runs: the library's own functions over rows made from orders and events."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions import dates, gates, geo, text
from wayfare.operators.filters import overlaps_by_class
from wayfare.operators.validate import ContractError, scraped_event_violations
from wayfare.plans import ingest, serving
from wayfare.plans.queries import Group, table
from wayfare.plans.queries.connectors import SQL_ORDERS, alert_pages, orders, spanish
from wayfare.plans.store import Store
from wayfare.sources import alerts, imports, pages, recurring

group = Group()


def scraped(rows: DataFrame, **columns: str) -> DataFrame:
    """Rows as scraped events; columns that aren't given are null."""
    ddl = {f.split()[0]: f.split(" ", 1)[1] for f in ("sourceId string", "externalId string", "title string", "startAt string", "endAt string", f"location {schemas.POINT}", "state string", "category string", "venueName string", "sourcePayload string", "sourceUrl string", "dedupKey string")}
    given = {"sourceId": "'manual'", "externalId": "cast(k as string)", "title": "concat('Acto ', k)", "startAt": "concat(d, 'T20:00:00-05:00')", "state": "'scheduled'", "category": "'civil'"} | columns
    return rows.select(*[F.expr(given.get(c, "null")).cast(t).alias(c) for c, t in ddl.items()])


def shared_root(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


# ---- Shapes ----


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the columns of the events table."""
    given = {
        "id": "k", "source_id": "CASE k % 5 WHEN 0 THEN 'joinnus' ELSE 'mml' END", "external_id": "concat('x', k)", "region_id": "1L", "title": "concat('Acto ', k)", "venue_name": "CASE WHEN k % 2 = 0 THEN 'Plaza' END",
        "category": "CASE k % 3 WHEN 0 THEN 'musica' WHEN 1 THEN 'futbol' ELSE 'feria' END", "state": "CASE WHEN k % 7 = 0 THEN 'cancelled' ELSE 'scheduled' END", "start_at": "cast(day as timestamp)",
        "end_at": "CASE WHEN k % 2 = 0 THEN cast(date_add(day, 1) as timestamp) END", "location": "CASE WHEN k % 3 > 0 THEN named_struct('lng', (k % 180) / 2.0D, 'lat', CASE WHEN k % 3 = 1 THEN (k % 90) / 2.0D END) END",
    }
    empty = spark.createDataFrame([], schemas.EVENTS)
    return orders(spark, sf_dir).select(*[F.expr(given.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in empty.schema])


SQL_RESPONSE = f"""(SELECT k AS id, CASE k % 5 WHEN 0 THEN 'joinnus' ELSE 'mml' END AS "sourceId", 'x' || k AS "externalId", 1 AS "regionId", 'Acto ' || k AS title, CASE k % 3 WHEN 0 THEN 'musica' WHEN 1 THEN 'futbol' ELSE 'feria' END AS category,
  CASE WHEN k % 7 = 0 THEN 'cancelled' ELSE 'scheduled' END AS state, d || 'T00:00:00.000Z' AS "startAt", CASE WHEN k % 2 = 0 THEN strftime(day + 1, '%Y-%m-%d') || 'T00:00:00.000Z' END AS "endAt",
  CASE WHEN k % 3 = 1 THEN CAST((k % 180) / 2.0 AS DOUBLE) END AS lng, CASE WHEN k % 3 = 1 THEN CAST((k % 90) / 2.0 AS DOUBLE) END AS lat, CASE WHEN k % 2 = 0 THEN 'Plaza' END AS "venueName", NULL::VARCHAR AS "sourceUrl" FROM {SQL_ORDERS})"""


def flat(response: DataFrame) -> DataFrame:
    return response.select(*[c for c in response.columns if c != "location"], F.col("location.lng").alias("lng"), F.col("location.lat").alias("lat"))


@group(f"SELECT * FROM {SQL_RESPONSE}")
def event_response(spark, sf_dir):
    return flat(serving.event_shape(stored_events(spark, sf_dir)))


@group(f"""SELECT * FROM {SQL_RESPONSE} WHERE "sourceId" <> 'joinnus' AND category = 'musica' AND "startAt" <= '1995-12-30T12:00:00.000Z' AND coalesce("endAt", "startAt") >= '1995-01-01T12:00:00.000Z' ORDER BY "startAt", id LIMIT 500""")
def events_route(spark, sf_dir):
    """The route's page: its limit is the feature."""
    return flat(serving.events_query(stored_events(spark, sf_dir), datetime(1996, 1, 1, tzinfo=UTC), "1995-01-01T12:00:00+00:00", "1995-12-30T12:00:00+00:00", category="musica", limit=500))


#: The body of each event, letter by letter.
SQL_BODY = f"""(SELECT id, '{{"id":' || id || ',"sourceId":"' || "sourceId" || '","externalId":"' || "externalId" || '","regionId":1,"title":"' || title || '","category":"' || category || '","state":"' || state || '","startAt":"' || "startAt"
  || '","endAt":' || coalesce('"' || "endAt" || '"', 'null') || ',"location":' || coalesce('{{"lng":' || CAST(lng AS VARCHAR) || ',"lat":' || CAST(lat AS VARCHAR) || '}}', 'null') || ',"venueName":' || coalesce('"' || "venueName" || '"', 'null') || ',"sourceUrl":null}}' AS body FROM {SQL_RESPONSE})"""


@group(f"SELECT md5(body) AS body_md5 FROM {SQL_BODY}")
def event_response_json(spark, sf_dir):
    return serving.as_json(serving.event_shape(stored_events(spark, sf_dir))).select(F.md5("body").alias("body_md5"))


@group("""SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN 'id' WHEN o_orderkey % 6 = 1 THEN 'state' WHEN o_orderkey % 6 = 2 THEN 'startAt' WHEN o_orderkey % 6 = 3 THEN 'title,location' WHEN o_orderkey % 6 = 4 THEN 'sourceUrl' ELSE '' END AS violations FROM orders WHERE o_orderkey % 6 < 5
UNION ALL SELECT -1, 'body' FROM orders WHERE o_orderkey % 6 = 5""")
def client_revalidation(spark, sf_dir):
    """Bodies read again by a client, of which most break the contract in some way."""
    text = """CASE k % 6 WHEN 5 THEN concat('<html>', k) ELSE concat('{"id":', k, ',"sourceId":"s","externalId":"x","title":"', if(k % 6 = 3, '', 'T'), '","category":"c","state":"', if(k % 6 = 1, 'past', 'scheduled'), '","startAt":"', d, if(k % 6 = 2, '', 'T20:00:00.000Z'),
      '","endAt":null,"location":', if(k % 6 = 3, '{"lng":-190.5,"lat":1.5}', 'null'), ',"sourceUrl":', if(k % 6 = 4, '"ftp://x"', '"https://x"'), '}') END"""
    found = serving.revalidated(orders(spark, sf_dir).select(F.expr(text).alias("body")))
    return found.select(F.coalesce("id", F.lit(-1)).alias("id"), F.array_join("violations", ",").alias("violations"))


@group("""SELECT event_type AS "sourceId", strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "lastRunAt", NULL::VARCHAR AS "lastSuccessAt", NULL::VARCHAR AS "lastErrorAt", 0 AS "consecutiveFailures" FROM events GROUP BY 1""")
def sources_route(spark, sf_dir):
    state = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.max("ts").alias("last_run_at"))
    none = F.lit(None).cast("timestamp")
    return serving.sources_query(state.withColumns({"last_success_at": none, "last_error_at": none, "consecutive_failures": F.lit(0)}))


@group(f"""SELECT k AS id, CASE k % 3 WHEN 0 THEN 'Música' WHEN 1 THEN 'Fútbol' ELSE 'Feria' END AS category_label, CASE k % 5 WHEN 0 THEN 'Joinnus' ELSE 'Municipalidad de Lima' END AS source_label,
  CASE WHEN k % 7 = 0 THEN 'Cancelado' ELSE 'Programado' END AS state_label, CASE k % 3 WHEN 0 THEN 'Música' WHEN 1 THEN 'Fútbol' ELSE 'Feria' END || CASE WHEN k % 2 = 0 THEN ' · Plaza' ELSE '' END AS subtitle FROM {SQL_ORDERS}""")
def event_labels(spark, sf_dir):
    return serving.labelled(stored_events(spark, sf_dir)).select("id", "category_label", "source_label", "state_label", "subtitle")


@group(f"""SELECT k, CASE WHEN k % 3 > 0 THEN 'SRID=4326;POINT(' || CAST(CAST((k % 180) / 2.0 AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST((k % 90) / 2.0 AS DOUBLE) AS VARCHAR) || ')' END AS wkt,
  CASE WHEN k % 3 > 0 THEN CAST((k % 180) / 2.0 AS DOUBLE) END AS lng, CASE WHEN k % 3 > 0 THEN CAST((k % 90) / 2.0 AS DOUBLE) END AS lat FROM {SQL_ORDERS}""")
def point_codec(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("wkt", geo.to_wkt(geo.point(F.expr("CASE WHEN k % 3 > 0 THEN (k % 180) / 2.0D END"), F.expr("(k % 90) / 2.0D"))))
    back = geo.from_wkt(F.col("wkt"))
    return rows.select("k", "wkt", back["lng"].alias("lng"), back["lat"].alias("lat"))


@group(f"""SELECT k, 'manual' AS source_id, CAST(k AS VARCHAR) AS external_id, 'Acto ' || k AS title, 1 AS region_id, strftime(day + 1, '%Y-%m-%d') || 'T01:00:00.000Z' AS start_at, CASE WHEN k % 2 = 0 THEN strftime(day + 1, '%Y-%m-%d') || 'T03:00:00.000Z' END AS end_at,
  CASE WHEN k % 3 = 0 THEN 'clave-' || k END AS dedup_key FROM {SQL_ORDERS}""")
def scraped_to_rows(spark, sf_dir):
    events = scraped(orders(spark, sf_dir), endAt="CASE WHEN k % 2 = 0 THEN concat(d, 'T22:00:00-05:00') END", dedupKey="CASE WHEN k % 3 = 0 THEN concat('clave-', k) END")
    rows = ingest.stored_rows(events, 1)
    return rows.select(F.col("external_id").cast("long").alias("k"), "source_id", "external_id", "title", "region_id", dates.iso_utc(F.col("start_at")).alias("start_at"), dates.iso_utc(F.col("end_at")).alias("end_at"), "dedup_key")


@group(f"""SELECT k, CASE WHEN k % 2 = 0 THEN '{{"titulo":"Acto ' || k || '"}}' ELSE '{{}}' END AS body FROM {SQL_ORDERS}""")
def blank_fields(spark, sf_dir):
    return orders(spark, sf_dir).select("k", F.to_json(F.struct(text.blank_to_null(F.expr("CASE WHEN k % 2 = 0 THEN concat(' Acto ', k) ELSE '  ' END")).alias("titulo"), text.blank_to_null(F.lit("")).alias("lugar"))).alias("body"))


# ---- Contracts ----


@group(f"""SELECT k, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'endAfterStart' WHEN 2 THEN 'state' WHEN 3 THEN 'sourceUrl' ELSE 'title,location' END AS broken FROM {SQL_ORDERS}""")
def event_contract(spark, sf_dir):
    events = scraped(
        orders(spark, sf_dir), endAt="CASE k % 5 WHEN 0 THEN concat(l, 'T20:00:00-05:00') WHEN 1 THEN concat(d, 'T19:00:00-05:00') END", state="CASE WHEN k % 5 = 2 THEN 'postponed' ELSE 'scheduled' END",
        sourceUrl="CASE WHEN k % 5 = 3 THEN 'ftp://x.pe' ELSE 'https://x.pe/a' END", title="CASE WHEN k % 5 = 4 THEN '' ELSE 'x' END", location="CASE WHEN k % 5 = 4 THEN named_struct('lng', 200.0D, 'lat', 0.0D) END",
    )
    return events.select(F.col("externalId").cast("long").alias("k"), F.array_join(scraped_event_violations(), ",").alias("broken"))


@group(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'https://x.pe/a/' || k WHEN 1 THEN 'https://y.pe/' || k WHEN 2 THEN 'http://z.pe' ELSE 'https://x.peftp' END AS url, k % 4 <> 3 AS web, CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) END AS id,
  'cuerpo' AS body FROM {SQL_ORDERS}""")
def url_parts(spark, sf_dir):
    href = F.expr("CASE k % 4 WHEN 0 THEN concat('/a/', k) WHEN 1 THEN concat('//y.pe/', k) WHEN 2 THEN 'http://z.pe' ELSE 'ftp' END")
    web = F.expr("CASE k % 4 WHEN 0 THEN 'https://x.pe/a' WHEN 1 THEN 'http://y.pe' WHEN 2 THEN 'https://z' ELSE 'javascript:alert(1)' END")
    return orders(spark, sf_dir).select("k", text.absolute_url(href, "https://x.pe").alias("url"), text.is_web_url(web).alias("web"), text.extracted(href, r"^/a/(\d+)$").alias("id"), text.without_bom(F.lit("﻿cuerpo")).alias("body"))


# ---- Dates ----

SQL_DISPLAY = """['lun', 'mar', 'mié', 'jue', 'vie', 'sáb', 'dom'][isodow(t)] || ', ' || date_part('day', t) || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'set', 'oct', 'nov', 'dic'][date_part('month', t)] || ' ' || date_part('year', t)"""


@group(f"""SELECT k, {SQL_DISPLAY} || CASE WHEN strftime(t, '%H:%M') IN ('00:00', '23:59') THEN '' ELSE ', ' || strftime(t, '%H:%M') END AS shown
FROM (SELECT k, CASE k % 3 WHEN 0 THEN CAST(day AS TIMESTAMP) WHEN 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 1439 MINUTE ELSE CAST(day AS TIMESTAMP) + INTERVAL 1170 MINUTE END AS t FROM {SQL_ORDERS})""")
def display_times(spark, sf_dir):
    at = F.expr("cast(cast(day as timestamp_ntz) + CASE k % 3 WHEN 0 THEN interval 300 minutes WHEN 1 THEN interval 1739 minutes ELSE interval 1470 minutes END as timestamp_ntz)")
    return orders(spark, sf_dir).select("k", dates.display_time(at).alias("shown"))


@group(f"SELECT k, CASE WHEN k % 2 = 0 THEN l END AS start_day FROM {SQL_ORDERS}")
def dates_fall_through(spark, sf_dir):
    """A pattern whose match isn't a real date gives way to the next one; without another there is no date."""
    sentence = F.expr(f"CASE WHEN k % 2 = 0 THEN concat('del 30 al 31 de febrero de 1990, o a partir del ', {spanish('later')}) ELSE 'del 30 al 31 de febrero de 1990' END")
    return orders(spark, sf_dir).select("k", F.date_format(dates.date_range(sentence, F.col("day"))["start"], "yyyy-MM-dd").alias("start_day"))


@group(f"SELECT k, CASE WHEN k % 3 = 2 THEN d END AS day, CASE WHEN k % 3 = 0 THEN d || 'T21:00:00-05:00' END AS ends FROM {SQL_ORDERS}")
def strict_dates_and_ends(spark, sf_dir):
    dashed = F.expr("CASE k % 3 WHEN 0 THEN '31-02-2001' WHEN 1 THEN '1-2-2001' ELSE date_format(day, 'dd-MM-yyyy') END")
    start, end = F.expr("concat(d, 'T20:00:00-05:00')"), F.expr("concat(d, CASE k % 3 WHEN 0 THEN 'T21' WHEN 1 THEN 'T20' ELSE 'T19' END, ':00:00-05:00')")
    return orders(spark, sf_dir).select("k", F.date_format(dates.dashed_date(dashed), "yyyy-MM-dd").alias("day"), dates.end_after_start(start, end).alias("ends"))


# ---- Signals of the gates, with their real words ----

SENTENCES = ("Culminamos y entregamos la obra en Miraflores", "Inauguró el desvío de la Vía Expresa", "Habrá cierre en la Línea Amarilla", "Concierto en Nazca")


@group(f"""SELECT k, ['culminamos,entregamos', 'inauguro', '', ''][k % 4 + 1] AS past, k % 4 < 2 AS lima, k % 4 IN (1, 2) AS listed,
  ['', 'Vía Expresa Paseo de la República', 'Línea Amarilla', ''][k % 4 + 1] AS arteries FROM {SQL_ORDERS}""")
def gate_signals(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, SENTENCES)), (F.col("k") % 4).cast("int"))
    folded = text.fold(said)
    return orders(spark, sf_dir).select(
        "k", F.array_join(gates.past_hits(folded), ",").alias("past"), gates.in_lima(folded).alias("lima"), gates.passes_listing(said, F.lit(None).cast("string")).alias("listed"), F.array_join(gates.arteries(folded), ",").alias("arteries")
    )


# ---- Imports, reference data and backfills ----


@group("""SELECT 'c' || c_custkey AS "externalId", 'Título, "' || c_custkey || '"' AS title, '2026-07-0' || (c_custkey % 9 + 1) || 'T20:00:00-05:00' AS "startAt", NULL::VARCHAR AS "endAt", CASE WHEN c_custkey % 2 = 0 THEN CAST(-77.5 AS DOUBLE) END AS lng,
  NULL::VARCHAR AS "sourceUrl" FROM customer""")
def csv_import_rows(spark, sf_dir):
    path = shared_root(spark, "import")
    values = {
        "sourceId": "'manual'", "externalId": "concat('c', c_custkey)", "title": "concat('Título, \"', c_custkey, '\"')", "category": "'civil'", "state": "'scheduled'", "startAt": "concat('2026-07-0', c_custkey % 9 + 1, 'T20:00:00-05:00')", "endAt": "''",
        "lng": "CASE WHEN c_custkey % 2 = 0 THEN '-77.5' ELSE '' END", "lat": "CASE WHEN c_custkey % 2 = 0 THEN '-12.5' ELSE '' END", "sourceUrl": "''",
    }
    table(spark, sf_dir, "customer").selectExpr(*[f"{values[c]} {c}" for c in imports.CSV_COLUMNS]).write.option("header", True).option("escape", '"').csv(path)
    return imports.read_csv(spark, path).select("externalId", "title", "startAt", "endAt", F.col("location.lng").alias("lng"), "sourceUrl")


@group("""SELECT 'n' || n_nationkey AS "externalId", n_name AS title, '2026-07-01T20:00:00-05:00' AS "startAt", CAST(-77.5 AS DOUBLE) AS lng FROM nation""")
def json_import_rows(spark, sf_dir):
    path = shared_root(spark, "import")
    row = "named_struct('sourceId', 'manual', 'externalId', concat('n', n_nationkey), 'title', n_name, 'startAt', '2026-07-01T20:00:00-05:00', 'state', 'scheduled', 'category', 'civil', 'location', named_struct('lng', -77.5D, 'lat', -12.5D))"
    # One file for each region, with an array of its nations.
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.expr(row))).alias("value"))
    nations.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return imports.read_json(spark, path).select("externalId", "title", "startAt", F.col("location.lng").alias("lng"))


def sql_values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


@group(sql_values([("PE", *r) for r in schemas.PERU_REGIONS], "country_code, slug, name, iso_code, lng, lat"))
def region_reference(spark, sf_dir):
    store = Store(spark, shared_root(spark, "regions"))
    store.migrate()
    store.migrate()
    return store.read("regions").select("country_code", "slug", "name", "iso_code", F.col("centroid.lng").alias("lng"), F.col("centroid.lat").alias("lat"))


@group(sql_values([(e[0], e[1], e[2], e[3], e[8]) for e in recurring.EVENTS], '"externalId", title, category, "startAt", "sourceUrl"'))
def recurring_events(spark, sf_dir):
    return recurring.recurring_events(spark).select("externalId", "title", "category", "startAt", "sourceUrl")


BACKFILLED = ("gran-teatro-nacional", "joinnus", "costa-21", "futbolperuano", "mml")


@group(f"""SELECT k AS id, CASE k % 5 WHEN 0 THEN 'Gran Teatro Nacional' WHEN 1 THEN 'V' || k WHEN 2 THEN 'V' || k WHEN 3 THEN 'E' || k END AS venue_name, CASE k % 5 WHEN 4 THEN 'nandu-avila-' || k END AS dedup_key FROM {SQL_ORDERS}""")
def backfills(spark, sf_dir):
    events = stored_events(spark, sf_dir).withColumns(
        {
            "source_id": F.get(F.array(*map(F.lit, BACKFILLED)), (F.col("id") % 5).cast("int")), "title": F.concat(F.lit("¡Ñandú, Ávila "), F.col("id")), "venue_name": F.lit(None).cast("string"),
            "source_payload": F.expr("concat('{\"venue\":\"V', id, '\",\"stadium\":\"E', id, '\"}')"),
        }
    )
    return ingest.backfilled(events).select("id", "venue_name", "dedup_key")


# ---- Runs ----

FIRST, SECOND, WINDOW_END = datetime(1995, 1, 1, tzinfo=UTC), datetime(1995, 2, 1, tzinfo=UTC), datetime(1998, 1, 1, tzinfo=UTC)


#: Of each session and folder: three queries read the same two runs.
_RUNS: dict[tuple[str, str], tuple[Store, list[ingest.RunSummary]]] = {}


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[Store, list[ingest.RunSummary]]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = _two_runs(spark, sf_dir)
    return _RUNS[key]


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[Store, list[ingest.RunSummary]]:
    """Urgent orders by one source, high ones by another with the same keys of news, a source that fails; the second run no longer lists odd urgent ones."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_orderpriority p", "date_format(o_orderdate, 'yyyy-MM-dd') d", "concat('c', o_custkey) c")
    store = Store(spark, shared_root(spark, "runs"))
    store.migrate()
    summaries = []

    def listed(priority: str, source: str, where: str, title: str) -> DataFrame:
        return scraped(rows.filter(F.col("p") == priority).filter(where), sourceId=f"'{source}'", title=f"'{title}'", startAt="concat(d, 'T00:00:00Z')", dedupKey="c")

    fields = {"sourceId": "'b'", "externalId": "cast(k as string)", "title": "'t'", "reason": "'no-date'"}
    rejected = rows.filter("p = '3-MEDIUM'").select(*[F.expr(fields.get(c, "null")).cast("string").alias(c) for c in schemas.column_names(schemas.QUARANTINED_POST)])

    def broken(cursor: str | None) -> ingest.ScanResult:
        raise ContractError("no page")

    for number, (now, where) in enumerate(((FIRST, "true"), (SECOND, "k % 2 = 0")), 1):
        sources = [
            ingest.Source("a", lambda cursor, w=where, n=number: ingest.ScanResult(listed("1-URGENT", "a", w, f"t{n}"), sweep_window_end=WINDOW_END, next_cursor={"run": n})),
            ingest.Source("b", lambda cursor, n=number: ingest.ScanResult(listed("2-HIGH", "b", "true", f"t{n}"), rejected)),
            ingest.Source("c", broken),
        ]
        summaries.append(ingest.run_once(store, sources, now))
    return store, summaries


SQL_RUN = "SELECT o_orderkey AS k, o_orderpriority AS p, CAST(o_orderdate AS TIMESTAMP) AS began, o_custkey AS c FROM orders"


@group(f"""SELECT 'a' AS source_id, CAST(k AS VARCHAR) AS external_id, CASE WHEN k % 2 = 0 THEN 't2' ELSE 't1' END AS title,
  CASE WHEN k % 2 = 1 AND began > TIMESTAMP '1995-02-01' AND began < TIMESTAMP '1998-01-01' THEN 'cancelled' ELSE 'scheduled' END AS state FROM ({SQL_RUN}) WHERE p = '1-URGENT'
UNION ALL SELECT 'b', CAST(k AS VARCHAR), 't2', 'scheduled' FROM ({SQL_RUN}) n WHERE p = '2-HIGH'
  AND NOT EXISTS (FROM ({SQL_RUN}) e WHERE e.p = '1-URGENT' AND e.c = n.c AND abs(epoch_ms(e.began) - epoch_ms(n.began)) <= 14 * 86400000)""")
def ingest_run_events(spark, sf_dir):
    return two_runs(spark, sf_dir)[0].read("events").select("source_id", "external_id", "title", "state")


@group("""SELECT * FROM (VALUES ('a', '{"run": 2}', '1995-02-01T00:00:00.000Z', '1995-02-01T00:00:00.000Z', NULL, NULL, 0), ('b', NULL, '1995-02-01T00:00:00.000Z', '1995-02-01T00:00:00.000Z', NULL, NULL, 0),
  ('c', NULL, '1995-02-01T00:00:00.000Z', NULL, '1995-02-01T00:00:00.000Z', 'no page', 2)) AS t(source_id, "cursor", last_run_at, last_success_at, last_error_at, last_error, consecutive_failures)""")
def ingest_run_state(spark, sf_dir):
    at = [dates.iso_utc(F.col(c)).alias(c) for c in ("last_run_at", "last_success_at", "last_error_at")]
    return two_runs(spark, sf_dir)[0].read("ingest_state").select("source_id", "cursor", *at, "last_error", "consecutive_failures")


SQL_KEPT = f"""FROM ({SQL_RUN}) n WHERE p = '2-HIGH' AND NOT EXISTS (FROM ({SQL_RUN}) e WHERE e.p = '1-URGENT' AND e.c = n.c AND abs(epoch_ms(e.began) - epoch_ms(n.began)) <= 14 * 86400000)"""


@group(f"""SELECT run, CASE run WHEN 1 THEN a + kept ELSE 0 END AS inserted, CASE run WHEN 1 THEN 0 ELSE even + kept END AS updated, CASE run WHEN 1 THEN 0 ELSE swept END AS cancelled, b - kept AS suppressed, quarantined, 'c' AS failed
FROM (VALUES (1), (2)) AS r(run), (SELECT count(*) FILTER (p = '1-URGENT') AS a, count(*) FILTER (p = '1-URGENT' AND k % 2 = 0) AS even, count(*) FILTER (p = '2-HIGH') AS b, count(*) FILTER (p = '3-MEDIUM') AS quarantined,
  count(*) FILTER (p = '1-URGENT' AND k % 2 = 1 AND began > TIMESTAMP '1995-02-01' AND began < TIMESTAMP '1998-01-01') AS swept, (SELECT count(*) {SQL_KEPT}) AS kept FROM ({SQL_RUN}))""")
def ingest_run_counters(spark, sf_dir):
    """The counters of two runs, as the jobs that write bring them along."""
    runs = two_runs(spark, sf_dir)[1]
    rows = [(i, s.inserted, s.updated, s.cancelled, s.suppressed, s.quarantined, ",".join(s.failed_sources)) for i, s in enumerate(runs, 1)]
    return spark.createDataFrame(rows, "run int, inserted long, updated long, cancelled long, suppressed long, quarantined long, failed string")


# ---- The store's layout ----


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored events of all durations, written to the store and read back with its hidden columns."""
    hours = "CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 20 WHEN 3 THEN 100 WHEN 4 THEN 2000 ELSE 20000 END"
    point = "named_struct('lng', (k % 3600) / 10.0D - 180, 'lat', (k % 1700) / 10.0D - 85)"
    rows = stored_events(spark, sf_dir).withColumnRenamed("id", "k")
    rows = rows.withColumn("end_at", F.expr(f"CASE WHEN k % 7 > 0 THEN start_at + make_dt_interval(0, {hours}) END")).withColumn("location", F.expr(f"CASE WHEN k % 5 > 0 THEN {point} END"))
    store = Store(spark, shared_root(spark, "layout"))
    store.replace("events", rows.withColumnRenamed("k", "id"))
    return store.read("events", hidden=True)


SQL_LAID_OUT = f"""(SELECT k AS id, CAST(day AS TIMESTAMP) AS start_at, CASE WHEN k % 7 > 0 THEN CAST(day AS TIMESTAMP) + to_hours(CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 20 WHEN 3 THEN 100 WHEN 4 THEN 2000 ELSE 20000 END) END AS end_at,
  CASE WHEN k % 5 > 0 THEN (k % 3600) / 10.0 - 180 END AS lng, CASE WHEN k % 5 > 0 THEN (k % 1700) / 10.0 - 85 END AS lat FROM {SQL_ORDERS})"""


@group(f"SELECT id FROM {SQL_LAID_OUT} WHERE start_at <= TIMESTAMP '1996-03-01' AND coalesce(end_at, start_at) >= TIMESTAMP '1996-02-20 06:00:00'")
def events_overlap_classes(spark, sf_dir):
    """Overlap with both bounds in the scan: events by classes of duration."""
    begin, end = (F.lit(x).cast("timestamp") for x in (datetime(1996, 2, 20, 6, tzinfo=UTC), datetime(1996, 3, 1, tzinfo=UTC)))
    return laid_out(spark, sf_dir).filter(overlaps_by_class(F.col("start_at"), F.col("end_at"), F.col("_class"), begin, end)).select("id")


def sql_metres(lng: float, lat: float) -> str:
    return f"2 * 6371008.8 * asin(sqrt(pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lng}) - radians(lng)) / 2), 2)))"


@group(f"SELECT 'near' AS kind, id, 0 AS km FROM {SQL_LAID_OUT} WHERE lng IS NOT NULL AND {sql_metres(-77.03, -12.05)} <= 3000000 UNION ALL SELECT 'nearest', id, CAST(floor(m / 1000) AS INT) FROM (SELECT id, {sql_metres(179.9, 10.05)} AS m FROM {SQL_LAID_OUT} WHERE lng IS NOT NULL ORDER BY m, id LIMIT 40)")
def events_by_place(spark, sf_dir):
    """All within a radius, and the nearest to a point beside the date line, by cells of a space-filling curve; the number of nearest ones is the feature."""
    rows = laid_out(spark, sf_dir)
    near = serving.events_near(rows, -77.03, -12.05, 3_000_000).select(F.lit("near").alias("kind"), "id", F.lit(0).alias("km"))
    return near.unionAll(serving.nearest_events(rows, 179.9, 10.05, 40).select(F.lit("nearest"), "id", F.floor(F.col("distance_m") / 1000).cast("int")))


@group(f"""SELECT 'PE-' || k AS codigo_via, CASE k % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'restringido' ELSE 'interrumpido' END AS estado, '1995-02-01T00:00:00.000Z' AS fetched_at FROM {SQL_ORDERS} WHERE day >= DATE '1997-01-01'""")
def snapshot_switch(spark, sf_dir):
    """Two snapshots and a third that can't be read: the table holds the second."""
    store = Store(spark, shared_root(spark, "alerts"))
    store.migrate()
    ingest.sync_road_alerts(store, lambda: alerts.road_alerts(alert_pages(spark, sf_dir)), FIRST)
    ingest.sync_road_alerts(store, lambda: alerts.road_alerts(alert_pages(spark, sf_dir, "day >= date'1997-01-01'")), SECOND)
    bad = spark.createDataFrame([("p", "ok", 200, "not JSON")], schemas.CAPTURE)
    ingest.sync_road_alerts(store, lambda: alerts.road_alerts(bad), datetime(1995, 3, 1, tzinfo=UTC))
    return store.read("road_alerts").select("codigo_via", "estado", dates.iso_utc(F.col("fetched_at")).alias("fetched_at"))
