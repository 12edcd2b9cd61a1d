"""Every connector, over pages that are written from orders and read back by the library's own functions.

A page's text is built with its record's key and date, so SQL knows what each
must give. The gates run with their real vocabularies.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import text
from wayfare.functions.vocabulary import INSTITUTIONS
from wayfare.plans import audit, scans, serving
from wayfare.plans.ingest import ScanResult
from wayfare.plans.queries import Group, spread, table
from wayfare.plans.queries.spanish import NAMES, SQL_NAMES
from wayfare.sources import alerts, captures, pages, posts

group = Group()

#: k: the order's key, day and d: its date, later: ten days on.
SQL_ORDERS = """(SELECT *, strftime(day, '%Y-%m-%d') AS d, strftime(later, '%Y-%m-%d') AS l FROM
  (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 10 AS later FROM orders))"""
MONTH_OF = "element_at(array(" + ", ".join(f"'{n}'" for n in NAMES) + "), month({0}))"


def spanish(day: str) -> str:
    """A date in words, in Spark's SQL."""
    return f"concat(dayofmonth({day}), ' de ', {MONTH_OF.format(day)}, ' de ', year({day}))"


def sql_spanish(day: str) -> str:
    return f"(date_part('day', {day}) || ' de ' || {SQL_NAMES}[date_part('month', {day})] || ' de ' || date_part('year', {day}))"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "to_date(o_orderdate) day", "date_add(to_date(o_orderdate), 10) later")
    return rows.withColumns({"d": F.date_format("day", "yyyy-MM-dd"), "l": F.date_format("later", "yyyy-MM-dd")})


def written(spark: SparkSession, sf_dir: str, body: str, url: str = "concat('p', k)", where: str = "true", **more: str) -> DataFrame:
    """A capture for each order: Spark SQL for its body and url."""
    return spread(orders(spark, sf_dir).filter(where), "k").selectExpr(f"{url} url", "'ok' kind", "200 status", f"{body} body", *[f"{v} {k}" for k, v in more.items()])


def linked(data: str) -> str:
    """A page with linked data."""
    return f"""concat('<html><head><script type="application/ld+json">', {data}, '</script></head></html>')"""


# ---- Theatre ----

CLOCK = "CASE WHEN k % 2 = 0 THEN '19:30:00' ELSE '20:00:00' END"


@group(f"""SELECT 'show-' || k || ':' || d || 'T' || left(c, 5) AS externalId, 'Función ' || k AS title, CASE k % 4 WHEN 0 THEN 'musica' WHEN 1 THEN 'danza' ELSE 'proximamente' END AS category,
  d || 'T' || c || '-05:00' AS startAt, 'https://granteatronacional.pe/evento/show-' || k AS sourceUrl, CAST(-77.003169 AS DOUBLE) AS lng,
  '{{"slug":"show-' || k || '","gtnRawCellDatetime":"1970-01-01T' || c || 'Z","date":"' || d || '"}}' AS sourcePayload FROM (SELECT *, {CLOCK} AS c FROM {SQL_ORDERS}) WHERE k % 4 <> 2""")
def theatre_calendar(spark, sf_dir):
    kind = """CASE k % 4 WHEN 0 THEN '<span class="cat-musica">M</span>' WHEN 1 THEN '<span class="cat-danza">D</span>' WHEN 2 THEN '<span class="cat-montaje">X</span>' ELSE '' END"""
    body = f"""concat('<table><tr><td date-date="', d, '"><div class="contents"><time datetime="1970-01-01T', {CLOCK}, 'Z"></time>', {kind}, '<a href="/evento/show-', k, '"> Función ', k, ' </a></div></td></tr></table>')"""
    found = pages.theatre_events(written(spark, sf_dir, body))
    return found.select("externalId", "title", "category", "startAt", "sourceUrl", F.col("location.lng").alias("lng"), "sourcePayload")


@group(f"""SELECT k, array_to_string([strftime(first, '%Y%m'), strftime(first + INTERVAL 1 MONTH, '%Y%m'), strftime(first + INTERVAL 2 MONTH, '%Y%m')], ',') AS months, strftime(first + INTERVAL 3 MONTH, '%Y-%m-%d') AS ends
FROM (SELECT k, date_trunc('month', day) AS first FROM {SQL_ORDERS})""")
def theatre_window(spark, sf_dir):
    months, end = pages.theatre_months(F.col("day").cast("timestamp"))
    return orders(spark, sf_dir).select("k", F.array_join(months, ",").alias("months"), F.date_format(end, "yyyy-MM-dd").alias("ends"))


# ---- Sports ----

CLUBS = ("universitario-de-deportes", "alianza-lima", "sporting-cristal", "otro-club")
VENUES = tuple(v for _, v, *_ in pages.SPORTS_VENUES)
CLUB = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLUBS)) + " END"
VENUE = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VENUES)) + " END"


@group(f"SELECT '/liga-1/' || {CLUB} || '-vs-rival-m' || k AS path, 0 AS place FROM {SQL_ORDERS} WHERE k % 4 < 3")
def sports_home_matches(spark, sf_dir):
    body = f"""concat('<div class="match big"><a href="/liga-1/', {CLUB}, '-vs-rival-m', k, '">x</a></div><div class="match"><a href="/liga-1/tabla">t</a></div>')"""
    return pages.sports_listing(written(spark, sf_dir, body))[2].select("path", "place")


@group("SELECT count(*) AS boxes, count(*) AS matches FROM orders")
def sports_listing_counts(spark, sf_dir):
    """A match on each page: boxes and different links are counted over all of them."""
    box = F.concat(F.lit('<div class="match"><a href="/liga-1/otro-club-vs-x-m'), F.col("k"), F.lit('">x</a></div>'))
    boxes, matches, _ = pages.sports_listing(spread(orders(spark, sf_dir), "k").select(F.concat(F.lit("listing-"), "k").alias("url"), box.alias("body")))
    return spark.createDataFrame([(boxes, matches)], "boxes long, matches long")


@group(f"""SELECT 'm' || k AS externalId, 'Partido ' || k AS title, CASE WHEN k % 5 = 0 THEN 'cancelled' ELSE 'scheduled' END AS state, d || 'T20:00:00-05:00' AS startAt, {VENUE} AS venueName,
  CAST(CASE k % 4 WHEN 0 THEN -76.9353339 WHEN 1 THEN -77.0229272 ELSE -77.0450308 END AS DOUBLE) AS lng FROM {SQL_ORDERS} WHERE k % 4 < 3""")
def sports_match_events(spark, sf_dir):
    data = f"""concat('{{"@type":"Review","itemReviewed":{{"@type":"SportsEvent","name":"Liga 1","description":"Partido ', k, '","startDate":"', d, 'T20:00:00-05:00","location":"', {VENUE}, ', Lima","eventStatus":"',
      CASE WHEN k % 5 = 0 THEN 'EventCancelled' ELSE 'EventScheduled' END, '","competitor":[{{"name":"A"}},{{"name":"B"}}]}}}}')"""
    found = pages.sports_events(written(spark, sf_dir, linked(data), f"concat('https://www.futbolperuano.com/liga-1/', {CLUB}, '-vs-rival-m', k)", "k % 4 < 3"))
    return found.select("externalId", "title", "state", "startAt", "venueName", F.col("location.lng").alias("lng"))


# ---- Municipal posts ----


def municipal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post a page, by the key's remainder: without a title, a trigger, a road or a date, past, or announced."""
    title = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Concierto ', k) WHEN 2 THEN concat('Cierre de campaña ', k) ELSE concat('Cierre de avenida ', k) END"
    content = f"""CASE k % 6 WHEN 1 THEN '<p>Música en la avenida Arequipa</p>' WHEN 2 THEN '<p>Fiesta final</p>' WHEN 3 THEN '<p>Habrá desvíos por obras</p>' WHEN 4 THEN '<p>Fue el 3 de enero de 1990</p>'
      WHEN 5 THEN concat('<p>Desde el ', {spanish("later")}, '</p>') ELSE 'x' END"""
    body = f"""to_json(array(named_struct('id', k, 'date', concat(d, 'T10:00:00'), 'link', concat('https://www.munlima.gob.pe/', k), 'title', named_struct('rendered', {title}), 'content', named_struct('rendered', {content}))))"""
    return written(spark, sf_dir, body)


@group(f"""SELECT CAST(k AS VARCHAR) AS externalId, 'Cierre de avenida ' || k AS title, l || 'T00:00:00-05:00' AS startAt, NULL::VARCHAR AS endAt, 'road_closure' AS category, 'cierre-de-avenida-' || k AS dedupKey,
  'https://www.munlima.gob.pe/' || k AS sourceUrl, CAST(k AS VARCHAR) AS post_id, '["cierre"]' AS keywords, {sql_spanish("later")} AS matched_date FROM {SQL_ORDERS} WHERE k % 6 = 5""")
def municipal_road_events(spark, sf_dir):
    read = lambda p: F.get_json_object("sourcePayload", p)
    found = posts.municipal(municipal_pages(spark, sf_dir)).events
    return found.select("externalId", "title", "startAt", "endAt", "category", "dedupKey", "sourceUrl", read("$.postId").alias("post_id"), read("$.matchedKeywords").alias("keywords"), read("$.matchedDate").alias("matched_date"))


@group(f"""SELECT 'mml' AS sourceId, CAST(k AS VARCHAR) AS externalId, CASE k % 6 WHEN 2 THEN 'Cierre de campaña ' ELSE 'Cierre de avenida ' END || k AS title, 'https://www.munlima.gob.pe/' || k AS url,
  CASE k % 6 WHEN 2 THEN 'no-road-context' WHEN 3 THEN 'no-date' ELSE 'past-event' END AS reason, d || 'T10:00:00-05:00' AS postDate,
  CASE k % 6 WHEN 3 THEN '{{"matchedKeywords":["cierre","desvios"]}}' WHEN 4 THEN '{{"matchedKeywords":["cierre"],"matchedDate":"3 de enero de 1990"}}' END AS detail FROM {SQL_ORDERS} WHERE k % 6 IN (2, 3, 4)""")
def municipal_quarantine(spark, sf_dir):
    return posts.municipal(municipal_pages(spark, sf_dir)).quarantined


@group(f"SELECT k AS id, d || 'T10:00:00' AS date FROM {SQL_ORDERS} WHERE d >= '1995-06-01' ORDER BY d, k LIMIT 250")
def posts_after_cursor(spark, sf_dir):
    return posts.next_posts(posts.municipal_posts(municipal_pages(spark, sf_dir)), "1995-06-01T00:00:00").select("id", "date")


@group(f"""SELECT k AS id, CASE k % 6 WHEN 0 THEN 'no-trigger' WHEN 1 THEN 'no-trigger' WHEN 2 THEN 'no-road-context' WHEN 3 THEN 'no-date' WHEN 4 THEN 'past-event' ELSE 'extracted' END AS stage,
  CASE k % 6 WHEN 3 THEN 'cierre,desvios' WHEN 4 THEN 'cierre' WHEN 5 THEN 'cierre' END AS keywords, CASE k % 6 WHEN 4 THEN '3 de enero de 1990' WHEN 5 THEN {sql_spanish("later")} END AS matched_date,
  CASE k % 6 WHEN 4 THEN true WHEN 5 THEN false END AS ends_before FROM {SQL_ORDERS} WHERE d || 'T10:00:00' > strftime(TIMESTAMP '1998-08-02' - INTERVAL 1000 DAY - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S')""")
def gate_audit_rows(spark, sf_dir):
    from datetime import UTC, datetime

    rows = audit.audit_municipal(posts.municipal_posts(municipal_pages(spark, sf_dir)), datetime(1998, 8, 2, tzinfo=UTC), 1000)
    return rows.select("id", "stage", F.array_join("keywords", ",").alias("keywords"), F.col("matchedDate").alias("matched_date"), F.col("endsBeforePost").alias("ends_before"))


# ---- Institutions' news ----

NEWS_URL = "concat('https://www.gob.pe/institucion/mtc/noticias/', k, '-nota')"


def institution_found(spark: SparkSession, sf_dir: str) -> posts.Extraction:
    title = "CASE WHEN k % 2 = 0 THEN concat('Restricción vehicular ', k) ELSE concat('Noticia ', k) END"
    items = posts.institution_news(written(spark, sf_dir, f"to_json(array(named_struct('title', {title}, 'description', 'Comunicado', 'url', {NEWS_URL}, 'image', '', 'date', concat(' ', {spanish('day')}))))"), "mtc")
    text = f"CASE k % 3 WHEN 0 THEN concat('En Miraflores desde el ', {spanish('later')}) WHEN 1 THEN 'En Nazca' ELSE 'En Miraflores fue el 3 de enero de 1990' END"
    details = written(spark, sf_dir, f"concat('<html><main><p>', {text}, '</p></main></html>')", NEWS_URL)
    details = details.withColumn("kind", F.when(F.col("url").rlike("0-nota$"), "http-4xx").otherwise("ok"))
    return posts.institution(posts.news_candidates(items, 100), details, "mtc")


SQL_CANDIDATES = f"{SQL_ORDERS} WHERE k % 2 = 0 AND k > 100 AND k % 10 <> 0"


@group(f"""SELECT 'gob-pe-mtc' AS sourceId, CAST(k AS VARCHAR) AS externalId, 'Restricción vehicular ' || k AS title, l || 'T00:00:00-05:00' AS startAt, 'road_work' AS category, 'restriccion-vehicular-' || k AS dedupKey,
  'mtc' AS institution FROM {SQL_CANDIDATES} AND k % 3 = 0""")
def institution_road_events(spark, sf_dir):
    return institution_found(spark, sf_dir).events.select("sourceId", "externalId", "title", "startAt", "category", "dedupKey", F.get_json_object("sourcePayload", "$.institution").alias("institution"))


@group(f"""SELECT CAST(k AS VARCHAR) AS externalId, CASE k % 3 WHEN 1 THEN 'non-lima' ELSE 'past-event' END AS reason, d || 'T00:00:00-05:00' AS postDate,
  CASE k % 3 WHEN 1 THEN '{{"matchedKeywords":["restriccion"]}}' ELSE '{{"matchedKeywords":["restriccion"],"matchedDate":"3 de enero de 1990"}}' END AS detail FROM {SQL_CANDIDATES} AND k % 3 <> 0""")
def institution_quarantine(spark, sf_dir):
    return institution_found(spark, sf_dir).quarantined.select("externalId", "reason", "postDate", "detail")


@group(f"SELECT k AS id, 'Título ' || k AS title, 'Sobre ' || k AS description, 'https://www.gob.pe/institucion/mtc/noticias/' || k || '-nota' AS link, d || 'T10:00:00' AS datetime FROM {SQL_ORDERS}")
def news_listing_html(spark, sf_dir):
    body = """concat('<div class="card p-6"><h3><a href="/institucion/mtc/noticias/', k, '-nota"> Título ', k, '</a></h3><p id="n', k, '-description">Sobre ', k, '</p><time datetime="', d, 'T10:00:00"></time></div>')"""
    return pages.news_listing(written(spark, sf_dir, body), "mtc").select("id", "title", "description", "link", "datetime")


# ---- Tickets ----

KIND = "CASE k % 4 WHEN 0 THEN 'concerts' WHEN 1 THEN 'sports' WHEN 2 THEN 'futbol' ELSE 'theater' END"


@group(f"SELECT 'https://www.joinnus.com/events/' || {KIND} || '/lima-show-' || k AS url, CAST(k AS VARCHAR) AS id, {KIND} AS category FROM {SQL_ORDERS} WHERE k % 4 < 3")
def sitemap_targets(spark, sf_dir):
    body = f"""concat('<urlset><url><loc>https://www.joinnus.com/events/', {KIND}, '/lima-show-', k, '</loc></url><url><loc>https://www.joinnus.com/events/concerts/cusco-', k, '</loc></url></urlset>')"""
    return pages.sitemap_targets(written(spark, sf_dir, body))


@group(f"""SELECT CAST(k AS VARCHAR) AS externalId, 'Show ' || k AS title, CASE k % 4 WHEN 0 THEN 'concert' WHEN 1 THEN 'sport' ELSE 'futbol' END AS category, CASE WHEN k % 5 = 0 THEN 'cancelled' ELSE 'scheduled' END AS state,
  d || 'T20:00:00-05:00' AS startAt, CASE WHEN k % 2 = 0 THEN d || 'T22:00:00-05:00' END AS endAt, CASE k % 3 WHEN 0 THEN 'Estadio Nacional' WHEN 1 THEN 'Arena Perú' END AS venueName,
  CAST(CASE k % 3 WHEN 0 THEN -77.0338629 WHEN 1 THEN -76.9798119 END AS DOUBLE) AS lng FROM {SQL_ORDERS} WHERE k % 4 < 3""")
def ticket_detail_events(spark, sf_dir):
    data = """concat('{"@type":"Event","name":"Show ', k, '","startDate":"', d, 'T20:00:00.000Z","endDate":"', d, CASE WHEN k % 2 = 0 THEN 'T22' ELSE 'T20' END, ':00:00.000Z","eventStatus":"https://schema.org/',
      CASE WHEN k % 5 = 0 THEN 'EventPostponed' ELSE 'EventScheduled' END, '","location":{"name":"', CASE k % 3 WHEN 0 THEN 'Estadio Nacional' WHEN 1 THEN 'Arena Perú' ELSE '' END, '","address":{"streetAddress":"Av. 1"}}}')"""
    found = pages.ticket_events(written(spark, sf_dir, linked(data), f"concat('https://www.joinnus.com/events/', {KIND}, '/lima-show-', k)", "k % 4 < 3", category=KIND))
    return found.select("externalId", "title", "category", "state", "startAt", "endAt", "venueName", F.col("location.lng").alias("lng"))


# ---- Press room ----


@group(f"SELECT '/news/nota-' || k || '.html' AS path, 0 AS place FROM {SQL_ORDERS}")
def press_listing_links(spark, sf_dir):
    body = """concat('<a href="https://prensa.limaexpresa.pe/news/nota-', k, '.html">a</a><a href="//prensa.limaexpresa.pe/news/nota-', k, '.html">b</a><a href="/otra.html">c</a>')"""
    return pages.press_listing(written(spark, sf_dir, body)).select("path", "place")


@group(f"""SELECT 'nota-' || k AS externalId, CASE k % 3 WHEN 0 THEN 'Cierre nocturno ' ELSE 'Mantenimiento ' END || k AS title, CASE k % 3 WHEN 0 THEN 'road_closure' ELSE 'road_work' END AS category,
  CASE WHEN k % 2 = 0 THEN l || 'T00:00:00-05:00' ELSE d || 'T08:00:00-05:00' END AS startAt, CASE k % 3 WHEN 0 THEN 'cierre-nocturno-' ELSE 'mantenimiento-' END || k AS dedupKey,
  CASE WHEN k % 2 = 0 THEN '["Vía de Evitamiento"]' ELSE '["Línea Amarilla"]' END AS arteries FROM {SQL_ORDERS} WHERE k % 3 < 2""")
def press_road_events(spark, sf_dir):
    headline = "concat(CASE k % 3 WHEN 0 THEN 'Cierre nocturno ' WHEN 1 THEN 'Mantenimiento ' ELSE 'Aniversario ' END, k)"
    text = f"CASE WHEN k % 2 = 0 THEN concat('En la Vía de Evitamiento desde el ', {spanish('later')}) ELSE 'En Línea Amarilla, sin fecha' END"
    data = f"""concat('{{"@type":"NewsArticle","headline":"', {headline}, '","datePublished":"', d, 'T08:00:00-05:00"}}')"""
    body = f"""concat({linked(data)}, '<div class="content-text"><p>', {text}, '</p></div>')"""
    found = pages.press_events(written(spark, sf_dir, body, path="concat('/news/nota-', k, '.html')"))
    return found.select("externalId", "title", "category", "startAt", "dedupKey", F.get_json_object("sourcePayload", "$.arteries").alias("arteries"))


# ---- Venue cards ----


@group(f"""SELECT 'show-' || k AS externalId, 'Gran show ' || k AS title, CASE k % 3 WHEN 1 THEN 'festival' ELSE 'concert' END AS category, d || 'T00:00:00-05:00' AS startAt, 'https://teleticket.com.pe/show-' || k AS sourceUrl FROM {SQL_ORDERS}""")
def show_card_events(spark, sf_dir):
    kind = "CASE k % 3 WHEN 0 THEN 'Concierto' WHEN 1 THEN 'Festival' ELSE 'Otro' END"
    body = f"""concat('<div class="news-block"><h4><a href="https://teleticket.com.pe/show-', k, '">Gran show ', k, '</a></h4><ul class="post-info"><li>', date_format(day, 'dd-MM-yyyy'), '</li><li>', {kind}, '</li></ul></div>')"""
    return pages.card_events(written(spark, sf_dir, body)).select("externalId", "title", "category", "startAt", "sourceUrl")


# ---- Road alerts ----

LEVELS = ("normal", "restringido", "interrumpido")


def alert_pages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """A snapshot for each order with one alert, behind a byte order mark."""
    when = "CASE WHEN k % 4 = 0 THEN '31/02/2001' ELSE date_format(day, 'dd/MM/yyyy') END"
    feature = f"""concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[-77.1301,-11.8542]}},"properties":{{"codigo_via":"PE-', k, '","evento":"E", "fecha_evento":"', {when}, '","fecha_actualizacion":"', date_format(day, 'dd/MM/yyyy'), ' 7:05 HORAS"}}}}')"""
    arrays = ", ".join(f"""'"{level}":[', CASE WHEN k % 3 = {i} THEN {feature} ELSE '' END, '],'""" for i, level in enumerate(LEVELS))
    return written(spark, sf_dir, f"""concat('﻿{{', {arrays}, '"fecha_hora_actualizacion":"11/06/2026 10:32"}}')""", where=where)


@group(f"""SELECT k AS id, CASE k % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'restringido' ELSE 'interrumpido' END AS estado, CAST(-77.1301 AS DOUBLE) AS lng, CAST(-11.8542 AS DOUBLE) AS lat, 'PE-' || k AS codigoVia,
  NULL::VARCHAR AS nombreCarretera, NULL::VARCHAR AS afectacion, 'E' AS evento, NULL::VARCHAR AS motivo, NULL::VARCHAR AS fuente, NULL::VARCHAR AS ubigeo, d || 'T12:05:00.000Z' AS reportedAt,
  CASE WHEN k % 4 <> 0 THEN d END AS eventStartedOn, '2026-06-11T15:32:00.000Z' AS datasetUpdatedAt FROM {SQL_ORDERS}""")
def road_alert_response(spark, sf_dir):
    rows = alerts.road_alerts(alert_pages(spark, sf_dir)).withColumn("id", F.substring("codigo_via", 4, 20).cast("long"))
    found = serving.road_alerts_query(rows)
    return found.select(*[c for c in found.columns if c != "location"], F.col("location.lng").alias("lng"), F.col("location.lat").alias("lat"))


# ---- Scans, end to end ----

INSTITUTION_TITLE = "concat('Restricción vehicular ', k)"


def fetched(spark: SparkSession, sf_dir: str) -> Callable[[str, str], DataFrame]:
    """Every source's listing and pages: one of each for each order."""
    news = lambda name: f"concat('https://www.gob.pe/institucion/{name}/noticias/', k, '-nota')"
    sports_path = f"concat('/liga-1/', {CLUB}, '-vs-rival-m', k)"
    match = f"""concat('{{"@type":"Review","itemReviewed":{{"@type":"SportsEvent","name":"Liga 1","description":"Partido ', k, '","startDate":"', d, 'T20:00:00-05:00","location":"', {VENUE}, ', Lima","eventStatus":"EventScheduled","competitor":[{{"name":"A"}},{{"name":"B"}}]}}}}')"""
    show = """concat('{"@type":"Event","name":"Show ', k, '","startDate":"', d, 'T20:00:00.000Z","endDate":"', d, 'T20:00:00.000Z","eventStatus":"https://schema.org/EventScheduled","location":{"name":"","address":{"streetAddress":"Av. 1"}}}')"""
    show_url = f"concat('https://www.joinnus.com/events/', {KIND}, '/lima-show-', k)"
    article = """concat('{"@type":"NewsArticle","headline":"', CASE k % 3 WHEN 0 THEN 'Cierre nocturno ' WHEN 1 THEN 'Mantenimiento ' ELSE 'Aniversario ' END, k, '","datePublished":"', d, 'T08:00:00-05:00"}')"""

    def captured(source: str, part: str) -> DataFrame:
        if source == posts.MUNICIPAL:
            return municipal_pages(spark, sf_dir)
        if source == pages.SPORTS and part == "listing":
            return written(spark, sf_dir, f"""concat('<div class="match"><a href="', {sports_path}, '">x</a></div>')""")
        if source == pages.SPORTS:  # Pages of one match in five are gone.
            found = written(spark, sf_dir, linked(match), f"concat('{pages.SPORTS_URL}', {sports_path})", n="k")
            return found.withColumn("kind", F.when(F.col("n") % 5 == 0, "http-4xx").otherwise("ok")).drop("n")
        if source == pages.TICKETS and part == "listing":
            return written(spark, sf_dir, f"concat('<urlset><url><loc>', {show_url}, '</loc></url></urlset>')")
        if source == pages.TICKETS:
            return written(spark, sf_dir, linked(show), show_url)
        if source == pages.PRESS and part == "listing":
            return written(spark, sf_dir, """concat('<a href="https://prensa.limaexpresa.pe/news/nota-', k, '.html">a</a>')""")
        if source == pages.PRESS:
            return written(spark, sf_dir, f"""concat({linked(article)}, '<div class="content-text"><p>En Línea Amarilla, sin fecha</p></div>')""", f"concat('{pages.PRESS_ORIGIN}/news/nota-', k, '.html')")
        name = source.removeprefix("gob-pe-")
        if part == "listing":
            return written(spark, sf_dir, f"to_json(array(named_struct('title', {INSTITUTION_TITLE}, 'description', 'Comunicado', 'url', {news(name)}, 'image', '', 'date', {spanish('day')})))")
        said = f"CASE k % 3 WHEN 0 THEN concat('En Miraflores desde el ', {spanish('later')}) WHEN 1 THEN 'En la avenida de Nazca' ELSE 'En Miraflores fue el 3 de enero de 1990' END"
        return written(spark, sf_dir, f"concat('<main><p>', {said}, '</p></main>')", news(name))

    return captured


#: Cursors that the scans begin with.
CURSORS = {pages.TICKETS: '{"seenIds": ["1", "2", "4"]}', pages.PRESS: '{"seenUrls": ["/news/nota-3.html"]}', "gob-pe-atu": '{"lastId": 100}', posts.MUNICIPAL: '{"after": "1995-06-01T00:00:00"}'}


def scanned(spark: SparkSession, sf_dir: str) -> list[tuple[str, ScanResult]]:
    now = datetime(1998, 8, 2, tzinfo=UTC)
    wanted = (pages.SPORTS, pages.TICKETS, pages.PRESS, posts.MUNICIPAL, *(f"gob-pe-{n}" for n in INSTITUTIONS))
    return [(s.name, s.scan(CURSORS.get(s.name))) for s in scans.registry(spark, fetched(spark, sf_dir), now) if s.name in wanted]


@group(f"""SELECT 'futbolperuano' AS "sourceId", 'm' || k AS "externalId", d || 'T20:00:00-05:00' AS "startAt" FROM {SQL_ORDERS} WHERE k % 4 < 3 AND k % 5 > 0
UNION ALL SELECT 'joinnus', CAST(k AS VARCHAR), d || 'T20:00:00-05:00' FROM {SQL_ORDERS} WHERE k % 4 < 3 AND k NOT IN (1, 2, 4)
UNION ALL SELECT 'lima-expresa', 'nota-' || k, d || 'T08:00:00-05:00' FROM {SQL_ORDERS} WHERE k % 3 < 2 AND k <> 3
UNION ALL SELECT 'mml', CAST(k AS VARCHAR), l || 'T00:00:00-05:00' FROM (SELECT * FROM {SQL_ORDERS} WHERE d >= '1995-06-01' ORDER BY d, k LIMIT 250) WHERE k % 6 = 5
UNION ALL SELECT 'gob-pe-' || n, CAST(k AS VARCHAR), CASE k % 3 WHEN 0 THEN l ELSE d END || 'T00:00:00-05:00' FROM {SQL_ORDERS}, (VALUES ('atu', 100, 2), ('sutran', 0, 1), ('mtc', 0, 1), ('munilima', 0, 2)) AS i(n, last, kinds) WHERE k > last AND k % 3 < kinds""")
def scan_events(spark, sf_dir):
    """What the scans of eight sources find behind their cursors: listings, the pages of what is new, gates."""
    return reduce(DataFrame.unionByName, [found.events.select("sourceId", "externalId", "startAt") for _, found in scanned(spark, sf_dir)])


@group(f"""SELECT 'joinnus' AS source, (SELECT '{{"seenIds": [' || string_agg('"' || k || '"', ', ' ORDER BY k DESC) || ']}}' FROM (SELECT k FROM (SELECT k FROM {SQL_ORDERS} WHERE k % 4 < 3 UNION SELECT unnest([1, 2, 4])) ORDER BY k DESC LIMIT 800)) AS "cursor"
UNION ALL SELECT 'mml', '{{"after": "' || max(d) || 'T10:00:00"}}' FROM (SELECT d FROM {SQL_ORDERS} WHERE d >= '1995-06-01' ORDER BY d, k LIMIT 250)
UNION ALL SELECT 'gob-pe-' || n, '{{"lastId": ' || max(k) || '}}' FROM {SQL_ORDERS}, (VALUES ('atu'), ('sutran'), ('mtc'), ('munilima')) AS i(n) GROUP BY n""")
def scan_cursors(spark, sf_dir):
    """Where each scan goes on: ids that were seen, the newest post, the highest news."""
    rows = [(name, json.dumps(found.next_cursor)) for name, found in scanned(spark, sf_dir) if name not in (pages.SPORTS, pages.PRESS)]
    return spark.createDataFrame(rows, "source string, cursor string")


@group(f"""SELECT id, CASE WHEN k % 2 = 1 THEN 'no-trigger-listing' WHEN nth > 40 THEN 'detail-cap-skipped' WHEN k % 10 = 0 THEN 'detail-fetch-failed-http-4xx' WHEN k % 3 = 1 THEN 'non-lima' WHEN k % 3 = 2 THEN 'past-event' ELSE 'extracted' END AS stage
FROM (SELECT k, k AS id, row_number() OVER (PARTITION BY k % 2 ORDER BY d DESC, k DESC) AS nth FROM {SQL_ORDERS} WHERE d || 'T10:00:00' >= '1997-12-05T00:00:00')""")
def institution_audit_rows(spark, sf_dir):
    """The gates replayed over an institution's listing; its forty details are the audit's own bound."""
    body = """concat('<div class="card p-6"><h3><a href="/institucion/mtc/noticias/', k, '-nota">', CASE WHEN k % 2 = 0 THEN 'Restricción vehicular ' ELSE 'Noticia ' END, k, '</a></h3><p id="n', k, '-description">Sobre ', k, '</p><time datetime="', d, 'T10:00:00"></time></div>')"""
    text = f"CASE k % 3 WHEN 0 THEN concat('En Miraflores, avenida Larco, desde el ', {spanish('later')}) WHEN 1 THEN 'En la avenida de Nazca' ELSE 'En la avenida Larco de Miraflores fue el 3 de enero de 1990' END"
    details = written(spark, sf_dir, f"concat('<main><p>', {text}, '</p></main>')", NEWS_URL)
    details = details.withColumn("kind", F.when(F.col("url").rlike("0-nota$"), "http-4xx").otherwise("ok"))
    listed = pages.news_listing(written(spark, sf_dir, body), "mtc")
    return audit.audit_institution(listed, details, "mtc", datetime(1998, 8, 2, tzinfo=UTC), 240).select("id", "stage")


#: Bodies of four kinds, as both engines write them.
BODIES = """CASE k % 4 WHEN 0 THEN concat('[{"id":', k, '}]') WHEN 1 THEN concat('{"id":', k, '}') WHEN 2 THEN concat('<html>', k, '</html>') ELSE concat('[{"nr":', k, '}]') END"""


@group(f"""SELECT k, CASE WHEN NOT json_valid(body) THEN 'not-json' WHEN json_type(body) <> 'ARRAY' OR NOT json_exists(body, '$[0].id') THEN 'wrong-shape' ELSE 'ok' END AS kind,
  coalesce(CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$[0].id') AS BIGINT) END, -1) AS id FROM (SELECT k, {BODIES} AS body FROM {SQL_ORDERS})""")
def json_body_classes(spark, sf_dir):
    """Captured bodies as variants: an array of posts, JSON of another shape, or no JSON."""
    body = orders(spark, sf_dir).select("k", F.expr(BODIES).alias("body"))
    return body.select("k", text.json_class(F.col("body"), "array", "id").alias("kind"), F.coalesce(F.try_variant_get(F.try_parse_json("body"), "$[0].id", "bigint"), F.lit(-1)).alias("id"))


# ---- Fetches ----


@group(f"""SELECT 'p' || k AS url, kind, kind = 'transient' AS dropped FROM (SELECT k, CASE WHEN k % 4 = 0 OR k % 8 = 2 THEN 'ok' WHEN k % 4 = 1 THEN 'http-4xx' ELSE 'transient' END AS kind FROM {SQL_ORDERS})""")
def retried_fetches(spark, sf_dir):
    first = written(spark, sf_dir, "'x'").withColumn("n", F.substring("url", 2, 20).cast("long"))
    kinds = F.array(*[F.lit(captures.outcome(s)) for s in (200, 404, 503, None)])
    second = first.filter("n % 8 in (2, 6)").withColumn("kind", F.when(F.col("n") % 8 == 2, captures.outcome(204)).otherwise(captures.outcome(500)))
    first = first.withColumn("kind", F.get(kinds, (F.col("n") % 4).cast("int")))
    return captures.retried(first.drop("n"), second.drop("n")).select("url", "kind", "dropped")


@group("""SELECT url, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT url, replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<article[^>]*>(.*)</article>', 1, 's'),
  '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM pages WHERE html LIKE '%<article%')""")
def html_article_text(spark, sf_dir):
    from wayfare.plans.queries.texts import article

    found = table(spark, sf_dir, "pages").select("url", F.col("html").alias("body"))
    return captures.parsed(found, article, "url string, n_chars long, text string").select("url", "n_chars", F.md5("text").alias("text_md5"))
