import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayfare.operators.validate import ContractError, validated
from wayfare.sources import alerts, imports, markup, pages, posts, recurring
from wayfare.sources.captures import captures, outcome, read_captures, retried


def fails(frame, match):
    with pytest.raises((PySparkException, ContractError), match=match):
        frame.collect()


def test_markup_tree():
    root = markup.parse('<div class="a b"><p>x<br>y<!-- c --><script>var t="</p>";</script></p><li>1<li>2</div>&amp;')
    assert root.text() == 'xyvar t="</p>";12&' and root.find(lambda n: n.has_class("b")).tag == "div"
    assert markup.parse(None).text() == ""


def test_article_text_reads_five_references_with_their_semicolon():
    from wayfare.plans.queries.texts import article

    html = "<p>&amp</p><article>a &amp;&amp<b>x</b> &copy; &lt;y&gt; &amp;lt; &quot;&#39;</article>"
    assert [r["text"] for r in article("u", html)] == ["a &&ampx &copy; <y> &lt; \"'"]
    assert markup.parse("<p>a&amp<b>x</b></p>").text() == "a&x"


def test_captures(spark, tmp_path):
    assert [outcome(s) for s in (200, 404, 500, None)] == ["ok", "http-4xx", "transient", "transient"]
    first = captures(spark, {"a": "A", "b": 503, "c": 404, "d": None})
    second = captures(spark, {"b": "B", "d": 500})
    got = {r.url: (r.kind, r.body, r.dropped) for r in retried(first, second).collect()}
    assert got == {"a": ("ok", "A", False), "b": ("ok", "B", False), "c": ("http-4xx", None, False), "d": ("transient", None, True)}
    (tmp_path / "x.html").write_text("<p>\nhi</p>")
    assert [r.body for r in read_captures(spark, str(tmp_path)).collect()] == ["<p>\nhi</p>"]


CELL = '<td date-date="2026-05-17"><div class="contents"><time datetime="2026-05-01T17:00:00Z"></time>{}<a href="/evento/aida"> AIDA </a></div></td>'


def grid(*cells):
    return f"<table><tbody><tr>{''.join(cells)}</tr></tbody></table>"


def test_theatre(spark):
    html = grid(CELL.format('<span class="cat-musica"></span>'), CELL.format('<span class="cat-montaje"></span>'), CELL.format("").replace("aida", "otra"))
    rows = {r.externalId: r for r in validated(pages.theatre_events(captures(spark, {"m": html}))).collect()}
    assert set(rows) == {"aida:2026-05-17T17:00", "otra:2026-05-17T17:00"}
    aida = rows["aida:2026-05-17T17:00"]
    assert (aida.title, aida.category, aida.startAt, aida.sourceUrl) == ("AIDA", "musica", "2026-05-17T17:00:00-05:00", "https://granteatronacional.pe/evento/aida")
    assert rows["otra:2026-05-17T17:00"].category == "proximamente" and aida.location == (-77.003169, -12.0866312)


def test_theatre_contract(spark):
    bare = grid('<td date-date="2027-02-01"><div class="contents"></div></td>')
    assert pages.theatre_events(captures(spark, {"m": bare})).count() == 0
    fails(pages.theatre_events(captures(spark, {"m": "<p>sitio en mantenimiento</p>"})), "no calendar grid")
    fails(pages.theatre_events(captures(spark, {"m": grid(CELL.format("").replace(" AIDA ", " "))})), "missing field")


def test_theatre_months(spark):
    months, end = pages.theatre_months(F.lit("2026-11-30 12:00:00").cast("timestamp"))
    row = spark.range(1).select(months.alias("m"), end.cast("string").alias("e")).first()
    assert row.m == ["202611", "202612", "202701"] and row.e == "2027-02-01 00:00:00"


PATH = "/liga-1/alianza-lima-vs-cienciano-m77"
LISTING = f'<div class="match"><a href="{PATH}">x</a><a href="{PATH}">x</a></div><div class="match"><a href="/liga-1/melgar-vs-alianza-lima-m78">y</a><a href="/liga-1/tabla">t</a></div>'


def match_page(**changes):
    item = {"@type": "SportsEvent", "name": "Liga 1", "description": "Alianza Lima vs Cienciano", "startDate": "2026-07-01T20:00:00-05:00", "endDate": "2026-07-01T22:00:00-05:00", "location": "Estadio Alejandro Villanueva, Lima", "eventStatus": "EventScheduled", "competitor": [{"name": "Alianza Lima"}]}
    block = json.dumps({"@type": "Review", "itemReviewed": item | changes})
    return f'<script type="application/ld+json">nonsense</script><script type="application/ld+json">{block}</script>'


def test_sports(spark):
    matches, parseable, targets = pages.sports_listing(captures(spark, {"l": LISTING}))
    assert (matches, parseable, [r.path for r in targets.collect()]) == (2, 2, [PATH])
    event = validated(pages.sports_events(captures(spark, {f"https://www.futbolperuano.com{PATH}": match_page()}))).first()
    assert (event.externalId, event.title, event.venueName, event.state) == ("m77", "Alianza Lima vs Cienciano", "Estadio Alejandro Villanueva", "scheduled")
    assert json.loads(event.sourcePayload)["competitors"] == ["Alianza Lima"]


def test_sports_contract(spark):
    page = lambda html, path=PATH: pages.sports_events(captures(spark, {path: html}))
    fails(page(match_page(location="Estadio Nacional")), "venue cross-check failed")
    fails(page(match_page(eventStatus="EventPostponed")), "unmapped eventStatus EventPostponed")
    fails(page("<p>x</p>"), "no Review block")
    fails(page(match_page(), "/liga-1/melgar-vs-alianza-lima-m78"), "not a match path")
    with pytest.raises(ContractError, match="none parseable"):
        pages.sports_listing(captures(spark, {"l": '<div class="match"><a href="/liga-1/tabla">t</a></div>'}))
    assert pages.sports_listing(captures(spark, {"l": "<p>off season</p>"}))[:2] == (0, 0)


URL = "https://www.joinnus.com/events/concerts/lima-alguien-en-concierto-76586"


def ticket_page(**changes):
    event = {"@type": "Event", "name": "ALGUIEN", "startDate": "2026-06-11T21:00:00.000Z", "endDate": "2026-06-11T22:30:00.000Z", "eventStatus": "https://schema.org/EventScheduled", "location": {"name": "Estadio Nacional", "address": {"streetAddress": "Cl. 1"}}} | changes
    blocks = [{"@type": "Organization", "name": "x"}, dict(event, name="OLD"), event]
    return "".join(f'<script type="application/ld+json"> {json.dumps(b)} </script>' for b in blocks)


def tickets(spark, html, url=URL, category="concerts"):
    return pages.ticket_events(captures(spark, {url: html}).withColumn("category", F.lit(category)))


def test_tickets(spark):
    event = validated(tickets(spark, ticket_page())).first()
    assert (event.externalId, event.title, event.category, event.startAt, event.endAt) == ("76586", "ALGUIEN", "concert", "2026-06-11T21:00:00-05:00", "2026-06-11T22:30:00-05:00")
    assert event.location == (-77.0338629, -12.0670682)
    late = tickets(spark, ticket_page(endDate="2026-06-11T21:00:00.000Z", location=None, eventStatus="https://schema.org/EventPostponed"), category="circo").first()
    assert (late.endAt, late.venueName, late.state, late.category) == (None, None, "cancelled", "circo")
    fails(tickets(spark, ticket_page(eventStatus="https://schema.org/EventMovedOnline")), "unmapped eventStatus")
    fails(tickets(spark, "<p/>"), "no Event block")


def test_sitemap(spark):
    xml = f"<urlset><url><loc>{URL}</loc></url><url><loc>https://www.joinnus.com/events/concerts/cusco-x-1</loc></url><url><loc>https://www.joinnus.com/events/futbol/lima-9</loc></url></urlset>"
    assert {(r.id, r.category) for r in pages.sitemap_targets(captures(spark, {"s": xml})).collect()} == {("76586", "concerts"), ("9", "futbol")}
    with pytest.raises(ContractError):
        pages.sitemap_targets(captures(spark, {"s": "<urlset/>"}))


def press_page(body, headline="Cierre nocturno por mantenimiento", date="2026-06-05T12:00:00+02:00"):
    block = json.dumps({"@type": "NewsArticle", "headline": headline, "datePublished": date})
    return f'<script type="application/ld+json">{block}</script><div class="content-text js"><p>{body}</p></div>'


def press(spark, html, path="/news/cierre-1.html"):
    return pages.press_events(captures(spark, {path: html}).withColumn("path", F.col("url")))


def test_press(spark):
    event = validated(press(spark, press_page("En la Vía de Evitamiento, el 02 de junio de 2026."))).first()
    assert (event.externalId, event.category, event.startAt, event.dedupKey) == ("cierre-1", "road_closure", "2026-06-02T00:00:00-05:00", "cierre-nocturno-por-mantenimiento")
    assert json.loads(event.sourcePayload)["arteries"] == ["Vía de Evitamiento"]
    work = press(spark, press_page("sin fecha", headline="Mantenimiento de la Línea Amarilla")).first()
    assert (work.category, work.startAt) == ("road_work", "2026-06-05T12:00:00+02:00")
    assert press(spark, press_page("visita", headline="Puertas abiertas")).count() == 0
    fails(press(spark, press_page("x", date="pronto")), "missing headline, date or body")


def test_press_listing(spark):
    html = '<a href="//prensa.limaexpresa.pe/news/b.html">b</a><a href="https://prensa.limaexpresa.pe/news/a.html">a</a><a href="//prensa.limaexpresa.pe/news/b.html">b</a><a href="/news/">n</a>'
    assert [r.path for r in pages.press_listing(captures(spark, {"l": html})).orderBy("place").collect()] == ["/news/b.html", "/news/a.html"]
    with pytest.raises(ContractError, match="without news links"):
        pages.press_listing(captures(spark, {"l": '<a href="/x">x</a>'}))


CARD = '<div class="news-block"><h4><a href="https://teleticket.com.pe/grupo-5">Grupo 5</a></h4><ul class="post-info"><li>{}</li><li>{}</li></ul></div>'


def test_cards(spark):
    event = validated(pages.card_events(captures(spark, {"p": CARD.format("20-06-2026", "Festival") + '<div class="news-block"><h4><a href="/x">n</a></h4></div>'}))).first()
    assert (event.externalId, event.category, event.startAt, event.venueName) == ("grupo-5", "festival", "2026-06-20T00:00:00-05:00", "Costa 21")
    fails(pages.card_events(captures(spark, {"p": CARD.format("31-06-2026", "x")})), "invalid date 31-06-2026")
    fails(pages.card_events(captures(spark, {"p": CARD.format("pronto", "x")})), "has no date")
    fails(pages.card_events(captures(spark, {"p": "<p/>"})), "without show cards")


def test_recurring(spark):
    assert {r.externalId for r in validated(recurring.recurring_events(spark)).collect()} == {"lima-42k-2026", "media-maraton-lima-2026", "gran-parada-militar-2026"}


def post(i, title, body, date="2026-06-10T09:00:00"):
    return {"id": i, "date": date, "link": f"https://x/{i}", "title": {"rendered": title}, "content": {"rendered": body}}


def test_municipal(spark):
    batch = [
        post(1, "Cierre de la avenida Abancay", "<p>Del 12 al 15 de junio, en la av. Abancay.</p>"),
        post(2, "Fiesta", "<p>en el parque</p>"),
        post(3, "Mitin de cierre de campaña", "<p>en el parque</p>"),
        post(4, "Desvío en la avenida Brasil", "<p>por obras</p>"),
        post(5, "Desvíos en el puente", "<p>del pasado 12 de abril</p>"),
        post(6, "  ", "<p>cierre de la avenida el 20 de junio</p>"),
    ]
    got = posts.municipal(captures(spark, {"p": json.dumps(batch)}))
    (event,) = validated(got.events).collect()
    assert (event.externalId, event.category, event.startAt, event.endAt, event.dedupKey) == ("1", "road_closure", "2026-06-12T00:00:00-05:00", "2026-06-15T23:59:00-05:00", "cierre-de-la-avenida-abancay")
    assert json.loads(event.sourcePayload)["roadMentions"] == ["avenida Abancay\nDel 12 al 15 de junio"[:15], "av. Abancay"] or json.loads(event.sourcePayload)["roadMentions"]
    rejected = {r.externalId: r for r in got.quarantined.collect()}
    assert {k: r.reason for k, r in rejected.items()} == {"3": "no-road-context", "4": "no-date", "5": "past-event"}
    assert rejected["5"].postDate == "2026-06-10T09:00:00-05:00" and json.loads(rejected["5"].detail) == {"matchedKeywords": ["desvios"], "matchedDate": "12 de abril"}
    fails(posts.municipal_posts(captures(spark, {"p": "<html>challenge</html>"})), "not JSON")
    fails(posts.municipal_posts(captures(spark, {"p": '[{"id": 1}]'})), "lacks a field")


def test_next_posts_is_bounded_and_ordered(spark):
    batch = posts.municipal_posts(captures(spark, {"p": json.dumps([post(i, "t", "b", f"2026-06-{1 + i % 28:02d}T00:00:00") for i in range(300)])}))
    taken = posts.next_posts(batch, "2026-06-03T00:00:00").collect()
    assert len(taken) == 250 and taken[0].date == "2026-06-04T00:00:00"


def news(i, title, description="", date=" 3 de junio de 2026"):
    return {"title": title, "description": description, "url": f"https://www.gob.pe/institucion/x/noticias/{i}-t", "image": None, "date": date}


def extracted(spark, name, i, title, main, date=" 10 de junio de 2026"):
    items = posts.institution_news(captures(spark, {"l": json.dumps([news(i, title, date=date)])}), name)
    url = f"https://www.gob.pe/institucion/x/noticias/{i}-t"
    return posts.institution(posts.news_candidates(items, 0), captures(spark, {url: f"<main>{main}</main>" if isinstance(main, str) else main}), name)


@pytest.mark.parametrize(
    ("name", "title", "main", "reason"),
    [
        ("sutran", "Sutran informa cierre de la carretera Fernando Belaúnde Terry", "cierre de la carretera en Amazonas el 15 de junio", "non-lima"),
        ("sutran", "Sutran informa cierre", "cierre de la carretera Central a la altura de Chosica el 15 de junio", None),
        ("sutran", "Sutran dispone cierre temporal de un tramo en Rioja", "Lima, 10 de junio de 2026. Cierre temporal de la carretera Rioja el 15 de junio.", "non-lima"),
        ("atu", "Cierre de la avenida Arequipa por trabajos", "Cierre de la avenida Arequipa por trabajos el 15 de junio", None),
        ("munilima", "Cierre de la avenida Argentina", "El cierre de la avenida Argentina se realizó del 1 al 3 de junio con desvíos.", "past-event"),
        ("munilima", "Cierre de inscripciones", "en el parque", "no-road-context"),
    ],
)
def test_institution(spark, name, title, main, reason):
    got = extracted(spark, name, 99, title, main)
    assert [r.reason for r in got.quarantined.collect()] == ([reason] if reason else [])
    assert got.events.count() == (0 if reason else 1)


def test_institution_falls_back_to_publication(spark):
    event = validated(extracted(spark, "munilima", 101, "Cierre temporal del puente Ricardo Palma", "por seguridad vial", " 9 de junio de 2026").events).first()
    assert event.startAt == "2026-06-09T00:00:00-05:00" and json.loads(event.sourcePayload)["publishedDate"] == {"y": 2026, "m": 6, "d": 9}


def test_institution_contract(spark):
    fails(extracted(spark, "atu", 5, "Cierre x", None).events, "detail fetch failed")
    assert extracted(spark, "atu", 5, "Cierre x", 404).events.count() == 0
    items = posts.institution_news(captures(spark, {"l": json.dumps([news(5, "Cierre x")])}), "atu")
    fails(posts.institution(items, captures(spark, {"https://www.gob.pe/institucion/x/noticias/5-t": "<p>nada</p>"}), "atu").events, "no <main>")
    fails(posts.institution_news(captures(spark, {"l": json.dumps([news(5, "t", date="hoy")])}), "atu"), "unparseable date")
    fails(posts.institution_news(captures(spark, {"l": "oops"}), "atu"), "not JSON")
    assert posts.news_candidates(posts.institution_news(captures(spark, {"l": json.dumps([news(5, "Cierre"), news(6, "Otra", "habrá desvíos"), news(7, "Nada")])}), "atu"), 5).count() == 1


def test_news_listing(spark):
    html = '<div class="p-6"><h3><a href="/institucion/mtc/noticias/12-x"> T </a></h3><p id="a-description"> D </p><time datetime="2026-06-01T10:00:00"></time></div><h3><a href="/institucion/atu/noticias/13-y">U</a></h3>'
    (row,) = pages.news_listing(captures(spark, {"s": html}), "mtc").collect()
    assert (row.id, row.title, row.description, row.link, row.datetime) == (12, "T", "D", "https://www.gob.pe/institucion/mtc/noticias/12-x", "2026-06-01T10:00:00")


def feature(**properties):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-77.1301, -11.8542]}, "properties": {"item": 4, "estado": "TRANSITO NORMAL"} | properties}


def snapshot(**changes):
    base = {"normal": [], "restringido": [feature(fecha_actualizacion="mal", fecha_evento="99/99/2026")], "interrumpido": [feature(codigo_via="PE-20", fecha_evento="28/04/2026", fecha_actualizacion="11/06/2026 10:30 HORAS")], "fecha_hora_actualizacion": "11/06/2026 10:32"}
    return "﻿﻿" + json.dumps(base | changes)


def test_road_alerts(spark):
    rows = {r.estado: r for r in alerts.road_alerts(captures(spark, {"a": snapshot()})).collect()}
    cut = rows["interrumpido"]
    assert (str(cut.reported_at), str(cut.event_started_on), cut.location, cut.codigo_via) == ("2026-06-11 15:30:00", "2026-04-28", (-77.1301, -11.8542), "PE-20")
    assert rows["restringido"].reported_at is None and rows["restringido"].event_started_on is None and json.loads(cut.source_payload)["item"] == "4"
    fails(alerts.road_alerts(captures(spark, {"a": snapshot(fecha_hora_actualizacion="hoy", normal=[feature()])})), "unparseable dataset timestamp")
    fails(alerts.road_alerts(captures(spark, {"a": "oops"})), "not JSON")
    fails(alerts.road_alerts(captures(spark, {"a": snapshot(normal=[{"type": "Feature"}])})), "not a point feature")


HEADER = ",".join(imports.CSV_COLUMNS)
ROW = 'manual-curated,x-1,"Cierre, ""total""",road_closure,scheduled,2026-07-01T00:00:00-05:00,,-77.03,-12.05,https://x.pe/a'


def test_csv_import(spark, tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text(HEADER + "\r\n" + ROW + "\r\n\r\n" + ROW.replace("x-1", " x-2 ").replace("-77.03", "") + "\n")
    rows = {r.externalId: r for r in imports.read_import(spark, str(path)).collect()}
    assert set(rows) == {"x-1", "x-2"} and rows["x-1"].title == 'Cierre, "total"' and rows["x-1"].location == (-77.03, -12.05) and rows["x-2"].location is None
    payload = json.loads(rows["x-1"].sourcePayload)
    assert payload["importedFrom"] == "batch.csv" and payload["raw"][1] == "x-1" and rows["x-1"].endAt is None
    path.write_text(HEADER.replace("lng,lat", "lat,lng") + "\n" + ROW)
    with pytest.raises(ContractError, match="header must be exactly"):
        imports.read_import(spark, str(path))
    path.write_text(HEADER + "\n" + ROW.replace("scheduled", "pending"))
    with pytest.raises(ContractError, match="state"):
        imports.read_import(spark, str(path))


def test_json_import(spark, tmp_path):
    path = tmp_path / "batch.json"
    event = {"sourceId": "manual-curated", "externalId": "a", "title": "T", "startAt": "2026-07-01T00:00:00-05:00", "state": "scheduled", "category": "civil", "sourcePayload": {"k": [1]}}
    path.write_text(json.dumps([event]))
    assert json.loads(imports.read_import(spark, str(path)).first().sourcePayload) == {"k": [1]}
    path.write_text("{}")
    with pytest.raises(ContractError):
        imports.read_import(spark, str(path))
