"""Work that follows the rows: tasks of even size, pages parsed once, cursors read when they are needed."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from wayfare.functions import text
from wayfare.operators import validate
from wayfare.operators.validate import ContractError
from wayfare.plans import audit, ingest, scans
from wayfare.plans.queries import connectors
from wayfare.plans.queries.rules import scraped
from wayfare.plans.store import Store
from wayfare.sources import alerts, markup, pages, posts
from wayfare.sources.captures import captures


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_split_are_made_by_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id o_orderkey", "timestamp'1995-01-01' o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = connectors.written(spark, str(tmp_path), "'x'")
    sizes = [len(rows) for rows in made.rdd.glom().collect()]
    assert len(sizes) >= 4 and max(sizes) < 200 and sum(sizes) == 400


def test_a_press_page_is_parsed_once(spark):
    found = pages.press_events(captures(spark, {"p": "x"}).selectExpr("url path", "body"))
    assert plan(found).count("ArrowEvalPython") == 1


def test_an_audit_moves_no_page_that_it_does_not_judge(spark):
    listing = '<div class="p-6"><h3><a href="/institucion/mtc/noticias/{0}-n">Cierre de la avenida {0}</a></h3><time datetime="2026-06-01T10:00:0{0}"></time></div>'
    listed = pages.news_listing(captures(spark, {f"l{i}": listing.format(i) for i in range(3)}), "mtc")
    details = captures(spark, {f"https://www.gob.pe/institucion/mtc/noticias/{i}-n": "<main>En la avenida Larco de Miraflores</main>" for i in range(3)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = audit.audit_institution(listed, details, "mtc", datetime(2026, 6, 10, tzinfo=UTC))
        assert "SortMergeJoin" not in plan(found)
        assert sorted((r.id, r.stage) for r in found.collect()) == [(i, "extracted") for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_alert_page_is_read_once_for_all_levels(spark):
    feature = '{"type":"Feature","geometry":{"type":"Point","coordinates":[-77.5,-11.5]},"properties":{"codigo_via":"%s","fecha_actualizacion":"03/04/2026 7:05 HORAS","fecha_evento":"31/02/2026"}}'
    body = '{"normal":[%s,%s],"restringido":[],"interrumpido":[%s],"fecha_hora_actualizacion":"11/06/2026 10:32"}' % tuple(feature % c for c in "abc")
    found = alerts.road_alerts(captures(spark, {"p": body}))
    assert plan(found).count("Generate inline") == 1 and "Union" not in plan(found)
    rows = [(r.estado, r.place, r.codigo_via, str(r.reported_at), r.event_started_on) for r in found.collect()]
    assert sorted(rows) == [("interrumpido", 0, "c", "2026-04-03 12:05:00", None), ("normal", 0, "a", "2026-04-03 12:05:00", None), ("normal", 1, "b", "2026-04-03 12:05:00", None)]


def test_a_cursor_is_made_when_it_is_read(spark):
    calls = []
    found = ingest.ScanResult(captures(spark, {}), next_cursor=lambda: calls.append(1) or {"n": 1})
    assert not calls
    assert found.next_cursor == found.next_cursor == {"n": 1} and calls == [1]


def batch(spark, first, n, **columns):
    return scraped(spark.range(first, first + n).selectExpr("id k", "'2026-07-01' d"), **columns)


def test_a_batch_without_news_is_not_compared_with_the_store(spark, tmp_path, monkeypatch):
    store, now = Store(spark, f"file://{tmp_path}/s"), datetime(2026, 6, 10, tzinfo=UTC)
    store.migrate()
    with monkeypatch.context() as m:
        m.setattr(ingest, "told_before", None)
        got = ingest.upsert_events(store, batch(spark, 0, 30), now)
        assert (got.inserted, got.updated, got.suppressed, got.duplicates.count()) == (30, 0, 0, 0)
        # The first rows are the base; ids go on without a search for the largest, whatever is written over them.
        assert [f[:2] for f in store.version("events")] == ["v-"] and store.pointer("events").last_id == 30
        got = ingest.upsert_events(store, batch(spark, 20, 30, title="'new'"), now)
        assert (got.inserted, got.updated) == (20, 10) and [f[:2] for f in store.version("events")] == ["v-", "c="]
        m.setattr(Store, "read", None)
        assert store.last_id("events") == 50
    rows = store.read("events").collect()
    assert sorted(r.id for r in rows) == list(range(1, 51)) and sum(r.title == "new" for r in rows) == 30
    news = lambda source: batch(spark, 100, 2, sourceId=f"'{source}'", dedupKey="CASE WHEN k = 100 THEN 'obras' END")
    assert ingest.upsert_events(store, news("a"), now).inserted == 2
    again = ingest.upsert_events(store, news("b"), now)
    assert (again.inserted, again.suppressed, again.duplicates.first().of_source_id) == (1, 1, "a")


def test_ids_go_on_after_those_of_replaced_rows(spark, tmp_path):
    store, now = Store(spark, f"file://{tmp_path}/s"), datetime(2026, 6, 10, tzinfo=UTC)
    store.migrate()
    ingest.upsert_events(store, batch(spark, 0, 3), now)
    store.replace("events", store.read("events").selectExpr("id + 1000 id", "* except (id)"))
    ingest.upsert_events(store, batch(spark, 0, 5), now)
    assert sorted(r.id for r in store.read("events").collect()) == [1001, 1002, 1003, 1004, 1005]


def test_one_change_set_is_read_without_a_search_for_the_newest(spark, tmp_path):
    store, now = Store(spark, f"file://{tmp_path}/s"), datetime(2026, 6, 10, tzinfo=UTC)
    store.migrate()
    for first, sets in ((0, 0), (2, 1), (4, 2)):
        ingest.upsert_events(store, batch(spark, first, 4), now)
        assert ("Window" in plan(store.read("events"))) == (sets > 1) and len(store.version("events")) == 1 + sets
    assert store.read("events").count() == 8


def test_all_tasks_look_for_a_bad_row_at_once(spark):
    def jobs(rows):
        spark.sparkContext.setJobGroup("bad-rows", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bad-rows"))
        validate.validated(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("bad-rows")) - before

    few, many = (jobs(scraped(spark.range(0, 100, 1, n).selectExpr("id k", "'2026-07-01' d"))) for n in (2, 40))
    assert 0 < few == many


def test_a_news_item_is_read_once(spark):
    news = posts.institution_news(captures(spark, {"l": "[]"}), "mtc")
    found = posts.institution(posts.news_candidates(news, 0), captures(spark, {}), "mtc").events.select("externalId", "startAt")
    made = plan(found)
    assert made.count("from_json(") == made.count("parseJson(") == 1
    assert made.count("/noticias/(") == 1
    # The text is searched for dates once, whatever asks for the dates.
    alone = spark.sql("SELECT '' t, current_date() d").select(posts.date_range(F.col("t"), F.col("d"), F.col("t")))
    assert made.count("hasta el") == plan(alone).count("hasta el")


def test_a_sports_scan_counts_no_boxes(spark, monkeypatch):
    listing = '<div class="match"><a href="/liga-1/alianza-lima-vs-x-m1">x</a></div><div class="match"><a href="/liga-1/otro-vs-x-m2">x</a></div>'
    assert pages.sports_targets(captures(spark, {"l": listing, "m": listing})).collect() == pages.sports_listing(captures(spark, {"l": listing}))[2].collect()
    assert pages.sports_targets(captures(spark, {"l": "<p></p>"})).count() == 0
    with pytest.raises(ContractError, match="sports: 1 matches but none parseable"):
        pages.sports_targets(captures(spark, {"l": '<div class="match"></div>'}))
    monkeypatch.setattr(pages, "sports_listing", None)
    scanned = scans.sports(lambda source, part: captures(spark, {"l": listing} if part == "listing" else {}), spark).scan(None)
    assert scanned.events.count() == 0


def test_folding_finds_all_letters(spark):
    points = spark.createDataFrame([(chr(p), f"a{chr(p)}ñ") for p in range(1, 0x11000) if not 0xD800 <= p <= 0xDFFF], "one string, many string")
    letters, bare = text.fold_table()
    for c in points.columns:
        assert points.filter(text.fold(F.col(c)) != F.translate(F.lower(c), letters, bare)).count() == 0
    assert points.select(text.fold(F.lit(None).cast("string")).alias("n")).first().n is None


def tree(node):
    return node.tag, node.attrs, [c if isinstance(c, str) else tree(c) for c in node.children]


PLAIN = (
    '<!DOCTYPE html><html><head><script type="application/ld+json">{"a":"<b>&amp;"}</SCRIPT ></head><body a=\'1 "\' b c="" A="2"><!-- x --><br><br/><img src="a>b<c"><P CLASS="x  y">1 &lt; 2 &amp</p></li></body></html> &copy',
    '<main\n><p>En Miraflores</p></main>', "x", "", "<li>1<li>2", "<div/>t", "<style></style>", "</p>",
)
OTHER = ("<a href=x>y</a>", "<a b = 'c'>", '<a b="c"d="e">', "<a b='", "1 < 2", "<!-- a > b -->", "<?x?>", "<script>", "<script>x</\u017fcript>y</script>", "</ p>", "<a\x0bb>", "<x:y>")


def test_a_plain_page_gives_the_tree_of_the_library(spark):
    for page in PLAIN:
        assert tree(markup._plain(page)) == tree(markup._by_library(page)) == tree(markup.parse(page))
    for page in OTHER:
        assert markup._plain(page) is None and tree(markup.parse(page)) == tree(markup._by_library(page))
