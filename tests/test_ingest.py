"""The store, merges, runs, serving queries, audit and streaming, over small inline rows."""

import json
import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.operators import cursors, dedup, merge, summaries
from wayfare.operators import filters as predicates
from wayfare.operators.validate import ContractError, orphans, region_violations, validated
from wayfare.plans import audit, ingest, scans, serving
from wayfare.plans.ingest import KEEP, ScanResult, Source
from wayfare.plans.store import Store, region_id, seed_regions
from wayfare.sources import posts
from wayfare.sources.captures import captures
from wayfare.streaming.incremental import event_files, merge_into, run_available

NOW = datetime(2026, 6, 12, 6, 0, tzinfo=UTC)
NAMES = schemas.column_names(schemas.SCRAPED_EVENT)


@pytest.fixture(scope="module")
def migrated(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("migrated")
    Store(spark, f"file://{path}/store").migrate()
    return path / "store"


@pytest.fixture
def store(spark, tmp_path, migrated):
    """A store of one's own: a copy of one that was just migrated."""
    shutil.copytree(migrated, tmp_path / "store")
    return Store(spark, f"file://{tmp_path}/store")


def event(external, start="2026-07-01T20:00:00-05:00", source="s", **more):
    base = {"sourceId": source, "externalId": external, "title": f"T {external}", "startAt": start, "state": "scheduled", "category": "concert", "sourcePayload": "{}"}
    return base | more


def events(spark, *rows):
    return spark.createDataFrame([(*[r.get(n) for n in NAMES], i) for i, r in enumerate(rows)], f"{schemas.SCRAPED_EVENT}, batch_pos int")


def table(store, name="events", key="external_id"):
    return {r[key]: r for r in store.read(name).collect()}


def test_seed_is_idempotent(store):
    assert seed_regions(store) == (0, 25) and store.read("regions").count() == 25
    assert store.read("regions").filter("slug = 'lima'").first().id == region_id(store)
    with pytest.raises(LookupError):
        region_id(store, "narnia")
    bad = store.spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 2, 1)], "id long, level int, parent_id long")
    assert [r.id for r in bad.filter(F.size(region_violations()) > 0).collect()] == [1]
    assert orphans(bad, "parent_id", bad).count() == 0


def test_upsert_is_idempotent_and_overwrites_with_null(spark, store):
    first = ingest.upsert_events(store, events(spark, event("a", venueName="V", endAt="2026-07-01T23:00:00-05:00"), event("b")), NOW)
    assert (first.inserted, first.updated) == (2, 0)
    before = table(store)
    again = ingest.upsert_events(store, events(spark, event("a", title="new", state="cancelled"), event("b"), event("c")), NOW + timedelta(days=1))
    after = table(store)
    assert (again.inserted, again.updated) == (1, 2)
    assert after["a"].title == "new" and after["a"].state == "cancelled" and after["a"].venue_name is None and after["a"].end_at is None
    assert all(after[k].id == before[k].id and after[k].ingested_at == before[k].ingested_at and after[k].updated_at > before[k].updated_at for k in "ab")
    assert len({r.id for r in after.values()}) == 3 and max(r.id for r in after.values()) == 3


def test_last_of_a_key_wins_in_a_batch(spark, store):
    got = ingest.upsert_events(store, events(spark, event("a", title="1"), event("b"), event("a", title="2")), NOW)
    assert (got.inserted, table(store)["a"].title) == (2, "2")


@pytest.mark.parametrize(("start", "source", "kept"), [("2026-10-15T00:00:00-05:00", "gob", False), ("2026-10-15T00:00:01-05:00", "gob", True), ("2026-10-03T00:00:00-05:00", "mml", True), ("2027-10-01T00:00:00-05:00", "gob", True)])
def test_suppression(spark, store, start, source, kept):
    ingest.upsert_events(store, events(spark, event("1", "2026-10-01T00:00:00-05:00", "mml", dedupKey="k")), NOW)
    got = ingest.upsert_events(store, events(spark, event("2", start, source, dedupKey="k"), event("3", start, source)), NOW)
    assert got.inserted == 1 + kept and got.suppressed == (not kept)
    if not kept:
        assert got.duplicates.first().of_external_id == "1"


def test_batch_does_not_suppress_itself(spark, store):
    assert ingest.upsert_events(store, events(spark, event("1", source="a", dedupKey="k"), event("2", source="b", dedupKey="k")), NOW).inserted == 2


def test_suppressed_row_does_not_update_its_stored_copy(spark, store):
    ingest.upsert_events(store, events(spark, event("1", source="a", dedupKey="k"), event("2", source="b", dedupKey="k")), NOW)
    got = ingest.upsert_events(store, events(spark, event("2", source="b", dedupKey="k", title="new")), NOW)
    assert (got.updated, got.suppressed, table(store)["2"].title) == (0, 1, "T 2")


def test_sweep(spark, store):
    rows = [event("past", "2026-06-01T00:00:00-05:00"), event("seen", "2026-08-01T00:00:00-05:00"), event("missing", "2026-08-02T00:00:00-05:00"), event("beyond", "2027-07-01T00:00:00-05:00"), event("other", "2026-08-02T00:00:00-05:00", "x")]
    ingest.upsert_events(store, events(spark, *rows), NOW)
    listed = spark.createDataFrame([("seen",), (None,)], "external_id string")
    end = datetime(2027, 6, 1, tzinfo=UTC)
    assert ingest.cancel_missing(store, "s", NOW, end, listed) == 1
    assert {k: r.state for k, r in table(store).items() if r.state == "cancelled"} == {"missing": "cancelled"}
    assert ingest.cancel_missing(store, "s", NOW, end, listed) == 0
    ingest.upsert_events(store, events(spark, rows[2]), NOW)
    assert table(store)["missing"].state == "scheduled"


def test_quarantine_keeps_first_seen(spark, store):
    make = lambda *rows: spark.createDataFrame(rows, schemas.QUARANTINED_POST)
    ingest.record_quarantine(store, make(("mml", "1", "T", "u", "no-date", "2026-06-01T00:00:00-05:00", None)), NOW)
    ingest.record_quarantine(store, make(("mml", "1", "T2", "u", "past-event", None, "{}"), ("mml", "2", "U", None, "no-date", None, None)), NOW + timedelta(hours=1))
    rows = table(store, "ingest_quarantine")
    assert rows["1"].reason == "past-event" and rows["1"].post_date is None and rows["1"].last_seen_at - rows["1"].first_seen_at == timedelta(hours=1) and {r.id for r in rows.values()} == {1, 2}
    with pytest.raises(ContractError, match="twice"):
        ingest.record_quarantine(store, make(*[("mml", "9", "T", None, "no-date", None, None)] * 2), NOW)


def result(spark, *rows, **more):
    return ScanResult(events(spark, *rows), **more)


def test_run_isolates_sources_and_freezes_cursors(spark, store):
    def broken(cursor):
        raise RuntimeError("boom")

    good = Source("good", lambda cursor: result(spark, event("a", source="good"), next_cursor={"n": (json.loads(cursor)["n"] if cursor else 0) + 1}))
    invalid = Source("invalid", lambda cursor: result(spark, event("x", source="invalid"), event("", source="invalid"), next_cursor={"n": 9}))
    sources = [Source("bad", broken), invalid, good]
    first = ingest.run_once(store, sources, NOW)
    second = ingest.run_once(store, sources, NOW + timedelta(hours=1))
    state = table(store, "ingest_state", "source_id")
    assert (first.inserted, second.inserted, second.updated, second.failed_sources) == (1, 0, 1, ["bad", "invalid"])
    assert state["bad"].consecutive_failures == 2 and state["bad"].last_error == "boom" and state["bad"].last_success_at is None
    assert state["good"].cursor == '{"n": 2}' and state["invalid"].cursor is None and set(table(store)) == {"a"}
    sources[0] = Source("bad", lambda cursor: result(spark))
    assert ingest.run_once(store, sources, NOW + timedelta(hours=2)).failed_sources == ["invalid"]
    row = table(store, "ingest_state", "source_id")["bad"]
    assert row.consecutive_failures == 0 and row.last_error is None and row.last_error_at is not None


def test_run_sweeps_only_complete_batches(spark, store):
    end = datetime(2027, 1, 1, tzinfo=UTC)
    run = lambda *rows, **more: ingest.run_once(store, [Source("s", lambda c: result(spark, *rows, **more))], NOW)
    run(event("a"), event("b"))
    assert run(event("a")).cancelled == 0 and run(sweep_window_end=end).cancelled == 0
    assert run(event("a"), sweep_window_end=end).cancelled == 1


def test_a_run_lets_go_of_what_it_persisted(spark, store):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    rejected = spark.createDataFrame([("s", "p", "t", None, "no-date", None, None)], "sourceId string, externalId string, title string, url string, reason string, postDate string, detail string")
    before = held()
    ingest.run_once(store, [Source("s", lambda c: ScanResult(events(spark, event("a"), event("b")), rejected))], NOW)
    assert store.read("ingest_quarantine").count() == 1 and held() == before


def test_first_run_catches_up_once(spark, store):
    source = Source("s", lambda c: result(spark, event("a")))
    assert ingest.run_first_time(store, [source], NOW).inserted == 1
    assert ingest.run_first_time(store, [source], NOW) is None


def alert_pages(spark, n=2, at="11/06/2026 10:32"):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-77.0, -12.0]}, "properties": {}}
    return captures(spark, {"a": json.dumps({"normal": [feature] * n, "restringido": [feature], "interrumpido": [feature], "fecha_hora_actualizacion": at})})


def test_snapshot_replaces_and_survives_failure(spark, store):
    sync = lambda pages: ingest.sync_road_alerts(store, scans.alert_scan(lambda s, p: pages), NOW)
    assert sync(alert_pages(spark)) and store.read("road_alerts").count() == 4
    assert sync(alert_pages(spark)) and store.read("road_alerts").count() == 4
    assert not sync(alert_pages(spark, at="hoy")) and store.read("road_alerts").count() == 4
    assert sync(alert_pages(spark, 0)) and store.read("road_alerts").count() == 2
    assert [r.estado for r in serving.road_alerts_query(store.read("road_alerts")).collect()] == ["interrumpido", "restringido"]
    assert table(store, "ingest_state", "source_id")["sutran-alerts"].consecutive_failures == 0


def test_snapshot_of_an_unknown_level_is_refused(spark, store):
    rows = scans.alert_scan(lambda s, p: alert_pages(spark))().withColumn("estado", F.lit("lento"))
    with pytest.raises(ContractError, match="level lento"):
        ingest.replace_road_alerts(store, rows, NOW)


def test_import(spark, store):
    source, counts = ingest.import_events(store, events(spark, event("a", source="manual")), NOW, ["mml"])
    assert (source, counts.inserted) == ("manual", 1) and ingest.import_events(store, events(spark, event("a", source="manual")), NOW)[1].updated == 1
    for rows, why in (([], "empty"), ([event("a", source="x"), event("b", source="y")], "one sourceId"), ([event("a", source="mml")], "registered"), ([event("a", source="sutran-alerts")], "registered")):
        with pytest.raises(ContractError, match=why):
            ingest.import_events(store, events(spark, *rows), NOW, ["mml"])


@pytest.mark.parametrize(
    "change",
    [{"startAt": "2026-07-01"}, {"startAt": "2026-07-01T20:00:00"}, {"endAt": "2026-07-01T20:00:00-05:00"}, {"title": ""}, {"state": "pending"}, {"location": (-190.0, 0.0)}, {"sourceUrl": "ftp://x/y"}, {"venueName": ""}, {"dedupKey": ""}, {"category": None}, {"startAt": "2026-02-30T20:00:00-05:00"}],
)
def test_contract(spark, change):
    with pytest.raises(ContractError):
        validated(events(spark, event("ok"), event("a") | change))


GOLDEN = [
    event("e1", "2026-07-01T20:00:00-05:00", "1", endAt="2026-07-01T23:00:00-05:00", location=(-77.03, -12.05), venueName="V"),
    event("e2", "2026-07-05T18:00:00-05:00", "1", category="futbol", location=(-77.03, -12.05)),
    event("e3", "2026-07-10T08:00:00-05:00", "2", category="road_closure", state="cancelled"),
    event("e4", "2026-07-02T08:00:00-05:00", "2", category="road_work", endAt="2026-07-09T18:00:00-05:00"),
    event("g", "2026-07-03T08:00:00-05:00", "joinnus"),
]


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    made = Store(spark, f"file://{tmp_path_factory.mktemp('served')}")
    made.migrate()
    ingest.upsert_events(made, events(spark, *GOLDEN), NOW)
    ingest.record_success(made, "1", NOW)
    ingest.record_failure(made, "mml", NOW, RuntimeError("secret text"))
    return made


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [
        ({}, "e1 e4 e2 e3"),
        ({"from_": "2026-07-04T00:00:00-05:00", "to": "2026-07-06T00:00:00-05:00"}, "e4 e2"),
        ({"from_": "2026-07-08T00:00:00-05:00"}, "e4 e3"),
        ({"from_": "2026-07-09T18:00:00-05:00", "to": "2026-07-10T08:00:00-05:00"}, "e4 e3"),
        ({"source": "2"}, "e4 e3"),
        ({"category": "futbol"}, "e2"),
        ({"limit": "2"}, "e1 e4"),
        ({"exposed": True}, "e1 e4 g e2 e3"),
        ({"source": "joinnus"}, ""),
        ({"source": "joinnus", "exposed_until": NOW + timedelta(seconds=1)}, "g"),
        ({"source": "joinnus", "exposed_until": NOW}, ""),
    ],
)
def test_events_query(served, arguments, expected):
    assert " ".join(r.externalId for r in serving.events_query(served.read("events"), NOW, **arguments).collect()) == expected


def test_event_query_and_shape(served):
    stored = served.read("events")
    ids = {r.external_id: r.id for r in stored.collect()}
    row = serving.event_query(stored, ids["e1"], NOW).first()
    assert (row.startAt, row.endAt, row.location, row.venueName) == ("2026-07-02T01:00:00.000Z", "2026-07-02T04:00:00.000Z", (-77.03, -12.05), "V")
    assert serving.event_query(stored, ids["g"], NOW).count() == 0 and serving.event_query(stored, 999, NOW).count() == 0
    for bad in ({"limit": 0}, {"limit": 501}, {"from_": "2026-07-01"}, {"to": "2026-07-01T00:00:00"}, {"category": ""}):
        with pytest.raises(ValueError):
            serving.events_query(stored, NOW, **bad)
    with pytest.raises(ValueError):
        serving.event_query(stored, 0, NOW)


def test_summaries(served):
    stored, state = served.read("events"), served.read("ingest_state")
    (pin,) = serving.event_pins(stored).collect()
    assert (pin.n, pin.venue_name) == (2, "V")
    assert [r.value for r in serving.category_facets(stored, "zzz").collect()] == ["concert", "futbol", "road_closure", "road_work", "zzz"]
    fresh = serving.freshness_query(state).first()
    assert (fresh.sources, fresh.failing, fresh.failing_labels) == (2, 1, ["Municipalidad de Lima"])
    statuses = serving.sources_query(state)
    assert "last_error" not in statuses.columns and "secret" not in str(statuses.collect()) and statuses.first().lastSuccessAt == "2026-06-12T06:00:00.000Z"
    assert serving.labelled(stored).filter("external_id = 'e1'").first().subtitle == "Concierto · V"
    assert serving.events_near(stored, -77.03, -12.05, 10).count() == 2
    assert {tuple(r.path) for r in serving.region_tree(served.read("regions")).collect()} >= {("lima",), ("callao",)}
    assert summaries.counters(stored, unpinned=F.col("location").isNull()).first().unpinned == 3


def test_unbounded_predicates_ask_nothing(spark):
    rows = spark.range(3)
    assert rows.filter(predicates.all_of([])).count() == 3 and predicates.after(rows, "id", None).count() == 3


def test_cursors(spark):
    read = cursors.read_cursor
    assert read('{"after": "2026-06-01T00:00:00"}', "after", str) == "2026-06-01T00:00:00" and read('{"after": 1}', "after", str) is None and read("oops", "after", str) is None
    assert read('{"lastId": 7}', "lastId", int) == 7 and read('{"lastId": true}', "lastId", int) is None and read(None, "lastId", int) is None
    assert read('{"seenIds": ["1"]}', "seenIds", list) == ["1"] and read('{"seenIds": [1]}', "seenIds", list) is None
    assert cursors.backfill_start(datetime(2026, 6, 12, 3, 0)) == "2026-05-12T22:00:00"
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert [r.id for r in cursors.largest_seen(ids("9", "100"), ids("20", "9"), "id", 2).collect()] == ["100", "20"]


def test_new_ids_are_gapless(spark):
    rows = spark.range(500).select(F.col("id").alias("k"))
    ids = sorted(r.id for r in merge.with_new_ids(rows, ["k"], 10).collect())
    assert ids == list(range(11, 511))
    assert dedup.last_wins(rows.withColumn("g", F.col("k") % 2), ["g"], [F.col("k")]).count() == 2


def test_backfills(spark):
    base = {"source_id": "mml", "title": "¡Vía!", "source_payload": "{}"}
    rows = [base, {"source_id": "joinnus", "source_payload": '{"venue": "V"}', "dedup_key": "k"}, {"source_id": "futbolperuano", "source_payload": '{"stadium": "E"}'}, {"source_id": "gran-teatro-nacional"}, {"source_id": "costa-21", "venue_name": "old", "source_payload": "{}"}]
    names = schemas.column_names(schemas.EVENTS)
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.EVENTS)
    got = {r.source_id: (r.venue_name, r.dedup_key) for r in ingest.backfilled(frame).collect()}
    assert got == {"mml": (None, "via"), "joinnus": ("V", "k"), "futbolperuano": ("E", None), "gran-teatro-nacional": ("Gran Teatro Nacional", None), "costa-21": ("old", None)}


def test_lock_excludes_a_second_writer(store):
    with store.locked("events"), pytest.raises(TimeoutError), store.locked("events", wait_s=0.2):
        pass
    with store.locked("events"):
        pass


def municipal_page(*rows):
    return json.dumps([{"id": i, "date": d, "link": f"https://x/{i}", "title": {"rendered": t}, "content": {"rendered": b}} for i, d, t, b in rows])


def test_registry_run_end_to_end(spark, store):
    pages = {
        ("mml", "listing"): {"p": municipal_page((1, "2026-06-10T09:00:00", "Cierre de la avenida Abancay", "<p>el 20 de junio</p>"), (2, "2026-06-11T09:00:00", "Cierre de campaña", "<p>x</p>"))},
        ("gob-pe-munilima", "listing"): {"l": json.dumps([{"title": "Cierre de la avenida Abancay", "description": "", "url": "https://www.gob.pe/institucion/munilima/noticias/7-c", "date": "11 de junio de 2026"}])},
        ("gob-pe-munilima", "detail"): {"https://www.gob.pe/institucion/munilima/noticias/7-c": "<main>cierre de la avenida Abancay el 21 de junio</main>"},
    }
    fetch = lambda source, part: captures(spark, pages.get((source, part), {"none": 503}))
    registry = scans.registry(spark, fetch, NOW)
    assert [s.name for s in registry] == ["gran-teatro-nacional", "futbolperuano", "mml", "lima-expresa", "recurring-events", "gob-pe-atu", "gob-pe-sutran", "gob-pe-mtc", "gob-pe-munilima", "joinnus", "costa-21"]
    chosen = [s for s in registry if s.name in ("mml", "recurring-events", "gob-pe-munilima", "costa-21")]
    summary = ingest.run_once(store, chosen, NOW)
    assert (summary.inserted, summary.suppressed, summary.quarantined, summary.failed_sources) == (4, 1, 1, ["costa-21"])
    state = table(store, "ingest_state", "source_id")
    assert json.loads(state["mml"].cursor) == {"after": "2026-06-11T09:00:00"} and json.loads(state["gob-pe-munilima"].cursor) == {"lastId": 7}
    again = ingest.run_once(store, chosen[:2], NOW)
    assert (again.inserted, again.updated) == (0, 3)


def test_audit(spark, tmp_path):
    frame = posts.municipal_posts(captures(spark, {"p": municipal_page((1, "2026-06-10T09:00:00", "Culminamos obras", "<p>fue rehabilitada</p>"), (2, "2026-06-10T09:00:00", "Cierre de la avenida X", "<p>el 20 de junio</p>"), (3, "2025-06-10T09:00:00", "old", "x"))}))
    rows = {r.id: r for r in audit.audit_municipal(frame, NOW).collect()}
    assert set(rows) == {1, 2} and rows[1].stage == "no-trigger" and rows[1].pastHits == ["culminamos", "fue rehabilitada"] and rows[2].stage == "extracted" and rows[2].matchedDate == "20 de junio"
    listed = spark.createDataFrame([("s", i, t, "", f"l{i}", "2026-06-10T10:00:00") for i, t in ((1, "Nada"), (2, "Cierre de vía"), (3, "Cierre total"), (4, "Desvío"))], "url string, id long, title string, description string, link string, datetime string")
    details = captures(spark, {"l2": "<main>cierre de la avenida en Nazca el 20 de junio</main>", "l3": "<main>cierre del puente en Ate del 1 al 3 de junio</main>", "l4": 404})
    found = audit.audit_institution(listed, details, "mtc", NOW)
    assert {r.id: r.stage for r in found.collect()} == {1: "no-trigger-listing", 2: "non-lima", 3: "past-event", 4: "detail-fetch-failed-http-4xx"}
    assert {(r.stage, r.n) for r in audit.summary(found).collect()} == {("no-trigger-listing", 1), ("non-lima", 1), ("past-event", 1), ("detail-fetch-failed-http-4xx", 1)}
    audit.write(found, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4


def test_stream_redelivery_inserts_once(spark, store, tmp_path):
    inbox = tmp_path / "in"
    deliver = lambda *rows: events(spark, *rows).drop("batch_pos").coalesce(1).write.mode("append").json(str(inbox))
    write = merge_into(store, "stream", lambda: NOW)
    deliver(event("a"), event("b"))
    run_available(event_files(spark, str(inbox)), write, str(tmp_path / "c1"))
    deliver(event("b", title="new"), event("c"))
    run_available(event_files(spark, str(inbox)), write, str(tmp_path / "c1"))
    assert {k: r.title for k, r in table(store).items()} == {"a": "T a", "b": "new", "c": "T c"}
    run_available(event_files(spark, str(inbox)), write, str(tmp_path / "c2"))
    assert store.read("events").count() == 3
    deliver(event("bad", state="pending"))
    with pytest.raises(Exception, match="invalid event"):
        run_available(event_files(spark, str(inbox)), write, str(tmp_path / "c1"))
    assert table(store, "ingest_state", "source_id")["stream"].consecutive_failures == 1


def test_keep_leaves_the_cursor(store):
    ingest.record_success(store, "s", NOW, {"n": 1})
    ingest.record_success(store, "s", NOW, KEEP)
    assert ingest.read_cursor(store, "s") == '{"n": 1}'
    ingest.record_success(store, "s", NOW, None)
    assert ingest.read_cursor(store, "s") == "null" and cursors.read_cursor("null", "n", int) is None


def test_a_lost_writers_lock_lapses(spark, tmp_path):
    import time

    store = Store(spark, f"file://{tmp_path}/leased")
    store.migrate()
    fs, path = store._path("events", "_LOCK")
    assert fs.createNewFile(path)
    with pytest.raises(TimeoutError), store.locked("events", wait_s=0.3):
        pass
    fs.setTimes(path, int((time.time() - 100) * 1000), -1)
    with store.locked("events", wait_s=5, lease_s=50):
        assert fs.exists(path)
    assert not fs.exists(path)


def test_a_merge_writes_what_it_touches(spark, store, monkeypatch):
    ingest.upsert_events(store, events(spark, *[event(str(i)) for i in range(40)]), NOW)
    store.replace("events", store.read("events"))
    (base,) = store.version("events")
    early = store.read("events")
    for n in range(3):
        got = ingest.upsert_events(store, events(spark, event("7", title=f"new {n}"), event(f"more {n}")), NOW)
        assert (got.inserted, got.updated) == (1, 1)
    first, *changes = store.version("events")
    assert first == base and [spark.read.parquet(f"{store.root}/events/{c}").count() for c in changes] == [2, 2, 2]
    rows = table(store)
    assert len(rows) == 43 and rows["7"].title == "new 2" and len({r.id for r in rows.values()}) == 43
    # A writer that was lost before the pointer moved has changed nothing.
    spark.read.parquet(f"{store.root}/events/{changes[0]}").write.parquet(f"{store.root}/events/c-00000099-lost")
    assert table(store) == rows
    # Many change sets become a base; rows and readers of what was current stay.
    monkeypatch.setattr("wayfare.plans.store.MOST_CHANGES", 3)
    monkeypatch.setattr("wayfare.plans.store.RETAIN_S", 3600)
    last = store.read("events")
    ingest.upsert_events(store, events(spark, event("7", title="folded")), NOW)
    assert len(store.version("events")) == 1 and table(store)["7"].title == "folded" and len(table(store)) == 43
    assert last.filter("external_id = '7'").first().title == "new 2" and early.count() == 40


def test_filters_reach_the_base_below_changes(spark, store):
    store.replace("events", store.read("events"))
    ingest.upsert_events(store, events(spark, event("a"), event("b", start="2027-01-01T00:00:00-05:00")), NOW)
    found = store.read("events").filter("start_at > timestamp'2026-12-01'")
    assert [r.external_id for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(start_at" in plan
