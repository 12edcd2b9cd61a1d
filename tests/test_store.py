"""The store: pointers, retention, cells, clustering and schema steps; suppression without pairs."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.functions import geo
from wayfare.functions.text import json_class
from wayfare.operators import dedup
from wayfare.operators import filters as predicates
from wayfare.plans import serving
from wayfare.plans import store as stores
from wayfare.plans.store import Layout, Store, StoreError

SMALL = {"t": Layout("k string, v long", ("k",)), "cells": Layout("k string, v long", ("k",), cells=True)}


@pytest.fixture
def small(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", SMALL)


def put(store, text, *parts):
    fs, path = store._path(*parts)
    stream = fs.create(path, True)
    stream.write(text.encode())
    stream.close()


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def content(store, table="t"):
    return dict(map(tuple, store.read(table).collect()))


def test_a_pointer_that_breaks_off_changes_nothing(spark, small):
    small.replace("t", rows(spark, a=1))
    small.change("t", rows(spark, b=2))
    number = small.pointer("t").number
    put(small, '{"folders": [["v-0', "t", f"_CURRENT-{number + 1:08d}")
    assert content(small) == {"a": 1, "b": 2}
    small.change("t", rows(spark, a=5))
    assert content(small) == {"a": 5, "b": 2} and small.pointer("t").number == number + 2


def test_pointers_are_made_once(spark, small):
    from py4j.protocol import Py4JJavaError

    small.replace("t", rows(spark, a=1))
    fs, path = small._path("t", f"_CURRENT-{small.pointer('t').number:08d}")
    with pytest.raises(Py4JJavaError, match="FileAlreadyExists"):
        fs.create(path, False)


def test_folders_without_a_pointer_raise(spark, small):
    small.replace("t", rows(spark, a=1))
    for name in small._listed("t"):
        if name.startswith("_CURRENT"):
            fs, path = small._path("t", name)
            fs.delete(path, False)
    for step in (lambda: small.read("t"), lambda: small.change("t", rows(spark, b=1)), small.migrate):
        with pytest.raises(StoreError, match="no pointer"):
            step()


def test_readers_two_writes_behind_keep_their_files(spark, small, monkeypatch):
    small.replace("t", rows(spark, a=1))
    first = small.read("t")
    old = small.version("t")[0]
    # However old the folder is: what counts is when it was superseded.
    fs, path = small._path("t", old)
    fs.setTimes(path, 1000, -1)
    small.replace("t", rows(spark, a=2))
    small.replace("t", rows(spark, a=3))
    small.replace("t", rows(spark, a=4))
    assert first.first().v == 1
    monkeypatch.setattr(stores, "RETAIN_S", -1)
    second = small.read("t")
    small.replace("t", rows(spark, a=5))
    assert old not in small._listed("t") and second.first().v == 4 and content(small) == {"a": 5}
    assert len([n for n in small._listed("t") if n.startswith("_CURRENT-")]) == 2


def test_folders_that_no_pointer_names_go_when_they_are_old(spark, small):
    small.replace("t", rows(spark, a=1))
    for name, age in (("c=00000007-young", 60), ("c=00000007-old", 10 * 3600)):
        put(small, "x", "t", name, "part")
        fs, path = small._path("t", name)
        fs.setTimes(path, int((datetime.now().timestamp() - age) * 1000), -1)
    small.change("t", rows(spark, b=2))
    assert "c=00000007-young" in small._listed("t") and "c=00000007-old" not in small._listed("t")


def scans(plan):
    """The parquet scans of an executed plan."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from scans(plan.executedPlan())
    elif "QueryStage" in name:
        yield from scans(plan.plan())
    elif name.startswith("Scan parquet"):
        yield plan
    else:
        for i in range(plan.children().size()):
            yield from scans(plan.children().apply(i))


def read_counts(frame, metric):
    frame.collect()
    return [s.metrics().apply(metric).value() for s in scans(frame._jdf.queryExecution().executedPlan())]


def test_a_merge_reads_the_cells_of_its_keys(spark, small, monkeypatch):
    monkeypatch.setattr(stores, "CELL_BYTES", 200)
    many = spark.range(2000).selectExpr("concat('k', id) k", "id v")
    small.replace("cells", many)
    small.replace("cells", many)
    cells = small.pointer("cells").folders[0].cells
    assert cells >= 16
    small.change("cells", rows(spark, k7=-7, new=1))
    found = small.read("cells", within=spark.createDataFrame([("k7",), ("k8",), ("none",)], "k string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted(map(tuple, found.collect())) == [("k7", -7), ("k8", 8)]
    files = max(read_counts(small.read("cells"), "numFiles"))
    assert files >= cells and max(read_counts(found, "numFiles")) <= 6


def test_schema_steps_are_followed_in_old_folders(spark, tmp_path):
    first = Store(spark, f"file://{tmp_path}/s", {"t": Layout("k string, city_id long", ("k",))})
    first.replace("t", spark.createDataFrame([("a", 1), ("b", 2)], "k string, city_id long"))
    steps = (("rename", "city_id", "region_id"), ("add", "url string"))
    second = Store(spark, first.root, {"t": Layout("k string, url string, region_id long", ("k",), steps=steps)})
    assert sorted(map(tuple, second.read("t").collect())) == [("a", None, 1), ("b", None, 2)]
    second.change("t", spark.createDataFrame([("b", "u", 3), ("c", "w", 4)], "k string, url string, region_id long"))
    # A later step takes the old name for another column.
    steps = (*steps, ("rename", "url", "city_id"))
    third = Store(spark, first.root, {"t": Layout("k string, city_id string, region_id long", ("k",), steps=steps)})
    assert sorted(map(tuple, third.read("t").select("k", "city_id", "region_id").collect())) == [("a", None, 1), ("b", "u", 3), ("c", "w", 4)]
    third.change("t", spark.createDataFrame([("a", "x", 9)], "k string, city_id string, region_id long"))
    third.replace("t", third.read("t"))
    assert sorted(map(tuple, third.read("t").filter("region_id > 3").collect())) == [("a", "x", 9), ("c", "w", 4)]


# ---- Layout of events ----

def many_files(spark, store, events):
    """Write events in many files, which stand for many row groups."""
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    store.replace("events", events)
    for k, v in before.items():
        spark.conf.set(k, v)


NOW = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def located(spark, tmp_path_factory):
    """Events over two years, of all durations and places, in small files."""
    rng = random.Random(5)
    names = schemas.column_names(schemas.EVENTS)
    base = []
    for i in range(3000):
        start = NOW + timedelta(minutes=rng.randrange(2 * 365 * 1440))
        hours = rng.choice([None, 0, 1, 5, 20, 100, 700, 8000, 20000])
        point = None if i % 9 == 0 else (rng.uniform(-180, 180), rng.uniform(-90, 90))
        row = {"id": i, "source_id": "s", "external_id": str(i), "title": "t", "category": "c", "state": "scheduled", "start_at": start, "end_at": None if hours is None else start + timedelta(hours=hours), "location": point}
        base.append(tuple(row.get(n) for n in names))
    store = Store(spark, f"file://{tmp_path_factory.mktemp('located')}/s")
    many_files(spark, store, spark.createDataFrame(base, schemas.EVENTS))
    return store.read("events", hidden=True)


def test_overlap_has_both_bounds_in_the_scan(located):
    begin, end = (F.lit(NOW + timedelta(days=d)).cast("timestamp") for d in (700, 703))
    start, stop = F.col("start_at"), F.col("end_at")
    plain = located.filter(predicates.overlaps(start, stop, begin, end)).select("id")
    classed = located.filter(predicates.overlaps_by_class(start, stop, F.col("_class"), begin, end)).select("id")
    assert sorted(r.id for r in classed.collect()) == sorted(r.id for r in plain.collect()) != []
    (scan,) = scans(classed._jdf.queryExecution().executedPlan())
    pushed = scan.metadata().apply("PushedFilters").replace(" ", "")
    assert "LessThanOrEqual(start_at" in pushed and "And(EqualTo(_class,0),GreaterThanOrEqual(start_at" in pushed
    assert read_counts(classed, "numOutputRows")[0] < 0.7 * read_counts(plain, "numOutputRows")[0]
    for sides in ((begin, None), (None, end), (None, None)):
        assert located.filter(predicates.overlaps_by_class(start, stop, F.col("_class"), *sides)).count() == located.filter(predicates.overlaps(start, stop, *sides)).count()


def test_places_are_found_by_cells(located):
    everything = {r.id: r.location for r in located.filter("location is not null").collect()}
    import math

    def metres(a, b):
        lat1, lat2 = math.radians(a[1]), math.radians(b[1])
        half = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(half))

    for lng, lat in ((-77.0, -12.0), (179.95, 3.0), (20.0, 89.5)):
        near = {i for i, p in everything.items() if metres((lng, lat), p) <= 1_500_000}
        assert {r.id for r in serving.events_near(located, lng, lat, 1_500_000).collect()} == near
        first = sorted(everything, key=lambda i: (metres((lng, lat), everything[i]), i))[:7]
        assert [r.id for r in serving.nearest_events(located, lng, lat, 7).collect()] == first
    assert serving.nearest_events(located, 0.0, 0.0, 5000).count() == len(everything)


def test_places_of_one_month_skip_files(spark, tmp_path):
    rng = random.Random(6)
    names = schemas.column_names(schemas.EVENTS)
    row = lambda i: {"id": i, "source_id": "s", "external_id": str(i), "start_at": NOW, "location": (rng.uniform(-180, 180), rng.uniform(-90, 90))}
    store = Store(spark, f"file://{tmp_path}/s")
    many_files(spark, store, spark.createDataFrame([tuple(row(i).get(n) for n in names) for i in range(2000)], schemas.EVENTS))
    events = store.read("events", hidden=True)
    assert read_counts(events.select("id"), "numOutputRows") == [2000]
    assert 0 < read_counts(serving.events_near(events, -77.0, -12.0, 500_000).select("id"), "numOutputRows")[0] < 500


def test_ranges_hold_the_box_and_little_else():
    rng = random.Random(3)
    number = lambda x, y: sum(((x >> i & 1) | (y >> i & 1) << 1) << 2 * i for i in range(16))
    for _ in range(50):
        west, south = rng.uniform(-180, 170), rng.uniform(-90, 80)
        east, north = west + rng.uniform(0, 10), south + rng.uniform(0, 10)
        ranges = geo.place_ranges(west, south, east, north)
        assert 1 <= len(ranges) <= 16 and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        for _ in range(20):
            x, y = geo._numbers(rng.uniform(west, east), -180, 180), geo._numbers(rng.uniform(south, north), -90, 90)
            assert any(a <= number(x, y) <= b for a, b in ranges)


# ---- Suppression ----


def test_told_before_against_all_pairs(spark):
    rng = random.Random(8)
    day = timedelta(days=1)
    make = lambda n, first: [(first + i, rng.choice("abc"), f"x{first + i}", rng.choice(["k1", "k2", "k3", None]), NOW + rng.choice([0, 14, 28]) * day + timedelta(hours=rng.choice([0, 0, 1, -1, 30, 336]), milliseconds=rng.choice([0, 0, 1]))) for i in range(n)]
    schema = "id long, source_id string, external_id string, dedup_key string, start_at timestamp"
    for n, m in ((60, 40), (7, 30), (0, 5)):
        stored, incoming = make(n, 0), make(m, 1000)
        got = {r.external_id: r.told.id if r.told else None for r in dedup.told_before(spark.createDataFrame(incoming, schema), spark.createDataFrame(stored, schema)).collect()}
        want = {x: min((i for i, s2, _, k2, t2 in stored if k2 == k and k and s2 != s and abs(t2 - t) <= 14 * day), default=None) for _, s, x, k, t in incoming}
        assert got == want


def test_a_headline_a_hundred_thousand_times(spark):
    moment = "timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 5000)"
    stored = spark.range(100_000).selectExpr("id", "concat('s', id % 2) source_id", "cast(id as string) external_id", "'obras' dedup_key", f"{moment} start_at")
    incoming = spark.range(100_000).selectExpr("id + 1000000 id", "concat('s', id % 3) source_id", "cast(id as string) external_id", "'obras' dedup_key", f"{moment} start_at")
    told = dedup.told_before(incoming, stored)
    assert {tuple(r) for r in told.groupBy("source_id").agg(F.min("told.id"), F.max("told.id"), F.count("told")).collect()} == {("s0", 1, 1, 33334), ("s1", 0, 0, 33333), ("s2", 0, 0, 33333)}


def test_tasks_of_the_suppression_grow_with_the_rows(spark, monkeypatch):
    rows = lambda first: spark.range(3000).selectExpr(f"id + {first} id", "concat('s', id % 3) source_id", "cast(id as string) external_id", "concat('k', id % 50) dedup_key", "timestamp'2026-01-01' + make_dt_interval(0, cast(id as int)) start_at")
    told = lambda: dedup.told_before(rows(10_000).withColumn("source_id", F.lit("s1")), rows(0))
    want = sorted((r.external_id, r.told.id if r.told else -1) for r in told().collect())
    monkeypatch.setattr(dedup, "TASK_ROWS", 1000)
    assert any("stretch" in line and ", 12)" in line for line in told()._jdf.queryExecution().sparkPlan().toString().split("\n"))
    assert sorted((r.external_id, r.told.id if r.told else -1) for r in told().collect()) == want and len({w for _, w in want}) > 10


# ---- Trees and bodies ----


def test_a_region_tree_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"r{i}") for i in range(30)] + [(100, 101, "loop"), (101, 100, "pool")]
    paths = {r.id: r.path for r in serving.region_tree(spark.createDataFrame(chain, "id long, parent_id long, slug string")).collect()}
    assert set(paths) == set(range(30)) and paths[29] == [f"r{i}" for i in range(30)]


def test_classes_of_bodies(spark):
    bodies = ['[{"id": 1}]', "[]", '{"id": 1}', '[{"nr": 1}]', "<html>", "", "3", "null", None, '[{"id": null}]']
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r.c for r in frame.select(json_class(F.col("body"), "array", "id").alias("c")).collect()]
    assert got == ["ok", "ok", "wrong-shape", "wrong-shape", "not-json", "not-json", "wrong-shape", "wrong-shape", None, "wrong-shape"]
    assert frame.filter(json_class(F.col("body"), "object", "id") == "ok").count() == 1
