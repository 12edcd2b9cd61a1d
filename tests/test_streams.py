"""Streams with offsets and keyed state, and the join of texts with patterns."""

import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.operators import patterns
from wayfare.plans import ingest
from wayfare.plans.store import Store
from wayfare.sources.paged import cursor, paged_posts, write_pages
from wayfare.streaming import state


def read_all(spark, root, after=""):
    query = paged_posts(spark, f"{root}/pages", after).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(r.id for r in spark.read.schema("id long").parquet(f"{root}/out").collect())


def test_a_paged_stream_goes_on_behind_its_cursor(spark, tmp_path):
    posts = spark.range(90).selectExpr("id", "concat('2026-01-', lpad(cast(1 + id div 10 as string), 2, '0'), 'T10:00:00') date", "'l' link", "'t' title", "null content", "id div 10 page")
    write_pages(posts.filter("page < 4"), "page", f"{tmp_path}/pages")
    assert read_all(spark, tmp_path) == list(range(40))
    assert read_all(spark, tmp_path) == list(range(40))
    write_pages(posts.filter("page >= 4"), "page", f"{tmp_path}/pages")
    assert read_all(spark, tmp_path) == list(range(90))
    again = tmp_path / "again"
    again.mkdir()
    (again / "pages").symlink_to(tmp_path / "pages")
    # Posts of one moment are told apart by their ids.
    assert read_all(spark, again, cursor("2026-01-03T10:00:00", 24)) == list(range(25, 90))


def test_state_of_a_stream_is_the_tables(spark, tmp_path):
    start = datetime(2026, 1, 1, tzinfo=UTC)
    rng = random.Random(2)
    runs = [(s, start + timedelta(hours=24 * d + i), None if rng.random() < 0.5 else f"error {d}") for d in range(8) for i, s in enumerate("ab")] + [("c", start, "only")]
    outcomes = [(s, at, e, e is None and at.day % 2 == 0, f'{{"n": {at.day}}}' if e is None and at.day % 2 == 0 else None) for s, at, e in runs]
    store = Store(spark, f"file://{tmp_path}/store")
    for s, at, error, has, value in outcomes:
        if error:
            ingest.record_failure(store, s, at, RuntimeError(error))
        else:
            ingest.record_success(store, s, at, {"n": at.day} if has else ingest.KEEP)
    got = {}

    def keep(batch, epoch):
        for r in batch.collect():
            got.setdefault(r.source_id, []).append(r)

    for part in (outcomes[:7], outcomes[3:12], outcomes[10:]):
        spark.createDataFrame(part, state.OUTCOME.replace("at timestamp", "at timestamp")).select("source_id", "at", "error", "has_cursor", "cursor").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        status = state.source_status(spark.readStream.schema(state.OUTCOME).parquet(f"{tmp_path}/in"))
        status.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    for row in store.read("ingest_state").collect():
        if row.source_id == "c":
            continue  # It came too late for the watermark of two days.
        last = [r for r in got[row.source_id] if not r.stale][-1]
        assert tuple(last[c] for c in ("cursor", "last_run_at", "last_success_at", "last_error_at", "last_error", "consecutive_failures")) == tuple(row[c] for c in ("cursor", "last_run_at", "last_success_at", "last_error_at", "last_error", "consecutive_failures"))


def test_a_silent_source_is_told_once(spark, tmp_path):
    start = datetime(2026, 1, 1, tzinfo=UTC)
    got = []
    for part in ([("a", start, None, False, None)], [("b", start + timedelta(days=9), None, False, None)], [("b", start + timedelta(days=10), None, False, None)]):
        spark.createDataFrame(part, state.OUTCOME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        status = state.source_status(spark.readStream.schema(state.OUTCOME).parquet(f"{tmp_path}/in"))
        status.writeStream.outputMode("update").foreachBatch(lambda b, e: got.extend((r.source_id, r.stale) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("a", False), ("a", True), ("b", False), ("b", False)]


@pytest.mark.parametrize(
    ("pattern", "found"),
    [("estadio nacional", ["estadio nacional"]), ("arena|coliseo?s grande", ["arena", "s grande"]), (r"a\.b(cdef|x)ghij+k", ["ghij"]), ("[abc]defg{2}h", ["def"]), ("(?i)abcd", [""]), (r"\bplaza\b", ["plaza"]), ("x(a|b)y|long part", ["x", "long part"])],
)
def test_literal_parts(pattern, found):
    assert [patterns.literal(a) for a in patterns.alternatives(pattern)] == found


def test_first_match_is_the_chain_of_cases(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(80)]
    shapes = (lambda w: w, lambda w: rf"\b{w}s?\b", lambda w: f"{w}|{rng.choice(words)} {rng.choice(words)}", lambda w: f"{w[:-1]}[{w[-1]}x] ?{rng.choice(words)}", lambda w: f"({w}|zz)+q?")
    table = [(i, rng.choice(shapes)(rng.choice(words))) for i in range(400)] + [(900, None), (901, "[xyz]{3}")]
    rng.shuffle(table)
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(300)] + [(1000, None), (1001, "xyz")]
    got = {r.id: r.place for r in patterns.first_match(spark.createDataFrame(texts, "id long, t string"), "t", spark.createDataFrame(table, "place long, pattern string")).collect()}
    want = {i: min((p for p, r in table if r is not None and re.search(r, t)), default=None) for i, t in texts if t is not None}
    assert got == {i: p for i, p in want.items() if p is not None} and len(got) > 100


def test_ten_thousand_patterns(spark):
    table = spark.range(10_000).selectExpr("id place", "concat('venue', lpad(cast(id as string), 5, '0'), '\\\\b') pattern")
    texts = spark.range(500).selectExpr("id", "concat('at venue', lpad(cast(id * 19 as string), 5, '0'), ' and venue', lpad(cast(id * 7 as string), 5, '0'), 'x') t")
    found = patterns.first_match(texts, "t", table)
    assert found.filter(F.col("place") != F.col("id") * 19).count() == 0 and found.count() == 500
    # No pattern is tried on every text.
    with pytest.raises(ValueError, match="literal part"):
        patterns.first_match(texts, "t", spark.range(300).selectExpr("id place", "'[a-z]' pattern"))


def test_first_match_never_broadcasts_texts(spark, tmp_path):
    path = str(tmp_path / "texts.parquet")
    spark.range(500).selectExpr("id", "concat('estadio ', id) t").write.parquet(path)
    found = patterns.first_match(spark.read.parquet(path), "t", spark.createDataFrame([(1, "estadio 1"), (2, "[a-z]"), (3, "estadio 2|plaza")], "place long, pattern string"))
    lines = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert len(scans) >= 3
    for i in scans:
        # From the scan up to the root: which joins it is under, and on which side.
        at, side = i, depth[i]
        for j in range(i, -1, -1):
            if depth[j] < side:
                if "BroadcastHashJoin" in lines[j] or "BroadcastNestedLoopJoin" in lines[j]:
                    left = at == j + 1
                    assert left == ("BuildRight" in lines[j]), lines[j]
                at, side = j, depth[j]
    assert found.count() == 500 and found.filter("place = 1").count() == 111
