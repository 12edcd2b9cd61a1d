"""Near copies against all pairs, and the pipeline's stage on planted ones."""

import os
import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from tests_llm_helpers import prose

from wayfare.llm import nearcopies


def by_hand(rows):
    """Kept doc_ids: the least of each component of links by the definition."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower()) or (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == c) for c in set(root)}


def planted():
    """Prose with copies of which one to several words are replaced, far and near, a chain, equal and blank texts."""
    rng = random.Random(3)
    rows = []
    for g in range(30):
        words = prose(500 + g, rng.randint(100, 250)).split()
        rows.append((100 * g, " ".join(words)))
        for k in range(1, 5):
            changed = list(words)
            for at in rng.sample(range(len(words)), k * k):
                changed[at] = f"new{k}x{at}"
            rows.append((100 * g + k, " ".join(changed)))
    chain = prose(999, 200).split()
    rows += [(9000 + k, " ".join(chain[6 * k :] + [f"tail{k}x{i}" for i in range(6 * k)])) for k in range(6)]
    return [*rows, (1, rows[0][1]), (9100, None), (9101, ""), (9102, " \n"), (9103, "one two"), (9104, "One, two!")]


def test_the_stage_drops_planted_near_copies(spark, make):
    rows = planted()
    docs = make([(i, t, "en", "a") for i, t in rows])
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == by_hand(rows)
    assert not {100 * g + 1 for g in range(30)} & set(kept)


def test_components_in_chunks(spark, make, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK_BYTES", 2000)
    rows = planted()
    docs = make([(i, t, "en", "a") for i, t in rows])
    got = nearcopies.without_near_copies(docs)
    assert {r.doc_id for r in got.select("doc_id").collect()} == by_hand(rows) and got.columns == docs.columns


def test_all_that_is_compared_comes_out_of_the_gray_index(monkeypatch):
    texts = [(t or "").encode() for _, t in planted()]
    found = nearcopies.verified(texts)
    assert len(set(found.tolist())) == len(by_hand(planted())) < len(texts) - 40
    monkeypatch.setattr(nearcopies.GrayIndex, "links", lambda self, *_, **__: iter(()))
    assert (nearcopies.verified(texts) == np.arange(len(texts))).all()


def test_groups_are_whole_whichever_is_searched_first(monkeypatch):
    monkeypatch.setattr(nearcopies, "FIRST_BLOCK", 1)
    monkeypatch.setattr(nearcopies, "PAIRS", 1)
    rows = [(i, t) for i, t in planted() if i != 1]
    found = nearcopies.verified([(t or "").encode() for _, t in rows])
    assert len(set(found.tolist())) == len(by_hand(rows))


def test_short_texts_link_as_long_ones_do():
    rng = random.Random(5)
    for _ in range(300):
        words = [f"w{rng.random()}" for _ in range(9)]
        assert nearcopies.verified([" ".join(words[:8]).encode(), " ".join(words).encode()]).tolist() == [0, 0]


def test_words_are_held_of_a_piece_at_a_time(monkeypatch):
    sizes, real = [], nearcopies.shingles
    monkeypatch.setattr(nearcopies, "shingles", lambda texts: sizes.append(sum(map(len, texts))) or real(texts))
    texts = [prose(i, 400).encode() for i in range(3000)]
    sets = nearcopies.shingle_sets([*texts, b"", texts[0]])
    assert len(sets) == 3002 and (sets[0] == sets[-1]).all() and len(sizes) > 3 and max(sizes) <= nearcopies.PIECE_BYTES
    assert [len(s) for s in nearcopies.shingle_sets([])] == []


def test_rows_of_one_doc_id_do_not_affect_each_other(make):
    a, b = prose(1, 150), prose(2, 150)
    got = nearcopies.without_near_copies(make([(1, a, "en", "a"), (1, b, "en", "a"), (2, a + " changed", "en", "b"), (1, a, "en", "a"), (None, b, None, None), (None, prose(3, 90), None, None)]))
    assert sorted((r.doc_id or 0, r.text[:20]) for r in got.collect()) == sorted([(1, a[:20]), (1, b[:20]), (0, prose(3, 90)[:20])])
    assert nearcopies.without_near_copies(make([])).count() == 0


def test_a_chain_at_half_stays_apart(spark, make):
    words = prose(77, 9000, "abcdefghijklmnopqrstuvwxyz").split()
    # Each text shares half of its shingles with the next: bands alone would join them all.
    chain = [" ".join(f"{w}{i}" for i, w in enumerate(words[60 * k : 60 * k + 180], 60 * k)) for k in range(140)]
    keys, minima = nearcopies.bands(*nearcopies.shingles([t.encode() for t in chain]))
    shared = sum(bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(keys, keys[1:]))
    assert shared > 50
    nodes = spark.createDataFrame([(i, [int(k) for k in row.astype("int64")], bytes(m.tobytes())) for i, (row, m) in enumerate(zip(keys, minima))], "fp long, keys array<long>, minima binary")
    assert nearcopies.coarse_links(nodes).count() <= 3
    docs = make([(i, t, "en", "a") for i, t in enumerate(chain)])
    assert nearcopies.without_near_copies(docs).count() == len(chain)


def test_recall_on_the_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(path)
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    sets, holders = {}, {}
    for i, text in texts.items():
        w = re.findall(r"[^\W_]+", (text or "").lower()) or (text or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    both = Counter(p for ids in holders.values() if len(ids) > 1 for p in combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    kept = {r.doc_id for r in nearcopies.without_near_copies(docs).select("doc_id").collect()}
    dropped, wanted = set(texts) - kept, {i for i in texts if find(i) != i}
    assert wanted and not dropped - wanted and len(dropped & wanted) >= 0.99 * len(wanted)
