"""Packing: every id once, sequences gapless and full, patterns against the bound."""

import random
import zlib

import numpy as np
import pytest
from tests_llm_helpers import prose

from wayfare.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
TRICKY = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't we'll I'M", "ΟΔΟΣ Σ", "é é à", "x y​z", "\x1c\x1d a\x85b", "日本語テキスト", "…--!!"]


def check(got, rows, size=packing.SIZE):
    """The contract, by the library's own ids; returns the share of padding."""
    import struct

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc_id, texts in ids.items():
        want = sum(len(t) for t in texts)
        assert sum(p.length for p in by_doc[doc_id]) == want
        for p in by_doc[doc_id]:
            assert any(len(t) == p.doc_tokens and zlib.crc32(struct.pack(f"<{p.length}I", *t[p.start : p.start + p.length])) == p.ids_crc32 for t in texts)
        if len(texts) == 1:
            place = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert p.start == place
                place += p.length
    padding = 0
    for pieces in by_sequence.values():
        place = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == place and p.length > 0
            place += p.length
        assert place <= size
        padding += 0 if place & (place - 1) == 0 else size - place
    assert set(by_sequence) == set(range(len(by_sequence)))
    return padding / sum(p.length for p in got)


def test_pieces_of_documents(make, edge_rows):
    rng = random.Random(1)
    rows = [(100 + i, prose(i, rng.randint(1, 900)), "en", "a") for i in range(150)] + [(400 + i, t, None, None) for i, t in enumerate(TRICKY)] + edge_rows
    assert check(packing.packed(make(rows), PATH).collect(), rows) < 0.01
    assert packing.packed(make([]), PATH).count() == 0


def test_rests_that_go_with_nothing_are_cut(make):
    rows = [(i, "word " * 1300, "en", "a") for i in range(90)] + [(1000 + i, None, "en", "a") for i in range(5)]
    got = packing.packed(make(rows), PATH).collect()
    assert check(got, rows) == 0 and len({p.sequence_id for p in got}) <= 90 * 1301 // 2048 + 12


def test_cells_and_small_caches(make, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    rows = [(i, prose(i % 40, 30 + 9 * (i % 40)), "en", "a") for i in range(120)]
    assert check(packing.packed(make(rows), PATH, size=256, grain=1).collect(), rows, 256) < 0.02


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_and_linear_program(seed):
    rng = np.random.default_rng(seed)
    room = 40
    classes = np.sort(rng.choice(np.arange(2, 41), 8, replace=False))
    prices = rng.random(8) * classes
    prices[0] = -1.0
    value, (pattern, *others) = packing.priced(prices, classes, room, 3)
    assert len(others) == 3 and all(p @ classes <= room and p.any() for p in others)
    best = np.zeros(room + 1)
    for c in range(1, room + 1):
        best[c] = max([best[c - 1], *(best[c - s] + p for s, p in zip(classes, prices) if s <= c)])
    assert abs(value - best[room]) < 1e-9 and pattern @ classes <= room and abs(pattern @ prices - value) < 1e-9
    demand = rng.integers(1, 200, 8).astype(float)
    basis, used, cut = packing.linear_program(classes, demand, room)
    assert np.allclose(used @ basis + cut, demand) and (used >= 0).all() and (basis @ classes <= room).all()
    value = used.sum() + cut @ classes / (room * packing.LEAST_FILL)
    assert classes @ demand / room - 1e-6 <= value <= classes @ demand / (room * packing.LEAST_FILL) + 1e-6


def test_linear_program_of_known_value():
    # 30 with 10, 20 with 20: every sequence is full, and nothing is cut.
    basis, used, cut = packing.linear_program(np.array([10, 20, 30]), np.array([50.0, 40.0, 50.0]), 40)
    assert abs(used.sum() - 70) < 0.2 and cut.sum() < 1
    # 25 goes with nothing: all are cut, and so is what 15 is too few for.
    basis, used, cut = packing.linear_program(np.array([15, 25]), np.array([10.0, 100.0]), 40)
    assert abs(used.sum() - 10) < 0.2 and abs(cut[1] - 90) < 0.2


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_no_item_twice(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(c): int(n * 20 / c) + 1 for c, n in zip(rng.choice(np.arange(1, 512), 300, replace=False), rng.integers(1, 900, 300))}
    plan = packing.planned(histogram, 512)
    used = {}
    for pattern, copies in plan.patterns:
        assert packing.LEAST_FILL * 512 <= sum(c * k for c, k in pattern.items()) <= 512
        for c, k in pattern.items():
            used[c] = used.get(c, 0) + k * copies
    assert used == {c: n for c, n in plan.placed.items() if n} and all(n <= histogram[c] for c, n in used.items())
    items = sum(c * n for c, n in histogram.items())
    assert sum(c * n for c, n in used.items()) > 0.9 * items
    for rows in plan.slots.values():
        assert [r[0] for r in rows] == sorted({r[0] for r in rows})


def test_powers_of_two():
    assert packing.powers(4096, 4096 + 1500) == [(4096, 5120), (5120, 5376), (5376, 5504), (5504, 5568), (5568, 5584), (5584, 5592), (5592, 5596)]
    assert packing.powers(7, 7) == [] and packing.sequence_at(5376, 2048, packing.powers(4096, 5596)) == (4, 5376, 5504)


def test_capitals_and_marks_cost_no_new_encoding(monkeypatch):
    import pyarrow as pa

    seen, encoded = [], packing.Ids._encoded
    monkeypatch.setattr(packing.Ids, "_encoded", lambda self, texts: seen.extend(texts) or encoded(self, texts))
    packing.Ids(PATH).of(pa.array(["erentiha Erentiha, (ERENTIHA) erentiha### ERENTIHA.", "\"erentiha\" élabich Élabich."]))
    text = b" ".join(seen).decode().lower()
    assert text.count("erentiha") == 1 and text.count("élabich") == 1


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_words_have_the_library_s_ids(seed):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(seed)
    # Letters that change in number or compose when folded, marks, special strings in either case.
    parts = [*"aAbZzéÉßÿŸİıKſΣςÀ×÷ªµ09.,'’!<>|`^_-&#", "\u0301", "\u0331", "\u0338", "\u0345", "\u200b", "\u00a0", "\u0085", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'T", "日", "가", "ǅ", "ﬁ", "\U0001f600", "don't", "THE", " ", " ", "\n"]
    texts = [None, "", " ", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)), *(prose(i, 40).title() + "." for i in range(20))]
    flat, ends = packing.Ids(PATH).of(pa.array(texts))
    library, begin = Tokenizer.from_file(PATH), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert flat[begin:end].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        begin = end


def test_ids_of_documents_that_are_not_cut_stay(make, monkeypatch):
    found, near = [], packing._near_cuts
    monkeypatch.setattr(packing, "_near_cuts", lambda *a: found.append(near(*a)) or found[-1])
    # Two of 1,024 ids fill a sequence, 1,301 go with nothing.
    rows = [(i, "word " * 1023, "en", "a") for i in range(40)] + [(100 + i, "word " * 1300, "en", "a") for i in range(20)]
    assert check(packing.packed(make(rows), PATH).collect(), rows) == 0
    assert sorted(r.doc_id for r in found[0].select("doc_id").collect()) == list(range(100, 120))
