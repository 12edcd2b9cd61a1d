"""Operators that judge each row by itself: licenses, quality, tokens, languages."""

import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_helpers import ordered, prose, rows_of

from wayfare.llm import language, licenses, quality
from wayfare.llm.license_texts import TEMPLATES
from wayfare.llm.tokencount import piece_counts, token_counts

# ---- op9 ----

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TRICKY = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't we'll I'M", "ΟΔΟΣ Σ", "İstanbul", "é é à́", " x y​z", "3.14 x10 ½", "\x1c\x1d a\x85b", "x" * 300, "日本語テキスト", "́ combining", "…--!!"]


def test_token_counts_are_the_librarys(make, edge_rows, tokenizer):
    rows = edge_rows + [(100 + i, t, None, None) for i, t in enumerate(TRICKY)]
    got = rows_of(token_counts(make(rows), PATH, 50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == ordered([(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 50) for i, t, *_ in rows])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=30, max_size=60))
def test_token_counts_of_any_text(make, tokenizer, texts):
    rows = [(i, t.replace("\x00", ""), None, None) for i, t in enumerate(texts)]
    got = rows_of(token_counts(make(rows), PATH), "doc_id", "n_tokens")
    assert got == [(i, len(tokenizer.encode(t, add_special_tokens=False))) for i, t, *_ in rows]


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_token_counts_by_exchange_are_the_librarys(make, edge_rows, tokenizer, hot):
    rows = edge_rows + [(100 + i, t, None, None) for i, t in enumerate(TRICKY)]
    got = rows_of(token_counts(make(rows), PATH, hot_entries=hot), "doc_id", "n_tokens", "n_pretokens")
    assert got == ordered([(i, len(tokenizer.encode(t or "", add_special_tokens=False)), len((t or "").encode().split())) for i, t, *_ in rows])


def test_pieces_are_counted_once_per_distinct_pretoken(make, edge_rows):
    counted = piece_counts(make(edge_rows), PATH)
    words = [w for _, t, *_ in edge_rows for w in (t or "").encode().split()]
    assert counted.count() == counted.select("name").distinct().count() == len(set(words))
    assert counted.agg({"times": "sum"}).first()[0] == len(words)


def test_token_counts_of_nothing(make):
    assert token_counts(make([]), PATH).count() == 0


# ---- op2 ----


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(make, edge_rows):
    rng = random.Random(5)
    rows = [r for r in edge_rows if len(r[1] or "") < 5000] + [(200 + i, " ".join(rng.choice(["a", "b", "ñ", "c\n", "c\nd", "$#", " "]) for _ in range(rng.randint(0, 60))), None, None) for i in range(40)]
    got = rows_of(quality.quality(make(rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(s := base_by_hand(t)), s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t, *_ in rows]
    assert got == ordered(want)


def test_quality_ratios_are_zstandards(make):
    text = prose(9, 2000)
    row = quality.quality(make([(1, text, None, None)])).first()
    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    raw = text.encode()
    chunks = [len(c) / len(press.compress(c)) for c in (raw[i : i + 4096] for i in range(0, len(raw), 4096))]
    assert row.zstd_ratio == len(raw) / len(press.compress(raw)) and row.chunk_ratio_min == min(chunks) and row.chunk_ratio_max == max(chunks)


def test_quality_verdicts(make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    # Every window of three differs, yet few words make it up: only compression tells.
    dull = " ".join(a + "-" + "x" * 60 + b for a in words for b in words)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(400))
    half = prose(8, 900) + " " + noise
    rows = [(1, prose(7, 900), None, None), (2, dull, None, None), (3, noise, None, None), (4, "short " * 60, None, None), (5, half, None, None), (6, None, None, None)]
    got = {r.doc_id: (r.verdict, r.kept) for r in quality.quality(make(rows)).collect()}
    assert got == {1: ("kept", True), 2: ("repetitive", False), 3: ("incompressible", False), 4: ("base", False), 5: got[5], 6: ("base", False)}
    assert got[5][0] in ("incompressible", "chunks") and quality.quality(make([])).count() == 0


# ---- op1 ----


def test_license_notices_and_spans(make):
    text = "Some prose. LICENSED under the apache license, version 2.0!\nMore — ñ — words. Released under the MIT License. End"
    found = licenses.license_matches(make([(1, text, None, None), (2, prose(1, 500), None, None), (3, None, None, None), (4, "", None, None), (None, text, None, None), (1, text, None, None)]))
    assert found.filter("doc_id is null").count() == 2 and found.filter("doc_id = 1").count() == 4 and found.count() == 6
    rows = {r.license: r for r in found.filter("doc_id = 1").collect()}
    assert set(rows) == {"Apache-2.0", "MIT"}
    assert text[rows["Apache-2.0"].start : rows["Apache-2.0"].end] == "LICENSED under the apache license, version 2.0" and text[rows["MIT"].start : rows["MIT"].end] == "Released under the MIT License"
    assert rows["MIT"].coverage == 1.0 and rows["MIT"].template_words == 5


@pytest.mark.parametrize(("drop", "found"), [(9, True), (3, False)])
def test_license_alignment_tolerates_changes(make, drop, found):
    words = licenses.WORD.findall(TEMPLATES["MIT"][1])
    changed = [w if i % drop else f"other{i}" for i, w in enumerate(words)]
    got = licenses.license_matches(make([(1, "Intro text here. " + " ".join(changed) + " and then more", None, None)])).filter("license = 'MIT' and template = 1").collect()
    assert bool(got) == found
    if found:
        assert got[0].matched_words == sum(bool(i % drop) for i in range(len(words)))


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_banded_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        t = [rng.randint(0, 6) for _ in range(rng.randint(1, 12))]
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = [rng.randint(0, 6)] * rng.randint(0, 1)
        w = w or [99]
        matched, first, last = licenses.align(np.array(t), np.array(w), 0, 14)
        assert matched == lcs(t, w)
        assert not matched or lcs(t, w[first : last + 1]) == matched


def test_license_inner_match_is_left_out(make):
    got = licenses.license_matches(make([(1, TEMPLATES["Apache-2.0"][1], None, None)])).collect()
    assert [(r.license, r.template) for r in got] == [("Apache-2.0", 1)]
    assert licenses.license_matches(make([])).count() == 0 and licenses.license_matches(make([(1, "x y z", None, None)]), {}).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    some = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    shared = some(5)
    for _ in range(50):
        a, b = (np.concatenate([some(rng.integers(0, 9)), shared, some(rng.integers(0, 9))]) for _ in range(2))
        prints = [set(g[licenses.winnowed(g)].tolist()) for g in (licenses.gram_hashes(a), licenses.gram_hashes(b))]
        assert prints[0] & prints[1]


# ---- op7 ----

LANGUAGES = {"en": "the of and to in that was with for this from", "de": "der die und nicht ein sie auch für über schön", "fr": "le la et les des été que pour dans où"}


def corpus(n=60):
    rng = random.Random(2)
    out = []
    for k, (lang, words) in enumerate(LANGUAGES.items()):
        stems = words.split()
        for i in range(n):
            out.append((1000 * k + i, " ".join(rng.choice(stems) + rng.choice(["", "", "s", "en"]) for _ in range(80)), lang, "s"))
    return out


def test_language_held_out_accuracy(make):
    rows = corpus()
    got = {r.doc_id: r for r in language.language_digest(make(rows)).collect()}
    for i, _, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected


def test_language_edges_and_rejection(make, edge_rows):
    model = language.train(make(corpus()))
    rng = random.Random(4)
    gibberish = "".join(rng.choice("qxzjkvwy ") for _ in range(600))
    rows = [*edge_rows, (50, gibberish, None, None), (51, "1234 $$ 5", None, None), (52, LANGUAGES["de"].upper() + "!", None, None)]
    got = {r.doc_id: r for r in language.identify(make(rows), model).collect()}
    assert got[50].rejected and got[50].lang_pred in LANGUAGES
    for i in (3, 4, 5, 9, 51):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[52].lang_pred == "de" and language.identify(make(rows), model).count() == len(rows)
    kept = language.accepted(make(rows), model)
    ids = {r.doc_id for r in kept.collect()}
    assert 52 in ids and not ids & {3, 4, 5, 9, 50, 51} and kept.columns == make(rows).columns


def test_language_without_labels(make):
    rows = [(1, "some text", None, None), (2, None, "en", None)]
    assert {(r.lang_pred, r.rejected) for r in language.language_digest(make(rows)).collect()} == {("und", True)}
    assert language.language_digest(make([])).count() == 0
    assert language.accepted(make(rows), language.train(make(rows))).count() == 0


def test_language_model_is_a_distribution(make):
    """Over all characters after a context, interpolated probabilities sum to about one."""
    (model,) = language.train(make(corpus())).models()
    alphabet = sorted({c if c.isalpha() else " " for _, t, *_ in corpus() for c in t})
    for context in ("the", "und", "été"):
        points = np.array([ord(c) for a in alphabet for c in context + a], np.uint32)
        hashes = language.gram_hashes(points)
        at = np.arange(len(alphabet)) * (len(context) + 1) + len(context)
        logs = model.log_p([h[at] for h in hashes], [language.shifted(h)[at] for h in hashes[: language.ORDER]])
        sums = np.exp(logs.astype(np.float64)).sum(axis=0)
        # What is missing is the share of characters that the model hasn't seen.
        assert (sums < 1.0001).all() and (sums > 0.9).all()


def test_language_learns_from_no_more_than_the_bound(make):
    model = language.train(make(corpus()), rows=8, chars=50)
    assert model.languages == sorted(LANGUAGES) and len(model.models()[0].grams[language.ORDER][0]) <= 3 * 8 * 60


def test_language_of_repeated_texts_is_learned(make):
    rows = [r for r in corpus() if r[2] == "en"] + [(5000 + i, LANGUAGES["fr"] + f" texte {i % 3}", "fr", "s") for i in range(60_000)]
    model = language.train(make(rows))
    assert model.languages == ["en", "fr"]
    got = language.identify(make(rows), model).filter("doc_id >= 5000").groupBy("lang_pred").count().collect()
    assert [tuple(r) for r in got] == [("fr", 60_000)]


def test_language_labels_without_letters(make):
    rows = corpus() + [(9000 + i, t, "zz", "s") for i, t in enumerate(["", "123 456", None, "$$", " "] * 4)]
    model = language.train(make(rows))
    assert model.languages == sorted(LANGUAGES)
    got = {r.doc_id: r.lang_pred for r in language.language_digest(make(rows)).collect()}
    assert all(got[9000 + i] == "und" for i in range(20)) and got[3] == "en"


def test_one_language_and_one_text(make):
    rows = [(1, "only one text of one language", "en", "s"), (2, "12", "de", "s")]
    model = language.train(make(rows))
    assert model.languages == ["en"]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(make(rows), model).collect()}
    assert got == {1: ("en", False), 2: ("und", True)}


def test_languages_in_blocks_and_passes(make, monkeypatch):
    whole = language.train(make(corpus()))
    monkeypatch.setattr(language, "BLOCK_CELLS", 1)
    monkeypatch.setattr(language, "PASS_BYTES", 1)
    split = language.train(make(corpus()))
    assert len(whole.passes) == 1 and len(split.passes) == 3
    rows = make([*corpus(8), (7000, "x", None, None), (7001, None, None, None)])
    a, b = ({r.doc_id: r for r in language.identify(rows, m).collect()} for m in (whole, split))
    for i in a:
        assert a[i].lang_pred == b[i].lang_pred and a[i].rejected == b[i].rejected
        assert abs(a[i].score - b[i].score) < 1e-3 and abs(a[i].cross_entropy - b[i].cross_entropy) < 1e-5
    assert sorted(r.doc_id for r in language.accepted(rows, whole).collect()) == sorted(r.doc_id for r in language.accepted(rows, split).collect())


def plain_kneser_ney(texts, alphabet):
    """p(character after context), straight from the definition, on strings."""
    top = language.ORDER
    padded = ["\x01" * (top - 1) + re.sub(r"[^a-zà-ÿ]+", " ", t.lower()) for t in texts]
    seen = {n: {} for n in range(1, top + 1)}
    for t in padded:
        for i in range(top - 1, len(t)):
            for n in range(1, top + 1):
                g = t[i - n + 1 : i + 1]
                seen[n][g] = seen[n].get(g, 0) + 1
    count = {top: seen[top]}
    for n in range(1, top):
        count[n] = {g: len({h[0] for h in seen[n + 1] if h[1:] == g}) for g in seen[n]}

    def p(context, c, n=top):
        if n == 0:
            return 1 / alphabet
        context = context[len(context) - (n - 1) :] if n > 1 else ""
        once, twice = (sum(k == x for k in count[n].values()) for x in (1, 2))
        discount = min(max((once + 0.5) / (once + 2 * twice + 1), 0.1), 0.9)
        after = {g: k for g, k in count[n].items() if g[:-1] == context}
        mass = sum(after.values())
        if not mass:
            return p(context, c, n - 1)
        return max(after.get(context + c, 0) - discount, 0) / mass + min(len(after) * discount, mass) / mass * p(context, c, n - 1)

    return p


def test_probabilities_are_plain_kneser_neys(make):
    texts = ["the cat sat on the mat", "that cat ate the rat", "a hat that sat"]
    model = language.train(make([(i, t, "en", "s") for i, t in enumerate(texts)]))
    alphabet = len(set("".join(texts))) + 1
    p = plain_kneser_ney(texts, alphabet)
    for text in ("the cat", "tah", "zzz", "mat a", "rat the hat"):
        want = -sum(np.log(p(("\x01" * 3 + text)[i : i + 3], c)) for i, c in enumerate(text)) / len(text)
        length, nats = language.cross_entropies(model.models(), [text.encode()])
        assert length[0] == len(text) and abs(nats[0, 0] - want) < 1e-4


def test_no_task_ranks_all_hashes_of_a_language(spark):
    rows = spark.range(1000).selectExpr("'en' lang", "xxhash64(id) h")
    plan = language.least_hashes(rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(lang") < plan.rindex("WindowGroupLimit")
    assert sorted(r.place for r in language.least_hashes(rows, 7).collect()) == list(range(1, 8))
