"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

A template's fingerprints are the least hashes of ``WINDOW`` successive word
trigrams; an inverted index maps each to the templates and places that have it.
A text is winnowed the same way, so whatever shares GRAM + WINDOW - 1 words in a
row with a template shares a fingerprint with it. Hits that follow one another
in both text and template form chains; each chain is a candidate, and the
template is aligned with the words around it, in the band of diagonals that the
chain's hits span and so many more as words may be missing: words may be
changed, missing or added, also many in a row. What matches gives coverage and span. The
words that tell a licence from its kin must be there whatever the coverage: a
version, the name in a short notice, and no term that makes another licence of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.common import blocks
from wayfare.llm.license_texts import TEMPLATES

GRAM, WINDOW = 3, 3
#: Diagonals on either side of a chain's: at least so many, or as many as words of the template may be missing.
BAND = 4
#: Words added between two hits of a chain: at most so many times the template's words.
ADDED = 1.0
#: The least share of a template's words that a match has in order.
COVERAGE = 0.8
MEMO_ENTRIES = 500_000
#: Templates of so many words at most are short: all of their words but these identify the licence.
SHORT_WORDS = 20
FILLER = frozenset("a an the this that is are it of in into under to and or work software free licensed license licence released international".split())
#: Words that make another licence of a template without them; the second only within short ones.
OTHER_LICENSE = ("lesser", "affero", "noncommercial", "sharealike", "noderivatives", "noderivs")
OTHER_SHORT_LICENSE = ("nc", "sa", "nd", "commercial", "alike", "derivatives", "derivs")

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, license string, template int, coverage double, matched_words long, template_words long, first_word long, start long, end long"


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "replace"))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(words) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Where the last least hash of some window is. Windows may reach past the ends, so short texts have fingerprints too."""
    if not len(grams):
        return np.zeros(0, np.int64)
    pad = np.full(WINDOW - 1, ~np.uint64(0))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, grams, pad]), WINDOW)
    last_least = WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    places = np.unique(np.arange(len(windows)) + last_least - (WINDOW - 1))
    return places[(places >= 0) & (places < len(grams))]


def identity(words: Sequence[str]) -> tuple[list[int], list[list[int]], frozenset[int]]:
    """Hashes of the words that a match has in order, of the versions that it has in a row, and of the words that it hasn't."""
    words = [w.lower() for w in words]
    short = len(words) <= SHORT_WORDS
    versions = []
    for i, word in enumerate(words):
        end = i + 1
        while end < len(words) and words[end].isdigit():
            end += 1
        if word in ("version", "v") and end > i + 1:
            versions.append([word_hash(w) for w in words[i:end]])
    named = [word_hash(w) for w in words if w not in FILLER] if short else []
    return named, versions, frozenset(word_hash(w) for w in OTHER_LICENSE + OTHER_SHORT_LICENSE * short if w not in words)


def identified(span: Sequence[int], named: Sequence[int], versions: Sequence[Sequence[int]], others: frozenset[int]) -> bool:
    rest = iter(span)
    return (
        all(w in rest for w in named)
        and all(any(list(span[i : i + len(v)]) == v for i in range(len(span) - len(v) + 1)) for v in versions)
        and others.isdisjoint(span)
    )


class Index:
    """fingerprints: sorted; per fingerprint the (template, place) pairs."""

    def __init__(self, templates: Mapping[str, Sequence[str]]):
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        self.words = [np.array([word_hash(w) for w in WORD.findall(templates[name][i])], np.uint64) for name, i in self.names]
        self.sorted_words = [np.unique(w) for w in self.words]
        self.identity = [identity(WORD.findall(templates[name][i])) for name, i in self.names]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            grams = gram_hashes(words)
            chosen = winnowed(grams)
            for p in chosen.tolist():
                places[int(grams[p])].append((t, p))
        self.fingerprints = np.array(sorted(places), np.uint64)
        self.places = [places[f] for f in self.fingerprints.tolist()]

    def hits(self, grams: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in grams, template, place in template) of the chosen grams that the index has."""
        values = grams[chosen]
        at = np.minimum(np.searchsorted(self.fingerprints, values), len(self.fingerprints) - 1)
        for i in np.flatnonzero(self.fingerprints[at] == values).tolist():
            for t, p in self.places[at[i]]:
                yield int(chosen[i]), t, p


def align(template: np.ndarray, words: np.ndarray, begin: int, band: int) -> tuple[int, int, int]:
    """The most words of the template that words have in order within ``band`` of the diagonal at ``begin``; the first and last of them in words.

    Longest common subsequence in a band; of several the one that begins last,
    then ends first. One step for each of the template's words, over all
    diagonals at once.
    """
    width, least = 2 * band + 1, begin - band
    # A cell: words matched, where the first lies, and how far the last lies from the end; 0 without a match. Places count from the band's start.
    bits = int(len(template) + width).bit_length() + 1
    last, one = (1 << bits) - 1, 1 << 2 * bits
    best = np.zeros(width + 1, np.int64)
    places = np.arange(width)
    padded = np.concatenate([np.zeros(max(-least, 0), words.dtype), words[max(least, 0) : max(least + len(template) + width, 0)]])
    real = np.concatenate([np.zeros(max(-least, 0), bool), np.ones(len(padded) - max(-least, 0), bool)])
    room = len(template) + width - len(padded)
    padded, real = np.concatenate([padded, np.zeros(max(room, 0), words.dtype)]), np.concatenate([real, np.zeros(max(room, 0), bool)])
    for i, word in enumerate(template):
        same = (padded[i : i + width] == word) & real[i : i + width]
        diagonal = best[:-1]
        j = i + places
        taken = np.where(diagonal == 0, one | j << bits, ((diagonal >> bits) << bits) + one) | (last - j)
        best[:-1] = np.maximum.accumulate(np.maximum(best[1:], np.where(same, taken, diagonal)))
    top = int(best.max())
    if not top:
        return 0, 0, 0
    return top >> 2 * bits, (top >> bits & last) + least, last - (top & last) + least


def chains(hits: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``hits`` (place in text, place in a template of ``size`` words) that follow one another in both, as chains without common rows; long ones first.

    A chain gains a hit's worth by each hit and loses, by the share of the
    template's size, what text and template differ by between two.
    """
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    place, at = hits[:, 0], hits[:, 1]
    worth, before = np.ones(len(hits)), np.full(len(hits), -1)
    from_ = np.searchsorted(place, place - int((1 + ADDED) * size))
    upto = np.searchsorted(place, place)
    for i in range(len(hits)):
        a, b = from_[i], upto[i]
        step, along = place[i] - place[a:b], at[i] - at[a:b]
        gain = np.where((along > 0) & (step - along <= ADDED * size), worth[a:b] - np.abs(step - along) / (2 * size), 0)
        if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 0:
            worth[i] += gain[k]
            before[i] = a + k
    used = np.zeros(len(hits), bool)
    out = []
    for i in np.argsort(-worth, kind="stable").tolist():
        rows = []
        while i >= 0 and not used[i]:
            used[i] = True
            rows.append(i)
            i = int(before[i])
        if rows:
            out.append(hits[rows[::-1]])
    return out


def find(index: Index, words: np.ndarray, hits: Sequence[tuple[int, int, int]], coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word) of a text's matches; one within another that matches as many words is left out, unless span and coverage are the same too."""
    found = []
    by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, t, p in hits:
        by_template[t].append((place, p))
    for t, own in by_template.items():
        template = index.words[t]
        size = len(template)
        least = coverage * size - 1e-9
        mine: list[tuple[int, int]] = []
        for chain in chains(np.array(own), size):
            if any(first <= chain[0, 0] and chain[-1, 0] <= last for first, last in mine[-4:]):
                continue
            diagonals = chain[:, 0] - chain[:, 1]
            low, high = int(diagonals.min()), int(diagonals.max())
            band = (high - low + 1) // 2 + max(BAND, int((1 - coverage) * size))
            begin = (low + high) // 2
            around = words[max(begin - band, 0) : max(begin + size + band, 0)]
            if np.count_nonzero(np.isin(around, index.sorted_words[t])) < least:
                continue
            matched, first, last = align(template, words, begin, band)
            if matched >= least and identified(words[first : last + 1].tolist(), *index.identity[t]):
                found.append((t, matched, first, last))
                mine.append((first, last))
    found = sorted(set(found), key=lambda m: (m[2], -m[1], -m[3], len(index.words[m[0]]), m[0]))
    kept: list[tuple[int, int, int, int]] = []
    ends: list[tuple[int, int, int, int]] = []
    for t, matched, first, last in found:
        while ends and ends[-1][0] < first:
            ends.pop()
        this = (last, matched, first, len(index.words[t]))
        if not any(other[0] >= last and other[1] >= matched and other != this for other in ends):
            kept.append((t, matched, first, last))
            ends.append(this)
            ends.sort(reverse=True)
    return kept


def license_matches(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: the template, matched words over its words, and the span in code points of the text, end exclusive.

    template counts the texts of one licence from 0. Null and empty texts, and
    templates without a word, match nothing. Templates of fewer than GRAM words
    have no fingerprints. Very long texts are scanned as a whole, in a block of
    their own. Equally good matches of one span are all given. Repeated rows give repeated results, a null doc_id
    stays null, an empty table gives an empty result; only doc_id and text are read.
    """
    index = Index(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for part, raw in blocks(batches):
            texts = [t.decode("utf-8", "replace") for t in raw]
            split = [WORD.findall(t) for t in texts]
            ends = np.cumsum([len(s) for s in split])
            encoded = pa.array([w for s in split for w in s], pa.string()).dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            for w in distinct:
                if w not in memo:
                    memo[w] = word_hash(w)
            words = np.fromiter((memo[w] for w in distinct), np.uint64, len(distinct))[encoded.indices.to_numpy()]
            grams = gram_hashes(words)
            # Trigrams across two texts count as the greatest hash, which no window prefers to another.
            for i in range(1, GRAM):
                over = ends[:-1] - i
                grams[over[(over >= 0) & (over < len(grams))]] = ~np.uint64(0)
            rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for place, t, p in index.hits(grams, winnowed(grams)) if len(index.fingerprints) else ():
                rows[int(np.searchsorted(ends, place, side="right"))].append((place, t, p))
            out: list[tuple] = []
            for row, hits in rows.items():
                base = int(ends[row] - len(split[row]))
                matches = find(index, words[base : int(ends[row])], [(place - base, t, p) for place, t, p in hits], coverage)
                spans = [m.span() for m in WORD.finditer(texts[row])] if matches else []
                for t, matched, first, last in matches:
                    name, number = index.names[t]
                    out.append((part.column(0)[row].as_py(), name, number, matched / len(index.words[t]), matched, len(index.words[t]), first, spans[first][0], spans[last][1]))
            if out:
                types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int64()] * 5]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, SCHEMA)
