"""Language ID with interpolated Kneser-Ney character models.

Each language has a model of character n-grams up to ``ORDER``. n-grams are
hashed to 64 bits and kept in sorted arrays, one per order for a block of
languages, beside a matrix of log probabilities: one search finds an n-gram in
every language of the block. A text gets the language of the lowest
cross-entropy per character. It is rejected where that is nearer to what the
language gives texts of its nearest neighbours than to what it gives its own,
both measured for that length on held-back labelled rows.

The models are fitted on a bounded number of labelled texts, each as a whole,
and on executors: n-grams are counted and summed as rows, and each block of
languages is fitted by a task of its own. Every text is scored as a whole. More
languages than ``PASS_BYTES`` of models are scored in several passes.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import blocks, stored

ORDER = 4
#: The bound of the sample: different texts of each language.
ROWS_PER_LANGUAGE = 400
#: Every so many-th text of the sample calibrates and isn't learned from.
CALIBRATE_EVERY = 4
#: Lengths, in letters and gaps, at which the limit of rejection changes; and the characters of the pieces, cut from calibrating texts, that set it.
LENGTHS = (20, 100, 500)
PIECES = (10, 20, 100, 500)
PIECES_PER_TEXT = 3
#: Percentiles of a language's own pieces and of its nearest neighbours' pieces between which the limit lies half-way.
#: The neighbours' median, not their least: labelled rows hold passages of other languages.
OWN, RIVAL = 95, 50
#: The limit is at least this percentile of the own pieces, and at least so many nats above OWN: a text with passages of another language, or with codes and numbers, stays.
OWN_LEAST, LEAST_SLACK = 99, 0.5
#: Nats per character above OWN where no other language is there to compare with.
SLACK = 1.5
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: n-grams times languages of a block that is fitted and searched as one matrix; bytes of models that are broadcast at once.
BLOCK_CELLS = 4 << 20
PASS_BYTES = 128 << 20

UNKNOWN = "und"
GAP, START = 32, 1
PRIME = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, n int, gram long, context long, suffix long, count long"
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double, n_chars_scored long"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each begun by ORDER - 1 STARTs, in lower case, with one GAP for what isn't a letter; where each begins."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts[:-1][sizes > 0]] = is_letter[starts[:-1][sizes > 0]]
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    body = np.where(is_letter, points, GAP)[keep]
    pad = ORDER - 1
    out = np.full(len(body) + pad * len(texts), START, np.uint32)
    doc = np.repeat(np.arange(1, len(texts) + 1), np.diff(kept))
    out[np.arange(len(body)) + pad * doc] = body
    return out, kept + pad * np.arange(len(texts) + 1)


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """hashes[n][i]: of the n characters that end at i (what lies before the array counts as nothing)."""
    one = points.astype(np.uint64) + np.uint64(1)
    one *= PRIME
    one ^= one >> np.uint64(29)
    one *= np.uint64(0xBF58476D1CE4E5B9)
    hashes = [np.zeros(len(one), np.uint64), one]
    power = np.uint64(1)
    for n in range(2, ORDER + 1):
        power = np.uint64(int(power) * int(PRIME) % (1 << 64))
        more = hashes[-1].copy()
        more[n - 1 :] += one[: len(one) - n + 1] * power
        hashes.append(more)
    return hashes


def shifted(a: np.ndarray) -> np.ndarray:
    """a[i - 1] at i."""
    return np.concatenate([np.zeros(1, a.dtype), a[:-1]])


def count_grams(texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: distinct grams with their context's and suffix's hashes, and how often they occur."""
    points, _ = characters(texts)
    hashes = gram_hashes(points)
    at = np.flatnonzero(points != START)
    out = []
    for n in range(1, ORDER + 1):
        gram, first, count = np.unique(hashes[n][at], return_index=True, return_counts=True)
        first = at[first]
        out.append((n, gram, shifted(hashes[n - 1])[first], hashes[n - 1][first], count))
    return out


@dataclass
class Model:
    """A block of languages. grams[n]: sorted hashes, and log p per language. backoff[n]: sorted hashes of contexts of n characters, and log of their weight per language."""

    languages: list[str] = field(default_factory=list)
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    backoff: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray | None = None

    def log_p(self, hashes: list[np.ndarray], contexts: list[np.ndarray], n: int = ORDER) -> np.ndarray:
        """For each position a row: log p of its character in every language. contexts[n]: of the n characters before."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(hashes[0]), len(self.languages)))
        known, values = self.grams[n]
        at = np.minimum(np.searchsorted(known, hashes[n]), len(known) - 1)
        out = values[at]
        missed = np.flatnonzero(known[at] != hashes[n])
        if len(missed):
            contexts_known, weights = self.backoff[n - 1]
            context = contexts[n - 1][missed]
            at = np.minimum(np.searchsorted(contexts_known, context), len(contexts_known) - 1)
            out[missed] = np.where((contexts_known[at] == context)[:, None], weights[at], 0) + self.log_p([h[missed] for h in hashes], [c[missed] for c in contexts], n - 1)
        return out


def cross_entropies(models: list[Model], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: scored characters, and nats per character in every language of the models."""
    points, starts = characters(texts)
    hashes = gram_hashes(points)
    real = np.flatnonzero(points != START)
    per_text = np.diff(starts) - (ORDER - 1)
    sums = np.zeros((len(texts), sum(len(m.languages) for m in models)))
    if len(real):
        at, before = [h[real] for h in hashes], [shifted(h)[real] for h in hashes[:ORDER]]
        has = per_text > 0
        begins = np.concatenate([[0], np.cumsum(per_text)[:-1]])[has]
        sums[has] = np.hstack([np.add.reduceat(m.log_p(at, before), begins, axis=0, dtype=np.float64) for m in models])
    return per_text, -sums / np.maximum(per_text, 1)[:, None]


def fit(counts: pa.Table, alphabet: int) -> Model:
    """Interpolated Kneser-Ney probabilities from how often grams occur; unseen grams get what backing off gives them.

    Below the highest order a gram counts once for each different character
    before it. alphabet: the number of characters that the floor is shared by.
    """
    coded = counts["lang"].combine_chunks().dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    model = Model(languages, [(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))])
    place = {x: k for k, x in enumerate(languages)}
    lang = np.array([place[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    order = counts["n"].to_numpy()
    columns = {c: counts[c].to_numpy().view(np.uint64) for c in ("gram", "context", "suffix")}
    number = counts["count"].to_numpy().astype(np.float64)
    for n in range(1, ORDER):
        rows, longer = np.flatnonzero(order == n), np.flatnonzero(order == n + 1)
        known = np.unique(columns["gram"][rows])
        cell = np.searchsorted(known, columns["suffix"][longer]) * len(languages) + lang[longer]
        before = np.bincount(cell, minlength=len(known) * len(languages))
        number[rows] = before[np.searchsorted(known, columns["gram"][rows]) * len(languages) + lang[rows]]
    for n in range(1, ORDER + 1):
        rows = np.flatnonzero(order == n)
        known, first, back = np.unique(columns["gram"][rows], return_index=True, return_inverse=True)
        contexts, of = np.unique(columns["context"][rows], return_inverse=True)
        mass = np.zeros((len(contexts), len(languages)))
        kinds, spared = mass.copy(), mass.copy()
        discounted = np.zeros((len(known), len(languages)))
        which = lang[rows]
        once, twice = (np.bincount(which[number[rows] == k], minlength=len(languages)) for k in (1, 2))
        discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
        np.add.at(mass, (of, which), number[rows])
        np.add.at(kinds, (of, which), 1)
        spared[:] = np.minimum(kinds * discount, mass)
        discounted[back, which] = np.maximum(number[rows] - discount[which], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(mass > 0, spared / mass, 1.0)
            context = of[first]
            share = np.where(mass[context] > 0, discounted / mass[context], 0.0)
        if n == 1:
            lower = np.full((len(known), len(languages)), 1 / alphabet)
            model.floor = np.log(weight[0] / alphabet).astype(np.float32)
        else:
            below, values = model.grams[n - 1]
            lower = np.exp(values[np.searchsorted(below, columns["suffix"][rows][first])].astype(np.float64))
        model.grams.append((known, np.log(share + weight[context] * lower).astype(np.float32)))
        # Contexts of no characters weigh on the floor already.
        model.backoff.append((contexts, np.log(weight).astype(np.float32) if n > 1 else np.zeros_like(weight, np.float32)))
    return model


@dataclass
class Classifier:
    """passes: the blocks that are broadcast together, as rows of ``fitted`` (block, model). limits[length][language]: nats per character beyond which a text is rejected."""

    languages: list[str] = field(default_factory=list)
    passes: list[list[int]] = field(default_factory=list)
    fitted: DataFrame | None = None
    limits: np.ndarray | None = None
    temperature: float = 1.0

    def models(self, number: int = 0) -> list[Model]:
        """The models of a pass, in order of their languages."""
        if not self.languages:
            return []
        rows = self.fitted.filter(F.col("block").isin(self.passes[number])).orderBy("block").collect()
        return [pickle.loads(r["model"]) for r in rows]


#: What is known of a text after some of the passes, as an array of numbers; then one more for each temperature.
LENGTH, BEST, NATS, OWN_NATS, RIVAL_AT, RIVAL_NATS, SUMS = range(7)


def folded(models: list[Model], texts: list[bytes], first: int, temperatures: tuple[float, ...], truth: np.ndarray | None, was: np.ndarray | None) -> np.ndarray:
    """The state of each text after a pass. first: the number of the models' first language; truth: that of each text's own. Equal cross-entropies: the first language."""
    state = np.full((len(texts), SUMS + len(temperatures)), np.inf)
    state[:, LENGTH] = 0
    if not models:
        return state
    length, nats = cross_entropies(models, texts)
    every = np.arange(len(texts))
    state[:, LENGTH], state[:, BEST] = length, nats.argmin(axis=1) + first
    state[:, NATS] = nats.min(axis=1)
    for k, t in enumerate(temperatures):
        state[:, SUMS + k] = np.logaddexp.reduce(-nats * (length * t)[:, None], axis=1)
    if truth is not None:
        here = np.flatnonzero((truth >= first) & (truth < first + nats.shape[1]))
        state[here, OWN_NATS] = nats[here, truth[here] - first]
        nats[here, truth[here] - first] = np.inf
        state[:, RIVAL_AT], state[:, RIVAL_NATS] = nats.argmin(axis=1) + first, nats[every, nats.argmin(axis=1)]
    if was is not None:
        state[:, OWN_NATS] = np.minimum(state[:, OWN_NATS], was[:, OWN_NATS])
        for at, value in ((BEST, NATS), (RIVAL_AT, RIVAL_NATS)):
            earlier = was[:, value] <= state[:, value]
            state[earlier, at], state[earlier, value] = was[earlier, at], was[earlier, value]
        state[:, SUMS:] = np.logaddexp(state[:, SUMS:], was[:, SUMS:])
    return state


def scored(docs: DataFrame, by: Classifier, temperatures: tuple[float, ...], finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType | str, truth: str | None = None) -> DataFrame:
    """``finish`` of the rows of ``docs`` (a column text among them) and their states. truth: a column with each row's own language."""
    name = "state"
    while name in docs.columns:
        name += "_"
    columns = docs.columns
    between = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    known = {x: k for k, x in enumerate(by.languages)}
    first = 0
    for number in range(max(1, len(by.passes))):
        models = by.models(number)
        shared = docs.sparkSession.sparkContext.broadcast(models)
        last = number + 1 >= len(by.passes)

        def step(batches: Iterator[pa.RecordBatch], shared=shared, first=first, number=number, last=last) -> Iterator[pa.RecordBatch]:
            models = shared.value
            for part, texts in blocks(batches, budget=1 << 20):
                own = np.array([known[x] for x in part.column(columns.index(truth)).to_pylist()], np.int64) if truth else None
                was = np.array(part.column(len(columns)).to_pylist()).reshape(part.num_rows, -1) if number else None
                state = folded(models, texts, first, temperatures, own, was)
                rows = pa.RecordBatch.from_arrays(part.columns[: len(columns)], names=columns)
                yield finish(rows, state) if last else rows.append_column(name, pa.array(state.tolist(), pa.list_(pa.float64())))

        docs = docs.mapInArrow(step, schema if last else between)
        if not last:
            docs = stored(docs)
        first += sum(len(m.languages) for m in models)
    return docs


def least_hashes(labelled: DataFrame, rows: int) -> DataFrame:
    """lang, h and place (from 1) of the ``rows`` least different hashes h of each language."""
    ranked = labelled.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.filter(F.col("place") <= rows)


def sample(labelled: DataFrame, rows: int, seed: int, chars: int | None = None) -> DataFrame:
    """lang, place and text of the ``rows`` texts of each language whose seeded hashes are least, without repeats; place counts from 0.

    Only hashes are made distinct and ranked. The rank's bound stands bare over the
    window, so each task keeps ``rows`` hashes of a language before they are
    exchanged; texts are fetched for the chosen hashes.
    """
    usable = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64(F.lit(seed), "text").alias("h"), "text")
    chosen = stored(least_hashes(usable, rows).withColumn("place", F.col("place") - 1))
    found = usable.alias("u").join(chosen.alias("c"), (F.col("u.lang") == F.col("c.lang")) & (F.col("u.h") == F.col("c.h"))).select("c.lang", "c.place", "u.h", "u.text")
    found = found.groupBy("lang", "place").agg(F.min("h").alias("h"), F.min("text").alias("text"))
    if chars is not None:
        begin = F.expr(f"cast(1 + pmod(shiftright(h, 31), greatest(length(text) - {chars} + 1, 1)) as int)")
        found = found.withColumn("text", F.substring("text", begin, F.lit(chars)))
    return found.select("lang", "place", "text")


def counted(learned: DataFrame) -> DataFrame:
    """COUNTS of the texts of each language, summed over all of its texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            names = part.column(0).to_pylist()
            for lang in sorted(set(names)):
                for n, g, c, s, k in count_grams([t for t, x in zip(texts, names, strict=True) if x == lang]):
                    m = len(g)
                    arrays = [pa.array([lang] * m, pa.string()), pa.array([n] * m, pa.int32()), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in (g, c, s)), pa.array(k.astype(np.int64))]
                    yield pa.record_batch(arrays, names=["lang", "n", "gram", "context", "suffix", "count"])

    each = learned.select("lang", "text").mapInArrow(count, COUNTS)
    return each.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("count").alias("count"))


def train(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int | None = None, seed: int = 11) -> Classifier:
    """labelled: text and lang. Fit on at most ``rows`` different texts of each language (and ``chars`` characters of each, if given), chosen by a seeded hash.

    Rows without a text, a language or a letter teach nothing, and a language of
    only such rows isn't learned; repeated texts count once. A language of fewer
    than CALIBRATE_EVERY texts learns from all of them.
    """
    spark = labelled.sparkSession
    chosen = stored(sample(labelled, rows, seed, chars))
    few = F.count("*").over(Window.partitionBy("lang")) < CALIBRATE_EVERY
    marked = chosen.withColumn("few", few)
    counts = stored(counted(marked.filter(F.col("few") | (F.col("place") % CALIBRATE_EVERY != 0))))
    sizes = {r[0]: r[1] for r in counts.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return Classifier()
    block_of, block, held = {}, 0, [0, 0]
    for lang, n in sorted(sizes.items()):
        held = [held[0] + n, held[1] + 1]
        if held[0] * held[1] > BLOCK_CELLS and held[1] > 1:
            block, held = block + 1, [n, 1]
        block_of[lang] = block
    alphabet = counts.filter("n = 1").select("gram").distinct().count() + 1

    def fit_block(key: tuple, table: pa.Table) -> pa.Table:
        model = pickle.dumps(fit(table, alphabet))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([model], pa.binary()), "size": pa.array([len(model)], pa.int64())})

    names = spark.createDataFrame(list(block_of.items()), "lang string, block int")
    fitted = stored(counts.join(names, "lang").groupBy("block").applyInArrow(fit_block, "block int, model binary, size long"))
    passes, size = [], 0
    for r in fitted.select("block", "size").orderBy("block").collect():
        size += r["size"]
        if not passes or size > PASS_BYTES:
            passes.append([])
            size = r["size"]
        passes[-1].append(r["block"])
    by = Classifier(sorted(sizes), passes, fitted)
    calibrate(by, chosen.filter(F.col("place") % CALIBRATE_EVERY == 0), seed)
    return by


def calibrate(by: Classifier, held: DataFrame, seed: int) -> None:
    """Set the limits of rejection per length and language, and the temperature at which scores fit how often predictions are right, from pieces of the texts of ``held``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            out = []
            for lang, place, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                text, rng = text.decode("utf-8", "replace"), random.Random(f"{seed}:{place}")
                for band, n in enumerate(PIECES):
                    for _ in range(PIECES_PER_TEXT if len(text) > n else 1):
                        begin = rng.randint(0, max(len(text) - n, 0))
                        if len(text) >= n or band == 0:
                            out.append((lang, band, text[begin : begin + n]))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["lang", "band", "text"])

    def finish(part: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([part.column(0), part.column(1), pa.array(state.tolist(), pa.list_(pa.float64()))], names=["lang", "band", "state"])

    pieces = held.select("lang", "place", "text").mapInArrow(cut, "lang string, band int, text string")
    found = scored(pieces, by, TEMPERATURES, finish, "lang string, band int, state array<double>", truth="lang").toArrow()
    known = {x: k for k, x in enumerate(by.languages)}
    truth, band = np.array([known[x] for x in found["lang"].to_pylist()], np.int64), found["band"].to_numpy()
    state = np.array(found["state"].to_pylist()).reshape(len(truth), SUMS + len(TEMPERATURES))
    has = state[:, LENGTH] > 0
    truth, band, state = truth[has], band[has], state[has]
    by.limits = np.full((len(PIECES), len(by.languages)), np.inf)
    for b in range(len(PIECES)):
        for k in range(len(by.languages)):
            own = state[(band == b) & (truth == k), OWN_NATS]
            rival = state[(band == b) & (truth != k) & (state[:, RIVAL_AT] == k), RIVAL_NATS]
            if not len(own):  # No text is so long: the limit of shorter ones holds.
                by.limits[b, k] = by.limits[max(b - 1, 0), k]
            elif len(rival):
                low, high = np.percentile(own, OWN), np.percentile(rival, RIVAL)
                by.limits[b, k] = max(np.percentile(own, OWN_LEAST), low + LEAST_SLACK, (low + high) / 2)
            else:
                by.limits[b, k] = np.percentile(own, OWN) + SLACK
    if len(state):
        logs = -(state[:, OWN_NATS] * state[:, LENGTH])[:, None] * np.array(TEMPERATURES) - state[:, SUMS:]
        by.temperature = TEMPERATURES[int(np.maximum(logs, np.log(1e-9)).mean(axis=0).argmax())]


def _over(by: Classifier, state: np.ndarray) -> np.ndarray:
    """Whether a text is rejected."""
    none = state[:, LENGTH] == 0
    best = np.where(none, 0, state[:, BEST]).astype(np.int64)
    return none if by.limits is None else none | (state[:, NATS] > by.limits[np.searchsorted(LENGTHS, state[:, LENGTH], side="right"), best])


def identify(docs: DataFrame, by: Classifier) -> DataFrame:
    """One row per row of ``docs``: lang_pred, score, rejected, cross_entropy (nats per character), n_chars_scored.

    A null text, or one without a letter, is ``und`` with score 0 and rejected,
    as all are by a model without languages. lang_pred of a rejected text still
    names the nearest language; of equally near ones the first by name. Repeated
    rows give repeated results, a null doc_id stays null, an empty table gives
    an empty result; a very long text is scored as a whole, in a block of its
    own; only doc_id and text are read.
    """
    names, temperature = [*by.languages, UNKNOWN], by.temperature
    limits = Classifier(limits=by.limits)

    def finish(part: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
        none = state[:, LENGTH] == 0
        best = np.where(none, len(names) - 1, state[:, BEST]).astype(np.int64)
        nats = np.where(none, 0.0, state[:, NATS])
        score = np.where(none, 0.0, np.exp(np.minimum(-nats * state[:, LENGTH] * temperature - np.where(none, 0.0, state[:, SUMS]), 0.0)))
        arrays = [part.column(0), pa.array([names[b] for b in best], pa.string()), pa.array(score), pa.array(_over(limits, state)), pa.array(nats), pa.array(state[:, LENGTH].astype(np.int64))]
        return pa.record_batch(arrays, names=["doc_id", "lang_pred", "score", "rejected", "cross_entropy", "n_chars_scored"])

    return scored(docs.selectExpr("cast(doc_id as long) doc_id", "text"), by, (temperature,), finish, SCHEMA)


def accepted(docs: DataFrame, by: Classifier) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all columns stay, and nothing is moved."""
    limits = Classifier(limits=by.limits)

    def finish(part: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(~_over(limits, state)))

    return scored(docs, by, (by.temperature,), finish, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy", "n_chars_scored")
