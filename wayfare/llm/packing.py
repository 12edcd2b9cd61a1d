"""Packing documents into sequences: cutting stock, by column generation.

A document is cut into whole sequences and a rest. Rests are the items of a
cutting-stock problem: their lengths, rounded up to ``GRAIN`` tokens, make a
histogram of at most ``size / GRAIN`` classes, all that the driver sees. A column
is a pattern: how many items of each class fill one sequence. The linear program
over patterns is solved by the revised simplex method; columns come from a
knapsack over the dual prices, by dynamic programming, until no pattern improves
it, or until its value is within ``GAP`` of a bound. Its solution is rounded down; what
is left is packed largest first, each sequence filled up by a subset sum.

*Cutting.* Some lengths don't go together: when most rests have one length, no
pattern of whole items may be good. So the linear program may also cut an item, at
its share of a sequence and a little more, and patterns that fill less than
``LEAST_FILL`` aren't worth their cost. Documents without a place are laid end to
end and cut where sequences end; where the last of these isn't full, it is cut
once more into sequences whose lengths are powers of two.

*Assignment.* Documents of a class are ranked, and each rank has its place in a
pattern's copy. Ranks and sums are counted per cell of hashes, so that a class
with most of the rows is ranked by many tasks.

Ids are made once and written; only the rests that are cut are read again. Cut are
a class's last ranks, so its last cells: other cells' ids aren't moved.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import blocks, stored

SIZE = 2048
END_ID = 1
#: Tokens to which lengths are rounded up in the histogram.
GRAIN = 4
#: The linear program ends within so much of its lower bound, or after this many columns for each class.
GAP, ROUNDS = 1e-3, 4
#: Columns that one knapsack offers.
COLUMNS = 16
#: A pattern of whole rests fills so much of its sequence, by rounded lengths.
LEAST_FILL = 0.98
#: Rows of a cell of hashes.
CELL_ROWS = 100_000
#: Known pieces of pre-tokens that a worker keeps from task to task, some 150 bytes each, and new ones that are encoded as one text.
CACHE_WORDS = 800_000
JOINED = 2000
#: Bytes of text that are made ids at a time; in a larger block fewer pieces are looked up twice.
BLOCK_BYTES = 8 << 20

#: One row per row of the input: pieces of whole sequences by their CRC-32, and the rest's ids, little-endian and as short as the vocabulary allows.
TOKENS = "key long, doc_id long, doc_tokens long, crcs array<long>, rest int, rest_crc long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# ---- ids ----


#: How the vocabulary's library must split and fold text for ``Ids`` to take words apart; other vocabularies' words are encoded whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at a word's ends that make one piece there: ASCII marks but the apostrophe, which can begin a piece with letters.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that have one lower-case letter each, and compose with no letter or mark beside them.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _strings(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column without nulls; many times faster than one scalar after the other."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    whole = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
    return [whole[i - at[0] : j - at[0]] for i, j in pairwise(at)]


class Ids:
    """Ids of texts. The vocabulary never joins across ASCII white space, so each distinct pre-token is encoded once.

    Many pre-tokens differ only in capitals and in marks at their ends. Where the
    vocabulary folds case and splits letters from marks, the letters between the
    marks are encoded once for all of them, as the library gives them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A special token's string ends a word whatever stands beside it, and its id nothing else has.
        added = self.tokenizer.get_added_tokens_decoder()
        special = sorted((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.between, self.break_ = special[-1] if special else (None, "")
        self.strings = [t.content.encode() for t in added.values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Ids as they are kept: as short as all of them allow.
        self.kept = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        parts = json.loads(self.tokenizer.to_str())
        normal, split, last = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}, parts["model"].get("end_of_word_suffix")
        self.folds = bool(
            [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and split["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
            and not split["pretokenizers"][1]["add_prefix_space"]
            and not split["pretokenizers"][1]["use_regex"]
            and last
            and all(not t.normalized and t.content.encode().strip(MARKS) != t.content.encode() for t in added.values())
        )
        #: By id: whether it ends a piece.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if last and t.endswith(last)]] = True
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: many at once, with a special token between them; by themselves those that hold one, or where there is none."""
        joined = [] if self.between is None else [w for w in words if not any(x in w for x in self.strings)]
        alone = words if self.between is None else [w for w in words if any(x in w for x in self.strings)]
        parts = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        found = self._encoded([self.break_.encode().join([*part, b""]) for part in parts] + alone)
        out = dict(zip(alone, map(np.ndarray.tobytes, found[len(parts) :]), strict=True))
        for part, ids in zip(parts, found, strict=False):
            stops = np.flatnonzero(ids == self.between)
            out.update(zip(part, _cut(ids, np.concatenate([[0], stops[:-1] + 1]), stops), strict=True))
        return [out[w] for w in words]

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs of lower-case letters, each one piece: many at once, with a blank between them, cut where pieces end."""
        parts, out = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)], []
        for part, ids in zip(parts, self._encoded([b" ".join(part) for part in parts]), strict=True):
            stops = np.flatnonzero(self.ends[ids]) + 1
            out += _cut(ids, np.concatenate([[0], stops[:-1]]), stops) if len(stops) == len(part) else self._whole(part)
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        """Add new pieces to those known."""
        runs = [p for p in pieces if LETTERS.fullmatch(p.decode("utf-8", "replace"))] if self.folds else []
        alike = set(runs)
        whole = [p for p in pieces if p not in alike]
        self.known.update(zip(runs, self._runs(runs), strict=True))
        self.known.update(zip(whole, self._whole(whole), strict=True))

    def _taken(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece, as bytes; each distinct one is looked up once."""
        encoded = pieces.dictionary_encode()
        distinct = _strings(encoded.dictionary)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found = list(map(self.known.get, distinct))
        if None in found:
            self._learn([p for p, ids in zip(distinct, found, strict=True) if ids is None])
            found = [self.known[p] if ids is None else ids for p, ids in zip(distinct, found, strict=True)]
        return pa.array(found, pa.large_binary()).take(encoded.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each word, as bytes. Letters between marks are three pieces: the marks before, the letters in lower case, the marks behind."""
        if not self.folds or not len(words):
            return self._taken(words)
        words = pa.concat_arrays([words.cast(pa.large_string())])
        begun = pc.ascii_ltrim(words, characters=MARKS.decode())
        run = pc.ascii_rtrim(begun, characters=MARKS.decode())
        apart = pc.match_substring_regex(run, rf"\A{LETTERS.pattern}\z")
        for x in self.strings:
            apart = pc.and_not(apart, pc.match_substring(words, x.decode()))
        # Places of the three in the words' own bytes; a word that stays whole is the second.
        sizes, some = pc.binary_length(words).to_numpy(), apart.to_numpy(zero_copy_only=False)
        before = np.where(some, sizes - pc.binary_length(begun).to_numpy(), 0)
        letters = np.where(some, pc.binary_length(run).to_numpy(), sizes)
        first = words.offset
        starts = np.frombuffer(words.buffers()[1], np.int64)[first : first + len(words) + 1]
        at = np.empty(3 * len(words) + 1, np.int64)
        at[::3], at[1::3], at[2::3] = starts, starts[:-1] + before, starts[:-1] + before + letters
        pieces = pa.LargeStringArray.from_buffers(3 * len(words), pa.py_buffer(at), words.buffers()[2])
        ids = self._taken(pc.if_else(pa.array(np.repeat(some, 3)), pc.utf8_lower(pieces), pieces))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1 : 3]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.copy()), ids.buffers()[2]])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by the end's id, and where each text's end. A null text has the end's id alone."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        encoded = split.flatten().dictionary_encode()
        # A document's end is one more word, of one id.
        words = pa.concat_arrays([self._words(encoded.dictionary), pa.array([np.array([END_ID], "<u4").tobytes()], pa.large_binary())])
        taken = words.take(pa.array(np.insert(encoded.indices.to_numpy(), ends, len(words) - 1)))
        stops = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
        return np.frombuffer(taken.buffers()[2], "<u4")[: stops[-1]], stops[ends + np.arange(1, len(texts) + 1)]


def _cut(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    whole = ids.astype("<u4").tobytes()
    return [whole[b:e] for b, e in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)]


#: Of each worker process.
_KNOWN: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _KNOWN:
        _KNOWN[path] = Ids(path)
    return _KNOWN[path]


def tokenized(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """TOKENS of each row of ``docs``; key tells rows apart once the result is written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, key = _ids(tokenizer_path), TaskContext.get().partitionId() << 40
        for part, texts in blocks(batches, budget=BLOCK_BYTES):
            flat, ends = ids.of(part.column(1))
            begins = np.concatenate([[0], ends[:-1]])
            lengths = ends - begins
            rests = ends - lengths % size
            crcs = [[zlib.crc32(flat[i : i + size]) for i in range(b, r, size)] for b, r in zip(begins.tolist(), rests.tolist(), strict=True)]
            short = memoryview(flat.astype(ids.kept)).cast("B")
            width = ids.kept.itemsize
            yield pa.record_batch(
                [
                    pa.array(key + np.arange(len(texts))), part.column(0), pa.array(lengths), pa.array(crcs, pa.list_(pa.int64())), pa.array((lengths % size).astype(np.int32)),
                    pa.array([zlib.crc32(flat[r:e]) for r, e in zip(rests.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    pa.array([bytes(short[width * r : width * e]) for r, e in zip(rests.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ],
                names=["key", "doc_id", "doc_tokens", "crcs", "rest", "rest_crc", "ids"],
            )
            key += len(texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, TOKENS)


# ---- patterns ----


def priced(prices: np.ndarray, classes: np.ndarray, room: int, more: int = 0) -> tuple[float, list[np.ndarray]]:
    """The knapsack: the most that items of ``classes`` (their sizes) can be worth in ``room``, and how many of each that takes.

    With ``more``, also the best patterns that hold one certain item, for so many different items at most.
    """
    useful = np.flatnonzero(prices > 1e-12)
    sizes, worth = classes[useful], prices[useful]
    best, took = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    # sizes are ascending, so those that fit a capacity are a prefix.
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fits[c]:
            value = best[c - sizes[: fits[c]]] + worth[: fits[c]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], took[c] = value[k], k

    def pattern(c: int, *held: int) -> np.ndarray:
        out = np.zeros(len(classes), np.int64)
        np.add.at(out, useful[list(held)], 1)
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                out[useful[took[c]]] += 1
                c -= sizes[took[c]]
        return out

    with_one = np.argsort(-(best[room - sizes] + worth), kind="stable")[:more]
    return float(best[room]), [pattern(room), *(pattern(room - int(sizes[k]), k) for k in with_one)]


def linear_program(classes: np.ndarray, demand: np.ndarray, room: int, least_fill: float = LEAST_FILL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (rows), how often each is used (a fraction), and how many items of each class are cut instead, so that all demand is met exactly.

    A sequence costs 1. An item that is cut needs no padding, so it costs its share
    of a sequence; divided by ``least_fill``, so that whole items are preferred and
    no pattern that fills less is worth its cost.
    """
    m = len(classes)
    cut = classes / (room * least_fill)
    basis, inverse, used, dual, cost = np.eye(m, dtype=np.int64), np.eye(m), demand.copy(), cut.copy(), cut.copy()
    is_cut, bound, least = np.ones(m, bool), float(classes @ demand) / room, 0.0
    held: list[np.ndarray] = []
    for _ in range(ROUNDS * m):
        price, back = 1.0, int((dual - cut).argmax())
        worth = dual @ held[0] if held else 0
        while held and worth - 1 < least:
            held.pop(0)
            worth = dual @ held[0] if held else 0
        if held:
            pattern, value = held.pop(0), float(worth)
        else:
            value, (pattern, *held) = priced(dual, classes, room, COLUMNS)
            # What later patterns must still be worth to enter without new prices.
            least = max((value - 1) / 2, 1e-9)
            # Prices divided by how far they exceed any column's cost are feasible for the dual program: a lower bound.
            bound = max(bound, float(dual @ demand) / max(value, float((dual / cut).max()), 1.0))
            if cost @ used <= bound * (1 + GAP) or max(value - 1, dual[back] - cut[back]) <= 1e-9:
                break
        if dual[back] - cut[back] > value - 1:
            pattern, price, value = np.eye(m, dtype=np.int64)[back], cut[back], dual[back]
        column = inverse @ pattern
        ratio = np.where(column > 1e-9, used / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        step, pivot = ratio[out], inverse[out] / column[out]
        used = np.maximum(used - step * column, 0)
        used[out] = step
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        dual = dual + (price - value) * pivot
        basis[out], cost[out], is_cut[out] = pattern, price, price < 1
    return basis[~is_cut], used[~is_cut], used[is_cut] @ basis[is_cut]


def filled(classes: np.ndarray, left: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, int]]:
    """Patterns and copies for what rounding left: the largest item first, then those that fill the sequence best."""
    left = left.copy()
    while left.any():
        pattern = np.zeros(len(classes), np.int64)
        largest = int(np.flatnonzero(left)[-1])
        pattern[largest] = 1
        space = room - int(classes[largest])
        # from_[c]: the item that first reached the sum c, with as many of each as there are.
        from_ = np.full(space + 1, -1, np.int64)
        from_[0] = len(classes)
        for k in np.flatnonzero(left)[::-1]:
            size, most = int(classes[k]), int(left[k] - pattern[k])
            for _ in range(min(most, space // size)):
                reached = np.flatnonzero((from_[: space + 1 - size] >= 0) & (from_[size:] < 0)) if size <= space else []
                if not len(reached):
                    break
                from_[reached + size] = k
            if from_[space] >= 0:
                break
        c = int(np.flatnonzero(from_ >= 0)[-1])
        while c:
            pattern[from_[c]] += 1
            c -= int(classes[from_[c]])
        taken = pattern > 0
        # A path may lean on an item oftener than there are: drop what is too much.
        pattern = np.minimum(pattern, left)
        copies = int((left[taken] // np.maximum(pattern[taken], 1)).min())
        left -= copies * pattern
        yield pattern, copies


@dataclass
class Plan:
    """Slots of whole rests: for each class, ranks from ``first`` on go to ``each`` places of a pattern's copies; ranks beyond the last are cut."""

    sequences: int = 0
    #: Of each class (by its size in grains): first rank, places of the class in a copy, first sequence, first slot in a copy.
    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    #: Ranks of each class that have a place.
    placed: dict[int, int] = field(default_factory=dict)
    #: Copies of each pattern: items by class.
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)

    def add(self, pattern: dict[int, int], copies: int) -> None:
        slot = 0
        for size, each in sorted(pattern.items(), reverse=True):
            first = self.placed.get(size, 0)
            self.slots.setdefault(size, []).append((first, each, self.sequences, slot))
            self.placed[size] = first + each * copies
            slot += each
        self.sequences += copies
        self.patterns.append((pattern, copies))


def planned(histogram: dict[int, int], room: int, least_fill: float = LEAST_FILL) -> Plan:
    """Patterns for items by class size; those that fill less than ``least_fill`` of ``room`` are left out."""
    plan = Plan()
    if not histogram:
        return plan
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in classes.tolist()], np.int64)
    basis, used, _ = linear_program(classes, demand.astype(float), room, least_fill)
    whole = np.floor(used + 1e-7).astype(np.int64)
    left, found = demand.copy(), []
    for pattern, copies in zip(basis, whole.tolist(), strict=True):
        # Floors of an exact solution never ask for more than there is, but for the last digits.
        taken = pattern > 0
        copies = min(copies, int((left[taken] // pattern[taken]).min())) if taken.any() else 0
        if copies:
            left -= copies * pattern
            found.append((pattern, copies))
    found += filled(classes, left, room)
    for pattern, copies in found:
        if pattern @ classes >= least_fill * room:
            plan.add({int(classes[k]): int(pattern[k]) for k in np.flatnonzero(pattern)}, copies)
    return plan


# ---- assignment ----


def _cells(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // CELL_ROWS))


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(cells))


def _class(grain: int) -> Column:
    return F.expr(f"cast((rest + {grain - 1}) div {grain} as int)").alias("class")


def _near_cuts(tokens: DataFrame, cut: DataFrame, cells: int, grain: int) -> DataFrame:
    """Rows of ``tokens`` in the cells that hold those of ``cut``: all of them, and few others, told by class and key alone."""
    first = cut.groupBy("class").agg(F.min(_cell(cells)).alias("first_cell"))
    rests = tokens.filter("rest > 0").select("key", "doc_id", "doc_tokens", "ids", _class(grain))
    return rests.join(F.broadcast(first), "class").filter(_cell(cells) >= F.col("first_cell")).select("key", "doc_id", "doc_tokens", "ids")


def _running(rows: DataFrame, within: list[str], amount: str, cells: int, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``amount`` over the rows before, in some order, among those equal in ``within``. No task sums more than a cell."""
    rows = rows.withColumn("cell", _cell(cells))
    sums = rows.groupBy(*within, "cell").agg(F.sum(amount).alias("cell_sum"))
    # Sums of cells are few: one row for each cell of a value.
    before = F.sum("cell_sum").over(Window.partitionBy(*within).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*within, "cell", F.coalesce(before, F.lit(0)).alias("cell_before"))
    inside = F.sum(amount).over(Window.partitionBy(*within, "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, [*within, "cell"])
    return rows.withColumn(name, F.col("cell_before") + F.col("inside")).drop("cell", "cell_before", "inside")


def placed(tokens: DataFrame, size: int = SIZE, grain: int = GRAIN, least_fill: float = LEAST_FILL) -> DataFrame:
    """PIECES of all rows of ``tokens``, as ``tokenized`` gives them, written and read again."""
    spark = tokens.sparkSession
    meta = tokens.select("key", "doc_id", "doc_tokens", "rest", "rest_crc", F.size("crcs").cast("long").alias("full"))
    classed = meta.filter("rest > 0").withColumn("class", _class(grain))
    histogram = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}
    plan = planned(histogram, size // grain, least_fill)
    cells = _cells(tokens, max(sum(histogram.values()), 1))

    # Whole sequences, and whole rests by the rank of their class.
    whole = tokens.filter("size(crcs) > 0").select("key", "doc_id", "doc_tokens", "crcs", F.size("crcs").cast("long").alias("full"))
    whole = _running(whole, [], "full", _cells(tokens, whole.count()), "before")
    whole = whole.select("doc_id", "doc_tokens", "before", F.posexplode("crcs").alias("at", "ids_crc32"))
    n_whole = meta.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    base, cut_base = n_whole, n_whole + plan.sequences
    pieces = whole.select("doc_id", (F.col("at") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("before") + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    ranked = stored(_running(classed.withColumn("one", F.lit(1).cast("long")), ["class"], "one", cells, "rank").drop("one"))
    shared = spark.sparkContext.broadcast({c: np.array(x, np.int64).reshape(-1, 4) for c, x in plan.slots.items()})
    limits = spark.createDataFrame([(c, plan.placed.get(c, 0)) for c in histogram], "class int, places long")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            kind, rank = part.column(0).to_numpy(), part.column(1).to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(kind).tolist():
                here, table = kind == c, shared.value[c]
                row = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1]
                copy, nth = np.divmod(rank[here] - row[:, 0], row[:, 1])
                sequence[here], slot[here] = base + row[:, 2] + copy, row[:, 3] + nth
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(sequence), pa.array(slot)], names=[*part.schema.names[2:], "sequence_id", "slot"])

    known = ranked.join(F.broadcast(limits), "class").withColumn("is_placed", F.col("rank") < F.col("places"))
    fitting = known.filter("is_placed").select("class", "rank", "doc_id", "doc_tokens", F.col("rest").cast("long").alias("length"), "rest_crc")
    fitting = fitting.mapInArrow(slots, "doc_id long, doc_tokens long, length long, rest_crc long, sequence_id long, slot long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.unionByName(fitting.select("doc_id", (F.col("doc_tokens") - F.col("length")).alias("start"), "length", F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(before, F.lit(0)).alias("offset")))

    # What no pattern holds: end to end, cut where sequences end.
    cut = known.filter("not is_placed").select("key", F.col("rest").cast("long").alias("rest"))
    total = cut.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    if not total:
        return pieces
    near = _near_cuts(tokens, known.filter("not is_placed"), cells, grain)
    stream = _running(cut, [], "rest", cells, "at").select("key", "at").join(near, "key").select("doc_id", "doc_tokens", "at", "ids")

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = powers(total - total % size, total)
        for part in batches:
            rows = []
            for doc_id, doc_tokens, at, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                ids = np.frombuffer(ids, f"<u{len(ids) // (doc_tokens % size)}").astype("<u4")
                begin, end = at, at + len(ids)
                while begin < end:
                    number, first, stop = sequence_at(begin, size, last)
                    stop = min(stop, end)
                    rows.append((doc_id, doc_tokens - len(ids) + begin - at, stop - begin, zlib.crc32(ids[begin - at : stop - at]), doc_tokens, cut_base + number, begin - first))
                    begin = stop
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.unionByName(stream.mapInArrow(divide, PIECES))


def powers(start: int, end: int) -> list[tuple[int, int]]:
    """[start, end) as stretches whose lengths are different powers of two, the longest first."""
    out = []
    for k in range((end - start).bit_length() - 1, -1, -1):
        if (end - start) >> k & 1:
            out.append((start, start + (1 << k)))
            start += 1 << k
    return out


def sequence_at(place: int, size: int, last: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The sequence of a place in the stream: its number, and where it begins and ends. last: the stretches of the last, unfilled one."""
    for k, (begin, end) in enumerate(last):
        if begin <= place < end:
            return last[0][0] // size + k, begin, end
    number = place // size
    return number, number * size, (number + 1) * size


def packed(docs: DataFrame, tokenizer_path: str, size: int = SIZE, grain: int = GRAIN, least_fill: float = LEAST_FILL) -> DataFrame:
    """One row per piece of a document: PIECES.

    A document's ids are those of its text (null: empty) and then ``END_ID``; each
    lies in exactly one piece, and a sequence's pieces are gapless from offset 0.
    Empty texts are items of one id. Repeated rows are packed each for itself, a
    null doc_id stays null, an empty table gives an empty result; a very long text
    is encoded as a whole, in a block of its own; columns other than doc_id and
    text are not read. sequence_id counts from 0, gapless.
    """
    return placed(stored(tokenized(docs, tokenizer_path, size)), size, grain, least_fill)
