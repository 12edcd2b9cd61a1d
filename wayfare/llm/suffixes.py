"""Suffix-array dedup: remove bytes of strings that occur earlier in the corpus.

*Which suffixes.* In every string of LENGTH bytes the least hash of its KGRAM
byte grams marks an anchor, so equal strings have their anchors at equal places.
Successive strings mostly share an anchor. Only the suffixes that begin at
anchors are sorted, each with the bytes before it that its strings need, and
only those whose anchor gram occurs a second time somewhere in the corpus.

*Sorting.* A task sorts the suffixes of its documents, drops what its own run
repeats, front-codes the run (length of the common prefix, remaining bytes) and
sends each range of the order to the task that merges it. The order is that of
the anchor gram's hash, then of the bytes: hashes are uniform, so equal ranges
of them are splitters that need no sample and balance by themselves.

*Merging.* A loser tree joins the runs. Each candidate carries the length of its
common prefix with the last suffix given out; of two candidates the longer
common prefix is the smaller suffix, and only for equal lengths are bytes
compared, from there on. The merge gives the suffixes in order with the common
prefixes of neighbours.

*Deciding.* Strings are equal if their parts after the anchor are (neighbours'
common prefixes reach that far) and their parts before it are. All but the
earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import partitions_for

LENGTH = 100
KGRAM = 32
#: Bytes that are hashed at a time, and bytes of text whose suffixes make a run.
SEGMENT_BYTES = 1 << 18
RUN_BYTES = 8 << 20
#: Bytes of text whose anchors, and at most whose suffixes, a task holds after an exchange.
TASK_BYTES = 64 << 20

_U = np.uint64
_ONES = ~_U(0)
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "big") for i in range(256)], _U)
_PLACE_BITS = 22

ANCHORS = "gram long, id long, kind int"
MOVED = "part int, run binary, id long, th long, start long, end long"
SPANS = "id long, th long, start long, end long"
_NO_ID = -(1 << 63)


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  kept between calls
    """base**0 ... base**(n - 1), modulo 2**64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1), _U)
        have[1:] = _U(base)
        have = cache[base] = np.multiply.accumulate(have)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Hashes:
    """Hashes of any stretches of a buffer."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[buffer] * _powers(_B, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _powers(_B_INVERSE, len(self.sums))[start])

    def grams(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * _powers(_B_INVERSE, len(self.sums) - size))


class Segment:
    """Stretches of texts in one buffer, and the anchors of their strings.

    Parallel arrays, one entry per anchor: lo and hi (first and last start of
    its strings in the buffer), at (its place), gram (its hash), row and shift
    (the text, and what to add to a place in the buffer for one in the text).
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.bytes = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces], np.int64)
        begins = np.cumsum(sizes) - sizes
        n = len(self.bytes) - LENGTH + 1
        self.hashes = Hashes(self.bytes)
        if n <= 0:
            self.lo = self.hi = self.at = self.row = self.shift = np.zeros(0, np.int64)
            self.gram = np.zeros(0, _U)
            return
        grams = self.hashes.grams(KGRAM)
        least = (grams & ~_U((1 << _PLACE_BITS) - 1)) | np.arange(len(grams), dtype=_U)
        width, window = 1, LENGTH - KGRAM + 1
        while width * 2 <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        anchor = (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        # Strings that would run into the next piece are none.
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.minimum(begins, n), 1)
        np.add.at(edge, np.minimum(np.maximum(begins + sizes - LENGTH + 1, begins), n), -1)
        real = np.cumsum(edge[:-1]) > 0
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (real[1:] != real[:-1])
        new[begins[begins < n]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        use = real[first]
        self.lo, self.hi = first[use], last[use]
        self.at = anchor[self.lo]
        # Hashed anew: the least of many hashes are small numbers, and ranges of them would not balance.
        self.gram = _mixed(grams[self.at] + _U(_B))
        piece = np.searchsorted(begins, self.lo, side="right") - 1
        # Empty pieces begin where the next one does; the last of equal begins is the one with bytes.
        self.row = np.array([r for r, _, _ in pieces], np.int64)[piece]
        self.shift = np.array([o for _, o, _ in pieces], np.int64)[piece] - begins[piece]


def segments(texts: list[tuple[int, bytes]]) -> Iterator[Segment]:
    """Segments over (row, text); a long text is cut so that each of its strings lies in one piece."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in texts:
        for start in range(0, max(len(text) - LENGTH + 1, 0), SEGMENT_BYTES):
            piece = text[start : start + SEGMENT_BYTES + LENGTH - 1]
            if pieces and size + len(piece) > 2 * SEGMENT_BYTES:
                yield Segment(pieces)
                pieces, size = [], 0
            pieces.append((row, start, piece))
            size += len(piece)
    if pieces:
        yield Segment(pieces)


def _runs_of(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Rows gathered to about RUN_BYTES of text: the named columns, and the texts."""
    held: dict[str, list] = {c: [] for c in columns}
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in (*columns, "text")}
        raw = at["text"].cast(pa.large_binary() if pa.types.is_large_string(at["text"].type) else pa.binary())
        for i in range(batch.num_rows):
            text = raw[i].as_py() or b""
            if texts and size + len(text) > RUN_BYTES:
                yield held, texts
                held, texts, size = {c: [] for c in columns}, [], 0
            for c in columns:
                held[c].append(at[c][i].as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield held, texts


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor gram of a run once. kind 0: of one document; 1: of several, which come as rows of kind 2."""
    for held, texts in _runs_of(batches, ("id",)):
        ids = np.array(held["id"], np.int64)
        found = [(s.gram, ids[s.row]) for s in segments(list(enumerate(texts)))]
        if not found:
            continue
        gram, of = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((of, gram))
        gram, of = gram[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        often = np.diff(np.append(first, len(gram))) > 1
        repeated = np.repeat(often, np.diff(np.append(first, len(gram))))
        direct = repeated & np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])
        yield pa.record_batch(
            [
                pa.array(np.concatenate([gram[first], gram[direct]]).view(np.int64)),
                pa.array(np.concatenate([of[first], of[direct]])),
                pa.array(np.concatenate([often.astype(np.int32), np.full(direct.sum(), 2, np.int32)])),
            ],
            names=["gram", "id", "kind"],
        )


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's grams those that occur twice, with the documents that have them."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    gram, of, kind = (table[c].to_numpy() for c in ("gram", "id", "kind"))
    ask = kind < 2
    order = np.argsort(gram[ask], kind="stable")
    asked, owner, single = gram[ask][order], of[ask][order], kind[ask][order] == 0
    same = asked[1:] == asked[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    reply = twice & single
    yield pa.record_batch([pa.array(np.concatenate([owner[reply], of[~ask]])), pa.array(np.concatenate([asked[reply], gram[~ask]]))], names=["id", "gram"])


def _merged_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans per row; touching ones become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Rows are told apart by a distance, so that one running maximum serves all.
    far = int(end.max()) + 1
    change = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
    reach = np.maximum.accumulate(end + change * far)
    new = np.concatenate([[True], start[1:] + change[1:] * far > reach[:-1]])
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] - change[first] * far


class Run:
    """Suffixes in order: key (gram hash and bytes from the anchor, front-coded), the bytes before the anchor, and where they are."""

    FIELDS = (("lcp", np.uint8), ("size", np.uint8), ("least", np.uint8), ("most", np.uint8), ("id", np.int64), ("th", np.int64), ("at", np.int64))

    def __init__(self, columns: dict[str, np.ndarray], tails: bytes, lefts: bytes):
        self.columns, self.tails, self.lefts = columns, tails, lefts

    def pack(self) -> bytes:
        import zstandard

        n = len(self.columns["lcp"])
        head = np.array([n, len(self.tails)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(self.columns[c].astype(k).tobytes() for c, k in self.FIELDS) + self.tails + self.lefts)

    @classmethod
    def unpack(cls, blob: bytes) -> Run:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, tails = np.frombuffer(raw, np.int64, 2).tolist()
        place, columns = 16, {}
        for c, k in cls.FIELDS:
            columns[c] = np.frombuffer(raw, k, n, place)
            place += columns[c].nbytes
        return cls(columns, raw[place : place + tails], raw[place + tails :])

    def keys(self) -> Iterator[tuple[bytes, int]]:
        """Each suffix and its common prefix with the one before."""
        key, place, tails = b"", 0, self.tails
        for lcp, size in zip(self.columns["lcp"].tolist(), self.columns["size"].tolist(), strict=True):
            key = key[:lcp] + tails[place : place + size - lcp]
            place += size - lcp
            yield key, lcp


def sorted_runs(grams: np.ndarray, keys: np.ndarray, sizes: np.ndarray, lefts: np.ndarray, columns: dict[str, np.ndarray], parts: int) -> Iterator[tuple[int, Run]]:
    """Sort suffixes, front-code them, and cut the run at the ranges of the parts. keys: rows of bytes padded with zeros; lefts: likewise, from the anchor backwards."""
    words = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, -keys.shape[1] % 8)))).view(">u8")
    order = np.lexsort((sizes, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))))
    keys, sizes, lefts = keys[order], sizes[order], lefts[order]
    columns = {c: v[order] for c, v in columns.items()}
    part = part_of(grams[order], parts)
    differ = keys[1:] != keys[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))])
    bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    lcp[bounds] = 0
    span = np.arange(keys.shape[1])
    in_tail = (span >= lcp[:, None]) & (span < sizes[:, None])
    in_left = np.arange(lefts.shape[1]) < columns["most"].astype(np.int64)[:, None]
    for a, b in zip(bounds, [*bounds[1:], len(part)], strict=True):
        cut = slice(a, b)
        yield int(part[a]), Run({"lcp": lcp[cut], "size": sizes[cut]} | {c: v[cut] for c, v in columns.items()}, keys[cut][in_tail[cut]].tobytes(), lefts[cut][in_left[cut]].tobytes())


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes, of ``parts`` equal ones."""
    return ((grams >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def make_runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _runs_of(batches, ("id", "th", "grams")):
            yield from _run(held, texts, parts)

    return run


def _moved(part: list, run: list, ids, ths, starts, ends) -> pa.RecordBatch:
    n, m = len(part), len(ids)
    none = [None] * m
    pad = np.zeros(n, np.int64)
    columns = [pa.array([*part, *[int(i) & 0x7FFFFFFF for i in ids]], pa.int32()), pa.array([*run, *none], pa.binary())]
    columns += [pa.array(np.concatenate([pad, np.asarray(x, np.int64)])) for x in (ids, ths, starts, ends)]
    return pa.record_batch(columns, names=["part", "run", "id", "th", "start", "end"])


def _run(held: dict[str, list], texts: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    ids, ths = np.array(held["id"], np.int64), np.array(held["th"], np.int64)
    wanted = np.unique(np.concatenate([np.array(g, np.int64) for g in held["grams"]]).view(_U))
    # Rows of equal id and text are one document.
    rank = np.unique(np.stack([ids, ths]), axis=1, return_inverse=True)[1].reshape(-1)
    names = ("gram", "whole", "rank", "row", "at", "least", "most", "segment", "place")
    found: dict[str, list[np.ndarray]] = {n: [] for n in names}
    buffers = []
    for s in segments(list(enumerate(texts))):
        near = np.minimum(np.searchsorted(wanted, s.gram), len(wanted) - 1)
        use = np.flatnonzero(wanted[near] == s.gram)
        if not len(use):
            continue
        lo, hi, at = s.lo[use], s.hi[use], s.at[use]
        whole = s.hashes.of(lo, hi + LENGTH) ^ _mixed(((at - lo) * 256 + (at - hi)).astype(_U) * _U(_B))
        for n, v in zip(names, (s.gram[use], whole, rank[s.row[use]], s.row[use], at + s.shift[use], at - hi, at - lo, np.full(len(use), len(buffers)), at), strict=True):
            found[n].append(v)
        buffers.append(s.bytes)
    if not buffers:
        return
    e = {n: np.concatenate(v) for n, v in found.items()}
    # What the run itself repeats as a whole is decided here; its earliest copy stands for it.
    order = np.lexsort((e["at"], e["rank"], e["whole"], e["gram"]))
    e = {n: v[order] for n, v in e.items()}
    new = np.concatenate([[True], (e["whole"][1:] != e["whole"][:-1]) | (e["gram"][1:] != e["gram"][:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    copy = ~new & ((e["rank"] != e["rank"][first]) | (e["at"] != e["at"][first]))
    row, start, end = _merged_spans(e["row"][copy], (e["at"] - e["most"])[copy], (e["at"] - e["least"] + LENGTH)[copy])
    e = {n: v[new] for n, v in e.items()}
    runs = list(_cut(e, buffers, ids, ths, parts))
    yield _moved([p for p, _ in runs], [r.pack() for _, r in runs], ids[row], ths[row], start, end)


def _cut(e: dict[str, np.ndarray], buffers: list[np.ndarray], ids: np.ndarray, ths: np.ndarray, parts: int) -> Iterator[tuple[int, Run]]:
    sizes = LENGTH - e["least"] + 8
    keys = np.zeros((len(sizes), LENGTH + 8), np.uint8)
    lefts = np.zeros((len(sizes), LENGTH - KGRAM), np.uint8)
    keys[:, :8] = e["gram"].astype(">u8").view(np.uint8).reshape(-1, 8)
    for i, buffer in enumerate(buffers):
        here = np.flatnonzero(e["segment"] == i)
        place = e["place"][here][:, None]
        right = np.arange(LENGTH)
        keys[here, 8:] = np.where(right < (LENGTH - e["least"][here])[:, None], buffer[np.minimum(place + right, len(buffer) - 1)], 0)
        left = np.arange(1, LENGTH - KGRAM + 1)
        lefts[here] = np.where(left <= e["most"][here][:, None], buffer[np.maximum(place - left, 0)], 0)
    columns = {"least": e["least"], "most": e["most"], "id": ids[e["row"]], "th": ths[e["row"]], "at": e["at"]}
    return sorted_runs(e["gram"], keys, sizes, lefts, columns, parts)


def first_difference(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(streams: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(stream, common prefix with the suffix before) in order of all streams' suffixes, by a loser tree.

    A player is (key, lcp, stream); lcp is its common prefix with the last
    winner, which all players on the path of that winner have been compared
    with. Bytes are looked at only where two players' prefixes are equal, and
    only after them.
    """
    size = 1
    while size < len(streams):
        size *= 2
    end = (None, -1, len(streams))

    def next_of(i: int) -> tuple:
        item = next(streams[i], None)
        return end if item is None else (item[0], item[1], i)

    def play(a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """Winner and loser; the loser's lcp is then that with the winner."""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[1] < 0:
            return a, b
        x, y = a[0], b[0]
        lcp = first_difference(x, y, a[1])
        if len(x) == lcp or (len(y) != lcp and x[lcp] < y[lcp]):
            return a, (y, lcp, b[2])
        return b, (x, lcp, a[2])

    losers: list[tuple] = [end] * size
    level = [next_of(i) if i < len(streams) else end for i in range(size)]
    # Against nothing yet: every player has prefix 0 with an empty winner.
    level = [(p[0], 0, p[2]) if p[1] >= 0 else p for p in level]
    node = size
    while node > 1:
        node //= 2
        up = []
        for i in range(node):
            won, losers[node + i] = play(level[2 * i], level[2 * i + 1])
            up.append(won)
        level = up
    winner = level[0]
    while winner[1] >= 0:
        yield winner[2], winner[1]
        node = (size + winner[2]) // 2
        winner = next_of(winner[2])
        while node:
            loser = losers[node]
            if winner[1] > loser[1]:
                pass
            elif winner[1] < loser[1]:
                winner, losers[node] = loser, winner
            else:
                winner, losers[node] = play(winner, loser)
            node //= 2


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's parts to spans; spans that runs decided pass through."""
    runs: dict[int, list[bytes]] = {}
    for batch in batches:
        blob = batch.column(1)
        for i, (part, is_run) in enumerate(zip(batch.column(0).to_pylist(), blob.is_valid().to_pylist(), strict=True)):
            if is_run:
                runs.setdefault(part, []).append(blob[i].as_py())
        through = batch.filter(blob.is_null())
        if through.num_rows:
            yield pa.record_batch([through.column(i) for i in range(2, 6)], names=["id", "th", "start", "end"])
    for part in sorted(runs):
        found = _decide([Run.unpack(b) for b in runs.pop(part)])
        if found is not None:
            yield pa.record_batch([pa.array(x) for x in found], names=["id", "th", "start", "end"])


def _decide(runs: list[Run]) -> tuple[np.ndarray, ...] | None:
    merged = list(merge([r.keys() for r in runs]))
    stream = np.array([s for s, _ in merged], np.int64)
    lcp = np.array([p for _, p in merged], np.int64)
    # The order of a run is kept, so its entries come as their stream's turn does.
    begins = np.cumsum([0, *(len(r.columns["lcp"]) for r in runs)])
    by_stream = np.argsort(stream, kind="stable")
    entry = np.empty(len(stream), np.int64)
    entry[by_stream] = np.arange(len(stream))
    e = {c: np.concatenate([r.columns[c] for r in runs])[entry].astype(k) for c, k in (("least", np.int64), ("most", np.int64), ("id", np.int64), ("th", np.int64), ("at", np.int64))}
    left_bytes = np.frombuffer(b"".join(r.lefts for r in runs), np.uint8)
    most = np.concatenate([r.columns["most"] for r in runs]).astype(np.int64)
    left_at = (np.cumsum(most) - most)[entry]
    del begins, merged, runs
    # Grams with one suffix are done.
    same = lcp >= 8
    several = same.copy()
    several[:-1] |= same[1:]
    keep = np.flatnonzero(several)
    if not len(keep):
        return None
    # What lies between two kept neighbours is of other grams, so their common prefix is below 8 there too.
    lcp = lcp[keep]
    e = {c: v[keep] for c, v in e.items()}
    left_at = left_at[keep]
    order = np.lexsort((e["at"], e["th"], e["id"]))
    removed_least = np.full(len(keep), LENGTH, np.int64)
    removed_most = np.full(len(keep), -1, np.int64)
    before = np.zeros(len(keep), _U)
    for o in range(LENGTH - KGRAM + 1):
        if o:
            more = e["most"] >= o
            before[more] = _mixed(before[more] * _U(_B) + _TABLE[left_bytes[left_at[more] + o - 1]])
        group = np.cumsum(lcp < 8 + LENGTH - o)
        use = order[(e["least"][order] <= o) & (e["most"][order] >= o)]
        if len(use) < 2:
            continue
        key = _mixed(before[use] + _mixed(group[use].astype(_U) * _U(_B)))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        lead = use[first[of]]
        again = (e["id"][use] != e["id"][lead]) | (e["th"][use] != e["th"][lead]) | (e["at"][use] != e["at"][lead])
        hit = use[again]
        removed_least[hit] = np.minimum(removed_least[hit], o)
        removed_most[hit] = o
    hit = removed_most >= 0
    return e["id"][hit], e["th"][hit], (e["at"] - removed_most)[hit], (e["at"] - removed_least + LENGTH)[hit]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result row of each document: its spans made one where they meet, and the hash of what is left."""
    for batch in batches:
        doc, th, text, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "th", "text", "spans"))
        raw = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            data, key = raw[i].as_py() or b"", th[i].as_py()
            own = sorted((s["start"], s["end"]) for s in spans[i].as_py() or () if s["th"] == key)
            runs: list[list[int]] = []
            for a, b in own:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            left = hashlib.sha256()
            place = 0
            for a, b in runs:
                left.update(data[place:a])
                place = b
            left.update(data[place:])
            rows.append((doc[i].as_py(), len(data), sum(b - a for a, b in runs), len(runs), left.hexdigest(), [a for a, _ in runs], [b for _, b in runs]))
        if rows:
            types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes, maximal removed runs and the hash of the bytes left.

    A byte goes if a string of LENGTH bytes that covers it starts earlier too:
    in a document of a smaller doc_id, or in its own. Null texts are empty. A
    null doc_id is smaller than all others (the least long counts as null). Rows of one doc_id with different
    texts are documents of their own, ordered by a hash of the text; rows of
    equal doc_id and text are one document and get the same result. A long text
    is cut into overlapping segments, each string of it in one of them. Texts
    shorter than LENGTH lose nothing. An empty table gives an empty result, and
    columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    n = partitions_for(spark, docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], TASK_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    own_id = F.coalesce("doc_id", F.lit(_NO_ID))
    # Rows of one doc_id, or without any, are told apart by their texts. Other rows of an equal key would only get grams that they lack.
    texts = texts.withColumn("key", F.xxhash64(own_id, "th"))
    anchors = texts.select(F.col("key").alias("id"), "text").mapInArrow(find_anchors, ANCHORS)
    # What a run repeats itself comes as direct rows: they go by document, so that a very common gram isn't one task's.
    anchors = anchors.repartition(n, F.when(F.col("kind") == 2, F.xxhash64("gram", "id")).otherwise(F.col("gram")))
    grams = anchors.mapInArrow(repeated_anchors, "id long, gram long").groupBy(F.col("id").alias("key")).agg(F.collect_list("gram").alias("grams"))
    # Both joins exchange the same columns of the texts by key, and ids are made after them, so Spark moves the texts once.
    chosen = texts.join(grams.hint("shuffle_hash"), "key")
    moved = chosen.select(own_id.alias("id"), "th", "text", "grams").mapInArrow(make_runs(n), MOVED)
    moved = moved.repartitionById(n, F.pmod("part", F.lit(n)))
    spans = moved.mapInArrow(merge_runs, SPANS).groupBy(F.xxhash64("id", "th").alias("key")).agg(F.collect_list(F.struct("th", "start", "end")).alias("spans"))
    return texts.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "th", "text", "spans").mapInArrow(cut_texts, RESULT)
