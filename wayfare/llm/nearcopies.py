"""Near copies at a similarity: SimHash in the Gray-order index, routed by MinHash, verified on whole sets of shingles.

Two texts link if their sets of five-word shingles have a Jaccard similarity of
``LEAST`` or more; a component is what links reach. SimHashes of two such texts
differ in 9.7 of 64 bits on average and now and then in 20, so cutting them into
blocks, one of which must be equal, can't bring them together. Texts are routed
by bands instead: the minima of ``ROWS`` hash functions over the shingles. A pair
at similarity s shares none with probability (1 - s ** ROWS) ** BANDS, 5e-5 at
0.8 and less above.

Bands alone say little: texts at 0.5 share one more often than not, and closed
over a web corpus that joins everything. So a band's members are compared first
by four bits of each of the minima: of two texts at 0.8 so many agree as
``AGREE`` asks but for one in 20,000, at 0.5 one in 1,500 does. What agrees is
joined to coarse components, and each text is sent once to its own. Only a band
that more than ``BUCKET`` texts share joins them unseen.

There the SimHashes are put into the Gray-order index and searched within
``BITS`` bits, which drops whole groups by the bits that their members share; a
link at LEAST lies within so many bits but for one in 600,000. What the search
leaves, and nothing else, is compared by its whole sets of shingles, unless the
links found so far connect it. A coarse component of more than ``CHUNK_BYTES`` is cut into chunks and
each pair of chunks meets in a group of its own, so none is too large; nothing
is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import blocks, partitions_for, stored, whole_text
from wayfare.llm.simhash import GrayIndex, _against, components, connected, gray_rank

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
SEED = 42
#: Of all the minima, those that agree in four bits, where a link isn't ruled out.
AGREE = 0.675
#: Different texts of one band that are compared by their minima.
BUCKET = 1024
#: Differing bits of SimHashes within which the index is searched.
BITS = 24
#: Of fewer shingles each turns more bits (12 of 64 on average where a set of four lies in one of five): the index is searched wider.
SHORT, SHORT_BITS = 16, 30
#: Bytes of text of a coarse component that meet as one chunk.
CHUNK_BYTES = 4 << 20
#: Bytes of text of coarse components that a task takes.
TASK_BYTES = 64 << 20
#: Bytes of text whose words a task holds at once, texts of the first block that is searched for, and pairs of a text and a node that a block makes.
PIECE_BYTES, FIRST_BLOCK, PAIRS = 1 << 20, 16, 1 << 17

WORD = re.compile(r"[^\W_]+")

_U = np.uint64
_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32), _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in a row, and where each text's begin. A text of fewer words than a shingle is one."""
    import xxhash

    lower = [t.decode("utf-8", "replace").lower() for t in texts]
    split = [WORD.findall(t) or t.split() for t in lower]
    counts = np.array([len(s) for s in split], np.int64)
    encoded = pa.array([w.encode("utf-8", "replace") for s in split for w in s], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, SEED) for w in encoded.dictionary.to_pylist()], _U)
    words = known[encoded.indices.to_numpy()] if len(known) else np.zeros(0, _U)
    # A text is filled up with zeros to one shingle at least.
    sizes = np.maximum(counts, SHINGLE)
    begins = np.cumsum(sizes) - sizes
    padded = np.zeros(int(sizes.sum()), _U)
    padded[np.arange(len(words)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)] = words
    grams = np.zeros(max(len(padded) - SHINGLE + 1, 0), _U)
    for i in range(SHINGLE):
        grams = _mixed(grams ^ padded[i : i + len(grams)])
    ends = begins + sizes - SHINGLE + 1
    inside = np.zeros(len(grams) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    starts = np.cumsum(ends - begins) - (ends - begins)
    return grams[np.cumsum(inside[:-1]) > 0], starts


def bands(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per text: the key of each band, and four bits of each of the minima, two to a byte."""
    low = (grams >> _U(32)).astype(np.uint32)
    keys, nibbles = np.empty((len(starts), BANDS), _U), np.zeros((len(starts), BANDS * ROWS + 1), np.uint8)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, _U)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat((low ^ _FLIP[k]) * _TIMES[k], starts)
            key = _mixed(key ^ least)
            nibbles[:, k] = _mixed(least.astype(_U)) >> _U(60)
        keys[:, b] = key
    return keys, nibbles[:, 0::2] << 4 | nibbles[:, 1::2]


#: How many of a byte's two halves are zero.
_ZEROS = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)


def agreeing(minima: np.ndarray) -> np.ndarray:
    """For each row of ``bands``' minima the first one that rows which agree connect it with."""
    n, least = len(minima), int(np.ceil(AGREE * BANDS * ROWS)) + 1  # the last half byte always agrees
    a, b = [], []
    for i in range(n - 1):
        near = np.flatnonzero(_ZEROS[minima[i] ^ minima[i + 1 :]].sum(axis=1, dtype=np.int32) >= least)
        a.append(np.full(len(near), i))
        b.append(near + i + 1)
    return components(n, np.concatenate(a), np.concatenate(b)) if n > 1 else np.arange(n)


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set of shingle hashes."""
    out = np.zeros(len(sets), _U)
    for i, s in enumerate(sets):
        total = np.zeros(64, np.int64)
        for k in range(0, len(s), 1 << 16):
            total += np.unpackbits(s[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
        out[i] = int.from_bytes(np.packbits(total * 2 > len(s)).tobytes(), "big")
    return out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's different shingles, sorted; words are held of ``PIECE_BYTES`` of text at a time."""
    out: list[np.ndarray] = []
    start = size = 0
    for i, text in enumerate([*texts, b""]):
        if (i == len(texts) and start < i) or (size and size + len(text) > PIECE_BYTES):
            grams, starts = shingles(texts[start:i])
            out += [np.unique(g) for g in np.split(grams, starts[1:])]
            start, size = i, 0
        size += len(text)
    return out


def verified(texts: list[bytes], least: float = LEAST) -> np.ndarray:
    """For each text the first one that links connect it with.

    All that is compared comes out of the Gray-order index. Texts are searched for
    in blocks, in Gray order. Of a group of copies most are one by the first block;
    what is connected with the largest group of then needn't be searched for any
    more, as its links to others are found from these.
    """
    sets = shingle_sets(texts)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(texts))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        near = (label[left] != label[right]) & (sizes[left] >= least * sizes[right] - 1e-9) & (sizes[right] >= least * sizes[left] - 1e-9)
        for p, q in zip(left[near].tolist(), right[near].tolist(), strict=True):
            if label[q] == label[p]:
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if both >= least * (len(sets[p]) + len(sets[q]) - both) - 1e-9:
                low, high = sorted((label[p], label[q]))
                label[label == high] = low

    codes = simhashes(sets)
    order = np.argsort(gray_rank(codes), kind="stable")
    index = GrayIndex(codes[order], np.zeros(len(order), np.int64))
    bits = BITS if sizes.min() >= SHORT else SHORT_BITS
    wanted, block, grown = order, FIRST_BLOCK, None
    while len(wanted):
        asked, wanted = wanted[:block], wanted[block:]
        for query, member in index.links(codes[asked], np.zeros(len(asked), np.int64), bits, whole_nodes=False):
            compare(asked[query], order[member])
        if grown is None:
            names, count = np.unique(label, return_counts=True)
            grown = int(names[count.argmax()]) if count.max() > 1 else None
        if grown is not None:
            wanted = wanted[label[wanted] != label[grown]]
        block = max(min(2 * block, PAIRS // len(texts)), FIRST_BLOCK)
    return label


def coarse_links(nodes: DataFrame) -> DataFrame:
    """Stars (fp, centre) of texts that share a band and agree in their minima. nodes: fp without repeats, keys and minima."""
    routed = nodes.select("fp", F.explode("keys").alias("key"))
    shared = routed.groupBy("key").agg(F.min("fp").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    met = stored(_against(routed, shared, "key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def stars(table: pa.Table) -> pa.RecordBatch:
            fps = table["fp"].to_numpy()
            label = agreeing(np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint8).reshape(len(fps), -1))
            moved = label != np.arange(len(fps))
            return pa.record_batch([pa.array(fps[moved]), pa.array(fps[label[moved]])], names=["fp", "centre"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = pa.Table.from_batches([batch.slice(start, end - start)])
                if held and end > start and held[-1]["key"][0].as_py() != key[start]:
                    yield stars(pa.concat_tables(held))
                    held = []
                if end > start:
                    held.append(part)
        if held:
            yield stars(pa.concat_tables(held))

    few = met.filter(F.col("n") <= BUCKET).select("key", "fp").join(nodes.select("fp", "minima"), "fp").select("key", "fp", "minima")
    seen = few.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "fp long, centre long")
    return seen.unionAll(met.filter(F.col("n") > BUCKET).select("fp", "centre")).filter("fp != centre").distinct()


def near_copy_links(docs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Stars (fp, centre) of verified links. docs: doc_id, fp and text; nodes: fp without repeats, its doc_id, n_bytes, keys and minima."""
    coarse = stored(connected(stored(coarse_links(nodes))))
    members = coarse.unionAll(coarse.selectExpr("centre", "centre").distinct()).join(nodes.select("fp", "doc_id", "n_bytes"), "fp")
    members = stored(members)
    sizes = members.groupBy("centre").agg(F.sum("n_bytes").alias("size"))
    chunks = stored(sizes.filter(F.col("size") > CHUNK_BYTES).select("centre", F.expr(f"cast((size + {CHUNK_BYTES - 1}) div {CHUNK_BYTES} as int)").alias("chunks")))
    dealt = members.join(chunks, "centre", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("fp", "doc_id", F.xxhash64("centre", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"))
    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    n = partitions_for(docs.sparkSession, total, TASK_BYTES)
    left, right = docs.alias("l"), dealt.alias("r")
    with_text = left.join(right, (F.col("l.fp") == F.col("r.fp")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))).select("r.group", "r.fp", "l.text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(texts: dict[int, bytes]) -> pa.RecordBatch:
            fps = np.array(list(texts), np.int64)
            centre = fps[verified(list(texts.values()), least)]
            moved = centre != fps
            return pa.record_batch([pa.array(fps[moved]), pa.array(centre[moved])], names=["fp", "centre"])

        group, held = None, {}
        for part, texts in blocks(batches):
            for g, fp, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                if g != group:
                    if len(held) > 1:
                        yield stars(held)
                    group, held = g, {}
                held[fp] = text
        if len(held) > 1:
            yield stars(held)

    return with_text.repartition(n, "group").sortWithinPartitions("group").mapInArrow(compare, "fp long, centre long")


def without_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, a null one last, then of the smallest hash of the text.

    Links join rows of equal text, and texts with a Jaccard similarity of
    ``least`` or more over the sets of their five-word shingles (lower-case runs
    of letters and digits; what lies between white space in a text without any). Null, empty and blank texts are one
    component. Rows that share a doc_id but no component don't affect each
    other. A very long text is compared as a whole, in a chunk of its own. An
    empty table gives an empty result.
    """
    fp, key = "fp", "id"
    while {fp, key} & set(docs.columns):
        fp, key = fp + "_", key + "_"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("fp"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches):
            keys, minima = bands(*shingles(raw))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([len(t) for t in raw], pa.int64()), listed, pa.array([m.tobytes() for m in minima], pa.binary())], names=["doc_id", "fp", "n_bytes", "keys", "minima"])

    prints = texts.mapInArrow(hashed, "doc_id long, fp long, n_bytes long, keys array<long>, minima binary")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.first("keys").alias("keys"), F.first("minima").alias("minima")))
    linked = connected(stored(near_copy_links(texts, nodes, least)))
    of = nodes.select("fp", "doc_id").join(linked, "fp", "left").select("fp", "doc_id", F.coalesce("centre", "fp").alias("centre"))
    first = of.groupBy("centre").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("s"))
    kept = stored(first.select(F.col("s.doc_id").alias("kept_id"), F.col("s.fp").alias("kept_fp")))
    rows = docs.withColumns({fp: F.xxhash64(whole_text()), key: F.col("doc_id").cast("long")})
    rows = rows.join(kept, (rows[fp] == kept["kept_fp"]) & rows[key].eqNullSafe(kept["kept_id"]), "left_semi")
    return rows.dropDuplicates([fp, key]).drop(fp, key)
