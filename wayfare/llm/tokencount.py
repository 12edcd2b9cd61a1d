"""Token counts without token ids.

A pre-token is a run of characters between ASCII white space. The vocabulary
splits at white space and never joins across it, so the tokens of a text are
the sum over its pre-tokens.

*Vocabulary.* Distinct pre-tokens and how often they occur are one aggregate,
combined per block and per task before its exchange. The library counts the
pieces of each distinct pre-token once, in a table by name: the pre-token
itself, or the 128-bit digest of a long one.

*Join.* That table meets the frequencies of the documents in two parts. The
most frequent pre-tokens, at most ``HOT_ENTRIES``, are broadcast: they make up
nearly all occurrences, and every pre-token that could skew an exchange is
among them. The frequencies of all others are exchanged and joined by name,
and their sums added. No text and no ids are moved.

A special token's string inside a text never holds white space, so it lies in
one pre-token and is treated there as the library treats it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import blocks, stored

#: Pre-tokens that are broadcast: at most so many, each with a name of 16 bytes at most and its count.
HOT_ENTRIES = 250_000
#: Steps of frequency, per doubling, among which the least one of a broadcast pre-token is chosen.
STEPS = 8
#: A pre-token of so many bytes or more goes by its digest, which has just so many: no short name is one.
DIGEST_BYTES = 16

PARTS = "key long, doc_id long, n_bytes long, n_pretokens long, hot_tokens long, rare array<struct<name: binary, times: long>>"


def _names(words: list[bytes]) -> list[bytes]:
    import xxhash

    return [w if len(w) < DIGEST_BYTES else xxhash.xxh128_digest(w) for w in words]


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of all texts, the place among them of each occurrence, and where each text's occurrences end."""
    words: list[bytes] = []
    ends = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words += text.split()
        ends[i] = len(words)
    encoded = pa.array(words, pa.binary()).dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(), ends


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in blocks(batches):
        words, at, _ = _split(texts)
        yield pa.record_batch([pa.array(words, pa.binary()), pa.array(np.bincount(at, minlength=len(words)))], names=["word", "times"])


def piece_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """name, times and pieces of each distinct pre-token of ``docs``; the library sees each of them once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for part, words in blocks(batches, text="word"):
            found = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
            yield pa.record_batch(
                [pa.array(_names(words), pa.binary()), part.column(1), pa.array([len(e) for e in found], pa.int64())],
                names=["name", "times", "pieces"],
            )

    distinct = docs.select("text").mapInArrow(_occurrences, "word binary, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return distinct.mapInArrow(count, "name binary, times long, pieces long")


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``counted``: as many whole steps of frequency as hold ``most`` rows or fewer."""
    step = F.floor(F.log2("times") * STEPS).cast("int")
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    return counted.filter(step >= least) if least is not None else counted.limit(0)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: bytes, tokens, pre-tokens, and whether the tokens exceed ``limit``.

    A null or empty text has no tokens. Repeated rows give repeated results, a
    null doc_id stays null, an empty table gives an empty result; a very long
    text is split as a whole, in a block of its own; columns other than doc_id
    and text are not read.
    """
    counted = stored(piece_counts(docs, tokenizer_path))
    hot = _frequent(counted, hot_entries).select("name", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(hot["name"].to_pylist(), hot["pieces"].to_pylist(), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # Rows are told apart by task and place; the result is written, so both hold.
        key = TaskContext.get().partitionId() << 40
        rare_type = pa.struct([("name", pa.binary()), ("times", pa.int64())])
        for part, texts in blocks(batches):
            words, at, ends = _split(texts)
            called = _names(words)
            pieces = np.fromiter((known.get(w, -1) for w in called), np.int64, len(words))
            each = pieces[at] if len(words) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(np.maximum(each, 0))])
            begins = np.concatenate([[0], ends[:-1]])
            rare = np.flatnonzero(each < 0)
            row = np.searchsorted(ends, rare, side="right")
            pairs, times = np.unique(row * max(len(words), 1) + at[rare], return_counts=True) if len(rare) else (np.zeros(0, np.int64),) * 2
            of, word = np.divmod(pairs, max(len(words), 1))
            entries = pa.StructArray.from_arrays([pa.array([called[w] for w in word.tolist()], pa.binary()), pa.array(times.astype(np.int64))], fields=list(rare_type))
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(key + np.arange(len(texts))), part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(ends - begins),
                    pa.array(total[ends] - total[begins]), pa.ListArray.from_arrays(pa.array(offsets), entries),
                ],
                names=["key", "doc_id", "n_bytes", "n_pretokens", "hot_tokens", "rare"],
            )
            key += len(texts)

    parts = stored(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, PARTS))
    rare = parts.select("key", F.explode("rare").alias("r")).select("key", "r.name", "r.times").join(counted.select("name", "pieces"), "name")
    sums = rare.groupBy("key").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare_tokens"))
    tokens = F.col("hot_tokens") + F.coalesce("rare_tokens", F.lit(0))
    return parts.join(sums, "key", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), "n_pretokens", (tokens > limit).alias("over_limit"))
