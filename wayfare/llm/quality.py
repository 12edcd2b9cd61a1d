"""Quality rules: word and line statistics, and zstandard compression bands.

Repetitive text compresses far better than prose, random or encoded text far
worse. How well prose compresses depends on how much of it there is, so each
band of lengths has its own limits: for the whole text, and for fixed chunks of
it, where a part that repeats or is random shows although the rest hides it in
the whole text's ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.common import blocks

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Limits for pieces of ``below`` bytes at most: raw bytes over compressed bytes."""

    below: int
    least: float
    most: float


#: Bands by length in bytes. The least lies between base64 or random letters and digits and the clean texts of that
#: length, the most somewhat above the clean ones; a piece under the first bound isn't judged.
BANDS = (
    Band(256, 0.0, float("inf")),
    Band(512, 1.3, 2.1),
    Band(1024, 1.38, 2.4),
    Band(4096, 1.5, 3.0),
    Band(16384, 1.8, 3.2),
    Band(1 << 62, 2.0, 3.4),
)
#: The same for the chunks of a text of several.
CHUNK_BANDS = (
    Band(256, 0.0, float("inf")),
    Band(512, 1.3, 2.1),
    Band(1024, 1.33, 2.4),
    Band(4096, 1.6, 3.0),
    *BANDS[4:],
)
CHUNK_BYTES = 4096
#: A text is rejected if more than this share of its chunks' bytes lies outside the limits.
BAD_CHUNK_SHARE = 0.5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_bytes long, zstd_ratio double, chunk_ratio_min double, chunk_ratio_max double, bad_chunk_bytes long, verdict string"
)


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1].astype(np.int64) << 32 | ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def outside(size: int, ratio: float, bands: tuple[Band, ...]) -> str:
    band = next(b for b in bands if size <= b.below)
    return "repetitive" if ratio > band.most else "incompressible" if ratio < band.least else ""


def quality(docs: DataFrame, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_CHUNK_SHARE, level: int = 3, chunk_bands: tuple[Band, ...] = CHUNK_BANDS) -> DataFrame:
    """One row per row of ``docs``: statistics, whether the base rule fails, and whether the text is kept.

    verdict says why a text goes: ``base``, ``repetitive``, ``incompressible``
    (whole text) or ``chunks``; it is ``kept`` otherwise. A null or empty text
    has no words and so fails the base rule; its ratio is 1. Repeated rows give
    repeated results, a null doc_id stays null, an empty table gives an empty
    result, columns other than doc_id and text are not read. Chunks are cut by
    bytes from the text's start; a last piece shorter than the first band's bound
    isn't judged.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

        def ratio(piece: bytes) -> float:
            return len(piece) / len(press.compress(piece)) if piece else 1.0

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for part, texts in blocks(batches):
            out: dict[str, list] = {n: [] for n in names[1:]}
            split = [t.split() for t in texts]
            ids = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
            start = 0
            for text, words in zip(texts, split, strict=True):
                n = len(words)
                repeats = repeated_words(ids[start : start + n])
                start += n
                chars = sum(map(len, words)) if text.isascii() else len(text.decode("utf-8", "replace").translate(_DROP_SPACES))
                failed = n < 50 or 100 * repeats > 50 * n
                whole = ratio(text)
                sizes = [min(chunk_bytes, len(text) - i) for i in range(0, len(text), chunk_bytes)]
                ratios = [whole] if len(sizes) == 1 else [ratio(text[i * chunk_bytes : i * chunk_bytes + s]) for i, s in enumerate(sizes)]
                limits = bands if len(sizes) == 1 else chunk_bands
                bad = sum(s for s, r in zip(sizes, ratios, strict=True) if outside(s, r, limits))
                why = "base" if failed else outside(len(text), whole, bands) or ("chunks" if bad > bad_share * len(text) else "kept")
                row = (n, chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), repeats, failed, why == "kept", len(text), whole, min(ratios, default=1.0), max(ratios, default=1.0), bad, why)
                for name, value in zip(names[1:], row, strict=True):
                    out[name].append(value)
            yield pa.record_batch([part.column(0), *(pa.array(v) for v in out.values())], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, SCHEMA)


_DROP_SPACES = dict.fromkeys(SPACES)
