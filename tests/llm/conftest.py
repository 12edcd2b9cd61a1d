import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
from tests_llm_helpers import prose  # noqa: E402

#: Extra columns whose names operators use for their own.
CLASH = "shard int, slot string, kept string, row int, id string, fp string, seed int, words string, blob string, h string, cell string, copies int, at int, stratum int, domain string, score int, rejected int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text, lang, source) as documents, with the clashing columns."""

    def frame(rows):
        extra = (7, "x", "y", 1, "i", "f", 2, "w", "b", "h", "c", 3, 4, 5, "d", 6, 8)
        return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA).repartition(3)

    return frame


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, prose(2, 300), "en", "a"), (2, prose(2, 300), "en", "a"), (2, prose(2, 300), "en", "a"), (2, "another text " + prose(3, 40), None, None),
        (3, None, "fr", "b"), (4, "", "fr", "b"), (5, " \n\t ", None, "a"), (6, long, "en", None), (7, long[:50_000] + " tail", "de", "a"),
        (None, prose(4, 120), "de", "b"), (None, None, None, None), (8, "¡Ünïcode — ñandú! \U0001f600 " * 30, "es", "c"), (9, "12345 67890", "es", "c"), (10, "x", "en", "a"), (11, prose(2, 299), "en", "b"),
    ]
