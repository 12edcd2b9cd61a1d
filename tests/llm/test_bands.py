"""Compression bands: clean, encoded, random and templated texts of each length."""

import base64
import random
import string

import pytest
from tests_llm_helpers import prose

from wayfare.llm.quality import quality


def texts(size):
    rng = random.Random(size)
    letters = string.ascii_letters + string.digits
    # Base64 in lines of 4 characters has enough words for the base rule at any length.
    encoded = base64.b64encode(rng.randbytes(size)).decode()
    lines = "\n".join(encoded[i : i + 4] if size < 4096 else encoded[i : i + 76] for i in range(0, len(encoded), 4 if size < 4096 else 76))[:size]
    alnum = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(size))[:size]
    # No window of three words occurs twice, so the base rule passes it.
    templated = " ".join(f"xxxx{i:03d}" for i in range(size))[:size]
    clean = prose(size, max(60, size // 4), string.ascii_lowercase)[:size]
    return {"encoded": lines, "alnum": alnum, "templated": templated, "clean": clean}


@pytest.mark.parametrize("size", [450, 1000, 4000, 16_000, 60_000])
def test_bands_decide_at_each_length(make, size):
    kinds = texts(size)
    found = quality(make([(i, t, None, None) for i, t in enumerate(kinds.values())])).collect()
    got = {name: next(r for r in found if r.doc_id == i) for i, name in enumerate(kinds)}
    assert got["encoded"].verdict == got["alnum"].verdict == "incompressible"
    assert got["templated"].verdict == "repetitive"
    assert got["clean"].kept, got["clean"]


def test_chunks_of_noise_in_a_longer_text(make):
    noise = texts(60_000)["encoded"]
    half = prose(8, 1500)[:8192]
    row = quality(make([(1, half + noise[: 3 * 4096], None, None)])).first()
    assert not row.kept and row.bad_chunk_bytes >= 3 * 4096
