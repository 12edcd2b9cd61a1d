"""Repairs of conversations against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from wayfare.llm import repair

SCHEMA = "conv_id long, turn int, role string, text string, cost int, audit string, place int, row string, edit int, copy int"


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], SCHEMA).repartition(3)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def by_hand(rows):
    """Cost, audit and repaired rows: all edit strings by cost, then by the string, until one is legal."""
    found = faults(rows)
    heap = [(0, "", 0, ())]
    legal, possible = re.compile(r"(s?(ua)+)?"), re.compile(r"(s?(ua)*u?)?")
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(r[:1] if r[:1] else "-" for r, _ in out)
        if at == len(rows) and legal.fullmatch(initials):
            return cost, audit, list(out)
        if not possible.fullmatch(initials):
            continue
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*out, (new, text))))
        for new in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (new, ""))))
    raise AssertionError


def expected(conv_rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of rows (turn, role, text) after damage."""
    conv_rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in conv_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    rows = [(r, x) for _, r, x in conv_rows]
    turns = [t for t, *_ in conv_rows if t is not None]
    kinds = faults(rows)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    cost, audit, out = by_hand(rows)
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def some_conversations(n, seed=7):
    rng = random.Random(seed)
    texts = ["Hello.", "Why?", "no end", "", " \n", "Sí — ñandú!", "a.b", "Hello. ", " ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", None]
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 7)):
            rows.append((c if c else None, rng.choice([k, k, k + 1, 2 * k, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_repairs_are_the_exhaustive_searchs(talks):
    rows = some_conversations(150)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repairs(talks(rows)).filter("edit is null").collect()}
    by_conv = {}
    for c, *rest in rows:
        by_conv.setdefault(c, []).append(rest)
    assert got == {c: expected(r) for c, r in by_conv.items()}


def test_repaired_rows_hash_to_the_digest(talks):
    rows = some_conversations(60, 11)
    found = {r.conv_id: r.repaired_sha256 for r in repair.repairs(talks(rows)).filter("edit is null").collect()}
    out = {c: [] for c in found}
    for r in sorted(repair.repaired(talks(rows)).collect(), key=lambda r: r.place):
        assert r.place == len(out[r.conv_id]) and (r.turn is None or r.edit in "KR")
        out[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in out.items()} == found
    for lines in out.values():
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[:1] for x in lines))


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text)
            out += [row, row] if k == 3 else [row]
    return out


def test_digest_of_damaged_conversations(talks):
    rng = random.Random(2)
    rows = [(c, t, ("user", "assistant")[t % 2] if t or c % 3 else "system", f"Text {rng.randint(0, 3)} of {t}" + rng.choice([".", "?", "", " x! "])) for c in range(120) for t in range(rng.randint(1, 6))]
    rows += [(1000 + c, 0, "user", "x.") for c in range(60)] + some_conversations(40, 5)
    by_conv = {c: [] for c, *_ in rows}
    for c, *rest in damage(rows):
        by_conv[c].append(rest)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_digest(talks(rows)).collect()}
    assert got == {c: expected(r) for c, r in by_conv.items()} and any(not r for r in by_conv.values())
    assert repair.repair_digest(talks([])).count() == 0


def test_a_long_conversation_and_a_long_text(talks):
    long = "word " * 200_000 + "."
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000) if t % 7] + [(2, 0, "user", long), (2, 1, "assistant", long + "x")]
    got = {r.conv_id: r for r in repair.repairs(talks(rows)).filter("edit is null").collect()}
    # Of each turn that is missing the neighbours have one role, so one row is inserted there.
    missing = len(range(0, 3000, 7))
    assert (got[1].gaps, got[1].cost, got[1].audit.count("I"), len(got[1].audit)) == (missing - 1, 2 * missing, missing, 3000)
    assert got[2].cost == 1 and got[2].audit == "KK" and got[2].truncated == 1
