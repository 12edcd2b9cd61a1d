"""Repair of a conversation's structure by composing weighted finite-state machines.

Three machines meet. The *input* is an acceptor with one arc per row. The *edit
transducer* has one state: it keeps a row, gives it another role, deletes it, or
inserts an empty row, each at a cost. The *grammar* is an acceptor over the
initials of roles, ``(s?(ua)+)?``. A state of the composition is a place in the
input and a grammar state; states and arcs are made when the search reaches them,
and never for more than one place at a time.

Weights are pairs (cost, label string), ordered by cost, then by the string of the
edits' initials. The composition has no cycles but for insertions, which cost
something, so one pass in topological order (by place, insertions relaxed within
a place) gives the least weight of each state.

Strings are never compared or copied as a whole. At a place, each state's best
string is what it had when the last row was consumed, its *base*, and the
insertions since, its *tail*. Bases consume the same rows and end with the last
one's edit, so none is a proper prefix of another: their order is known from the
step before, and is kept as a rank. The edits themselves are back pointers, nine
bytes each, and the repaired text is hashed while it is read, a state of the hash
for each grammar state. So a conversation is a stream: what is held of it is its
back pointers and a digest per row, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Added where a row that ends in the middle of a sentence stays.
TRUNCATED_COST = 1
#: Roles that a row can be given, and that are inserted.
ROLES = ("user", "assistant")
#: From each state, by a role's initial, to the next: (s?(ua)+)?
GRAMMAR: dict[int, dict[str, int]] = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
START, FINAL = 0, (0, 3)
#: Initials of neighbours that the grammar allows.
LEGAL = frozenset(("su", "ua", "au"))

_BLANK = " \t\n\v\f\r"
_ENDS = ".!?"


@dataclass(slots=True)
class Best:
    """The least weight with which a state is reached: cost, rank of the base, tail; the last edit's number, and the hash of what is written so far (None: nothing)."""

    cost: int
    rank: int
    tail: str
    last: int
    digest: object

    def weight(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.tail


class Repair:
    """One conversation: rows go in by ``row``, in order; ``end`` gives the least path."""

    def __init__(self) -> None:
        # Edits as back pointers: the edit before, its label, and the role it writes (0 none, 1 the row's own, 2 and 3 ROLES).
        self.before, self.label, self.role = array("q"), bytearray(), bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.seen: set[bytes] = set()
        self.initial: str | None = None
        self.states = {START: Best(0, 0, "", -1, None)}
        self._insertions()

    def _edit(self, before: int, label: str, role: int) -> int:
        self.before.append(before)
        self.label.append(ord(label))
        self.role.append(role)
        return len(self.before) - 1

    @staticmethod
    def _written(digest: object, role: str, text: str) -> object:
        if digest is None:
            digest = hashlib.sha256()
        else:
            digest = digest.copy()
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        return digest

    def _insertions(self) -> None:
        """Arcs that consume no row, relaxed until nothing improves."""
        again = True
        while again:
            again = False
            for state, best in list(self.states.items()):
                for k, role in enumerate(ROLES):
                    to = GRAMMAR[state].get(role[0])
                    if to is None:
                        continue
                    weight = (best.cost + COST[INSERT], best.rank, best.tail + INSERT)
                    if to not in self.states or weight < self.states[to].weight():
                        self.states[to] = Best(*weight, self._edit(best.last, INSERT, 2 + k), self._written(best.digest, role, ""))
                        again = True

    def fault(self, role: str, text: str) -> str | None:
        """The first that holds of blank, duplicate and truncated."""
        from xxhash import xxh3_128_digest

        end = text.rstrip(_BLANK)
        if not end:
            return "blank"
        key = xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        if key in self.seen:
            return "duplicate"
        self.seen.add(key)
        return None if end[-1] in _ENDS else "truncated"

    def row(self, role: str, text: str) -> None:
        fault = self.fault(role, text)
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = role[:1]
        # The edit transducer's arcs that consume this row: label, cost, role written.
        arcs = [(DELETE, COST[DELETE], 0)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED_COST if fault else 0
            arcs += [(KEEP, COST[KEEP] + more, 1), *((REROLE, COST[REROLE] + more, 2 + k) for k in range(len(ROLES)))]
        reached: dict[int, tuple] = {}
        for state, best in self.states.items():
            for label, cost, writes in arcs:
                name = role if writes == 1 else ROLES[writes - 2]
                to = state if not writes else GRAMMAR[state].get(name[:1])
                if to is None:
                    continue
                weight = (best.cost + cost, best.rank, best.tail + label)
                if to not in reached or weight < reached[to][0]:
                    reached[to] = (weight, best, label, writes, name)
        ranks = {base: i for i, base in enumerate(sorted({weight[1:] for weight, *_ in reached.values()}))}
        self.states = {
            to: Best(weight[0], ranks[weight[1:]], "", self._edit(best.last, label, writes), self._written(best.digest, name, text) if writes else best.digest)
            for to, (weight, best, label, writes, name) in reached.items()
        }
        self._insertions()

    def end(self) -> Best:
        return min((self.states[s] for s in FINAL if s in self.states), key=Best.weight)

    def edits(self, last: int) -> tuple[str, bytes]:
        """Labels and role codes of a path, first to last."""
        labels, roles = bytearray(), bytearray()
        while last >= 0:
            labels.append(self.label[last])
            roles.append(self.role[last])
            last = self.before[last]
        return labels[::-1].decode(), bytes(roles[::-1])


EMPTY_SHA256 = hashlib.sha256().hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text (nulls: one space), each conversation in one partition and in order."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repairs(conversations: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation, with one row for the whole of it and one for each edit.

    conversations: conv_id, turn, role, text. A row of ``edit`` null has the
    conversation's counts (gaps, blank, duplicate, truncated, illegal, cost), its
    ``audit`` and ``repaired_sha256``. The others have ``place`` (from 0), ``edit``
    (K, R, D or I), ``role`` that is written (null: the row's own, or none) and
    ``row``, the place of the row in the conversation (null for insertions).

    Rows are taken by turn, nulls first, then by role and text. A null role or
    text is one space: it can't be kept, and a null text is blank. A null conv_id
    is a conversation of its own; repeated rows are duplicates. A role is known by
    its first character; an empty one has none. An empty table gives an empty
    result. Other columns are not read. A conversation is read by one task as a
    stream, since one hash runs over all of its text; memory grows by some 70
    bytes a row, and not with the texts.
    """
    kind = conversations.schema["conv_id"].dataType
    fields = [("conv_id", kind), *((c, T.LongType()) for c in COUNTS), ("audit", T.StringType()), ("repaired_sha256", T.StringType()), ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("row", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def finished(conv: object, repair: Repair, turns: tuple) -> Iterator[pa.RecordBatch]:
        least, most, distinct = turns
        best = repair.end()
        labels, roles = repair.edits(best.last)
        counts = {**repair.counts, "gaps": 0 if least is None else most - least + 1 - distinct, "cost": best.cost}
        sha = best.digest.hexdigest() if best.digest is not None else EMPTY_SHA256
        yield batch([{"conv_id": conv, **counts, "audit": labels, "repaired_sha256": sha}])
        row, held = 0, []
        for place, (label, role) in enumerate(zip(labels, roles, strict=True)):
            held.append({"conv_id": conv, "place": place, "edit": label, "role": ROLES[role - 2] if role > 1 else None, "row": None if label == INSERT else row})
            row += label != INSERT
            if len(held) == 10_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, turns, last = None, None, None, None
        for part in batches:
            for c, turn, role, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if repair is None or c != conv:
                    if repair is not None:
                        yield from finished(conv, repair, turns)
                    conv, repair, turns, last = c, Repair(), (None, None, 0), None
                if turn is not None and turn != last:
                    turns, last = (turn if turns[0] is None else turns[0], turn, turns[2] + 1), turn
                repair.row(role, text)
        if repair is not None:
            yield from finished(conv, repair, turns)

    return ordered(conversations).mapInArrow(search, schema)


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (gapless from 0), edit, role, text and the row's turn (null: inserted). found: what ``repairs`` gave."""
    edits = (stored(repairs(conversations)) if found is None else found).filter("edit is not null and edit != 'D'")
    by_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("row", (F.row_number().over(by_order) - 1).cast("long")).alias("r")
    joined = edits.alias("e").join(rows, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e.row") == F.col("r.row")), "left")
    place = F.row_number().over(Window.partitionBy("e.conv_id").orderBy("e.place")) - 1
    return joined.select("e.conv_id", place.cast("long").alias("place"), "e.edit", F.coalesce("e.role", "r.role").alias("role"), F.coalesce("r.text", F.lit("")).alias("text"), "r.turn")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after faults that CRC-32 of ``conv_id:turn``, divided by 20, decides: 0 drops a row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""

    def one(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``, after ``damaged``; zeros where no row is left."""
    found = stored(repairs(damaged(conversations))).filter("edit is null").select("conv_id", *COUNTS, "audit", "repaired_sha256").alias("f")
    every = conversations.select("conv_id").distinct().alias("c")
    joined = every.join(found, F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return joined.select("c.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
