"""A join of texts with a table of patterns: the first pattern that a text has.

Each alternative of a pattern has a literal part that any match must hold. Its
grams, ``GRAM`` characters each, are an index: a text meets a pattern only if the
text holds all grams of one alternative, so few pairs are verified by the pattern
itself. Alternatives without such a part meet every text; they should be few.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4
#: Patterns of which no literal part is known, at most: each of them is tried on every text.
LOOSE = 200
#: Grams of patterns that are sent to every task, at most; more of them meet the texts by a shuffle. Texts are never sent: a small file can hold a hundred times as many grams.
BROADCAST = 200_000

_META = set(".^$*+?{}[]\\|()")


def alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives at the outermost level."""
    out, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def literal(alternative: str) -> str:
    """The longest run of characters that any match holds as they stand, outside groups and classes; a character before a quantifier isn't sure."""
    if re.search(r"\(\?[a-zA-Z-]", alternative):  # flags may change what a character means
        return ""
    best, run, depth, i = "", "", 0, 0
    while i <= len(alternative):
        c = alternative[i] if i < len(alternative) else ""
        if c and c not in _META and not depth:
            run += c
        else:
            if c and c in "*?{":
                run = run[:-1]
            best = max(best, run, key=len)
            run = ""
            if c == "\\":
                i += 1
            elif c == "[":
                i = max(alternative.find("]", i + 2), i)
            elif c in ("(", ")"):
                depth += 1 if c == "(" else -1
            elif c == "{":
                i = max(alternative.find("}", i), i)
        i += 1
    return best


def index(patterns: DataFrame) -> DataFrame:
    """place, alternative and gram, with how many different grams the alternative has; a null gram where it has none. patterns: place and pattern."""

    def grams(rows):
        import pandas as pd

        for part in rows:
            out = []
            for place, pattern in zip(part["place"], part["pattern"], strict=True):
                for k, a in enumerate(alternatives(pattern)):
                    text = literal(a)
                    found = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
                    out += [(place, k, g, len(found)) for g in found] or [(place, k, None, 0)]
            yield pd.DataFrame(out, columns=["place", "alternative", "gram", "grams"])

    return patterns.select("place", "pattern").mapInPandas(grams, "place long, alternative int, gram string, grams int")


def first_match(rows: DataFrame, text: str, patterns: DataFrame, key: str = "id") -> DataFrame:
    """key and place of the first pattern, by place, that the row's text has; rows without any are left out.

    rows: a unique ``key`` and a column of text, folded as the patterns are; a null
    text has no pattern. patterns: place (unique) and pattern, Java's regular
    expressions. A null pattern matches nothing.
    """
    known = patterns.filter("pattern is not null").select(F.col("place").cast("long").alias("place"), "pattern")
    grams = index(known).persist()
    try:
        few = grams.count() <= BROADCAST
        loose = grams.filter("gram is null").select("place").distinct()
        n_loose = loose.count()
        if n_loose > LOOSE:
            raise ValueError(f"{n_loose} patterns have no literal part of {GRAM} characters; at most {LOOSE} can be tried on every text")
        loose_patterns = [r.place for r in loose.collect()]
    finally:
        grams.unpersist()
    to_tasks = F.broadcast if few else lambda df: df.hint("merge")
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    # Overlapping grams, in one pass over the text.
    held = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), 1))).alias("gram"))
    met = held.join(to_tasks(grams.filter("gram is not null")), "gram").groupBy("key", "place", "alternative").agg(F.count("*").alias("n"), F.first("grams").alias("grams")).filter("n = grams").select("key", "place").distinct()
    verified = met.join(to_tasks(known), "place").join(texts.hint("merge"), "key").filter(F.expr("text rlike pattern")).select("key", "place")
    if loose_patterns:
        tried = texts.select("key", "text", F.explode(F.array(*map(F.lit, loose_patterns))).alias("place")).join(F.broadcast(known.join(loose, "place")), "place")
        verified = verified.unionByName(tried.filter(F.expr("text rlike pattern")).select("key", "place"))
    return verified.groupBy("key").agg(F.min("place").alias("place")).withColumnRenamed("key", key)
