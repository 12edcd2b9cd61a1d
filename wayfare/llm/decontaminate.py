"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps; words under a zero may
differ. Seeds of the benchmark are looked up for each position of each document
and each mask. Around every hit the item and the document are aligned without
gaps and every window that holds the hit is compared word by word, so a passage
with some words replaced is found and a chance hit isn't.

The masks are chosen so that nothing is lost: whichever words of a window are
replaced, as long as LEAST_PERCENT of them are equal, one of the masks fits
into what is left of it. What the seeds find is thus exactly what comparing all
windows of all items with all places of all documents would find.

All of it is one stage of generated code over the documents: positions are
generated, hashed and looked up without a shuffle, and only verified overlaps
leave it. The benchmark is broadcast in blocks of bounded size; a larger
benchmark takes more blocks, each of them over all documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import stored, whole_text

#: Words compared at once (all of a shorter item), and the percentage of them that must be equal.
WINDOW_WORDS = 13
LEAST_PERCENT = 80
#: Masks for items of a window's words or more: each way to replace two of 13 words leaves one of them a place.
MASKS = ("11101011", "11001111")
#: Masks for shorter items, of SHORTEST words at least: the same for one of 7 to 9 words and two of 10 to 12. Items still shorter are looked up whole.
SHORT_MASKS = ("11111", "111011", "110111", "11010011")
SHORTEST = 7
#: Seeds of the benchmark that are broadcast at once; about 100 bytes each.
BLOCK_SEEDS = 500_000

#: A mask and the items, from so many to so many words, that it is for.
Mask = tuple[str, int, int]


def mask_plan(masks: Sequence[str] = MASKS, short_masks: Sequence[str] = SHORT_MASKS, window: int = WINDOW_WORDS) -> list[Mask]:
    whole = [("1" * n, n, n) for n in range(1, SHORTEST)]
    return [(m, window, 1 << 30) for m in masks] + [(m, SHORTEST, window - 1) for m in short_masks] + whole


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seeds(frame: DataFrame, plan: Sequence[Mask], items: bool) -> DataFrame:
    """frame has words; adds at (from 0), span and seed, for each mask (of an item: each that is for its size) and each place where it fits."""
    shortest = min(len(m) for m, _, _ in plan)
    # explode_outer: for explode the optimizer would infer a filter that computes the words once more.
    at = frame.withColumn("at", F.explode_outer(F.expr(f"sequence(0, greatest(size(words) - {shortest}, 0))")))

    def hashed(mask: str, least: int, most: int) -> Column:
        fits = F.col("at") + len(mask) <= F.size("words")
        if items:
            fits &= F.size("words").between(least, most)
        kept = [F.get("words", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(fits, F.struct(F.lit(len(mask)).alias("span"), F.xxhash64(F.lit(mask), *kept).alias("seed")))

    return at.withColumn("s", F.explode_outer(F.array(*[hashed(*m) for m in plan]))).filter("s is not null").withColumns({"span": F.col("s.span"), "seed": F.col("s.seed")}).drop("s")


def _verified(docs: DataFrame, benchmark: DataFrame, plan: Sequence[Mask] | None, window: int, least_percent: int, block_seeds: int) -> DataFrame:
    """doc_id, th (hash of the text), item_id and o: the best window of each."""
    plan = mask_plan(window=window) if plan is None else plan
    named = benchmark.select("item_id", words_of(whole_text()).alias("words"))
    # Items of one item_id with different texts are items of their own here, null ids too.
    items = stored(named.distinct().withColumn("item", F.xxhash64(F.col("item_id").isNull(), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.concat_ws(" ", "words"))))
    seeds = stored(_seeds(items, plan, items=True).select("seed", "item", F.col("at").alias("item_at"), "span").distinct())
    sizes = [r[0] for r in items.select(F.size("words")).distinct().collect()]
    used = [m for m in plan if any(m[1] <= n <= m[2] for n in sizes)] or list(plan[:1])
    blocks = max(1, -(-seeds.count() // block_seeds))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"), words_of(whole_text()).alias("words"))

    def verified(block: int) -> DataFrame:
        part = F.pmod("item", F.lit(blocks)) == block
        found = _seeds(texts, used, items=False).drop("span").join(F.broadcast(seeds.filter(part)), "seed")
        found = found.join(F.broadcast(items.filter(part).select("item", "item_id", F.col("words").alias("own"))), "item")
        # All windows that hold the hit lie from low to high in the item; the document's words are off by shift.
        found = found.withColumn("n", F.least(F.size("own"), F.lit(window))).withColumn("shift", F.col("at") - F.col("item_at"))
        found = found.withColumn("low", F.greatest(F.col("item_at") + F.col("span") - F.col("n"), F.lit(0))).withColumn("high", F.least(F.col("item_at") + F.col("n"), F.size("own")))
        same = "if(shift + i >= 0 and get(words, shift + i) = own[i], 1, 0)"
        found = found.withColumn("same", F.expr(f"transform(sequence(low, high - 1), i -> {same})"))
        windows = "transform(sequence(0, high - low - n), k -> struct(aggregate(slice(same, k + 1, n), 0, (a, x) -> a + x) as equal, -(low + shift + k) as before, n as n))"
        found = found.withColumn("o", F.array_max(F.expr(windows))).filter(F.col("o.equal") * 100 >= F.col("n") * least_percent)
        return found.select("doc_id", "th", "item_id", "o")

    return reduce(DataFrame.unionByName, [verified(b) for b in range(blocks)])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, plan: Sequence[Mask] | None = None, window: int = WINDOW_WORDS, least_percent: int = LEAST_PERCENT, block_seeds: int = BLOCK_SEEDS
) -> DataFrame:
    """doc_id, item_id, first_word, equal_words, compared_words: the best window of each document and item, the first of equally good ones.

    A window is WINDOW_WORDS words in a row of the item, or all of a shorter
    item; an item of fewer than SHORTEST words must be there without a change.
    Null and empty texts have no words and overlap nothing. Items of equal texts
    each count; of one item_id, null included, the best counts, whatever texts
    it has. Rows with one doc_id, null included, are one document. A very long
    text is one row of positions, looked up one by one. Empty tables give an
    empty result. Only doc_id, item_id and the texts are read. Another window or
    percentage needs masks of its own to lose nothing.
    """
    best = _verified(docs, benchmark, plan, window, least_percent, block_seeds).groupBy("doc_id", "item_id").agg(F.max("o").alias("o"))
    return best.select("doc_id", "item_id", (-F.col("o.before")).alias("first_word"), F.col("o.equal").alias("equal_words"), F.col("o.n").alias("compared_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document that overlaps an item: doc_id, n_items, item_ids in order, and the largest number of equal words. A null item_id counts, but isn't listed."""
    found = overlaps(docs, benchmark, **options).groupBy("doc_id")
    return found.agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("equal_words").alias("most_equal_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, plan: Sequence[Mask] | None = None, window: int = WINDOW_WORDS, least_percent: int = LEAST_PERCENT, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """``docs`` without the rows that overlap an item. A clean row stays, whatever else has its doc_id."""
    bad = _verified(docs, benchmark, plan, window, least_percent, block_seeds).select(F.col("doc_id").alias("bad_doc_id"), "th").distinct()
    # Written, so that its size is known: a small one is broadcast and the documents stay where they are.
    bad = stored(bad)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["th"]), "left_anti")
