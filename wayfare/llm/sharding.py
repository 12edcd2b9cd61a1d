"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the r-th of a source's n
rows gets the fraction (2r - 1) / 2n, all rows are sorted by fraction, and the
sorted row is cut into shards of equal counts. Any stretch of it then holds the
sources in the proportions of the whole.

No rank is taken over a whole source or table. Rows are ranked within cells (a
source's range of hashes, then a range of fractions), and each cell's start is
known from small tables: counted for the first, and computed from the sources'
sizes alone for the second. A source with a third of all rows is thereby dealt
over all of its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import stored, whole_text

#: Ranges of hashes in a source, and of fractions over all; a power of two.
CELLS = 1 << 12


def proportional_shards(docs: DataFrame, shards: int = 40, seed: int = 7, cells: int = CELLS, content: Column | None = None) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (0, 1, ... within the shard); counts of shards differ by one at most.

    All columns stay; a column called shard or slot is replaced. Null sources
    are a source of their own. Rows with equal doc_id and text (nulls too) are
    separate rows; which of them comes first doesn't show. With fewer rows than
    shards the last shards are empty; an empty table gives an empty result.
    content: what tells rows of one doc_id apart in the seeded order; the
    CRC-32 of the text, if it isn't given.
    """
    content = F.crc32(whole_text().cast("binary")) if content is None else content
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("row"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), "doc_id", content).alias("h"),
        F.col("doc_id").alias("id"),
    ).withColumn("cell", F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1)).cast("int"))

    counted = stored(rows.groupBy("stratum", "cell").agg(F.count("*").alias("n_cell")))
    in_order = Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("stratum", "cell", F.coalesce(F.sum("n_cell").over(in_order), F.lit(0)).alias("before"), F.sum("n_cell").over(Window.partitionBy("stratum")).alias("n"))
    total = counted.agg(F.sum("n_cell")).first()[0] or 0

    by_hash = Window.partitionBy("stratum", "cell").orderBy("h", "id")
    ranked = rows.withColumn("rn", F.row_number().over(by_hash)).join(starts.hint("shuffle_hash"), ["stratum", "cell"]).withColumn("odd", 2 * (F.col("before") + F.col("rn")) - 1)
    ranked = ranked.select("row", "stratum", "odd", "n", F.expr(f"cast((odd * {cells}L) div (2 * n) as int)").alias("span"))

    # Rows of a source of size n whose fraction is below j / cells: (2nj + cells - 1) div (2 cells).
    spans = counted.groupBy("stratum").agg(F.sum("n_cell").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("span"))
    spans = spans.groupBy("span").agg(F.sum(F.expr(f"(2 * n * span + {cells - 1}) div {2 * cells}")).alias("first"))
    by_fraction = Window.partitionBy("span").orderBy(F.col("odd") / (2 * F.col("n")), "stratum", "odd")
    placed = ranked.withColumn("rn", F.row_number().over(by_fraction)).join(spans.hint("shuffle_hash"), "span").withColumn("at", F.col("first") + F.col("rn") - 1)

    size, larger = divmod(total, shards)
    cut = larger * (size + 1)
    if size:
        shard = F.expr(f"if(at < {cut}L, at div {size + 1}L, {larger}L + (at - {cut}L) div {size}L)")
        slot = F.expr(f"if(at < {cut}L, at % {size + 1}L, (at - {cut}L) % {size}L)")
    else:
        shard, slot = F.col("at"), F.lit(0)
    return placed.select("row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the text itself isn't moved."""
    lean = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source"),
        (F.octet_length(whole_text()) + 16).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
    )
    placed = proportional_shards(lean, shards, seed, content=F.col("text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
