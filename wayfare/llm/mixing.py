"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets go down the tree: a node's budget is split among its children by weight,
and none gets more than its subtree holds (tokens times the epochs allowed).
What a short child leaves is split again among its siblings; only what all
children together can't hold was never given to their parent, and so went to
the parent's siblings. For one parent this is water filling, solved at once:
with children in order of capacity over weight, a child is full if the level at
which it fills needs no more than the budget.

A leaf then gives whole epochs, and of the next epoch, in that epoch's own
seeded order, the longest prefix of rows within what is left of its budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import stored

#: A leaf's rows meet its budget in so many groups, so that a large leaf isn't one group.
SALTS = 64
#: Hexadecimal digits of the seeded hash that name a cell: 3 give 4,096 cells a leaf.
CELL_DIGITS = 3

#: The default tree: the domain of a source, and weights among siblings. What isn't listed weighs 1, a domain's name then is "other".
DOMAINS: Mapping[str, Sequence[str]] = {
    "web": [f"src{i}" for i in range(10)],
    "books": [f"src{i}" for i in range(10, 15)],
    "reference": [f"src{i}" for i in range(15, 20)],
}
DOMAIN_WEIGHTS: Mapping[str, int] = {"web": 50, "books": 30, "reference": 20, "other": 1}
LANGUAGE_WEIGHTS: Mapping[str, int] = {"en": 50, "fr": 20, "de": 20, "es": 10}
SOURCE_WEIGHTS: Mapping[str, int] = {}

LEVELS = ("domain", "language", "origin")


def _lookup(of: Column, values: Mapping[str, object], default: object) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), of), F.lit(default))


def _water_fill(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """nodes: parent columns, budget (of the parent), capacity, weight. Returns them with budget: the node's own."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.col("capacity") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    upto, after = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(1, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    nodes = nodes.withColumn("held", F.sum("capacity").over(upto).cast(wide)).withColumn("rest", F.coalesce(F.sum("weight").over(after), F.lit(0)).cast(wide))
    full = (F.col("capacity").cast(wide) * F.col("rest")) <= (F.col("budget").cast(wide) - F.col("held")) * F.col("weight").cast(wide)
    nodes = nodes.withColumn("is_full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("capacity"))).over(siblings), F.lit(0))
    open_weight = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(siblings)
    nodes = nodes.withColumn("left_", left).withColumn("open_", open_weight)
    share = F.expr("if(is_full, capacity, cast((cast(left_ as decimal(38,0)) * weight) div open_ as bigint))")
    return nodes.withColumn("budget", share).drop("held", "rest", "is_full", "left_", "open_")


def leaf_budgets(supply: DataFrame, budget_percent: int, max_epochs: int, weights: Sequence[Mapping[str, int]]) -> DataFrame:
    """supply: the levels and tokens of each leaf. Returns them with budget, epochs (whole ones) and part (tokens of the next)."""
    leaves = supply.withColumn("capacity", F.col("tokens") * max_epochs)
    given = int(leaves.agg(F.sum("tokens")).first()[0] or 0)
    tree = leaves.withColumn("budget", F.lit(given * budget_percent // 100).cast("long"))
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = tree.groupBy(*path).agg(F.max("budget").alias("budget"), F.sum("capacity").alias("capacity"))
        nodes = _water_fill(nodes.withColumn("weight", _lookup(F.col(level), weights[depth], 1).cast("long")), LEVELS[:depth])
        tree = tree.drop("budget").join(nodes.select(*path, "budget"), list(path))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    return tree.withColumn("epochs", whole.cast("long")).withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("capacity")


def mix(
    docs: DataFrame,
    budget_percent: int = 80,
    max_epochs: int = 2,
    seed: str = "mix-1",
    domains: Mapping[str, Sequence[str]] = DOMAINS,
    weights: Sequence[Mapping[str, int]] = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS),
    tokens: Column | None = None,
) -> DataFrame:
    """Every row of ``docs``, as the struct ``row``, with its leaf, its tokens, the leaf's budget, and copies: how often the mixture has it.

    The total is ``budget_percent`` of the tokens there are, at most what
    ``max_epochs`` give. tokens: a row's tokens; if none are given, a quarter of
    its bytes, rounded up. Null language or source: ``unknown``. Null or empty
    text: no tokens, and as many copies as a row of its place in the order gets.
    Rows alike in all columns are rows of their own. Rows of one doc_id come in
    the order of a hash of language, source and text, and those without one are
    dealt by that hash. A very long text is one row, taken or left as a whole.
    Empty table: empty result.
    Columns of any names stay within ``row``.
    """
    count = F.expr("cast((octet_length(coalesce(text, '')) + 3) div 4 as bigint)") if tokens is None else tokens.cast("long")
    content = F.xxhash64("lang", "source", "text", count)
    of_source = {s: d for d, names in domains.items() for s in names}
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), content.cast("string"))).alias("id"),
        content.alias("content"),
        F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.coalesce("source", F.lit("unknown")).alias("origin"),
        count.alias("n_tokens"),
    ).withColumn("domain", _lookup(F.col("origin"), of_source, "other"))

    supply = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    budgets = stored(leaf_budgets(supply, budget_percent, max_epochs, weights))
    dealt = budgets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.hash("id", "content"), F.lit(SALTS)))
    planned = salted.join(dealt.hint("shuffle_hash"), [*LEVELS, "salt"]).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), "id")))
    planned = planned.withColumn("cell", F.substring("h", 1, CELL_DIGITS))

    cells = stored(planned.groupBy(*LEVELS, "cell").agg(F.sum("n_tokens").alias("n_cell")))
    # Sums before a cell in two levels: of the cells with the same first digit, then of the digits.
    digit = F.substring("cell", 1, 1).alias("digit")
    in_digit = Window.partitionBy(*LEVELS, "digit").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_leaf = Window.partitionBy(*LEVELS).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = cells.groupBy(*LEVELS, digit).agg(F.sum("n_cell").alias("n_digit")).select(*LEVELS, "digit", F.coalesce(F.sum("n_digit").over(in_leaf), F.lit(0)).alias("first"))
    starts = cells.select("*", digit).withColumn("inner", F.coalesce(F.sum("n_cell").over(in_digit), F.lit(0))).join(digits, [*LEVELS, "digit"]).select(*LEVELS, "cell", (F.col("first") + F.col("inner")).alias("before"))
    upto = Window.partitionBy(*LEVELS, "cell").orderBy("h", "id", "content").rowsBetween(Window.unboundedPreceding, 0)
    summed = planned.withColumn("within", F.sum("n_tokens").over(upto)).join(starts.hint("shuffle_hash"), [*LEVELS, "cell"])
    taken = (F.col("part") > 0) & (F.col("before") + F.col("within") <= F.col("part"))
    return summed.select("row", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("epochs") + taken.cast("long")).alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it has copies."""
    chosen = mix(docs, **options).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.expr("cast((octet_length(coalesce(text, '')) + 3) div 4 as bigint)").alias("n"), F.lit("").alias("text"))
    return mix(lean, tokens=F.col("n"), **options).select("row.doc_id", *LEVELS, "n_tokens", "leaf_budget", "copies")
