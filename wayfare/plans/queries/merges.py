"""Identity, merges, suppression and sweeps over orders, lineitem and other keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import dedup, merge, summaries
from wayfare.operators.filters import disrupted, unseen
from wayfare.plans import serving
from wayfare.plans.ingest import upserted
from wayfare.plans.queries import Group, table

group = Group()


@group("""SELECT * EXCLUDE (nth) REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS nth FROM lineitem) WHERE nth = 1""")
def batch_dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    last = dedup.last_wins(items, ["l_orderkey", "l_linenumber"], [F.col(c) for c in rest])
    return last.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


#: Stored: orders not divisible by 6. Incoming: even ones, dearer by 10, with no clerk's note where the key is divisible by 4.
SQL_EXISTING = "(SELECT o_orderkey AS id, 's' || o_custkey % 4 AS source_id, 'o' || o_orderkey AS external_id, o_orderpriority AS title, o_totalprice AS price FROM orders WHERE o_orderkey % 6 <> 0)"
SQL_INCOMING = "(SELECT 's' || o_custkey % 4 AS source_id, 'o' || o_orderkey AS external_id, CASE WHEN o_orderkey % 4 <> 0 THEN lower(o_orderpriority) END AS title, o_totalprice + 10 AS price FROM orders WHERE o_orderkey % 2 = 0)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    key = [F.concat(F.lit("s"), F.col("o_custkey") % 4).alias("source_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("external_id")]
    existing = orders.filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("id"), *key, F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    title = F.when(F.col("o_orderkey") % 4 != 0, F.lower("o_orderpriority"))
    return existing, orders.filter("o_orderkey % 2 = 0").select(*key, title.alias("title"), (F.col("o_totalprice") + 10).alias("price"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = sides(spark, sf_dir)
    return merge.merged(existing, incoming, ["source_id", "external_id"], {"title": F.col("n.title"), "price": F.col("n.price")}, {})


SQL_MERGED = f"""(SELECT coalesce(e.source_id, n.source_id) AS source_id, coalesce(e.external_id, n.external_id) AS external_id, e.id,
  CASE WHEN n.external_id IS NOT NULL THEN n.title ELSE e.title END AS title, CASE WHEN n.external_id IS NOT NULL THEN n.price ELSE e.price END AS price,
  CASE WHEN e.external_id IS NULL THEN 'inserted' WHEN n.external_id IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM {SQL_EXISTING} e FULL JOIN {SQL_INCOMING} n ON e.source_id = n.source_id AND e.external_id = n.external_id)"""


@group(f"SELECT * REPLACE (coalesce(id, -1) AS id) FROM {SQL_MERGED}")
def upsert_merge(spark, sf_dir):
    return merged(spark, sf_dir).withColumnRenamed("_change", "change").withColumn("id", F.coalesce("id", F.lit(-1)))


@group(f"SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated FROM {SQL_MERGED}")
def upsert_counts(spark, sf_dir):
    return merge.change_counts(merged(spark, sf_dir))


@group("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 'new ' || c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 0""")
def insert_or_ignore(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    offered = customers.withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    return merge.insert_or_ignore(customers.filter("c_custkey % 5 <> 0"), offered, ["c_custkey"])


#: News: the key is the customer, the source the priority; stored are odd orders, incoming even ones.
SQL_NEWS = "SELECT o_orderkey AS id, o_orderpriority AS source_id, 'o' || o_orderkey AS external_id, CASE WHEN o_custkey % 10 <> 0 THEN 'c' || o_custkey END AS dedup_key, o_orderdate AS start_at FROM orders"
SQL_COPIES = f"""FROM ({SQL_NEWS} WHERE o_orderkey % 2 = 0) n JOIN ({SQL_NEWS} WHERE o_orderkey % 2 = 1) e
  ON n.dedup_key = e.dedup_key AND n.source_id <> e.source_id AND abs(epoch_ms(n.start_at) - epoch_ms(e.start_at)) <= 14 * 86400000"""


def news(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("external_id"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("c"), "o_custkey")).alias("dedup_key"), F.col("o_orderdate").cast("timestamp").alias("start_at"),
    )
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


@group(f"SELECT o_orderpriority AS source_id, 'o' || o_orderkey AS external_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT n.id {SQL_COPIES})")
def cross_source_suppress_kept(spark, sf_dir):
    incoming, existing = news(spark, sf_dir)
    return dedup.not_suppressed(incoming, existing).select("source_id", "external_id")


@group(f"SELECT DISTINCT n.source_id, n.external_id, n.dedup_key {SQL_COPIES}")
def cross_source_suppress_dropped(spark, sf_dir):
    incoming, existing = news(spark, sf_dir)
    return dedup.suppressed(incoming, existing).select("source_id", "external_id", "dedup_key")


@group(f"SELECT n.source_id, n.external_id, n.dedup_key, arg_min(e.source_id, e.id) AS of_source_id, arg_min(e.external_id, e.id) AS of_external_id, min(e.id) AS of_id {SQL_COPIES} GROUP BY 1, 2, 3")
def cross_source_suppress_listing(spark, sf_dir):
    return dedup.suppressed(*news(spark, sf_dir))


SQL_SWEPT = """(SELECT *, o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderkey % 4 <> 0 AS flipped FROM orders)"""


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("external_id"), F.col("o_orderpriority").alias("source_id"), F.when(F.col("o_orderstatus") == "O", "scheduled").otherwise(F.col("o_orderstatus")).alias("state"),
        F.col("o_orderdate").alias("start_at"), F.col("o_orderdate").alias("updated_at"),
    )
    now, end = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1999-01-01"))
    return merge.cancel_missing(rows, "2-HIGH", now, end, rows.filter("external_id % 4 = 0"))


@group(f"SELECT o_orderkey AS external_id, CASE WHEN flipped THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'scheduled' ELSE o_orderstatus END AS state, flipped FROM {SQL_SWEPT}")
def absence_sweep(spark, sf_dir):
    return swept(spark, sf_dir).select("external_id", "state", F.col("_flipped").alias("flipped"))


@group(f"SELECT count(*) FILTER (flipped) AS cancelled FROM {SQL_SWEPT}")
def absence_sweep_count(spark, sf_dir):
    return swept(spark, sf_dir).agg(F.count_if("_flipped").alias("cancelled"))


@group("SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey, s_name FROM supplier")
def snapshot_replace(spark, sf_dir):
    snapshot = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # Cells of a thousand keys, in their order: ids follow the key, as the SQL's do.
    return merge.with_new_ids(snapshot, ["s_suppkey"], 0, "n", cell=F.floor(F.col("s_suppkey") / 1000)).select("n", "s_suppkey", "s_name")


@group("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality-' || l.quality ELSE 'lang-' || d.lang END AS reason,
  CASE WHEN d.doc_id IS NOT NULL THEN 1 ELSE 2 END AS first_seen, CASE WHEN l.doc_id IS NOT NULL THEN 2 ELSE 1 END AS last_seen
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def quarantine_refresh(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("lang-"), "lang").alias("reason"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"))
    incoming = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality-"), "quality").alias("reason"))
    seen = F.lit(2)
    return merge.merged(existing, incoming, ["doc_id"], {"reason": F.col("n.reason"), "last_seen": seen}, {"first_seen": seen, "last_seen": seen}).drop("_change")


@group("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS severity FROM orders WHERE o_orderpriority <> '5-LOW' ORDER BY 3, 1""")
def alerts_severity_order(spark, sf_dir):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "interrumpido").when(F.col("o_orderpriority") == "2-HIGH", "restringido").otherwise("normal")
    level = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "sin nivel").when(F.col("o_orderpriority") == "3-MEDIUM", "lento").otherwise(level)
    rows = table(spark, sf_dir, "orders").filter(disrupted(level)).select("o_orderkey", "o_orderpriority", summaries.severity(level).alias("severity"))
    return rows.orderBy("severity", "o_orderkey")


@group("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def region_lookup(spark, sf_dir):
    regions = table(spark, sf_dir, "region").filter("r_name = 'ASIA'")
    return table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


#: Regions of the first level, nations below them, and a chain of suppliers below the first nation.
SQL_TREE = """(SELECT r_regionkey AS id, NULL AS parent_id, lower(r_name) AS slug FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, lower(n_name) FROM nation
  UNION ALL SELECT 1000 + s_suppkey, CASE WHEN s_suppkey = 1 THEN 100 ELSE 999 + s_suppkey END, 's' || s_suppkey FROM supplier WHERE s_suppkey <= 10)"""


@group(f"""WITH RECURSIVE tree AS (SELECT id, slug AS path, 1 AS depth FROM {SQL_TREE} WHERE parent_id IS NULL
  UNION ALL SELECT r.id, t.path || '/' || r.slug, t.depth + 1 FROM {SQL_TREE} r JOIN tree t ON r.parent_id = t.id) SELECT id, path, depth FROM tree""")
def region_paths(spark, sf_dir):
    """A tree of twelve levels: the chain of the first ten suppliers is its depth, not a part of the table."""
    regions = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as long) id", "cast(null as long) parent_id", "lower(r_name) slug")
    nations = table(spark, sf_dir, "nation").selectExpr("cast(100 + n_nationkey as long)", "cast(n_regionkey as long)", "lower(n_name)")
    chain = table(spark, sf_dir, "supplier").filter("s_suppkey <= 10").selectExpr("cast(1000 + s_suppkey as long)", "cast(if(s_suppkey = 1, 100, 999 + s_suppkey) as long)", "concat('s', s_suppkey)")
    return serving.region_tree(regions.union(nations).union(chain)).select("id", F.array_join("path", "/").alias("path"), F.size("path").alias("depth"))


@group("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def orphan_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return unseen(table(spark, sf_dir, "lineitem"), parents, "l_orderkey").select("l_orderkey", "l_linenumber")


@group("""SELECT CASE WHEN k % 6 = 0 THEN 'inserted' WHEN k % 2 = 0 THEN 'updated' ELSE 'kept' END AS _change, count(*) AS n, count(*) AS with_ingested,
  count(*) FILTER (k % 2 = 0) AS with_updated FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1""")
def upsert_events_table(spark, sf_dir):
    """The events table's own upsert, over rows made from orders: every column by its policy."""
    from wayfare import schemas

    orders = table(spark, sf_dir, "orders")
    base = {"id": "o_orderkey", "source_id": "o_orderpriority", "external_id": "cast(o_orderkey as string)", "title": "o_orderstatus", "start_at": "cast(o_orderdate as timestamp)", "state": "'scheduled'", "category": "'civil'", "region_id": "1L"}
    at = F.lit("2002-01-01").cast("timestamp")
    empty = spark.createDataFrame([], schemas.EVENTS)
    stored = orders.filter("o_orderkey % 6 <> 0").select(*[F.expr(base.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in empty.schema]).withColumn("ingested_at", at)
    incoming = orders.filter("o_orderkey % 2 = 0").select(*[F.expr(base.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in empty.schema if f.name not in ("id", "ingested_at", "updated_at")])
    return upserted(stored, incoming, F.lit("2003-01-01").cast("timestamp")).groupBy("_change").agg(F.count("*").alias("n"), F.count("ingested_at").alias("with_ingested"), F.count("updated_at").alias("with_updated"))
