"""Secret scans over a ledger of content-addressed blobs.

A version (one row of the table: a path and its text at some time) is addressed
by the SHA-256 of its text. The ledger holds the (blob, rule, rule version)
triples that have been scanned and what was found. A run scans a blob with the
rules it hasn't seen in their present versions, adds to both tables, and joins
the findings back to every version of every path by blob. ``Ledger`` keeps both
tables in a folder from run to run.

Spans are found with Catalyst's regular expressions alone: the matches and the
pieces between them alternate, so a running sum of their lengths places each
match, in code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.common import stored, whole_text


@dataclass(frozen=True)
class Rule:
    """``guard`` is a cheap test that holds for each text with a match; group ``value`` has ``least`` characters at least in a match that counts."""

    kind: str
    version: int
    pattern: str
    guard: str
    value: int
    least: int
    base: bool = True


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:password|passwd|secret|token|api_?key)[\"' :=]", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 0, 16),
    # A run of 32 or more starts where a run of one or more starts, so shorter runs need not be listed to be dropped.
    Rule("hex", 1, "[0-9a-f]{32,}", "[0-9a-f]{32}", 0, 32),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", "-----BEGIN", 0, 27, base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", 0, 30, base=False),
)

LEDGER = "blob string, rule string, rule_version int"
FINDINGS = "blob string, rule string, rule_version int, start long, end long"


@dataclass
class Scan:
    """versions: the keys and blob, one row per row of the input; ledger and findings: the old rows and the new ones, which ``scanned`` and ``found`` hold by themselves."""

    versions: DataFrame
    ledger: DataFrame
    findings: DataFrame
    scanned: DataFrame
    found: DataFrame


def _guard(rule: Rule, text: Column) -> Column:
    literal = not any(c in r"\[](){}|?*+.^$" for c in rule.guard)
    return F.contains(text, F.lit(rule.guard)) if literal else text.rlike(rule.guard)


def scan_versions(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> Scan:
    """Scan the blobs and rule versions that ``ledger`` lacks.

    keys: the columns that name a version, such as a path and a revision; they
    are carried along as they are and may be null or repeat. A null text is the empty blob. Repeated rows and rows of equal text share a
    blob and its one scan; one key may come with several texts. A very long text
    is one row, scanned as a whole. An empty table adds nothing. Columns other
    than the keys and text are not read.
    Findings of a rule's older versions stay in the findings, under that version.
    """
    spark = docs.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    findings = spark.createDataFrame([], FINDINGS) if findings is None else findings
    if taken := {"text", "blob", "found"} & set(keys):
        raise ValueError(f"keys may not be named {sorted(taken)}")
    blob = F.sha2(whole_text(), 256).alias("blob")
    versions = docs.select(*keys, blob)
    texts = docs.select(F.xxhash64(*keys).alias("version"), whole_text().alias("text"), blob)

    # One version of each blob stands for it. Only hashes are grouped; the text moves once, to its unseen rules.
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("seen"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    unseen = stored(
        texts.groupBy("blob")
        .agg(F.min("version").alias("version"))
        .join(seen, "blob", "left")
        .select("blob", "version", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen")).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    scanned = unseen.select("blob", F.explode("todo").alias("t")).select("blob", "t.rule", "t.rule_version")

    u = unseen.select(F.col("blob").alias("u_blob"), F.col("version").alias("u_version"), F.col("todo.rule").alias("todo")).hint("shuffle_hash")
    text = F.col("text")
    hits = texts.join(u, (F.col("blob") == F.col("u_blob")) & (F.col("version") == F.col("u_version")), "inner")
    due = {r.kind: F.array_contains("todo", r.kind) & _guard(r, text) for r in rules}
    hits = hits.select("blob", "text", *[due[r.kind].alias(f"is_{r.kind}") for r in rules]).filter(" or ".join(f"is_{r.kind}" for r in rules))
    each = [
        F.when(
            F.col(f"is_{r.kind}"),
            F.struct(
                F.lit(r.kind).alias("rule"),
                F.lit(r.version).alias("rule_version"),
                F.arrays_zip(
                    F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("whole"),
                    F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.value)).alias("value"),
                    F.split("text", r.pattern, -1).alias("gap"),
                ).alias("parts"),
                F.lit(r.least).alias("least"),
            ),
        )
        for r in rules
    ]
    pieces = hits.select("blob", F.explode(F.array_compact(F.array(*each))).alias("m")).select("blob", "m.rule", "m.rule_version", "m.least", F.posexplode("m.parts").alias("i", "p"))
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # Rows alike in key and text are all joined; their pieces come several times and are made one here.
    found = stored(
        pieces.select("blob", "rule", "rule_version", "least", "i", F.length("p.whole").alias("n"), F.length("p.value").alias("v"), F.length("p.gap").alias("g"))
        .dropDuplicates(["blob", "rule", "i"])
        .filter("n is not null")
        .withColumn("end", F.sum(F.col("g") + F.col("n")).over(so_far))
        .filter("v >= least")
        .selectExpr("blob", "rule", "rule_version", "end - n start", "end")
    )
    return Scan(versions, ledger.unionByName(scanned), findings.unionByName(found), scanned, found)


class Ledger:
    """Ledger and findings in a folder of any file system that Spark knows.

    Each run adds a folder with the pairs it scanned and what it found, and a
    marker last. A folder without its marker, of a run that was lost, isn't
    read, so that run's blobs are scanned by the next one. Of two runs at a time
    each may scan the same pair: its findings are one when read.
    """

    MARKER = "_DONE"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def runs(self) -> list[str]:
        """Folders of the runs that were ended."""
        fs, marked = self._path("run-*", self.MARKER)
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(marked) or ())

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{run}/{part}" for run in self.runs()]
        return self.spark.read.schema(schema).parquet(*paths).distinct() if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> Scan:
        """Scan what is unseen, and add it; the result reads the folder as it is then."""
        done = scan_versions(docs, self.ledger(), self.findings(), rules, keys)
        run = f"run-{uuid.uuid4().hex}"
        done.found.write.parquet(f"{self.root}/{run}/findings")
        done.scanned.write.parquet(f"{self.root}/{run}/ledger")
        fs, marker = self._path(run, self.MARKER)
        fs.create(marker, True).close()
        return Scan(done.versions, self.ledger(), self.findings(), done.scanned, done.found)


def findings_by_version(scan: Scan, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each version (its keys and blob) with the spans of the rules' present versions: an array of (start, rank, kind, end) in order of start, then of the rules."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    spans = (
        scan.findings.filter(now[F.col("rule")] == F.col("rule_version"))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), "end"))).alias("found"))
    )
    # Written, so that both sides of the join are exchanged for it and a blob with very many versions can be split.
    return scan.versions.join(stored(spans), "blob", "left").select(*scan.versions.columns, F.coalesce("found", F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")).alias("found"))


def secret_digest(by_version: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of each base kind, the hash of the base spans, and all spans as text."""

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = [r.kind for r in rules if r.base]
    found = F.col("found")
    counts = [F.size(F.expr(f"filter(found, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in base]
    return by_version.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(F.filter(found, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(found).alias("spans"), "blob")
