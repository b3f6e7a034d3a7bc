"""Secret scans with an incremental blob ledger (DataFrame operations only).

Every version of every path is addressed by the sha256 of its content. The
ledger records which (blob, rule version) pairs have been scanned; a scan takes
one copy of each blob that still lacks a rule version, applies only the missing
rules, and writes findings and pairs. Findings are joined back to every path
that holds the blob. A rule's version is the hash of its definition, so a
changed rule is scanned again and an unchanged one is not.

Positions come from two built-ins: the gaps between the matches (``split``) and
the matches themselves (``regexp_extract_all``); their lengths add up to starts
in code points. Gaps are cut only for blobs that have a match long enough.

Defined cases: null text = empty text, no findings; repeated rows and equal
texts share a blob and are scanned once; rows that repeat path and text inside a scan are
reported each, scanning the same table again adds none; null paths are kept as a path;
very long texts and many matches in one take a time about linear in them; other
columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.llm.common import keep


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# Base rules of the scan contract.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    Rule("hex", r"([0-9a-f]{16,})", 1, 16),
)
# Rules beyond the base: key blocks, tokens with a known head, signed web tokens.
MORE_RULES = (
    Rule("private_key", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 1, 20),
    Rule("headed", r"\b((?:ghp|gho|ghs|xoxb|xoxp|sk_live|glpat)[_-][A-Za-z0-9_-]{16,})", 1, 20),
    Rule("web_token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 20),
)
RULES = BASE_RULES + MORE_RULES

BLOBS, PAIRS, FINDINGS = "blobs", "pairs", "findings"
BLOCK = 256         # matches whose places are added up at once


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _running(sizes: Column) -> Column:
    """For every number the sum of those before it; the array grows with each, so for short ones."""
    return F.aggregate(sizes, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
                       lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")))["all"]


def _before(sizes: Column) -> Column:
    """For every number the sum of those before it, by blocks of BLOCK and then inside them."""
    count = F.ceil(F.size(sizes) / BLOCK).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
                         lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
    return F.flatten(F.zip_with(blocks, _running(sums), lambda x, s: F.transform(_running(x), lambda v: v + s)))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, found>> of a rule's matches, in code points."""
    wide = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, wide, F.lit(0))
    inner = F.regexp_extract_all(text, wide, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    at = F.zip_with(_before(sizes), gaps, lambda s, g: s + F.length(g))
    rows = F.zip_with(F.arrays_zip(whole.alias("m"), inner.alias("g")), at,
                      lambda x, s: F.struct(s.alias("start"), (s + F.length(x["m"])).alias("end"),
                                            x["g"].alias("inner"), x["m"].alias("found")))
    good = F.filter(rows, lambda x: F.length(x["inner"]) >= rule.least)
    none = F.array().cast("array<struct<start:int,end:int,inner:string,found:string>>")
    return F.when(F.exists(inner, lambda g: F.length(g) >= rule.least), good).otherwise(none)


def _hits(text: Column, rule: Rule) -> Column:
    return F.transform(_spans(text, rule), lambda x: F.struct(
        F.lit(rule.version).alias("rule_version"), F.lit(rule.kind).alias("kind"),
        x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; one that has not been written yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class BlobLedger:
    """Ledger tables under ``path`` (shared storage, one writer at a time)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def pairs(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/{PAIRS}", "blob string, rule_version string")

    def findings(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/{FINDINGS}",
                     "blob string, rule_version string, kind string, start int, end int, found string")

    def versions(self) -> DataFrame:
        """path, blob, n: in how many rows of one scan, at most."""
        return (_read(self.spark, f"{self.path}/{BLOBS}", "path string, blob string, n long")
                .groupBy("path", "blob").agg(F.max("n").alias("n")))

    def scan(self, df: DataFrame, path: str, text: str, rules: tuple[Rule, ...] = RULES) -> None:
        """Record the versions in ``df`` and scan what the ledger has not seen."""
        rows = df.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        rows = rows.withColumn("blob", blob_id(F.col("text")))
        (rows.groupBy("path", "blob").agg(F.count(F.lit(1)).alias("n"))
         .write.mode("append").parquet(f"{self.path}/{BLOBS}"))
        wanted = F.array(*[F.lit(r.version) for r in rules])
        seen = (self.pairs().where(F.col("rule_version").isin([r.version for r in rules]))
                .groupBy("blob").agg(F.collect_set("rule_version").alias("seen")))
        one = rows.groupBy("blob").agg(F.first("text").alias("text"))
        todo = (one.join(seen, "blob", "left")
                .withColumn("missing", F.array_except(wanted, F.coalesce(F.col("seen"), F.array().cast("array<string>"))))
                .where(F.size("missing") > 0))
        none = F.array().cast("array<struct<rule_version:string,kind:string,start:int,end:int,found:string>>")
        hits = F.concat(*[F.when(F.array_contains("missing", r.version), _hits(F.col("text"), r)).otherwise(none)
                          for r in rules])
        scanned = keep(todo.select("blob", "missing", hits.alias("hits")), "scan")
        (scanned.select("blob", F.explode("hits").alias("h")).select("blob", "h.*")
         .write.mode("append").parquet(f"{self.path}/{FINDINGS}"))
        (scanned.select("blob", F.explode("missing").alias("rule_version"))
         .write.mode("append").parquet(f"{self.path}/{PAIRS}"))

    def path_findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Every version of every path with its findings under ``rules``:
        path, blob, findings (array of kind, start, end, found; by start, then
        rule order; empty when there are none)."""
        rank = {r.kind: i for i, r in enumerate(rules)}
        order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in rank.items()])
        per_blob = (self.findings().where(F.col("rule_version").isin([r.version for r in rules]))
                    .distinct()
                    .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
                        "start", order.alias("rank"), "end", "kind", "found"))).alias("f")))
        shaped = per_blob.select("blob", F.transform("f", lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            x["found"].alias("found"))).alias("findings"))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
        copies = F.array_repeat(F.lit(0), F.col("n").cast("int"))
        return (self.versions().join(keep(shaped, "found"), "blob", "left")
                .select("path", "blob", F.coalesce("findings", none).alias("findings"), F.explode(copies).alias("copy")).drop("copy"))
