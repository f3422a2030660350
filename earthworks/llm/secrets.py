"""Secret scans over an incremental blob ledger, in built-in functions only.

A blob is a text under its content address (SHA-256). The ledger holds the pairs of blob and rule version that were scanned,
and what was found; a run scans only pairs that are not in it, once for all copies, adds them, and joins the findings back
to all paths (rows). Without a ledger of the caller's a run begins an empty one in the shared folder.

Positions come from the gaps: ``split`` gives the text between matches, ``regexp_extract_all`` the matches, and running
sums of their lengths in code points give every start and end.

Defined results: a null text is the empty blob and has no findings. Copies and repeated rows share one scan, and each of
them gets all findings. An empty table gives empty results. Spans of one kind never overlap; spans of different kinds may
start at one place, then the order of the rules decides. A very long text is scanned whole; its findings, bounded by its
own length, are the largest group that meets in a task. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earthworks.llm.store import packed
from earthworks.operators.lineage import shared_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, of which those stay whose ``group`` has at least ``least`` characters.

    ``hint`` is a pattern that every text with such a match contains; it is cheap to look for.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# A run of hex digits, or what follows AKIA, is as long as it can be, so the length bound may stand in the pattern: a run
# that is too short can't hold a longer one.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)

LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start long, end long"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_rank(rules: tuple[Rule, ...] = RULES) -> Column:
    rank = F.lit(len(rules))
    for k, rule in enumerate(rules):
        rank = F.when(F.col("rule") == rule.kind, k).otherwise(rank)
    return rank


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs with ``_due``, the indexes of the rules for which the ledger has no pair; blobs without any are left out."""
    every = F.array(*[F.lit(k) for k in range(len(rules))])
    if ledger is None:
        return blobs.withColumn("_due", every)
    versions = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("_done"))
    joined = blobs.join(done, "blob", "left").withColumn("_versions", versions).withColumn("_due", every)
    still = F.filter("_due", lambda k: ~F.coalesce(F.array_contains(F.col("_done"), F.get(F.col("_versions"), k)), F.lit(False)))
    return joined.withColumn("_due", still).where(F.size("_due") > 0).select("blob", "_due")


def hinted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text has the hint of any rule; only such a text can have findings."""
    return F.coalesce(reduce(or_, [text.rlike(rule.hint) for rule in rules]), F.lit(False))


def findings(due: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of every due blob and rule."""
    per_rule = []
    for k, rule in enumerate(rules):
        hit = F.array_contains("_due", k) & F.col("_text").rlike(rule.hint)
        gaps = F.split(F.col("_text"), rule.pattern, -1)
        whole = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
        part = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        parts = F.transform(
            F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")),
            lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"),
                               F.length(x["part"]).alias("part")))
        per_rule.append(F.when(hit, F.struct(
            F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
            parts.alias("parts"))))
    found = due.select("blob", F.array_compact(F.array(*per_rule)).alias("_found")).where(F.size("_found") > 0)
    found = found.select("blob", F.explode("_found").alias("f")).select("blob", "f.rule", "f.version", "f.least", "f.parts")
    rows = found.select("blob", "rule", "version", "least", F.posexplode("parts").alias("pos", "p"))
    before = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.sum(F.col("p.gap") + F.coalesce(F.col("p.whole"), F.lit(0))).over(before), F.lit(0))
    start = (reach + F.col("p.gap")).cast("long")
    return rows.withColumn("start", start).where(F.col("p.part") >= F.col("least")).select(
        "blob", "rule", "version", "start", (F.col("start") + F.col("p.whole")).cast("long").alias("end"))


def scan(
    df: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings of the pairs that the ledger has not (FINDINGS), and these pairs (LEDGER).

    Addresses of all texts are compared with the ledger; texts move only if they have a hint, one of all copies.
    """
    blobs = df.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    due = unseen(blobs.select("blob").distinct(), ledger, rules)
    likely = blobs.where(hinted(F.col("_text"), rules)).distinct()
    found = findings(unseen(likely, None, rules) if ledger is None else likely.join(due, "blob"), rules)
    named = [F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_k") + 1) for xs in zip(*[(r.kind, r.version) for r in rules], strict=True)]
    pairs = due.select("blob", F.explode("_due").alias("_k")).select("blob", named[0].alias("rule"), named[1].alias("version"))
    return found, pairs


class Ledger:
    """A folder that keeps what was scanned: for each blob the rule versions, and the spans that they found.

    A run adds a row for each blob it scanned, with its pairs and findings together, so that a run that breaks off leaves
    whole rows only. The files of a folder on the shared store grow with every run; nothing is written twice.
    """

    ROW = "blob string, pairs array<struct<rule:string,version:int>>, spans array<struct<rule:string,version:int,start:bigint,end:bigint>>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def fresh(cls, spark: SparkSession) -> Ledger:
        """An empty one in the folder that all executors share."""
        ledger = cls(spark, f"{shared_folder(spark)}/llm-ledger-{uuid.uuid4().hex}")
        spark.createDataFrame([], cls.ROW).write.parquet(ledger.folder)
        return ledger

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.ROW).parquet(self.folder)

    def pairs(self) -> DataFrame:
        return self.rows().select("blob", F.inline("pairs"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The spans of the given rule versions."""
        wanted = [f"{r.kind}:{r.version}" for r in rules]
        return self.rows().select("blob", F.inline("spans")).where(F.concat_ws(":", "rule", "version").isin(wanted))

    def extend(self, df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger has not yet, and add it."""
        known = None if self.rows().isEmpty() else self.pairs()
        found, pairs = scan(df, text, known, rules)
        spans = found.groupBy("blob").agg(F.collect_list(F.struct("rule", "version", "start", "end")).alias("spans"))
        seen = pairs.groupBy("blob").agg(F.collect_list(F.struct("rule", "version")).alias("pairs"))
        seen.join(spans, "blob", "left").select("blob", "pairs", "spans").write.mode("append").parquet(self.folder)


def per_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind and all spans in order, for every blob with a finding."""
    spans = F.sort_array(F.collect_list(F.struct("start", rule_rank(rules).alias("rank"), "end", "rule")))
    counts = [F.count_if(F.col("rule") == r.kind).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.groupBy("blob").agg(*counts, spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))
    return F.coalesce(F.array_join(F.transform(spans, one), ","), F.lit(""))


def report(
    df: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None,
) -> DataFrame:
    """Counts and spans of every row: what the ledger, extended by this table, has of its blob."""
    ledger = ledger or Ledger.fresh(df.sparkSession)
    ledger.extend(df, text, rules)
    blobs = per_blob(ledger.findings(rules), rules)
    paths = df.select(*keys, blob_id(F.col(text)).alias("blob"))
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return paths.join(blobs, "blob", "left").select(*keys, "blob", *counts, "spans")


def masked(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", ledger: Ledger | None = None,
) -> DataFrame:
    """All rows and columns, with every span of the text replaced; a text without findings stays as it is.

    Overlapping spans of different kinds become one mask. Only texts with a hint of a secret meet the findings; the others
    pass as they are read.
    """
    ledger = ledger or Ledger.fresh(df.sparkSession)
    ledger.extend(df, text, rules)
    blobs = per_blob(ledger.findings(rules), rules).select("blob", "spans")
    seed = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    whole = F.col(f"row.{text}")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(whole, acc["at"].cast("int") + 1, F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(gap, F.lit(mask))).otherwise("")
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(whole, acc["at"].cast("int") + 1, F.length(whole)))

    clean = F.when(F.col("spans").isNull(), whole).otherwise(F.aggregate("spans", seed, step, finish))
    rows, likely = packed(df), hinted(whole, rules)
    joined = rows.where(likely).withColumn("blob", blob_id(whole)).join(blobs, "blob", "left")
    return joined.select(F.col("row").withField(text, clean).alias("row")).unionByName(rows.where(~likely)).select("row.*")
