"""Secret scans over an incremental ledger of blobs, with Spark expressions only.

A blob is a text by its SHA-256. The ledger, a folder on shared storage, has four kinds of facts: which path had
which blob (every version ever given), one copy of each blob, which blob was scanned with which version of which
rule, and what was found. A scan adds the blobs that the ledger has not, runs on them the rule versions that have
not seen them, appends, and joins the findings back to its rows. catch_up does the same for blobs of earlier scans
and newer rules; history joins the findings to all paths and all versions that they ever had.

A scan reads the ledger's facts of its own blobs only. Each call appends to folders of its own, so that calls may
run side by side; blobs that two of them add or scan, or that a call repeats which failed half-way, count once.

Spans are in code points, end exclusive. Matches of a kind do not overlap; a rule may drop matches by the length
of one of its groups. Null texts count as empty. Repeated rows give repeated results. An empty table gives no
rows. Only the path columns and the text are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.shared import lookup, running_sums, whole, written


@dataclass(frozen=True)
class SecretRule:
    """Matches of `regex` whose `group` has at least `least` characters. gate: a regex that every text with one has."""

    kind: str
    regex: str
    gate: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, then the method's own.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw|secret|token|api_?key)", 2, 6),
    SecretRule("access", r"(AKIA[A-Z0-9]+)", r"AKIA[A-Z0-9]{16}", 1, 20),
    SecretRule("hex", r"([0-9a-f]{24,})", r"[0-9a-f]{24}", 1, 24),
)
MORE_RULES = (
    SecretRule("private_key", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", "PRIVATE KEY-----"),
    SecretRule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", "gh[pousr]_"),
    SecretRule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", "xox[abprs]-"),
    SecretRule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "eyJ"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,rank:int,kind:string,rule:string,end:bigint>>"
FACTS = f"blob string, rules array<string>, spans {SPANS}"
FOUND = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """The rule's spans in a text: matches lie between the pieces that a split leaves."""
    gaps = F.split(text, rule.regex, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.regex), 0)
    checked = F.regexp_extract_all(text, F.lit(rule.regex), rule.group)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), checked.alias("checked"))
    before = running_sums(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint")))
    placed = F.transform(
        F.arrays_zip(before.alias("before"), pairs.alias("p")),
        lambda z: F.struct(
            (z["before"] + F.length(z["p"]["gap"])).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.key).alias("rule"),
            (z["before"] + F.length(z["p"]["gap"]) + F.length(z["p"]["hit"])).alias("end"),
            F.length(z["p"]["checked"]).alias("checked"),
        ),
    )
    kept = F.transform(F.filter(placed, lambda s: s["checked"] >= rule.least), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "rule", "end")]))
    return F.when(text.rlike(rule.gate), kept).otherwise(F.array().cast(SPANS))


def _ledger(spark: SparkSession, ledger: str, name: str) -> DataFrame:
    """A kind of facts, of all calls; empty if there is none yet."""
    schema = {"blobs": "blob string, text string", "scans": FACTS}[name]
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _rule_keys(rules: tuple[SecretRule, ...]) -> Column:
    return F.array(*[F.lit(r.key) for r in rules])


def _unseen(blobs: DataFrame, scans: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Of the blobs (blob, each once) those that some of the rules have not seen, with these as `todo`."""
    seen = scans.join(blobs, "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    todo = F.array_except(_rule_keys(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def _run(texts: DataFrame, rules: tuple[SecretRule, ...], path: str) -> None:
    """Append what the rules in `todo` find in texts (blob, text, todo)."""
    found = F.concat(*[F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r, k)).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)])
    texts.select("blob", F.col("todo").alias("rules"), found.alias("spans")).write.parquet(path)


def _by_blob(scans: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Spans of the rules by blob, each once, sorted by start, then by the rules' order; blobs without any are left out."""
    facts = scans.select("blob", F.filter("spans", lambda s: s["rule"].isin(*[r.key for r in rules])).alias("spans")).where(F.size("spans") > 0)
    ranks = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    ranked = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), ranks[s["rule"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return facts.groupBy("blob").agg(F.array_sort(F.array_distinct(ranked)).alias("spans"))


def _joined(versions: DataFrame, spans: DataFrame, paths: list[str]) -> DataFrame:
    # The versions are a table of their own, so that no path column clashes with blob or spans.
    rows = versions.select(F.struct(*paths).alias("_p"), "blob")
    met = lookup(rows, spans, ["blob"], rows.count(), F.xxhash64("_p"))
    return met.select(*[F.col(f"_p.{p}").alias(p) for p in paths], F.col("blob").alias("blob"), F.coalesce("spans", F.array().cast(FOUND)).alias("spans"))


def _refuse(paths: list[str]) -> None:
    """Names of the ledger's own columns, and of its folders, are not for paths."""
    if taken := {"blob", "spans", "call"} & {p.lower() for p in paths}:
        raise ValueError(f"path columns may not be named {sorted(taken)}")


def scan(docs: DataFrame, ledger: str, paths: list[str], text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: paths, blob and spans, sorted by start, then by the rules' order.

    ledger: a folder of this operator on shared storage, empty at first. What it has of other rule versions stays
    and is not returned. paths must not be named blob, spans or call.
    """
    _refuse(paths)
    spark = docs.sparkSession
    call = f"call={uuid.uuid4().hex}"
    body = whole(F.col(text))
    mine = written(docs.select(*[F.col(p) for p in paths], F.sha2(body, 256).alias("blob")), f"{ledger}/paths/{call}")
    at_hand = mine.select("blob").distinct()

    known = _ledger(spark, ledger, "blobs").select("blob")
    texts = docs.select(F.sha2(body, 256).alias("blob"), body.alias("text"))
    if not known.isEmpty():
        texts = texts.join(known.join(at_hand, "blob", "left_semi"), "blob", "left_anti")
    # One copy of each blob: copies collapse before they move.
    texts.groupBy("blob", "text").agg(F.count(F.lit(1)).alias("n")).select("blob", "text").write.parquet(f"{ledger}/blobs/{call}")

    scans = _ledger(spark, ledger, "scans")
    if known.isEmpty() and scans.isEmpty():
        todo = spark.read.schema("blob string, text string").parquet(f"{ledger}/blobs/{call}").withColumn("todo", _rule_keys(rules))
    else:
        unseen = written(_unseen(at_hand, scans, rules), f"{ledger}/unseen/{call}")
        todo = _ledger(spark, ledger, "blobs").join(unseen, "blob").dropDuplicates(["blob"])
    _run(todo, rules, f"{ledger}/scans/{call}")
    facts = _ledger(spark, ledger, "scans").join(at_hand, "blob", "left_semi") if not scans.isEmpty() else spark.read.schema(FACTS).parquet(f"{ledger}/scans/{call}")
    return _joined(mine, _by_blob(facts, rules), paths)


def catch_up(spark: SparkSession, ledger: str, rules: tuple[SecretRule, ...] = RULES) -> None:
    """Scan every blob of the ledger with those of the rules that it has not seen, as after a new rule version."""
    call = f"call={uuid.uuid4().hex}"
    blobs = _ledger(spark, ledger, "blobs")
    unseen = written(_unseen(blobs.select("blob").distinct(), _ledger(spark, ledger, "scans"), rules), f"{ledger}/unseen/{call}")
    _run(blobs.join(unseen, "blob").dropDuplicates(["blob"]), rules, f"{ledger}/scans/{call}")


def history(spark: SparkSession, ledger: str, paths: list[str], rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """A row for each path and each version that it ever had: paths, blob and spans; of a ledger without a scan none, with paths as strings."""
    _refuse(paths)
    try:
        written_paths = spark.read.parquet(f"{ledger}/paths")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join([*(f"`{p}` string" for p in paths), f"blob string, spans {FOUND}"]))
    versions = written_paths.select(*paths, "blob").distinct()
    return _joined(versions, _by_blob(_ledger(spark, ledger, "scans"), rules), paths)


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; of some kinds only."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
