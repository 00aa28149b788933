"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is literal text with `*` (anything), `^` (a separator or the end) and a leading `||` (the host or a
parent domain of it). It is matched against host + path + query, the host with A-Z lower-cased. Of the tokens
(runs of letters and digits) that a pattern must contain whole, the one that is rarest in the URLs at hand
indexes the rule; a URL's tokens fetch its candidate rules, and only those run their regular expressions.

A null URL or one without `://` has an empty host and path, fits no rule and gets the default verdict. Repeated
rows are judged each; columns beside the URL pass through, but for one named like the result, which it replaces.
URLs are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.shared import SALTS, ascii_lower, free_names, ship_package

#: As many rules go to each Python worker (about 300 bytes a rule); more are joined by token instead.
BROADCAST_RULES = 100_000
URL = re.compile(r"://([^/?#]*)([^?#]*)(.*)", re.S)
TOKEN = re.compile(r"[A-Za-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
JUDGED = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "pattern", "verdict")] + [T.StructField("candidates", T.IntegerType())])


@dataclass(frozen=True)
class Rule:
    """A rule: site rules (`host/path`, with subdomains) go before patterns; then the longest wins."""

    text: str
    action: str
    site: bool = False

    @property
    def pattern(self) -> str:
        return f"||{self.text}" if self.site else self.text

    @property
    def order(self) -> tuple:
        return self.site, len(self.text), self.text


#: The method's own rules, for URLs that no site rule fits.
DEFAULT_PATTERNS = (Rule("/login^", "block"), Rule("/cart/checkout^", "block"), Rule("^sessionid=", "block"))


def to_regex(rule: Rule) -> str:
    """The rule as a regular expression that Python and Java read alike."""
    anchored = rule.pattern.startswith("||")
    body = rule.pattern[2:] if anchored else rule.pattern
    if rule.site:
        return r"^(?:[^/?#]*\.)?" + re.escape(body)
    # A search needs no wildcard at its ends; one at the start would try every place of a long URL anew.
    body = body.rstrip("*") if anchored else body.strip("*")
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    return (r"^(?:[^/?#]*\.)?" if anchored else "") + "".join(parts.get(c) or re.escape(c) for c in body)


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that every fitting URL has whole: those with a boundary on either side in the pattern."""
    body, wild = rule.pattern.removeprefix("||"), "" if rule.site else "*"
    anchored = rule.pattern.startswith("||")
    found = []
    for m in TOKEN.finditer(body):
        before, after = body[m.start() - 1] if m.start() else "", body[m.end()] if m.end() < len(body) else ""
        if (before or anchored) and before != (wild or None) and after and after != (wild or None):
            found.append(m[0])
    return found


def target_of(url: Column) -> Column:
    """host + path + query of a URL column; empty without `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)(.*)", k), F.lit(""))
    return F.concat(ascii_lower(part(1)), part(2), part(3))


def token_counts(urls: DataFrame, url: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens is; other tokens are dropped before they are counted."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    wanted = F.broadcast(wanted) if len(set(tokens)) <= BROADCAST_RULES else wanted
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(target_of(F.col(url)), F.lit("([A-Za-z0-9]+)"), 1))).alias("token"))
    return {r["token"]: r["n"] for r in seen.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_rules(rules: Iterable[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and those without one, which every URL has to try."""
    by_token: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        if tokens := literal_tokens(rule):
            by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
        else:
            rest.append(rule)
    return by_token, rest


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", result: str = "judged") -> DataFrame:
    """pages with a struct `result`: host, path, rule (the site rule's text), pattern (what decided), verdict, candidates."""
    rules = sorted(set(rules), key=lambda r: r.order)
    pages = pages.drop(*[c for c in pages.columns if c.lower() == result.lower() and c.lower() != url.lower()])
    tokens = [t for r in rules for t in literal_tokens(r)]
    by_token, rest = index_rules(rules, token_counts(pages, url, tokens) if tokens else {})
    if len(rules) > BROADCAST_RULES:
        return _judge_by_join(spark, pages, by_token, rest, url, default, result)
    ship_package(spark)
    index = spark.sparkContext.broadcast((by_token, rest))

    @F.pandas_udf(JUDGED)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_token, rest = index.value
        compiled = {r: re.compile(to_regex(r), re.S) for r in {x for v in by_token.values() for x in v} | set(rest)}
        for urls in batches:
            yield pd.DataFrame([_judge_one(u, by_token, rest, compiled, default) for u in urls], columns=JUDGED.names)

    return pages.withColumn(result, apply(F.col(url)))


def _judge_one(url: str | None, by_token: dict, rest: list[Rule], compiled: dict, default: str) -> tuple:
    m = URL.search(url or "")
    host, path, tail = (m[1].translate(LOWER), m[2], m[3]) if m else ("", "", "")
    target = host + path + tail
    candidates = [r for t in set(TOKEN.findall(target)) for r in by_token.get(t, ())] + rest
    best = max((r for r in candidates if compiled[r].search(target)), key=lambda r: r.order, default=None)
    return host, path, best.text if best and best.site else None, best.text if best else None, best.action if best else default, len(candidates)


def _judge_by_join(spark: SparkSession, pages: DataFrame, by_token: dict, rest: list[Rule], url: str, default: str, result: str) -> DataFrame:
    """The same with any number of rules: distinct targets meet the index in a join by token, dealt over salts.

    Rules without a token have the empty one, which every target has besides its own.
    """
    fields = "token string, site boolean, length int, text string, action string, regex string"
    rows = [(t, r.site, len(r.text), r.text, r.action, f"(?s){to_regex(r)}") for t, v in [*by_token.items(), ("", rest)] for r in v]
    index = spark.createDataFrame(rows, fields).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own, met_name = free_names(pages, "_target", "_met")
    keyed = pages.withColumn(own, target_of(F.col(url)))
    targets = keyed.select(F.col(own).alias("target")).distinct()
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("target", F.lit("([A-Za-z0-9]+)"), 1)))
    met = targets.withColumn("token", F.explode(tokens)).withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)).cast("int")).join(index, ["token", "salt"])
    best = met.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.when(F.expr("target rlike regex"), F.struct("site", "length", "text", "action"))).alias("best"))
    verdicts = best.select(F.col("target").alias(own), F.struct("n", "best").alias(met_name))
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    m = lambda path: F.col(f"{met_name}.{path}")
    judged = F.struct(ascii_lower(part(1)).alias("host"), part(2).alias("path"), F.when(m("best.site"), m("best.text")).alias("rule"), m("best.text").alias("pattern"), F.coalesce(m("best.action"), F.lit(default)).alias("verdict"), F.coalesce(m("n"), F.lit(0)).alias("candidates"))
    return keyed.join(verdicts, own, "left").withColumn(result, judged).drop(own, met_name)
