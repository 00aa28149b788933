"""What the operators of this package share: the shared folder, tables written there, hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.storage import scratch as shared_dir  # noqa: F401
from wayfold.operators.storage import ship_package, stored as written  # noqa: F401

#: A key is hot if it has more than 1/HOT_PARTS of all rows, so at most HOT_PARTS keys are.
HOT_PARTS = 1000
#: Salts over which the rows of a hot key are dealt.
SALTS = 64


def arrow_rows(spark: SparkSession, most: int = 500) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit in a Python worker.

    A setting of the session, as plans read it when they run, after their operator has returned; smaller ones stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def whole(text: Column) -> Column:
    """A text, with null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each one. Two levels, so that the work grows as n to the 1.5, not squared."""
    n = F.size(lengths)
    step = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.greatest(step, F.lit(1))).cast("int")), lambda k: F.slice(lengths, k * step + 1, step))).otherwise(F.array().cast("array<array<bigint>>"))

    def sums(a: Column) -> Column:
        last = lambda acc: F.element_at(acc, -1)
        return F.aggregate(a, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    inner = F.transform(cut, sums)
    starts = sums(F.transform(inner, lambda s: F.element_at(s, -1)))
    return F.flatten(F.transform(F.arrays_zip(inner.alias("inner"), F.slice(starts, 1, F.size(cut)).alias("start")), lambda z: F.transform(F.slice(z["inner"], 1, F.size(z["inner"]) - 1), lambda x: x + z["start"])))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], total: int, deal: Column, how: str = "left") -> DataFrame:
    """left joined with right, whose keys are unique, without a task that gets all rows of a hot key.

    total: rows of left. deal: a column of left that spreads the rows of a key. The hot keys, at most
    HOT_PARTS, are the only thing broadcast; their rows are dealt over SALTS and their right rows repeated.
    """
    least = max(10_000, total // HOT_PARTS)
    if total <= least:
        return left.join(right, keys, how)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    spread = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return marked.join(spread, [*keys, "_salt"], how).drop("_salt")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def keep_documents(docs: DataFrame, stay: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs whose id and text are in stay (_id, _sha: SHA-256 in hex), repeated rows once."""
    sha0, id1, sha1, n = free_names(docs, "_sha0", "_id1", "_sha1", "_n")
    marked = docs.withColumn(sha0, F.sha2(whole(F.col(text)), 256))
    named = lambda d: d.select(F.col("_id").alias(id1), F.col("_sha").alias(sha1))
    same = F.col(doc_id).eqNullSafe(F.col(id1)) & (F.col(sha0) == F.col(sha1))
    kept = marked.join(named(stay), same, "left_semi")
    again = marked.groupBy(F.col(doc_id).alias("_id"), F.col(sha0).alias("_sha")).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    if not again.isEmpty():
        again = named(again)
        rest = [c for c in docs.columns if c not in (doc_id, text)]
        # Of rows with one id and text the first by their other columns, so that reruns keep the same one.
        least = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
        doubled = kept.join(again, same, "left_semi")
        one = doubled.withColumn(n, F.row_number().over(W.partitionBy(doc_id, sha0).orderBy(least))).where(F.col(n) == 1).drop(n)
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.drop(sha0)


def own_keys(keys: list[str], *results: str) -> list[str]:
    """Names for the keys inside an operator, so that no key clashes with its columns; keys may not have a result's name."""
    if taken := {k.lower() for k in keys} & set(results):
        raise ValueError(f"keys may not be named {sorted(taken)}")
    return [f"_key{i}" for i in range(len(keys))]
