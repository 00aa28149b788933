"""Writes as DataFrames: upserts, ignored inserts, rolling means, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows after an upsert with optimistic versions, each with its outcome: one full join by key.

    An insert gets version 1. An update must name the stored version, which then rises by one; else it conflicts
    and the stored row stays.
    """
    o = old.select(F.col(key), *[F.col(v).alias(f"_o_{v}") for v in values], F.col("version").alias("_o"))
    n = new.select(F.col(key), *[F.col(v).alias(f"_n_{v}") for v in values], F.col("version").alias("_n"))
    met = o.join(n, key, "full")
    outcome = F.when(F.col("_n").isNull(), "KEPT").when(F.col("_o").isNull(), "INSERTED").when(F.col("_o") == F.col("_n"), "UPDATED").otherwise("CONFLICT")
    taken = F.col("outcome").isin("INSERTED", "UPDATED")
    version = F.when(F.col("outcome") == "INSERTED", 1).when(F.col("outcome") == "UPDATED", F.col("_o") + 1).otherwise(F.col("_o")).cast("int")
    return met.withColumn("outcome", outcome).select(key, *[F.when(taken, F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}")).alias(v) for v in values], version.alias("version"), "outcome")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it has not, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def rolling_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and n by key."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def merge_means(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Means of two batches as one, weighted by their counts."""
    both = a.select(*keys, "mean", "n").unionByName(b.select(*keys, "mean", "n"))
    return both.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def retry_state(failed: DataFrame, now_us: int, most: int = 3, first_s: int = 60, longest_s: int = 1800) -> DataFrame:
    """Failed rows (fix_id, tries, next_us) with their state and the time of the next try, doubling each time."""
    state = F.when(F.col("tries") >= most, "PERMANENT").when(F.col("next_us").isNull() | (F.col("next_us") <= now_us), "READY").otherwise("WAITING")
    wait = F.least(first_s * F.pow(F.lit(2), F.col("tries")), F.lit(longest_s)).cast("bigint")
    return failed.select("fix_id", state.alias("state"), F.when(F.col("tries") < most, now_us + wait * 1_000_000).alias("next_us"))
