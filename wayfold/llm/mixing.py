"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of the source. Its fraction is
rounded dependently: two fractional documents exchange mass, measured in words, in a random direction whose odds
keep both expectations, until one of them is integral. Blocks of a source do so on their own and leave one
fractional document each; those meet in ever fewer blocks, a reduction tree, and the last one of a source is
rounded alone. So the words taken from a source miss its target by less than one document.

Null texts have size 0; null is a source of its own, ordered last. Documents of size 0 get no copies that count.
Repeated rows are documents of their own. An empty table gives no rows. Which documents gain depends on their
ids, texts and the seed only, not on partitions or order, so reruns agree. Keys may have any names but those of the
result. Rows that repeat keys and text lie in one block.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm.shared import free_names, lookup, own_keys, shared_dir, ship_package, whole, written

#: Documents in a block of the first level, and blocks that meet in one of the next.
BLOCK_DOCS, FAN_IN = 4096, 1024
#: Sources, about 60 bytes each, whose shares the driver finds and broadcasts; of more a table is made in rounds.
DRIVER_SOURCES = 100_000
#: A word, and the weights that sources take in turn.
WORD, WEIGHTS = r"[^\x20\x09-\x0D]+", (3, 1, 2)


def share(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """total shared by weight, no share above cap times the size; what is above is shared again."""
    shares, active, rest = [0.0] * len(sizes), list(range(len(sizes))), total
    while active:
        weight = sum(weights[i] for i in active)
        over = [i for i in active if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in active:
                shares[i] = rest * weights[i] / weight
            break
        for i in over:
            shares[i] = float(cap * sizes[i])
        full = set(over)
        active = [i for i in active if i not in full]
        rest -= sum(shares[i] for i in over)
    return shares


def pivot(sizes: np.ndarray, fractions: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Fractions made 0 or 1 but for one at most, whose index is returned, or -1. Keeps the sum of sizes * fractions."""
    x, draws = fractions.copy(), rng.random(len(fractions))
    held = -1
    for j in range(len(x)):
        if not 0.0 < x[j] < 1.0:
            continue
        if sizes[j] == 0:
            x[j] = 0.0
            continue
        if held < 0:
            held = j
            continue
        i, s, t = held, float(sizes[held]), float(sizes[j])
        up, down = min(s * (1 - x[i]), t * x[j]), min(s * x[i], t * (1 - x[j]))
        if draws[j] * (up + down) < down:
            full = s * (1 - x[i]) <= t * x[j]
            a, b = (1.0, x[j] - up / t) if full else (x[i] + up / s, 0.0)
        else:
            empty = s * x[i] <= t * (1 - x[j])
            a, b = (0.0, x[j] + down / t) if empty else (x[i] - down / s, 1.0)
        x[i], x[j] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
        held = i if 0.0 < x[i] < 1.0 else j if 0.0 < x[j] < 1.0 else -1
    return x, held


def block_rounder(keys: list[str], level: int, last: bool, seed: int):
    """A function that rounds the fractions of a block (source, block); all of them if it is the last of its source."""

    def round_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "size"], kind="stable", na_position="first").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(key[0]).encode()), int(key[1])])
        # The largest first, so that mass left over at the end is a small document's.
        order = np.lexsort((rng.random(len(pdf)), -pdf["size"].to_numpy()))
        x, held = pivot(pdf["size"].to_numpy()[order], pdf["fraction"].to_numpy()[order], rng)
        if last and held >= 0:
            x[held], held = float(rng.random() < x[held]), -1
        back = np.empty(len(pdf))
        back[order] = x
        is_open = np.zeros(len(pdf), bool)
        if held >= 0:
            is_open[order[held]] = True
        gained = np.where(is_open, 0, np.rint(back)).astype("int64")
        return pdf.assign(copies=pdf["copies"] + gained, fraction=np.where(is_open, back, 0.0), open=is_open)

    return round_block


def positions(rows: DataFrame, by: list[Column], where: str) -> DataFrame:
    """rows with `position`, from 0 in the order of `by`: numbered within ranges, whose sizes are added up."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), where)
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate([0, *(sizes[k] for k in sorted(sizes))]), strict=False))
    table = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "_range int, _before bigint"))
    return ranged.join(table, "_range").withColumn("position", F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*by)) - 1).drop("_range", "_before")


def share_table(totals: DataFrame, weights: tuple[float, ...], epoch: float, cap: float, where: str) -> DataFrame:
    """totals (source, size, docs) with `target`, as share() finds it: each round settles all sources above their cap."""
    placed = positions(totals, [F.col("source").isNull(), F.col("source")], f"{where}/positions")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    left = written(placed.withColumn("weight", turn), f"{where}/weights")
    rest, settled, k = epoch * (left.agg(F.sum("size")).first()[0] or 0), None, 0
    while True:
        weight = left.agg(F.sum("weight")).first()[0]
        level = left.withColumn("target", F.col("weight") * rest / (weight or 1.0)).withColumn("over", F.col("target") > cap * F.col("size"))
        level = written(level, f"{where}/round-{k}")
        over = level.where("over")
        spent = over.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
        done = (over.withColumn("target", cap * F.col("size")) if spent["n"] else level).select("source", "size", "docs", F.col("target").cast("double").alias("target"))
        settled = done if settled is None else settled.unionByName(done)
        if not spent["n"]:
            return settled
        rest, left, k = rest - cap * spent["size"], level.where("not over").drop("target", "over"), k + 1


def _plan(sized: DataFrame, weights: tuple[float, ...], epoch: float, cap: float, block_docs: int, where: str) -> tuple[DataFrame, int, bool]:
    """(_source, source_size, target, rate, blocks) by source, the most blocks of one, and whether the plan may be broadcast."""
    spark = sized.sparkSession
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), f"{where}/totals")
    small = totals.count() <= DRIVER_SOURCES
    if small:
        rows = sorted(totals.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in rows]
        targets = share(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epoch * sum(sizes), cap)
        shares = spark.createDataFrame([(r["source"], r["size"], r["docs"], float(t)) for r, t in zip(rows, targets, strict=True)], "source string, size bigint, docs bigint, target double")
    else:
        shares = share_table(totals, weights, epoch, cap, f"{where}/shares")
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("size"))).otherwise(0.0)
    plan = shares.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", rate.alias("rate"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    return plan, int(totals.agg(F.ceil(F.max("docs") / block_docs).alias("n")).first()["n"] or 1), small


def mix(docs: DataFrame, keys: list[str], text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, epoch: float = 1.5, cap: float = 2.0, seed: int = 17, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row for each row of docs: keys, source, size, source_size, target, copies.

    weights are taken in turn by the sources in code point order; epoch: the mix's words over all words; cap: the
    most copies. keys identify documents and seed their draws.
    """
    spark = docs.sparkSession
    ship_package(spark)
    where = shared_dir(spark, "mixing")
    own = own_keys(keys, "source", "size", "source_size", "target", "copies")
    sized = written(docs.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(source).cast("string").alias("source"), F.regexp_count(whole(F.col(text)), F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(whole(F.col(text))).alias("_tie")), f"{where}/sizes")
    plan, blocks, small = _plan(sized, weights, epoch, cap, block_docs, where)
    # Null is a source too: the key of the join is never null.
    named = lambda c: F.concat(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(c, F.lit("")))
    keyed, plan = sized.withColumn("_plan", named(F.col("source"))), plan.withColumn("_plan", named(F.col("_source")))
    met = keyed.join(F.broadcast(plan), "_plan") if small else lookup(keyed, plan, ["_plan"], sized.count(), F.xxhash64(*own, "_tie"), "inner")
    start = met.withColumn("block", F.pmod(F.xxhash64(*own, "size", "_tie", F.lit(seed)), F.col("blocks"))).select(
        *own, "source", "size", "_tie", "source_size", "target", F.floor("rate").cast("bigint").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"), "block", F.lit(False).alias("open")
    )
    level, done, rows = 0, None, start
    while True:
        last = blocks <= 1

        out = written(rows.groupBy("source", "block").applyInPandas(block_rounder([*own, "_tie"], level, last, seed), rows.schema), f"{where}/level-{level}")
        closed = out.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "source", "size", "source_size", "target", "copies")
        rows = out.where("open").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("bigint"))
        level, blocks = level + 1, math.ceil(blocks / FAN_IN)


def repeat_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """docs with every row as often as the mix takes it.

    A row's copies are found by its id, text and source. Rows that share all three take theirs in the order of their
    other columns, so reruns agree; they meet in one task, as they do in the mix.
    """
    key, id2, key2, source2, nth, nth2, rows, copies = free_names(docs, "_key", "_id2", "_key2", "_source2", "_nth", "_nth2", "_rows", "_copies")
    of_text = F.xxhash64(whole(F.col(text)))
    plain = docs.select(F.col(doc_id).alias("_id"), of_text.alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    mixed = written(mix(plain, ["_id", "_key"], "_text", "_source", **options).select(F.col("_id").alias(id2), F.col("_key").alias(key2), F.col("source").alias(source2), F.col("copies").alias(copies)), shared_dir(docs.sparkSession, "copies"))
    alike = [id2, key2, source2]
    several = mixed.groupBy(*alike).agg(F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 1)
    same = lambda other: F.col(doc_id).eqNullSafe(other[id2]) & (F.col(key) == other[key2]) & F.col(source).cast("string").eqNullSafe(other[source2])
    again = lambda left, right: left[id2].eqNullSafe(right[id2]) & (left[key2] == right[key2]) & left[source2].eqNullSafe(right[source2])
    marked = docs.withColumn(key, of_text)
    if several.isEmpty():
        met = marked.join(mixed, same(mixed))
    else:
        several = written(several, shared_dir(docs.sparkSession, "alike"))
        ranked = mixed.join(several, again(mixed, several), "left_semi").withColumn(nth2, F.row_number().over(W.partitionBy(*alike).orderBy(F.col(copies).desc())))
        doubled = marked.join(several, same(several), "left_semi").withColumn(nth, F.row_number().over(W.partitionBy(doc_id, key, F.col(source).cast("string")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
        once = mixed.join(several, again(mixed, several), "left_anti")
        met = marked.join(once, same(once)).unionByName(doubled.join(ranked, same(ranked) & (F.col(nth) == F.col(nth2))).drop(nth, nth2))
    return met.where(F.col(copies) > 0).withColumn(rows, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
