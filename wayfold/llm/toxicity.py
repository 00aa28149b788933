"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else, labelled or not, is unlabelled text. The risk of a
linear classifier g over text features is estimated as  p R+(g, positives) + max(0, R-(g, unlabelled) - p R-(g,
positives)),  p being the class prior: the share of toxic ones among the labelled rows. Where the second term
falls below zero the step goes the other way, so that unlabelled toxic text is not learnt as clean.

Features are the different words of the lower-cased text, and first letters that one, two or three of them share. The vocabulary holds those
that a certain share of the positives has, and that are much more or less usual there than in unlabelled text.
Classifiers are trained with numpy in Spark tasks, one for each shard of a bounded sample, and averaged.

The sample is bounded by MOST_POSITIVE and MOST_UNLABELLED; only rows outside the held-out fold are in it. Every
document is scored over its whole text. Null and empty texts have no features and score by the bias alone, as do
all texts if nothing can be learnt; without any label the prior is 0. Null labels count as unlabelled. Repeated
rows score alike. An empty table gives no rows. Columns other than the text are never a score's input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import arrow_rows, free_names, shared_dir, ship_package, whole, written

#: Bounds of what training sees unless other ones, or None for all, are given: labelled rows, unlabelled rows, features.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 6000, 18000, 20_000
#: Training shards of bounded samples; rows of a shard when all rows are taken, and positives that a shard needs.
SHARDS, SHARD_ROWS, SHARD_POSITIVES = 8, 3000, 200
#: Deviations by which a feature's count among the positives must differ from its usual one.
LEAST_GAIN = 4.0
FOLDS, HELD_OUT = 5, 0
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights by feature: words, and first letters marked by `*`."""

    weights: dict[str, float]
    bias: float


def features(text: str) -> set[str]:
    """Words, and first letters with as many marks as different words begin so, up to three."""
    words = set(WORD.findall(text.lower()))
    found = set(words)
    for k in (4, 5):
        for start, n in Counter([w[:k] for w in words if len(w) > k]).items():
            found.update(start + "*" * m for m in range(1, min(n, 3) + 1))
    return found


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that training never sees; one without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def train_shard(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias that minimise the non-negative risk over feature ids by row."""
    lengths = np.array([len(r) for r in rows])
    ids, owner = np.concatenate([*rows, np.array([], np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)
    pos, unl = positive.astype(bool), ~positive.astype(bool)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        g = np.bincount(owner, w[ids], len(rows)) + w[-1]
        up = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # the slope of the loss of calling a row negative
        loss = np.logaddexp(0, g)
        clean = loss[unl].mean() - prior * loss[pos].mean()
        slope = np.zeros(len(rows))
        if clean >= 0:
            slope[pos] = prior * ((up[pos] - 1) - up[pos]) / pos.sum()
            slope[unl] = up[unl] / unl.sum()
        else:  # the negative part alone, upwards
            slope[pos] = prior * up[pos] / pos.sum()
            slope[unl] = -up[unl] / unl.sum()
        grad = np.append(np.bincount(ids, slope[owner], size), slope.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 5, most_positive: int | None = MOST_POSITIVE, most_unlabelled: int | None = MOST_UNLABELLED, most_features: int | None = MOST_FEATURES) -> Model:
    """A model from docs and labels (doc_id, label 0/1) outside the held-out fold.

    The bounds are of the sample; None takes all positives, all unlabelled rows, all telling features. Unlabelled rows
    without a bound are dealt over as many shards as they need, and each shard gets one of the groups of positives.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    order = F.xxhash64(F.col(doc_id), F.lit(seed))
    named = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).select(doc_id, F.col(label).alias("_label"))
    seen = named.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_label") == 1).cast("int")).alias("toxic")).first()
    if not seen["n"] or not seen["toxic"] or seen["toxic"] == seen["n"]:
        return Model({}, -30.0 if not seen["toxic"] else 30.0)
    prior = seen["toxic"] / seen["n"]

    confirmed = named.where("_label = 1").select(doc_id).distinct().withColumn("_positive", F.lit(True))
    if most_positive is not None:
        confirmed = F.broadcast(confirmed.orderBy(order).limit(most_positive))
    open_docs = docs.where(~held_out(F.col(doc_id))).select(doc_id, whole(F.col(text)).alias("_text"))
    share = 1.0 if most_unlabelled is None else min(1.0, most_unlabelled / max(1, open_docs.count()))
    drawn = F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))
    # Bounded positives are broadcast. A positive may be drawn as unlabelled text as well: that is what unlabelled means.
    met = open_docs.join(confirmed, doc_id, "left").where(F.col("_positive") | drawn)
    roles = F.array_compact(F.array(F.when(F.col("_positive"), F.lit(1)), F.when(drawn, F.lit(0))))
    source = met.select(F.explode(roles).alias("positive"), F.xxhash64(F.col(doc_id), F.lit(seed + 1)).alias("shard"), "_text")

    def featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(features(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["positive", "shard", "features"])

    where = shared_dir(spark, "toxicity")
    sample = written(source.mapInArrow(featurize, "positive int, shard bigint, features array<string>"), f"{where}/sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, math.log(prior / (1 - prior)))
    counts = sample.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    ratio = F.log((F.col("p") + 0.5) / (sizes[1] + 1)) - F.log((F.col("u") + 0.5) / (sizes[0] + 1))
    # How many positives would have the feature if they were like the rest, and by how many deviations they differ.
    usual = F.col("u") * (sizes[1] / sizes[0])
    gain = F.abs(F.col("p") - usual) / F.sqrt(usual + 1)
    telling = counts.where((F.abs(ratio) > math.log(2)) & (gain > LEAST_GAIN)).withColumn("gain", gain)
    telling = telling.orderBy(F.desc("gain"), "feature")
    vocabulary = [r["feature"] for r in (telling if most_features is None else telling.limit(most_features)).collect()]
    if not vocabulary:
        return Model({}, math.log(prior / (1 - prior)))
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary)})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        known = index.value
        positive = pdf["positive"].to_numpy()
        if positive.all() or not positive.any():
            return pd.DataFrame({"weights": []})
        ids = [[known[f] for f in fs if f in known] for fs in pdf["features"]]
        # A shuffle hands on rows in any order, and sums of doubles depend on it.
        order = sorted(range(len(ids)), key=lambda k: (positive[k], ids[k]))
        return pd.DataFrame({"weights": [train_shard([np.array(ids[k], np.int64) for k in order], positive[order], len(known), prior)]})

    # Few positives are kept together: a shard needs enough of them.
    groups = max(1, sizes[1] // SHARD_POSITIVES)
    if most_unlabelled is not None:
        shards = min(SHARDS, groups)
        dealt = sample.withColumn("shard", F.pmod(F.pmod("shard", F.lit(SHARDS)), F.lit(shards)))
    else:
        shards = max(groups, -(-sizes[0] // SHARD_ROWS))
        own = F.pmod(F.col("shard"), F.lit(groups))
        dealt = sample.withColumn("shard", F.explode(F.when(F.col("positive") == 1, F.sequence(own, F.lit(shards - 1).cast("bigint"), F.lit(groups).cast("bigint"))).otherwise(F.array(F.pmod(F.col("shard"), F.lit(shards))))))
    made = dealt.groupBy("shard").applyInPandas(fit, "weights array<double>")
    mean = F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda a, w: a + w) / F.count("w")
    fitted = [r["w"] for r in made.select(F.posexplode("weights").alias("i", "w")).groupBy("i").agg(mean.alias("w")).orderBy("i").collect()]
    if not fitted:
        return Model({}, math.log(prior / (1 - prior)))
    return Model(dict(zip(vocabulary, fitted, strict=False)), fitted[-1])


def score(docs: DataFrame, model: Model, text: str = "text", result: str = "score") -> DataFrame:
    """docs with `result`, from 0 to 1: how likely the text is toxic."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value.weights, shared.value.bias
        known = weights.keys()
        for texts in batches:
            sums = np.array([sum(weights[f] for f in features(t) & known) for t in texts], float) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return docs.withColumn(result, apply(whole(F.col(text))))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below `least`, with all columns."""
    (name,) = free_names(docs, "_score")
    return score(docs, model, text, name).where(F.col(name) < least).drop(name)
