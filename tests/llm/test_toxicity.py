import random
import zlib

import numpy as np
from fixtures import awkward, docs_table, prose
from pyspark.sql import functions as F

from wayfold.llm import toxicity as t
from wayfold.llm.queries import op6_toxicity


def corpus(n=1500):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.12
        text = prose(rng, 60)
        if toxic:
            text += " " + " ".join(rng.choice(["vile", "nasty", "rotten", "foul"]) for _ in range(3))
        docs.append((k, text, "a"))
        if rng.random() < 0.5:
            labels.append((k, int(toxic)))
    return docs, labels, {k for k, text, _ in docs if text.split()[-1] in ("vile", "nasty", "rotten", "foul")}


def test_held_out_accuracy_and_fold(spark):
    docs, labels, toxic = corpus()
    frame = docs_table(spark, docs)
    model = t.train(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = t.score(frame, model).select("doc_id", "score", t.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["out"]]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] in toxic) for r in out) / len(out) > 0.97
    assert t.drop_toxic(frame.withColumn("_score", F.lit(1)), model).columns == [*frame.columns, "_score"]


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(400)
    frame = docs_table(spark, docs)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    models = [t.train(frame, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_order_of_rows_does_not_matter(spark):
    docs, labels, _ = corpus(400)
    frame, marked = docs_table(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    turned = frame.orderBy(F.desc("doc_id")).coalesce(1)
    assert t.train(frame, marked) == t.train(turned, marked)


def test_negative_part_is_not_driven_below_zero():
    rng = np.random.default_rng(1)
    rows = [np.array([0]) if k < 20 else np.array([1 + k % 3]) for k in range(120)]
    positive = np.array([k < 10 for k in range(120)])  # ten more of the kind are unlabelled
    w = t.train_shard(rows, positive, 4, 0.18)
    assert w[0] + w[-1] > 0 > w[1] + w[-1]
    assert rng is not None


def test_awkward_rows(spark):
    frame = docs_table(spark, awkward())
    for labels in ([], [(1, 1)], [(1, 0), (None, 1), (4, None)], [(k, k % 2) for k in range(1, 60)]):
        model = t.train(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        got = t.score(frame, model).collect()
        assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 8}) == 1
    assert t.score(frame.limit(0), t.Model({}, 0.0)).count() == 0


def test_query(spark):
    got = op6_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200


def test_without_bounds_all_rows_are_seen(spark, monkeypatch):
    """Many small shards, each with its own unlabelled rows and a group of the positives."""
    monkeypatch.setattr(t, "SHARD_ROWS", 40)
    monkeypatch.setattr(t, "SHARD_POSITIVES", 10)
    rng = random.Random(9)
    rows = [(k, prose(rng, 30) + (" vile foul rotten" if k % 6 == 0 else "")) for k in range(600)]
    docs = docs_table(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(600)], "doc_id bigint, toxic int")
    model = t.train(docs, labels, most_positive=None, most_unlabelled=None, most_features=None)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in t.score(docs, model).collect()}
    assert sum(got[k] == (k % 6 == 0) for k in range(600)) > 580
