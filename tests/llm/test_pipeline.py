"""The pipeline's stages, each against a plain version on its own input."""

import math
import random
import re

import corpus_pipeline as cp
from fixtures import docs_table, prose
from pyspark.sql import functions as F
from test_near_copies import least_ids

from wayfold.llm import toxicity

SF = "/root/testdata/sf0.001"


def plain_score(text, model):
    """The model's score of a text, by counting words and first letters one by one."""
    words = {w for w in re.split(r"[\W\d_]+", text.lower()) if w}
    total = model.bias + sum(model.weights.get(w, 0.0) for w in words)
    for k in (4, 5):
        for start in {w[:k] for w in words if len(w) > k}:
            n = sum(len(w) > k and w.startswith(start) for w in words)
            total += sum(model.weights.get(start + "*" * m, 0.0) for m in (1, 2, 3) if m <= n)
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def test_toxicity_drops_what_a_plain_score_drops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: plain_score(r["text"] or "", model) for r in docs.collect()}
    assert all(abs(s - 0.5) > 1e-9 for s in scores.values()) and 0 < sum(s < 0.5 for s in scores.values())
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.5)


def test_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    unique = cp.drop_exact_copies(spark, docs, SF)
    assert {r["doc_id"] for r in unique.collect()} == {max(i for i, x in rows.items() if x == t) for t in rows.values()}
    near = cp.drop_near_copies(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"] or "") for r in near.collect()) == least_ids(list(rows.items()))
    assert unique.columns == near.columns == docs.columns


def test_mix_takes_each_source_s_share(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len((r["text"] or "").encode().split()) for i, r in rows.items()}
    taken: dict = {}
    for r in mixed.collect():
        assert r == rows[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 2
    by_source: dict = {}
    for i, r in rows.items():
        by_source.setdefault(r["source"], []).append(i)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by_source[s]) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    # Water filling, by bisection on the level instead of in rounds.
    low, high = 0.0, 4.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in order) < 1.5 * sum(total.values()) else (low, level)
    for s in order:
        got = sum(size[i] * taken.get(i, 0) for i in by_source[s])
        assert abs(got - min(2 * total[s], low * weight[s])) <= max(size[i] for i in by_source[s]) + 1e-6


def test_packed_sequences_are_full_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = cp.pack_sequences(spark, docs, SF).select("doc_id", "piece", "start", "length", "sequence_id", "offset").toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    for _, own in packed.sort_values("piece").groupby("doc_id"):
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    assert packed["sequence_id"].nunique() <= 1.02 * packed["length"].sum() / 2048 + 1


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def test_stages_take_awkward_tables(spark):
    rng = random.Random(1)
    rows = [(1, None, None), (None, "", "a"), (2, "x", "a"), (2, "x", "a"), (2, "y", "b"), (3, prose(rng, 3000), "b")]
    extra = docs_table(spark, rows).withColumn("_sha", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_id1", F.lit(3))
    for docs in (extra, extra.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
