import random

import numpy as np
import pytest
from fixtures import awkward, docs_table, prose
from pyspark.sql import functions as F

from wayfold.llm import mixing as m


def test_share_fills_up_to_the_cap():
    assert m.share([10, 10, 10], [3, 1, 2], 45, 2) == [20.0, 25 / 3, 50 / 3]
    assert m.share([1, 100], [1, 1], 101 * 1.5, 2) == [2.0, 149.5]
    assert m.share([], [], 0, 2) == []
    assert m.share([0, 4], [3, 1], 6, 2) == [0.0, 6.0]


def test_pivot_keeps_the_sum_and_the_expectation():
    sizes = np.array([7, 3, 5, 11, 2, 9], float)
    fractions = np.full(6, 0.4)
    total = np.zeros(6)
    for s in range(4000):
        x, held = m.pivot(sizes, fractions, np.random.default_rng(s))
        assert abs((sizes * x).sum() - (sizes * fractions).sum()) < 1e-9
        assert all(v in (0.0, 1.0) for k, v in enumerate(x) if k != held)
        total += x
    assert np.abs(total / 4000 - 0.4).max() < 0.03


def test_mix(spark):
    rng = random.Random(1)
    rows = awkward() + [(100 + k, prose(rng, rng.randrange(5, 80)), rng.choice("abcdefghi")) for k in range(900)]
    docs = docs_table(spark, rows)
    got = m.mix(docs, ["doc_id"], block_docs=32).toPandas()
    assert len(got) == len(rows)
    again = m.mix(docs.repartition(5), ["doc_id"], block_docs=32).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], got["copies"])) == sorted(zip(again["doc_id"].fillna(-1), again["size"], again["copies"]))
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = m.share([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s, target in zip(order, shares):
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert set(own["source_size"]) == {sizes[s]} and abs(own["target"].iloc[0] - target) < 1e-6
        assert abs((own["copies"] * own["size"]).sum() - target) <= own["size"].max()
    assert got["copies"].between(0, 2).all()


def test_repeat_rows(spark):
    docs = docs_table(spark, awkward()).withColumn("_copies", F.lit(7)).withColumn("size", F.lit("s"))
    got = m.repeat_rows(docs)
    assert got.columns == docs.columns
    copies = m.mix(docs.select("doc_id", "text", "source"), ["doc_id"])
    assert got.count() == copies.agg(F.sum("copies")).first()[0]
    assert m.repeat_rows(docs.limit(0)).count() == 0


def test_shares_as_a_table_are_those_of_the_driver(spark, monkeypatch):
    rng = random.Random(6)
    rows = awkward() + [(100 + k, prose(rng, rng.randrange(0, 80)), f"src{rng.randrange(40)}") for k in range(500)]
    docs = docs_table(spark, rows)
    want = sorted(map(repr, m.mix(docs, ["doc_id"], block_docs=16).collect()))
    monkeypatch.setattr(m, "DRIVER_SOURCES", 0)
    assert sorted(map(repr, m.mix(docs, ["doc_id"], block_docs=16).collect())) == want
    assert m.mix(docs.limit(0), ["doc_id"]).count() == 0


def test_keys_with_names_of_the_operator(spark):
    docs = docs_table(spark, awkward()).withColumnsRenamed({"doc_id": "block", "lang": "open"})
    got = m.mix(docs, ["block", "open"])
    assert got.columns == ["block", "open", "source", "size", "source_size", "target", "copies"] and got.count() == len(awkward())
    with pytest.raises(ValueError, match="size"):
        m.mix(docs.withColumnRenamed("block", "size"), ["size"])


def test_rows_of_several_sources_keep_their_own_copies(spark):
    """Rows that share id and text but not the source, and rows that share all three, on any partitioning."""
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "t"), (None, "a b", None), (None, "a b", None)] + [(k, "x y z w " * (k % 5 + 1), "stu"[k % 3]) for k in range(2, 60)]
    docs = docs_table(spark, rows).withColumn("n", F.monotonically_increasing_id() % 3).withColumn("_nth", F.lit("x"))
    want = None
    for parts in (1, 3, 7):
        got = m.repeat_rows(docs.repartition(parts))
        assert got.columns == docs.columns
        said = sorted(repr(tuple(r)) for r in got.collect())
        want = want or said
        assert said == want
    copies = m.mix(docs, ["doc_id"]).groupBy("source").agg(F.sum("copies").alias("c")).collect()
    taken = {r["source"]: r["c"] for r in got.groupBy("source").agg(F.count("*").alias("c")).collect()}
    assert taken == {r["source"]: r["c"] for r in copies if r["c"]}
