import hashlib

from fixtures import awkward, docs_table
from pyspark.sql import functions as F

from wayfold.llm import exact_dedup as x
from wayfold.llm.shared import shared_dir


def test_classes_even_where_keys_collide(spark):
    rows = awkward() + [(1000 + k, "hot", "a") for k in range(400)] + [(5000 + k, f"text {k % 150}", "a") for k in range(600)]
    docs = docs_table(spark, rows)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for bits in (64, 5):
        got = x.exact_classes(docs, capacity=16, key_bits=bits).collect()
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert sum(r["kept"] for r in got) == len(groups)
        # Links number the different texts of a key; short keys have chains of several.
        chains: dict = {}
        for r in got:
            chains.setdefault(r["key"], {}).setdefault(r["text_sha256"], set()).add(r["link"])
        assert all(sorted(x for v in c.values() for x in v) == list(range(1, len(c) + 1)) for c in chains.values())
        assert (max(map(len, chains.values())) > 1) == (bits == 5)


def test_classes_come_from_the_chains(spark, monkeypatch):
    """An owner that loses its links leaves every document of a shared key in a class of its own."""
    docs = docs_table(spark, [(k, f"text {k % 3}", "a") for k in range(30)])
    real = x.written
    monkeypatch.setattr(x, "written", lambda df, path: real(df.limit(0) if path.endswith("/links") else df, path))
    assert all(r["group_size"] == 1 and r["kept"] for r in x.exact_classes(docs).collect())


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    leaves, depths = x.grow_directory(keys, 64, shared_dir(spark, "test"))
    found = leaves.collect()
    assert sum(r["keys"] for r in found) == 5000
    assert max(r["keys"] for r in found) <= 64
    assert sum(2.0 ** -r["depth"] for r in found) == 1.0
    close = spark.range(300).select((F.col("id") + 5).alias("key"))
    leaves, depths = x.grow_directory(close, 64, shared_dir(spark, "test"), most_bits=20)
    assert [(r["depth"], r["keys"]) for r in leaves.collect()] == [(20, 300)]


def test_drop_copies_keeps_columns_and_rows(spark):
    rows = awkward()
    docs = docs_table(spark, rows).withColumn("_sha0", F.lit(1)).withColumn("key", F.lit("k"))
    got = x.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["text"] or "" for r in got.collect()) == sorted({r[1] or "" for r in rows})
    assert x.drop_copies(docs.limit(0)).count() == 0
