import random

import numpy as np
import pytest
from fixtures import awkward, docs_table, prose
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wayfold.llm import simhash as s
from wayfold.llm.shared import shared_dir


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    """The least index that each value reaches over distances of 3 or fewer."""
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array(values, np.uint64)
    for a in range(len(v)):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= 3) + a + 1:
            x, y = root(a), root(int(b))
            up[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(v))]


def planted(rng, n, centres):
    """Random fingerprints, and some whose copies differ in a few bits, in chains."""
    made = [rng.getrandbits(64) for _ in range(n)]
    for c in range(centres):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(2, 60)):
            made.append(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(set(made))


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = random.Random(8)
    values = planted(rng, 500, 25)
    dense = rng.getrandbits(64)
    values = sorted({*values, *(dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(800))})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = roots(values)
    groups = {}
    for v, r in zip(signed, want):
        groups.setdefault(r, set()).add(v)
    for group_rows, hot_group in ((64, s.HOT_GROUP), (10**-6, s.HOT_GROUP), (64, 100)):
        monkeypatch.setattr(s, "HOT_GROUP", hot_group)
        edges = s.links(frame, len(values), group_rows=group_rows)
        found = {r["node"]: r["root"] for r in s.components(edges, shared_dir(spark, "test")).collect()}
        by_root = {}
        for v in signed:
            by_root.setdefault(found.get(v, v), set()).add(v)
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, groups.values()))


def test_walk_and_cut_groups_agree(monkeypatch):
    rng = random.Random(5)
    values = np.array(planted(rng, 300, 30), np.uint64)
    monkeypatch.setattr(s, "WALK_ROWS", 40)
    for links in (s.walk(values, 3), s.group_links(values, list(range(64)), 3)):
        forest = s.Forest()
        for a, b in links:
            forest.link(a, b)
        assert [forest.root(k) for k in range(len(values))] == roots(values.tolist())
    for radius in range(6):
        got = {(int(a), int(b)) for i, j in s.shifted_pairs(values[:200], np.zeros(200), np.full(200, 200), radius) for a, b in zip(i, j)}
        assert got == {(a, b) for a in range(200) for b in range(a + 1, 200) if int(values[a] ^ values[b]).bit_count() <= radius}


def test_near_classes(spark):
    rng = random.Random(2)
    base = prose(rng, 400)
    rows = awkward() + [(1000 + k, base if k % 3 else base + f" tail{k % 7}", "a") for k in range(60)]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    got = s.near_classes(docs_table(spark, rows), ["doc_id"], order).collect()
    values = [plain(r[1]) for r in rows]
    by_row = roots(values)
    first = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            first[by_row[k]] = min(first.get(by_row[k], r[0]), r[0])
    want = sorted(repr((r[0], values[k], first.get(by_row[k]))) for k, r in enumerate(rows))
    assert sorted(repr((r["doc_id"], r["fp"] % (1 << 64), r["first"]["doc_id"])) for r in got) == want
    kept = s.drop_near_copies(docs_table(spark, rows).withColumn("fp", F.lit(0)))
    assert kept.count() == len(set(by_row)) and kept.columns[-1] == "fp"
    assert s.drop_near_copies(docs_table(spark, rows).limit(0)).count() == 0


def test_hot_groups_are_cut_before_they_are_dealt(spark, monkeypatch):
    """Fingerprints that share half of their bits make one group, which has to end in many."""
    monkeypatch.setattr(s, "HOT_GROUP", 100)
    rng = random.Random(1)
    values = [rng.getrandbits(32) for _ in range(2000)]
    keyed = spark.createDataFrame([(-(1 << 32), 0, v) for v in values], "mask bigint, key bigint, fp bigint")
    cut = s.cut_hot(keyed, 2000, 3).groupBy("mask", "key").count().agg(F.max("count"), F.count("*")).first()
    assert cut[0] <= 100 and cut[1] > 100


def test_hubs_are_dealt(spark):
    edges = spark.range(25_000).select(F.lit(-1).cast("bigint").alias("a"), F.col("id").alias("b")).unionByName(spark.range(30_000, 30_010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r["node"]: r["root"] for r in s.components(edges, shared_dir(spark, "test")).collect()}
    assert got == {**{k: -1 for k in range(25_000)}, **{k: 30_000 for k in range(30_001, 30_011)}}


def test_keys_named_like_results(spark):
    with pytest.raises(ValueError, match="fp"):
        s.near_classes(docs_table(spark, awkward()).withColumnRenamed("doc_id", "fp"), ["fp"], F.col("fp"))
