import random

import numpy as np
from fixtures import awkward, docs_table, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import minhash as m
from wayfold.llm import near_sets
from wayfold.llm.queries import op11_minhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def plain(rows):
    """(doc_id, set size, smallest id of the component) by comparing every pair."""
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 100 * small >= 85 * large and root(i) != root(j):
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    first = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            first[root(k)] = min(first.get(root(k), d), d)
    return sorted(((d, len(s), c := first.get(root(k)), d == c) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def planted(rng):
    rows = [r[:2] for r in awkward(rng)] + [(None, "no id at all"), (None, "no id at all"), (90, "  "), (91, "A b"), (92, "a B")]
    for words in (8, 20, 60, 100, 300, 1000):
        for _ in range(6):
            base = prose(rng, words)
            rows.append((1000 + len(rows), base))
            for k in range(6):
                text = edited(rng, base, rng.randrange(1, 2 + words // 40))
                rows.append((1000 + len(rows), text))
                base = text if k % 2 else base
    return rows


def found(spark, rows):
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    got = m.near_classes(docs_table(spark, rows), ["doc_id"], order).select("doc_id", "n_shingles", F.col("first.doc_id").alias("c"), F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return sorted(map(tuple, got.collect()), key=repr)


def test_equals_all_pairs(spark):
    rows = planted(random.Random(3))
    assert found(spark, rows) == plain(rows)


def test_large_keys_are_cut_by_their_first_shingles(spark, monkeypatch):
    """Copies of one text, each with edits of its own, most of which do not link; in blocks where even that leaves large keys."""
    monkeypatch.setattr(near_sets, "MOST_ROUNDS", 0)
    monkeypatch.setattr(near_sets, "LEFT", 0)
    rng = random.Random(13)
    base = prose(rng, 50)
    rows = planted(rng)[:120] + [(5000 + k, edited(rng, base, rng.randrange(1, 4))) for k in range(200)]
    want = plain(rows)
    for pair_rows, block_rows in ((8, 16), (2, 7)):
        monkeypatch.setattr(near_sets, "PAIR_ROWS", pair_rows)
        monkeypatch.setattr(near_sets, "BLOCK_ROWS", block_rows)
        assert found(spark, rows) == want


def test_a_key_of_thousands_carries_each_set_a_few_times(spark, monkeypatch, tmp_path):
    """Texts with a common footer: rows that are cut and paired stay below 8 a set."""
    rng, made = np.random.default_rng(1), 3000
    footer = rng.integers(1 << 62, 1 << 63, 40)
    own = [np.unique(np.concatenate([footer, rng.integers(0, 1 << 62, 20)])).astype(np.int64) for _ in range(made)]
    sets = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(own)], "fp bigint, shingles binary")
    members = spark.createDataFrame([(k, len(x), k) for k, x in enumerate(own)], "fp bigint, n int, root bigint")
    assert near_sets.first_shingles(members, sets, m.SHARE, str(tmp_path)).count() < 8 * made


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 3), min_size=m.PARTS * m.SYMBOLS, max_size=m.PARTS * m.SYMBOLS), st.sets(st.integers(0, m.PARTS * m.SYMBOLS - 1), max_size=m.DISTANCE))
def test_signatures_within_the_distance_share_a_key(symbols, changed):
    a = np.array([symbols, symbols], "<u2")
    for c in changed:
        a[1, c] += 9
    keys = m.part_keys(a)
    assert set(keys[0]) & set(keys[1])


def test_pairs_at_the_limit_are_within_the_distance():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        common = rng.integers(0, 1 << 64, 170, np.uint64, endpoint=False)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 64, 15, np.uint64, endpoint=False)]) for _ in range(2))
        missed += (m.signature(a) != m.signature(b)).sum() > m.DISTANCE
    assert missed <= 3


def test_query_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, op11_minhash(spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == plain(rows)
    assert found(spark, []) == []


def test_first_shingles_of_near_sets_meet():
    for share in (m.SHARE, near_sets.Share(4, 5)):
        for n in range(1, 200):
            # of two near sets of n shingles with c in common, the first ones reach into the common part
            least = -(-2 * n * share.up // (share.up + share.down))
            assert share.first_of(n) > n - least >= 0 and share.first_of(n) == n - -(-n * share.up // share.down) + 1


def test_hashes_that_collide_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 3, b"a"), (1, 3, b"a"), (1, 4, b"b"), (2, 3, b"c")], "fp bigint, n int, sketch binary")
    got = near_sets.told_apart(rows, F.hash("n", "sketch")).collect()
    assert len({r["fp"] for r in got}) == 3
