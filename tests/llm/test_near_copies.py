import random

import corpus_pipeline as cp
import numpy as np
from fixtures import awkward, docs_table, prose

from wayfold.llm import near_copies as nc
from wayfold.llm import near_sets
from wayfold.llm import simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def planted(rng):
    """Copies with few and with many edits, in chains too, of short and long texts."""
    rows = [r for r in awkward(rng) if r[0] is not None]
    for words in (20, 60, 100, 300, 1000):
        for _ in range(6):
            base = prose(rng, words)
            rows.append((1000 + len(rows), base))
            for k in range(6):
                text = edited(rng, base, rng.randrange(1, 2 + words // 30))
                rows.append((1000 + len(rows), text))
                base = text if k % 2 else base
    return rows


def components(rows):
    sets, up = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
                near += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(rows))], near


def least_ids(rows):
    """Of each component the row with the least (id, text)."""
    import hashlib

    by_root = {}
    for k, r in zip(components(rows)[0], rows):
        by_root.setdefault(k, []).append((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1]))
    return sorted((i, t or "") for i, _, t in map(min, by_root.values()))


def test_stage_drops_what_brute_force_jaccard_links(spark):
    rows = planted(random.Random(11))
    got = cp.STAGES[2][1](spark, docs_table(spark, rows), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == least_ids(rows)


def test_rounds_of_stars_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "LEFT", 0)
    monkeypatch.setattr(near_sets, "MOST_ROUNDS", 2)
    rng = random.Random(12)
    base = prose(rng, 80)
    rows = planted(rng)[:150] + [(5000 + k, edited(rng, base, rng.randrange(1, 4))) for k in range(150)]
    got = nc.drop_near_copies(docs_table(spark, rows))
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == least_ids(rows)


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    """Copies of one text, each with an edit of its own, that mostly do not link with each other."""
    monkeypatch.setattr(near_sets, "PAIR_ROWS", 8)
    monkeypatch.setattr(near_sets, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_sets, "MOST_ROUNDS", 0)
    rng = random.Random(13)
    base = prose(rng, 50)
    rows = planted(rng)[:120] + [(5000 + k, edited(rng, base, rng.randrange(1, 4))) for k in range(200)]
    got = nc.drop_near_copies(docs_table(spark, rows))
    want = least_ids(rows)
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == want and len(want) > 100


def test_bands_find_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(1000):
        a = rng.integers(0, 1 << 64, 100, np.uint64, endpoint=False)
        b = np.concatenate([a[:89], rng.integers(0, 1 << 64, 11, np.uint64, endpoint=False)])
        missed += not (nc.band_keys(a) == nc.band_keys(b)).any()
    assert missed <= 3


def test_fingerprints_of_pairs_at_the_limit_are_within_the_radius(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in (9, 45, 450):
        for k in range(1000):
            common = rng.integers(0, 1 << 64, size * 8 // 9, np.uint64, endpoint=False)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 64, size // 9, np.uint64, endpoint=False)]) for _ in range(2))
            rows.append((k, size, *(int(np.uint64(simhash.majority(x)).view(np.int64)) for x in (a, b))))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, a_bits bigint, b_bits bigint")
    assert simhash.pairs_within(pairs, nc.RADIUS).count() >= len(rows) - 3
    want = sorted((r[0], r[1]) for r in rows if ((r[2] ^ r[3]) % (1 << 64)).bit_count() <= 9)
    assert sorted(map(tuple, simhash.pairs_within(pairs, 9).collect())) == want
