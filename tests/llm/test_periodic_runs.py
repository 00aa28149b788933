import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import awkward, docs_table, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import periodic_runs as p
from wayfold.llm.queries import op12_periodic_runs

CONTRACT = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def brute(words):
    """Every stretch of every period, by comparing all words; the smallest period of equal stretches."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def expected(doc_id, text, planted=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def made_of(rng, kind, n):
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # Fibonacci words have runs of many periods
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        return [0] * n
    out = []
    while len(out) < n:
        base = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 12))]
        out += (base * 12)[: rng.randrange(5, 90)] + ([rng.randrange(40)] if rng.random() < 0.5 else [])
        if rng.random() < 0.2:
            out += out[: rng.randrange(len(out))]
    return out[:n]


@pytest.mark.parametrize("kind", range(4))
def test_runs_equal_brute_force(kind):
    rng = random.Random(kind)
    for n in [0, 1, 23, 24, 25, 60, *[rng.randrange(30, 400) for _ in range(60 if kind != 2 else 5)]]:
        words = made_of(rng, kind, n)
        assert p.runs(np.array(words, np.int64)) == brute(words)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_segments_are_last_occurrences(words):
    """The former colour of each segment is the last place where its strings ended."""
    automaton = p.Automaton()
    for i, w in enumerate(words):
        automaton.append(w)
        got = automaton.access(i)
        text = words[: i + 1]
        want = {}
        for m in range(1, i + 1):
            ends = [j for j in range(m - 1, i) if text[j - m + 1 : j + 1] == text[i - m + 1 :]]
            if ends:
                want[max(ends)] = m
        assert {j: m for j, m in got if m} == want


def test_long_runs_are_linear():
    n = 20_000
    assert p.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    base = np.random.default_rng(1).permutation(n // 4)
    assert p.runs(np.tile(base, 4)) == [(0, n, n // 4)]


def test_table_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in awkward(rng) if r[0] not in (5, 6)] + [(500 + k, " ".join(f"w{x}" for x in made_of(rng, k % 4, 120)), "a") for k in range(80)] + [(700 + k, prose(rng, 150), "b") for k in range(60)]
    docs = docs_table(spark, rows)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = p.periodic_runs(docs, ["doc_id"], loop=(h % 10 == 0, F.floor(h / 10), F.floor(h / 10) % 8)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", *CONTRACT)) for r in got), key=repr) == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    as_they_are = p.periodic_runs(docs, ["doc_id"]).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", *CONTRACT)) for r in as_they_are), key=repr) == sorted((expected(r[0], r[1], False) for r in rows), key=repr)


def test_given_rows(spark):
    """The short documents of the smallest table."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    short = {k for k, t in texts.items() if len((t or "").split()) < 500}
    got = {r["doc_id"]: tuple(r[c] for c in ("doc_id", *CONTRACT)) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    assert [got[k] for k in sorted(short)] == [expected(k, texts[k]) for k in sorted(short)]


def test_empty_table_and_clashing_columns(spark):
    docs = docs_table(spark, [(1, "x " * 30), (1, "x " * 30), (None, None)])
    assert p.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
    clash = docs.selectExpr("doc_id as _text", "text as words", "1 as start", "2 as _on")
    got = p.periodic_runs(clash, ["_text"], "words").collect()
    assert sorted((repr(r["_text"]), r["n_runs"], r["length"]) for r in got) == [("1", 1, 30), ("1", 1, 30), ("None", 0, None)]
    with pytest.raises(ValueError, match="start"):
        p.periodic_runs(clash, ["start"], "words")
