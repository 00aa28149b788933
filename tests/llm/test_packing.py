import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, docs_table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import packing as p
from wayfold.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(runs, hist, capacity):
    bins: dict = {}
    for length, first, count, each, start, offset in runs:
        for r in range(count):
            bins.setdefault(start + r // each, []).append((offset + r % each * length, length))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    assert sorted(n for own in bins.values() for _, n in own) == sorted(n for n, c in hist.items() for _ in range(c))
    ranks: dict = {}
    for length, first, count, *_ in runs:
        assert first == ranks.get(length, 0)
        ranks[length] = first + count
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plan_is_valid_and_no_worse_than_first_fit(hist):
    used = check(p.plan(hist, 40), hist, 40)
    bins: list[int] = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 40), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert used <= len(bins) * 11 / 9 + 1


def test_plan_size_does_not_grow_with_documents():
    rng = random.Random(2)
    hist = {n: rng.randrange(1, 50) for n in range(1, 2049)}
    few, many = p.plan(hist, 2048), p.plan({n: c * 10_000_000 for n, c in hist.items()}, 2048)
    assert len(few) < 20_000 and len(many) < 20_000
    total = sum(n * c for n, c in hist.items())
    assert max(first + -(-count // each) for _, _, count, each, first, _ in few) <= 1.03 * total / 2048 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aAbB'sSdDtT'_ .,!0123\t\n\xa0éÉıİſßøŁ–“”€²½ª\x85\x1c", max_size=60), st.just("x <|endoftext|> y")), min_size=1, max_size=6))
def test_ids_are_those_of_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert WordBpe.load(PATH).encode(texts) == want


def test_pack_equals_brute_force(spark):
    rows = awkward()
    got = p.pack(docs_table(spark, rows), ["doc_id"], capacity=512).toPandas()
    slow = Tokenizer.from_file(PATH)
    want = []
    for i, text, *_ in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if i is None else i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert sorted(zip(got["doc_id"].fillna(-1), got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 512
    assert all(zlib.crc32(x) == c for x, c in zip(got["ids"], got["ids_crc32"]))
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 512 + 1
    assert p.pack(docs_table(spark, rows).limit(0), ["doc_id"]).count() == 0


def test_large_plans_and_counts_are_joined_alike(spark, monkeypatch):
    docs = docs_table(spark, awkward()).withColumnsRenamed({"doc_id": "rank", "lang": "part"})
    kept = lambda d: sorted(map(repr, d.drop("sequence_id", "offset").collect()))
    want = kept(p.pack(docs, ["rank", "part"], capacity=64))
    monkeypatch.setattr(p, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(p, "BROADCAST_COUNTS", 0)
    got = p.pack(docs, ["rank", "part"], capacity=64)
    assert got.columns[:2] == ["rank", "part"] and kept(got) == want
    for _, own in got.toPandas().sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
    with pytest.raises(ValueError, match="piece"):
        p.pack(docs.withColumnRenamed("rank", "piece"), ["piece"])
