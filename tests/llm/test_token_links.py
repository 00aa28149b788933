import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from fixtures import awkward, docs_table, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfold.llm import token_links as t


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of():
    """The inverse of the byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


def plain(rows, coders):
    """Every text encoded whole, its groups by byte offset, its links one by one."""
    a, b = coders
    table, alphabet = [], byte_of()
    for _, text in rows:
        groups = []
        if text:
            ta, tb = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ta]
            pieces = [b.id_to_piece(k) for k in tb]
            bb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
                ia = ib = 0
                for end in sorted({*ea.tolist()} & {*eb.tolist()}):
                    ja, jb = ia, ib
                    while ja < len(ta) and ea[ja] <= end:
                        ja += 1
                    while jb < len(tb) and eb[jb] <= end:
                        jb += 1
                    groups.append((ta[ia:ja], tb[ib:jb]))
                    ia, ib = ja, jb
        table.append(groups)
    count, best = Counter(), defaultdict(int)
    links = [[(x, y) for ga, gb in groups for x in ga for y in gb] for groups in table]
    for own in links:
        count.update(set(own))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), groups, own in zip(rows, table, links):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((key, sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = ["a  b   c ", " x", "\n", "   ", "tab\tand\n new \n\n line", "<s> </s> <|endoftext|> ok", "mark ▁ here", "▁", "nul \x00 end", " hard  space   em", "é combining İ", "日本語の文章 と English", "emoji 😀😀 👩‍👩‍👧", "ﬁ ligature ①", "a" * 5000, "\n" * 300, "Русский текст, с запятыми", "trailing ", "\x1c sep\x1d x", "we're I'll 'tis 's"]


def table(got):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [t.BLOCK_BYTES, 300])
def test_equals_whole_texts(spark, coders, block_bytes):
    rng = random.Random(1)
    rows = awkward() + [(200 + k, x) for k, x in enumerate(ODD)] + [(300 + k, prose(rng, 30, 20)) for k in range(40)]
    docs = docs_table(spark, rows)
    assert table(t.token_links(docs, ["doc_id"], block_bytes=block_bytes)) == plain([r[:2] for r in rows], coders)


def test_given_rows(spark, coders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert table(t.token_links(docs, ["doc_id"])) == plain(rows, coders)


def test_empty_table_and_clashing_columns(spark):
    docs = docs_table(spark, [(1, "one two"), (1, "one two"), (None, None)])
    assert t.token_links(docs.limit(0), ["doc_id"]).count() == 0
    clash = docs.selectExpr("doc_id as block", "text as kind", "1 as x", "2 as n_a", "3 as _text")
    assert sorted((r["block"], r["n_groups"], r["count_sum"]) for r in t.token_links(clash, ["block"], "kind").where("block is not null").collect()) == [(1, 2, 4), (1, 2, 4)]
    with pytest.raises(ValueError, match="n_a"):
        t.token_links(clash, ["n_a"], "kind")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=25), st.lists(st.integers(0, 3), min_size=0, max_size=25))
def test_products(x, y):
    a, b = np.zeros((4, 5), np.int64), np.zeros((5, 3), np.int64)
    for k, v in enumerate(x):
        a[k * 7 % 4, k * 3 % 5] += v
    for k, v in enumerate(y):
        b[k * 3 % 5, k * 2 % 3] += v
    csr = lambda m: t.Csr.of(*np.nonzero(m), m[np.nonzero(m)], *m.shape)
    made = csr(a).times(csr(b))
    dense = np.zeros((4, 3), np.int64)
    dense[made.rows, made.columns] = made.values
    assert (dense == a @ b).all()
    back = csr(a).transposed()
    assert sorted(zip(back.columns.tolist(), back.rows.tolist(), back.values.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(a)), a[np.nonzero(a)].tolist()))


def test_ranks_are_the_vocabulary(coders):
    pair, alphabet = t.Pair.load("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"), byte_of()
    for k, b in enumerate(pair.a_bytes.to_pylist()):
        assert bytes(alphabet[c] for c in coders[0].id_to_token(k)) == b
