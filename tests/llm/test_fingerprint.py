import hashlib
import random

import numpy as np
from fixtures import awkward, docs_table, prose

from wayfold.llm import multiset_hash as mh
from wayfold.llm.neighbours import fingerprint_edits


def test_homomorphic():
    a, b = "one two three\nfour five six seven", "eight nine\n\nten"
    assert np.array_equal(mh.combine([mh.vector(a), mh.vector(b)]), mh.vector(f"{b}\n{a}"))
    assert np.array_equal(mh.remove(mh.vector(f"{a}\n{b}"), mh.vector(b)), mh.vector(a))
    assert np.array_equal(mh.vector("x\ny"), mh.vector("y\nx"))
    assert not np.array_equal(mh.vector("x\nx"), mh.vector("x"))
    assert np.array_equal(mh.from_hex(mh.to_hex(mh.vector(a))), mh.vector(a))
    assert mh.likeness(mh.vector(""), mh.vector("\n")) == 1.0
    same, other = prose(random.Random(1), 400), prose(random.Random(2), 400)
    assert mh.likeness(mh.vector(same), mh.vector(same[: len(same) // 2] + other[: len(other) // 2])) > 0.3 > mh.likeness(mh.vector(same), mh.vector(other))


def test_edits_equal_brute_force(spark):
    rows = [r for r in awkward() if r[0] not in (8, 9, None)] + [(200 + 3 * k, prose(random.Random(k), k % 50), "a") for k in range(300)]
    ordered = sorted(rows, key=lambda r: -r[0])
    want = {}
    for k, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        v, e, n = mh.vector(text), mh.vector(changed), mh.vector(after)
        want[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), mh.to_hex(v), mh.to_hex(e), mh.likeness(v, e), mh.likeness(v, n))
    got = {r["doc_id"]: tuple(r)[1:] for r in fingerprint_edits(docs_table(spark, rows)).collect()}
    assert got == want


def test_awkward_rows(spark):
    rows = awkward()
    got = fingerprint_edits(docs_table(spark, rows)).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    assert fingerprint_edits(docs_table(spark, rows).limit(0)).count() == 0
    (one,) = fingerprint_edits(docs_table(spark, [(5, "abcdef")])).collect()
    assert (one["n_chars"], one["edited_sha256"], one["near_next"]) == (6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)
    assert len(fingerprint_edits(docs_table(spark, [(None, "a"), (None, "b")])).collect()) == 2
