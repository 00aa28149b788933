"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines). Every paragraph has a wide vector, and a text's fingerprint is
the sum of its paragraphs' vectors, lane by lane modulo 2^16: order does not matter, and a paragraph is added to or
taken out of a fingerprint without the rest of the text. The first lanes come from a 512-bit hash of the
paragraph, for equality. The others count its three-word shingles with random signs, lane by lane, so that the
angle between two fingerprints tells how much of their text is the same.

Null and empty texts have the fingerprint 0. Empty lines count as nothing. Equal fingerprints have likeness 1.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np

#: Lanes of 16 bits: for equality, for likeness.
EQUAL_LANES, LIKE_LANES = 32, 128
SHINGLE = 3
#: Words whose hashes a Python worker keeps, about 150 bytes each.
CACHE_WORDS = 300_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_words: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


def vector(text: str) -> np.ndarray:
    """The fingerprint as lanes; that of a paragraph is its vector, and vectors of texts add up."""
    paragraphs = _paragraphs(text)
    lanes = np.zeros(EQUAL_LANES + LIKE_LANES, np.int64)
    if not paragraphs:
        return lanes.astype(np.uint16)
    digests = b"".join(blake2b(p.encode("utf-8", "surrogatepass"), digest_size=2 * EQUAL_LANES).digest() for p in paragraphs)
    lanes[:EQUAL_LANES] = np.frombuffer(digests, "<u2").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.int64)
    words: list[str] = []
    for p in paragraphs:
        words += p.split()
        words += [""] * (SHINGLE - 1)
    hashes = _word_hashes(words)
    mixed = hashes[: len(hashes) - SHINGLE + 1] * _FACTORS[0]
    for k in range(1, SHINGLE):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _FACTORS[k] + hashes[k : len(hashes) - SHINGLE + 1 + k]
    mixed = mixed[np.fromiter(map(bool, words[: len(mixed)]), bool, len(mixed))]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[0]
    mixed ^= mixed >> np.uint64(32)
    lane = (mixed % np.uint64(LIKE_LANES)).astype(np.int64)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(40)) & np.uint64(1)).astype(float)
    lanes[EQUAL_LANES:] = np.bincount(lane, sign, LIKE_LANES).astype(np.int64)
    return (lanes & 0xFFFF).astype(np.uint16)


def combine(vectors: Iterable[np.ndarray]) -> np.ndarray:
    """The fingerprint of the texts together."""
    total = np.zeros(EQUAL_LANES + LIKE_LANES, np.uint16)
    for v in vectors:
        total = total + v
    return total


def remove(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The fingerprint of what is left of a text without a part of it."""
    return whole - part


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the cosine of the counting lanes; 1 for equal fingerprints only."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EQUAL_LANES:].view(np.int16).astype(float) for v in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return float(min(max(x @ y / norm, 0.0), 1.0 - 2**-20)) if norm else 0.0


def to_hex(v: np.ndarray) -> str:
    return v.astype(">u2").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16)
