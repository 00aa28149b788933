"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures; links are confirmed on whole sets.

A document's set: its distinct 3-word shingles (A-Z lower-cased); with fewer words all of them as one. Sets of equal
hash collapse to one. A signature is PARTS * SYMBOLS MinHashes, of each the last BITS bits. The signatures of sets
of similarity s differ in each symbol with a probability of 1 - s at most.

Join: signatures that differ in no more than PARTS * (ERRORS + 1) - 1 symbols have, by pigeonhole, a part in which
no more than ERRORS differ. The allowed errors of a part are enumerated as the places where they can be: a key is a
part's symbols without those of ERRORS places, so all pairs within the distance share a key. At a similarity of
0.85 a pair of 40 symbols differs in more than 15 with a probability of 1.1e-4, above it in fewer. Pairs that share a key are held
against that distance, then against their whole sets. Hot keys and components: see `near_sets`.

A text without words has an empty set and is linked with nothing. Null ids never become a component's id unless all
its ids are null; a row is kept if its id, null as well, is its component's. Repeated rows are rows of one component.
An empty table gives no rows. Columns beside the keys and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import near_sets
from wayfold.llm.near_sets import Share, as_binary, mixed
from wayfold.llm.shared import lookup, own_keys, shared_dir, ship_package, whole, written

WORDS, PARTS, SYMBOLS, ERRORS, BITS, SHARE = 3, 8, 5, 1, 16, Share(17, 20)
#: The signature distance up to which no pair is lost.
DISTANCE = PARTS * (ERRORS + 1) - 1
#: Shingles that meet all hash functions at once.
CHUNK = 1 << 14
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 64, (PARTS * SYMBOLS, 1), np.uint64, endpoint=False) | np.uint64(1)
_TERMS = _rng.integers(0, 1 << 64, (PARTS * SYMBOLS, 1), np.uint64, endpoint=False)
_KEPT = np.array(list(combinations(range(SYMBOLS), SYMBOLS - ERRORS)))


def signature(found: np.ndarray) -> np.ndarray:
    """The last bits of a MinHash for each hash function; zeros for an empty set."""
    if not len(found):
        return np.zeros(PARTS * SYMBOLS, "<u2")
    least = np.full(PARTS * SYMBOLS, ~np.uint64(0))
    for k in range(0, len(found), CHUNK):
        np.minimum(least, (found[None, k : k + CHUNK] * _FACTORS + _TERMS).min(axis=1), out=least)
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def part_keys(signatures: np.ndarray) -> np.ndarray:
    """The keys of all parts for each row of signatures: a part's number, the places kept, and their symbols."""
    parts = signatures.reshape(-1, PARTS, SYMBOLS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(PARTS * len(_KEPT), dtype=np.uint64).reshape(PARTS, -1), (len(parts), PARTS, len(_KEPT)))
    for c in range(_KEPT.shape[1]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, _KEPT[:, c]] + np.uint64(1))
    return keys.reshape(len(parts), -1).view(np.int64)


def sketch(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([signature(s).tobytes() for s in found], pa.binary())]


def close(pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Of pairs (a, b, a_sketch, b_sketch) those (a, b) whose signatures differ in at most distance symbols."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PARTS * SYMBOLS) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left != right).sum(axis=1) <= distance))

    ship_package(pairs.sparkSession)
    return pairs.mapInArrow(search, "a bigint, b bigint")


def keyed(groups: DataFrame) -> DataFrame:
    """(fp, n, sketch, keys) of groups (fp, n, sketch)."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = part_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2"))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["fp", "n", "sketch", "keys"])

    ship_package(groups.sparkSession)
    return groups.select("fp", "n", "sketch").mapInArrow(make, "fp bigint, n int, sketch binary, keys array<bigint>")


def near_classes(docs: DataFrame, keys: list[str], id_order: Column, text: str = "text") -> DataFrame:
    """A row for each row of docs: keys, n_shingles and first, the least id_order (a struct or value of keys) of its component.

    Rows without words are each the first of a component of their own.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "minhash")
    own = own_keys(keys, "n_shingles", "first")
    named = docs.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], id_order.alias("_order"), F.sha2(whole(F.col(f"`{text}`")), 256).alias("_sha"), whole(F.col(f"`{text}`")).alias("_body"))
    rows = written(near_sets.sketches(named, [*own, "_order", "_sha"], "_body", WORDS, False, "sketch binary", sketch), f"{where}/rows")
    full = near_sets.told_apart(rows.where("n > 0"), F.hash("n", "sketch"))
    least = F.min(F.struct(F.col("_order").alias("least"), "_sha", "n", "sketch")).alias("one")
    groups = written(full.groupBy("fp").agg(least).select("fp", "one.*"), f"{where}/groups")
    shared = written(near_sets.shared_keys(keyed(groups), F.col("keys"), where), f"{where}/shared")
    # of the texts of a wanted set one is read again
    wanted = groups.join(shared.select("fp").distinct(), "fp").select(F.col("fp").alias("_fp"), F.col("_sha").alias("_sha1"), F.col("least").alias("_order1"))
    texts = named.select("_order", "_sha", "_body").join(wanted, (F.col("_sha") == F.col("_sha1")) & F.col("_order").eqNullSafe(F.col("_order1"))).select("_fp", "_body")
    sets = near_sets.sketches(texts, ["_fp"], "_body", WORDS, False, "shingles binary", as_binary)
    sets = written(sets.select(F.col("_fp").alias("fp"), "shingles").dropDuplicates(["fp"]), f"{where}/sets")
    roots = near_sets.joined(shared, sets, groups.count(), where, SHARE, close)
    member = written(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), f"{where}/members")
    first = member.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = lookup(member.select("fp", "root"), first, ["root"], member.count(), F.col("fp")).select("fp", "first")
    found = lookup(full, by_fp, ["fp"], full.count(), F.col("_sha")).select(*own, "n", "first").unionByName(rows.where("n = 0").select(*own, "n", F.col("_order").alias("first")))
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.col("n").cast("bigint").alias("n_shingles"), "first")
