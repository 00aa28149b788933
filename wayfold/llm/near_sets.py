"""Components of sets that are near: a Jaccard similarity of at least a given share, confirmed on whole sets.

Sets are brought together by keys, of which near sets share one. Every candidate that could join two components is
compared. First by stars: in each round a set meets one representative of a key, so a dense group costs about one
comparison for each member; components come after each round. When what is left between components is little, or a
round has not halved it (sets that share keys and are not near, for which stars do nothing), or after MOST_ROUNDS,
all of it is compared.

Sets of small keys are compared as pairs. The sets of large keys are cut by their own shingles: of two sets whose
similarity is at least s, with all shingles in one order, the first n - ceil(s n) + 1 of each have one in common.
The order is by frequency among these sets, the rarest first, so what many share (a site's footer) is not among the
first; shingles that one set alone has bring nothing together. A set gives at most as many rows as it has first
shingles, whatever the size of its key. Should many sets share a first shingle still, they are compared in blocks.
Keys that hold the same sets count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import arrow_rows, lookup, ship_package, whole, written
from wayfold.llm.simhash import Forest, components

#: Rounds of stars, and comparisons for each set that may be left to the last round.
MOST_ROUNDS, LEFT = 6, 2
#: Rows of a key whose sets are compared as pairs, and rows of a block of a larger one.
PAIR_ROWS, BLOCK_ROWS = 64, 512
#: Bits of the hash by which shingles are counted: a table of 2 to that many counts goes to the driver and the tasks.
COUNT_BITS = 18
#: Tasks that add these tables up.
SUM_TASKS = 8
#: Words kept by a Python worker.
CACHE_WORDS = 400_000
_WEIGHTS = np.random.default_rng(20).integers(0, 1 << 64, 16, np.uint64, endpoint=False) | np.uint64(1)
_words: dict[bytes, int] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int, empty: bool = True) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's shingles, all words at once if there are fewer. empty: whether no words are a shingle too.

    bytes.lower and bytes.split handle ASCII only, as wanted.
    """
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if len(parts) < words:
        return np.array([xxh64_intdigest(b" ".join(parts), 42)] if parts or empty else [], np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for p in set(parts).difference(_words):
        _words[p] = xxh64_intdigest(p, 7)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += mixed(h[k : k + n] * _WEIGHTS[k])
    return np.unique(mixed(total))


def sketches(docs: DataFrame, keys: list[str], text: str, words: int, empty: bool, kinds: str, sketch: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """keys, fp (the hash of the set), n (its size), and what sketch makes of the sets (columns kinds), for each row."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    source = docs.select(*keys, whole(F.col(text)).cast("binary").alias("_text"))
    names = [c.split()[0] for c in kinds.split(", ")]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            found = [shingles(t, words, empty) for t in b.column(len(keys)).to_pylist()]
            fp = np.array([xxh64_intdigest(s.tobytes(), 42) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fp), pa.array([len(s) for s in found], pa.int32()), *sketch(found)], names=[*keys, "fp", "n", *names])

    return source.mapInArrow(apply, ", ".join([*(f"`{k}` {t}" for k, t in source.dtypes if k != "_text"), "fp bigint, n int", kinds]))


def as_binary(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([s.tobytes() for s in found], pa.binary())]


def told_apart(rows: DataFrame, check: Column) -> DataFrame:
    """rows with a new fp where sets of one fp differ by another check: about one in 10^19 pairs of sets."""
    alike = rows.groupBy("fp").agg(F.min(check).alias("low"), F.max(check).alias("high")).where("low != high").select("fp", F.lit(True).alias("_several"))
    if alike.isEmpty():
        return rows
    return rows.join(alike, "fp", "left").withColumn("fp", F.when(F.col("_several"), F.xxhash64("fp", check)).otherwise(F.col("fp"))).select(rows.columns)


def held_alike(keyed: DataFrame) -> DataFrame:
    """(key, all): the keys that several sets have and how many; of keys with the same sets one. keyed: (key, fp), no row twice."""
    of = lambda seed: F.bit_xor(F.xxhash64("fp", F.lit(seed))).alias(f"h{seed}")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), of(1), of(2)).where("all > 1")
    return sizes.groupBy("all", "h1", "h2").agg(F.min("key").alias("key")).select("key", "all")


def shared_keys(rows: DataFrame, keys: Column, where: str) -> DataFrame:
    """(key, fp, n, sketch) of the keys that several sets have; of keys with the same sets one. rows: fp, n, sketch, one for each set."""
    keyed = written(rows.select("fp", F.explode(F.array_distinct(keys)).alias("key")), f"{where}/keyed")
    one = written(held_alike(keyed).select("key"), f"{where}/alike")
    return keyed.join(one, "key").join(rows.select("fp", "n", "sketch"), "fp")


class Share(NamedTuple):
    """A least Jaccard similarity, as a fraction."""

    up: int
    down: int

    def met(self, common, sizes):
        """Whether sets with so many common shingles, of so many in sum, are near."""
        return (self.up + self.down) * common >= self.up * sizes

    def fits(self, x: Column, y: Column) -> Column:
        """Whether sets of these sizes can be near."""
        return F.least(x, y) * self.down >= F.greatest(x, y) * self.up

    def first_of(self, n: int) -> int:
        """How many first shingles of a set of n have one in common with every near set's."""
        return n + self.up * n // -self.down + 1


def near(pairs: DataFrame, total: int, sets: DataFrame, share: Share) -> DataFrame:
    """The pairs (a, b) whose sets are near."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = lookup(lookup(pairs, side("a"), ["a"], total, F.col("b")), side("b"), ["b"], total, F.col("a")).select("a", "b", "a_set", "b_set")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(share.met(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(apply, "a bigint, b bigint")


def block_links(fps: list[int], roots: list[int], right: np.ndarray, sets: list[np.ndarray], forest: Forest, share: Share) -> Iterator[tuple[int, int]]:
    """Links between the rows of two blocks that join components, by counts of common shingles.

    right: whether a row is of the second block; all rows may be of one block, then all meet.
    """
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    holders, edges = owner[order], np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0, [True]]))
    place = np.empty(len(every), np.int64)
    place[order] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    ends = np.cumsum(sizes)
    known, two = np.array(roots), right.any() and not right.all()
    for i in range(len(fps)):
        wanted = (known != known[i]) & ((right != right[i]) | (not two))
        wanted[: i + 1] = False
        if not wanted.any():
            continue
        mine = place[ends[i] - sizes[i] : ends[i]]
        starts, lengths = edges[mine], edges[mine + 1] - edges[mine]
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[at], minlength=len(fps))
        for j in np.flatnonzero(wanted & share.met(common, sizes[i] + sizes)).tolist():
            if forest.link(roots[i], roots[j]):
                yield fps[i], fps[j]


def within_keys(rows: DataFrame, sets: DataFrame, share: Share) -> DataFrame:
    """Links (a, b) that join components within keys. rows: key, fp, root, all (rows of the key)."""
    total = rows.count()
    met = lookup(rows, sets.select("fp", "shingles"), ["fp"], total, F.col("key"), "inner")
    blocks = F.ceil(F.col("all") / BLOCK_ROWS).cast("int")
    dealt = met.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).alias("right"), "fp", "root", "shingles")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "fp")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, group = Forest(), [], None

        def links() -> pa.RecordBatch:
            right, fps, roots, raw = zip(*held, strict=True)
            pairs = list(block_links(list(fps), list(roots), np.array(right), [np.frombuffer(x, np.uint64) for x in raw], forest, share))
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group:
                    if len(held) > 1:
                        yield links()
                    group, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield links()

    return ordered.mapInArrow(search, "a bigint, b bigint")


def _bucket(s: np.ndarray) -> np.ndarray:
    return (mixed(s) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def usual_counts(held: DataFrame) -> np.ndarray:
    """How many sets have a shingle, by a hash of it: a table of fixed size, whatever the number of sets. held: shingles."""

    def table(n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(n, _bucket(np.frombuffer(raw.as_py(), np.uint64)), 1)
        yield from table(n)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n += np.frombuffer(raw.as_py(), np.int64)
        yield from table(n)

    # A row for each task, not for each count; the tasks' tables are added up in a few.
    tables = held.select("shingles").mapInArrow(count, "counts binary").repartition(SUM_TASKS).mapInArrow(add, "counts binary").toArrow()
    return sum((np.frombuffer(t.as_py(), np.int64) for t in tables.column(0)), np.zeros(1 << COUNT_BITS, np.int64))


def first_shingles(members: DataFrame, sets: DataFrame, share: Share, where: str) -> DataFrame:
    """(key, fp, n, root) by those first shingles that sets of several components have. members: fp, n, root, one row for each set.

    The order may be any, as long as it is the same for all sets: so counts by a hash of a shingle do.
    """
    spark = members.sparkSession
    ship_package(spark)
    held = written(members.join(sets.select("fp", "shingles"), "fp").select("fp", "n", "root", "shingles"), f"{where}/held")
    counts = spark.sparkContext.broadcast(usual_counts(held))

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = counts.value
        for batch in batches:
            firsts = []
            for raw in batch.column(3):
                own = np.frombuffer(raw.as_py(), np.uint64)
                firsts.append(own[np.lexsort((own, usual[_bucket(own)]))[: share.first_of(len(own))]])
            at = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
            keys = np.concatenate([*firsts, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(at) for c in range(3))], names=["key", "fp", "n", "root"])

    keyed = written(held.mapInArrow(spell, "key bigint, fp bigint, n int, root bigint"), f"{where}/spelt")
    apart = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return keyed.join(apart, "key").select("key", "fp", "n", "root")


def joined(shared: DataFrame, sets: DataFrame, total: int, where: str, share: Share, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) as components gives them. shared: rows (key, fp, n, sketch) of keys that several sets have.

    close: of pairs (a, b, a_sketch, b_sketch) those (a, b) that can be near by their sketches.
    """
    links, now, k, before = None, shared.withColumn("root", F.col("fp")), 0, None
    while True:
        sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
        main = sizes.groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most")).where("all > most")
        main = written(main, f"{where}/keys-{k}")
        left = main.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("n")).first()["n"] or 0
        last = left <= LEFT * total or k >= MOST_ROUNDS or (before is not None and left > before / 2)
        before = left
        open_rows = written(now.join(main.select("key", "main", "all"), "key"), f"{where}/open-{k}")
        if last:
            large = written(open_rows.where(F.col("all") > PAIR_ROWS).select("fp", "n", "sketch", "root").dropDuplicates(["fp"]), f"{where}/large")
            small = open_rows.where(F.col("all") <= PAIR_ROWS).select("key", "fp", "n", "sketch", "root")
            if not large.isEmpty():
                cut = written(first_shingles(large, sets, share, where), f"{where}/first")
                held = held_alike(cut)
                cut = written(cut.join(held, "key"), f"{where}/cut")
                apart = written(within_keys(cut.where(F.col("all") > PAIR_ROWS).select("key", "fp", "root", "all"), sets, share), f"{where}/apart")
                links = apart if links is None else links.unionByName(apart)
                small = small.unionByName(cut.where(F.col("all") <= PAIR_ROWS).join(large.select("fp", "sketch"), "fp").select("key", "fp", "n", "sketch", "root"))
            others = small.select("key", F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("b_sketch"), F.col("root").alias("b_root"))
            met = small.join(others, "key").where("root != b_root and fp < b").where(share.fits(F.col("n"), F.col("bn")))
            pairs = close(met.select(F.col("fp").alias("a"), "b", F.col("sketch").alias("a_sketch"), "b_sketch")).distinct()
        else:
            of = lambda c: F.xxhash64(c, F.lit(k))
            stars = open_rows.groupBy("key").agg(F.min_by(F.struct("fp", "n", "sketch", "root"), of("fp")).alias("s"))
            met = open_rows.join(stars, "key").where("root != s.root").where(share.fits(F.col("n"), F.col("s.n")))
            found = close(met.select(F.col("fp").alias("a"), F.col("s.fp").alias("b"), F.col("sketch").alias("a_sketch"), F.col("s.sketch").alias("b_sketch")))
            pairs = found.groupBy("a").agg(F.min_by("b", of("b")).alias("b"))
        pairs = written(pairs, f"{where}/pairs-{k}")
        more = written(near(pairs, pairs.count(), sets, share), f"{where}/links-{k}")
        links = more if links is None else links.unionByName(more)
        roots = components(links, f"{where}/components-{k}")
        if last:
            return roots
        now = written(shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"{where}/state-{k}")
        k += 1
