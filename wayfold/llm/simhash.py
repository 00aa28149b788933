"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: words of the A-Z lower-cased text, 3-word shingles with repeats, XXH64 of each; a bit is 1 if over
half of the hashes have it. Documents with equal fingerprints collapse to one before anything is compared.

Candidates: if two fingerprints differ in at most r bits, then of k bit ranges k - r are equal in both. Each
choice of k - r ranges is a table of keys; k grows with the number of fingerprints, so that groups of a key stay
small. Within a group the 64 bit planes are stored vertically. Small groups: one shift of the planes compares all
rows of a partition with the row d below at once, carry-save counters add up the differing bits, and words in
which every lane exceeds the radius are dropped. Large groups: a fingerprint is compared with all that are not
yet linked, so a dense group costs little more than one pass; groups too large for that are cut by further bits, the
largest, which would be too much for a task, before they are dealt.
Tasks give spanning forests, not pairs; components come from star contraction over written tables.

Null and empty texts have fingerprint 0. Null doc_ids never become a component's id unless all its ids are null.
Repeated rows are rows of one component. An empty table gives no rows. Columns beside the keys and the text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import HOT_PARTS, arrow_rows, keep_documents, lookup, shared_dir, ship_package, whole, written

#: Rows of a group compared by shifts; larger groups are walked.
SHIFT_ROWS = 64
#: Rows of a group that is walked whole; larger ones are cut by further bits.
WALK_ROWS = 4096
#: Fingerprints that a key should hold on average at most.
GROUP_ROWS = 64
#: Fingerprints of a key that one task compares; groups above that, or above their share of all, are cut before.
HOT_GROUP = 1 << 16
#: Hashes whose bits are unpacked at once.
UNPACK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text. bytes.lower and bytes.split handle ASCII only, as wanted."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[words - 1 :], strict=False) if len(parts) >= words else [(0, len(joined))]
    return majority(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), UNPACK):
        ones += np.unpackbits(hashes[k : k + UNPACK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """keys and fp, the fingerprint as a signed long, for each row."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    source = docs.select(*keys, whole(F.col(text)).cast("binary").alias("_text"))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, words) for t in b.column(len(keys)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(made)], names=[*keys, "fp"])

    return source.mapInArrow(apply, ", ".join([*(f"`{k}` {t}" for k, t in source.dtypes if k != "_text"), "fp bigint"]))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of bits, one for each bit of the fingerprints, packed to 64-bit words."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def lanes_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def within(differing: Iterable[np.ndarray], alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (as words) whose differing bits number at most radius.

    differing: a function from a plane and the words still alive to that plane's differing bits. The counters are
    bit-sliced: counter i holds bit i of every lane's count; over marks the lanes beyond the radius.
    """
    where = np.flatnonzero(alive)
    valid = alive[where]
    size = radius.bit_length()
    counters = [np.zeros(len(where), np.uint64) for _ in range(size)]
    over = np.zeros(len(where), np.uint64)
    for p in range(64):
        carry = differing(p, where)
        for i in range(size):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if radius != (1 << size) - 1:
            above, equal = np.zeros_like(over), ~np.uint64(0)
            for i in reversed(range(size)):
                if radius >> i & 1:
                    equal = equal & counters[i]
                else:
                    above |= equal & counters[i]
                    equal = equal & ~counters[i]
            over |= above
        if p % 8 == 7:
            some = (valid & ~over) != 0
            if not some.all():
                where, valid, over = where[some], valid[some], over[some]
                counters = [c[some] for c in counters]
                if not len(where):
                    break
    out = np.zeros(len(alive), np.uint64)
    out[where] = valid & ~over
    return out


def pairs_within(pairs: DataFrame, radius: int) -> DataFrame:
    """Of the pairs (a, b, a_bits, b_bits) those whose fingerprints differ in at most radius bits, as (a, b)."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (planes_of(np.asarray(batch.column(k)).view(np.uint64)) for k in (2, 3))
            every = np.zeros(left.shape[1] * 64, np.uint8)
            every[: batch.num_rows] = 1
            hit = within(lambda p, w: left[p][w] ^ right[p][w], np.packbits(every, bitorder="little").view("<u8"), radius)  # noqa: B023
            yield batch.select([0, 1]).filter(pa.array(lanes_of(hit)[: batch.num_rows]))

    ship_package(pairs.sparkSession)
    return pairs.mapInArrow(search, "a bigint, b bigint")


def shifted_pairs(fps: np.ndarray, group: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius of rows that lie in one group; rows are sorted by group, sizes is by row."""
    rows = np.arange(len(fps))
    for d in range(1, int(sizes.max(initial=1))):
        if d > 1:
            keep = sizes[rows] > d
            rows = rows[keep]
        own, ids = fps[rows], group[rows]
        n = len(rows)
        if n <= d:
            return
        same = np.zeros(-(-n // 64) * 64, np.uint8)
        same[: n - d] = ids[d:] == ids[:-d]
        planes, below = planes_of(own), planes_of(np.concatenate([own[d:], np.zeros(d, own.dtype)]))
        hit = within(lambda p, w: planes[p][w] ^ below[p][w], np.packbits(same, bitorder="little").view("<u8"), radius)  # noqa: B023
        i = np.flatnonzero(lanes_of(hit)[:n])
        if len(i):
            yield rows[i], rows[i + d]


def walk(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the group's components: each row meets only rows that nothing has reached yet."""
    free = np.arange(len(fps))
    planes = planes_of(fps)
    alive = np.zeros(planes.shape[1] * 64, np.uint8)
    alive[: len(fps)] = 1
    alive = np.packbits(alive, bitorder="little").view("<u8").copy()
    ones = ~np.uint64(0)
    todo: list[int] = []
    for first in free:
        todo = [int(first)] if alive[first >> 6] >> np.uint64(first & 63) & np.uint64(1) else []
        if todo:
            alive[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        while todo:
            q = todo.pop()
            bits = [ones if int(fps[q]) >> p & 1 else np.uint64(0) for p in range(64)]
            hit = within(lambda p, w: planes[p][w] ^ bits[p], alive, radius)  # noqa: B023
            alive &= ~hit
            for j in np.flatnonzero(lanes_of(hit)).tolist():
                yield q, j
                todo.append(j)


def group_links(fps: np.ndarray, free: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect all rows of one group within the radius. free: bits on which the group's rows may differ."""
    if len(fps) <= WALK_ROWS or len(free) < 4 * (radius + 1):
        yield from walk(fps, radius)
        return
    for part in np.array_split(np.array(free), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        values = fps & mask
        order = np.argsort(values, kind="stable")
        edges = np.flatnonzero(np.diff(values[order])) + 1
        rest = [b for b in free if not int(mask) >> b & 1]
        for rows in np.split(order, edges):
            if len(rows) > 1:
                deeper = walk(fps[rows], radius) if 2 * len(rows) > len(fps) else group_links(fps[rows], rest, radius)
                for i, j in deeper:
                    yield int(rows[i]), int(rows[j])


class Forest:
    """Union of values; keeps the links that connect something new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def bit_ranges(k: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.arange(64), k)]


def tables_for(total: int, radius: int, group_rows: int = GROUP_ROWS) -> list[tuple[int, list[int]]]:
    """(mask, free bits) of each table of keys, with as many ranges as keep groups of evenly spread rows small."""
    k = radius + 1
    while k < radius + 5 and total > group_rows * 2 ** (64 * (k - radius) // k):
        k += 1
    ranges = bit_ranges(k)
    found = []
    for chosen in combinations(range(k), k - radius):
        mask = sum(1 << b for c in chosen for b in ranges[c])
        found.append((mask, [b for c in range(k) if c not in chosen for b in ranges[c]]))
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def cut_hot(keyed: DataFrame, rows: int, radius: int) -> DataFrame:
    """keyed (mask, key, fp; key is fp under mask) with hot groups cut by further bits, so that they spread over tasks.

    The rows of a group that lie within the radius agree on one of radius + 1 parts of its free bits. Groups are cut
    again until none is hot, or so few bits are free that a group is small for that reason.
    """
    least = max(HOT_GROUP, rows // HOT_PARTS)
    while True:
        hot = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
        parts = {}
        for mask in (r["mask"] for r in hot.select("mask").distinct().collect()):
            free = _free(mask % (1 << 64))
            if len(free) >= 4 * (radius + 1):
                parts[mask] = [_signed(mask % (1 << 64) | sum(1 << int(b) for b in p)) for p in np.array_split(np.array(free), radius + 1)]
        if not parts:
            return keyed
        # At most HOT_PARTS groups are that large.
        hot = hot.where(F.col("mask").isin(*parts)).select("mask", "key", F.lit(True).alias("hot"))
        marked = keyed.join(F.broadcast(hot), ["mask", "key"], "left")
        deeper = F.create_map(*[x for m, p in parts.items() for x in (F.lit(m).cast("bigint"), F.array(*[F.lit(q).cast("bigint") for q in p]))])
        cut = marked.where("hot").select(F.explode(deeper[F.col("mask")]).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        keyed = marked.where("hot is null").select("mask", "key", "fp").unionByName(cut)
    return keyed


def links(fps: DataFrame, total: int, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect all within the radius; a forest from each task."""
    masks = [_signed(m) for m, _ in tables_for(total, radius, group_rows)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for m in masks])).alias("k")).select("k.mask", "k.key", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A group has at most all fingerprints.
    keyed = cut_hot(keyed, total * len(masks), radius) if total > HOT_GROUP else keyed
    dealt = keyed.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, found = Forest(), []
        held: list[np.ndarray] = []

        def link(a: np.ndarray, b: np.ndarray) -> None:
            found.extend(p for p in zip(a.tolist(), b.tolist(), strict=True) if forest.link(*p))

        def groups(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> None:
            starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
            sizes = np.diff(np.append(starts, len(fp)))
            by_row, number = np.repeat(sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
            few = np.flatnonzero((by_row > 1) & (by_row <= SHIFT_ROWS))
            if len(few):
                own = fp[few]
                for i, j in shifted_pairs(own.view(np.uint64), number[few], by_row[few], radius):
                    link(own[i], own[j])
            for g in np.flatnonzero(sizes > SHIFT_ROWS).tolist():
                own = fp[starts[g] : starts[g] + sizes[g]]
                for i, j in group_links(own.view(np.uint64), _free(int(t[starts[g]]) % (1 << 64)), radius):
                    if forest.link(int(own[i]), int(own[j])):
                        found.append((int(own[i]), int(own[j])))

        def flush() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1)), np.asarray(batch.column(2))]))
            t, key, _ = held[-1]
            if sum(h.shape[1] for h in held) < 1 << 18 or (t[0], key[0]) == (t[-1], key[-1]):
                continue
            rows = np.concatenate(held, axis=1)
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1
            groups(*rows[:, :last])
            held = [rows[:, last:]]
            yield flush()
        if held:
            groups(*np.concatenate(held, axis=1))
        yield flush()

    return dealt.mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes with links but the roots themselves.

    Large-star and small-star contraction in turn, each round over a written table, until nothing changes.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{where}/round-0")
    state, k = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, k = now, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # A hub, the smallest node of a giant component, is on one side of most links: its rows are dealt.
        large = lookup(both.where("v > u"), least, ["u"], 2 * now["n"], F.col("v"), "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, lowest, ["u"], 2 * now["n"], F.col("v"), "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, f"{where}/round-{k}")


def near_classes(docs: DataFrame, keys: list[str], id_order: Column, text: str = "text", radius: int = 3, words: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each row of docs: keys, fp and first, the least id_order (a struct or value of keys) of its component."""
    if taken := {"fp", "first"} & {k.lower() for k in keys}:
        raise ValueError(f"keys may not be named {sorted(taken)}")
    where = shared_dir(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs, keys, text, words), f"{where}/fingerprints")
    groups = written(rows.groupBy("fp").agg(F.min(id_order).alias("least"), F.count(F.lit(1)).alias("rows")), f"{where}/groups")
    sizes = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    roots = components(links(groups.select("fp"), sizes["n"], radius, group_rows), where)
    member = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = written(member, f"{where}/members")
    first = member.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = lookup(member.select("fp", "root"), first, ["root"], sizes["n"], F.col("fp")).select("fp", "first")
    return lookup(rows, by_fp, ["fp"], sizes["rows"] or 0, F.xxhash64(*keys))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """docs with one document of each component, the one with the smallest id, and all columns."""
    marked = docs.select(F.col(doc_id).alias("_id"), F.sha2(whole(F.col(text)), 256).alias("_sha"), whole(F.col(text)).alias("_body"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_sha").alias("_sha"))
    found = near_classes(marked, ["_id", "_sha"], order, "_body", radius)
    return keep_documents(docs, found.select("first._id", "first._sha").distinct(), doc_id, text)
