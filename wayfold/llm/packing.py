"""Best-fit packing of documents into sequences of a fixed number of tokens, by large-item matching.

Only lengths matter to the plan, and there are no more of them than tokens in a sequence. So the driver plans
over a histogram of lengths, however many documents there are: pieces above a third of the capacity go in pairs
at most, each of the longest with the longest partner that fits; shorter ones, in falling order, fill the
smallest gap that holds them. The plan is a list of runs of equal pieces; a piece finds its place by its length
and its rank among the pieces of that length, which Spark counts by scan task.

A document is its ids and an end id. One longer than the capacity is cut, its last piece may be shorter. Null
and empty texts are the end id alone. Repeated rows are packed each. An empty table gives no rows. Keys may have
any names but those of the result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import SALTS, arrow_rows, own_keys, shared_dir, ship_package, whole, written

#: Runs of a plan, about 50 bytes each, that are broadcast, and counts by length and scan task, about 20 bytes each;
#: more are joined by a shuffle.
BROADCAST_RUNS, BROADCAST_COUNTS = 200_000, 400_000


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset of the first piece)."""
    left = {n: c for n, c in lengths.items() if c}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def put(length: int, each: int, first: int, bins: int, offset: int) -> None:
        runs.append((length, ranks[length], each * bins, each, first, offset))
        ranks[length] += each * bins
        left[length] -= each * bins

    def keep(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        at = bisect_left(large, min(a, capacity - a) + 1) - 1
        while left[a]:
            while at >= 0 and (not left[large[at]] or (large[at] == a and left[a] < 2)):
                at -= 1
            b = large[at] if at >= 0 else 0
            bins = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, 1, opened, bins, 0)
            if b:
                put(b, 1, opened, bins, a)
            keep(capacity - a - b, opened, bins)
            opened += bins
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                bins = -(-left[s] // (capacity // s))
                keep(capacity, opened, bins)
                opened += bins
                continue
            gap = order[at]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = min(gap // s, left[s])
            used = min(bins, left[s] // each)
            put(s, each, first, used, capacity - gap)
            keep(gap - each * s, first, used)
            keep(gap, first + used, bins - used)
    return runs


def cut_pieces(docs: DataFrame, keys: list[str], tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: keys, piece, start, length, ids_crc32, [ids,] scan task and rank in it by length."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int32()), pa.field("ids_crc32", pa.int64()), pa.field("part", pa.int32()), pa.field("rank", pa.int64())]
    fields += [pa.field("ids", pa.binary())] if keep_ids else []
    source = docs.select(*keys, whole(F.col(text)).alias("_text"))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        from wayfold.llm.tokens import WordBpe

        encoder, part, seen = WordBpe.load(public_tokenizers.path(tokenizer)), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, out = [], []
            for i, ids in enumerate(encoder.encode(batch.column(len(keys)).to_pylist())):
                data = memoryview(b"".join((ids, end)))
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    seen[n] = seen.get(n, -1) + 1
                    rows.append(i)
                    out.append((k, at // 4, n, zlib.crc32(own), part, seen[n], *([bytes(own)] if keep_ids else [])))
            kept = [batch.column(j).take(pa.array(rows, pa.int32())) for j in range(len(keys))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], names=[*keys, *(f.name for f in fields)])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in source.dtypes if k != "_text"), "piece int, start bigint, length int, ids_crc32 bigint, part int, rank bigint", *(["ids binary"] if keep_ids else [])])
    return source.mapInArrow(cut, schema)


def pack(docs: DataFrame, keys: list[str], tokenizer: str = "word_bpe_49k.json", text: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: keys, piece, start, length, ids_crc32, sequence_id, offset and, if kept, its ids.

    tokenizer: a file name of public_tokenizers, read on the executors. ids: little-endian 32-bit.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "packing")
    own = own_keys(keys, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    named = docs.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(text).alias("_body"))
    pieces = written(cut_pieces(named, own, tokenizer, "_body", capacity, end_id, keep_ids), f"{where}/pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), f"{where}/counts")
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    placed = spark.createDataFrame(runs, "run_length int, first_rank bigint, pieces bigint, each bigint, first_sequence bigint, first_offset bigint")
    before = counts.selectExpr("length as _length", "part as _part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as _before")
    before = F.broadcast(before) if counts.count() <= BROADCAST_COUNTS else before.hint("merge")
    met = pieces.join(before, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).withColumn("rank", F.col("rank") + F.col("_before"))
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces"))
    if len(runs) <= BROADCAST_RUNS:
        met = met.join(F.broadcast(placed), fits)
    else:
        met = met.withColumn("_salt", F.pmod("rank", F.lit(SALTS)).cast("int")).join(placed.withColumn("_run_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), fits & (F.col("_salt") == F.col("_run_salt")))
    within = F.col("rank") - F.col("first_rank")
    return met.select(
        *[F.col(a).alias(k) for a, k in zip(own, keys, strict=True)],
        "piece",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "ids_crc32",
        (F.col("first_sequence") + F.floor(within / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + within % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids as they were placed, instead of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
