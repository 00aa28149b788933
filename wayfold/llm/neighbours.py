"""Fingerprints of documents and of their edits: each with the document that follows it by falling id.

Documents are dealt by ranges of their ids, one shuffle of their texts; the first document of each range goes to
the range before it as well, as a guest, so that every task has the neighbours of all its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import multiset_hash as mh
from wayfold.llm.shared import arrow_rows, ship_package, whole

#: Ranges of ids for each shuffle partition.
RANGES = 4


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the last the first. Rows with one id follow each
    other by the hash of their texts; null ids come last.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    n = RANGES * parts
    bounds = sorted(set(ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) or []))
    # Ranges from 1 up, in rising order of ids; null ids are range 0.
    of = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < F.col("doc_id").cast("double")))).cast("int")
    tops = {r["range"]: r["top"] for r in ids.groupBy(of.alias("range")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    #: Of each range, whose guests its first documents are: the range before it in falling order, for the first the last.
    host = {r: order[k - 1] for k, r in enumerate(order)}
    table = spark.createDataFrame([(r, tops[r], host[r]) for r in order], "range int, top bigint, host int")
    base = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text")).withColumn("range", of)
    placed = base.join(F.broadcast(table), "range").withColumn("tie", F.xxhash64("text"))
    guest = F.col("doc_id").eqNullSafe(F.col("top"))
    dealt = placed.select("doc_id", "text", "tie", F.explode(F.when(guest, F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))).alias("p")).select("p.range", "p.guest", "doc_id", "tie", "text")
    sorted_rows = dealt.repartition(parts, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "tie")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # range, doc_id, text, vector of a document whose next one is not known yet

        def pair(text: str, next_vector, next_text: str, doc_id: int | None, v) -> None:
            changed = edited(text, next_text)
            e = v if changed == text else mh.vector(changed)
            out.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mh.to_hex(v), mh.to_hex(e), mh.likeness(v, e), mh.likeness(v, next_vector)))

        for batch in batches:
            for r, is_guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if is_guest and (held is None or held[0] != r):
                    continue  # rows with one id: only the first guest is a next document
                v = mh.vector(text)
                if held is not None:
                    pair(held[2], v, text, held[1], held[3])
                held = None if is_guest else (r, doc_id, text, v)
            if out:
                yield made(out)
                out = []
        if held is not None:
            raise AssertionError("a document without a next one")

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return sorted_rows.mapInArrow(apply, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
