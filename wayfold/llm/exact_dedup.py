"""Exact duplicates by an extendible-hash index on shared files, with Spark expressions only.

1. entries: one compact row for each document (key: XXH64 of the text, SHA-256, doc_id, row number), written.
2. directory: buckets are key prefixes, and at first there is one. A bucket with more distinct keys than its
   capacity splits, which doubles the directory below it; copies share a key, so a hot group splits nothing. A
   bucket is there if the one it splits from is overfull, so all doublings come from one count by prefix. Leaves,
   the buckets that fit, are written.
3. pages: keys beside their bucket, written. A key with one row is a chain of one link, without its text.
4. owners: of keys with several rows the texts are read again and copies collapse over salts before they move.
   They are dealt by ranges of buckets, so that an owner task has whole buckets, of bounded size. It compares the
   bytes: each different text of a key is a link of the key's chain, with its position, the largest doc_id and the
   number of rows. Links are written; every document's class is its key's only link, or the link whose text it has.

A document finds its link by key and SHA-256, which the owner takes from the compared text; two links of a key with
one SHA-256 are an error. Null texts count as empty. Of equal texts the row with the largest doc_id stays, of
repeated rows one; null doc_ids go below all others. An empty table gives no rows. Columns beside doc_id and text
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.llm.shared import HOT_PARTS, SALTS, keep_documents, lookup, shared_dir, whole, written

#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 4096
#: Prefix bits at which splitting ends; a bucket this deep keeps its keys in one chain.
MOST_BITS = 40
#: Up to so many 8-byte keys are broadcast to pick the texts that have to be compared; more are joined.
BROADCAST_KEYS = 250_000


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a 64-bit key; 0 for no bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def text_key(body: Column, bits: int = 64) -> Column:
    """XXH64 of a text, with all but its first bits zero."""
    key = F.xxhash64(body)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def _buckets(keys: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct keys by depth and prefix, for all depths from first to last, from one count by the longest prefix."""
    fine = keys.groupBy(prefix(F.col("key"), last).alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    depths = fine.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return depths.groupBy("depth", F.expr(f"shiftrightunsigned(fine, {last} - depth)").alias("prefix")).agg(F.sum("n").alias("keys"))


def grow_directory(keys: DataFrame, capacity: int, where: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, list[int]]:
    """The directory's leaves (depth, prefix, keys), and the depths that have leaves.

    All doublings to the depth at which evenly spread keys fit come from one count; only keys in buckets that are
    overfull even there are counted once more, to most_bits.
    """
    even = min(most_bits, (4 * keys.count() // capacity).bit_length())
    counted = written(_buckets(keys, 0, even), f"{where}/buckets")
    overfull = counted.where(F.col("keys") > capacity)
    deep = overfull.where((F.col("depth") == even) & (F.col("depth") < most_bits)).select("prefix")
    if not deep.isEmpty():
        below = keys.withColumn("prefix", prefix(F.col("key"), even)).join(deep, "prefix", "left_semi").select("key")
        counted = counted.unionByName(written(_buckets(below, even + 1, most_bits), f"{where}/deep-buckets"))
        overfull = counted.where(F.col("keys") > capacity)
    parents = overfull.where(F.col("depth") < most_bits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = counted.where((F.col("keys") <= capacity) | (F.col("depth") == most_bits)).withColumn("parent", F.shiftright("prefix", 1))
    leaves = written(fits.where("depth = 0").unionByName(fits.where("depth > 0").join(parents, ["depth", "parent"], "left_semi").select(fits.columns)).drop("parent"), f"{where}/leaves")
    return leaves, sorted(r["depth"] for r in leaves.select("depth").distinct().collect())


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, key, link, text_sha256 (hex), keep_id, group_size, kept.

    link: the text's place in the chain of its key. key_bits below 64 shortens the keys, which makes collisions;
    other columns are the same.
    """
    spark = docs.sparkSession
    where = shared_dir(spark, "extendible-hash")
    body = whole(F.col(text))
    entries = written(docs.select(F.col(doc_id).alias("doc_id"), text_key(body, key_bits).alias("key"), F.sha2(body, 256).alias("sha"), F.monotonically_increasing_id().alias("row")), f"{where}/entries")
    total = entries.count()

    keys = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), f"{where}/keys")
    leaves, depths = grow_directory(keys.select("key"), capacity, f"{where}/directory")
    # Every key is in exactly one leaf: of the few depths, the one at which its prefix is a leaf.
    paged = keys.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")))
    paged = paged.withColumn("prefix", F.coalesce(*[F.when(F.col("depth") == d, prefix(F.col("key"), d)) for d in depths], F.lit(0).cast("bigint"))).join(leaves.select("depth", "prefix"), ["depth", "prefix"], "left_semi")
    # Unsigned order of keys, in which each bucket is one range.
    start = F.coalesce(*[F.when(F.col("depth") == d, F.shiftleft(F.col("prefix"), max(0, 64 - d)) if d else F.lit(0).cast("bigint")) for d in depths], F.lit(0).cast("bigint")).bitwiseXOR(F.lit(-(2**63)))
    pages = written(paged.withColumn("bucket", start), f"{where}/pages")

    shared = pages.where(F.col("rows") > 1).select("key", "bucket", "rows")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    hot = max(1000, total // HOT_PARTS)
    salt = F.when(F.col("rows") > hot, F.pmod(F.xxhash64(F.col("doc_id")), F.lit(SALTS))).otherwise(F.lit(0))
    texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("key", text_key(F.col("text"), key_bits)).join(shared, "key")
    collapsed = texts.groupBy("bucket", "key", "text", salt.alias("salt")).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    owned = collapsed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    compared = owned.groupBy("bucket", "key", "text").agg(F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))
    chain = W.partitionBy("bucket", "key").orderBy("text")
    links = written(compared.select("key", F.row_number().over(chain).alias("link"), F.sha2("text", 256).alias("sha"), "group_size", "keep_id"), f"{where}/links")
    if not links.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("two texts have one SHA-256")

    found = lookup(entries, links.withColumn("_chained", F.lit(True)), ["key", "sha"], total, F.col("row"))
    chained = F.coalesce("_chained", F.lit(False))
    keep = F.when(chained, F.col("keep_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "key", F.coalesce("link", F.lit(1)).alias("link"), F.col("sha").alias("text_sha256"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "row")
    # Rows that repeat id and text: only the last of them may stay.
    again = entries.join(shared.select("key"), "key", "left_semi").groupBy("key", "sha", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last")).where("n > 1")
    again = written(again.select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), F.col("doc_id").alias("_id"), "last"), f"{where}/repeated")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not again.isEmpty():
        found = found.join(again, (F.col("key") == F.col("_key")) & (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        kept = kept & (F.coalesce("last", "row") == F.col("row"))
    return found.select("doc_id", "key", "link", "text_sha256", "keep_id", "group_size", kept.alias("kept"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without exact copies, with all its columns."""
    stay = exact_classes(docs, doc_id, text).where("kept")
    return keep_documents(docs, stay.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), doc_id, text)
