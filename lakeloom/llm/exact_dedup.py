"""Operator 9, exact dedup: an extendible-hash index on shared files.  Native: no Python on the rows.

1. *Heads.*  Every text has a 64-bit hash.  Rows are pre-aggregated to one head a
   hash with its number of rows; only these small rows are shuffled.  A hash that
   one row has is settled: no other text is equal.
2. *Directory.*  A histogram of the heads over the leading hash bits (at most 2^16
   counters, whatever the input) drives directory doubling: a bucket with more
   than ``capacity`` hashes is split by its next bit, and the directory doubles
   whenever a bucket's depth exceeds the global depth.  Copies don't count, so a
   text with very many splits nothing.
3. *Owners.*  Rows whose hash several rows have go, with their texts, to the owner
   task of their bucket, which is a range of hashes; a hash of very many rows is
   dealt over parts of its bucket.  An owner compares the bytes of the texts of
   one hash and makes a chain of the distinct ones: a chain of several links is
   a hash collision.  Links of a dealt hash are merged over its parts.
4. *Index files.*  Chains go to Parquet in the shared folder in order of their
   buckets, without the texts.
5. *Lookup.*  A document finds its chain by bucket and hash.  A chain of one link
   is its own; in a longer one the digest says which.  Documents without a chain
   keep themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, bounded, dealt, documents, repeated, select_exact

#: Hashes that a bucket of the index may hold before it is split; rows of one hash in one task.
CAPACITY, ROWS_OF_A_PART = 1 << 12, 1 << 10
#: Leading hash bits that the directory can use; bounds it to 65,536 entries.
MAX_DEPTH = 16
#: Links of the index that may be broadcast (about 150 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LINKS = 200_000


def grow_directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """Directory doubling over counts by ``max_depth``-bit prefix.

    Returns the global depth g and, for each of the 2^g directory slots, the
    (local depth, bucket number) that it points to.
    """
    counts = [0] * (1 << max_depth)
    for prefix, n in histogram.items():
        counts[prefix] += n
    sums = [0]
    for n in counts:
        sums.append(sums[-1] + n)

    def load(prefix: int, depth: int) -> int:
        width = max_depth - depth
        return sums[(prefix + 1) << width] - sums[prefix << width]

    depth, slots = 0, [(0, 0)]  # slot -> (local depth, leading bits of the bucket)
    while True:
        overfull = {s for s in slots if load(s[1], s[0]) > capacity and s[0] < max_depth}
        if not overfull:
            break
        if any(s[0] == depth for s in overfull):
            depth, slots = depth + 1, [s for s in slots for _ in (0, 1)]
        slots = [(d + 1, i >> (depth - d - 1)) if (d, bits) in overfull else (d, bits) for i, (d, bits) in enumerate(slots)]
    numbers = {s: k for k, s in enumerate(dict.fromkeys(slots))}
    return depth, [(s[0], numbers[s]) for s in slots]


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when their bytes are; null counts as empty, so null and
    empty texts form one group.  Of a group the row with the largest id stays.
    A null id never wins over another; if all ids of a group are null, keep_id is
    null and they are kept.  Rows that repeat id and text are one document: they
    carry the same values, and all count in group_size.  An empty table gives
    an empty result.  Other columns of ``docs`` are not touched.  ``bucket`` is
    the text's bucket of the index.  ``hash_of`` gives a text's 64-bit hash; any
    function gives the same groups, a poor one longer chains.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce("content", F.lit(""))
    rows = select_exact(docs, {"doc_id": id_col, "content": text_col}).select("doc_id", text.alias("content"), hash_of(text).cast("long").alias("h"))

    heads = scratch.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "heads")
    histogram = heads.groupBy(_prefix(F.col("h"), MAX_DEPTH).alias("prefix")).count()
    depth, slots = grow_directory({r["prefix"]: r["count"] for r in histogram.collect()}, capacity)
    directory = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(slots)], "slot long, bucket int").coalesce(1)
    directory = F.broadcast(scratch.keep(directory, "directory"))  # at most 2^MAX_DEPTH rows

    def routed(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", _prefix(F.col("h"), depth)).join(directory, "slot").drop("slot")

    crowded = scratch.keep(routed(heads.where("rows > 1")).select("h", "bucket"), "crowded")
    hot = heads.where(F.col("rows") > ROWS_OF_A_PART).select("h", F.ceil(F.col("rows") / ROWS_OF_A_PART).cast("long").alias("parts"))
    hot = scratch.keep(hot, "hot")  # at most one in ROWS_OF_A_PART rows
    hot = None if hot.isEmpty() else bounded(hot)

    places = repeated(crowded, ["h"], hot)
    places = F.broadcast(places) if crowded.count() <= BROADCAST_KEYS else places
    candidates = dealt(rows, ["h"], hot, F.col("doc_id")).join(places, ["h", "part"])
    links = candidates.repartition("bucket", "part").groupBy("bucket", "part", "h", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    if hot is not None:
        links = links.groupBy("bucket", "h", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = Window.partitionBy("bucket", "h")
    links = links.select("bucket", "h", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), "keep_id", "group_size")
    links = links.withColumns({"link": F.row_number().over(chain.orderBy("digest")), "links": F.count(F.lit(1)).over(chain)})
    index = scratch.keep(links.repartitionByRange("bucket").sortWithinPartitions("bucket", "h", "link"), "index")

    found = repeated(index, ["h"], hot)
    found = found.select(*(F.col(c).alias(f"i_{c}") for c in ("bucket", "h", "part", "digest", "keep_id", "group_size", "links")))
    found = F.broadcast(found) if index.count() <= BROADCAST_LINKS else found
    own = rows.select("doc_id", "h", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"))
    own = dealt(routed(own), ["h"], hot, F.col("doc_id"))
    place = (F.col("bucket") == F.col("i_bucket")) & (F.col("h") == F.col("i_h")) & (F.col("part") == F.col("i_part"))
    same = (F.col("i_links") == 1) | (F.col("text_sha256") == F.col("i_digest"))
    alone = F.col("i_h").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("i_keep_id"))
    return own.join(found, place & same, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("i_group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "bucket",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("bucket")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
