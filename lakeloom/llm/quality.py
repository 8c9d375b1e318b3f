"""Operator 3, quality classifier: importance resampling on hashed n-grams.

Two bag-of-n-grams models over the same hash buckets are counted: one over all
documents (raw), one over those labelled good (target).  A document's log
importance weight is the sum of log p_target / p_raw over its words and word
pairs.  Gumbel top-k then draws k documents without replacement in proportion
to the weights: the k largest values of log weight plus Gumbel noise, the noise
being a fixed function of id and seed.

Counting covers every row; the threshold of the top-k is found by narrowing a
histogram, so no global sort or collection is needed.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents, map_slices, select_exact

BUCKET_BITS = 16
#: Good labels that may be broadcast at most (an id each); beyond, they are joined by a shuffle.
BROADCAST_LABELS = 250_000
#: Values that the top-k threshold is picked from on the driver at most; bins of one narrowing step.
LAST_VALUES, BINS = 10_000, 4_096
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes | None) -> np.ndarray:
    """Buckets of a text's words and word pairs; A-Z in lower case, words split at ASCII white space."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7)) + h[1:]
    return (np.concatenate((h, pairs)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def fit(rows: DataFrame) -> np.ndarray:
    """log p_target / p_raw of every bucket, add-one smoothed, from (text binary, target boolean)."""

    def body(slices):
        raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for part in slices:
            for text, good in zip(part["text"], part["target"]):
                f = np.bincount(features(text), minlength=1 << BUCKET_BITS) if text and len(text) > 1 << 18 else None
                if f is not None:
                    raw += f
                    target += f if good else 0
                elif text:
                    f = features(text)
                    np.add.at(raw, f, 1)
                    if good:
                        np.add.at(target, f, 1)
        at = np.flatnonzero(raw)
        yield {"bucket": at.astype(np.int32), "raw": raw[at], "target": target[at]}

    counts = map_slices(rows, "bucket int, raw long, target long", {"text": "text", "target": "target"}, body)
    raw, target = np.ones(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # 2^16 rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise as a fixed function of id and seed."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls; -inf if there are fewer."""
    if k <= 0:
        return math.inf
    low, high, total = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if total <= k:
        return -math.inf
    inside, wanted = total, k
    c = F.col(column)
    while inside > LAST_VALUES and high > low:
        width = (high - low) / BINS
        if low + width == low or high - width == high:
            break  # the bins are narrower than the numbers' spacing: ties
        slot = F.least(F.floor((c - low) / width), F.lit(BINS - 1))
        counts = {r["slot"]: (r["n"], r["lo"], r["hi"]) for r in values.where((c >= low) & (c <= high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()}
        for s in sorted(counts, reverse=True):
            n, lo, hi = counts[s]
            if wanted <= n:
                low, high, inside = lo, hi, n
                break
            wanted -= n
    if inside > LAST_VALUES:
        return low
    last = sorted((r[0] for r in values.where((c >= low) & (c <= high)).select(column).collect()), reverse=True)
    return last[wanted - 1]


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
) -> DataFrame:
    """One row per row: doc_id, n_features, log_weight, score, gumbel_key, selected.

    ``log_weight`` is the log importance weight, ``score`` the logistic of its mean
    over the features (0.5: as in the raw text).  ``share`` of the rows is
    selected, rounded; by default the share of good rows among labelled ones.
    Labels are joined by id; an id counts as good if any of its labels is 1;
    null ids and null labels count as unlabelled.  Null, empty and word-less
    texts have no features, weight 0 and score 0.5.  Ties at the threshold are
    all selected.  Repeated rows are weighed each and share their noise.
    Without any good label nothing is learned: all weights are 0.  An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = select_exact(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("binary"))
    own = select_exact(labels, {"l_id": id_col, "q": quality_col}).where("l_id IS NOT NULL AND q IS NOT NULL")
    own = scratch.keep(own.groupBy("l_id").agg(F.max("q").alias("q")), "labels")
    labelled, good = own.agg(F.count(F.lit(1)), F.count_if(F.col("q") >= 1)).first()
    good_ids = bounded(own.where("q >= 1").select("l_id"), BROADCAST_LABELS)
    marked = rows.join(good_ids, F.col("doc_id") == F.col("l_id"), "left").select("text", F.col("l_id").isNotNull().alias("target"))
    ratio = fit(marked) if good else np.zeros(1 << BUCKET_BITS)

    def weigh(slices):
        for part in slices:
            found = [ratio[features(t)] for t in part["text"]]
            sums = [float(f.sum()) for f in found]
            yield {"doc_id": part["doc_id"], "n_features": [len(f) for f in found], "log_weight": sums, "score": [1 / (1 + math.exp(-s / max(1, len(f)))) for s, f in zip(sums, found)]}

    weighed = map_slices(rows, f"doc_id {id_type}, n_features long, log_weight double, score double", {"doc_id": "doc_id", "text": "text"}, weigh)
    weighed = scratch.keep(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    share = (good / labelled if labelled else 0.0) if share is None else share
    k = round(share * weighed.count())
    return weighed.withColumn("selected", F.col("gumbel_key") >= F.lit(kth_largest(weighed, "gumbel_key", k)))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
