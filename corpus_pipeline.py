"""Corpus pipeline: language ID, exact dedup, near dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of ``docs``, unchanged and in their
order, whatever other columns are called; null ids, texts and languages, repeated
rows and empty tables are handled as the stages say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import exact_dedup, language_id, ngram_join, packing, secrets
from lakeloom.llm.common import Scratch, bounded, documents, map_column, number_columns

#: Texts nearer to no learned language than this score are rejected.
LEAST_LANGUAGE_SCORE = 0.2
#: Dropped (id, digest) that may be broadcast (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and those far from every learned language.

    The language is predicted from the text alone; profiles come from the rows'
    own ``lang``.  Where no row has one, only the first rule applies.  Repeated
    rows are judged each.
    """
    own, names = number_columns(docs)
    profiles = language_id.fit_profiles(own, names["text"], names["lang"], id_col=names["doc_id"])

    def spoken(texts: list) -> list:
        if not profiles.languages:
            return [bool(t) and language_id.ngram_counts(t)[0].size > 0 for t in texts]
        found = map(profiles.predict, texts)
        return [lang != language_id.UNKNOWN and score >= LEAST_LANGUAGE_SCORE for lang, score in found]

    return own.where(map_column(F.col(names["text"]), "boolean", spoken)).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat id and text, one.

    Null counts as an empty text.  A null id never wins over another.
    """
    scratch = Scratch(spark, "drop-copies")
    own, names = number_columns(docs)
    doc_id, text = names["doc_id"], names["text"]
    found = scratch.keep(exact_dedup.exact_dedup(own, doc_id, text).withColumn("digest", F.unhex("text_sha256")), "found")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    named = [F.col("doc_id").alias("d_id"), F.col("digest").alias("d_digest")]
    dropped = scratch.keep(found.where("NOT kept").select(*named).distinct(), "dropped")
    same = F.col(doc_id).eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("d_digest"))
    left = own.withColumn("digest", digest).join(bounded(dropped, BROADCAST_DIGESTS), same, "left_anti")
    several = found.where("kept AND group_size > 1").groupBy("doc_id", "digest").count().where("count > 1")
    several = scratch.keep(several.select(*named), "several")
    if not several.isEmpty():
        once = left.join(bounded(several, BROADCAST_DIGESTS), same, "left_semi").dropDuplicates([doc_id, "digest"])
        left = left.join(bounded(several, BROADCAST_DIGESTS), same, "left_anti").unionByName(once)
    return left.drop("digest").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows without an id or without words are linked with nothing and stay; rows
    that repeat an id are one document and stay or go together.
    """
    scratch = Scratch(spark, "drop-near-copies")
    own, names = number_columns(docs)
    doc_id = names["doc_id"]
    dropped = ngram_join.ngram_join(own, doc_id, names["text"]).where("component_id <> doc_id").select(F.col("doc_id").alias("d_id")).distinct()
    dropped = scratch.keep(dropped, "dropped")
    return own.join(bounded(dropped), F.col(doc_id) == F.col("d_id"), "left_anti").toDF(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become marks, and n_chars follows.  Null texts stay as they are."""
    own, names = number_columns(docs)
    text, n_chars = F.col(names["text"]), F.col(names["n_chars"])
    own = own.withColumn(names["text"], secrets.masked(text))
    length = F.char_length(text).cast(docs.schema[docs.columns.index("n_chars")].dataType)
    return own.withColumn(names["n_chars"], F.when(text.isNull(), n_chars).otherwise(length)).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens; a null text is the end token alone."""
    own, names = number_columns(docs)
    return packing.pack(own, public_tokenizers.path("byte_bpe_50k.json"), id_col=names["doc_id"], text_col=names["text"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Profiles, novelty and packing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, so a lost executor costs one stage."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
