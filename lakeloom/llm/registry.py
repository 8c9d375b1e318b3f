"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, flac, language_id, lm_score, ngram_join, packing, quality, secrets, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_bpe_prefix_dp": bpe.op2_bpe_prefix_dp,
        "op3_importance_resampling": quality.op3_importance_resampling,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_language_id": language_id.op5_language_id,
        "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
        "op7_flac_media": flac.op7_flac_media,
        "op8_maxent_lm": lm_score.op8_maxent_lm,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard_join": ngram_join.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
