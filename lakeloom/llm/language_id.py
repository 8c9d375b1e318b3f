"""Operator 5, language ID: rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's most frequent letter n-grams (one to
three symbols, words padded with a space), most frequent first.  A document's
own most frequent n-grams are ranked alike; its distance to a language is the
sum over its n-grams of how many places they are out of place, an n-gram that
the profile lacks counting as one whole profile length.

Profiles are fitted on a bounded sample of labelled rows (``rows_per_language``
expected rows of each language, drawn by a hash over all labelled rows, and at
least one); every label has a profile.  Prediction reads every whole text.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, crc_part, documents, map_slices, select_exact

#: Places in a language's profile, n-grams of a document that are ranked.
PROFILE, RANKED = 500, 300
#: Expected labelled rows a language is fitted on.
ROWS_PER_LANGUAGE = 1_500
#: n-grams that are counted at once; bounds memory on very long texts.
WINDOW = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of a text's letter n-grams and their counts; empty if it has no letter.

    A symbol takes 21 bits: a space is 1, a letter its code point plus 2.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_table()[points]
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    symbols = np.ones(len(points) + 2, np.int64)
    symbols[1:-1] = np.where(letters, points + 2, 1)
    x = symbols[np.concatenate(([True], (symbols[1:] != 1) | (symbols[:-1] != 1)))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), WINDOW):
        w = x[at : at + WINDOW + 2]
        one, two = w[:WINDOW], (w[:-1] << 21 | w[1:])[:WINDOW]
        three = (w[:-2] << 42 | w[1:-1] << 21 | w[2:])[w[1:-1] != 1]
        found.append(np.unique(np.concatenate((one[one != 1], two, three)), return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent of some sorted codes, most frequent first; equal counts by code."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[-k]
        above = np.flatnonzero(counts > least)
        at = np.concatenate((above, np.flatnonzero(counts == least)[: k - len(above)]))
        codes, counts = codes[at], counts[at]
    return codes[np.lexsort((codes, -counts))]


@dataclass
class Profiles:
    """Rank of each n-gram in each language; ``size`` where a profile lacks it."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, profiles: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(profiles)
        codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        ranks = np.full((len(codes), len(languages)), size, np.int32)
        for j, language in enumerate(languages):
            ranks[np.searchsorted(codes, profiles[language]), j] = np.arange(len(profiles[language]))
        return cls(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: first by name) and one minus its distance over the largest possible."""
        codes, counts = ngram_counts(text) if text else (np.empty(0), np.empty(0))
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = most_frequent(codes, counts, RANKED)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = self.ranks[at[known]]
        places = np.minimum(np.abs(ranks - np.flatnonzero(known)[:, None]), self.size)
        distance = np.where(ranks < self.size, places, self.size).sum(axis=0) + self.size * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def fit_profiles(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    size: int = PROFILE,
    id_col: str | None = None,
) -> Profiles:
    """Profiles from rows with a non-null language and text.  No labelled row: no language is learned.

    A language's rows are drawn by a hash of text and id, so that copies of one
    text are drawn each on its own; rows that repeat both count once.  A language
    with few rows has all of them, and each has one at least.  The profiles take
    about 6 KB a language.
    """
    own = {"text": text_col, "lang": lang_col} | ({"id": id_col} if id_col else {})
    rows = select_exact(labelled, own).withColumn("lang", F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select("text", "lang", F.xxhash64(*(["id", "text"] if id_col else ["text"])).alias("h"))
    scratch = Scratch(labelled.sparkSession, "language-id")
    counts = scratch.keep(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("h").alias("first")), "counts")
    drawn = F.pmod(F.xxhash64("h"), F.lit(1 << 30)).cast("double") * F.col("rows") < float((1 << 30) * rows_per_language)
    sample = rows.join(bounded(counts), "lang").where(drawn | (F.col("h") == F.col("first"))).select("lang", "text", "h").dropDuplicates(["lang", "h"])

    def count(slices):
        for part in slices:
            total: dict[tuple[str, int], int] = {}
            for lang, text in zip(part["lang"], part["text"]):
                codes, n = ngram_counts(text)
                for c, k in zip(codes.tolist(), n.tolist()):
                    total[lang, c] = total.get((lang, c), 0) + k
            yield {"lang": [k[0] for k in total], "code": [k[1] for k in total], "n": list(total.values())}

    grams = map_slices(sample, "lang string, code long, n long", {"lang": "lang", "text": "text"}, count)
    summed = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = summed.withColumn("place", place).where(F.col("place") <= size).collect()  # size rows a language at most
    profiles: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Profiles.of(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with lang_pred and score (0 to 1), one row per row.

    ``und`` with score 0 where the text is null, empty or without any letter, or
    where no language was learned.  Null ids and repeated rows are carried as
    they are; other columns are ignored, whatever their names.
    """
    names = {f"k{i}": c for i, c in enumerate(carry)}
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in names.items())

    def predict(slices):
        for part in slices:
            got = [profiles.predict(text) for text in part["text"]]
            yield {n: part[n] for n in names} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    out = map_slices(docs, f"{fields}, lang_pred string, score double", names | {"text": text_col}, predict)
    return out.select(*(F.col(n).alias(c) for n, c in names.items()), "lang_pred", "score")


def held_out(doc_id) -> F.Column:
    return crc_part(doc_id, 4) == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), id_col="doc_id")
    found = identify(docs, profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
