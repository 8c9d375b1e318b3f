"""Operator 10, token counts: offset-mapped attribution.

A document is encoded once, as a whole, so its token count is the true one.  The
character span of every token is then interval-joined to the document's
sections (lines, or spans that the caller gives, such as the fields that a text
was joined from).  A token that crosses a boundary is allocated by a rule:

* ``first``: to the section of its first character (the default);
* ``last``: to the section of its last character;
* ``split``: to all sections that it touches, in proportion to its characters.

Under each rule the counts of a document add up to its number of tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_slices, number_columns
from .tokenizer import text_encoder

RULES = ("first", "last", "split")
#: Section number of characters that no given span covers.
OUTSIDE = -1


def line_starts(text: str) -> np.ndarray:
    """First character of each line; a line feed belongs to the line that it ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate(([0], np.flatnonzero(points == 10) + 1))


def token_ends(starts: np.ndarray, length: int) -> np.ndarray:
    """One past each token's last character; tokens that split one character all cover it."""
    if not len(starts):
        return starts
    step = np.append(starts[1:], length)
    return np.where(step > starts, step, starts + 1)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each interval [bounds[i], bounds[i + 1]) of the text.

    Intervals may be empty; then no token starts in them.  A crossing token is
    counted where it is begun.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = np.bincount(first[last > first], minlength=n)[:n]
    if rule == "first":
        return np.bincount(first, minlength=n)[:n].astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n)[:n].astype(float), crossing
    inside = last == first
    got = np.bincount(first[inside], minlength=n)[:n].astype(float)
    for a, b, i, j in zip(starts[~inside], ends[~inside], first[~inside], last[~inside]):
        for k in range(i, j + 1):
            got[k] += (min(b, bounds[k + 1]) - max(a, bounds[k])) / (b - a)
    return got, crossing


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    rule: str = "first",
    id_col: str = "doc_id",
    text_col: str = "text",
    spans_col: str | None = None,
) -> DataFrame:
    """One row per row and section: doc_id, section, start, end, n_tokens double, n_crossing.

    Sections are the text's lines or, with ``spans_col`` (array<struct<start,
    end>> of characters, in order and without overlap, null as empty), the given
    spans; tokens outside all of them are counted in section -1, whose start and
    end are null.  A null or empty text has one empty line and no given span
    counts.  Repeated rows, null ids and texts of any length are carried; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = {"doc_id": id_col, "text": text_col} | ({"spans": spans_col} if spans_col else {})

    def run(slices):
        encoder = text_encoder(tokenizer_path)
        for part in slices:
            out: dict[str, list] = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")}

            def add(doc_id, section, start, end, tokens, crossing):
                for k, v in zip(out, (doc_id, section, start, end, tokens, crossing)):
                    out[k].append(v)

            for i, text in enumerate(part["text"]):
                doc_id, text = part["doc_id"][i], text or ""
                starts = encoder.spans(text)
                ends = token_ends(starts, len(text))
                if not spans_col:
                    at = line_starts(text)
                    bounds = np.append(at, max(len(text), at[-1]))
                    tokens, crossing = attribute(starts, ends, bounds, rule)
                    out["doc_id"] += [doc_id] * len(at)
                    out["section"] += range(len(at))
                    out["start"] += at.tolist()
                    out["end"] += bounds[1:].tolist()
                    out["n_tokens"] += tokens.tolist()
                    out["n_crossing"] += crossing.tolist()
                    continue
                # Given spans and the gaps between them are intervals in turn.
                spans = [(s["start"], s["end"]) for s in part["spans"][i] or [] if s is not None]
                bounds = np.array([0, *(x for s in spans for x in s), max(len(text), spans[-1][1] if spans else 0)], np.int64)
                tokens, crossing = attribute(starts, ends, bounds, rule)
                for k, (start, end) in enumerate(spans):
                    add(doc_id, k, start, end, float(tokens[2 * k + 1]), int(crossing[2 * k + 1]))
                if tokens[::2].sum():
                    add(doc_id, OUTSIDE, None, None, float(tokens[::2].sum()), int(crossing[::2].sum()))
            yield out

    return map_slices(docs, f"doc_id {id_type}, section int, start long, end long, n_tokens double, n_crossing long", columns, run)


def field_counts(df: DataFrame, tokenizer_path: str, fields: list[str], separator: str = "\n", rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """Tokens of each field of a row whose fields are encoded as one text, joined by ``separator``.

    doc_id, section (number of the field, -1 for separators), start, end,
    n_tokens, n_crossing.  Null fields count as empty; null ids, repeated rows and
    other columns are treated as in ``token_counts``; an empty table gives an
    empty result.
    """
    numbered, names = number_columns(df)
    parts = [F.coalesce(F.col(names[f]).cast("string"), F.lit("")) for f in fields]
    start, spans = F.lit(0), []
    for p in parts:
        end = start + F.char_length(p)
        spans.append(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        start = end + len(separator)
    joined = numbered.select(F.col(names[id_col]).alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*spans).alias("spans"))
    return token_counts(joined, tokenizer_path, rule, spans_col="spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return got.withColumn("n_tokens", F.col("n_tokens").cast("long"))
