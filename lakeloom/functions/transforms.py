"""Partition transforms and layout values as column expressions; no Python runs on rows."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

_FORM = re.compile(r"(identity|bucket|truncate|year|month|day|hour|void)(?:\[(\d+)\])?")


def parse(transform: str) -> tuple[str, int | None]:
    """``bucket[16]`` -> ("bucket", 16)."""
    m = _FORM.fullmatch(transform)
    if not m or (m[1] in ("bucket", "truncate")) != (m[2] is not None) or m[2] and not int(m[2]):
        raise ValidationError(f"no such transform: {transform}")
    return m[1], int(m[2]) if m[2] else None


def check_source(transform: str, kind: dict) -> None:
    """Raises unless a transform applies to a type."""
    name, _ = parse(transform)
    tag = kind["type"]
    allowed = {"truncate": ("string", "binary"), "hour": ("timestamp",)} | dict.fromkeys(("year", "month", "day"), ("date", "timestamp"))
    if name in allowed and tag not in allowed[name] or name == "identity" and tag in ("struct", "list", "map"):
        raise ValidationError(f"{name} does not apply to {tag}")


def result_type(transform: str, source: str) -> str:
    """Spark type name of the transformed value."""
    name, _ = parse(transform)
    return source if name in ("identity", "truncate", "void") else "int"


def apply(transform: str, c: Column, source: str) -> Column:
    """The transformed column; null stays null.

    year, month, day and hour count from 1970 (UTC for time zones), negative
    before it.  bucket is Spark's 32-bit Murmur3 modulo the number of buckets.
    """
    name, n = parse(transform)
    if name == "identity":
        return c
    if name == "void":
        return F.lit(None).cast(source)
    if name == "bucket":
        return F.when(c.isNotNull(), F.pmod(F.hash(c), F.lit(n))).cast("int")
    if name == "truncate":
        return F.substring(c, 1, n)
    if name == "year":
        return (F.year(c) - 1970).cast("int")
    if name == "month":
        return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("int")
    if name == "day":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("int")
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(3_600_000_000)).cast("int")


#: Rows that bounds of a z-order are taken from; bounds a column has, in two levels; bits between two bounds of numbers.
SAMPLE, BOUNDS, FINE_BITS = 16_384, 1_024, 6
_LEVEL = 32


def _rank(c: Column, bounds: list, kind: str) -> Column:
    """Number of bounds that are not above a value, 0 for null: first among every 32nd bound, then among those after it."""
    steps = [bounds[k : k + _LEVEL] for k in range(0, len(bounds), _LEVEL)]
    heads = F.from_json(F.lit(json.dumps([s[0] for s in steps[1:]])), f"array<{kind}>")
    parts = F.from_json(F.lit(json.dumps(steps)), f"array<array<{kind}>>")
    step = F.size(F.filter(heads, lambda b: b <= c))
    rank = step * _LEVEL + F.size(F.filter(F.element_at(parts, step + 1), lambda b: b <= c))
    return F.when(c.isNull(), 0).otherwise(rank).cast("long")


def _fine(c: Column, rank: Column, bounds: list) -> Column:
    """Place of a number between its two bounds, in steps of 2^-FINE_BITS of their distance."""
    all_bounds = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
    low, high = F.get(all_bounds, (rank - 1).cast("int")), F.get(all_bounds, rank.cast("int"))
    place = F.floor((c - low) / (high - low) * (1 << FINE_BITS))
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit((1 << FINE_BITS) - 1)), F.lit(0)).cast("long")


def with_z_value(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds interleaved bits of the columns' ranks: near values in all columns get near z-values.

    Ranks are those among bounds from a bounded sample of all rows, drawn by a
    hash; between two bounds numbers, dates and times are placed by distance.
    Strings and binary values of any length and characters are ranked whole; null
    comes first.  Only the layout depends on the sample, never the rows.
    """
    kinds = dict(df.dtypes)
    out, values = df, []
    for i, column in enumerate(columns):
        c, kind = F.col(f"`{column}`"), kinds[column]
        if kind in ("string", "binary") or kind.startswith(("varchar", "char")):
            c, kind = (F.hex(c) if kind == "binary" else c.cast("string")), "string"
        else:
            if kind == "boolean":
                c = c.cast("int")
            elif kind == "date":
                c = F.datediff(c, F.lit("1970-01-01").cast("date"))
            elif kind.startswith("timestamp"):
                c = F.unix_micros(c.cast("timestamp"))
            c, kind = c.cast("double"), "double"
        out = out.withColumn(f"{name}v{i}", c)
        values.append((f"{name}v{i}", kind))
    drawn = out.select(*(v for v, _ in values)).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in columns), F.monotonically_increasing_id())).limit(SAMPLE)
    sample = drawn.collect()  # SAMPLE rows at most
    ranks = []
    for i, (v, kind) in enumerate(values):
        found = sorted(x for r in sample if (x := r[i]) is not None and (kind == "string" or math.isfinite(x)))
        bounds = sorted({found[k * len(found) // BOUNDS] for k in range(BOUNDS)}) if found else []
        rank = _rank(F.col(v), bounds, kind) if bounds else F.lit(0).cast("long")
        out = out.withColumn(f"{name}r{i}", rank)
        if kind == "double" and bounds:
            r = F.col(f"{name}r{i}")
            out = out.withColumn(f"{name}r{i}", F.shiftleft(r, FINE_BITS) + _fine(F.col(v), r, bounds))
        else:
            out = out.withColumn(f"{name}r{i}", F.shiftleft(F.col(f"{name}r{i}"), FINE_BITS))
        ranks.append(f"{name}r{i}")
    width = BOUNDS.bit_length() + FINE_BITS
    bits = min(width, 63 // len(ranks))
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for i, r in enumerate(ranks):
            z = z + F.shiftleft(F.shiftright(F.col(r), bit + width - bits).bitwiseAND(F.lit(1).cast("long")), bit * len(ranks) + i)
    return out.withColumn(name, z).drop(*(v for v, _ in values), *ranks)
