"""Predicates that prune files: conjunctions of (column, operator, literal).

A condition may be a SQL string, a Column, or a list of such triples.  Triples,
and SQL strings that are a plain conjunction of comparisons with literals, also
prune files by partition values and column bounds.  Pruning is conservative and
the condition itself is always applied to the rows.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import transforms
from .metadata import DataFile
from .partition import PartitionSpec
from .schema import Schema

Triple = tuple[str, str, Any]
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}
_LITERAL = r"(?:-?\d+(?:\.\d+)?|'(?:[^']|'')*'|(?:DATE|TIMESTAMP|TIMESTAMP_NTZ)\s*'[^']*'|TRUE|FALSE)"
_TERM = re.compile(
    rf"\s*([A-Za-z_]\w*)\s*(?:(=|==|<=|>=|<|>)\s*({_LITERAL})|(?:IN\s*\(\s*({_LITERAL}(?:\s*,\s*{_LITERAL})*)\s*\))|(IS\s+NULL)|(IS\s+NOT\s+NULL)|BETWEEN\s+({_LITERAL})\s+AND\s+({_LITERAL}))\s*(AND\b|$)",
    re.I,
)


def _value(text: str) -> Any:
    upper = text.upper()
    if upper in ("TRUE", "FALSE"):
        return upper == "TRUE"
    if text.endswith("'"):
        body = text[text.index("'") + 1 : -1].replace("''", "'")
        if upper.startswith("TIMESTAMP"):
            return dt.datetime.fromisoformat(body)
        return dt.date.fromisoformat(body) if upper.startswith("DATE") else body
    return float(text) if "." in text else int(text)


def triples_of(condition: str) -> list[Triple]:
    """Comparisons of a SQL conjunction; empty if the string is anything else."""
    at, out = 0, []
    while at < len(condition):
        m = _TERM.match(condition, at)
        if not m:
            return []
        name = m[1]
        if m[2]:
            out.append((name, "=" if m[2] == "==" else m[2], _value(m[3])))
        elif m[4]:
            out.append((name, "in", [_value(v) for v in re.findall(_LITERAL, m[4], re.I)]))
        elif m[7]:
            out += [(name, ">=", _value(m[7])), (name, "<=", _value(m[8]))]
        else:
            out.append((name, "is null" if m[5] else "is not null", None))
        at = m.end()
        if m[9].upper() == "AND" and at >= len(condition):
            return []
    return out


def column_of(condition: str | Column | list[Triple] | None) -> Column | None:
    """The condition as a Column that every row is checked with."""
    if condition is None or isinstance(condition, Column):
        return condition
    if isinstance(condition, str):
        return F.expr(condition)
    terms = [OPERATORS[op.lower()](F.col(name), value) for name, op, value in condition]
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def pruning_triples(condition: str | Column | list[Triple] | None) -> list[Triple]:
    if isinstance(condition, str):
        return triples_of(condition)
    return list(condition) if isinstance(condition, list) else []


def encode(value: Any, kind: dict) -> Any:
    """A value as bounds store it: numbers, strings, days, microseconds; None if it has no order here."""
    tag = kind["type"]
    if value is None or tag in ("binary", "fixed", "struct", "list", "map"):
        return None
    if tag == "date":
        if isinstance(value, dt.datetime):
            value = value.date()
        return (value - dt.date(1970, 1, 1)).days if isinstance(value, dt.date) else (dt.date.fromisoformat(value) - dt.date(1970, 1, 1)).days
    if tag == "timestamp":
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value)
        if not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        zero = dt.datetime(1970, 1, 1, tzinfo=value.tzinfo and dt.UTC)
        d = value - zero
        return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    if tag == "decimal":
        return float(value)
    if tag in ("float", "double"):
        return float(value)
    return value


def _comparable(a: Any, b: Any) -> bool:
    number = (int, float)
    return isinstance(a, str) and isinstance(b, str) or isinstance(a, number) and isinstance(b, number)


def _may_match(op: str, value: Any, low: Any, high: Any) -> bool:
    """Whether a range of values may satisfy a comparison; unknown bounds may."""
    values = value if op == "in" else [value]
    if low is None or high is None:
        return True
    if any(v is not None and not _comparable(v, low) for v in values):
        return True
    if op in ("=", "in"):
        return any(v is not None and low <= v <= high for v in values)
    v = values[0]
    if v is None:
        return False
    return {"<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}[op]


def _partition_may_match(op: str, value: Any, transform: str, kind: dict, stored: Any, bucket: Callable[[Any, int, dict], int]) -> bool:
    name, n = transforms.parse(transform)
    if name == "void":
        return True
    if stored is None and kind["type"] in ("string", "uuid") and name in ("identity", "truncate"):
        stored = ""  # folders name empty strings and nulls alike
    if stored is None:
        return False  # null never satisfies a comparison
    values = value if op == "in" else [value]
    if name == "bucket":
        return op not in ("=", "in") or any(bucket(v, n, kind) == stored for v in values if v is not None)
    if name == "identity":
        return _may_match(op, [encode(v, kind) for v in values] if op == "in" else encode(value, kind), stored, stored)
    mapped = [_map(name, n, v, kind) for v in values]
    if any(m is None for m in mapped):
        return True
    loose = {"<": "<=", ">": ">="}.get(op, op)  # values of one partition lie on both sides of the literal
    return _may_match(loose, mapped if op == "in" else mapped[0], stored, stored)


def _map(name: str, n: int | None, value: Any, kind: dict) -> Any:
    """The transform of a literal; None if it can't be told."""
    if name == "truncate":
        return value[:n] if isinstance(value, str) else None
    try:
        number = encode(value, kind)
    except (ValueError, AttributeError, TypeError):
        return None
    if number is None:
        return None
    days = number if kind["type"] == "date" else number // 86_400_000_000
    if name == "hour":
        return number // 3_600_000_000
    if name == "day":
        return days
    date = dt.date(1970, 1, 1) + dt.timedelta(days=days)
    return date.year - 1970 if name == "year" else (date.year - 1970) * 12 + date.month - 1


def file_may_match(f: DataFile, triples: list[Triple], schema: Schema, specs: dict[int, PartitionSpec], bucket: Callable[[Any, int, dict], int]) -> bool:
    """Whether a file may hold a row that satisfies all comparisons."""
    for name, op, value in triples:
        source = schema.find(name)
        if source is None:
            continue
        op = op.lower()
        key = str(source.id)
        nulls, values = f.null_counts.get(key), f.value_counts.get(key)
        if op == "is null":
            if nulls == 0:
                return False
            continue
        if nulls is not None and values is not None and nulls == values:
            return False
        if op == "is not null":
            continue
        try:
            stored = [encode(v, source.type) for v in value] if op == "in" else encode(value, source.type)
        except (ValueError, AttributeError, TypeError):
            continue
        # Floats that hold a NaN have no usable upper bound: NaN is the largest value in Spark.
        if key in f.lower and key in f.upper and not f.nan_counts.get(key) and not _may_match(op, stored, f.lower[key], f.upper[key]):
            return False
        for p in specs[f.spec_id].fields:
            if p.source_id == source.id and str(p.field_id) in f.partition and not _partition_may_match(op, value, p.transform, source.type, f.partition[str(p.field_id)], bucket):
                return False
    return True
