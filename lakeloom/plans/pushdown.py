"""Pruning by what Catalyst has pushed down: conditions read off an optimised plan.

A query over a table's rows is optimised as usual; the filters that then stand
right above the table's file relations are translated into comparisons that
files are pruned by.  Filters that have come through joins, views, unions and
subqueries count, as do disjunctions: a file stays if any of their branches may
match.  What can't be translated prunes nothing.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame

from ..sources import storage
from . import predicates, scan
from .metadata import TableMetadata
from .schema import Schema

#: Branches of a condition's disjunctive form that are looked at; a wider condition prunes nothing.
MOST_BRANCHES = 64
_COMPARE = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
_EPOCH = dt.datetime(1970, 1, 1)

Branches = list[list[predicates.Triple]]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(node) -> tuple[bool, Any]:
    """(whether it is a literal that bounds can be compared with, its value)."""
    if _name(node) != "Literal":
        return False, None
    value, kind = node.value(), node.dataType().simpleString()
    if value is None:
        return False, None
    if kind == "date":
        return True, (_EPOCH + dt.timedelta(days=value)).date()
    if kind == "timestamp_ntz":
        return True, _EPOCH + dt.timedelta(microseconds=value)
    if kind == "string":
        return True, value if isinstance(value, str) else value.toString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return True, value
    if kind.startswith("decimal"):
        return True, float(value.toString())
    return False, None


def _next(prefix: str) -> str | None:
    """A string above all that begin with a prefix."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0xD7FF:
            return prefix[:i] + chr(ord(prefix[i]) + 1)
    return None


def branches_of(node) -> Branches:
    """A condition as a disjunction of conjunctions; [[]] if nothing is known."""
    kind = _name(node)
    if kind in ("And", "Or"):
        a, b = branches_of(node.left()), branches_of(node.right())
        if kind == "Or":
            return a + b if [] not in a and [] not in b and len(a) + len(b) <= MOST_BRANCHES else [[]]
        return [x + y for x in a for y in b] if len(a) * len(b) <= MOST_BRANCHES else a
    if kind in ("IsNull", "IsNotNull") and _name(node.child()) == "AttributeReference":
        return [[(node.child().name(), "is null" if kind == "IsNull" else "is not null", None)]]
    if kind in _COMPARE:
        for attribute, other, op in ((node.left(), node.right(), _COMPARE[kind]), (node.right(), node.left(), _TURNED[_COMPARE[kind]])):
            known, value = _literal(other)
            if known and _name(attribute) == "AttributeReference":
                return [[(attribute.name(), op, value)]]
    if kind == "In" and _name(node.value()) == "AttributeReference":
        values = [_literal(x) for x in _items(node.list())]
        if values and all(known for known, _ in values):
            return [[(node.value().name(), "in", [v for _, v in values])]]
    if kind == "StartsWith" and _name(node.left()) == "AttributeReference":
        known, value = _literal(node.right())
        if known and value and (above := _next(value)):
            return [[(node.left().name(), ">=", value), (node.left().name(), "<", above)]]
    if kind == "Not" and _name(node.child()) == "EqualTo":
        for attribute, other in ((node.child().left(), node.child().right()), (node.child().right(), node.child().left())):
            known, value = _literal(other)
            if known and _name(attribute) == "AttributeReference":
                return [[(attribute.name(), "<", value)], [(attribute.name(), ">", value)]]
    return [[]]


def _relations(plan) -> list[tuple[list[str], Branches]]:
    """(files, branches of the filter above) of every file relation of a plan, subqueries included."""
    out, todo = [], [(plan, [[]])]
    while todo:
        node, above = todo.pop()
        kind = _name(node)
        if kind == "LogicalRelation":
            relation = node.relation()
            if _name(relation) == "HadoopFsRelation":
                out.append((relation.location().rootPaths().mkString("\n").split("\n"), above))
            continue
        inner = branches_of(node.condition()) if kind == "Filter" else [[]]
        todo += [(child, inner if _name(child) == "LogicalRelation" else [[]]) for child in _items(node.children())]
        todo += [(sub, [[]]) for sub in _items(node.subqueries())]
    return out


def pruned(meta: TableMetadata, tasks: list[scan.ScanTask], schema: Schema, query: DataFrame) -> list[scan.ScanTask]:
    """The tasks whose files a query over all of them may need."""
    specs = {s.spec_id: s for s in meta.specs}
    by_path = {storage.normalise(t.data.file.path): t for t in tasks}
    needed: set[str] = set()
    seen: set[str] = set()
    for paths, branches in _relations(query._jdf.queryExecution().optimizedPlan()):
        own = [p for path in paths if (p := storage.normalise(storage.from_file_uri(path))) in by_path]
        seen.update(own)
        buckets = [scan._buckets(b, schema, specs) for b in branches]
        for p in own:
            if p not in needed and any(predicates.file_may_match(by_path[p].data.file, b, schema, specs, bucket) for b, bucket in zip(branches, buckets)):
                needed.add(p)
    return [t for p, t in by_path.items() if p in needed or p not in seen]
