"""Row-level changes: DELETE, UPDATE, MERGE and upsert, copy-on-write or merge-on-read.

Copy-on-write rewrites just the files that hold a changed row; merge-on-read
writes delete files (and new rows) and leaves data files alone.  A predicate
that is NULL changes nothing.  Each statement is one commit; one that changes no
row is none.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MergeCardinalityError, SchemaMismatch
from ..plans import predicates, scan
from ..plans.schema import spark_type
from ..plans.transaction import Transaction
from ..sources import storage, writer

if TYPE_CHECKING:
    from ..table import Table

COPY_ON_WRITE, MERGE_ON_READ = "copy-on-write", "merge-on-read"
Assignment = dict[str, "Column | str"]


def _as_column(v: Column | str) -> Column:
    return v if isinstance(v, Column) else F.expr(v)


def _true(condition: Column | str | list | None) -> Column:
    c = predicates.column_of(condition)
    return F.lit(True) if c is None else F.coalesce(c, F.lit(False))


class _Target:
    """The table's rows with their places, pruned by the statement's condition."""

    def __init__(self, table: Table, condition=None):
        self.table, self.spark = table, table.spark
        self.meta, self.schema = table.metadata, table.schema
        self.tasks = scan.plan(self.meta, self.meta.snapshot(), self.schema, condition)
        self.by_uri = {storage.file_uri(t.data.file.path): t for t in self.tasks}

    def rows(self, files: list[str] | None = None) -> DataFrame:
        tasks = self.tasks if files is None else [self.by_uri[f] for f in files]
        return scan.to_frame(self.spark, self.meta, tasks, self.schema, with_position=True)

    def write(self, rows: DataFrame) -> list:
        return self.table.write_files(rows)

    def obsolete_deletes(self, removed: list[str]) -> list[str]:
        """Position-delete files all of whose targets go away with this commit."""
        gone = set(removed)
        out = []
        snapshot = self.meta.snapshot()
        for e in snapshot.delete_files() if snapshot else []:
            if e.file.targets and set(e.file.targets) <= gone:
                out.append(e.file.path)
        return out

    def drop(self, tx: Transaction, uris: list[str]) -> None:
        tx.delete_files(storage.from_file_uri(u) for u in uris)
        tx.delete_files(self.obsolete_deletes(uris))


def _touched(rows: DataFrame, hit: Column) -> tuple[list[str], int]:
    """Files that hold a matching row (file names, not rows, reach the driver) and the number of such rows."""
    found = rows.where(hit).groupBy(scan.FILE).count().collect()
    return sorted(r[scan.FILE] for r in found), sum(r["count"] for r in found)


def delete(table: Table, condition: Column | str | list, strategy: str = COPY_ON_WRITE, keys: list[str] | None = None) -> Transaction:
    """Rows for which the condition is true go.  Merge-on-read with ``keys`` writes equality deletes, which also
    reach rows outside the condition that share a deleted row's key; without keys position deletes."""
    target = _Target(table, condition)
    tx = Transaction(table, "delete")
    hit = _true(condition)
    rows = target.rows()
    if strategy == MERGE_ON_READ and keys:
        found = [table.schema.need(k) for k in keys]
        files = writer.write_equality_deletes(rows.where(hit), found, table.location)
        tx.affected = sum(f.record_count for f in files)
        return tx.add_files(files)
    if strategy == MERGE_ON_READ:
        gone = rows.where(hit).select(F.col(scan.FILE).alias("file_path"), F.col(scan.POS).alias("pos"))
        files = writer.write_position_deletes(gone, table.location)
        tx.affected = sum(f.record_count for f in files)
        return tx.add_files(files)
    files, tx.affected = _touched(rows, hit)
    if files:
        target.drop(tx, files)
        tx.add_files(target.write(target.rows(files).where(~hit).select(*_names(table))))
    return tx


def _names(table: Table) -> list[Column]:
    return [F.col(f"`{n}`") for n in table.schema.names]


def _assigned(table: Table, assignments: Assignment, when: Column | None = None) -> list[Column]:
    """The table's columns with new values, all computed from the old ones."""
    if unknown := [c for c in assignments if c not in table.schema.names]:
        raise SchemaMismatch(f"no columns {unknown}")
    out = []
    for f in table.schema.fields:
        old = F.col(f"`{f.name}`")
        if f.name in assignments:
            new = _as_column(assignments[f.name]).cast(spark_type(f.type))
            old = new if when is None else F.when(when, new).otherwise(old)
        out.append(old.alias(f.name))
    return out


def update(table: Table, condition: Column | str | list, assignments: Assignment, strategy: str = COPY_ON_WRITE) -> Transaction:
    """Sets columns of the rows for which the condition is true; values see the row before the update."""
    target = _Target(table, condition)
    tx = Transaction(table, "overwrite")
    hit = _true(condition)
    rows = target.rows()
    files, tx.affected = _touched(rows, hit)
    if not files:
        return tx
    if strategy == MERGE_ON_READ:
        touched = target.rows(files).where(hit)
        tx.add_files(writer.write_position_deletes(touched.select(F.col(scan.FILE).alias("file_path"), F.col(scan.POS).alias("pos")), table.location))
        return tx.add_files(target.write(touched.select(*_assigned(table, assignments))))
    target.drop(tx, files)
    return tx.add_files(target.write(target.rows(files).select(*_assigned(table, assignments, hit))))


def _equal_columns(on: str) -> dict[str, str]:
    """{target column: source column} of a condition that is a conjunction of equalities t.a = s.b; else none."""
    found = {}
    for term in re.split(r"\s+AND\s+", on.strip(), flags=re.I):
        m = re.fullmatch(r"([ts])\.(\w+)\s*=\s*([ts])\.(\w+)", term.strip())
        if not m or m[1] == m[3]:
            return {}
        found[m[2] if m[1] == "t" else m[4]] = m[4] if m[1] == "t" else m[2]
    return found


@dataclass
class Clause:
    action: str  # update, delete or insert
    condition: Column | str | None = None
    assignments: Assignment | None = None  # None: all columns by name


@dataclass
class MergeBuilder:
    """``merge(t, source, on).when_matched_update(...).when_not_matched_insert().execute()``.

    ``on`` is a condition over the aliases t (target) and s (source), or a list of
    key columns, by default the table's identifiers.  Clauses are tried in order
    and the first whose condition is true acts; NULL is false.  Expressions may
    use t and s (inserts only s).  If an acting clause meets one target row with
    several source rows, MergeCardinalityError is raised.
    """

    table: Table
    source: DataFrame
    on: Column | str | list[str] | None = None
    strategy: str = COPY_ON_WRITE
    matched: list[Clause] = field(default_factory=list)
    unmatched: list[Clause] = field(default_factory=list)

    def when_matched_update(self, assignments: Assignment | None = None, condition: Column | str | None = None) -> MergeBuilder:
        self.matched.append(Clause("update", condition, assignments))
        return self

    def when_matched_delete(self, condition: Column | str | None = None) -> MergeBuilder:
        self.matched.append(Clause("delete", condition))
        return self

    def when_not_matched_insert(self, assignments: Assignment | None = None, condition: Column | str | None = None) -> MergeBuilder:
        self.unmatched.append(Clause("insert", condition, assignments))
        return self

    def _on(self) -> Column:
        if isinstance(self.on, Column):
            return self.on
        if isinstance(self.on, str):
            return F.expr(self.on)
        keys = self.on or self.table.schema.identifiers
        if not keys:
            raise SchemaMismatch("a merge needs a condition, key columns or a table with identifiers")
        out = None
        for k in keys:
            c = F.col(f"t.`{k}`") == F.col(f"s.`{k}`")
            out = c if out is None else out & c
        return out

    def _values(self, clause: Clause, old: bool) -> Column:
        """A struct of the table's columns after the clause; ``old``: unassigned ones keep the target's value."""
        names, have = self.table.schema.names, set(self.source.columns)
        given = clause.assignments
        if given is None:
            given = {n: F.col(f"s.`{n}`") for n in names if n in have}
        if unknown := [c for c in given if c not in names]:
            raise SchemaMismatch(f"no columns {unknown}")
        out = []
        for f in self.table.schema.fields:
            kind = spark_type(f.type)
            rest = F.col(f"t.`{f.name}`") if old else F.lit(None).cast(kind)
            out.append((_as_column(given[f.name]).cast(kind) if f.name in given else rest).alias(f.name))
        return F.struct(*out)

    def _key_bounds(self, source: DataFrame) -> list[predicates.Triple]:
        """Comparisons that every target row with a source row's keys satisfies; they prune the target's files."""
        if isinstance(self.on, Column):
            return []
        keys = {k: k for k in self.on or self.table.schema.identifiers} if not isinstance(self.on, str) else _equal_columns(self.on)
        bounded = [f.name for f in writer.stat_columns(self.table.schema) if not isinstance(spark_type(f.type), T.TimestampType)]
        keys = {t: s for t, s in keys.items() if t in bounded and s in source.columns and source.schema[s].dataType == spark_type(self.table.schema.need(t).type)}
        if not keys:
            return []
        found = source.agg(*(f(F.col(f"`{s}`")) for s in keys.values() for f in (F.min, F.max))).first()
        out = []
        for i, k in enumerate(keys):
            low, high = found[2 * i], found[2 * i + 1]
            if low is not None and low == low and high == high:  # a NaN bounds nothing
                out += [(k, ">=", low), (k, "<=", high)]
        return out

    @staticmethod
    def _first(clauses: list[Clause], start: int = 0) -> Column:
        """The number of the first clause whose condition is true, counted from ``start``; null if none."""
        c = None
        for k, clause in enumerate(clauses, start):
            hit = _true(clause.condition)
            c = F.when(hit, F.lit(k)) if c is None else c.when(hit, F.lit(k))
        return c if c is not None else F.lit(None).cast("int")

    def execute(self) -> Transaction:
        table, spark = self.table, self.table.spark
        staging = f"{table.location}/staging/{uuid.uuid4().hex}"
        tx = Transaction(table, "overwrite")
        try:
            # The source is read several times: written once, it is the same each time.
            self.source.write.parquet(f"{staging}/source")
            s = spark.read.schema(self.source.schema).parquet(f"{staging}/source").alias("s")
            target = _Target(table, self._key_bounds(s))
            t = target.rows().alias("t")
            # One join from the source gives the changed and the new rows.
            found = s.join(t, self._on(), "left" if self.unmatched else "inner")
            known = F.col(f"t.{scan.FILE}").isNotNull()
            acting = F.when(known, self._first(self.matched)).otherwise(self._first(self.unmatched, len(self.matched)))
            clauses = [*self.matched, *self.unmatched]
            value = F.lit(None).cast(table.schema.spark())
            for k, clause in enumerate(clauses):
                if clause.action != "delete":
                    value = F.when(F.col("__clause") == k, self._values(clause, clause.action == "update")).otherwise(value)
            kinds = F.element_at(F.array(*(F.lit(c.action) for c in clauses)), F.col("__clause") + 1)
            picked = found.withColumn("__clause", acting).where("__clause IS NOT NULL")
            picked = picked.select(F.col(scan.FILE), F.col(scan.POS), kinds.alias("__action"), value.alias("__row"))
            picked.write.parquet(f"{staging}/changed")
            picked = spark.read.schema(picked.schema).parquet(f"{staging}/changed")
            changed = picked.where("__action <> 'insert'")
            files, hits = [], 0
            if self.matched:
                if changed.groupBy(scan.FILE, scan.POS).count().where("count > 1").limit(1).count():
                    raise MergeCardinalityError("several source rows would change one target row")
                files, hits = _touched(changed, F.lit(True))
            inserts, inserted = (picked.where("__action = 'insert'").select("__row.*") if self.unmatched else None), 0
            if files and self.strategy == MERGE_ON_READ:
                tx.add_files(writer.write_position_deletes(changed.select(F.col(scan.FILE).alias("file_path"), F.col(scan.POS).alias("pos")), table.location))
                tx.add_files(target.write(changed.where("__action = 'update'").select("__row.*")))
            elif files:
                target.drop(tx, files)
                old = target.rows(files)
                names = table.schema.names
                both = old.join(changed.withColumnsRenamed({scan.FILE: "__f", scan.POS: "__p"}), (F.col(scan.FILE) == F.col("__f")) & (F.col(scan.POS) == F.col("__p")), "left")
                kept = both.where("__action IS NULL OR __action <> 'delete'")
                tx.add_files(target.write(kept.select(*(F.when(F.col("__action").isNull(), F.col(f"`{n}`")).otherwise(F.col(f"__row.`{n}`")).alias(n) for n in names))))
            if inserts is not None:
                written = target.write(inserts)
                inserted = sum(f.record_count for f in written)
                tx.add_files(written)
            tx.affected = hits + inserted
            return tx
        finally:
            storage.delete(staging)


def upsert(table: Table, source: DataFrame, keys: list[str] | None = None, strategy: str = COPY_ON_WRITE) -> Transaction:
    """Rows with a known key are replaced, others are added."""
    return MergeBuilder(table, source, keys, strategy).when_matched_update().when_not_matched_insert().execute()
