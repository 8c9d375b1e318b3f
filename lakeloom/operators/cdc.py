"""Changes between snapshots: by file and by row, with named checkpoints.

Row changes read only what differs: files that one side has and the other has
not, and files whose deletes differ.  Rows that a rewrite merely carried over
cancel out.  With key columns, a delete and an insert of one key are an update.
"""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scan
from ..sources import storage

if TYPE_CHECKING:
    from ..table import Table

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _tasks(table: Table, snapshot_id: int | None) -> dict[str, scan.ScanTask]:
    if snapshot_id is None:
        return {}
    return {t.data.file.path: t for t in scan.plan(table.metadata, table.metadata.snapshot(snapshot_id), table.schema)}


def _end(table: Table, end: int | None) -> int | None:
    return end if end is not None else (table.snapshot.snapshot_id if table.snapshot else None)


def file_changes(table: Table, start: int | None, end: int | None = None) -> DataFrame:
    """Data files added (insert) and removed (delete) from one snapshot to another; start None: the empty table."""
    a, b = _tasks(table, start), _tasks(table, _end(table, end))
    rows = [(INSERT, p, b[p].data.file.record_count) for p in sorted(b.keys() - a.keys())]
    rows += [(DELETE, p, a[p].data.file.record_count) for p in sorted(a.keys() - b.keys())]
    return table.spark.createDataFrame(rows, "change string, path string, record_count long")


def _comparable(schema: T.StructType) -> list[Column]:
    """Columns that set operations can compare: maps become sorted entry arrays."""
    return [(F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")).alias(f.name) for f in schema]


def _back(schema: T.StructType) -> list[Column]:
    return [(F.map_from_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")).alias(f.name) for f in schema]


def row_changes(table: Table, start: int | None, end: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Changed rows with a ``change`` column: insert, delete, and with keys (default: the identifiers) update.

    An update carries the new row.  Both sides are read under the current
    schema.  Duplicate rows count: the result has as many changes as copies
    came or went.
    """
    a, b = _tasks(table, start), _tasks(table, _end(table, end))
    deletes = lambda t: {e.file.path for e in t.deletes}
    differ = {p for p in a.keys() | b.keys() if p not in a or p not in b or deletes(a[p]) != deletes(b[p])}
    schema = table.schema.spark()
    read = lambda side: scan.to_frame(table.spark, table.metadata, [t for p, t in side.items() if p in differ], table.schema).select(*_comparable(schema))
    before, after = read(a), read(b)
    gone = before.exceptAll(after).withColumn("change", F.lit(DELETE))
    new = after.exceptAll(before).withColumn("change", F.lit(INSERT))
    found = new.unionByName(gone)
    keys = keys or table.schema.identifiers
    if keys:
        both = Window.partitionBy(*keys)
        paired = (F.count_if(F.col("change") == INSERT).over(both) > 0) & (F.count_if(F.col("change") == DELETE).over(both) > 0)
        found = found.withColumn("__paired", paired).where("NOT (__paired AND change = 'delete')")
        found = found.withColumn("change", F.when(F.col("__paired"), UPDATE).otherwise(F.col("change"))).drop("__paired")
    return found.select("change", *_back(schema))


def _checkpoint(table: Table, name: str) -> str:
    if not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"no name for a checkpoint: {name!r}")
    return f"{table.location}/checkpoints/{name}.json"


def save_checkpoint(table: Table, name: str, snapshot_id: int | None = None) -> None:
    """Remembers a snapshot (default: the current one) under a name."""
    at = _end(table, snapshot_id)
    storage.write_over(_checkpoint(table, name), json.dumps({"name": name, "snapshot-id": at, "sequence-number": table.metadata.snapshot(at).sequence if at is not None else 0}))


def load_checkpoint(table: Table, name: str) -> int | None:
    """The remembered snapshot id; FileNotFoundError if there is no such checkpoint."""
    path = _checkpoint(table, name)
    if not storage.exists(path):
        raise FileNotFoundError(path)
    return json.loads(storage.read_text(path))["snapshot-id"]
