"""The table facade: create, open, read, change, travel in time, evolve, maintain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NoChanges, ReadOnlyTable, TableAlreadyExists
from .operators import cdc, dml, maintenance, stats
from .plans import metadata as M
from .plans import predicates, pushdown, scan
from .plans.partition import FIRST_FIELD_ID, PartitionSpec, SpecBuilder
from .plans.schema import Schema, SchemaUpdate
from .plans.transaction import RetryConfig, Transaction
from .session import configure_spark
from .sources import storage, writer
from .sources.catalog import VersionStore

if TYPE_CHECKING:
    from .sources.catalog import TableIdentifier


def _millis(when: int | str | dt.datetime) -> int:
    if isinstance(when, int):
        return when
    t = dt.datetime.fromisoformat(when) if isinstance(when, str) else when
    return int((t if t.tzinfo else t.replace(tzinfo=dt.UTC)).timestamp() * 1000)


class Table:
    """A snapshot table.  ``scan()`` is an ordinary lazy DataFrame; everything else is driver-side metadata."""

    def __init__(self, spark: SparkSession, store: VersionStore, metadata: M.TableMetadata, snapshot_id: int | None = None):
        self.spark, self.store, self.metadata = spark, store, metadata
        self.read_only = snapshot_id is not None
        self._snapshot_id = snapshot_id
        self.identifier: TableIdentifier | None = None

    # --- state -----------------------------------------------------------------
    @property
    def location(self) -> str:
        return self.metadata.location

    @property
    def snapshot(self) -> M.Snapshot | None:
        return self.metadata.snapshot(self._snapshot_id)

    @property
    def schema(self) -> Schema:
        """The current schema, or that of the snapshot a view is fixed to."""
        return self.metadata.schema(self.snapshot.schema_id if self.read_only else None)

    @property
    def uuid(self) -> str:
        return self.metadata.table_uuid

    @property
    def properties(self) -> dict[str, str]:
        return dict(self.metadata.properties)

    @property
    def spec(self) -> PartitionSpec:
        return self.metadata.spec()

    @property
    def metrics(self) -> dict[str, int]:
        return dict(self.metadata.metrics)

    def refresh(self) -> Table:
        _, self.metadata = self.store.load()
        return self

    def snapshot_ids(self) -> list[int]:
        return [s.snapshot_id for s in self.metadata.snapshots]

    def snapshot_count(self) -> int:
        return len(self.metadata.snapshots)

    def __repr__(self) -> str:
        return f"Table({self.identifier or self.location}, snapshot={self.snapshot and self.snapshot.snapshot_id}, fields={self.schema.names})"

    # --- reading ---------------------------------------------------------------
    def plan(self, condition=None) -> list[scan.ScanTask]:
        """The files a scan with this condition reads, after pruning; a Column or SQL of any form prunes by what Catalyst makes of it."""
        tasks = scan.plan(self.metadata, self.snapshot, self.schema, condition)
        if condition is None or isinstance(condition, list) or not tasks or predicates.pruning_triples(condition):
            return tasks
        return pushdown.pruned(self.metadata, tasks, self.schema, self.frame(tasks).where(predicates.column_of(condition)))

    def scan(self, columns: list[str] | None = None, condition: str | Column | list[predicates.Triple] | None = None, limit: int | None = None) -> DataFrame:
        """The table's rows.  The condition prunes files and is applied to the rows; later filters still reach the Parquet scan."""
        df = self.frame(self.plan(condition))
        if condition is not None:
            df = df.where(predicates.column_of(condition))
        if columns is not None:
            df = df.select(*(F.col(c) for c in columns))
        return df if limit is None else df.limit(limit)

    def at_snapshot(self, snapshot_id: int) -> Table:
        """A read-only view of a snapshot, with its schema."""
        self.metadata.snapshot(snapshot_id)
        return Table(self.spark, self.store, self.metadata, snapshot_id)

    def as_of(self, when: int | str | dt.datetime) -> Table:
        """A read-only view of what was current at a time (milliseconds, ISO text in UTC, or datetime)."""
        return self.at_snapshot(self.metadata.snapshot_at(_millis(when)).snapshot_id)

    snapshot_at = as_of

    def create_view(self, name: str) -> Table:
        """Registers the rows as a temporary view for Spark SQL."""
        self.scan().createOrReplaceTempView(name)
        return self

    def sql(self, query: str, name: str = "table") -> DataFrame:
        """Runs SQL with this table's rows as ``{name}``; the filters that Catalyst pushes down to them prune files."""
        return self.over(lambda rows: self.spark.sql(query, **{name: rows}))

    def over(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What a function makes of the table's rows, from the files alone that its pushed-down filters leave."""
        tasks = self.plan()
        df = build(self.frame(tasks))
        kept = pushdown.pruned(self.metadata, tasks, self.schema, df)
        return build(self.frame(kept)) if len(kept) < len(tasks) else df

    def frame(self, tasks: list[scan.ScanTask]) -> DataFrame:
        """The rows of some of the table's files."""
        return scan.to_frame(self.spark, self.metadata, tasks, self.schema)

    def to_spark(self) -> DataFrame:
        return self.scan()

    def to_arrow(self):
        return self.scan().toArrow()

    def to_pandas(self):
        return self.scan().toPandas()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_arrow())

    def to_duckdb(self, connection=None):
        import duckdb

        return (connection or duckdb.connect()).from_arrow(self.to_arrow())

    # --- metadata tables ---------------------------------------------------------
    def history(self) -> DataFrame:
        return self.spark.createDataFrame([(i, dt.datetime.fromtimestamp(t / 1000, dt.UTC), o, self._records(i)) for i, t, o in self.metadata.snapshot_log], "snapshot_id long, made_at timestamp, operation string, total_records long")

    def _records(self, snapshot_id: int) -> int | None:
        return next((s.count("total-records") for s in self.metadata.snapshots if s.snapshot_id == snapshot_id), None)

    def snapshots(self) -> DataFrame:
        rows = [(s.snapshot_id, s.parent_id, s.sequence, s.timestamp_ms, s.operation, s.manifest_list, s.schema_id, s.summary) for s in self.metadata.snapshots]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence long, timestamp_ms long, operation string, manifest_list string, schema_id int, summary map<string,string>")

    def manifests(self) -> DataFrame:
        rows = [(r.path, r.content, r.sequence, r.snapshot_id, r.added, r.existing, r.deleted, r.rows) for r in (self.snapshot.manifests() if self.snapshot else [])]
        return self.spark.createDataFrame(rows, "path string, content string, sequence long, snapshot_id long, added int, existing int, deleted int, rows long")

    def files(self) -> DataFrame:
        rows = []
        for e in self.snapshot.entries() if self.snapshot else []:
            f = e.file
            text = lambda m: {int(k): str(v) for k, v in m.items()}
            number = lambda m: {int(k): int(v) for k, v in m.items()}
            rows.append((f.path, f.content, f.spec_id, text(f.partition), f.record_count, f.file_size, number(f.value_counts), number(f.null_counts), text(f.lower), text(f.upper), list(f.equality_ids), e.sequence, e.snapshot_id))
        return self.spark.createDataFrame(rows, "path string, content string, spec_id int, partition map<int,string>, record_count long, file_size long, value_counts map<int,long>, null_counts map<int,long>, lower map<int,string>, upper map<int,string>, equality_ids array<int>, sequence long, snapshot_id long")

    def column_stats(self) -> DataFrame:
        return stats.column_stats(self)

    # --- writing -----------------------------------------------------------------
    def write_files(self, df: DataFrame) -> list[M.DataFile]:
        """Writes rows under the current schema and spec without committing them."""
        if self.read_only:
            raise ReadOnlyTable("a time-travel view cannot be written to")
        bloom = {k.removeprefix("write.bloom.ndv."): int(v) for k, v in self.metadata.properties.items() if k.startswith("write.bloom.ndv.")}
        return writer.write_data(df, self.schema, self.spec, self.location, bloom)

    def new_transaction(self, operation: str = "append") -> Transaction:
        return Transaction(self, operation)

    def _commit(self, tx: Transaction, retry: RetryConfig | None = None) -> int:
        """Commits unless there is nothing to; returns the number of rows changed."""
        if tx.has_changes:
            tx.commit(retry)
        return tx.affected

    def append(self, df: DataFrame, summary: dict[str, str] | None = None) -> M.Snapshot | None:
        """Adds rows in one snapshot; no row, no snapshot."""
        files = self.write_files(df)
        if not files:
            return self.snapshot
        tx = Transaction(self, "append", files, summary=dict(summary or {}))
        return tx.commit()

    def overwrite(self, df: DataFrame, condition: str | Column | list | None = None, dynamic: bool = False) -> M.Snapshot | None:
        """Replaces all rows, those that a condition selects, or (``dynamic``) the partitions that the new rows fall into."""
        tx = Transaction(self, "overwrite")
        files = self.write_files(df)
        tasks = self.plan()
        if condition is not None:
            gone = dml.delete(self, condition)
            tx.delete_files(gone.removed).add_files(gone.added)
        elif dynamic:
            hit = {(f.spec_id, tuple(sorted(f.partition.items()))) for f in files}
            tx.delete_files(t.data.file.path for t in tasks if (t.data.file.spec_id, tuple(sorted(t.data.file.partition.items()))) in hit)
        else:
            tx.delete_files(t.data.file.path for t in tasks)
            tx.delete_files(e.file.path for e in (self.snapshot.delete_files() if self.snapshot else []))
        tx.add_files(files)
        return tx.commit() if tx.has_changes else self.snapshot

    def truncate(self) -> M.Snapshot | None:
        tx = Transaction(self, "delete").delete_files(e.file.path for e in (self.snapshot.entries() if self.snapshot else []))
        return tx.commit() if tx.has_changes else self.snapshot

    def delete(self, condition: str | Column | list, strategy: str = dml.COPY_ON_WRITE, keys: list[str] | None = None) -> int:
        return self._commit(dml.delete(self, condition, strategy, keys))

    def update(self, condition: str | Column | list, assignments: dml.Assignment, strategy: str = dml.COPY_ON_WRITE) -> int:
        return self._commit(dml.update(self, condition, assignments, strategy))

    def merge(self, source: DataFrame, on: Column | str | list[str] | None = None, strategy: str = dml.COPY_ON_WRITE) -> dml.MergeBuilder:
        """A builder; its ``execute()`` gives a transaction to commit, ``Table.run`` does both."""
        return dml.MergeBuilder(self, source, on, strategy)

    def run(self, builder: dml.MergeBuilder) -> int:
        return self._commit(builder.execute())

    def upsert(self, source: DataFrame, keys: list[str] | None = None, strategy: str = dml.COPY_ON_WRITE) -> int:
        return self._commit(dml.upsert(self, source, keys, strategy))

    def rollback_to(self, snapshot_id: int) -> Table:
        """Makes an earlier snapshot current; history keeps what came after it."""
        self.metadata.snapshot(snapshot_id)
        Transaction(self, "replace", rollback_to=snapshot_id).commit()
        return self

    # --- evolution -----------------------------------------------------------------
    def update_schema(self) -> SchemaUpdate:
        return SchemaUpdate(self.metadata.schema(), self.metadata.last_column_id)

    def evolve(self, update: SchemaUpdate) -> Table:
        """Commits a schema update as a new schema version; no file is rewritten."""
        if not update.changes:
            raise NoChanges("the schema update is empty")
        schema = update.apply(self.metadata.next_schema_id)
        Transaction(self, "replace").set_schema(schema, update.last_id).commit()
        return self

    def add_column(self, name: str, kind: dict, parent: str | None = None, doc: str | None = None) -> Table:
        return self.evolve(self.update_schema().add_column(name, kind, parent, doc))

    def drop_column(self, key: int | str) -> Table:
        return self.evolve(self.update_schema().drop_column(key))

    def rename_column(self, key: int | str, name: str) -> Table:
        return self.evolve(self.update_schema().rename_column(key, name))

    def widen_column(self, key: int | str, kind: dict) -> Table:
        return self.evolve(self.update_schema().widen_type(key, kind))

    def make_optional(self, key: int | str) -> Table:
        return self.evolve(self.update_schema().make_optional(key))

    def new_spec(self) -> SpecBuilder:
        last = max([FIRST_FIELD_ID - 1, *(f.field_id for s in self.metadata.specs for f in s.fields)])
        return SpecBuilder(self.schema, self.metadata.next_spec_id, last + 1)

    def set_spec(self, spec: PartitionSpec) -> Table:
        """New files follow the spec; old ones keep theirs."""
        Transaction(self, "replace").set_spec(spec).commit()
        return self

    def set_properties(self, **properties: str) -> Table:
        Transaction(self, "replace", properties={k.replace("__", "."): str(v) for k, v in properties.items()}).commit()
        return self

    # --- maintenance, changes --------------------------------------------------------
    def compact(self, **options: Any) -> maintenance.CompactResult:
        return maintenance.compact(self, **options)

    def expire_snapshots(self, older_than_ms: int | None = None, retain_last: int = 1, now_ms: int | None = None) -> list[int]:
        return maintenance.expire_snapshots(self, older_than_ms, retain_last, now_ms)

    def remove_orphans(self, older_than_ms: int = 3 * 86_400_000, dry_run: bool = False) -> list[str]:
        return maintenance.remove_orphans(self, older_than_ms, dry_run)

    def vacuum(self, retain_hours: float = maintenance.RETAIN_HOURS) -> dict[str, int]:
        return maintenance.vacuum(self, retain_hours)

    def file_changes(self, start: int | None, end: int | None = None) -> DataFrame:
        return cdc.file_changes(self, start, end)

    def changes(self, start: int | None, end: int | None = None, keys: list[str] | None = None) -> DataFrame:
        return cdc.row_changes(self, start, end, keys)

    changes_since = changes

    def save_checkpoint(self, name: str, snapshot_id: int | None = None) -> None:
        cdc.save_checkpoint(self, name, snapshot_id)

    def load_checkpoint(self, name: str) -> int | None:
        return cdc.load_checkpoint(self, name)

    def changes_since_checkpoint(self, name: str, keys: list[str] | None = None) -> DataFrame:
        return cdc.row_changes(self, cdc.load_checkpoint(self, name), None, keys)


def create_table(
    spark: SparkSession,
    location: str,
    schema: Schema | T.StructType,
    spec: PartitionSpec | None = None,
    properties: dict[str, str] | None = None,
    partition_by: list[str | tuple[str, str]] | None = None,
) -> Table:
    """Creates an empty table.  ``partition_by`` lists columns or (column, transform) pairs."""
    configure_spark(spark)
    location = storage.normalise(location)
    own = Schema.of(schema) if isinstance(schema, T.StructType) else schema
    if partition_by:
        builder = SpecBuilder(own)
        for p in partition_by:
            builder.add(*((p, "identity") if isinstance(p, str) else p))
        spec = builder.build()
    store = VersionStore(location)
    if store.version() is not None or not store.create(0, meta := M.TableMetadata.new(location, own, spec, properties)):
        raise TableAlreadyExists(location)
    return Table(spark, store, meta)


def open_table(spark: SparkSession, location: str) -> Table:
    """Opens a table at its newest version."""
    configure_spark(spark)
    store = VersionStore(location)
    _, meta = store.load()
    return Table(spark, store, meta)
