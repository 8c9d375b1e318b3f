"""Optimistic transactions: changes are collected, then one exclusive create decides.

The next metadata version is created only if nobody has created it.  A loser
reloads and tries again: an append simply moves on to the newer state; a commit
that removes files, or adds position deletes for files, first checks that those
files are still live, else it is a CommitConflict.
"""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from ..errors import CommitConflict, MaxRetriesExceeded, NoChanges, ReadOnlyTable
from ..sources import storage
from . import metadata as M
from .partition import PartitionSpec
from .schema import Schema, check_compatible

if TYPE_CHECKING:
    from ..table import Table


@dataclass(frozen=True)
class RetryConfig:
    attempts: int = 5
    initial_ms: int = 100
    maximum_ms: int = 10_000
    multiplier: float = 2.0

    def backoff_ms(self, attempt: int) -> int:
        """Wait before an attempt: 0 for the first, then growing up to the maximum."""
        if attempt <= 0:
            return 0
        return int(min(self.initial_ms * self.multiplier ** (attempt - 1), self.maximum_ms))


@dataclass
class Transaction:
    """Files to add and to remove against the state that ``table`` was loaded with."""

    table: Table
    operation: str = "append"
    added: list[M.DataFile] = field(default_factory=list)
    removed: set[str] = field(default_factory=set)
    summary: dict[str, str] = field(default_factory=dict)
    schema: tuple[Schema, int] | None = None
    spec: PartitionSpec | None = None
    properties: dict[str, str] | None = None
    rollback_to: int | None = None
    drop_snapshots: set[int] = field(default_factory=set)
    data_sequence: int | None = None  # added data files count as this old: compaction keeps what later deletes may reach
    exclusive: bool = False  # any other commit in between is a conflict
    affected: int = 0  # rows that the statement changed

    def __post_init__(self) -> None:
        if self.table.read_only:
            raise ReadOnlyTable("a time-travel view cannot be written to")
        self.base = self.table.metadata

    def add_files(self, files: list[M.DataFile]) -> Transaction:
        self.added += files
        return self

    def delete_files(self, paths) -> Transaction:
        self.removed |= set(paths)
        return self

    def set_schema(self, schema: Schema, last_id: int) -> Transaction:
        check_compatible(self.base.schema(), schema)
        self.schema = (schema, last_id)
        return self

    def set_spec(self, spec: PartitionSpec) -> Transaction:
        self.spec = spec
        return self

    def set_summary(self, **values: str) -> Transaction:
        self.summary |= {k.replace("_", "-"): str(v) for k, v in values.items()}
        return self

    @property
    def changes_files(self) -> bool:
        return bool(self.added or self.removed)

    @property
    def has_changes(self) -> bool:
        return self.changes_files or any(x is not None for x in (self.schema, self.spec, self.properties, self.rollback_to)) or bool(self.drop_snapshots)

    def commit(self, retry: RetryConfig | None = None) -> M.Snapshot | None:
        """The new snapshot, or the current one if only metadata changed.  The table moves to the new state."""
        if not self.has_changes:
            raise NoChanges("the transaction is empty")
        retry = retry or RetryConfig()
        for attempt in range(retry.attempts):
            if wait := retry.backoff_ms(attempt):
                time.sleep(wait * random.uniform(0.5, 1.0) / 1000)
            version, latest = self.table.store.load()
            self._check(latest)
            prepared = self._apply(latest)
            if self.table.store.create(version + 1, prepared):
                self.table.metadata = prepared
                return prepared.snapshot()
        raise MaxRetriesExceeded(f"{retry.attempts} attempts lost against other commits")

    def _check(self, latest: M.TableMetadata) -> None:
        if latest.last_sequence == self.base.last_sequence:
            return
        if self.exclusive or self.rollback_to is not None:
            raise CommitConflict("the table has changed since it was loaded")
        if self.schema and latest.current_schema_id != self.base.current_schema_id:
            raise CommitConflict("the schema has changed since the table was loaded")
        if self.spec and latest.default_spec_id != self.base.default_spec_id:
            raise CommitConflict("the partition spec has changed since the table was loaded")
        if self.added and latest.current_schema_id != self.base.current_schema_id:
            check_compatible(self.base.schema(), latest.schema())
        targets = {t for f in self.added for t in f.targets}
        needed = self.removed | {storage.from_file_uri(t) for t in targets}
        if needed:
            snapshot = latest.snapshot()
            entries = snapshot.entries() if snapshot else []
            live = {e.file.path for e in entries}
            if gone := needed - live:
                raise CommitConflict(f"{len(gone)} files that this commit rests on are gone, e.g. {min(gone)}")
            # Rewritten rows would come back if a newer delete file has meanwhile removed some of them.
            rewritten = {storage.file_uri(p) for p in self.removed}
            for e in entries:
                if e.sequence > self.base.last_sequence and (rewritten & set(e.file.targets) or e.file.equality_ids and self.removed and self.data_sequence is None):
                    raise CommitConflict("rows of files that this commit rewrites have been deleted meanwhile")

    def _apply(self, latest: M.TableMetadata) -> M.TableMetadata:
        sequence, now = latest.last_sequence + 1, max(M.now_ms(), latest.last_updated_ms)
        meta = replace(latest, last_sequence=sequence, last_updated_ms=now)
        if self.schema:
            meta = meta.with_schema(*self.schema)
        if self.spec:
            meta = meta.with_spec(self.spec)
        if self.properties is not None:
            meta = replace(meta, properties=meta.properties | self.properties)
        if self.drop_snapshots:
            meta = replace(meta, snapshots=tuple(s for s in meta.snapshots if s.snapshot_id not in self.drop_snapshots), snapshot_log=tuple(x for x in meta.snapshot_log if x[0] not in self.drop_snapshots))
        if self.rollback_to is not None:
            target = meta.snapshot(self.rollback_to)
            meta = replace(meta, current_snapshot_id=target.snapshot_id, current_schema_id=target.schema_id, snapshot_log=(*meta.snapshot_log, (target.snapshot_id, now, "replace")), metrics=M.metrics_of(target.entries()))
        if not self.changes_files:
            return meta

        parent = latest.snapshot()
        refs, dropped, left = [], [], set(self.removed)
        for ref in parent.manifests() if parent else []:
            if not ref.added + ref.existing:
                continue
            # Manifests are read only until every removed file is found: an append reads none.
            live = [e for e in M.read_manifest(ref.path) if e.status != M.DELETED] if left else []
            hit = [e for e in live if e.file.path in left]
            if not hit:
                refs.append(ref)
                continue
            dropped += hit
            left -= {e.file.path for e in hit}
            changed = [replace(e, status=M.DELETED, snapshot_id=sequence) if e.file.path in self.removed else replace(e, status=M.EXISTING) for e in live]
            refs.append(M.write_manifest(latest.location, changed, ref.content, sequence, sequence))
        for content in ("data", "deletes"):
            own = [f for f in self.added if (f.content == M.DATA) == (content == "data")]
            if own:
                at = self.data_sequence if content == "data" and self.data_sequence is not None else sequence
                refs.append(M.write_manifest(latest.location, [M.Entry(M.ADDED, sequence, at, f) for f in own], content, sequence, sequence))
        listed = M.write_list(latest.location, sequence, refs)
        data = [f for f in self.added if f.content == M.DATA]
        gone = [e.file for e in dropped if e.file.content == M.DATA]
        before = M.totals_of(latest, parent)
        metrics = {
            "total-records": before["total-records"] + sum(f.record_count for f in data) - sum(f.record_count for f in gone),
            "total-files": before["total-files"] + len(self.added) - len(dropped),
            "total-bytes": before["total-bytes"] + sum(f.file_size for f in self.added) - sum(e.file.file_size for e in dropped),
        }
        data_files = before["total-data-files"] + len(data) - len(gone)
        summary = {
            "added-data-files": str(len(data)),
            "added-records": str(sum(f.record_count for f in data)),
            "added-files-size": str(sum(f.file_size for f in self.added)),
            "added-delete-files": str(len(self.added) - len(data)),
            "deleted-data-files": str(len(gone)),
            "deleted-records": str(sum(f.record_count for f in gone)),
            "total-records": str(metrics["total-records"]),
            "total-data-files": str(data_files),
            "total-delete-files": str(metrics["total-files"] - data_files),
        } | self.summary
        snapshot = M.Snapshot(sequence, parent.snapshot_id if parent else None, sequence, now, self.operation, listed, summary, meta.current_schema_id)
        return replace(meta, snapshots=(*meta.snapshots, snapshot), current_snapshot_id=sequence, snapshot_log=(*meta.snapshot_log, (sequence, now, self.operation)), metrics=metrics)
