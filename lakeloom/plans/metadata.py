"""Table state: metadata, snapshots, manifest lists and manifests, all JSON.

A commit writes manifests, then a manifest list, then the next metadata file.
Files are immutable; a snapshot lists the manifests that are live in it, so an
append writes one small manifest whatever the size of the table.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache

from ..errors import SchemaNotFound, SnapshotNotFound
from ..sources import storage
from .partition import PartitionSpec
from .schema import Schema

FORMAT_VERSION = 1
OPERATIONS = ("append", "overwrite", "delete", "replace")
DATA, POSITION_DELETES, EQUALITY_DELETES = "data", "position-deletes", "equality-deletes"
EXISTING, ADDED, DELETED = "existing", "added", "deleted"


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass(frozen=True)
class DataFile:
    """One Parquet file and what is known about its columns, by field id."""

    path: str
    record_count: int
    file_size: int
    content: str = DATA
    format: str = "parquet"
    spec_id: int = 0
    partition: dict[str, object] = field(default_factory=dict)  # partition field id -> value
    value_counts: dict[str, int] = field(default_factory=dict)
    null_counts: dict[str, int] = field(default_factory=dict)
    nan_counts: dict[str, int] = field(default_factory=dict)
    column_sizes: dict[str, int] = field(default_factory=dict)
    lower: dict[str, object] = field(default_factory=dict)
    upper: dict[str, object] = field(default_factory=dict)
    equality_ids: tuple[int, ...] = ()
    targets: tuple[str, ...] = ()  # data files that a position-delete file names
    sort_order_id: int | None = None
    key_metadata: str | None = None
    split_offsets: tuple[int, ...] = ()

    def to_json(self) -> dict:
        return {k.replace("_", "-"): v for k, v in asdict(self).items() if v not in (None, {}, (), [])}

    @classmethod
    def from_json(cls, j: dict) -> DataFile:
        got = {k.replace("-", "_"): v for k, v in j.items()}
        for k in ("equality_ids", "targets", "split_offsets"):
            got[k] = tuple(got.get(k, ()))
        return cls(**got)


@dataclass(frozen=True)
class Entry:
    """A file in a manifest; its sequence number orders it against deletes."""

    status: str
    snapshot_id: int
    sequence: int
    file: DataFile

    def to_json(self) -> dict:
        return {"status": self.status, "snapshot-id": self.snapshot_id, "sequence-number": self.sequence, "data-file": self.file.to_json()}

    @classmethod
    def from_json(cls, j: dict) -> Entry:
        return cls(j["status"], j["snapshot-id"], j["sequence-number"], DataFile.from_json(j["data-file"]))


@dataclass(frozen=True)
class ManifestRef:
    """A manifest as its list names it."""

    path: str
    content: str  # data or deletes
    sequence: int
    snapshot_id: int
    added: int = 0
    existing: int = 0
    deleted: int = 0
    rows: int = 0

    def to_json(self) -> dict:
        return {k.replace("_", "-"): v for k, v in asdict(self).items()}

    @classmethod
    def from_json(cls, j: dict) -> ManifestRef:
        return cls(**{k.replace("-", "_"): v for k, v in j.items()})


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    parent_id: int | None
    sequence: int
    timestamp_ms: int
    operation: str
    manifest_list: str
    summary: dict[str, str]
    schema_id: int

    def to_json(self) -> dict:
        return {k.replace("_", "-"): v for k, v in asdict(self).items()}

    @classmethod
    def from_json(cls, j: dict) -> Snapshot:
        return cls(**{k.replace("-", "_"): v for k, v in j.items()})

    def count(self, key: str) -> int:
        """A number of the summary, e.g. ``added-records`` or ``total-data-files``; 0 if absent."""
        return int(self.summary.get(key, 0))

    def manifests(self) -> list[ManifestRef]:
        return read_list(self.manifest_list)

    def entries(self) -> list[Entry]:
        """Live files, data and deletes."""
        return [e for ref in self.manifests() for e in read_manifest(ref.path) if e.status != DELETED]

    def data_files(self) -> list[Entry]:
        return [e for e in self.entries() if e.file.content == DATA]

    def delete_files(self) -> list[Entry]:
        return [e for e in self.entries() if e.file.content != DATA]


@lru_cache(maxsize=512)
def read_manifest(path: str) -> tuple[Entry, ...]:
    """Manifests never change, so they are kept by path."""
    return tuple(Entry.from_json(json.loads(line)) for line in storage.read_text(path).splitlines() if line)


@lru_cache(maxsize=512)
def _list(path: str) -> tuple[ManifestRef, ...]:
    return tuple(ManifestRef.from_json(j) for j in json.loads(storage.read_text(path))["manifests"])


def read_list(path: str) -> list[ManifestRef]:
    return list(_list(path))


def write_manifest(location: str, entries: list[Entry], content: str, sequence: int, snapshot_id: int) -> ManifestRef:
    path = f"{location}/metadata/manifest-{uuid.uuid4().hex}.json"
    storage.write_new(path, "".join(json.dumps(e.to_json()) + "\n" for e in entries))
    count = {s: sum(e.status == s for e in entries) for s in (ADDED, EXISTING, DELETED)}
    rows = sum(e.file.record_count for e in entries if e.status != DELETED)
    return ManifestRef(path, content, sequence, snapshot_id, count[ADDED], count[EXISTING], count[DELETED], rows)


def write_list(location: str, snapshot_id: int, refs: list[ManifestRef]) -> str:
    path = f"{location}/metadata/snap-{snapshot_id}-{uuid.uuid4().hex}.json"
    storage.write_new(path, json.dumps({"snapshot-id": snapshot_id, "manifests": [r.to_json() for r in refs]}))
    return path


@dataclass(frozen=True)
class TableMetadata:
    location: str
    table_uuid: str
    schemas: tuple[Schema, ...]
    current_schema_id: int = 0
    specs: tuple[PartitionSpec, ...] = (PartitionSpec(),)
    default_spec_id: int = 0
    last_column_id: int = 0
    last_sequence: int = 0
    last_updated_ms: int = 0
    snapshots: tuple[Snapshot, ...] = ()
    current_snapshot_id: int | None = None
    snapshot_log: tuple[tuple[int, int, str], ...] = ()  # (snapshot id, timestamp, operation)
    properties: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, int] = field(default_factory=lambda: {"total-records": 0, "total-files": 0, "total-bytes": 0})

    @classmethod
    def new(cls, location: str, schema: Schema, spec: PartitionSpec | None = None, properties: dict[str, str] | None = None) -> TableMetadata:
        return cls(location, str(uuid.uuid4()), (schema,), schema.schema_id, (spec or PartitionSpec(),), (spec or PartitionSpec()).spec_id, schema.highest_id(), last_updated_ms=now_ms(), properties=dict(properties or {}))

    def to_json(self) -> dict:
        return {
            "format-version": FORMAT_VERSION,
            "table-uuid": self.table_uuid,
            "location": self.location,
            "last-sequence-number": self.last_sequence,
            "last-updated-ms": self.last_updated_ms,
            "last-column-id": self.last_column_id,
            "schemas": [s.to_json() for s in self.schemas],
            "current-schema-id": self.current_schema_id,
            "partition-specs": [s.to_json() for s in self.specs],
            "default-spec-id": self.default_spec_id,
            "snapshots": [s.to_json() for s in self.snapshots],
            "current-snapshot-id": self.current_snapshot_id,
            "snapshot-log": [{"snapshot-id": i, "timestamp-ms": t, "operation": o} for i, t, o in self.snapshot_log],
            "properties": self.properties,
            "metrics": self.metrics,
        }

    @classmethod
    def from_json(cls, j: dict) -> TableMetadata:
        return cls(
            j["location"],
            j["table-uuid"],
            tuple(map(Schema.from_json, j["schemas"])),
            j["current-schema-id"],
            tuple(map(PartitionSpec.from_json, j["partition-specs"])),
            j["default-spec-id"],
            j["last-column-id"],
            j["last-sequence-number"],
            j["last-updated-ms"],
            tuple(map(Snapshot.from_json, j["snapshots"])),
            j["current-snapshot-id"],
            tuple((x["snapshot-id"], x["timestamp-ms"], x["operation"]) for x in j["snapshot-log"]),
            j["properties"],
            j["metrics"],
        )

    def schema(self, schema_id: int | None = None) -> Schema:
        want = self.current_schema_id if schema_id is None else schema_id
        for s in self.schemas:
            if s.schema_id == want:
                return s
        raise SchemaNotFound(f"no schema {want}")

    def spec(self, spec_id: int | None = None) -> PartitionSpec:
        want = self.default_spec_id if spec_id is None else spec_id
        return next(s for s in self.specs if s.spec_id == want)

    def snapshot(self, snapshot_id: int | None = None) -> Snapshot | None:
        """The snapshot of that id, which must exist, or the current one, if any."""
        want = self.current_snapshot_id if snapshot_id is None else snapshot_id
        if want is None:
            return None
        for s in self.snapshots:
            if s.snapshot_id == want:
                return s
        raise SnapshotNotFound(f"no snapshot {want}")

    def snapshot_at(self, timestamp_ms: int) -> Snapshot:
        """What was current at a time, by the log, so rollbacks count."""
        ids = [i for i, t, _ in self.snapshot_log if t <= timestamp_ms]
        if not ids:
            raise SnapshotNotFound(f"no snapshot at or before {timestamp_ms}")
        return self.snapshot(ids[-1])

    def with_schema(self, schema: Schema, last_column_id: int) -> TableMetadata:
        return replace(self, schemas=(*self.schemas, schema), current_schema_id=schema.schema_id, last_column_id=max(last_column_id, self.last_column_id))

    def with_spec(self, spec: PartitionSpec) -> TableMetadata:
        return replace(self, specs=(*self.specs, spec), default_spec_id=spec.spec_id)

    @property
    def next_schema_id(self) -> int:
        return max(s.schema_id for s in self.schemas) + 1

    @property
    def next_spec_id(self) -> int:
        return max(s.spec_id for s in self.specs) + 1


def metrics_of(entries: list[Entry]) -> dict[str, int]:
    """Exact totals; records are those of data files, before deletes."""
    data = [e.file for e in entries if e.file.content == DATA]
    return {"total-records": sum(f.record_count for f in data), "total-files": len(entries), "total-bytes": sum(e.file.file_size for e in entries)}


def totals_of(meta: TableMetadata, snapshot: Snapshot | None) -> dict[str, int]:
    """Totals of the current state from metadata alone: the table's metrics, and the data files of the snapshot's summary."""
    if snapshot is None:
        return {"total-records": 0, "total-files": 0, "total-bytes": 0, "total-data-files": 0}
    if "total-data-files" not in snapshot.summary:
        entries = snapshot.entries()
        return metrics_of(entries) | {"total-data-files": sum(e.file.content == DATA for e in entries)}
    return meta.metrics | {"total-data-files": snapshot.count("total-data-files")}
