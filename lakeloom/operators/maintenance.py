"""Layout and clean-up: compaction (bin-pack, sort, z-order), snapshot expiry, orphan removal, vacuum."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from ..functions import transforms
from ..plans import metadata as M
from ..plans import scan
from ..plans.transaction import Transaction
from ..sources import storage, writer

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from ..table import Table

TARGET_SIZE, MIN_FILES, RETAIN_HOURS = 128 << 20, 5, 168
Z = "__lakeloom_z"


@dataclass(frozen=True)
class CompactResult:
    files_before: int = 0
    files_after: int = 0
    rows: int = 0


def needs_compaction(table: Table, target_size: int = TARGET_SIZE, min_files: int = MIN_FILES) -> bool:
    """Whether some partition has enough small files, or files with deletes, to be worth a rewrite."""
    return bool(_groups(table, target_size, min_files, None, False))


def _groups(table: Table, target_size: int, min_files: int, condition, everything: bool) -> list[list[scan.ScanTask]]:
    by_partition: dict[tuple, list[scan.ScanTask]] = {}
    for t in table.plan(condition):
        f = t.data.file
        if everything or f.file_size < target_size or t.deletes:
            by_partition.setdefault((f.spec_id, tuple(sorted(f.partition.items(), key=str))), []).append(t)
    return [g for g in by_partition.values() if everything or len(g) >= min_files or any(t.deletes for t in g)]


def compact(
    table: Table,
    strategy: str = "binpack",
    columns: list[str] | None = None,
    target_size: int = TARGET_SIZE,
    min_files: int = MIN_FILES,
    condition: str | list | None = None,
) -> CompactResult:
    """Rewrites small files, and files with deletes, into files of about ``target_size``.

    ``binpack`` merges within partitions; ``sort`` and ``zorder`` rewrite every
    file that the condition selects, ordered by ``columns``.  A condition selects
    files, not rows.  Rows keep the age of the newest file they come from, so
    deletes that are committed meanwhile still reach them.
    """
    if strategy not in ("binpack", "sort", "zorder"):
        raise ValueError(f"no such strategy: {strategy}")
    if strategy != "binpack" and not columns:
        raise ValueError(f"{strategy} needs columns")
    groups = _groups(table, target_size, min_files, condition, strategy != "binpack")
    tasks = [t for g in groups for t in g]
    if not tasks:
        return CompactResult()
    rows = scan.to_frame(table.spark, table.metadata, tasks, table.schema)
    size = sum(t.data.file.file_size for t in tasks)
    n = max(1, -(-size // target_size))
    files = _rewrite(table, rows, strategy, columns or [], n)
    tx = Transaction(table, "replace", files, data_sequence=table.metadata.last_sequence)
    removed = {t.data.file.path for t in tasks}
    tx.delete_files(removed)
    uris = {storage.file_uri(p) for p in removed}
    left = [e for e in table.snapshot.data_files() if e.file.path not in removed]
    for e in table.snapshot.delete_files():
        if e.file.targets and set(e.file.targets) <= uris or e.file.equality_ids and not any(d.sequence < e.sequence for d in left):
            tx.delete_files([e.file.path])
    tx.set_summary(strategy=strategy)
    tx.commit()
    return CompactResult(len(tasks), len(files), sum(f.record_count for f in files))


def _rewrite(table: Table, rows: DataFrame, strategy: str, columns: list[str], n: int) -> list[M.DataFile]:
    """Writes rows in a layout.  A partitioned table is rebalanced by its partition values, so its rows are ordered after that."""
    if strategy == "binpack":
        rows = rows if table.spec.fields else rows.repartition(n)
        return writer.write_data(rows, table.schema, table.spec, table.location)
    order = columns
    if strategy == "zorder":
        rows, order = transforms.with_z_value(rows, columns, Z), [Z]
    if not table.spec.fields:
        rows = rows.repartitionByRange(n, *order)
    return writer.write_data(rows, table.schema, table.spec, table.location, order=order)


def expire_snapshots(table: Table, older_than_ms: int | None = None, retain_last: int = 1, now_ms: int | None = None) -> list[int]:
    """Forgets snapshots older than an age; returns their ids.

    Newest first, a snapshot goes if it is too old and at least ``retain_last``
    snapshots (the current one included) stay.  The current one always stays.
    Without an age nothing expires.  Files are left to ``remove_orphans``.
    """
    if older_than_ms is None:
        return []
    now = M.now_ms() if now_ms is None else now_ms
    current = table.metadata.current_snapshot_id
    kept, gone = 1 if current is not None else 0, []
    for s in sorted(table.metadata.snapshots, key=lambda s: (-s.timestamp_ms, -s.snapshot_id)):
        if s.snapshot_id == current:
            continue
        if now - s.timestamp_ms > older_than_ms and kept >= retain_last:
            gone.append(s.snapshot_id)
        else:
            kept += 1
    if gone:
        Transaction(table, "replace", drop_snapshots=set(gone)).commit()
    return sorted(gone)


def reachable(table: Table) -> set[str]:
    """Every file that some snapshot needs."""
    out = set()
    for s in table.metadata.snapshots:
        out.add(storage.normalise(s.manifest_list))
        for ref in s.manifests():
            out.add(storage.normalise(ref.path))
            out |= {storage.normalise(e.file.path) for e in M.read_manifest(ref.path) if e.status != M.DELETED}
    return out


def _companion(path: str, needed: set[str], folders: set[str]) -> bool:
    """Whether a file is a checksum of a needed file, or a marker in a folder that holds one."""
    folder, _, name = path.rpartition("/")
    if name.startswith(".") and name.endswith(".crc"):
        return f"{folder}/{name[1:-4]}" in needed or name == "._SUCCESS.crc" and folder in folders
    return name == "_SUCCESS" and any(f == folder or f.startswith(folder + "/") for f in folders)


def remove_orphans(table: Table, older_than_ms: int = 3 * 86_400_000, dry_run: bool = False) -> list[str]:
    """Removes files below the location that no snapshot needs and that are older than an age.

    Version files, the version hint and checkpoints always stay; the age guards
    commits and lazy reads that are under way.
    """
    table.refresh()
    needed, now, out = reachable(table), M.now_ms(), []
    folders = {p.rsplit("/", 1)[0] for p in needed}
    for path, _, modified in storage.list_files(table.location):
        own = storage.normalise(path)
        rest = own.removeprefix(table.location + "/")
        if rest.startswith("checkpoints/") or rest.startswith("metadata/v") or own in needed or _companion(own, needed, folders):
            continue
        if now - modified >= older_than_ms:
            out.append(own)
            if not dry_run:
                storage.delete(own)
    return sorted(out)


def vacuum(table: Table, retain_hours: float = RETAIN_HOURS) -> dict[str, int]:
    """Expires snapshots older than the retention and removes files that are no longer needed and as old."""
    age = int(retain_hours * 3_600_000)
    expired = expire_snapshots(table, age)
    removed = remove_orphans(table, age)
    return {"expired_snapshots": len(expired), "removed_files": sum(p.endswith(".parquet") for p in removed)}


def estimate(table: Table) -> dict[str, int]:
    """Files, small files and files with deletes, for a scheduler's threshold."""
    tasks = table.plan()
    return {"files": len(tasks), "small_files": sum(t.data.file.file_size < TARGET_SIZE for t in tasks), "files_with_deletes": sum(bool(t.deletes) for t in tasks)}
