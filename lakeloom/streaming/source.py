"""Structured Streaming over a table's changes: a Python stream source of commits, and row batches from it.

The source yields one small row per change of the table's state (sequence,
snapshot, what was current before it, operation); a rollback is one, too.  An
offset is a sequence number, which rises with every commit, and the snapshot
that was current then, so a reader goes on from the state that it has seen.
Rows themselves never pass through Python: each micro-batch turns its commits
into an ordinary DataFrame of changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.catalog import VersionStore

COMMITS = "lakeloom_commits"
SCHEMA = "sequence long, snapshot_id long, previous_id long, operation string"


class _Range(InputPartition):
    def __init__(self, commits: list[tuple]):
        self.commits = commits


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.location = options["location"]
        self.first = int(options.get("startsequence", 0))

    def _load(self):
        return VersionStore(self.location).load()[1]

    def _seen(self, meta, offset: dict) -> int | None:
        """The snapshot that was current at an offset; without a note, the newest one up to its sequence."""
        if "snapshot" in offset:
            return offset["snapshot"]
        return max((s.snapshot_id for s in meta.snapshots if s.sequence <= offset["sequence"]), default=None)

    def initialOffset(self) -> dict:
        at = {"sequence": self.first}
        return at | {"snapshot": self._seen(self._load(), at) if self.first else None}

    def latestOffset(self) -> dict:
        meta = self._load()
        return {"sequence": meta.last_sequence, "snapshot": meta.current_snapshot_id}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        meta = self._load()
        at, out = self._seen(meta, start), []
        for s in sorted(meta.snapshots, key=lambda s: s.sequence):
            if start["sequence"] < s.sequence <= end["sequence"]:
                if s.parent_id != at and s.parent_id is not None:
                    out.append((s.sequence, s.parent_id, at, "replace"))
                    at = s.parent_id
                out.append((s.sequence, s.snapshot_id, at, s.operation))
                at = s.snapshot_id
        if at != (last := self._seen(meta, end)):
            out.append((end["sequence"], last, at, "replace"))
        return [_Range(out)]

    def read(self, partition: _Range):
        yield from partition.commits

    def commit(self, end: dict) -> None:
        pass


class CommitSource(DataSource):
    """``spark.readStream.format("lakeloom_commits").option("location", ...)``."""

    @classmethod
    def name(cls) -> str:
        return COMMITS

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def commit_stream(spark: SparkSession, location: str, start_sequence: int = 0) -> DataFrame:
    """A stream of the table's commits after a sequence number."""
    spark.dataSource.register(CommitSource)
    return spark.readStream.format(COMMITS).option("location", location).option("startSequence", str(start_sequence)).load()


def stream_changes(spark: SparkSession, location: str, handle: Callable[[DataFrame, int], None], checkpoint: str, keys: list[str] | None = None, available_now: bool = True):
    """Starts a query that hands each micro-batch's row changes to ``handle(changes, batch_id)``.

    Changes span from the state that the reader has seen to the state after the
    batch's last commit, also over rollbacks; a restart on the same checkpoint
    replays nothing.
    """
    from ..table import open_table

    def run(commits: DataFrame, batch_id: int) -> None:
        got = commits.coalesce(1).collect()  # commits of one batch in order, not rows
        if got:
            table = open_table(commits.sparkSession, location)
            handle(table.changes(got[0]["previous_id"], got[-1]["snapshot_id"], keys), batch_id)

    writer = commit_stream(spark, location).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

