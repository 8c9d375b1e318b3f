"""Scan planning: live files, pruned, turned into one DataFrame with deletes applied.

A position delete reaches the file that it names; an equality delete reaches
files with a smaller sequence number.  Files that no delete can reach are read
plainly; the rest are anti-joined, null-safe, before any projection, so filters
and column pruning still go down to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import storage
from . import predicates
from .metadata import DATA, EQUALITY_DELETES, POSITION_DELETES, Entry, Snapshot, TableMetadata
from .schema import FIELD_ID, Field, Schema, spark_field, spark_type

FILE, POS, SEQ = "__lakeloom_file", "__lakeloom_pos", "__lakeloom_seq"
#: Delete rows, and files of a file-to-sequence map, that may be broadcast at most.
BROADCAST_ROWS = 1_000_000
POSITION_SCHEMA = T.StructType([T.StructField("file_path", T.StringType(), True, {FIELD_ID: 2147483546}), T.StructField("pos", T.LongType(), True, {FIELD_ID: 2147483545})])


@dataclass(frozen=True)
class ScanTask:
    """A data file and the delete files that can reach it."""

    data: Entry
    deletes: tuple[Entry, ...]


def _buckets(condition: list, schema: Schema, specs: dict) -> Callable[[Any, int, dict], int]:
    """The bucket of each literal that is compared with a bucketed column; all are hashed in one job."""
    sources = {p.source_id for s in specs.values() for p in s.fields if p.transform.startswith("bucket")}
    wanted: dict[tuple, None] = {}
    for name, op, value in condition:
        f = schema.find(name)
        if f is not None and f.id in sources and op.lower() in ("=", "in"):
            kind = spark_type(f.type).simpleString()
            wanted |= dict.fromkeys((v, kind) for v in (value if op.lower() == "in" else [value]) if v is not None)
    hashes: dict[tuple, int] = {}
    if wanted:
        each = F.array(*(F.hash(F.lit(v).cast(kind)) for v, kind in wanted))
        hashes = dict(zip(wanted, SparkSession.getActiveSession().range(1).select(each.alias("h")).first()["h"]))
    return lambda value, n, kind: hashes[value, spark_type(kind).simpleString()] % n


def plan(meta: TableMetadata, snapshot: Snapshot | None, schema: Schema, condition=None) -> list[ScanTask]:
    """Files that may hold matching rows, each with the deletes that can reach it."""
    if snapshot is None:
        return []
    entries = snapshot.entries()
    triples = predicates.pruning_triples(condition)
    specs = {s.spec_id: s for s in meta.specs}
    bucket = _buckets(triples, schema, specs)
    data = [e for e in entries if e.file.content == DATA and (not triples or predicates.file_may_match(e.file, triples, schema, specs, bucket))]
    by_target: dict[str, list[Entry]] = {}
    equality = []
    for e in entries:
        if e.file.content == POSITION_DELETES:
            for t in e.file.targets:
                by_target.setdefault(t, []).append(e)
        elif e.file.content == EQUALITY_DELETES:
            equality.append(e)
    return [ScanTask(d, tuple([p for p in by_target.get(storage.file_uri(d.file.path), ()) if d.sequence <= p.sequence] + [q for q in equality if d.sequence < q.sequence])) for d in data]


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Beyond the bound a sort-merge join is asked for: left alone, Spark goes by the size of the files, and
    sorted positions under one path take about a byte a row there but hundreds on the driver."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _read(spark: SparkSession, fields: T.StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(fields).parquet(*paths)


def to_frame(spark: SparkSession, meta: TableMetadata, tasks: list[ScanTask], schema: Schema, with_position: bool = False) -> DataFrame:
    """Rows of the tasks under a schema; ``with_position`` adds FILE and POS."""
    names = [F.col(f"`{n}`") for n in schema.names]
    keys = {i for t in tasks for d in t.deletes for i in d.file.equality_ids}
    extra = [_known_field(meta, i) for i in sorted(keys - {f.id for f in schema.fields})]
    fields = T.StructType([*schema.spark().fields, *(spark_field(Field(f.id, f"__lakeloom_k{f.id}", f.type)) for f in extra)])
    where = {f.id: f.name for f in schema.fields} | {f.id: f"__lakeloom_k{f.id}" for f in extra}
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS)]

    plain = [t.data.file.path for t in tasks if not t.deletes]
    parts = []
    if plain or not tasks:
        rows = _read(spark, schema.spark(), plain)
        parts.append(rows.select(*names, *(place if with_position else [])))
    if reached := [t for t in tasks if t.deletes]:
        rows = _read(spark, fields, [t.data.file.path for t in reached]).select("*", *place)
        deletes = list({e.file.path: e for t in reached for e in t.deletes}.values())
        position = [e for e in deletes if e.file.content == POSITION_DELETES]
        if position:
            gone = _read(spark, POSITION_SCHEMA, [e.file.path for e in position])
            gone = _broadcast(gone, sum(e.file.record_count for e in position))
            rows = rows.join(gone, (F.col(FILE) == F.col("file_path")) & (F.col(POS) == F.col("pos")), "left_anti")
        equality = [e for e in deletes if e.file.content == EQUALITY_DELETES]
        if equality:
            rows = _apply_equality(spark, meta, rows, reached, equality, where)
        parts.append(rows.select(*names, *([FILE, POS] if with_position else [])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _apply_equality(spark: SparkSession, meta: TableMetadata, rows: DataFrame, reached: list[ScanTask], equality: list[Entry], where: dict[int, str]) -> DataFrame:
    """Anti-joins each set of key columns on null-safe equality and an older sequence."""
    sequences = {t.data.sequence for t in reached}
    if len(sequences) == 1:
        rows = rows.withColumn(SEQ, F.lit(sequences.pop()))
    else:
        of_file = spark.createDataFrame([(storage.file_uri(t.data.file.path), t.data.sequence) for t in reached], f"f string, {SEQ} long")
        rows = rows.join(_broadcast(of_file, len(reached)), F.col(FILE) == F.col("f")).drop("f")
    by_ids: dict[tuple[int, ...], dict[int, list[Entry]]] = {}
    for e in equality:
        by_ids.setdefault(e.file.equality_ids, {}).setdefault(e.sequence, []).append(e)
    for ids, by_sequence in by_ids.items():
        fields = T.StructType([spark_field(Field(i, f"d{i}", _known_field(meta, i).type)) for i in ids])
        gone = None
        for sequence, entries in by_sequence.items():
            part = _read(spark, fields, [e.file.path for e in entries]).withColumn("d_seq", F.lit(sequence).cast("long"))
            gone = part if gone is None else gone.unionByName(part)
        on: Column = F.col(SEQ) < F.col("d_seq")
        for i in ids:
            on = on & F.col(f"`{where[i]}`").eqNullSafe(F.col(f"d{i}"))
        rows = rows.join(_broadcast(gone, sum(e.file.record_count for es in by_sequence.values() for e in es)), on, "left_anti")
    return rows


def _known_field(meta: TableMetadata, field_id: int) -> Field:
    """A field by id from the newest schema that has it."""
    for s in sorted(meta.schemas, key=lambda s: -s.schema_id):
        if f := s.find(field_id):
            return f
    raise KeyError(field_id)
