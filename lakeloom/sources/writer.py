"""Data and delete files: checked, written by Spark under field ids, described from their footers."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch
from ..functions import transforms
from ..plans.metadata import DATA, EQUALITY_DELETES, POSITION_DELETES, DataFile
from ..plans.partition import PartitionSpec
from ..plans.predicates import encode
from ..plans.schema import FIELD_ID, Field, Schema, spark_type
from . import storage

#: Files whose footers are read by the driver; beyond, or on a remote store, Spark aggregates the new files.
FOOTERS = 2_000
#: Longest string kept as a bound.
BOUND_LENGTH = 64
_PART = "__lakeloom_p"


def align(df: DataFrame, schema: Schema, extra: list[str] = ()) -> DataFrame:
    """The frame's columns by name, in schema order, then ``extra`` ones; SchemaMismatch if they don't fit.

    Missing optional columns become null.  A null in a required column, or a
    ``fixed`` value of another length, fails the write itself (no extra pass).
    """
    have = {f.name: f for f in df.schema}
    if len(have) != len(df.schema):
        raise SchemaMismatch(f"a column name occurs twice in {df.columns}")
    if unknown := [n for n in have if n not in schema.names and n not in extra]:
        raise SchemaMismatch(f"columns {unknown} are not in the table")
    out = []
    for f in schema.fields:
        want = spark_type(f.type)
        if f.name not in have:
            if f.required:
                raise SchemaMismatch(f"required column {f.name} is missing")
            out.append(F.lit(None).cast(want).alias(f.name))
            continue
        got = have[f.name].dataType
        if not _fits(got, want):
            raise SchemaMismatch(f"column {f.name} is {got.simpleString()}, the table has {want.simpleString()}")
        c = F.col(f"`{f.name}`")
        c = c if got == want else c.cast(want)
        if f.required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"null in required column {f.name}"))).otherwise(c)
        if f.type["type"] == "fixed":
            c = F.when(F.octet_length(c) != f.type["length"], F.raise_error(F.lit(f"{f.name} has fixed length {f.type['length']}"))).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out, *(F.col(f"`{n}`") for n in extra))


def _fits(got: T.DataType, want: T.DataType) -> bool:
    if isinstance(got, T.NullType) or _plain(got) == _plain(want):
        return True
    widening = [(T.ByteType, T.IntegerType), (T.ShortType, T.IntegerType), (T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)]
    if isinstance(got, T.DecimalType) and isinstance(want, T.DecimalType):
        return got.scale == want.scale and got.precision <= want.precision
    return any(isinstance(got, a) and isinstance(want, b) for a, b in widening)


def _plain(t: T.DataType) -> str:
    return t.simpleString()


def with_ids(df: DataFrame, kind: T.StructType) -> DataFrame:
    """The frame under a schema, so that the files carry its field ids at every level.

    ``to`` sets the ids of nested fields.  Top-level ids are set by aliases over
    columns that don't have them yet: an alias that repeats them is optimised away.
    """
    bare = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in kind])
    return df.to(bare).select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in kind))


def partition_columns(schema: Schema, spec: PartitionSpec) -> list[Column]:
    out = []
    for i, p in enumerate(spec.fields):
        name, source = _path_of(schema, p.source_id)
        out.append(transforms.apply(p.transform, F.col(name), spark_type(source.type).simpleString()).alias(f"{_PART}{i}"))
    return out


def _path_of(schema: Schema, field_id: int) -> tuple[str, Field]:
    for name, f in schema.all_fields():
        if f.id == field_id:
            return ".".join(f"`{p}`" for p in name.split(".")), f
    raise SchemaMismatch(f"partition source {field_id} is no longer in the schema")


def write_data(df: DataFrame, schema: Schema, spec: PartitionSpec, location: str, bloom: dict[str, int] | None = None, order: list[str] | None = None) -> list[DataFile]:
    """Writes rows under a fresh folder and describes the files; no row, no file.

    Partitioned rows are rebalanced by their partition values: each value's rows
    meet in few files, and a value with very many rows is split by AQE.
    ``bloom`` gives columns their expected number of distinct values.  Each file
    is sorted by ``order``, columns of ``df`` that may be none of the table's.
    """
    folder = f"{location}/data/{uuid.uuid4().hex}"
    names = [f"{_PART}{i}" for i in range(len(spec.fields))]
    extra = [df.schema[c] for c in order or [] if c not in schema.names]
    rows = align(df, schema, [f.name for f in extra])
    rows = with_ids(rows, T.StructType([*schema.spark().fields, *extra]))
    if names:
        rows = rows.select("*", *partition_columns(schema, spec)).hint("rebalance", *names)
    if order:
        rows = rows.sortWithinPartitions(*names, *(F.col(f"`{c}`") for c in order)).drop(*(f.name for f in extra))
    writer = rows.write.mode("error").option("compression", "zstd")
    for column, ndv in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(ndv))
    (writer.partitionBy(*names) if names else writer).parquet(folder)
    return describe(df.sparkSession, folder, schema, spec)


def write_position_deletes(df: DataFrame, location: str) -> list[DataFile]:
    """Writes (file_path, pos), sorted, and notes which files they target."""
    spark = df.sparkSession
    kind = T.StructType([T.StructField("file_path", T.StringType(), True, {FIELD_ID: 2147483546}), T.StructField("pos", T.LongType(), True, {FIELD_ID: 2147483545})])
    own = df.select(F.col("file_path").cast("string"), F.col("pos").cast("long"))
    rows = own.repartition("file_path").sortWithinPartitions("file_path", "pos")
    folder = f"{location}/data/{uuid.uuid4().hex}-deletes"
    with_ids(rows, kind).write.option("compression", "zstd").parquet(folder)
    files = _listed(folder)
    if not files:
        return []
    written = spark.read.schema(kind).parquet(*[p for p, _ in files])
    per_file = written.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("file_path").alias("targets")).collect()
    size = dict(files)
    out = []
    for r in per_file:
        path = storage.from_file_uri(r["f"])
        out.append(DataFile(path, r["n"], size[path], POSITION_DELETES, targets=tuple(sorted(r["targets"]))))
    return sorted(out, key=lambda f: f.path)


def write_equality_deletes(df: DataFrame, keys: list[Field], location: str) -> list[DataFile]:
    """Writes the distinct key rows and notes the ids of the key columns; null keys match null."""
    schema = Schema(tuple(Field(f.id, f.name, f.type) for f in keys))
    folder = f"{location}/data/{uuid.uuid4().hex}-deletes"
    with_ids(df.select(*(F.col(f"`{f.name}`") for f in keys)).distinct(), schema.spark()).write.option("compression", "zstd").parquet(folder)
    ids = tuple(f.id for f in keys)
    return [DataFile(**(vars(f) | {"content": EQUALITY_DELETES, "equality_ids": ids})) for f in describe(df.sparkSession, folder, schema, PartitionSpec())]


def _listed(folder: str) -> list[tuple[str, int]]:
    return [(p, n) for p, n, _ in storage.list_files(folder) if p.rsplit("/", 1)[-1].startswith("part-") and p.endswith(".parquet")]


def describe(spark: SparkSession, folder: str, schema: Schema, spec: PartitionSpec) -> list[DataFile]:
    """Data files of a written folder with counts and bounds; empty files are removed."""
    files = _listed(folder)
    if storage.is_local(folder) and len(files) <= FOOTERS:
        with ThreadPoolExecutor(8) as pool:
            stats = dict(pool.map(lambda f: (f[0], footer_stats(f[0], schema)), files))
    else:
        stats = spark_stats(spark, [p for p, _ in files], schema)
    out = []
    for path, size in files:
        s = stats.get(path)
        if not s or not s["record_count"]:
            storage.delete(path)
            continue
        out.append(DataFile(path, file_size=size, content=DATA, spec_id=spec.spec_id, partition=_partition_of(path, schema, spec), **s))
    return out


def _partition_of(path: str, schema: Schema, spec: PartitionSpec) -> dict:
    found = {}
    for part in path.split("/"):
        if part.startswith(_PART):
            name, _, raw = part.partition("=")
            p = spec.fields[int(name[len(_PART) :])]
            _, source = _path_of(schema, p.source_id)
            found[str(p.field_id)] = _typed(unquote(raw), transforms.result_type(p.transform, spark_type(source.type).simpleString()), source.type)
    return found


def _typed(raw: str, kind: str, source: dict) -> object:
    if raw == "__HIVE_DEFAULT_PARTITION__":
        return None
    if kind in ("int", "bigint"):
        return int(raw)
    if kind in ("double", "float"):
        return float(raw)
    if kind == "boolean":
        return raw == "true"
    if kind == "string":
        return raw
    return encode(raw, source)


def footer_stats(path: str, schema: Schema) -> dict:
    """Counts, sizes and bounds of top-level primitive columns, from a Parquet footer."""
    meta = pq.ParquetFile(path).metadata
    out: dict = {"record_count": meta.num_rows, "value_counts": {}, "null_counts": {}, "column_sizes": {}, "lower": {}, "upper": {}}
    by_name = {f.name: f for f in schema.fields}
    unknown: set[str] = set()
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for i in range(group.num_columns):
            c = group.column(i)
            f = by_name.get(c.path_in_schema)
            if f is None:
                continue
            key = str(f.id)
            out["column_sizes"][key] = out["column_sizes"].get(key, 0) + c.total_compressed_size
            out["value_counts"][key] = out["value_counts"].get(key, 0) + c.num_values
            s = c.statistics
            if s is None or not s.has_null_count:
                unknown.add(key)
                continue
            out["null_counts"][key] = out["null_counts"].get(key, 0) + s.null_count
            if s.null_count == c.num_values:
                continue
            if not s.has_min_max:
                unknown.add(key)
                continue
            try:
                low, high = _bound(s.min, f.type, False), _bound(s.max, f.type, True)
            except (ValueError, TypeError, NotImplementedError):
                low = high = None
            if low is None or high is None:
                unknown.add(key)
                continue
            out["lower"][key] = min(low, out["lower"].get(key, low))
            out["upper"][key] = max(high, out["upper"].get(key, high))
    for key in unknown:
        out["lower"].pop(key, None)
        out["upper"].pop(key, None)
    return out


def _bound(value: object, kind: dict, upper: bool) -> object:
    if isinstance(value, bytes):
        if kind["type"] not in ("string", "uuid"):
            return None
        value = value.decode("utf-8")
    if isinstance(value, decimal.Decimal):
        near = float(value)
        return math.nextafter(near, math.inf if upper else -math.inf)
    if isinstance(value, (dt.date, dt.datetime)) or isinstance(value, (int, bool)):
        return encode(value, kind)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if upper else -0.0) if value == 0 else value
    if isinstance(value, str):
        if len(value) <= BOUND_LENGTH:
            return value
        return value[:BOUND_LENGTH] if not upper else _round_up(value[:BOUND_LENGTH])
    return None


def _round_up(s: str) -> str | None:
    """A string above every string with this prefix."""
    for i in range(len(s) - 1, -1, -1):
        if ord(s[i]) < 0xD7FF or 0xE000 <= ord(s[i]) < 0x10FFFF:
            return s[:i] + chr(ord(s[i]) + 1)
    return None


_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def stat_columns(schema: Schema) -> list[Field]:
    return [f for f in schema.fields if isinstance(spark_type(f.type), _ORDERED)]


def spark_stats(spark: SparkSession, paths: list[str], schema: Schema) -> dict[str, dict]:
    """The same as ``footer_stats`` by one aggregation over the files, with NaN counts; for stores without local footers."""
    if not paths:
        return {}
    aggs = [F.count(F.lit(1)).alias("n")]
    fields = stat_columns(schema)
    for f in fields:
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"z{f.id}"), F.min(c).alias(f"l{f.id}"), F.max(c).alias(f"u{f.id}")]
        if f.type["type"] in ("float", "double"):
            aggs.append(F.count_if(F.isnan(c)).alias(f"q{f.id}"))
    rows = spark.read.schema(schema.spark()).parquet(*paths).groupBy(F.col("_metadata.file_path").alias("f")).agg(*aggs)
    out = {}
    for r in rows.collect():  # one row a file
        s: dict = {"record_count": r["n"], "value_counts": {}, "null_counts": {}, "nan_counts": {}, "lower": {}, "upper": {}}
        for f in fields:
            key = str(f.id)
            s["value_counts"][key], s["null_counts"][key] = r["n"], r[f"z{f.id}"]
            if f.type["type"] in ("float", "double"):
                s["nan_counts"][key] = r[f"q{f.id}"]
            low, high = (None if r[k] is None else _bound(r[k], f.type, up) for k, up in ((f"l{f.id}", False), (f"u{f.id}", True)))
            if low is not None and high is not None:
                s["lower"][key], s["upper"][key] = low, high
        out[storage.from_file_uri(r["f"])] = s
    return out
