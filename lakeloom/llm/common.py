"""Helpers that the operators share: the shared folder, Arrow mapping, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of text that one step of a Python operator holds at once, and characters.
SLICE_ROWS, SLICE_CHARS = 2_000, 4_000_000
#: Spark's setting that removes the shuffle files of a finished write, and bytes of a row group of a kept table.
CLEAN_UP, ROW_GROUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", 32 << 20
#: Spark's setting of the bytes that go to Python at once, and its value in kept steps: JVM and worker hold a batch each, both in full.
BATCH_BYTES, BYTES_OF_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Rows of keys, a few numbers each, that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset on a single
    machine (tests) a temporary folder is made and set as the checkpoint folder;
    on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_by_us = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_us.isDefined():
            return set_by_us.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


class Scratch:
    """Parquet tables in the shared folder that cut lineage between steps.

    ``keep`` writes a frame and reads it back; a lost executor then costs only
    the step that was running.  ``drop`` removes a table that no later step
    reads; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Row groups and Arrow batches are small, so that a writing task holds little; the shuffle files of the step go with it."""
        path = f"{self.root}/{name}"
        before = {CLEAN_UP: self.spark.conf.get(CLEAN_UP, "false"), BATCH_BYTES: self.spark.conf.get(BATCH_BYTES)}
        self.spark.conf.set(CLEAN_UP, "true")
        self.spark.conf.set(BATCH_BYTES, str(BYTES_OF_A_BATCH))
        try:
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def map_slices(
    df: DataFrame,
    schema: str | StructType,
    columns: dict[str, str],
    body: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]],
) -> DataFrame:
    """``mapInArrow`` over bounded slices.

    ``columns`` maps the names that ``body`` uses to the frame's own names, so
    that extra columns of the frame, whatever they are called, never clash.
    ``body`` gets dicts of Python lists, at most SLICE_ROWS rows and about
    SLICE_CHARS characters each (one row may be longer), and yields dicts of
    lists or Arrow arrays for ``schema``.
    """
    out = schema_of(schema)
    names = list(columns)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict[str, list]]:
            for batch in batches:
                at = 0
                step = max(1, min(SLICE_ROWS, int(SLICE_CHARS * batch.num_rows / max(1, batch.nbytes))))
                while at < batch.num_rows:
                    part = batch.slice(at, step)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                    at += step

        for got in body(slices()):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v := got[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow], schema=arrow
            )
        pa.default_memory_pool().release_unused()  # workers live on; what this task needed goes back

    return select_exact(df, columns).mapInArrow(run, out)


def number_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns renamed by place, and the new name of each, so that no name can clash with an operator's own."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def select_exact(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns under new names (new name -> the frame's own name), found by their exact names: neither dots nor letter case confuse them."""
    numbered, names = number_columns(df)
    return numbered.select(*(F.col(names[c]).alias(n) for n, c in columns.items()))


def map_column(column: Column, kind: str, body: Callable[[list], list]) -> Column:
    """A column made of another one by a Python function over bounded slices of values; all other columns stay in the JVM."""
    arrow = to_arrow_type(schema_of(f"x {kind}")["x"].dataType)

    def run(values: pa.Array) -> pa.Array:
        step = max(1, min(SLICE_ROWS, int(SLICE_CHARS * len(values) / max(1, values.nbytes))))
        parts = [pa.array(body(values.slice(at, step).to_pylist()), type=arrow) for at in range(0, len(values), step)]
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], type=arrow)

    return F.arrow_udf(run, kind)(column)


def bounded(rows: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows that are broadcast if they are few enough.  They are counted, so they should come from a written table."""
    return F.broadcast(rows) if rows.count() <= most else rows


def heavy_keys(rows: DataFrame, on: list[str], limit: int, scratch: Scratch, name: str) -> DataFrame | None:
    """(on..., parts) of the keys with over ``limit`` rows: at most one in ``limit`` rows has one.  None if there are none."""
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit)
    heavy = scratch.keep(counted.select(*on, F.ceil(F.col("c") / limit).cast("long").alias("parts")), name)
    return None if heavy.isEmpty() else bounded(heavy)


def dealt(rows: DataFrame, on: list[str], heavy: DataFrame | None, by: Column, part: str = "part") -> DataFrame:
    """Adds ``part``: rows with a heavy key fall into one of its parts by a hash, all others into part 0."""
    if heavy is None:
        return rows.withColumn(part, F.lit(0).cast("long"))
    return rows.join(heavy, on, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")


def repeated(rows: DataFrame, on: list[str], heavy: DataFrame | None, part: str = "part") -> DataFrame:
    """Adds ``part``: rows with a heavy key once for each of its parts, all others with part 0."""
    if heavy is None:
        return rows.withColumn(part, F.lit(0).cast("long"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    return rows.join(heavy, on, "left").withColumn(part, each).drop("parts")


def dealt_join(many: DataFrame, one: DataFrame, on: list[str], heavy: DataFrame | None, by: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``on``, the rows of heavy keys dealt over several tasks."""
    if heavy is None:
        return many.join(one, on, how)
    return dealt(many, on, heavy, by).join(repeated(one, on, heavy), [*on, "part"], how).drop("part")


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
