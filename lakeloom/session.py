"""Session settings that the table layer relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import TableAlreadyExists, TableNotFound

#: Parquet columns are resolved by field id, so renamed and re-added columns read right.
SETTINGS = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.write.enabled": "true"}


def configure_spark(spark: SparkSession) -> SparkSession:
    """Switches on what table reads and writes need; safe to call again.

    Files without field ids still read by name when their schema has no ids.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, location: str, snapshot_id: int | None = None, as_of=None) -> DataFrame:
    """A table's rows, now, at a snapshot or as of a time."""
    from .table import open_table

    table = open_table(spark, location)
    if snapshot_id is not None:
        table = table.at_snapshot(snapshot_id)
    elif as_of is not None:
        table = table.as_of(as_of)
    return table.scan()


def write_table(df: DataFrame, location: str, mode: str = "append", partition_by: list | None = None, properties: dict[str, str] | None = None):
    """Writes rows to the table at a location, which is created if it isn't there.

    Modes: append, overwrite, error (the table must not exist), ignore (nothing
    happens if it does).
    """
    from .table import create_table, open_table

    if mode not in ("append", "overwrite", "error", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    try:
        table = open_table(df.sparkSession, location)
    except TableNotFound:
        table = None
    if table is not None and mode == "error":
        raise TableAlreadyExists(location)
    if table is not None and mode == "ignore":
        return table
    if table is None:
        from .plans.schema import Schema

        table = create_table(df.sparkSession, location, Schema.of(df.schema, required=()), properties=properties, partition_by=partition_by)
    if mode == "overwrite" and table.snapshot:
        table.overwrite(df)
    else:
        table.append(df)
    return table
