"""Cells from and to storage. The store is Parquet, range-partitioned and sorted by key within a namespace folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange

SCHEMA = "key binary, version int, value binary, is_tombstone boolean"


def write(cells: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Sorted key ranges, a file each, so that file and row group statistics prune range scans."""
    dealt = cells.repartitionByRange(partitions, "key") if partitions else cells.repartitionByRange("key")
    dealt.sortWithinPartitions("key", F.col("version").desc()).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, span: KeyRange | None = None) -> DataFrame:
    cells = spark.read.schema(SCHEMA).parquet(path)
    return cells if span is None else cells.where(span.holds(F.col("key")))


def from_int_column(rows: DataFrame, column: str, value: Column, span: KeyRange | None = None) -> DataFrame:
    """Cells of version 0 over a table with an integer column for a key (not negative).

    Four-byte keys of such integers order as the integers do, so a key range is also pushed to the scan as a range of
    the column, which knows nothing of keys.
    """
    if span is not None:
        low = int.from_bytes(span.begin[:4].ljust(4, b"\0"), "big")
        rows = rows.where(F.col(column) >= low)
        if span.end is not None:
            rows = rows.where(F.col(column) <= int.from_bytes(span.end[:4].ljust(4, b"\xff"), "big"))
    cells = rows.select(keys.int_key(F.col(column)).alias("key"), F.lit(0).alias("version"), F.encode(value, "UTF-8").alias("value"), value.isNull().alias("is_tombstone"))
    return cells if span is None else cells.where(span.holds(F.col("key")))


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(schema_id, name, meta) from a JSON file with an array of {name, meta}; an id in meta replaces the name's hash."""
    rows = spark.read.schema("name string, meta map<string,string>").json(path, multiLine=True)
    own = keys.from_hex(F.element_at("meta", "id"))
    return rows.select(F.when(F.element_at("meta", "id").isNotNull(), own).otherwise(keys.schema_id(F.col("name"))).alias("schema_id"), "name", "meta")


def write_schemas(schemas: DataFrame, path: str) -> None:
    """One JSON array, as :func:`read_schemas` takes it."""
    schemas.agg(F.to_json(F.collect_list(F.struct("name", "meta"))).alias("value")).write.mode("overwrite").text(path)  # a catalog, not data


def write_series(rows: DataFrame, path: str) -> None:
    """Measured series as CSV."""
    rows.write.mode("overwrite").csv(path, header=True)
