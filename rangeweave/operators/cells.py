"""Multi-version cells: a row (key BINARY, version INT, value BINARY, is_tombstone BOOLEAN) per key and version.

Values, empty values and tombstones are three different things: a tombstone is a row with ``is_tombstone``, whose value
is null; an empty value is a live cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions.ranges import KeyRange

MAX_VALUE = 65_534
MAX_VERSION = 65_535


def validate(cells: DataFrame) -> DataFrame:
    """Fails the job on a value or version that is too large, instead of losing the cell."""
    ok = (F.coalesce(F.octet_length("value"), F.lit(0)) <= MAX_VALUE) & F.col("version").between(0, MAX_VERSION)
    return cells.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("value over 65534 bytes or version out of range"))))


def newest(cells: DataFrame, at: int | None = None, tombstones: bool = False) -> DataFrame:
    """One row per key: its newest version (not above ``at``); keys whose newest is a tombstone are absent.

    ``row_number() = 1`` is planned as a group limit, which keeps one row per key before the shuffle.
    """
    seen = cells if at is None else cells.where(F.col("version") <= at)
    last = Window.partitionBy("key").orderBy(F.col("version").desc())
    out = seen.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return out if tombstones else out.where("NOT is_tombstone")


def get(cells: DataFrame, *wanted: bytes) -> DataFrame:
    """Newest versions of some keys, found by a pushed-down IN."""
    return newest(cells.where(F.col("key").isin([bytearray(k) for k in wanted])))


def raw_size(value: Column) -> Column:
    """Bytes of a version in the packed form: a four-byte header and the value."""
    return (F.lit(4) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def size_scan(cells: DataFrame, by: list[str] | None = None, span: KeyRange | None = None) -> DataFrame:
    """Bytes (keys once, all versions packed) and number of keys, in all or by group columns that a key determines."""
    rows = cells if span is None else cells.where(span.holds(F.col("key")))
    per_key = rows.groupBy(*(by or []), "key").agg(F.sum(raw_size(F.col("value"))).alias("raw"))
    return per_key.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.octet_length("key") + F.col("raw")), F.lit(0)).cast("bigint").alias("size"), F.count(F.lit(1)).alias("n_keys")
    )


def cleanup(cells: DataFrame, version: int) -> DataFrame:
    """Without versions up to ``version``, save each key's newest."""
    newest_of = cells.groupBy("key").agg(F.max("version").alias("__newest"))
    return cells.join(newest_of, "key").where((F.col("version") > version) | (F.col("version") == F.col("__newest"))).drop("__newest")


def merge(cells: DataFrame, batch: DataFrame, version: int) -> DataFrame:
    """``batch`` (key, value; null deletes) written at ``version`` over ``cells``."""
    written = batch.select("key", F.lit(version).cast("int").alias("version"), "value", F.col("value").isNull().alias("is_tombstone"))
    kept = cells.where(F.col("version") != version).unionByName(cells.where(F.col("version") == version).join(written.select("key"), "key", "left_anti"))
    return kept.unionByName(written)


def full_delete(cells: DataFrame, span: KeyRange) -> DataFrame:
    """Without any version of the keys of a range."""
    return cells.where(~span.holds(F.col("key")))


def diff_fold(diffs: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Store size and keys after each of a series of diffs (size, n_keys, reset): a reset overwrites, others add."""
    groups = by or []
    upto = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    epoch = diffs.withColumn("__epoch", F.sum(F.col("reset").cast("int")).over(upto))
    within = Window.partitionBy(*groups, "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return epoch.withColumns({"store_size": F.sum("size").over(within), "store_keys": F.sum("n_keys").over(within)}).drop("__epoch")


def snapshot_total(diffs: DataFrame, order: str, by: list[str]) -> DataFrame:
    """What :func:`diff_fold` ends with, by group: sums from the last reset on, aggregated before they are shuffled."""
    last = diffs.where("reset").groupBy(*by).agg(F.max(order).alias("__from"))
    return diffs.join(last, by, "left").where(F.col("__from").isNull() | (F.col(order) >= F.col("__from"))).groupBy(*by).agg(F.sum("size").alias("store_size"), F.sum("n_keys").alias("store_keys"))
