"""Range scans: range, limit, filter and transformation, action; rows, writes and the change in size they cause."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange
from rangeweave.operators.cells import newest

KILO, MEGA = 1000, 1_000_000


def _running(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` with (__bucket, __size, __before), and the bytes of all values up to and with a row's in order of key.

    Keys are cut into even buckets, by a sample; only the buckets' totals are ordered across buckets, rows within theirs.
    """
    edges = keys.bounds(rows)
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint")
    rows = rows.withColumns({"__bucket": keys.bucket(F.col("key"), edges), "__size": size})
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are buckets
    totals = rows.groupBy("__bucket").agg(F.sum("__size").alias("__total")).select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(totals), "__bucket")  # MOST_BOUNDS rows at most
    return placed, F.col("__before") + F.sum("__size").over(within)


def byte_prefix(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows by key whose values add up to ``limit`` bytes at most; the scan stops at the first that doesn't fit.

    Only buckets that begin below the limit are summed row by row.
    """
    placed, used = _running(rows)
    return placed.where(F.col("__before") <= limit).withColumn("__used", used).where(F.col("__used") <= limit).drop("__bucket", "__size", "__before", "__used")


@dataclass(frozen=True)
class Scan:
    """A scan of cells; methods give changed copies. ``keep`` and ``transform`` see the columns key and value."""

    span: KeyRange
    at: int | None = None
    items: int | None = None
    bytes: int | None = None
    keep: Callable[[Column], Column] | None = None
    transform: Callable[[Column], Column] | None = None

    def first(self, n: int) -> Scan:
        return replace(self, items=n)

    def up_to_bytes(self, n: int) -> Scan:
        return replace(self, bytes=n)

    def where(self, keep: Callable[[Column], Column]) -> Scan:
        return replace(self, keep=keep)

    def map(self, transform: Callable[[Column], Column]) -> Scan:
        return replace(self, transform=transform)

    def appending(self, tail: bytes) -> Scan:
        return self.map(lambda value: F.concat(value, F.lit(bytearray(tail))))

    def in_range(self, cells: DataFrame) -> DataFrame:
        """(key, version, old, value) of the range's live cells that pass the filter, transformed, without a limit."""
        rows = newest(cells.where(self.span.holds(F.col("key"))), self.at)
        if self.keep:
            rows = rows.where(self.keep(F.col("value")))
        value = self.transform(F.col("value")) if self.transform else F.col("value")
        return rows.select("key", "version", F.col("value").alias("old"), value.alias("value"))

    def rows(self, cells: DataFrame) -> DataFrame:
        """What the scan returns. An item limit is a distributed top-n by key."""
        rows = self.in_range(cells)
        if self.bytes is not None:
            rows = byte_prefix(rows, self.bytes)
        return rows if self.items is None else rows.orderBy("key").limit(self.items)

    def truncated(self, cells: DataFrame) -> DataFrame:
        """One row: how many cells the scan returns, and whether the limit kept some back."""
        whole = self.in_range(cells).agg(F.count(F.lit(1)).alias("n"))
        got = self.rows(cells).agg(F.count(F.lit(1)).alias("returned"))
        return whole.join(got).select("returned", (F.col("returned") < F.col("n")).alias("truncated"))  # a row each

    def delete(self, cells: DataFrame, version: int) -> DataFrame:
        """Tombstones at ``version`` for what the scan returns."""
        return self.rows(cells).select("key", F.lit(version).cast("int").alias("version"), F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_tombstone"))

    def write_back(self, cells: DataFrame, version: int) -> DataFrame:
        """The transformed values at ``version``; a null value deletes. Unchanged cells aren't written."""
        changed = self.rows(cells).where(~F.col("old").eqNullSafe(F.col("value")))
        return changed.select("key", F.lit(version).cast("int").alias("version"), "value", F.col("value").isNull().alias("is_tombstone"))

    def diff(self, cells: DataFrame, delete: bool = False) -> DataFrame:
        """One row (size, n_keys): the change that :meth:`delete` or :meth:`write_back` causes; key bytes count for deletes."""
        old, new = F.octet_length("old"), F.octet_length("value")
        gone = F.lit(True) if delete else F.col("value").isNull()
        return self.rows(cells).agg(
            F.coalesce(F.sum(F.when(gone, -(F.octet_length("key") + old)).otherwise(new - old)), F.lit(0)).cast("bigint").alias("size"),
            F.coalesce(F.sum(F.when(gone, -1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_keys"),
        )


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (key, value) with the page that a transfer bounded by ``limit`` bytes a page sends them in: pages are cut
    where the running sum of value bytes passes a multiple of the limit."""
    placed, used = _running(rows)
    return placed.withColumn("page", F.floor((used - F.col("__size")) / limit).cast("bigint")).drop("__bucket", "__size", "__before")
