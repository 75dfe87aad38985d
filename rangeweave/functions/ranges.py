"""Key ranges: a Python value for literals, and expressions over struct columns for ranges that are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeweave.functions import keys


@dataclass(frozen=True)
class KeyRange:
    """``end`` None is INF."""

    begin: bytes
    end: bytes | None
    begin_closed: bool = True
    end_closed: bool = False

    @staticmethod
    def prefix(p: bytes) -> KeyRange:
        return KeyRange(p, keys.inc_bytes(p) if p else None)

    @staticmethod
    def key(k: bytes) -> KeyRange:
        return KeyRange(k, k, True, True)

    @staticmethod
    def starting(begin: bytes, closed: bool = True) -> KeyRange:
        return KeyRange(begin, None, closed, False)

    def within(self, prefix: bytes) -> KeyRange:
        """The same range inside a namespace."""
        if self.end is None:
            return KeyRange(prefix + self.begin, keys.inc_bytes(prefix), self.begin_closed, False)
        return KeyRange(prefix + self.begin, prefix + self.end, self.begin_closed, self.end_closed)

    def holds(self, key: Column) -> Column:
        """A predicate of comparisons with literals, which Parquet scans can use."""
        low = key >= keys.literal(self.begin) if self.begin_closed else key > keys.literal(self.begin)
        if self.end is None:
            return low
        return low & (key <= keys.literal(self.end) if self.end_closed else key < keys.literal(self.end))

    def column(self) -> Column:
        return struct(keys.literal(self.begin), F.lit(self.begin_closed), keys.literal(self.end), F.lit(self.end_closed))


EMPTY = KeyRange(b"\0", b"\0", False, False)


def struct(begin: Column, begin_closed: Column, end: Column, end_closed: Column) -> Column:
    return F.struct(begin.alias("begin"), begin_closed.alias("begin_closed"), end.alias("end"), end_closed.alias("end_closed"))


def is_empty(r: Column) -> Column:
    b, e = r["begin"], r["end"]
    return e.isNotNull() & ((b > e) | ((b == e) & ~(r["begin_closed"] & r["end_closed"])))


def contains_key(r: Column, key: Column) -> Column:
    low = (key > r["begin"]) | ((key == r["begin"]) & r["begin_closed"])
    high = r["end"].isNull() | (key < r["end"]) | ((key == r["end"]) & r["end_closed"])
    return low & high


def contains_range(a: Column, b: Column) -> Column:
    """Whether every key of b is in a; an empty b is in any range."""
    low = (a["begin"] < b["begin"]) | ((a["begin"] == b["begin"]) & (a["begin_closed"] | ~b["begin_closed"]))
    high = a["end"].isNull() | (b["end"].isNotNull() & ((b["end"] < a["end"]) | ((b["end"] == a["end"]) & (a["end_closed"] | ~b["end_closed"]))))
    return is_empty(b) | (low & F.coalesce(high, F.lit(False)))


def _intersect(a: Column, b: Column) -> Column:
    a_end_first = F.coalesce(a["end"] < b["end"], a["end"].isNotNull())
    same_end = a["end"].eqNullSafe(b["end"])
    return struct(
        F.greatest(a["begin"], b["begin"]),
        F.when(a["begin"] == b["begin"], a["begin_closed"] & b["begin_closed"]).when(a["begin"] > b["begin"], a["begin_closed"]).otherwise(b["begin_closed"]),
        F.when(a_end_first, a["end"]).otherwise(b["end"]),
        F.when(same_end, a["end_closed"] & b["end_closed"]).when(a_end_first, a["end_closed"]).otherwise(b["end_closed"]),
    )


def intersect(a: Column, b: Column) -> Column:
    """The common keys; (00, 00) where there are none."""
    both = _intersect(a, b)
    return F.when(is_empty(a) | is_empty(b) | is_empty(both), EMPTY.column()).otherwise(both)


def overlaps(a: Column, b: Column) -> Column:
    return ~(is_empty(a) | is_empty(b) | is_empty(_intersect(a, b)))


def order(r: Column) -> list[Column]:
    """By begin, closed before open, then end (open before closed, INF last)."""
    return [r["begin"], (~r["begin_closed"]).alias("open"), r["end"].asc_nulls_last(), r["end_closed"].asc()]


def text(r: Column) -> Column:
    """``[00 01, 00 02)`` in hex."""
    return F.concat(
        F.when(r["begin_closed"], "[").otherwise("("), F.hex(r["begin"]), F.lit(","), F.coalesce(F.hex(r["end"]), F.lit("INF")), F.when(r["end_closed"], "]").otherwise(")")
    )
