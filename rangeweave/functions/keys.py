"""Key algebra as column expressions. Keys are BINARY and compare as unsigned bytes, shorter prefixes first.

The least upper bound of all keys (INF) is null; it occurs only as the end of a range. Integer keys are big-endian
two's complement in four bytes, so negative ones sort after all others.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of namespaces may not begin with this.
RESERVED = bytes(4)


def int_bytes(*values: int) -> bytes:
    return b"".join(struct.pack(">I", v & 0xFFFFFFFF) for v in values)


def literal(key: bytes | None) -> Column:
    return F.lit(None).cast("binary") if key is None else F.lit(bytearray(key))


def int_key(value: Column) -> Column:
    """Four big-endian bytes of an integer."""
    return F.unhex(F.lpad(F.right(F.hex(value.cast("bigint")), F.lit(8)), 8, "0"))


def int_value(key: Column) -> Column:
    """The signed integer in the last four bytes of a key."""
    unsigned = F.conv(F.hex(F.substring(key, -4, 4)), 16, 10).cast("bigint")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def text_key(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def from_hex(text: Column) -> Column:
    """``AA BB`` or ``AABB``; null gives the empty key."""
    return F.unhex(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def show(key: Column) -> Column:
    """Bytes in upper-case hex, a space between two."""
    return F.array_join(F.regexp_extract_all(F.hex(key), F.lit("(..)"), F.lit(1)), " ")


def append(key: Column, tail: Column) -> Column:
    """INF absorbs what is appended to it."""
    return F.concat(key, tail)


def prepend(end: Column, prefix: Column) -> Column:
    """A range's end inside the namespace ``prefix``: INF becomes the end of the namespace."""
    return F.when(end.isNull(), inc(prefix)).otherwise(F.concat(prefix, end))


def inc(key: Column) -> Column:
    """The key of the same length that comes next; INF after FF...FF, 00 after the empty key."""
    h = F.hex(key)
    head = F.regexp_extract(h, "^((?:..)*?)((?:FF)*)$", 1)
    last = F.lpad(F.hex(F.conv(F.right(head, F.lit(2)), 16, 10).cast("bigint") + 1), 2, "0")
    up = F.unhex(F.rpad(F.concat(F.left(head, F.length(head) - 2), last), F.length(h), F.lit("0")))
    return F.when(h == "", F.lit(bytearray(b"\0"))).when(head == "", F.lit(None).cast("binary")).otherwise(up)


def inc_bytes(key: bytes | None) -> bytes | None:
    if key is None:
        return None
    if not key:
        return b"\0"
    n = int.from_bytes(key, "big") + 1
    return None if n >> 8 * len(key) else n.to_bytes(len(key), "big")


def has_prefix(key: Column, prefix: bytes) -> Column:
    """As a range, which reaches Parquet's statistics where startswith() on BINARY doesn't."""
    end = inc_bytes(prefix) if prefix else None
    low = key >= literal(prefix)
    return low if end is None else low & (key < literal(end))


def first_byte(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int")


def size(key: Column) -> Column:
    return F.octet_length(key).cast("bigint")


def is_byte_length(key: Column) -> Column:
    return F.octet_length(key) <= 255


def schema_id(name: Column, reserved: bytes = RESERVED, rounds: int = 4) -> Column:
    """MD5 of the name, hashed again with a counter while it begins with the reserved prefix (``rounds`` times at most)."""
    taken = reserved.hex()
    out = F.md5(F.encode(name, "UTF-8"))
    for i in range(rounds):
        again = F.md5(F.concat(F.unhex(out), F.lit(bytearray(int_bytes(i)))))
        out = F.when(F.left(out, F.lit(len(taken))) == taken, again).otherwise(out)
    return F.unhex(out)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; INF (null) is above every key."""
    return (
        F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
        .when(a < b, -1).when(a > b, 1).otherwise(0)
    )


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b in doubles; 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.floor(a.cast("double") / b.cast("double")).cast("bigint"))


def interval_gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Distance of two uncertainty intervals: negative if a lies before b, positive if after, 0 if they overlap."""
    return F.when(a_high < b_low, a_high - b_low).when(a_low > b_high, a_low - b_high).otherwise(F.lit(0).cast("bigint"))


#: Keys that are sampled for bounds, and bounds that are taken from them: what a comparison tree holds.
SAMPLED_KEYS, MOST_BOUNDS = 4096, 256


def bounds(rows: DataFrame, key: str = "key", most: int = MOST_BOUNDS) -> list[bytes]:
    """Up to ``most`` keys of ``rows`` that split them evenly, in order: of ``SAMPLED_KEYS`` keys by hash, or of all if
    there are no more. The least key is always among them."""
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    least = known.agg(F.min("k").alias("k")).where("k IS NOT NULL")
    sample = known.orderBy(F.xxhash64("k"), "k").limit(SAMPLED_KEYS).union(least).collect()  # so many keys
    found = sorted({bytes(r["k"]) for r in sample})
    step = -(-len(found) // most) or 1
    return found[::step]


def bucket(key: Column, edges: list[bytes]) -> Column:
    """The place (from 0) of the last bound up to the key, -1 below all: a balanced tree of comparisons."""
    if not edges:
        return F.lit(-1)
    mid = len(edges) // 2
    if len(edges) == 1:
        return F.when(key < literal(edges[0]), -1).otherwise(0)
    return F.when(key < literal(edges[mid]), bucket(key, edges[:mid])).otherwise(bucket(key, edges[mid:]) + mid)
