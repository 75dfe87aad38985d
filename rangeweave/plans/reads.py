"""Point, range and prefix reads; limits, filters, transformations; versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange
from rangeweave.operators import cells as C
from rangeweave.operators.scan import Scan, pages
from rangeweave.plans.base import VERSIONS_SQL, event_versions, order_cells, query, shown, table

_ORDERS = "SELECT printf('%08X', o_orderkey) AS key, o_orderpriority AS value FROM orders"
A, B = keys.int_bytes(100), keys.int_bytes(4000)


@query("point_get", f"{_ORDERS} WHERE o_orderkey = 42")
def point_get(spark, d):
    k = keys.int_bytes(42)
    return shown(C.get(order_cells(spark, d, KeyRange.key(k)), k))


@query("multi_get", f"{_ORDERS} WHERE o_orderkey IN (7, 42, 99, 1000000000)")
def multi_get(spark, d):
    return shown(C.get(order_cells(spark, d), *[keys.int_bytes(i) for i in (7, 42, 99, 1_000_000_000)]))


@query("get_absent", "SELECT 'SUCCESS' AS code, k AS key, max(o_orderpriority) AS value FROM (VALUES ('3B9ACA00', 1000000000), ('00000007', 7)) w(k, i) LEFT JOIN orders ON o_orderkey = i GROUP BY k")
def get_absent(spark, d):
    wanted = spark.createDataFrame([("3B9ACA00",), ("00000007",)], "k string")
    got = shown(C.get(order_cells(spark, d), keys.int_bytes(1_000_000_000), keys.int_bytes(7)))
    return wanted.join(got, F.col("k") == F.col("key"), "left").select(F.lit("SUCCESS").alias("code"), F.col("k").alias("key"), "value")


def _ranged(name, begin_closed, end_closed):
    low, high = ">=" if begin_closed else ">", "<=" if end_closed else "<"

    @query(name, f"{_ORDERS} WHERE o_orderkey {low} 100 AND o_orderkey {high} 4000")
    def run(spark, d):
        span = KeyRange(A, B, begin_closed, end_closed)
        return shown(Scan(span).rows(order_cells(spark, d, span)))


_ranged("range_closed_closed", True, True)
_ranged("range_open_open", False, False)
_ranged("range_closed_open", True, False)
_ranged("range_open_closed", False, True)


@query("range_to_infinity", f"{_ORDERS} WHERE o_orderkey >= 500")
def range_to_infinity(spark, d):
    span = KeyRange.starting(keys.int_bytes(500))
    return shown(Scan(span).rows(order_cells(spark, d, span)))


@query("prefix_scan", f"SELECT * FROM ({_ORDERS}) WHERE key LIKE '000001%'")
def prefix_scan(spark, d):
    span = KeyRange.prefix(b"\0\0\1")
    return shown(Scan(span).rows(order_cells(spark, d, span)))


@query("prefix_scan_text", "SELECT hex(encode(p_name)) AS key, p_brand AS value, count(*) AS n FROM part WHERE p_name LIKE 'b%' GROUP BY 1, 2")
def prefix_scan_text(spark, d):
    rows = table(spark, d, "part").select(keys.text_key(F.col("p_name")).alias("key"), F.col("p_brand").alias("value"))
    return rows.where(keys.has_prefix(F.col("key"), b"b")).groupBy(F.hex("key").alias("key"), "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_scan",
    "SELECT upper(md5('orders')) || printf('%08X', o_orderkey) AS key, o_orderpriority AS value FROM orders",
)
def schema_scan(spark, d):
    """Cells of two namespaces in one key space; one is read by its prefix range."""
    names = spark.createDataFrame([("orders",), ("spare",)], "name string").select(keys.schema_id(F.col("name")).alias("schema_id"))
    both = order_cells(spark, d).join(F.broadcast(names)).withColumn("key", F.concat("schema_id", "key")).drop("schema_id")
    import hashlib

    return shown(Scan(KeyRange.starting(b"").within(hashlib.md5(b"orders").digest())).rows(both))


@query("limit_items", f"SELECT * FROM ({_ORDERS}) WHERE key >= '00000064' ORDER BY key LIMIT 25")
def limit_items(spark, d):
    span = KeyRange.starting(A)
    return shown(Scan(span).first(25).rows(order_cells(spark, d, span)))


_BYTES = "SELECT printf('%08X', o_orderkey) AS key, o_orderpriority AS value, sum(length(o_orderpriority)) OVER (ORDER BY o_orderkey) AS used FROM orders WHERE o_orderkey BETWEEN 100 AND 4000"


@query("limit_bytes", f"SELECT key, value FROM ({_BYTES}) WHERE used <= 1000")
def limit_bytes(spark, d):
    span = KeyRange(A, B, True, True)
    return shown(Scan(span).up_to_bytes(1000).rows(order_cells(spark, d, span)))


@query("limit_kilobytes", f"SELECT key, value FROM ({_BYTES}) WHERE used <= 2000")
def limit_kilobytes(spark, d):
    from rangeweave.operators.scan import KILO

    span = KeyRange(A, B, True, True)
    return shown(Scan(span).up_to_bytes(2 * KILO).rows(order_cells(spark, d, span)))


@query("limit_flag", f"SELECT count(*) FILTER (used <= 1000) AS returned, count(*) > count(*) FILTER (used <= 1000) AS truncated FROM ({_BYTES})")
def limit_flag(spark, d):
    span = KeyRange(A, B, True, True)
    return Scan(span).up_to_bytes(1000).truncated(order_cells(spark, d, span))


@query("transform_append", "SELECT printf('%08X', o_orderkey) AS key, o_orderpriority || '!x' AS value FROM orders WHERE o_orderkey < 300")
def transform_append(spark, d):
    span = KeyRange(b"", keys.int_bytes(300))
    return shown(Scan(span).appending(b"!x").rows(order_cells(spark, d, span)))


@query("filter_values", f"SELECT * FROM ({_ORDERS}) WHERE key < '00000FA0' AND value LIKE '1%'")
def filter_values(spark, d):
    span = KeyRange(b"", B)
    return shown(Scan(span).where(lambda v: keys.has_prefix(v, b"1")).rows(order_cells(spark, d, span)))


@query("filter_tombstones", f"SELECT k AS key, v AS value FROM {VERSIONS_SQL} QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1 AND NOT dead")
def filter_tombstones(spark, d):
    return shown(C.newest(event_versions(spark, d)))


@query("asof_version", f"SELECT k AS key, v AS value FROM {VERSIONS_SQL} WHERE version <= 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1 AND NOT dead")
def asof_version(spark, d):
    return shown(C.newest(event_versions(spark, d), at=20))


@query("all_versions", f"SELECT k AS key, version, v AS value, dead AS is_tombstone FROM {VERSIONS_SQL} WHERE k >= '0000000A' AND k < '00000014'")
def all_versions(spark, d):
    span = KeyRange(keys.int_bytes(10), keys.int_bytes(20))
    rows = event_versions(spark, d).where(span.holds(F.col("key")))
    return rows.select(F.hex("key").alias("key"), "version", F.decode("value", "UTF-8").alias("value"), "is_tombstone")


@query(
    "cleanup_versions",
    f"SELECT k AS key, version, v AS value, dead AS is_tombstone FROM (SELECT *, max(version) OVER (PARTITION BY k) AS newest FROM {VERSIONS_SQL}) WHERE version > 50 OR version = newest",
)
def cleanup_versions(spark, d):
    return C.cleanup(event_versions(spark, d), 50).select(F.hex("key").alias("key"), "version", F.decode("value", "UTF-8").alias("value"), "is_tombstone")


@query("composite_key_scan", "SELECT printf('%08X', conv_id) || printf('%08X', turn) AS key, role AS value FROM conversations WHERE conv_id = 3")
def composite_key_scan(spark, d):
    rows = table(spark, d, "conversations").select(
        keys.append(keys.int_key(F.col("conv_id")), keys.int_key(F.col("turn"))).alias("key"), F.lit(0).alias("version"), F.encode("role", "UTF-8").alias("value"), F.lit(False).alias("is_tombstone")
    )
    return shown(Scan(KeyRange.prefix(keys.int_bytes(3))).rows(rows))


@query(
    "transfer_pages",
    "SELECT page, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT printf('%08X', o_orderkey) AS key, ((sum(length(o_orderpriority)) OVER (ORDER BY o_orderkey) - length(o_orderpriority)) // 4096)::BIGINT AS page FROM orders) GROUP BY page",
)
def transfer_pages(spark, d):
    rows = pages(Scan(KeyRange.starting(b"")).rows(order_cells(spark, d)).select("key", "value"), 4096)
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.hex(F.min("key")).alias("first_key"), F.hex(F.max("key")).alias("last_key"))
