"""Sizes, scans that write, batches, and replay of the operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange
from rangeweave.operators import cells as C
from rangeweave.operators import log as L
from rangeweave.operators.scan import Scan
from rangeweave.plans.base import VERSIONS_SQL, event_log, event_versions, order_cells, query, shown, table

_MID = KeyRange(keys.int_bytes(100), keys.int_bytes(4000), True, True)


@query("size_scan", "SELECT sum(4 + 4 + length(o_orderpriority))::BIGINT AS size, count(*) AS n_keys FROM orders WHERE o_orderkey BETWEEN 100 AND 4000")
def size_scan(spark, d):
    return C.size_scan(order_cells(spark, d, _MID), span=_MID)


@query("size_scan_versions", f"SELECT (sum(4 + coalesce(length(v), 0)) + 4 * count(DISTINCT k))::BIGINT AS size, count(DISTINCT k) AS n_keys FROM {VERSIONS_SQL}")
def size_scan_versions(spark, d):
    return C.size_scan(event_versions(spark, d))


@query("size_per_vnode", "SELECT c_nationkey AS vnode, sum(4 + 4 + length(c_name))::BIGINT AS size, count(*) AS n_keys FROM customer GROUP BY 1")
def size_per_vnode(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("vnode"), keys.int_key(F.col("c_custkey")).alias("key"), F.encode("c_name", "UTF-8").alias("value"))
    return C.size_scan(rows, ["vnode"])


@query("size_scan_bulk", "SELECT l_returnflag AS part, count(*) AS n_rows, sum(8 + 4 + length(l_shipmode_or_flag))::BIGINT AS size FROM (SELECT l_returnflag, l_returnflag || l_linestatus AS l_shipmode_or_flag FROM lineitem) GROUP BY 1")
def size_scan_bulk(spark, d):
    rows = table(spark, d, "lineitem")
    key = keys.append(keys.int_key(F.col("l_orderkey")), keys.int_key(F.col("l_linenumber")))
    value = F.encode(F.concat("l_returnflag", "l_linestatus"), "UTF-8")
    return rows.groupBy(F.col("l_returnflag").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(key) + C.raw_size(value)).alias("size"))


_DIFFS = """(SELECT user_id AS vnode, event_id AS seq, CASE WHEN event_type = 'error' THEN -10 ELSE length(props) END::BIGINT AS size,
  CASE WHEN event_type = 'error' THEN -1 ELSE 1 END::BIGINT AS n_keys, event_type = 'signup' AS reset FROM events)"""


def _diffs(spark, d):
    e = table(spark, d, "events")
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("vnode"), F.col("event_id").alias("seq"), F.when(bad, -10).otherwise(F.length("props")).cast("bigint").alias("size"),
        F.when(bad, -1).otherwise(1).cast("bigint").alias("n_keys"), (F.col("event_type") == "signup").alias("reset"),
    )


@query(
    "diff_fold",
    f"""SELECT vnode, seq, sum(size) OVER w::BIGINT AS store_size, sum(n_keys) OVER w::BIGINT AS store_keys FROM (SELECT *, sum(reset::INT) OVER (PARTITION BY vnode ORDER BY seq) AS epoch FROM {_DIFFS})
  WINDOW w AS (PARTITION BY vnode, epoch ORDER BY seq)""".replace("OVER w::BIGINT", "OVER w"),
)
def diff_fold(spark, d):
    out = C.diff_fold(_diffs(spark, d), "seq", ["vnode"])
    return out.select("vnode", "seq", "store_size", "store_keys")


@query(
    "diff_total",
    f"""WITH x AS (SELECT * FROM {_DIFFS}), r AS (SELECT vnode, max(seq) AS at FROM x WHERE reset GROUP BY vnode)
SELECT x.vnode, sum(size)::BIGINT AS store_size, sum(n_keys)::BIGINT AS store_keys FROM x LEFT JOIN r ON x.vnode = r.vnode WHERE r.at IS NULL OR seq >= r.at GROUP BY x.vnode""",
)
def diff_total(spark, d):
    return C.snapshot_total(_diffs(spark, d), "seq", ["vnode"])


@query("range_delete", "SELECT printf('%08X', o_orderkey) AS key, o_orderpriority AS value FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 4000)")
def range_delete(spark, d):
    cells = order_cells(spark, d)
    return shown(C.newest(cells.unionByName(Scan(_MID).delete(cells, 1))))


@query("full_delete", f"SELECT k AS key, version FROM {VERSIONS_SQL} WHERE NOT (k >= '0000000A' AND k < '00000014')")
def full_delete(spark, d):
    rest = C.full_delete(event_versions(spark, d), KeyRange(keys.int_bytes(10), keys.int_bytes(20)))
    return rest.select(F.hex("key").alias("key"), "version")


@query(
    "write_back",
    "SELECT printf('%08X', o_orderkey) AS key, CASE WHEN o_orderkey BETWEEN 100 AND 4000 THEN upper(o_orderpriority) || '+' ELSE o_orderpriority END AS value FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 4000 AND o_orderpriority LIKE '5%')",
)
def write_back(spark, d):
    """A transformation to null deletes."""
    cells = order_cells(spark, d)
    changed = Scan(_MID).map(lambda v: F.when(~keys.has_prefix(v, b"5"), F.encode(F.concat(F.upper(F.decode(v, "UTF-8")), F.lit("+")), "UTF-8")))
    return shown(C.newest(cells.unionByName(changed.write_back(cells, 1))))


@query("range_action_diff", "SELECT -sum(4 + length(o_orderpriority))::BIGINT AS size, -count(*) AS n_keys FROM orders WHERE o_orderkey BETWEEN 100 AND 4000")
def range_action_diff(spark, d):
    return Scan(_MID).diff(order_cells(spark, d, _MID), delete=True)


@query(
    "batch_merge",
    "SELECT printf('%08X', coalesce(o_orderkey, s_suppkey)) AS key, coalesce(s_name, o_orderpriority) AS value FROM orders FULL JOIN supplier ON o_orderkey = s_suppkey * 3 WHERE coalesce(s_suppkey % 10, 1) <> 0".replace("coalesce(o_orderkey, s_suppkey)", "coalesce(o_orderkey, s_suppkey * 3)"),
)
def batch_merge(spark, d):
    """A batch of puts, and of deletes where the value is null."""
    batch = table(spark, d, "supplier").select(keys.int_key(F.col("s_suppkey") * 3).alias("key"), F.when(F.col("s_suppkey") % 10 != 0, F.encode("s_name", "UTF-8")).alias("value"))
    return shown(C.newest(C.merge(order_cells(spark, d), batch, 1)))


_PUTS = "(SELECT *, printf('%08X', user_id) AS k FROM events)"


@query("log_last_write", f"SELECT k AS key, event_type || ':' || event_id AS value FROM {_PUTS} WHERE event_type IN ('view', 'click', 'error') QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def log_last_write(spark, d):
    return shown(L.last_write(event_log(spark, d)))


def _replayed(kinds: str) -> str:
    return f"""WITH e AS (SELECT *, printf('%08X', user_id) AS k FROM events WHERE event_type IN ({kinds})),
c AS (SELECT k, max(event_id) AS cut FROM e WHERE event_type IN ('view', 'click', 'error') GROUP BY k),
r AS (SELECT e.* FROM e LEFT JOIN c ON e.k = c.k WHERE c.cut IS NULL OR event_id >= c.cut),
b AS (SELECT k, min(event_id) AS base FROM r WHERE event_type IN ('view', 'click', 'signup') GROUP BY k)
SELECT r.k AS key, string_agg(event_type || ':' || event_id, '' ORDER BY event_id) AS value FROM r JOIN b ON r.k = b.k
WHERE event_id = base OR (event_type = 'purchase' AND event_id > base) GROUP BY r.k"""


@query("log_put_if_absent", _replayed("'view', 'click', 'error', 'signup'"))
def log_put_if_absent(spark, d):
    return shown(L.replay(event_log(spark, d).where("op <> 'append'")))


@query("log_append", _replayed("'view', 'click', 'error', 'signup', 'purchase'"))
def log_append(spark, d):
    return shown(L.replay(event_log(spark, d)))


@query("log_fold", _replayed("'view', 'click', 'error', 'signup', 'purchase'"))
def log_fold(spark, d):
    """The same state by the general fold."""
    return shown(L.fold(event_log(spark, d)))


@query(
    "log_cas",
    """SELECT key, value FROM (SELECT printf('%08X', user_id) AS key, list_reduce(list_prepend('', list(event_type ORDER BY event_id)), lambda a, x:
  CASE WHEN x = 'view' THEN 'view' WHEN x = 'error' THEN '' WHEN x = 'signup' AND a = '' THEN 'signup' WHEN x = 'click' AND a = 'view' THEN 'click'
       WHEN x = 'purchase' AND a = 'click' THEN 'purchase' ELSE a END) AS value FROM events GROUP BY user_id) WHERE value <> ''""",
)
def log_cas(spark, d):
    """view puts, error deletes, signup needs an absent key, click needs view, purchase needs click."""
    e = table(spark, d, "events")
    kind, t = F.create_map(*[F.lit(x) for x in ("view", "put", "error", "delete", "signup", "cas", "click", "cas", "purchase", "cas")]), F.col("event_type")
    expected = F.when(t == "click", "view").when(t == "purchase", "click")
    log = e.select(
        F.col("event_id").alias("pos"), keys.int_key(F.col("user_id")).alias("key"), F.element_at(kind, t).alias("op"), F.encode(t, "UTF-8").alias("value"), F.encode(expected, "UTF-8").alias("expected")
    )
    return shown(L.fold(log))


def multi_op_log(spark, d):
    """An operation per event on two keys of a vnode: if the user's key holds nothing but what a view wrote, both are
    written; else the user's key is deleted."""
    e = table(spark, d, "events")

    def pair(k, v):
        return F.struct(k.alias("key"), v.alias("value"))

    own, other = keys.int_key(F.col("user_id")), keys.int_key(F.col("user_id") + 1_000_000)
    t = F.encode("event_type", "UTF-8")
    needs = F.when(F.col("event_type") == "purchase", F.encode(F.lit("view"), "UTF-8"))
    return e.select(
        F.col("event_id").alias("pos"), (F.col("user_id") % 8).alias("vnode"), F.array(pair(own, needs)).alias("conditions"),
        F.array(pair(own, t), pair(other, t)).alias("success"), F.array(pair(own, F.lit(None).cast("binary"))).alias("failure"),
    )


@query(
    "log_multiop",
    """WITH f AS (SELECT user_id, list_reduce(list_prepend({'a': '', 'b': ''}, list({'a': event_type, 'b': event_type} ORDER BY event_id)), lambda s, x:
  CASE WHEN s.a = CASE WHEN x.a = 'purchase' THEN 'view' ELSE '' END THEN x ELSE {'a': '', 'b': s.b} END) AS s FROM events GROUP BY user_id)
SELECT printf('%08X', user_id) AS key, s.a AS value FROM f WHERE s.a <> '' UNION ALL SELECT printf('%08X', user_id + 1000000), s.b FROM f WHERE s.b <> ''""",
)
def log_multiop(spark, d):
    return shown(L.written(L.multi_ops(multi_op_log(spark, d))))


_GAPPY = "(SELECT event_id AS pos FROM events WHERE event_id % 97 <> 96)"


def _gappy(spark, d):
    return event_log(spark, d).where("pos % 97 <> 96")


@query("log_contiguous", f"SELECT pos FROM {_GAPPY} WHERE pos >= 10 AND pos < 96")
def log_contiguous(spark, d):
    return L.contiguous(_gappy(spark, d), 10).select("pos")


@query("log_gaps", f"SELECT pos + 1 AS low, nxt - 1 AS high FROM (SELECT pos, lead(pos) OVER (ORDER BY pos) AS nxt FROM (SELECT pos FROM {_GAPPY} WHERE pos >= 10 UNION ALL SELECT 9)) WHERE nxt > pos + 1")
def log_gaps(spark, d):
    return L.gaps(_gappy(spark, d), 10)


@query("log_fill_noop", "SELECT event_id AS pos, CASE WHEN event_id % 97 = 96 THEN 'noop' ELSE CASE event_type WHEN 'view' THEN 'put' WHEN 'click' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'put_if_absent' ELSE 'append' END END AS op FROM events WHERE event_id >= 10 AND event_id <= (SELECT max(event_id) FROM events WHERE event_id % 97 <> 96)")
def log_fill_noop(spark, d):
    return L.fill_gaps(_gappy(spark, d), 10)


@query("log_prune", "SELECT count(*) AS n, min(event_id) AS low FROM events WHERE event_id > 500")
def log_prune(spark, d):
    return L.pruned(event_log(spark, d), 500).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"))


@query("log_since_snapshot", f"SELECT k AS key, CASE WHEN event_type <> 'error' THEN event_type || ':' || event_id END AS value, event_type = 'error' AS is_tombstone FROM {_PUTS} WHERE event_id > 500 AND event_type IN ('view', 'click', 'error') QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1")
def log_since_snapshot(spark, d):
    return L.since_snapshot(event_log(spark, d), 500).select(F.hex("key").alias("key"), F.decode("value", "UTF-8").alias("value"), "is_tombstone")


@query("log_dedupe", "SELECT user_id AS op_id, min(event_id) AS pos FROM events GROUP BY 1")
def log_dedupe(spark, d):
    """Each id's first position counts."""
    log = table(spark, d, "events").select(F.col("user_id").alias("op_id"), F.col("event_id").alias("pos"))
    return L.deduplicated(log, "op_id")
