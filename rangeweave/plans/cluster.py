"""Statistics, consensus, failure detection and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.operators import consensus as N
from rangeweave.operators import detection as D
from rangeweave.operators import stats as S
from rangeweave.plans.base import query, table

# statistics: a customer's nation is its vnode, the nation's region its host

_NODES = """(SELECT n_regionkey AS host, c_nationkey AS vnode, sum(length(c_name) + 8)::BIGINT AS store_size, count(*)::BIGINT AS n_keys, sum(c_custkey % 7)::BIGINT AS ops
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def _nodes(spark, d):
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.sum(F.length("c_name") + 8).alias("store_size"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("c_custkey") % 7).alias("ops")
    )
    return per.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("host"), F.col("c_nationkey").alias("vnode"), "store_size", "n_keys", "ops")


@query("vnode_stats", f"SELECT * FROM {_NODES}")
def vnode_stats(spark, d):
    return _nodes(spark, d)


@query("host_report", f"SELECT host, count(*) AS n_vnodes, sum(store_size)::BIGINT AS size, sum(n_keys)::BIGINT AS n_keys, sum(ops)::BIGINT AS ops, (sum(store_size) // count(*))::BIGINT AS avg_size, (sum(ops) // count(*))::BIGINT AS avg_ops FROM {_NODES} GROUP BY host")
def host_report(spark, d):
    return S.host_report(_nodes(spark, d), "host")


def _extremes(value, by="host"):
    part = f"PARTITION BY {by} " if by else ""
    return " UNION ALL ".join(
        f"SELECT host, vnode, {value} AS value, '{side}' AS side, row_number() OVER ({part}ORDER BY {value} {order}, vnode)::INT AS place FROM {_NODES} QUALIFY place <= {S.TOP}" for side, order in (("top", "DESC"), ("bottom", "ASC"))
    )


@query("topk_bottomk", _extremes("store_size"))
def topk_bottomk(spark, d):
    return S.extremes(_nodes(spark, d), ["host"], "store_size", "vnode").select("host", "vnode", F.col("store_size").alias("value"), "side", "place")


@query("topk_bottomk_ops", _extremes("ops", ""))
def topk_bottomk_ops(spark, d):
    return S.extremes(_nodes(spark, d), [], "ops", "vnode").select("host", "vnode", F.col("ops").alias("value"), "side", "place")


@query("cluster_avg", f"SELECT round(avg(size), 6) AS avg_size, (sum(size) // count(*))::BIGINT AS floor_size, count(*) AS n_hosts FROM (SELECT host, sum(store_size) AS size FROM {_NODES} GROUP BY host)")
def cluster_avg(spark, d):
    hosts = S.host_report(_nodes(spark, d), "host")
    return hosts.agg(F.round(F.avg("size"), 6).alias("avg_size"), S.floor_div(F.sum("size"), F.count(F.lit(1))).alias("floor_size"), F.count(F.lit(1)).alias("n_hosts"))


@query("ewma_load", f"SELECT user_id AS host, round(sum({S.ALPHA} * pow({1 - S.ALPHA}, r) * value), 6) AS ewma FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS r FROM events) GROUP BY 1")
def ewma_load(spark, d):
    return S.ewma(table(spark, d, "events").withColumnRenamed("user_id", "host"), ["host"], ["event_id"], "value").select("host", F.round("ewma", 6).alias("ewma"))


@query("load_bounds", f"SELECT vnode, store_size, CASE WHEN store_size > a * {1 + S.BOUND} THEN 'over' WHEN store_size < a * {1 - S.BOUND} THEN 'under' ELSE 'normal' END AS load FROM {_NODES}, (SELECT avg(store_size) AS a FROM {_NODES})")
def load_bounds(spark, d):
    return S.bounds(_nodes(spark, d), "store_size").select("vnode", "store_size", "load")


@query("failed_hosts", "SELECT n_nationkey AS host FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 4 <> 1)")
def failed_hosts(spark, d):
    hosts = table(spark, d, "nation").select(F.col("n_nationkey").alias("host"))
    return S.failed_hosts(hosts, table(spark, d, "customer").where("c_nationkey % 4 <> 1").select(F.col("c_nationkey").alias("host")), "host")


@query("failed_hosts_cut_off", "SELECT 'near' AS reader, n_nationkey AS host FROM nation WHERE n_nationkey % 4 = 1")
def failed_hosts_cut_off(spark, d):
    """Two readers: one misses more than half, so it is cut off and nobody failed; the other misses a quarter, which has."""
    hosts = table(spark, d, "nation").select(F.col("n_nationkey").alias("host"))
    off, near = (S.failed_hosts(hosts, hosts.where(seen), "host") for seen in ("host % 4 = 1", "host % 4 <> 1"))
    return off.select(F.lit("off").alias("reader"), "host").unionByName(near.select(F.lit("near").alias("reader"), "host"))


@query("assign_ids", "SELECT r_name AS address, CASE WHEN n <= 2 THEN [1, 3][n] ELSE 10 + n - 3 END::BIGINT AS id FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region)")
def assign_ids(spark, d):
    joining = table(spark, d, "region").select(F.col("r_name").alias("address"))
    return S.assign_ids(joining, spark.createDataFrame([(3,), (1,)], "id long"), 10).select("address", F.col("id").cast("bigint").alias("id"))


@query("balance_swaps", f"WITH h AS (SELECT host, sum(store_size) AS size FROM {_NODES} GROUP BY host), r AS (SELECT host, size, row_number() OVER (ORDER BY size DESC, host) AS t, row_number() OVER (ORDER BY size, host) AS b FROM h) SELECT x.t::INT AS place, x.host AS from_host, y.host AS to_host FROM r x JOIN r y ON x.t = y.b WHERE x.size > y.size AND x.t <= 5")
def balance_swaps(spark, d):
    return S.swaps(S.host_report(_nodes(spark, d), "host"), "size").select("place", "from_host", "to_host")


@query("rse_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, round(stddev_samp(value) / sqrt(count(*)) / avg(value), 6) AS rse FROM events GROUP BY 1 HAVING count(*) > 10")
def rse_stats(spark, d):
    stats = S.relative_error(F.col("value"))
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(c, 6).alias(k) for k, c in stats.items()])
    return rows.where("n > 10").drop("n")


# consensus: ten messages an instance, five acceptors, two ballots

_VOTES = """(SELECT event_id // 10 AS instance, 1 + event_id % 10 // 5 AS ballot, CASE WHEN value < 60 THEN 'v' || event_id // 10 % 3 ELSE event_type END AS value,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END AS view, event_id % 5 AS acceptor FROM events)"""
_DECIDED = f"""(SELECT instance, ballot, value FROM (SELECT instance, ballot, value, count(DISTINCT acceptor) AS n FROM {_VOTES} WHERE view = 1 GROUP BY 1, 2, 3) WHERE n >= 3
  QUALIFY row_number() OVER (PARTITION BY instance ORDER BY ballot DESC, value) = 1)"""


def _votes(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    instance = F.floor(i / 10)
    value = F.when(F.col("value") < 60, F.concat(F.lit("v"), (instance % 3).cast("string"))).otherwise(F.col("event_type"))
    return e.select(
        instance.alias("instance"), (1 + F.floor(i % 10 / 5)).alias("ballot"), value.alias("value"), F.when(i % 97 == 0, 0).otherwise(1).alias("view"), (i % 5).alias("acceptor")
    )


@query("quorum_decide", f"SELECT * FROM {_DECIDED}")
def quorum_decide(spark, d):
    return N.decisions(_votes(spark, d), 5, 1)


@query("quorum_apply", f"SELECT instance, value FROM {_DECIDED} WHERE instance >= 5 AND instance < coalesce((SELECT min(i) FROM range(5, 1000000) t(i) WHERE i NOT IN (SELECT instance FROM {_DECIDED})), 5)")
def quorum_apply(spark, d):
    return N.applied(N.decisions(_votes(spark, d), 5, 1), 5).select("instance", "value")


@query("prepare_recovery", f"SELECT i AS instance, coalesce(value, 'noop') AS value FROM range(5, (SELECT max(instance) + 1 FROM {_DECIDED})) t(i) LEFT JOIN {_DECIDED} ON i = instance")
def prepare_recovery(spark, d):
    return N.recovery(N.decisions(_votes(spark, d), 5, 1), 5)


_VIEWS = "(SELECT n_regionkey AS rep_set, n_nationkey AS view, [n_nationkey % 4, 4 + n_nationkey % 3, 7 + n_nationkey % 2] AS members FROM nation)"


def _views(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("rep_set"), n.alias("view"), F.array(n % 4, 4 + n % 3, 7 + n % 2).alias("members"))


@query(
    "view_change",
    f"""SELECT rep_set, view, array_to_string(members, ',') AS members, array_to_string(list_sort(list_filter(members, lambda x: NOT list_contains(before, x))), ',') AS added,
  array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(members, x))), ',') AS removed
FROM (SELECT *, coalesce(lag(members) OVER (PARTITION BY rep_set ORDER BY view), []) AS before, row_number() OVER (PARTITION BY rep_set ORDER BY view DESC) AS n FROM {_VIEWS}) WHERE n = 1""",
)
def view_change(spark, d):
    return N.current_view(_views(spark, d), "rep_set").select("rep_set", "view", *[F.array_join(c, ",").alias(c) for c in ("members", "added", "removed")])


@query("leader_election", "SELECT n_regionkey AS rep_set, min(n_name) AS leader FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1")
def leader_election(spark, d):
    members = table(spark, d, "nation").select(F.col("n_regionkey").alias("rep_set"), F.col("n_name").alias("address"), "n_nationkey")
    return N.leaders(members, members.where("n_nationkey % 3 = 0").select("rep_set", "address"), "rep_set", "address")


@query("request_validation", "SELECT event_id AS op_id FROM events WHERE event_type IN ('error', 'view') OR value < 1")
def request_validation(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_id", "op_id")
    answers = e.where("event_type <> 'view' AND value >= 1").select("op_id", F.when(F.col("event_type") == "error", "UNSUPPORTED_OP").otherwise("SUCCESS").alias("code"))
    return N.unanswered(e.select("op_id"), answers, "op_id")


@query("range_validation", "SELECT printf('%08X', o_orderkey) AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'extra' ELSE 'lost' END AS side FROM orders WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0)")
def range_validation(spark, d):
    from rangeweave.plans.base import order_cells

    cells = order_cells(spark, d).select("key", F.conv(F.hex("key"), 16, 10).cast("long").alias("i"))
    return N.range_mismatch(cells.where("i % 13 <> 0").select(F.hex("key").alias("key")), cells.where("i % 11 <> 0").select(F.hex("key").alias("key")))


@query(
    "broadcast_check",
    """WITH p AS (SELECT event_id AS value FROM events WHERE event_id % 50 <> 3), dd AS (SELECT node, event_id // 1000 AS epoch, CASE WHEN node = 2 AND event_id % 40 IN (10, 11) THEN event_id // 40 * 40 + 21 - event_id % 40 ELSE event_id % 1000 + event_id // 1000 * 1000 END AS seq, event_id AS value FROM events, (SELECT unnest([0, 1, 2]) AS node) WHERE NOT (node = 1 AND event_id // 1000 = 1 AND event_id % 1000 >= 990) AND NOT (node = 0 AND event_id // 1000 = 2 AND event_id % 1000 >= 500)),
s AS (SELECT epoch, value, row_number() OVER (PARTITION BY node, epoch ORDER BY seq, value) AS slot FROM dd)
SELECT 'not proposed' AS fault, epoch, value FROM (SELECT DISTINCT epoch, value FROM dd) WHERE value NOT IN (SELECT value FROM p)
UNION ALL SELECT 'order', epoch, min(value) FROM s GROUP BY epoch, slot HAVING count(DISTINCT value) > 1
UNION ALL SELECT 'not decided', epoch, value FROM dd GROUP BY epoch, value HAVING count(DISTINCT CASE WHEN NOT (node = 0 AND epoch = 2) THEN node END) < CASE WHEN epoch = 2 THEN 2 ELSE 3 END""",
)
def broadcast_check(spark, d):
    """Three nodes; the third swaps two neighbours in forty; some values were never proposed; the second stops near the end
    of epoch 1 without having failed, the first fails in epoch 2."""
    e = table(spark, d, "events").select(F.col("event_id").alias("value"))
    v = F.col("value")
    decided = e.withColumn("node", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    decided = decided.where("NOT (node = 1 AND value BETWEEN 1990 AND 1999) AND NOT (node = 0 AND value BETWEEN 2500 AND 2999)")
    swapped = F.when((F.col("node") == 2) & (v % 40).isin(10, 11), F.floor(v / 40) * 40 + 21 - v % 40).otherwise(v)
    decided = decided.select("node", F.floor(v / 1000).alias("epoch"), swapped.alias("seq"), "value")
    return N.broadcast_faults(e.where("value % 50 <> 3"), decided, spark.createDataFrame([(0, 2)], "node int, epoch long"))


# round trips, failures, transfers

_RTT = f"""(SELECT *, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS {D.SAMPLES - 1} PRECEDING))"""


@query(
    "rtt_window",
    f"SELECT user_id AS host, event_id, round(mean, 9) AS mean, round(var, 4) AS var, round(greatest(50, mean + {D.STD_FACTOR} * sqrt(var)), 4) AS rto FROM (SELECT *, avg(pow(mean - value, 2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS {D.SAMPLES - 1} PRECEDING) AS var FROM {_RTT})",
)
def rtt_window(spark, d):
    rows = D.rtt_window(table(spark, d, "events").withColumnRenamed("user_id", "host"), "host", "event_id", "value", 50.0)
    return rows.select("host", "event_id", F.round("mean", 9).alias("mean"), F.round("var", 4).alias("var"), F.round("rto", 4).alias("rto"))


@query(
    "rtt_alltime",
    f"""SELECT host, round(s.mean, 6) AS mean, round(s.dev, 6) AS deviation, round(greatest(50, s.mean + {D.STD_FACTOR} * s.dev), 6) AS rto FROM (SELECT user_id AS host,
  list_reduce(list({{'mean': value, 'dev': 0.0::DOUBLE}} ORDER BY event_id), lambda a, x: {{'mean': {1 - D.MEAN_RATE}::DOUBLE * a.mean + {D.MEAN_RATE}::DOUBLE * x.mean, 'dev': {1 - D.DEVIATION_RATE}::DOUBLE * a.dev + {D.DEVIATION_RATE}::DOUBLE * abs(a.mean - x.mean)}}) AS s FROM events GROUP BY 1)""",
)
def rtt_alltime(spark, d):
    out = D.rtt_all_time(table(spark, d, "events").withColumnRenamed("user_id", "host"), "host", "event_id", "value", 50.0)
    return out.select("host", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "rto")])


_BEATS = "(SELECT DISTINCT user_id AS host, event_id // 300 AS period FROM events)"


@query(
    "suspicions",
    f"""WITH s AS (SELECT *, lag(period) OVER w AS before, lead(period) OVER w AS after FROM {_BEATS} WINDOW w AS (PARTITION BY host ORDER BY period)), e AS (SELECT min(period) AS a, max(period) AS b FROM {_BEATS})
SELECT host, period + 2 AS period, 'failed' AS event FROM s, e WHERE coalesce(after, 1000000000) > period + 2 AND period + 2 <= b
UNION ALL SELECT host, period, 'restored' FROM s, e WHERE CASE WHEN before IS NULL THEN period > a ELSE before < period - 2 END""",
)
def suspicions(spark, d):
    return D.suspicions(table(spark, d, "events").select(F.col("user_id").alias("host"), F.floor(F.col("event_id") / 300).alias("period")), "host", "period")


@query("late_answers", "SELECT host, event_id, gap FROM (SELECT user_id AS host, event_id, (event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id))::DOUBLE AS gap FROM events) WHERE gap > 400 + host")
def late_answers(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("host"), "event_id")
    return D.late_answers(beats, "host", "event_id", beats.select("host", (F.lit(400.0) + F.col("host")).alias("rto")).distinct())


@query("transfer_stats", "SELECT event_type AS protocol, sum(length(props))::BIGINT AS bytes, sum(event_id % 9 + 1)::BIGINT AS millis, round(sum(length(props))::DOUBLE / sum(event_id % 9 + 1) * 1000 / 1024, 6) AS kb_per_s FROM events GROUP BY 1")
def transfer_stats(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("protocol"), F.length("props").cast("long").alias("n"), (F.col("event_id") % 9 + 1).alias("ms"))
    return D.throughput(rows, ["protocol"], "n", "ms").withColumn("kb_per_s", F.round("kb_per_s", 6))
