"""Key algebra, ranges as data, and routing to vnodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions import ranges as R
from rangeweave.operators import catalog as K
from rangeweave.operators import log as L
from rangeweave.plans.base import order_cells, query, table

# key algebra

_KEYS = "(SELECT DISTINCT printf('%08X', x) AS k FROM (SELECT o_orderkey * 257 % 65536 AS x FROM orders UNION ALL SELECT unnest([255, 65535, 16777215, 4294967295])))"


def _keys(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") * 257 % 65536).alias("x"))
    more = spark.createDataFrame([(255,), (65535,), (16777215,), (4294967295,)], "x long")
    return rows.union(more).distinct().select(keys.int_key(F.col("x")).alias("key"))


@query("key_inc", f"SELECT k AS key, CASE WHEN k <> 'FFFFFFFF' THEN printf('%08X', ('0x' || k)::BIGINT + 1) END AS next FROM {_KEYS}")
def key_inc(spark, d):
    return _keys(spark, d).select(F.hex("key").alias("key"), F.hex(keys.inc(F.col("key"))).alias("next"))


@query("key_hex", f"SELECT k[1:2] || ' ' || k[3:4] || ' ' || k[5:6] || ' ' || k[7:8] AS shown, k AS parsed, ('0x' || k[1:2])::INT AS first_byte, 4::BIGINT AS size, ('0x' || k)::BIGINT - CASE WHEN k >= '80000000' THEN 4294967296 ELSE 0 END AS number FROM {_KEYS}")
def key_hex(spark, d):
    k = F.col("key")
    return _keys(spark, d).select(keys.show(k).alias("shown"), F.hex(keys.from_hex(keys.show(k))).alias("parsed"), keys.first_byte(k).alias("first_byte"), keys.size(k).alias("size"), keys.int_value(k).alias("number"))


@query("key_hash_id", "SELECT n_name AS name, upper(md5(n_name)) AS id FROM nation UNION ALL SELECT 'test', '098F6BCD4621D373CADE4E832627B4F6'")
def key_hash_id(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("test",)], "name string"))
    return names.select("name", F.hex(keys.schema_id(F.col("name"))).alias("id"))


@query("key_compare", "SELECT a.p_brand AS a, b.r_name AS b, CASE WHEN a.p_brand < b.r_name THEN -1 WHEN a.p_brand > b.r_name THEN 1 ELSE 0 END AS sign FROM part a JOIN region b ON a.p_size % 5 = b.r_regionkey GROUP BY 1, 2")
def key_compare(spark, d):
    a, b = table(spark, d, "part"), table(spark, d, "region")
    pairs = a.join(b, F.col("p_size") % 5 == F.col("r_regionkey")).select(F.col("p_brand").alias("a"), F.col("r_name").alias("b")).distinct()
    return pairs.select("a", "b", keys.compare(keys.text_key(F.col("a")), keys.text_key(F.col("b"))).alias("sign"))


@query("key_prepend", "SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN '00AA' || printf('%08X', n_nationkey) ELSE '00AB' END AS stop FROM nation")
def key_prepend(spark, d):
    end = F.when(F.col("n_nationkey") % 2 == 0, keys.int_key(F.col("n_nationkey")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.hex(keys.prepend(end, keys.literal(b"\0\xaa"))).alias("stop"))


@query("interval_distance", "SELECT event_id, CASE WHEN hi < lo2 THEN hi - lo2 WHEN lo > hi2 THEN lo - hi2 ELSE 0 END AS gap FROM (SELECT event_id, user_id AS lo, user_id + 20 AS hi, event_id % 100 AS lo2, event_id % 100 + 30 AS hi2 FROM events)")
def interval_distance(spark, d):
    u, e = F.col("user_id"), F.col("event_id") % 100
    return table(spark, d, "events").select("event_id", keys.interval_gap(u, u + 20, e, e + 30).alias("gap"))


# ranges as data: a nation's range against its region's

_PAIRS = """(SELECT n_nationkey AS n, n_nationkey * 600 AS ab, n_nationkey % 2 = 0 AS ac, n_nationkey * 600 + 900 AS ae, n_nationkey % 3 = 0 AS ad,
  n_regionkey * 3000 AS bb, n_regionkey % 2 = 1 AS bc, CASE WHEN n_regionkey = 4 THEN NULL ELSE n_regionkey * 3000 + 3000 END AS be, n_regionkey % 2 = 0 AS bd FROM nation)"""
_LOW = "CASE WHEN ab > bb THEN ab ELSE bb END"
_HIGH = "CASE WHEN be IS NULL OR ae < be THEN ae ELSE be END"
_LC = "CASE WHEN ab = bb THEN ac AND bc WHEN ab > bb THEN ac ELSE bc END"
_HC = "CASE WHEN ae = be THEN ad AND bd WHEN be IS NULL OR ae < be THEN ad ELSE bd END"
_NONE = f"({_LOW} > {_HIGH} OR ({_LOW} = {_HIGH} AND NOT ({_LC} AND {_HC})))"


def _pairs(spark, d):
    n, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    a = R.struct(keys.int_key(n * 600), n % 2 == 0, keys.int_key(n * 600 + 900), n % 3 == 0)
    b = R.struct(keys.int_key(r * 3000), r % 2 == 1, F.when(r != 4, keys.int_key(r * 3000 + 3000)), r % 2 == 0)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), a.alias("a"), b.alias("b"))


@query("range_overlap", f"SELECT n, NOT {_NONE} AS meets FROM {_PAIRS}")
def range_overlap(spark, d):
    return _pairs(spark, d).select("n", R.overlaps(F.col("a"), F.col("b")).alias("meets"))


@query(
    "range_intersect",
    f"SELECT n, CASE WHEN {_NONE} THEN '(00,00)' ELSE CASE WHEN {_LC} THEN '[' ELSE '(' END || printf('%08X', {_LOW}) || ',' || printf('%08X', {_HIGH}) || CASE WHEN {_HC} THEN ']' ELSE ')' END END AS common FROM {_PAIRS}",
)
def range_intersect(spark, d):
    return _pairs(spark, d).select("n", R.text(R.intersect(F.col("a"), F.col("b"))).alias("common"))


@query(
    "range_contains",
    f"SELECT n, (bb < ab OR (bb = ab AND (bc OR NOT ac))) AND (be IS NULL OR ae < be OR (ae = be AND (bd OR NOT ad))) AS inside, (ab < 1200 OR (ab = 1200 AND ac)) AND (1200 < ae OR (1200 = ae AND ad)) AS holds FROM {_PAIRS}",
)
def range_contains(spark, d):
    return _pairs(spark, d).select("n", R.contains_range(F.col("b"), F.col("a")).alias("inside"), R.contains_key(F.col("a"), keys.literal(keys.int_bytes(1200))).alias("holds"))


@query("range_order", f"SELECT n, row_number() OVER (ORDER BY n // 2, NOT ac, ae, ad, n) AS place FROM {_PAIRS}")
def range_order(spark, d):
    from pyspark.sql import Window

    n = F.col("n_nationkey").cast("long")
    r = R.struct(keys.int_key(F.floor(n / 2)), n % 2 == 0, keys.int_key(n * 600 + 900), n % 3 == 0)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), r.alias("r"))
    return rows.select("n", F.row_number().over(Window.orderBy(*R.order(F.col("r")), "n")).cast("bigint").alias("place"))


# routing: a vnode per nation, namespaces one by one; hosts are regions

_ID = b"\x42"


def _vnodes(spark, d):
    """In namespace 42: a vnode every 600 keys from 0, dealt over five replication sets."""
    n = F.col("n_nationkey").cast("long")
    start = F.when(n == 0, keys.literal(_ID)).otherwise(F.concat(keys.literal(_ID), keys.int_key(n * 600)))
    return table(spark, d, "nation").select(keys.literal(_ID).alias("schema_id"), start.alias("start"), F.col("n_regionkey").alias("rep_set"))


_VNODES = "(SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '42' ELSE '42' || printf('%08X', n_nationkey * 600) END AS start, n_regionkey AS rep_set FROM nation)"


def _rep_sets(spark, d):
    r = F.col("r_regionkey")
    return table(spark, d, "region").select(r.alias("rep_set"), F.array(r, (r + 1) % 5, (r + 2) % 5).alias("members"))


def _hosts(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("host"), F.concat(F.lower("r_name"), F.lit(":5555")).alias("address"))


def _routed(spark, d, most=K.BROADCAST_VNODES):
    rows = order_cells(spark, d).select(F.concat(keys.literal(_ID), F.col("key")).alias("key"))
    other = spark.createDataFrame([(bytearray(b"\x43\0"),), (bytearray(b"\x41"),)], "key binary")
    return K.route(rows.union(other), _vnodes(spark, d), most=most)


_ROUTED = f"(SELECT k AS key, start, rep_set FROM (SELECT '42' || printf('%08X', o_orderkey) AS k, least(o_orderkey // 600, 24) AS v FROM orders) JOIN {_VNODES} ON v = n_nationkey)"


@query("route_keys", f"SELECT * FROM {_ROUTED}")
def route_keys(spark, d):
    return _routed(spark, d).select(F.hex("key").alias("key"), F.hex("start").alias("start"), "rep_set")


@query("route_keys_joined", f"SELECT * FROM {_ROUTED}")
def route_keys_joined(spark, d):
    """The plan for more vnodes than are broadcast."""
    return _routed(spark, d, most=0).select(F.hex("key").alias("key"), F.hex("start").alias("start"), "rep_set")


_TEST = "098F6BCD4621D373CADE4E832627B4F6"
_SCATTERED = "(SELECT event_id, event_id * 2654435761 % 4294967296 AS x FROM events)"


@query("route_keys_many", f"SELECT event_id, '{_TEST}' || CASE WHEN least(x // 858993, 4999) = 0 THEN '' ELSE printf('%08X', least(x // 858993, 4999) * 858993) END AS start, least(x // 858993, 4999) % 5 AS rep_set FROM {_SCATTERED}")
def route_keys_many(spark, d):
    """Five thousand vnodes of one namespace."""
    own, k = keys.literal(bytes.fromhex(_TEST)), F.col("id")
    start = F.when(k == 0, own).otherwise(F.concat(own, keys.int_key(k * 858993)))
    vnodes = spark.range(5000).select(own.alias("schema_id"), start.alias("start"), (k % 5).alias("rep_set"))
    x = F.col("event_id") * 2654435761 % 4294967296
    rows = table(spark, d, "events").select("event_id", F.concat(own, keys.int_key(x)).alias("key"))
    return K.route(rows, vnodes).select("event_id", F.hex("start").alias("start"), "rep_set")


@query("responsibility", f"SELECT start, coalesce(lead(start) OVER (ORDER BY start), '43') AS stop, rep_set FROM {_VNODES}")
def responsibility(spark, d):
    return K.responsibilities(_vnodes(spark, d)).select(F.hex("start").alias("start"), F.hex("end").alias("stop"), "rep_set")


_SPANS = "(SELECT r_regionkey AS r, r_regionkey * 3000 + 100 AS b, r_regionkey * 3000 + 2000 AS e FROM region)"
_PARTS = f"""(SELECT r, n_nationkey, start, rep_set, greatest(b, n_nationkey * 600) AS lo, least(e, CASE WHEN n_nationkey = 24 THEN e ELSE n_nationkey * 600 + 600 END) AS hi,
  e < n_nationkey * 600 + 600 OR n_nationkey = 24 AS own_end FROM {_SPANS} JOIN {_VNODES} ON n_nationkey * 600 <= e AND (n_nationkey = 24 OR n_nationkey * 600 + 600 > b))"""


def _spans(spark, d):
    r = F.col("r_regionkey").cast("long")
    span = R.struct(F.concat(keys.literal(_ID), keys.int_key(r * 3000 + 100)), F.lit(True), F.concat(keys.literal(_ID), keys.int_key(r * 3000 + 2000)), F.lit(True))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("r"), keys.literal(_ID).alias("schema_id"), span.alias("span"))


@query("range_split", f"SELECT r, start, rep_set, '[42' || printf('%08X', lo) || ',42' || printf('%08X', hi) || CASE WHEN own_end THEN ']' ELSE ')' END AS part FROM {_PARTS}")
def range_split(spark, d):
    return K.split(_spans(spark, d), _vnodes(spark, d)).select("r", F.hex("start").alias("start"), "rep_set", R.text(F.col("part")).alias("part"))


@query("range_first_part", f"SELECT r, start, '[42' || printf('%08X', lo) || ',42' || printf('%08X', hi) || CASE WHEN own_end THEN ']' ELSE ')' END AS part FROM {_PARTS} QUALIFY row_number() OVER (PARTITION BY r ORDER BY n_nationkey) = 1")
def range_first_part(spark, d):
    return K.first_part(_spans(spark, d), _vnodes(spark, d), "r").select("r", F.hex("start").alias("start"), R.text(F.col("part")).alias("part"))


def _answered(spark, d):
    """The parts that came back: those of vnodes 11 (inside a span) and 23 (at a span's end) are missing."""
    lost = [keys.literal(_ID + keys.int_bytes(600 * n)) for n in (11, 23)]
    return K.split(_spans(spark, d), _vnodes(spark, d)).where(~F.col("start").isin(*lost))


@query("range_coverage", "SELECT r_regionkey AS r, r_regionkey NOT IN (2, 4) AS complete FROM region")
def range_coverage(spark, d):
    return K.covered(_answered(spark, d), "r")


@query("range_uncovered", "SELECT 2 AS r, '[42' || printf('%08X', 6600) || ',42' || printf('%08X', 7200) || ')' AS part UNION ALL SELECT 4, '[42' || printf('%08X', 13800) || ',42' || printf('%08X', 14000) || ']'")
def range_uncovered(spark, d):
    return K.uncovered(_spans(spark, d), _answered(spark, d), "r").select("r", R.text(F.col("part")).alias("part"))


@query("lookup_replicas", f"SELECT start, replica::INT AS replica, (rep_set + replica) % 5 AS host, lower(r_name) || ':5555' AS address FROM {_VNODES}, (SELECT unnest(range(3)) AS replica) JOIN region ON r_regionkey = (rep_set + replica) % 5")
def lookup_replicas(spark, d):
    return K.replicas(_vnodes(spark, d), _rep_sets(spark, d), _hosts(spark, d)).select(F.hex("start").alias("start"), "replica", "host", "address")


@query("vnodes_at_host", f"SELECT start, rep_set FROM {_VNODES} WHERE 2 IN (rep_set, (rep_set + 1) % 5, (rep_set + 2) % 5)")
def vnodes_at_host(spark, d):
    return K.vnodes_at(_vnodes(spark, d), _rep_sets(spark, d), 2).select(F.hex("start").alias("start"), "rep_set")


@query("address_ids", "SELECT lower(r_name) || ':5555' AS address, r_regionkey AS host FROM region WHERE r_regionkey < 3")
def address_ids(spark, d):
    wanted = table(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lower("r_name"), F.lit(":5555")).alias("address"))
    return wanted.join(_hosts(spark, d), "address").select("address", "host")


@query("quorum_sizes", "SELECT r_regionkey AS rep_set, (r_regionkey + 3) // 2 + 1 AS quorum FROM region")
def quorum_sizes(spark, d):
    """Sets of three to seven members."""
    sets = _rep_sets(spark, d).withColumn("members", F.sequence(F.lit(1), F.col("rep_set") + 3))
    return sets.select("rep_set", K.quorum("members").alias("quorum"))


@query(
    "vnode_splits",
    """WITH s AS (SELECT upper(md5(n_name)) AS id, n_nationkey + 1 AS n FROM nation), i AS (SELECT id, n, unnest(range(1, n)) AS k FROM s WHERE n > 1)
SELECT id AS schema_id, id AS start FROM s UNION ALL SELECT id, id || printf('%08X', k * (4294967295 // (n - 1))) FROM i WHERE k * (4294967295 // (n - 1)) < 4294967295""",
)
def vnode_splits(spark, d):
    names = table(spark, d, "nation").select(keys.schema_id(F.col("n_name")).alias("schema_id"), (F.col("n_nationkey") + 1).cast("int").alias("vnodes"))
    return K.split_points(names).select(F.hex("schema_id").alias("schema_id"), F.hex("start").alias("start"))


@query("schema_of_key", "SELECT upper(md5(r_name)) || printf('%08X', n_nationkey) AS key, upper(md5(r_name)) AS schema_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 4")
def schema_of_key(spark, d):
    """Keys of five namespaces, one of them not in the catalog."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), keys.schema_id(F.col("r_name")).alias("id"))
    rows = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r")).select(F.concat("id", keys.int_key(F.col("n_nationkey"))).alias("key"))
    return K.schema_of(rows, regions.where("r < 4").select(F.col("id").alias("schema_id"))).select(F.hex("key").alias("key"), F.hex("schema_id").alias("schema_id"))


@query("collocation_check", "SELECT event_id AS pos, user_id // 600 = (user_id + event_id % 7 * 100) // 600 AS collocated FROM events")
def collocation_check(spark, d):
    """Two keys per operation; vnodes every 600 keys, as far as there are keys."""
    e, own = table(spark, d, "events"), keys.literal(_ID)
    both = F.explode(F.array(F.col("user_id"), F.col("user_id") + F.col("event_id") % 7 * 100))
    ops = e.select(F.col("event_id").alias("pos"), both.alias("x"))
    at = lambda x: F.concat(own, keys.int_key(x))
    vnodes = ops.select((F.col("x") - F.col("x") % 600).alias("x")).distinct().select(own.alias("schema_id"), at(F.col("x")).alias("start"))
    ops = ops.select("pos", at(F.col("x")).alias("key"))
    routed = K.route(ops.select("key").distinct(), vnodes).select("key", F.col("start").alias("vnode"))
    return L.collocated(ops, routed)


# catalog

_CHANGES = """(SELECT event_id AS version, event_type AS entity, user_id % 20 AS id, CASE WHEN value < 10 THEN NULL ELSE event_type || event_id END AS value FROM events WHERE event_id <> 700)"""


@query("catalog_fold", f"SELECT entity, id, value FROM {_CHANGES} WHERE version < 700 QUALIFY row_number() OVER (PARTITION BY entity, id ORDER BY version DESC) = 1 AND value IS NOT NULL")
def catalog_fold(spark, d):
    """Changes after a missing version don't count yet."""
    e = table(spark, d, "events").where("event_id <> 700")
    value = F.when(~(F.col("value") < 10), F.concat("event_type", F.col("event_id").cast("string")))
    changes = e.select(F.col("event_id").alias("version"), F.col("event_type").alias("entity"), (F.col("user_id") % 20).alias("id"), value.alias("value"))
    return K.current(changes, 0).select("entity", "id", "value")


@query("schemas_json", """SELECT '{"name":"' || r_name || '","id":"' || upper(md5(r_name)) || '","meta":{"vnodes":"' || r_regionkey || '"}}' AS json FROM region""")
def schemas_json(spark, d):
    rows = table(spark, d, "region")
    meta = F.create_map(F.lit("vnodes"), F.col("r_regionkey").cast("string"))
    return K.to_json(rows.select(keys.schema_id(F.col("r_name")).alias("schema_id"), F.col("r_name").alias("name"), meta.alias("meta")))


@query("schema_settings", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey + 3 ELSE 3 END::INT AS rfactor, 1 AS vnodes, false AS force_master FROM region")
def schema_settings(spark, d):
    """Metadata with its defaults."""
    r = F.col("r_regionkey")
    meta = F.when(r % 2 == 0, F.create_map(F.lit("rfactor"), (r + 3).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, d, "region").select(F.col("r_name").alias("name"), meta.alias("meta"))
    return rows.select(
        "name", F.coalesce(F.element_at("meta", "rfactor"), F.lit("3")).cast("int").alias("rfactor"), F.coalesce(F.element_at("meta", "vnodes"), F.lit("1")).cast("int").alias("vnodes"),
        (F.coalesce(F.element_at("meta", "forceMaster"), F.lit("false")) == "true").alias("force_master"),
    )


@query("spread_vnodes", f"SELECT start, [0, 2, 4][(row_number() OVER (ORDER BY start) - 1) % 3 + 1] AS rep_set FROM {_VNODES}")
def spread_vnodes(spark, d):
    return K.spread(_vnodes(spark, d).drop("rep_set"), [0, 2, 4]).select(F.hex("start").alias("start"), "rep_set")


@query("chunk_values", "SELECT doc_id, piece::INT AS piece, octet_length(encode(text)) AS n, least(1000, octet_length(encode(text)) - piece * 1000)::INT AS size FROM (SELECT *, unnest(range(greatest(1, ceil(octet_length(encode(text)) / 1000.0)::BIGINT))) AS piece FROM documents)".replace("octet_length(encode(text)) AS n,", "octet_length(encode(text))::INT AS n,"))
def chunk_values(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("value"), F.octet_length("text").alias("n"))
    return K.chunks(rows, 1000).select("doc_id", "piece", "n", F.octet_length("chunk").alias("size"))


def _pieces(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("value"), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 1000)).cast("int").alias("n"))
    return K.chunks(rows, 1000).where(~((F.col("doc_id") % 5 == 0) & (F.col("piece") == 1)))


_COUNTED = "(SELECT *, greatest(1, ceil(octet_length(encode(text)) / 1000.0))::INT AS n FROM documents)"


@query("reassemble_values", f"SELECT doc_id, sha256(text) AS sha256 FROM {_COUNTED} WHERE NOT (doc_id % 5 = 0 AND n > 1)")
def reassemble_values(spark, d):
    """Values with a lost piece aren't there yet."""
    return K.reassembled(_pieces(spark, d), "doc_id").select("doc_id", F.sha2("value", 256).alias("sha256"))


@query("missing_pieces", f"SELECT doc_id, 1 AS piece FROM {_COUNTED} WHERE doc_id % 5 = 0 AND n > 1")
def missing_pieces(spark, d):
    return K.missing_pieces(_pieces(spark, d), "doc_id")


@query("sample_hosts", "SELECT r_regionkey AS host, lower(r_name) || ':5555' AS address FROM region ORDER BY md5('1:' || r_regionkey) LIMIT 3")
def sample_hosts(spark, d):
    return K.sample_hosts(_hosts(spark, d), 3, seed=1)


@query(
    "copysets",
    """WITH p AS (SELECT n_nationkey AS host, turn, (row_number() OVER (PARTITION BY turn ORDER BY md5('0:' || turn || ':' || n_nationkey)) - 1) // 3 AS piece FROM nation, (SELECT unnest(range(3)) AS turn))
SELECT DISTINCT members FROM (SELECT string_agg(host, ',' ORDER BY host) AS members, count(*) AS n FROM p GROUP BY turn, piece) WHERE n = 3""",
)
def copysets(spark, d):
    hosts = table(spark, d, "nation").select(F.col("n_nationkey").alias("host"))
    return K.copysets(hosts, 3, 6).select(F.array_join("members", ",").alias("members"))


@query("random_replication_set", "SELECT r_regionkey AS rep_set FROM region ORDER BY md5('7:' || r_regionkey) LIMIT 1")
def random_replication_set(spark, d):
    return K.random_set(_rep_sets(spark, d), 7, 3).select("rep_set")


@query("membership_changes", "SELECT user_id AS host, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'joined' END AS change FROM (SELECT DISTINCT user_id FROM events) WHERE (user_id % 7 = 0) <> (user_id % 5 = 0)")
def membership_changes(spark, d):
    """Of all users, the catalog knows those but multiples of 5, and all but multiples of 7 are alive."""
    hosts = table(spark, d, "events").select(F.col("user_id").alias("host")).distinct()
    return K.membership_changes(hosts.where("host % 5 <> 0"), hosts.where("host % 7 <> 0"))


@query("vnodes_of_set", f"SELECT start FROM {_VNODES} WHERE rep_set = 3")
def vnodes_of_set(spark, d):
    return K.vnodes_of_set(_vnodes(spark, d), 3).select(F.hex("start").alias("start"))


@query("vnodes_of_schema", "SELECT upper(md5(n_name)) AS schema_id, count(*) AS n FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) GROUP BY 1")
def vnodes_of_schema(spark, d):
    vnodes = table(spark, d, "nation").select(keys.schema_id(F.col("n_name")).alias("schema_id"), "n_name")
    name = vnodes.agg(F.min("n_name")).first()[0]
    found = K.vnodes_of_schema(vnodes, keys.schema_id(F.lit(name)))
    return found.groupBy(F.hex("schema_id").alias("schema_id")).agg(F.count(F.lit(1)).alias("n"))
