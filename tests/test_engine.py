"""Key algebra, ranges and replay against Python models; the store; streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rangeweave.client import Store
from rangeweave.functions import keys
from rangeweave.functions import ranges as R
from rangeweave.functions.ranges import KeyRange
from rangeweave.operators import catalog, log
from rangeweave.operators import cells as C
from rangeweave.operators.scan import Scan, byte_prefix
from rangeweave.sources import cells as store
from rangeweave.streaming import streams


def binary(x):
    return None if x is None else bytearray(x)


# keys


def test_inc_and_order(spark):
    r = random.Random(1)
    some = [b"", b"\0", b"\xff", b"\x01\xff", b"\x00\xfe", b"\x0f\xf0", b"\xaf\xff", b"\xff" * 4, bytes.fromhex("098F6BCD4621D373CADE4E832627B4F6")]
    some += [bytes(r.choice([0, 1, 15, 240, 254, 255]) for _ in range(r.randrange(6))) for _ in range(300)]
    rows = spark.createDataFrame([(binary(k),) for k in some], "k binary").select("k", keys.inc(F.col("k")).alias("n")).collect()
    for x in rows:
        assert (None if x["n"] is None else bytes(x["n"])) == keys.inc_bytes(bytes(x["k"]))
    ordered = [bytes(x["k"]) for x in spark.createDataFrame([(binary(k),) for k in some], "k binary").orderBy("k").collect()]
    assert ordered == sorted(some)


def test_golden_ids_and_splits(spark):
    one = spark.createDataFrame([("test", 5)], "name string, vnodes int").select(keys.schema_id(F.col("name")).alias("schema_id"), "vnodes")
    starts = sorted(bytes(x["start"]).hex().upper() for x in catalog.split_points(one).collect())
    own = "098F6BCD4621D373CADE4E832627B4F6"
    assert starts == [own, own + "3FFFFFFF", own + "7FFFFFFE", own + "BFFFFFFD", own + "FFFFFFFC"]
    assert {n: 1 + len(catalog.vnode_starts(n)) for n in (2, 3, 4, 5, 6, 7, 10, 16)} == {2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 10: 10, 16: 15}
    assert Store.prefix("test").hex().upper() == own


def test_reserved_prefix_is_hashed_again(spark):
    taken = Store.prefix("x")[:1]
    got = spark.range(1).select(keys.schema_id(F.lit("x"), taken).alias("i")).first()["i"]
    import hashlib

    assert bytes(got) == hashlib.md5(Store.prefix("x") + keys.int_bytes(0)).digest()


def test_int_keys(spark):
    numbers = [0, 1, 255, 2**31 - 1, -1, -(2**31)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", keys.int_key(F.col("x")).alias("k")).withColumn("back", keys.int_value(F.col("k")))
    assert [x["x"] for x in rows.orderBy("k").collect()] == [0, 1, 255, 2**31 - 1, -(2**31), -1]
    assert all(x["x"] == x["back"] and bytes(x["k"]) == keys.int_bytes(x["x"]) for x in rows.collect())


# ranges, against sets of one-byte keys


def members(r):
    return {k for k in range(8) if (k > r[0] or (k == r[0] and r[1])) and (r[2] is None or k < r[2] or (k == r[2] and r[3]))}


def test_range_algebra(spark):
    r = random.Random(2)
    some = [(r.randrange(8), r.random() < 0.5, r.choice([None, *range(8)]), r.random() < 0.5) for _ in range(400)]
    some = [(b, bc, e, ec and e is not None) for b, bc, e, ec in some]
    pairs = [(k, some[k], some[-k]) for k in range(1, 400)]
    kind = "struct<begin:binary,begin_closed:boolean,end:binary,end_closed:boolean>"

    def data(x):
        return bytearray([x[0]]), x[1], None if x[2] is None else bytearray([x[2]]), x[3]

    frame = spark.createDataFrame([(i, data(a), data(b)) for i, a, b in pairs], f"i int, a {kind}, b {kind}")
    a, b = F.col("a"), F.col("b")
    out = frame.select("i", R.intersect(a, b).alias("x"), R.overlaps(a, b).alias("o"), R.contains_range(a, b).alias("c"), R.contains_key(a, F.lit(bytearray(b"\3"))).alias("k")).collect()
    for row, (i, p, q) in zip(sorted(out, key=lambda x: x["i"]), pairs, strict=True):
        x = row["x"]
        both = members((x["begin"][0], x["begin_closed"], None if x["end"] is None else x["end"][0], x["end_closed"]))
        assert both == members(p) & members(q)
        assert row["k"] == (3 in members(p))
        # between two neighbouring one-byte keys there are longer keys, which these sets don't show
        if members(p) & members(q):
            assert row["o"]
        if row["c"]:
            assert members(q) <= members(p)


# scans


@pytest.fixture(scope="module")
def cells(spark):
    """Twenty integer keys with value i + 10, version 0."""
    rows = [(binary(keys.int_bytes(i)), 0, binary(keys.int_bytes(i + 10)), False) for i in range(20)]
    return spark.createDataFrame(rows, store.SCHEMA)


def test_scans(cells):
    k = keys.int_bytes
    assert bytes(C.get(cells, k(5)).first()["value"]) == k(15)
    assert Scan(KeyRange(k(0), k(19), True, True)).rows(cells).count() == 20
    assert Scan(KeyRange(k(1), k(18), True, False)).rows(cells).count() == 17
    assert [bytes(x["key"]) for x in Scan(KeyRange.starting(k(15))).first(3).rows(cells).orderBy("key").collect()] == [k(15), k(16), k(17)]
    for limit, n, cut in ((0, 0, True), (7, 1, True), (8, 2, True), (79, 19, True), (80, 20, False), (999, 20, False)):
        got = Scan(KeyRange.starting(b"")).up_to_bytes(limit).truncated(cells).first()
        assert tuple(got) == (n, cut)
    assert tuple(Scan(KeyRange(k(2), k(4), True, True)).diff(cells, delete=True).first()) == (-24, -3)
    assert tuple(Scan(KeyRange(k(2), k(4), True, True)).appending(b"xy").diff(cells).first()) == (6, 0)


def test_range_pushdown(spark, cells, tmp_path):
    store.write(cells, str(tmp_path / "cells"), 4)
    rows = store.read(spark, str(tmp_path / "cells"), KeyRange(keys.int_bytes(3), keys.int_bytes(9)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and rows.count() == 6


def test_versions_and_tombstones(spark):
    rows = [(b"a", 1, b"x", False), (b"a", 2, None, True), (b"b", 1, b"", False), (b"c", 1, None, True), (b"c", 5, b"z", False)]
    cells = spark.createDataFrame([(binary(k), v, binary(x), t) for k, v, x, t in rows], store.SCHEMA)
    assert {(bytes(x["key"]), bytes(x["value"])) for x in C.newest(cells).collect()} == {(b"b", b""), (b"c", b"z")}
    assert {bytes(x["key"]) for x in C.newest(cells, at=1).collect()} == {b"a", b"b"}
    assert {(bytes(x["key"]), x["version"]) for x in C.cleanup(cells, 1).collect()} == {(b"a", 2), (b"b", 1), (b"c", 5)}
    with pytest.raises(Exception, match="65534"):
        C.validate(cells.withColumn("value", F.encode(F.repeat(F.lit("x"), 70_000), "UTF-8"))).collect()


# replay against a dictionary


def random_log(seed, n=400):
    r = random.Random(seed)
    ops = []
    for pos in range(n):
        op = r.choice(["put", "delete", "put_if_absent", "append", "cas"])
        ops.append((pos, b"k%d" % r.randrange(12), op, None if op == "delete" else b"%d" % r.randrange(4), r.choice([None, b"0", b"1"]) if op == "cas" else None))
    return ops


def model(ops):
    state = {}
    for _, k, op, v, e in ops:
        if op == "put" or (op == "put_if_absent" and k not in state) or (op == "cas" and state.get(k) == e):
            state[k] = v
        elif op == "delete":
            state.pop(k, None)
        elif op == "append" and k in state:
            state[k] += v
    return state


def as_log(spark, ops):
    return spark.createDataFrame([(p, binary(k), op, binary(v), binary(e)) for p, k, op, v, e in ops], "pos long, key binary, op string, value binary, expected binary")


def state(rows):
    return {bytes(x["key"]): bytes(x["value"]) for x in rows.collect()}


def test_replay(spark):
    for seed in range(3):
        ops = random_log(seed)
        assert state(log.fold(as_log(spark, ops))) == model(ops)
        plain = [o for o in ops if o[2] != "cas"]
        assert state(log.replay(as_log(spark, plain))) == model(plain)
        writes = [o for o in ops if o[2] in ("put", "delete")]
        assert state(log.last_write(as_log(spark, ops))) == model(writes)


def test_multi_ops(spark):
    r = random.Random(5)
    ops = []
    for pos in range(300):
        v = r.randrange(3)
        pick = lambda: [(b"%d-%d" % (v, r.randrange(4)), r.choice([None, b"a", b"b"])) for _ in range(r.randrange(3))]  # noqa: B023, E731
        ops.append((pos, v, pick(), pick(), pick()))
    data = [(p, v, *[[(bytearray(k), binary(x)) for k, x in part] for part in parts]) for p, v, *parts in ops]
    want, passed = {}, {}
    for p, _, conditions, success, failure in ops:
        passed[p] = all(want.get(k) == x for k, x in conditions)
        want |= dict(success if passed[p] else failure)
    out = log.multi_ops(spark.createDataFrame(data, log.MULTI_OP))
    assert {x["pos"]: x["passed"] for x in out.collect()} == passed
    assert state(log.written(out)) == {k: v for k, v in want.items() if v is not None}


def test_gaps(spark):
    frame = spark.createDataFrame([(p,) for p in (5, 6, 7, 9, 12, 13, 2)], "pos long")
    assert sorted(x["pos"] for x in log.contiguous(frame, 5).collect()) == [5, 6, 7]
    assert sorted(map(tuple, log.gaps(frame, 5).collect())) == [(8, 8), (10, 11)]
    assert sorted(map(tuple, log.gaps(frame, 3).collect())) == [(3, 4), (8, 8), (10, 11)]
    assert log.contiguous(frame, 4).count() == 0


# planning


def test_copysets(spark):
    def hosts(n):
        return spark.range(n).withColumnRenamed("id", "host")

    for n in (6, 30, 500):
        sets = [tuple(r["members"]) for r in catalog.copysets(hosts(n), 3, 6).collect()]
        assert len(set(sets)) == len(sets) and all(len(set(s)) == 3 for s in sets)
        assert n == 500 or {h for s in sets for h in s} == set(range(n))
    with pytest.raises(ValueError):
        catalog.copysets(hosts(5), 2, 4)
    with pytest.raises(ValueError):
        catalog.copysets(hosts(2), 3, 4)


def test_even_buckets_and_route(spark):
    """Five thousand vnodes and many keys of one namespace: no bucket holds over twice the mean."""
    own = keys.literal(bytes.fromhex("098F6BCD4621D373CADE4E832627B4F6"))
    vnodes = spark.range(5000).select(own.alias("schema_id"), F.concat(own, keys.int_key(F.col("id") * 858_993)).alias("start"), F.col("id").alias("rep_set"))
    rows = spark.range(20_000).select(F.concat(own, keys.int_key(F.col("id") * 2_654_435_761 % (1 << 32))).alias("key"), (F.col("id") * 2_654_435_761 % (1 << 32)).alias("x"))
    for frame, key in ((vnodes, "start"), (rows, "key")):
        edges = keys.bounds(frame, key)
        sizes = [r["count"] for r in frame.groupBy(keys.bucket(F.col(key), edges)).count().collect()]
        assert len(sizes) > 100 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    for most in (0, 100_000):
        routed = catalog.route(rows, vnodes, most=most).select("x", "rep_set").collect()
        assert len(routed) == 20_000 and all(r["rep_set"] == min(r["x"] // 858_993, 4999) for r in routed)
    assert catalog.route(rows, vnodes.limit(0)).count() == 0 == catalog.route(rows.limit(0), vnodes).count()


def test_collocation_of_large_keys(spark, tmp_path):
    """Vnodes go on as far as there are keys."""
    from rangeweave.registry import QUERIES

    users = [0, 599, 14_399, 15_000, 15_599, 15_600, 90_000, 10**9]
    rows = [(10 * k + s, u) for k, u in enumerate(users) for s in range(7)]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(n, n % 5) for n in range(25)], "n_nationkey int, n_regionkey int").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    got = {r["pos"]: r["collocated"] for r in QUERIES["collocation_check"](spark, str(tmp_path)).collect()}
    assert got == {e: u // 600 == (u + e % 7 * 100) // 600 for e, u in rows}


def test_byte_prefix_in_one_namespace(spark):
    r = random.Random(2)
    cells = sorted((b"namespace-of-all" + r.randbytes(4), r.randbytes(r.randrange(40))) for _ in range(3000))
    frame = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in cells], "key binary, value binary").repartition(7)
    want, used = [], 0
    for k, v in cells:
        used += len(v)
        if used > 20_000:
            break
        want.append(k)
    assert sorted(bytes(x["key"]) for x in byte_prefix(frame, 20_000).collect()) == want
    assert byte_prefix(frame.limit(0), 5).count() == 0


# the store


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.create_schema("a", {"rfactor": "3"}) == "SUCCESS" == s.create_schema("a", {"rfactor": "3"})
    assert s.create_schema("a", {}) == "EXISTS" and s.create_schema("b") == "SUCCESS"
    s.put("a", b"k1", b"v1")
    s.put("b", b"k1", b"other")
    s.append("a", b"k1", b"+")
    s.put_if_absent("a", b"k1", b"no")
    s.cas("a", b"k1", b"v1+", b"v2")
    s.cas("a", b"k1", b"v1+", b"v3")
    assert s.get("a", b"k1") == b"v2" and s.get("a", b"k9") is None
    s.compact()
    s.delete("a", b"k1")
    s.load("a", spark.createDataFrame([(bytearray(b"k%d" % i), bytearray(b"x")) for i in range(2, 7)], "key binary, value binary"))
    assert [bytes(x["key"]) for x in s.all("a").orderBy("key").collect()] == [b"k2", b"k3", b"k4", b"k5", b"k6"]
    assert s.scan("a", KeyRange(b"k3", None), items=2).count() == 2 and s.prefix_scan("a", b"k4").count() == 1
    s.compact()
    assert s.all("a").count() == 5 and s.get("b", b"k1") == b"other"
    twice = [(bytearray(b"k2"), bytearray(b"old")), (bytearray(b"k2"), None), (bytearray(b"k3"), bytearray(b"3")), (bytearray(b"k3"), bytearray(b"new"))]
    s.load("a", spark.createDataFrame(twice, "key binary, value binary").coalesce(1))
    assert s.get("a", b"k2") is None and s.get("a", b"k3") == b"new"
    s.load("a", spark.range(500).select(keys.int_key(F.col("id")).alias("key"), F.lit(bytearray(b"x")).alias("value")).repartition(5))
    assert s.log().groupBy("pos").count().where("count > 1").count() == 0 == log.gaps(s.log(), 0).count()
    assert s.multi("a", {b"k3": b"new", b"k2": None}, {b"k2": b"yes", b"k3": None}, {b"k2": b"no"}) and s.get("a", b"k2") == b"yes" and s.get("a", b"k3") is None
    assert not s.multi("a", {b"k3": b"new"}, {b"k2": b"again"}) and s.get("a", b"k2") == b"yes"
    with pytest.raises(Exception, match="65534"):
        s.put("a", b"k2", b"x" * 70_000)
    assert s.drop_schema("b") == "SUCCESS" and s.drop_schema("b") == "NO_SUCH_SCHEMA"
    with pytest.raises(KeyError):
        s.get("b", b"k1")


def test_schema_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"name": "test", "meta": {"vnodes": "2"}}, {"name": "own", "meta": {"id": "AA BB"}}]')
    got = {x["name"]: (bytes(x["schema_id"]).hex().upper(), x["meta"]) for x in store.read_schemas(spark, str(tmp_path / "in.json")).collect()}
    assert got == {"test": ("098F6BCD4621D373CADE4E832627B4F6", {"vnodes": "2"}), "own": ("AABB", {"id": "AA BB"})}
    store.write_schemas(store.read_schemas(spark, str(tmp_path / "in.json")), str(tmp_path / "out"))
    assert store.read_schemas(spark, str(tmp_path / "out")).count() == 2


# streams


def run_stream(spark, tmp_path, batches, schema, build, mode):
    """Feeds batches one at a time; gives what each trigger wrote."""
    source, got = tmp_path / "in", []
    source.mkdir()
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda b, _, k=k: got.extend((k, *r) for r in b.collect())).start().awaitTermination()
    return got


def test_stream_contiguous(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[(1, 0), (1, 2)], [(1, 3), (2, 1)], [(1, 1), (2, 0)]], "v long, pos long", lambda s: streams.contiguous(s, "v", 0), "append")
    assert sorted(got) == [(0, 1, 0), (2, 1, 1), (2, 1, 2), (2, 1, 3), (2, 2, 0), (2, 2, 1)]


def test_stream_round_trips(spark, tmp_path):
    from rangeweave.operators.detection import rtt_all_time

    r = random.Random(4)
    rows = [(h, i, r.random() * 100) for i in range(30) for h in range(2)]
    got = run_stream(spark, tmp_path, [rows[:20], rows[20:41], rows[41:]], "h long, seq long, x double", lambda s: streams.round_trips(s, "h", "x", 5.0), "update")
    want = {x["h"]: tuple(x)[1:] for x in rtt_all_time(spark.createDataFrame(rows, "h long, seq long, x double"), "h", "seq", "x", 5.0).collect()}
    last = {h: state for _, h, *state in got}
    assert all(last[h] == pytest.approx(want[h]) for h in want)


def test_stream_silence(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    at = lambda s: (t + pd.Timedelta(seconds=s)).to_pydatetime()
    batches = [[(1, at(0)), (2, at(0))], [(1, at(60))], [(1, at(120))], [(1, at(121)), (2, at(121))], [(1, at(122))]]
    got = run_stream(spark, tmp_path, batches, "h long, ts timestamp", lambda s: streams.silent_hosts(s, "h", "ts", 10_000, "0 seconds"), "append")
    assert [x[2] for x in got if x[1] == 2] == ["suspected", "restored"]
