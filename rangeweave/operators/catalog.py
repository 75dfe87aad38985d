"""Namespaces, vnodes, replication sets and hosts as DataFrames; routing of keys and ranges to them.

vnodes: (schema_id BINARY, start BINARY, rep_set INT); rep_sets: (rep_set INT, members ARRAY<INT>); hosts: (host INT, address STRING).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions import keys, ranges

#: Up to so many vnodes (two keys and two numbers each) are broadcast.
BROADCAST_VNODES = 50_000
MAX_SUFFIX = 0xFFFFFFFF


def responsibilities(vnodes: DataFrame) -> DataFrame:
    """``vnodes`` with the end of their range: the next start in the namespace, or the namespace's end."""
    following = Window.partitionBy("schema_id").orderBy("start")
    return vnodes.withColumn("end", F.coalesce(F.lead("start").over(following), keys.inc(F.col("schema_id"))))


def route(rows: DataFrame, vnodes: DataFrame, key: str = "key", most: int = BROADCAST_VNODES) -> DataFrame:
    """``rows`` with (schema_id, start, end, rep_set) of the vnode that is responsible for their key; others are dropped.

    The responsible vnode has the greatest start up to the key, in the key's own namespace. Starts are cut into even
    buckets, each of which begins with a start, so that a key's vnode is in its own bucket: a tree of comparisons gives
    the bucket, a binary search in the bucket's starts the vnode. Up to ``most`` vnodes are broadcast, so no row is
    shuffled; beyond, rows meet their bucket by a join whose hot buckets adaptive execution splits.
    """
    edges = keys.bounds(vnodes, "start")
    owners = responsibilities(vnodes)
    names = [c for c in owners.columns if c != key]
    held = F.array_sort(F.collect_list(F.struct("start", *[c for c in owners.columns if c != "start"])))
    small = owners.groupBy(keys.bucket(F.col("start"), edges).alias("__bucket")).agg(held.alias("__own"))
    if vnodes.count() <= most:
        small = F.broadcast(small)
    met = rows.withColumn("__bucket", keys.bucket(F.col(key), edges)).join(small, "__bucket")
    # the last place whose start is up to the key; the first place always is
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("__own"))).cast("int") + 1)

    def halve(state, _):
        mid = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        up = F.get("__own", mid)["start"] <= F.col(key)
        return F.struct(F.when(up, mid).otherwise(state["low"]).alias("low"), F.when(up, state["high"]).otherwise(mid - 1).alias("high"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size("__own") - 1).alias("high")), lambda s, x: F.when(s["low"] < s["high"], halve(s, x)).otherwise(s), lambda s: F.get("__own", s["low"]))
    met = met.withColumn("__vnode", found).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("__vnode")[c].alias(c) for c in names])
    return met.where(F.col("end").isNull() | (F.col(key) < F.col("end")))


def schema_of(rows: DataFrame, schemas: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with the schema_id that is a prefix of their key: an equality join, as all ids have one length each."""
    lengths = [r[0] for r in schemas.select(F.octet_length("schema_id")).distinct().collect()]  # a few lengths
    out = None
    for n in sorted(lengths):
        ids = schemas.where(F.octet_length("schema_id") == n).select("schema_id")
        met = rows.join(ids, F.substring(key, 1, n) == F.col("schema_id"))
        out = met if out is None else out.unionByName(met)
    return out


def split(spans: DataFrame, vnodes: DataFrame) -> DataFrame:
    """``spans`` (schema_id, span) in parts, one for each vnode they touch: with (start, rep_set, part).

    Spans are spread over the even buckets of starts that they touch, and meet only the vnodes of those.
    """
    edges = keys.bounds(vnodes, "start")
    owners = responsibilities(vnodes).withColumn("__own", ranges.struct(F.col("start"), F.lit(True), F.col("end"), F.lit(False)))
    owners = owners.withColumn("__bucket", keys.bucket(F.col("start"), edges))
    first = F.greatest(F.lit(0), keys.bucket(F.col("span.begin"), edges))
    last = F.when(F.col("span.end").isNull(), F.lit(max(len(edges) - 1, 0))).otherwise(keys.bucket(F.col("span.end"), edges))
    spread = spans.withColumn("__bucket", F.explode(F.when(first <= last, F.sequence(first, last))))
    met = spread.join(owners, ["schema_id", "__bucket"]).where(ranges.overlaps(F.col("span"), F.col("__own")))
    return met.withColumn("part", ranges.intersect(F.col("span"), F.col("__own"))).drop("__own", "__bucket")


def first_part(spans: DataFrame, vnodes: DataFrame, by: str) -> DataFrame:
    """The part of each span that its first responsible vnode holds."""
    first = Window.partitionBy(by).orderBy("start")
    return split(spans, vnodes).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def covered(parts: DataFrame, by: str) -> DataFrame:
    """(by, complete) whether the parts that came back cover their span: each begins where the one before ended."""
    w = Window.partitionBy(by).orderBy("part.begin")
    seam = F.lag("part.end").over(w).eqNullSafe(F.col("part.begin")) | F.lag("part.end").over(w).isNull()
    joined = parts.withColumn("__seam", seam)
    return joined.groupBy(by).agg(
        (F.min("__seam") & (F.min("part.begin") == F.first("span.begin")) & F.max(F.col("part.end").eqNullSafe(F.col("span.end")))).alias("complete")
    )


def uncovered(spans: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """(by, part) of what no part covers: between parts, after the last, and all of a span without any."""
    w = Window.partitionBy(by).orderBy("part.begin")
    at = parts.withColumn("__before", F.lag("part.end").over(w)).withColumn("__first", F.lag("part.begin").over(w).isNull())
    low = F.when(F.col("__first"), F.col("span.begin")).otherwise(F.col("__before"))
    inner = at.where(low < F.col("part.begin")).select(by, ranges.struct(low, F.lit(True), F.col("part.begin"), F.lit(False)).alias("part"))
    last = parts.groupBy(by).agg(F.max("part.end").alias("__end"), F.max(F.col("part.end").isNull()).alias("__open"), F.first("span").alias("span"))
    rest = last.where(~F.col("__open") & (F.col("span.end").isNull() | (F.col("__end") < F.col("span.end"))))
    tail = rest.select(by, ranges.struct(F.col("__end"), F.lit(True), F.col("span.end"), F.col("span.end_closed")).alias("part"))
    none = spans.join(parts.select(by).distinct(), by, "left_anti").select(by, F.col("span").alias("part"))
    return inner.unionByName(tail).unionByName(none)


def vnode_starts(n: int) -> list[int]:
    """Four-byte suffixes of the vnodes that begin inside a namespace asked to have n: multiples of an even step below the
    greatest suffix. The vnode at the namespace's own start comes on top."""
    if n < 2:
        return []
    step = MAX_SUFFIX // (n - 1)
    return [k * step for k in range(1, n) if k * step < MAX_SUFFIX]


def split_points(schemas: DataFrame) -> DataFrame:
    """(schema_id, start) of the vnodes of namespaces (schema_id, vnodes)."""
    step = F.floor(F.lit(MAX_SUFFIX) / (F.col("vnodes") - 1)).cast("long")
    inner = F.when(F.col("vnodes") > 1, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.col("vnodes") - 1, F.lit(1))), lambda k: k * step), lambda x: x < MAX_SUFFIX)).otherwise(F.array().cast("array<bigint>"))
    own = schemas.select("schema_id", F.col("schema_id").alias("start"))
    return own.unionByName(schemas.select("schema_id", F.explode(inner).alias("x")).select("schema_id", F.concat("schema_id", keys.int_key(F.col("x"))).alias("start")))


def replicas(vnodes: DataFrame, rep_sets: DataFrame, hosts: DataFrame) -> DataFrame:
    """(schema_id, start, replica, host, address): the hosts of each vnode, in the order of its replication set."""
    members = rep_sets.select("rep_set", F.posexplode("members").alias("replica", "host"))
    return vnodes.join(members, "rep_set").join(hosts, "host").select("schema_id", "start", "replica", "host", "address")


def vnodes_at(vnodes: DataFrame, rep_sets: DataFrame, host: int) -> DataFrame:
    return vnodes.join(rep_sets.where(F.array_contains("members", host)).select("rep_set"), "rep_set")


def quorum(members: str) -> Column:
    return (F.floor(F.size(members) / 2) + 1).cast("int")


def replication_problem(factor: int, hosts: int) -> str | None:
    """Why a replication factor can't be used."""
    if factor < 3:
        return "a replication factor is 3 or more"
    return "more replicas than hosts" if factor > hosts else None


def _shuffled(seed, *parts) -> Column:
    """What rows are ordered by for a seeded permutation."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def copysets(hosts: DataFrame, factor: int, scatter: int, seed: int = 0) -> DataFrame:
    """(members): different replication sets of ``factor`` hosts: ceil(scatter / (factor - 1)) permutations of the hosts, by a
    seeded hash, are cut in pieces of ``factor`` (what is left over goes), and equal pieces count once."""
    if problem := replication_problem(factor, hosts.count()):
        raise ValueError(problem)
    turns = F.array(*[F.lit(k) for k in range(-(-scatter // (factor - 1)))])
    dealt = hosts.select("host", F.explode(turns).alias("turn"))
    order = Window.partitionBy("turn").orderBy(_shuffled(seed, "turn", "host"), "host")
    pieces = dealt.withColumn("piece", F.floor((F.row_number().over(order) - 1) / factor)).groupBy("turn", "piece").agg(F.sort_array(F.collect_list("host")).alias("members"))
    return pieces.where(F.size("members") == factor).select("members").distinct()


def random_set(sets: DataFrame, seed: int, factor: int | None = None) -> DataFrame:
    """One row of ``sets`` (rep_set, members), by a seeded hash: of those with ``factor`` members, if that is given."""
    able = sets if factor is None else sets.where(F.size("members") == factor)
    return able.orderBy(_shuffled(seed, "rep_set"), "rep_set").limit(1)


def current(changes: DataFrame, first: int) -> DataFrame:
    """The catalog after a change log (version, entity, id, value; null drops): the last change of each entity and id wins,
    and only versions that follow on ``first`` without a gap count."""
    from rangeweave.operators.log import contiguous

    usable = contiguous(changes.withColumnRenamed("version", "pos"), first).withColumnRenamed("pos", "version")
    last = Window.partitionBy("entity", "id").orderBy(F.col("version").desc())
    return usable.withColumn("__n", F.row_number().over(last)).where("__n = 1 AND value IS NOT NULL").drop("__n")


def to_json(schemas: DataFrame) -> DataFrame:
    """(json) of each namespace (schema_id, name, meta)."""
    return schemas.select(F.to_json(F.struct("name", F.hex("schema_id").alias("id"), "meta")).alias("json"))


def spread(vnodes: DataFrame, sets: list[int]) -> DataFrame:
    """New vnodes dealt over replication sets in turn, by start within the namespace."""
    turn = Window.partitionBy("schema_id").orderBy("start")
    return vnodes.withColumn("rep_set", F.get(F.lit(sets), ((F.row_number().over(turn) - 1) % len(sets)).cast("int")))


def chunks(rows: DataFrame, size: int, value: str = "value") -> DataFrame:
    """``rows`` with (piece, chunk) instead of the value: its bytes in pieces of ``size``."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(value) / size)).cast("int")
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk", F.substring(value, F.col("piece") * size + 1, F.lit(size))).drop(value)


def reassembled(pieces: DataFrame, by: str) -> DataFrame:
    """(by, value) of values whose pieces are all there, ``pieces`` having (by, piece, n, chunk)."""
    whole = pieces.groupBy(by).agg(F.first("n").alias("n"), F.collect_set(F.struct("piece", "chunk")).alias("all")).where(F.size("all") == F.col("n"))
    return whole.select(by, F.unhex(F.array_join(F.transform(F.sort_array("all"), lambda x: F.hex(x["chunk"])), "")).alias("value"))


def missing_pieces(pieces: DataFrame, by: str) -> DataFrame:
    """(by, piece) of the pieces that haven't come."""
    wanted = pieces.groupBy(by).agg(F.first("n").alias("n")).select(by, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    return wanted.join(pieces.select(by, "piece"), [by, "piece"], "left_anti")


def sample_hosts(hosts: DataFrame, n: int, seed: int) -> DataFrame:
    """n hosts by a seeded hash of their number, or all if there are no more: the same ones for a seed."""
    return hosts.orderBy(_shuffled(seed, "host"), "host").limit(n)


def membership_changes(catalog_ids: DataFrame, alive: DataFrame, on: str = "host") -> DataFrame:
    """(host, change): ids of the catalog that aren't alive have failed, live ones that it lacks have joined."""
    both = catalog_ids.select(on, F.lit(1).alias("__known")).distinct().join(alive.select(on, F.lit(1).alias("__alive")).distinct(), on, "full")
    change = F.when(F.col("__alive").isNull(), "failed").when(F.col("__known").isNull(), "joined")
    return both.select(on, change.alias("change")).where("change IS NOT NULL")


def vnodes_of_set(vnodes: DataFrame, rep_set: int) -> DataFrame:
    return vnodes.where(F.col("rep_set") == rep_set)


def vnodes_of_schema(vnodes: DataFrame, schema_id: Column) -> DataFrame:
    return vnodes.where(F.col("schema_id") == schema_id)
