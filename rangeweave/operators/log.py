"""Replay of an operation log: rows (pos BIGINT, key BINARY, op STRING, value BINARY, expected BINARY).

``op`` is put, delete, put_if_absent, append or cas. All state of a key follows from its last unconditional write and
what comes after; history before it is pre-aggregated away (one maximum per key) before any row is shuffled by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCONDITIONAL = ("put", "delete")
GAP_BLOCK = 1 << 16


def deduplicated(log: DataFrame, op_id: str) -> DataFrame:
    """The first position of each operation id: a log may hold an operation more than once."""
    first = Window.partitionBy(op_id).orderBy("pos")
    return log.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def since_last_write(log: DataFrame) -> DataFrame:
    """Each key's rows from its last unconditional write on."""
    last = log.where(F.col("op").isin(*UNCONDITIONAL)).groupBy("key").agg(F.max("pos").alias("__from"))
    return log.join(last, "key", "left").where(F.col("__from").isNull() | (F.col("pos") >= F.col("__from"))).drop("__from")


def last_write(log: DataFrame) -> DataFrame:
    """(key, pos, value) by puts and deletes alone: the last one wins, deleted keys are absent."""
    last = Window.partitionBy("key").orderBy(F.col("pos").desc())
    rows = log.where(F.col("op").isin(*UNCONDITIONAL)).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return rows.where("op = 'put'").select("key", "pos", "value")


def replay(log: DataFrame) -> DataFrame:
    """(key, pos, value) after puts, deletes, put_if_absents and appends; pos is where the value began.

    A key's value begins with its last put, or with the first put_if_absent after its last delete; appends that follow
    are joined to it, appends to an absent key do nothing.
    """
    rest = since_last_write(log)
    base = F.min(F.when(F.col("op").isin("put", "put_if_absent"), F.col("pos")))
    tail = F.collect_list(F.when(F.col("op") != "delete", F.struct("pos", "op", "value")))  # as long as the value it makes
    state = rest.groupBy("key").agg(base.alias("pos"), tail.alias("all")).where("pos IS NOT NULL")
    parts = F.filter("all", lambda x: (x["pos"] == F.col("pos")) | ((x["op"] == "append") & (x["pos"] > F.col("pos"))))
    joined = F.unhex(F.array_join(F.transform(F.sort_array(parts), lambda x: F.hex(x["value"])), ""))
    return state.select("key", "pos", joined.alias("value"))


def fold(log: DataFrame) -> DataFrame:
    """(key, value) after all kinds of operations, each seeing the outcome of the one before; absent keys have no row.

    An ordered fold of one key's operations since its last unconditional write, inside the JVM.
    """
    ops = F.array_sort(F.collect_list(F.struct("pos", "op", "value", "expected")))
    one = since_last_write(log).groupBy("key").agg(ops.alias("ops"))

    def step(state: Column, x: Column) -> Column:
        return (
            F.when(x["op"] == "put", x["value"])
            .when(x["op"] == "delete", F.lit(None).cast("binary"))
            .when((x["op"] == "put_if_absent") & state.isNull(), x["value"])
            .when((x["op"] == "append") & state.isNotNull(), F.concat(state, x["value"]))
            .when((x["op"] == "cas") & state.eqNullSafe(x["expected"]), x["value"])
            .otherwise(state)
        )

    return one.select("key", F.aggregate("ops", F.lit(None).cast("binary"), step).alias("value")).where("value IS NOT NULL")


_PAIRS = "array<struct<key:binary,value:binary>>"
MULTI_OP = f"pos long, vnode long, conditions {_PAIRS}, success {_PAIRS}, failure {_PAIRS}"


def collocated(ops: DataFrame, vnode_of: DataFrame) -> DataFrame:
    """(pos, collocated): whether all keys of an operation lie in one vnode. ``ops``: (pos, key); ``vnode_of``: (key, vnode)."""
    return ops.join(vnode_of, "key", "left").groupBy("pos").agg(
        ((F.count_distinct("vnode") == 1) & (F.count("vnode") == F.count(F.lit(1)))).alias("collocated")
    )


def multi_ops(ops: DataFrame) -> DataFrame:
    """(pos, vnode, passed, key, value): a row for each key that conditional multi-key operations write, in order.

    Operations of a vnode run one after the other, as each depends on what came before; all keys of one lie in one
    vnode. They stream through a task sorted by position: what it holds is the vnode's keys, not its log. A null value
    is a delete. An operation that writes nothing gives one row with a null key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vnode, state = None, {}
        for rows in batches:
            out = []
            for op in rows.itertuples(index=False):
                if op.vnode != vnode:
                    vnode, state = op.vnode, {}
                passed = all(state.get(bytes(c["key"])) == (None if c["value"] is None else bytes(c["value"])) for c in op.conditions)
                writes = {bytes(p["key"]): None if p["value"] is None else bytes(p["value"]) for p in (op.success if passed else op.failure)}
                state |= writes
                out += [(op.pos, vnode, passed, k, v) for k, v in (writes or {None: None}).items()]
            yield pd.DataFrame(out, columns=["pos", "vnode", "passed", "key", "value"])

    ordered = ops.repartition("vnode").sortWithinPartitions("vnode", "pos")
    return ordered.mapInPandas(run, "pos long, vnode long, passed boolean, key binary, value binary")


def written(outcomes: DataFrame) -> DataFrame:
    """(key, value): the state after :func:`multi_ops`."""
    last = Window.partitionBy("key").orderBy(F.col("pos").desc())
    return outcomes.where("key IS NOT NULL").withColumn("__n", F.row_number().over(last)).where("__n = 1 AND value IS NOT NULL").select("key", "value")


def first_gap(log: DataFrame, first: int) -> DataFrame:
    """One row (gap): the smallest position from ``first`` on that the log lacks. An anti-join, no global order."""
    present = log.where(F.col("pos") >= first).select("pos").distinct()
    after = present.select((F.col("pos") + 1).alias("pos")).union(log.sparkSession.createDataFrame([(first,)], "pos long"))
    return after.join(present, "pos", "left_anti").agg(F.min("pos").alias("gap"))


def contiguous(log: DataFrame, first: int) -> DataFrame:
    """The rows that can be applied: positions from ``first`` without a gap."""
    return log.where(F.col("pos") >= first).join(F.broadcast(first_gap(log, first)), F.col("pos") < F.col("gap")).drop("gap")  # one row


def gaps(log: DataFrame, first: int) -> DataFrame:
    """(low, high) of every run of missing positions between ``first`` and the log's end.

    Positions look at the one before them in their block of ``GAP_BLOCK``; only the blocks' ends are ordered as a whole.
    """
    block = F.floor(F.col("pos") / GAP_BLOCK).alias("block")
    present = log.where(F.col("pos") >= first).select("pos", block)
    inside = Window.partitionBy("block").orderBy("pos")
    within = present.withColumn("before", F.lag("pos").over(inside))
    seams = Window.orderBy("block")  # a row for each block that has positions
    ends = present.groupBy("block").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    across = ends.select("pos", F.coalesce(F.lag("last").over(seams), F.lit(first - 1).cast("long")).alias("before"))
    pairs = within.where("before IS NOT NULL").select("pos", "before").unionByName(across)
    return pairs.where(F.col("pos") > F.col("before") + 1).select((F.col("before") + 1).alias("low"), (F.col("pos") - 1).alias("high"))


def fill_gaps(log: DataFrame, first: int) -> DataFrame:
    """(pos, op) with a noop at every missing position."""
    missing = gaps(log, first).select(F.explode(F.sequence("low", "high")).alias("pos"), F.lit("noop").alias("op"))
    return log.where(F.col("pos") >= first).select("pos", "op").unionByName(missing)


def pruned(log: DataFrame, upto: int) -> DataFrame:
    return log.where(F.col("pos") > upto)


def since_snapshot(log: DataFrame, snapshot: int) -> DataFrame:
    """(key, pos, value, is_tombstone) writes after a snapshot, the last of each key: what brings it up to date."""
    last = Window.partitionBy("key").orderBy(F.col("pos").desc())
    rows = pruned(log, snapshot).where(F.col("op").isin(*UNCONDITIONAL)).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return rows.select("key", "pos", "value", (F.col("op") == "delete").alias("is_tombstone"))
