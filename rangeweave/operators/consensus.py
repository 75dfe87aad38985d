"""Decisions, views and checks over tables of consensus messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.operators.log import contiguous


def decisions(votes: DataFrame, members: int, view: int) -> DataFrame:
    """(instance, ballot, value) that a quorum of distinct acceptors accepted in the current view, at the highest ballot.

    ``votes``: (instance, ballot, value, view, acceptor).
    """
    best = Window.partitionBy("instance").orderBy(F.col("ballot").desc(), F.col("value"))
    counted = votes.groupBy("instance", "ballot", "value", "view").agg(F.count_distinct("acceptor").alias("n"))
    able = counted.where((F.col("n") >= members // 2 + 1) & (F.col("view") == view))
    return able.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("instance", "ballot", "value")


def applied(decided: DataFrame, first: int) -> DataFrame:
    """Decisions in order of instance, up to the first that is missing."""
    return contiguous(decided.withColumnRenamed("instance", "pos"), first).withColumnRenamed("pos", "instance")


def recovery(promises: DataFrame, first: int) -> DataFrame:
    """(instance, value) that a new leader proposes again: each instance's value of highest ballot, a noop where none is."""
    best = Window.partitionBy("instance").orderBy(F.col("ballot").desc(), F.col("value"))
    known = promises.where(F.col("instance") >= first).withColumn("__n", F.row_number().over(best)).where("__n = 1").select("instance", "value")
    span = known.agg(F.max("instance").alias("hi")).where("hi IS NOT NULL").select(F.explode(F.sequence(F.lit(first).cast("long"), "hi")).alias("instance"))
    return span.join(known, "instance", "left").select("instance", F.coalesce("value", F.lit("noop")).alias("value"))


def current_view(views: DataFrame, by: str) -> DataFrame:
    """The view with the highest id of each group: (by, view, members, added, removed), against the one before it."""
    newest = Window.partitionBy(by).orderBy(F.col("view").desc())
    before = F.coalesce(F.lead("members").over(newest), F.array().cast(views.schema["members"].dataType))
    return (
        views.withColumns({"__n": F.row_number().over(newest), "__before": before}).where("__n = 1")
        .select(by, "view", "members", F.array_sort(F.array_except("members", "__before")).alias("added"), F.array_sort(F.array_except("__before", "members")).alias("removed"))
    )


def leaders(members: DataFrame, suspected: DataFrame, by: str, address: str) -> DataFrame:
    """(by, leader): the smallest address of each group that isn't suspected."""
    return members.join(suspected, [by, address], "left_anti").groupBy(by).agg(F.min(address).alias("leader"))


def unanswered(requests: DataFrame, responses: DataFrame, op_id: str) -> DataFrame:
    """Requests without a response of success; empty for a valid history."""
    return requests.join(responses.where("code = 'SUCCESS'").select(op_id), op_id, "left_anti")


def range_mismatch(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows on one side only, with repeats counted: (…, side); empty where results agree."""
    extra, lost = got.exceptAll(expected), expected.exceptAll(got)
    return extra.withColumn("side", F.lit("extra")).unionByName(lost.withColumn("side", F.lit("lost")))


def broadcast_faults(proposed: DataFrame, decided: DataFrame, failed: DataFrame) -> DataFrame:
    """(fault, epoch, value) against atomic broadcast: decided but never proposed; decided in different orders; decided by
    some node, but not by all nodes that haven't failed.

    ``proposed``: (value); ``decided``: (node, epoch, seq, value); ``failed``: (node, epoch) of nodes that failed in an
    epoch. A value that a node decides again counts once, at its first place. Nodes are those that decide at all.
    """
    first = decided.groupBy("node", "epoch", "value").agg(F.min("seq").alias("seq"))
    slot = first.withColumn("slot", F.row_number().over(Window.partitionBy("node", "epoch").orderBy("seq", "value")))
    stray = decided.select("epoch", "value").distinct().join(proposed.select("value").distinct(), "value", "left_anti").select(F.lit("not proposed").alias("fault"), "epoch", "value")
    split = slot.groupBy("epoch", "slot").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n > 1")
    live = first.select("node", "epoch", "value", F.lit(1).alias("here")).join(failed.select("node", "epoch", F.lit(1).alias("gone")).distinct(), ["node", "epoch"], "left")
    by = live.groupBy("epoch", "value").agg(F.count(F.when(F.col("gone").isNull(), 1)).alias("n"))
    nodes = decided.agg(F.count_distinct("node").alias("nodes"))  # one row
    wanted = failed.select("node", "epoch").distinct().groupBy("epoch").agg(F.count(F.lit(1)).alias("lost"))
    lost = by.join(wanted, "epoch", "left").crossJoin(F.broadcast(nodes)).where(F.col("n") < F.col("nodes") - F.coalesce("lost", F.lit(0)))
    return (
        stray.unionByName(split.select(F.lit("order").alias("fault"), "epoch", "value"))
        .unionByName(lost.select(F.lit("not decided").alias("fault"), "epoch", "value"))
    )
