"""Statistics of vnodes, hosts and the cluster, and what a balancer derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions.keys import floor_div

TOP = 5
ALPHA = 0.16
BOUND = 0.35


def host_report(nodes: DataFrame, host: str) -> DataFrame:
    """Per host of (host, vnode, store_size, n_keys, ops): number of vnodes, totals, floor averages."""
    total = nodes.groupBy(host).agg(F.count(F.lit(1)).alias("n_vnodes"), F.sum("store_size").alias("size"), F.sum("n_keys").alias("n_keys"), F.sum("ops").alias("ops"))
    return total.withColumns({"avg_size": floor_div(F.col("size"), F.col("n_vnodes")), "avg_ops": floor_div(F.col("ops"), F.col("n_vnodes"))})


def extremes(rows: DataFrame, by: list[str], value: str, tie: str, k: int = TOP) -> DataFrame:
    """The k largest and k smallest rows of each group: (…, side, place). Ties go by ``tie``, ascending."""
    out = []
    for side, order in (("top", F.col(value).desc()), ("bottom", F.col(value).asc())):
        w = Window.partitionBy(*by).orderBy(order, F.col(tie).asc())
        out.append(rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


def ewma(rows: DataFrame, by: list[str], order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """(by, ewma) after avg = alpha * x + (1 - alpha) * avg from 0 over the ordered values, as a sum of weighted values."""
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    weighed = rows.withColumn("__w", alpha * F.pow(F.lit(1 - alpha), F.row_number().over(back) - 1) * F.col(value))
    return weighed.groupBy(*by).agg(F.sum("__w").alias("ewma"))


def bounds(rows: DataFrame, value: str, bound: float = BOUND) -> DataFrame:
    """``rows`` with their load against the average: over, under or normal."""
    avg = rows.agg(F.avg(value).alias("__avg"))
    load = F.when(F.col(value) > F.col("__avg") * (1 + bound), "over").when(F.col(value) < F.col("__avg") * (1 - bound), "under").otherwise("normal")
    return rows.join(F.broadcast(avg)).withColumn("load", load).drop("__avg")  # one row


def failed_hosts(hosts: DataFrame, reports: DataFrame, host: str) -> DataFrame:
    """Hosts without a report; none if they are more than half of all, as the reader is then more likely cut off."""
    missing = hosts.join(reports.select(host).distinct(), host, "left_anti")
    n = hosts.agg(F.count(F.lit(1)).alias("__all")).join(missing.agg(F.count(F.lit(1)).alias("__missing")))
    return missing.join(F.broadcast(n)).where(F.col("__missing") * 2 <= F.col("__all")).drop("__all", "__missing")


def assign_ids(joining: DataFrame, free: DataFrame, next_id: int) -> DataFrame:
    """(address, id): joining hosts take free ids in order, then new ones."""
    j = joining.withColumn("__n", F.row_number().over(Window.orderBy("address")))  # hosts, not data
    f = free.withColumn("__n", F.row_number().over(Window.orderBy("id")))
    n_free = free.agg(F.count(F.lit(1)).alias("__free"))
    return j.join(f, "__n", "left").join(n_free).select("address", F.coalesce("id", F.lit(next_id) + F.col("__n") - F.col("__free") - 1).alias("id"))


def swaps(hosts: DataFrame, value: str, k: int = TOP) -> DataFrame:
    """A recommendation (from_host, to_host): the most loaded host with the least loaded one, and so on inwards."""
    ends = extremes(hosts, [], value, "host", k)
    top, bottom = ends.where("side = 'top'"), ends.where("side = 'bottom'")
    return top.select("place", F.col("host").alias("from_host"), F.col(value).alias("from_load")).join(
        bottom.select("place", F.col("host").alias("to_host"), F.col(value).alias("to_load")), "place"
    ).where("from_load > to_load AND from_host <> to_host")


def relative_error(x: Column) -> dict[str, Column]:
    """Mean, sample deviation, standard error and relative standard error of a measured series."""
    mean, std = F.avg(x), F.stddev_samp(x)
    sem = std / F.sqrt(F.count(x))
    return {"mean": mean, "std": std, "sem": sem, "rse": sem / mean}
