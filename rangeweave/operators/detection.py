"""Failure detection, round-trip times and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 100
STD_FACTOR = 4.0
MEAN_RATE, DEVIATION_RATE = 0.125, 0.25


def rtt_window(samples: DataFrame, by: str, order: str, rtt: str, least: float) -> DataFrame:
    """``samples`` with (mean, var, rto) over the last 100: a sample's squared error is against the mean when it came, so
    the variance is a second window over the first one's result."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(1 - SAMPLES, 0)
    mean = samples.withColumn("mean", F.avg(rtt).over(last))
    var = mean.withColumn("__sq", F.pow(F.col("mean") - F.col(rtt), 2)).withColumn("var", F.avg("__sq").over(last)).drop("__sq")
    return var.withColumn("rto", F.greatest(F.lit(least), F.col("mean") + STD_FACTOR * F.sqrt("var")))


def rtt_all_time(samples: DataFrame, by: str, order: str, rtt: str, least: float) -> DataFrame:
    """(by, mean, deviation, rto) after all samples, each moving the deviation by a quarter, then the mean by an eighth.

    An ordered fold of one host's samples inside the JVM; for endless series the streaming detector keeps the two numbers.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(rtt).cast("double").alias("x")))), lambda s: s["x"])
    one = samples.groupBy(by).agg(ordered.alias("xs"))
    state = F.aggregate(
        F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))),
        F.struct(F.get("xs", F.lit(0)).alias("mean"), F.lit(0.0).alias("deviation")),
        lambda a, x: F.struct(
            ((1 - MEAN_RATE) * a["mean"] + MEAN_RATE * x).alias("mean"),
            ((1 - DEVIATION_RATE) * a["deviation"] + DEVIATION_RATE * F.abs(a["mean"] - x)).alias("deviation"),
        ),
    )
    return one.select(by, state.alias("s")).select(by, "s.mean", "s.deviation", F.greatest(F.lit(least), F.col("s.mean") + STD_FACTOR * F.col("s.deviation")).alias("rto"))


def suspicions(beats: DataFrame, host: str, period: str) -> DataFrame:
    """(host, period, event) of a detector that looks at each period's heartbeats and those of the period before.

    A host fails in the second period without one, and is restored in the first with one again. ``beats``: (host, period).
    """
    active = beats.select(host, period).distinct()
    ends = beats.agg(F.min(period).alias("__first"), F.max(period).alias("__last"))
    w = Window.partitionBy(host).orderBy(period)
    seen = active.withColumns({"__before": F.lag(period).over(w), "__after": F.lead(period).over(w)}).join(F.broadcast(ends))  # one row
    failed = seen.where((F.coalesce("__after", F.lit(1 << 62)) > F.col(period) + 2) & (F.col(period) + 2 <= F.col("__last"))).select(host, (F.col(period) + 2).alias(period), F.lit("failed").alias("event"))
    back = seen.where(F.when(F.col("__before").isNull(), F.col(period) > F.col("__first")).otherwise(F.col("__before") < F.col(period) - 2)).select(host, F.col(period), F.lit("restored").alias("event"))
    return failed.unionByName(back)


def late_answers(beats: DataFrame, host: str, at: str, rto: DataFrame) -> DataFrame:
    """(host, at, gap): answers that came later than the host's timeout after the one before. ``rto``: (host, rto)."""
    w = Window.partitionBy(host).orderBy(at)
    gap = (F.col(at) - F.lag(at).over(w)).cast("double")
    return beats.withColumn("gap", gap).join(rto.select(host, "rto"), host).where(F.col("gap") > F.col("rto")).select(host, at, "gap")


def throughput(transfers: DataFrame, by: list[str], size: str, millis: str) -> DataFrame:
    """(by, bytes, millis, kb_per_s) of transfers."""
    total = transfers.groupBy(*by).agg(F.sum(size).alias("bytes"), F.sum(millis).alias("millis"))
    return total.withColumn("kb_per_s", F.when(F.col("millis") > 0, F.col("bytes") / F.col("millis") * 1000 / 1024).otherwise(0.0))
