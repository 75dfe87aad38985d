"""Streams over the events table, run until it is read and given back as what their sink holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.plans.base import query, table
from rangeweave.streaming import streams as S


def _folder(spark: SparkSession) -> str:
    """A folder in the shared one; one is made only where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="rangeweave-"))
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _ran(rows: DataFrame, mode: str) -> DataFrame:
    """What the stream has written when all input is read: all rows of appends and updates, the last state of a table."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    else:
        # each batch's result replaces the one before: what is complete is so in the last
        writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/{k}")).start().awaitTermination()
        jvm, path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        last = max(int(s.getPath().getName()) for s in found)
        del jvm
        return spark.read.parquet(*[f"{folder}/out/{k}" for k in (range(last + 1) if mode == "update" else [last])])
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("stream_heartbeats", "SELECT user_id AS host, time_bucket(INTERVAL 10 MINUTES, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_heartbeats(spark, d):
    """Reports a host and ten-minute window."""
    rows = _stream(spark, d).select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"))
    out = _ran(S.latest_reports(rows, "host", "ts", "10 minutes", "1 day"), "update")
    return out.groupBy("host", F.col("window.start").cast("timestamp_ntz").alias("start")).agg(F.max("n").alias("n"))  # the last update has the most


@query("stream_vnode_counters", "SELECT user_id AS vnode, sum(length(props))::BIGINT AS store_size, count(*) AS store_keys FROM events GROUP BY 1")
def stream_vnode_counters(spark, d):
    rows = _stream(spark, d).select(F.col("user_id").alias("vnode"), F.length("props").cast("long").alias("size"), F.lit(1).cast("long").alias("n_keys"))
    return _ran(S.vnode_counters(rows, "vnode"), "complete")


@query("stream_log_contiguous", "SELECT event_id % 4 AS vnode, event_id // 4 AS pos FROM events WHERE event_id // 4 < 96 + event_id % 4")
def stream_log_contiguous(spark, d):
    """Four logs, each with a gap."""
    rows = _stream(spark, d).select((F.col("event_id") % 4).alias("vnode"), F.floor(F.col("event_id") / 4).alias("pos")).where("pos <> 96 + vnode")
    return _ran(S.contiguous(rows, "vnode", 0), "append")
