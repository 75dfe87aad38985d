"""Registration of queries and the views of the test tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange
from rangeweave.sources import cells as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, sf_dir: str, span: KeyRange | None = None) -> DataFrame:
    """One cell per order: key of o_orderkey, value o_orderpriority."""
    return store.from_int_column(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderpriority"), span)


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by user: a version per event, a tombstone for each error."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("version", F.row_number().over(w))
    dead = F.col("event_type") == "error"
    return e.select(keys.int_key(F.col("user_id")).alias("key"), "version", F.when(~dead, F.encode("event_type", "UTF-8")).alias("value"), dead.alias("is_tombstone"))


VERSIONS_SQL = """(SELECT printf('%08X', user_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS version,
  CASE WHEN event_type <> 'error' THEN event_type END AS v, event_type = 'error' AS dead FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by event: view and click put, error deletes, signup puts if absent, purchase appends."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "put", "click", "put", "error", "delete", "signup", "put_if_absent", "purchase", "append")])
    op = F.element_at(kind, F.col("event_type"))
    value = F.encode(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), "UTF-8")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), keys.int_key(F.col("user_id")).alias("key"), op.alias("op"), F.when(op != "delete", value).alias("value"), F.lit(None).cast("binary").alias("expected")
    )


def shown(rows: DataFrame) -> DataFrame:
    """(key, value) as hex and text."""
    return rows.select(F.hex("key").alias("key"), F.decode("value", "UTF-8").alias("value"))
