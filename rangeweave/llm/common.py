"""What the training-data operators share: reading, checkpoints, small text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where the session names none and runs in one process
    (tests); a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rangeweave-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: lineage ends here and columns can be pruned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """(row): the rows of ``docs`` as a struct each, so that no column of theirs clashes with one that is added."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def fields(docs: DataFrame, other: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs`` out of a packed ``row``, some of them given anew."""
    return [(other or {}).get(c, F.col("row")[c]).alias(c) for c in docs.columns]
