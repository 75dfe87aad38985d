"""Chat formatting (DataFrame functions only): logged snapshots of growing conversations collapse before rendering.

A log holds a conversation again each time it grows. Every turn gets the hash of its conversation up to it (a running
exclusive-or of 128 bits per turn, each salted with the turn's place, so equal hashes mean equal turn sequences). A
conversation whose whole hash is a turn-prefix hash of a longer one is dropped by an anti-join; of equal conversations
the smallest ``conv_id`` stays. What stays is rendered with one block per turn.

A conversation of any length is spread over tasks (but for turns of one number, which are put in order together): turns are numbered and hashed in blocks of ``BLOCK`` turn numbers,
only block sums are ordered along a whole conversation, and the text is rendered in parts of ``PART`` turns, a row each.

Edge cases: a null ``conv_id`` is a conversation of its own (it loses to any other id among equals); a null turn comes
first; a null role or text is empty; turns with one number are ordered by role, then text; a repeated row counts once.
Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeweave.llm.common import table, whole, written

BLOCK = 512
PART = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, without the right side's keys."""
    names = {k: f"{k}_" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), on, how).drop(*(names.values() if how == "inner" else ()))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, at, role, text, c1, c2): every turn once, its place in its block, 128 bits of hash of it.

    Texts are shuffled here, to be put in order, and when what stays is rendered; all in between works on numbers.
    """
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"), F.floor(F.col("turn") / BLOCK).alias("block"))
    this = F.struct("turn", "role", "text")
    once = rows.withColumn("again", F.lag(this).over(inside).eqNullSafe(this)).where(~F.col("again")).withColumn("at", F.row_number().over(inside))
    return once.select("conv_id", "block", "at", "role", "text", F.xxhash64("role", "text").alias("c1"), F.xxhash64("text", "role", F.lit(1)).alias("c2"))


def _before(blocks: DataFrame, sums: list[str], total) -> DataFrame:
    """(conv_id, block, <sum>_0...): what a conversation's blocks before each add up to."""
    along = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("conv_id", "block", *[F.coalesce(total(c).over(along), F.lit(0)).alias(f"{c}_0") for c in sums])


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, n_0): the turns before each block; (conv_id, n): the maximal conversations and their lengths."""
    keys = ["conv_id", "block"]
    rows = turns.select(*keys, "at", "c1", "c2")
    places = written(_before(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), ["n"], F.sum))
    rows = _same(rows, places, keys).withColumn("pos", F.col("n_0") + F.col("at"))
    rows = rows.select(*keys, "pos", F.xxhash64(F.lit(1), "pos", "c1", "c2").alias("x1"), F.xxhash64(F.lit(2), "pos", "c2", "c1").alias("x2"))
    sums = _before(rows.groupBy(*keys).agg(*[F.bit_xor(x).alias(x) for x in ("x1", "x2")]), ["x1", "x2"], F.bit_xor)
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marks = written(_same(rows, sums, keys).select("conv_id", "pos", *[F.col(f"x{k}_0").bitwiseXOR(F.bit_xor(f"x{k}").over(upto)).alias(f"h{k}") for k in (1, 2)]))
    lengths = marks.groupBy("conv_id").agg(F.max("pos").alias("n"))
    marks = _same(marks, lengths, ["conv_id"])
    first = marks.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = marks.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return places, first.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, in parts of ``PART`` turns counted from 0."""
    turns = written(_turns(conversations))
    places, kept = collapse(turns)
    places = _same(places, kept.select("conv_id"), ["conv_id"], "left_semi")
    stay = _same(turns.select("conv_id", "block", "at", "role", "text"), places, ["conv_id", "block"]).withColumn("pos", F.col("n_0") + F.col("at"))
    said = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    parts = stay.groupBy("conv_id", F.floor((F.col("pos") - 1) / PART).alias("part")).agg(F.collect_list(F.struct("pos", said.alias("said"))).alias("all"))
    return parts.select("conv_id", "part", F.size("all").cast("bigint").alias("n_turns"), F.array_join(F.transform(F.sort_array("all"), lambda x: x["said"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
k AS (SELECT min(conv_id) AS conv_id FROM t WHERE pos = n AND upto NOT IN (SELECT upto FROM t WHERE pos < n) GROUP BY upto)
SELECT t.conv_id, (pos - 1) // {PART} AS part, count(*) AS n_turns,
  string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id, (pos - 1) // {PART}
"""
