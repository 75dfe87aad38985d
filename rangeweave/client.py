"""The engine's verbs over a stored key space: namespaces, point and range reads, writes, conditional writes.

A store is a folder: ``schemas`` (the catalog), ``log`` (operations in order, appended) and ``cells`` (the state as of a
position, sorted by key). Reads merge the cells with the log behind them; :meth:`Store.compact` moves the boundary. One
writer at a time: a position is the log's length when it is written.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeweave.functions import keys
from rangeweave.functions.ranges import KeyRange
from rangeweave.operators import log as L
from rangeweave.operators.cells import MAX_VALUE
from rangeweave.operators.scan import Scan

LOG = "pos long, key binary, op string, value binary, expected binary"
CELLS = "key binary, value binary"
SCHEMAS = "version long, name string, schema_id binary, meta map<string,string>, dropped boolean"


def _small(ops: DataFrame) -> DataFrame:
    """``ops``; the job fails on a value that is too large to be stored."""
    ok = F.coalesce(F.octet_length("value"), F.lit(0)) <= MAX_VALUE
    return ops.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit(f"value over {MAX_VALUE} bytes")).cast("binary")))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # storage

    def _there(self, name: str) -> bool:
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _snapshots(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(path)]
        return sorted(int(n[6:]) for n in names if n.startswith("cells-") and self._there(n))

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def cells(self) -> DataFrame:
        """(key, value) now: the last snapshot with the log after it folded in."""
        done = self._snapshots()
        rest = self.log()
        if not done:
            return L.fold(rest)
        base = self._read(f"cells-{done[-1]}", CELLS).select(F.lit(done[-1]).cast("long").alias("pos"), "key", F.lit("put").alias("op"), "value", F.lit(None).cast("binary").alias("expected"))
        touched = rest.where(F.col("pos") > done[-1])
        keep = base.join(touched.select("key").distinct(), "key", "left_anti").select("key", "value")
        return keep.unionByName(L.fold(base.join(touched.select("key").distinct(), "key", "left_semi").unionByName(touched)))

    def _next(self) -> int:
        last = self.log().agg(F.max("pos")).first()[0]
        return max([-1 if last is None else last, *self._snapshots()]) + 1

    def append_log(self, ops: DataFrame) -> None:
        """Appends operations (key, op, value, expected, n), ordered by n."""
        first = self._next()
        ops.select((F.col("n") + first).cast("long").alias("pos"), "key", "op", "value", "expected").write.mode("append").parquet(f"{self.path}/log")

    def _do(self, key: bytes, op: str, value: bytes | None = None, expected: bytes | None = None) -> None:
        row = (bytearray(key), op, None if value is None else bytearray(value), None if expected is None else bytearray(expected), 0)
        self.append_log(_small(self.spark.createDataFrame([row], "key binary, op string, value binary, expected binary, n long")))

    def compact(self) -> int:
        """Writes the state as of now as sorted cells and gives its position; earlier snapshots stay readable."""
        upto = self._next() - 1
        cells = self.cells().repartitionByRange("key").sortWithinPartitions("key")
        cells.write.mode("overwrite").parquet(f"{self.path}/cells-{upto}")
        return upto

    # namespaces

    def schemas(self) -> DataFrame:
        """(name, schema_id, meta) of the namespaces that exist."""
        last = Window.partitionBy("name").orderBy(F.col("version").desc())
        return self._read("schemas", SCHEMAS).withColumn("__n", F.row_number().over(last)).where("__n = 1 AND NOT dropped").select("name", "schema_id", "meta")

    def _meta(self, name: str) -> dict | None:
        row = self.schemas().where(F.col("name") == name).first()
        return None if row is None else dict(row["meta"] or {})

    def _change(self, name: str, meta: dict | None) -> None:
        version = (self._read("schemas", SCHEMAS).agg(F.max("version")).first()[0] or 0) + 1
        row = (version, name, bytearray(self.prefix(name)), meta, meta is None)
        self.spark.createDataFrame([row], SCHEMAS).write.mode("append").parquet(f"{self.path}/schemas")

    @staticmethod
    def prefix(name: str) -> bytes:
        digest, i = hashlib.md5(name.encode()).digest(), 0
        while digest.startswith(keys.RESERVED):
            digest, i = hashlib.md5(digest + keys.int_bytes(i)).digest(), i + 1
        return digest

    def create_schema(self, name: str, meta: dict[str, str] | None = None) -> str:
        """SUCCESS, also where the namespace exists with the same metadata; EXISTS where it has other."""
        old = self._meta(name)
        if old is not None:
            return "SUCCESS" if old == (meta or {}) else "EXISTS"
        self._change(name, meta or {})
        return "SUCCESS"

    def drop_schema(self, name: str) -> str:
        if self._meta(name) is None:
            return "NO_SUCH_SCHEMA"
        self._change(name, None)
        return "SUCCESS"

    def _key(self, schema: str, key: bytes) -> bytes:
        if self._meta(schema) is None:
            raise KeyError(f"no namespace {schema}")
        return self.prefix(schema) + key

    # reads

    def get(self, schema: str, key: bytes) -> bytes | None:
        row = self.cells().where(F.col("key") == keys.literal(self._key(schema, key))).first()
        return None if row is None else bytes(row["value"])

    def scan(self, schema: str, span: KeyRange, items: int | None = None, size: int | None = None) -> DataFrame:
        """(key, value) of a range of a namespace, keys without its prefix."""
        self._key(schema, b"")
        prefix = self.prefix(schema)
        cells = self.cells().select("key", F.lit(0).alias("version"), "value", F.lit(False).alias("is_tombstone"))
        rows = Scan(span.within(prefix), items=items, bytes=size).rows(cells)
        return rows.select(F.substring("key", len(prefix) + 1, 1 << 20).alias("key"), "value")

    def prefix_scan(self, schema: str, prefix: bytes) -> DataFrame:
        return self.scan(schema, KeyRange.prefix(prefix))

    def all(self, schema: str) -> DataFrame:
        return self.scan(schema, KeyRange.starting(b""))

    # writes

    def put(self, schema: str, key: bytes, value: bytes) -> None:
        self._do(self._key(schema, key), "put", value)

    def delete(self, schema: str, key: bytes) -> None:
        self._do(self._key(schema, key), "delete")

    def put_if_absent(self, schema: str, key: bytes, value: bytes) -> None:
        self._do(self._key(schema, key), "put_if_absent", value)

    def append(self, schema: str, key: bytes, tail: bytes) -> None:
        self._do(self._key(schema, key), "append", tail)

    def cas(self, schema: str, key: bytes, old: bytes | None, new: bytes) -> None:
        self._do(self._key(schema, key), "cas", new, old)

    def load(self, schema: str, rows: DataFrame) -> None:
        """Puts all rows (key, value) of a DataFrame in their order, deletes where the value is null.

        Rows are written with the partition they came in and their place in it; positions follow from the partitions'
        sizes, so each row has its own and none is left out.
        """
        prefix = keys.literal(self._key(schema, b""))
        op = F.when(F.col("value").isNull(), "delete").otherwise("put")
        at = F.monotonically_increasing_id()
        staged = rows.select(F.concat(prefix, "key").alias("key"), op.alias("op"), "value", F.lit(None).cast("binary").alias("expected"), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        path = f"{self.path}/staged-{uuid.uuid4().hex}"
        _small(staged).write.parquet(path)
        staged = self.spark.read.schema(staged.schema).parquet(path)
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        sizes = staged.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
        self.append_log(staged.join(F.broadcast(sizes), "part").withColumn("n", F.col("before") + F.col("place")).drop("part", "place", "before"))
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    def multi(self, schema: str, conditions: dict[bytes, bytes | None], success: dict[bytes, bytes | None], failure: dict[bytes, bytes | None] | None = None) -> bool:
        """Whether all conditions (key: its value, None for absent) hold; then ``success`` is written, else ``failure``, as
        one append to the log. A value of None deletes."""
        prefix = self._key(schema, b"")
        wanted = {prefix + k: v for k, v in conditions.items()}
        found = {}
        if wanted:
            rows = self.cells().where(F.col("key").isin(*[keys.literal(k) for k in wanted])).collect()  # at most a row a condition
            found = {bytes(r["key"]): bytes(r["value"]) for r in rows}
        passed = all(found.get(k) == v for k, v in wanted.items())
        writes = success if passed else failure or {}
        if writes:
            out = [(bytearray(prefix + k), "delete" if v is None else "put", None if v is None else bytearray(v), None, n) for n, (k, v) in enumerate(writes.items())]
            self.append_log(_small(self.spark.createDataFrame(out, "key binary, op string, value binary, expected binary, n long")))
        return passed
