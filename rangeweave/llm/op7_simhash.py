"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two
bits agree wholly in one segment, and differ in at most two bits in any other. So for each segment a key joins its
exact value with an index of the next segment that forgives two errors: the segment (as a 23-bit word) is decoded with
the perfect binary Golay code. A word within two bits of a codeword gets that codeword's 12-bit index; a word three
bits away gets it and those of the five codewords four bits away. Words at most two bits apart always share an index.
Fingerprints that share a key are joined and verified.

Equal fingerprints are one node, so copies are never paired. A key shared by more than ``BUCKET`` fingerprints isn't
paired either: each of its fingerprints goes to the 65 words within one bit of it, and two fingerprints differ in at
most two bits exactly where they meet in such a word, which can hold 65 fingerprints at most. So no link is lost and
work stays linear in the distinct fingerprints.

Edge cases: a null or empty text has fingerprint zero and links like any other. A null ``doc_id`` gets a row, but is a
component's id only where no other is there. Repeated rows give a row each. Extra columns are not carried by
:func:`components` and are kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeweave.llm.common import fields, packed, table, whole, written
from rangeweave.llm.components import connected

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Keys shared by more fingerprints than this are linked by way of the words one bit away.
BUCKET = 64
#: (shift, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the [23, 12, 7] code.
GENERATOR = 0b110001110101
#: Shingles of one document whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(words, islice(words, 1, None), islice(words, 2, None))), len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    while part := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, CHUNK)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows["doc_id"], "h": rows["h"], "fp": np.array([fingerprint(t) for t in rows["t"]], dtype=np.uint64).view(np.int64)})


@cache
def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (11 bits): how many codewords lie near a word (1 or 6), and what to add to reach each."""
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            s = int(_syndrome(np.array([e]))[0])
            if weight < 4 or found[s] and found[s][0].bit_count() == 3:
                found[s].append(e)
    masks = np.zeros((len(found), 6), dtype=np.int64)
    for s, x in enumerate(found):
        masks[s, : len(x)] = x
    return np.array([len(x) for x in found]), masks


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator; zero for codewords."""
    rest = words.astype(np.int64)
    for i in range(22, 10, -1):
        rest = np.where(rest >> i & 1, rest ^ (GENERATOR << (i - 11)), rest)
    return rest


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``fps``, key) of all keys of the unsigned 64-bit fingerprints."""
    counts, masks = _error_patterns()
    whose, keys = [], []
    cut = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    for i, exact in enumerate(cut):
        word = cut[(i + 1) % len(cut)]
        s = _syndrome(word)
        for k in range(6):
            has = np.flatnonzero(counts[s] > k)
            index = (word[has] ^ masks[s[has], k]) >> 11  # the codeword's 12 information bits
            whose.append(has)
            keys.append((exact[has] << 12 | index) << 2 | i)
    return np.concatenate(whose), np.concatenate(keys)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        fps = rows["fp"].to_numpy(dtype=np.int64)
        whose, keys = golay_keys(fps.view(np.uint64))
        yield pd.DataFrame({"key": keys, "fp": fps[whose]})


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links enough to join all distinct fingerprints (column fp) within two bits of each other."""
    keys = written(fps.mapInPandas(_keys, "key long, fp long"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keys.join(shared, "key"))
    few = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_set("fp").alias("all"))
    near = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    paired = few.select(F.explode(near).alias("e")).select("e.*").distinct()
    many = met.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    stars = many.select("fp", F.explode(flips).alias("word")).groupBy("word").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return paired.union(stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct())


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, fp, component_id) of every document; h is the hash that tells texts of one doc_id apart."""
    at = docs.select("doc_id", whole(F.col(text)).alias("t"))
    rows = written(at.select("doc_id", F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("t")).mapInPandas(_fingerprints, "doc_id long, h long, fp long"))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(fps.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id (then text hash), with all its columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("k")
    keys = ["none", "id", "h"]
    kept = components(docs).groupBy("root").agg(first).select(*[f"k.{c}" for c in keys])
    at = packed(docs).select("row", F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(whole(F.col("row")["text"])).alias("h"))
    at = at.select("row", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    once = Window.partitionBy(*keys).orderBy(*keys)
    # repeated rows share a key; SMJ leaves them side by side, so the window sorts and shuffles nothing anew
    return at.join(kept, keys).withColumn("n", F.row_number().over(once)).where("n = 1").select(*fields(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
