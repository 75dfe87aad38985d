"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages: windows that start every ``SEGMENT`` words and are as long as a benchmark item needs to
lie inside one. Passages and items are TF-IDF vectors over the items' words (no other word can bring a passage nearer
to an item), with document frequencies counted over the segments of all documents. A truncated SVD maps them to
``RANK`` latent dimensions; passages whose cosine with an item is at least ``COSINE`` are candidates, and each is read
against the item word by word.

The SVD is a distributed randomised one: workers multiply their part of the passage matrix A with a random block,
the sums of A'(AQ) are orthonormalised, ``POWERS`` times over. It is fitted on all passages of all documents (read once
and kept as sparse rows) and the items themselves, weighed so that both have the same energy.
All passages of all documents are then searched. ``COSINE`` is low, as a short item fills little more than half of its
window, and words in between that other items use lower the cosine even of an exact copy.

A candidate is a leak if the longest common subsequence of item and passage holds ``SAME`` of the item's weight (IDF),
or if it holds ``PARAPHRASED`` of it and the item's answer - its last sentence, or its last ``ANSWER_WORDS`` words where
that is shorter - is there in order to ``ANSWER``.

The benchmark is the query set: it is searched in blocks of about ``BLOCK_BYTES`` of items, each of which fits the driver:
what a block costs there is its words times ``RANK``, a few times over. An item is searched and judged whole, however long.

Edge cases: null or empty texts have no leaks; items without words match nothing; a null item_id is reported as null.
Repeated rows are judged each by itself. :func:`clean` keeps all columns, whatever their names. Texts of any length are
read in buffers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from rangeweave.llm.common import table, whole, written
from rangeweave.llm.hashing import words

SEGMENT = 16
RANK = 96
POWERS = 2
#: Words of the vocabulary whose sums over all parts are added up in one group.
PIECE = 64
COSINE = 0.4
SAME, PARAPHRASED, ANSWER = 0.8, 0.6, 0.9
ANSWER_WORDS = 8
BLOCK_BYTES = 400_000
_LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType())]))


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([h for h, *_ in words([text.encode()])] or [np.zeros(0, np.uint64)])


class Benchmark:
    """A block of items as hashed words, with what passages are measured by."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.answers: list[int] = []
        for item, text in items:
            h = _hashes(text)
            last = [s for s in re.split(r"[.!?]+\s+|\n+", text.strip()) if s][-1:] or [""]
            if len(h):
                self.ids.append(item)
                self.words.append(h)
                self.answers.append(min(max(len(_hashes(last[0])), ANSWER_WORDS), len(h)))
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, w) for w in self.words]
        #: segments that a window needs to hold an item wherever it begins
        self.spans = np.array([(len(w) + SEGMENT - 1 + SEGMENT - 1) // SEGMENT for w in self.words])
        bits = max(16, int(len(self.vocabulary) * 8).bit_length())
        self._mask = np.uint64((1 << bits) - 1)
        self._slots: np.ndarray | None = None
        self._here = np.zeros(len(self.vocabulary), bool)
        self.idf = np.ones(len(self.vocabulary))
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)
        self.latent = np.zeros((0, 0), np.float32)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for other words. A table over some bits of the hash drops most other words."""
        if self._slots is None:
            self._slots = np.zeros(int(self._mask) + 1, bool)
            self._slots[(self.vocabulary & self._mask).astype(np.int64)] = True
        out = np.full(len(hashes), -1)
        may = np.flatnonzero(self._slots[(hashes & self._mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[may]), len(self.vocabulary) - 1)
        out[may] = np.where(self.vocabulary[at] == hashes[may], at, -1)
        return out

    def weigh(self, frequencies: np.ndarray, segments: int) -> None:
        self.idf = np.log((1 + segments) / (1 + frequencies)) + 1e-3
        self.totals = np.array([self.idf[t].sum() for t in self.terms])
        item, self.distinct, counts = self._distinct()
        self.distinct_weights = counts * self.idf[self.distinct]
        self.distinct_starts = np.flatnonzero(np.diff(item, prepend=-1))
        self.distinct_sizes = np.diff(np.append(self.distinct_starts, len(item)))

    def _distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the vocabulary, how often) of the items' different words, in order of item and place."""
        item = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        pairs, counts = np.unique(item * len(self.vocabulary) + np.concatenate(self.terms), return_counts=True)
        return *np.divmod(pairs, len(self.vocabulary)), counts

    def item_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items' TF-IDF rows, each of length 1: (item, place in the vocabulary, value) in order of item and place."""
        item, term, counts = self._distinct()
        values = counts * self.idf[term]
        norm = np.sqrt(np.add.reduceat(values**2, np.flatnonzero(np.diff(item, prepend=-1))))
        return item, term, values / np.maximum(norm, 1e-12)[item]

    def project(self, basis: np.ndarray) -> None:
        self.basis = (basis * self.idf[:, None]).astype(np.float32)
        item, term, values = self.item_rows()
        latent = _weighted(values, basis, term, np.flatnonzero(np.diff(item, prepend=-1)))
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def same(self, item: int, passage: np.ndarray) -> float | None:
        """The share of the item's weight that a passage (places in the vocabulary) holds in order, if it is a leak."""
        terms = self.terms[item]
        weights = self.idf[terms]
        total, tail = weights.sum(), self.answers[item]
        self._here[passage] = True
        shared = weights[self._here[terms]].sum()
        self._here[passage] = False
        if shared < min(SAME, PARAPHRASED) * total:
            return None
        best = _common_weight(terms, weights, passage) / total
        if best >= SAME:
            return best
        answer = weights[-tail:]
        return best if best >= PARAPHRASED and _common_weight(terms[-tail:], answer, passage) >= ANSWER * answer.sum() else None


def _common_weight(terms: np.ndarray, weights: np.ndarray, passage: np.ndarray) -> float:
    """Weight of the heaviest common subsequence."""
    row = np.zeros(len(passage) + 1)
    for t, w in zip(terms, weights, strict=True):
        row[1:] = np.maximum(row[1:], row[:-1] + w * (passage == t))
        np.maximum.accumulate(row, out=row)
    return float(row[-1])


def _segments(b: Benchmark, hashes: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the vocabulary, segment) of each word, and the first segment of each run of one text."""
    starts = np.flatnonzero(np.diff(whose, prepend=-1))
    sizes = np.diff(np.append(starts, len(whose)))
    counts = (sizes + SEGMENT - 1) // SEGMENT
    first = np.cumsum(counts) - counts
    segment = np.repeat(first, sizes) + (np.arange(len(whose)) - np.repeat(starts, sizes)) // SEGMENT
    return b.look_up(hashes), segment, first


def _read(b: Benchmark, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages (here pairs of segments) as sparse rows, a buffer of texts at a time: how many different words of the
    vocabulary each has, which, and how often. Then a row with the segments that hold each word, and with all segments."""
    counts, segments = np.zeros(len(b.vocabulary), np.int64), 0
    for rows in batches:
        for hashes, whose, *_ in words(rows["t"].tolist()):
            if len(hashes):
                terms, segment, first = _segments(b, hashes, whose)
                has, n = terms >= 0, int(segment[-1]) + 1
                segments += n
                if not has.any():
                    continue
                runs = np.diff(np.append(first, n))
                halves = (runs + 1) // 2
                passage_of = np.repeat(np.cumsum(halves) - halves, runs) + (np.arange(n) - np.repeat(first, runs)) // 2
                pairs, often = np.unique(segment[has] * len(b.vocabulary) + terms[has], return_counts=True)
                segment, term = np.divmod(pairs, len(b.vocabulary))
                counts += np.bincount(term, minlength=len(b.vocabulary))
                passage = passage_of[segment]
                order = np.argsort(passage * len(b.vocabulary) + term, kind="stable")  # a word of both segments is there twice
                sizes = np.diff(np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(passage)))
                yield pd.DataFrame({"sizes": [sizes.astype(np.uint8).tobytes()], "terms": [term[order].astype(np.int32).tobytes()], "often": [often[order].astype(np.uint8).tobytes()], "segments": [0]})
    yield pd.DataFrame({"sizes": [b""], "terms": [counts.tobytes()], "often": [b""], "segments": [segments]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, n) of the counts of :func:`_read`, and all segments as term -1."""
    total, segments = 0, 0
    for rows in batches:
        for x, n in zip(rows["terms"], rows["segments"], strict=True):
            total, segments = total + np.frombuffer(x, np.int64), segments + n
    if segments:
        yield pd.DataFrame({"term": np.arange(-1, len(total)), "n": np.concatenate(([segments], total))})


def _weighted(values: np.ndarray, block: np.ndarray, which: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of entries, the sum of the rows ``which`` of ``block``, each times its value; groups begin at
    ``starts`` and end where the next begins. All groups of a size are one stack of small products."""
    sizes = np.diff(np.append(starts, len(values)))
    out = np.empty((len(starts), block.shape[1]), np.result_type(values, block))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        at = starts[order[a:b], None] + np.arange(sizes[order[a]])
        out[order[a:b]] = np.matmul(values[at][:, None], block[which[at]])[:, 0]
    return out


def _add_product(total: np.ndarray, block: np.ndarray, row: np.ndarray, term: np.ndarray, values: np.ndarray) -> None:
    """Adds A'(A block) to ``total``; A is sparse, its entries in order of row, rows numbered without a gap."""
    product = _weighted(values, block, term, np.flatnonzero(np.diff(row, prepend=-1)))
    order = np.argsort(term, kind="stable")
    at = np.flatnonzero(np.diff(term[order], prepend=-1))
    total[term[order][at]] += _weighted(values[order], product, row[order], at)


def _sketch(b: Benchmark, block: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """This part's A'(A block) in pieces of ``PIECE`` words, and its share of A's energy."""
    total, energy, block = np.zeros(block.shape), 0, block.astype(np.float32)
    for rows in batches:
        for sizes, terms, often in zip(rows["sizes"], rows["terms"], rows["often"], strict=True):
            sizes, term = np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(terms, np.int32)
            values = np.frombuffer(often, np.uint8) * b.idf[term]
            # the square of a passage's length: words that are there twice count with their sum
            row = np.repeat(np.arange(len(sizes)), sizes)
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])))
            row, term, values = row[new], term[new], np.add.reduceat(values, new)
            norm = np.sqrt(np.bincount(row, weights=values**2, minlength=len(sizes)))
            _add_product(total, block, row, term, (values / norm[row]).astype(np.float32))
            energy += len(sizes)
    at = range(0, len(total), PIECE)
    yield pd.DataFrame({"piece": list(at), "sums": [total[a : a + PIECE].tobytes() for a in at], "energy": [float(energy)] * len(at)})


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    sums = sum(np.frombuffer(x, np.float64) for x in rows["sums"])
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "sums": [sums.tobytes()], "energy": [rows["energy"].sum()]})


def fit(docs: DataFrame, items: list[tuple[int | None, str]], rank: int = RANK, seed: int = 7) -> Benchmark:
    """The items with IDF weights and a latent basis, both from all of ``docs`` (a column ``t`` of bytes)."""
    b = Benchmark(items)
    n = len(b.vocabulary)
    if not n:
        return b
    read = written(docs.mapInPandas(lambda batches: _read(b, batches), "sizes binary, terms binary, often binary, segments long"))
    is_count = F.length("sizes") == 0
    counted = read.where(is_count).select("terms", "segments").mapInPandas(_summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row per word of the block's items
    frequencies = np.zeros(n + 1, np.int64)
    frequencies[counted["term"].to_numpy() + 1] = counted["n"].to_numpy()
    b.weigh(frequencies[1:], int(frequencies[0]))
    passages = read.where(~is_count).select("sizes", "terms", "often")
    rank = min(rank, n)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, rank)))[0]
    own = b.item_rows()
    schema = "piece long, sums binary, energy double"
    for _ in range(POWERS):
        sums, energy = np.zeros((n, rank)), 0.0
        parts = passages.mapInPandas(lambda batches, q=block: _sketch(b, q, batches), schema).groupBy("piece").applyInPandas(_add_up, schema)
        for p in parts.collect():  # one block of n by rank
            sums[p["piece"] : p["piece"] + PIECE] = np.frombuffer(p["sums"], np.float64).reshape(-1, rank)
            energy = p["energy"]
        mine = np.zeros((n, rank))
        _add_product(mine, block, *own)
        sums += max(1.0, energy / max(len(b.words), 1)) * mine
        block = np.linalg.svd(sums, full_matrices=False)[0]
    b.project(block)
    return b


def _holding(b: Benchmark, places: np.ndarray, at: np.ndarray, stops: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs of a passage (segments ``at`` to ``stops`` of n) and an item share words of enough of the item's
    weight for a leak, in any order. ``places`` are the sorted ``term * n + segment`` of all words."""
    out = np.zeros(len(at), bool)
    sizes = b.distinct_sizes[items]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + (1 << 18), side="right")))
        size = sizes[begin:end]
        starts = np.cumsum(size) - size
        of = np.repeat(b.distinct_starts[items[begin:end]] - starts, size) + np.arange(size.sum())
        base = b.distinct[of] * n
        # the first segment from the passage's own on that holds the word
        found = places[np.minimum(np.searchsorted(places, base + np.repeat(at[begin:end], size)), len(places) - 1)]
        held = (found >= base + np.repeat(at[begin:end], size)) & (found < base + np.repeat(stops[begin:end], size))
        shared = np.add.reduceat(b.distinct_weights[of] * held, starts)
        out[begin:end] = shared >= min(SAME, PARAPHRASED) * b.totals[items[begin:end]] - 1e-6
        begin = end
    return out


def _leaks(b: Benchmark, hashes: np.ndarray, whose: np.ndarray, found: list[dict[int, float]], cosine: float) -> None:
    """Adds to ``found`` (by text) the items of which these words hold a leak."""
    terms, segment, first = _segments(b, hashes, whose)
    has = np.flatnonzero(terms >= 0)
    if not len(has):
        return
    n = int(segment[-1]) + 1
    ends = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    # a common subsequence weighs no more than all words of its passage: lighter passages needn't be looked at
    least = min(SAME, PARAPHRASED) * b.totals - 1e-6
    weight = np.concatenate(([0.0], np.cumsum(np.bincount(segment[has], weights=b.idf[terms[has]], minlength=n))))
    spans = []
    for span in np.unique(b.spans):
        items = np.flatnonzero(b.spans == span)
        stops = np.minimum(np.arange(n) + span, ends)
        able = np.flatnonzero(weight[stops] - weight[:-1] >= least[items].min())
        if len(able):
            spans.append((items, able, stops[able]))
    if not spans:
        return
    starts = np.flatnonzero(np.diff(segment[has], prepend=-1))
    sums = np.zeros((n + 1, b.basis.shape[1]), np.float32)
    sums[1 + segment[has][starts]] = _weighted(np.ones(len(has), np.float32), b.basis, terms[has], starts)
    np.cumsum(sums, axis=0, out=sums)
    hits = []
    for items, able, stops in spans:
        passages = sums[stops] - sums[able]
        norm = np.sqrt(np.einsum("ij,ij->i", passages, passages))
        near = passages @ b.latent[items].T
        at, which = np.nonzero((near >= np.maximum(cosine * norm, 1e-9)[:, None]) & ((weight[stops] - weight[able])[:, None] >= least[items]))
        hits.append((near[at, which] / norm[at], able[at], stops[at], items[which]))
    near, at, stops, items = (np.concatenate(x) for x in zip(*hits, strict=True))
    holding = np.flatnonzero(_holding(b, np.sort(terms[has] * n + segment[has]), at, stops, items, n))
    if not len(holding):
        return
    words_at = np.searchsorted(segment, np.arange(n + 1))
    text = whose[words_at[:-1]]
    for _, at, stop, item in sorted(zip(*(x[holding].tolist() for x in (near, at, stops, items)), strict=True), reverse=True):
        k = int(text[at])
        if item not in found[k]:
            passage = terms[words_at[at] : words_at[stop]]
            if (share := b.same(item, passage[passage >= 0])) is not None:
                found[k][item] = share


def _search(b: Benchmark, cosine: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    longest = int(b.spans.max()) * SEGMENT if len(b.spans) else 0
    for rows in batches:
        found: list[dict[int, float]] = [{} for _ in range(len(rows))]
        kept = np.zeros(0, np.uint64)
        last = -1
        for hashes, whose, *_ in words(rows["t"].tolist()) if longest else ():
            if len(hashes):
                if whose[0] == last:  # a long text goes on: windows begin in what came before
                    hashes, whose = np.concatenate((kept, hashes)), np.concatenate((np.full(len(kept), last), whose))
                last = int(whose[-1])
                kept = hashes[-longest:][whose[-longest:] == last]
                _leaks(b, hashes, whose, found, cosine)
        out = rows.drop(columns="t")
        best: list[dict] = [{} for _ in found]
        for mine, f in zip(best, found, strict=True):
            for item, share in f.items():  # an item_id may stand for several texts
                mine[b.ids[item]] = max(share, mine.get(b.ids[item], 0.0))
        out["leaks"] = [[{"item_id": i, "score": round(s, 4)} for i, s in f.items()] for f in best]
        yield out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, about ``BLOCK_BYTES`` of text at a time."""
    known = benchmark.where("text IS NOT NULL").select("item_id", "text")
    n = -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", cosine: float = COSINE) -> DataFrame:
    """The columns of ``docs`` as c0, c1 and so on, with ``all_leaks``: the (item_id, score) of the items in each text."""
    at = whole(F.col(f"c{docs.columns.index(text)}")).cast("binary").alias("t")
    out = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    known = out.select(at)
    out = out.withColumn("all_leaks", F.array().cast(_LEAKS))
    for items in blocks(benchmark):
        b = docs.sparkSession.sparkContext.broadcast(fit(known, items))  # a block's words and their latent vectors
        schema = StructType([*out.schema.fields, StructField("leaks", _LEAKS)])
        out = out.select("*", at).mapInPandas(lambda batches, b=b: _search(b.value, cosine, batches), schema)
        out = out.withColumn("all_leaks", F.concat("all_leaks", "leaks")).drop("leaks")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with the columns of ``docs``."""
    return mark(docs, benchmark).where(F.size("all_leaks") == 0).drop("all_leaks").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score) of every leak."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = mark(docs.select("doc_id", "text"), benchmark).select(F.col("c0").alias("doc_id"), F.explode("all_leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.score")
