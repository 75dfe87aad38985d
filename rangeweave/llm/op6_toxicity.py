"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of a text, a few numbers about its shape, and the
probabilities of the categories before it. While fitting, those probabilities are out-of-fold: of models that have not
seen the row. The labels table has two categories, low quality (quality 0) and toxic; the chain runs in that order, and
takes any list.

A model is a logistic regression with a ridge, fitted by Newton steps, on the words whose share differs most between the
classes (a two-sample z of ``MIN_Z`` or more, ``MAX_WORDS`` at most), counted in a grouping by word. It is fitted in one task per category and fold on
at most ``TRAIN_ROWS`` labelled texts, those whose doc_id has the smallest hashes. A category is given from the threshold
on that serves its out-of-fold probabilities best (:func:`best_threshold`). Every document is scored.

Words are runs of ASCII letters (in lower case), digits and all characters beyond ASCII.

Edge cases: a null or empty text has no words and is scored by the rest. Labels that are null, of no document or without
a doc_id don't count; of several labels for one doc_id the largest counts; of several documents with one doc_id each is
a row, but equal ones are fitted on once. Without labelled rows, or with one class, a category's probability is its share
among them (0 for none) and its threshold 0.5.
Repeated rows and null ids give a row each; extra columns are not carried.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeweave.llm.common import table, whole, written
from rangeweave.llm.hashing import words

TRAIN_ROWS = 20_000
FOLDS = 3
#: The group of rows that the final models are fitted on.
ALL = -1
MIN_Z, MIN_ROWS, MAX_WORDS = 4.0, 5, 1024
RIDGE, STEPS = 1.0, 20
#: Rows whose numbers are worked out at a time; the words of all rows of a fit are a byte each.
BLOCK_ROWS = 1024
#: Category: its mark (1 or 0) as an SQL expression over the labels table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!{}[]@^~=+/\\"


def distinct_words(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's words, each once."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for hashes, whose, *_ in words(texts):
        starts = np.flatnonzero(np.diff(whose, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(whose)), strict=False):
            parts[int(whose[a])].append(hashes[a:b])
    none = np.zeros(0, np.uint64)
    return [np.unique(np.concatenate(p)) if p else none for p in parts]


def shapes(texts: Sequence[bytes], found: Sequence[np.ndarray]) -> np.ndarray:
    """Per text: logs of its bytes and distinct words, shares of capitals and symbols, distinct words a byte."""
    n = np.array([len(t) for t in texts], float)
    d = np.array([len(f) for f in found], float)
    upper = np.array([len(t) - len(t.translate(None, _UPPER)) for t in texts], float)
    symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], float)
    per = np.maximum(n, 1)
    return np.stack([np.log1p(n), np.log1p(d), upper / per, symbols / per, d / per], axis=1)


class Model:
    """One category's probability from words and numbers; a constant without two classes."""

    def __init__(self, share: float):
        self.share = share
        self.threshold = 0.5
        self.vocabulary = np.zeros(0, np.uint64)
        self.weights: np.ndarray | None = None

    def marks(self, found: Sequence[np.ndarray]) -> np.ndarray:
        """A byte per text and word of the vocabulary: 1 where the text has the word."""
        x = np.zeros((len(found), len(self.vocabulary)), np.uint8)
        sizes = np.array([len(f) for f in found])
        if len(self.vocabulary) and sizes.sum():
            every, row = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
            at = np.minimum(np.searchsorted(self.vocabulary, every), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == every
            x[row[hit], at[hit]] = 1
        return x

    def design(self, marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        scaled = (numbers - self.center) / self.scale
        return np.concatenate([marks, scaled.astype(np.float32), np.ones((len(marks), 1), np.float32)], axis=1, dtype=np.float32)

    def _steps(self, n: int) -> Iterator[slice]:
        return (slice(a, a + BLOCK_ROWS) for a in range(0, n, BLOCK_ROWS))

    def fit(self, marks: np.ndarray, numbers: np.ndarray, y: np.ndarray) -> Model:
        self.center, self.scale = numbers.mean(axis=0), np.maximum(numbers.std(axis=0), 1e-9)
        ridge = np.full(len(self.vocabulary) + numbers.shape[1] + 1, RIDGE)
        ridge[-1] = 0.0
        w = np.zeros(len(ridge))
        w[-1] = np.log(self.share / (1 - self.share))
        for _ in range(STEPS):
            slope, curve = -ridge * w, np.diag(ridge + 1e-6)
            for at in self._steps(len(y)):
                x = self.design(marks[at], numbers[at]).astype(np.float64)
                q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope += x.T @ (y[at] - q)
                curve += (x * (q * (1 - q))[:, None]).T @ x
            step = np.linalg.solve(curve, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def predict(self, found: Sequence[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(found), float(self.share))
        p = [1 / (1 + np.exp(-np.clip(self.design(self.marks(found[at]), numbers[at]) @ self.weights, -30, 30))) for at in self._steps(len(found))]
        return np.concatenate(p) if p else np.zeros(0)


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(place, fold, words, numbers, y_<category>...) of the rows that models are fitted on."""
    names = [f"y_{c}" for c in categories]
    marks = labels.where("doc_id IS NOT NULL").select("doc_id", *[F.expr(x).cast("double").alias(n) for n, x in zip(names, categories.values(), strict=True)]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    place = F.xxhash64("doc_id", "text").alias("place")
    few = docs.select("doc_id", place).join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "place").limit(train_rows)
    few = F.broadcast(few.withColumnsRenamed({"doc_id": "__id", "place": "__place"}))  # train_rows rows of numbers at most
    rows = docs.select("doc_id", "text", place).join(few, (F.col("doc_id") == F.col("__id")) & (F.col("place") == F.col("__place"))).dropDuplicates(["place"])
    rows = rows.select("place", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), whole(F.col("text")).cast("binary").alias("t"), *names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            found = distinct_words(texts)
            out = b.drop(columns="t")
            out.insert(2, "words", [f.view(np.int64) for f in found])
            out.insert(3, "numbers", list(shapes(texts, found)))
            yield out

    return written(rows.mapInPandas(run, "place long, fold int, words array<long>, numbers array<double>, " + ", ".join(f"{n} double" for n in names)))


def _arrays(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.asarray(w, np.int64).view(np.uint64) for w in rows["words"]], np.stack(rows["numbers"].to_list()).astype(float)


def _vocabularies(train: DataFrame, label: str) -> dict[int, np.ndarray]:
    """The words of each group's model: of those in ``MIN_ROWS`` of its texts, those whose share differs most."""
    y, word = F.col(label), F.col("word")
    totals = {r["fold"]: (r["n"], r["n1"]) for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n1")).collect()}
    own = lambda x, f: F.sum(F.when(F.col("fold") == f, x).otherwise(0.0))
    counts = train.select("fold", label, F.explode("words").alias("word")).groupBy("word").agg(*[own(x, f).alias(f"{name}{f}") for f in range(FOLDS) for name, x in (("n", F.lit(1.0)), ("b", y))])
    scored = []
    for part in (ALL, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != part]
        n, n1 = (sum(totals.get(f, (0, 0.0))[k] for f in folds) for k in (0, 1))
        if 0 < n1 < n:
            rows, bad = (sum((F.col(f"{name}{f}") for f in folds), F.lit(0.0)) for name in "nb")
            p = rows / n
            z = F.abs((bad / n1 - (rows - bad) / (n - n1)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1))))
            scored.append(F.when((rows >= MIN_ROWS) & (z >= MIN_Z), F.struct(F.lit(part).alias("part"), z.alias("z"))))
    found: dict[int, list[int]] = {}
    if scored:
        best = W.partitionBy("part").orderBy(F.desc("z"), word.bitwiseXOR(F.lit(-1 << 63)))  # hashes count as unsigned
        rows = counts.select("word", F.explode(F.array_compact(F.array(*scored))).alias("s")).select("word", "s.*")
        for r in rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MAX_WORDS).select("part", "word").collect():  # FOLDS + 1 vocabularies
            found.setdefault(r["part"], []).append(r["word"])
    return {part: np.sort(np.array(w, np.int64).view(np.uint64)) for part, w in found.items()}


def _fit_groups(train: DataFrame, label: str) -> dict[int, Model]:
    """Models by fold that were fitted without it, and the one of all rows: a task for each. Rows come to it with a bit
    for each word of its vocabulary."""
    vocabularies = _vocabularies(train, label)

    def model(part: int, share: float) -> Model:
        out = Model(share)
        out.vocabulary = vocabularies.get(part, out.vocabulary)
        return out

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, _ = _arrays(rows)
            for part in (ALL, *range(FOLDS)):
                at = np.flatnonzero(rows["fold"].to_numpy() != part)
                bits = np.packbits(model(part, 0.0).marks([found[i] for i in at]), axis=1)
                yield rows.iloc[at][["place", "numbers", label]].assign(part=part, marks=[b.tobytes() for b in bits])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        y, part = rows[label].to_numpy(float), int(rows["part"].iloc[0])
        out = model(part, float(y.mean()))
        if 0 < out.share < 1:
            bits = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)
            out.fit(np.unpackbits(bits, axis=1, count=len(out.vocabulary)), np.stack(rows["numbers"].to_list()).astype(float), y)
        return pd.DataFrame({"part": [part], "model": [pickle.dumps(out)]})

    rows = train.mapInPandas(spread, f"place long, numbers array<double>, {label} double, part int, marks binary")
    return {r["part"]: pickle.loads(bytes(r["model"])) for r in rows.groupBy("part").applyInPandas(one, "part int, model binary").collect()}  # FOLDS + 1 models


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on the harmonic mean of precision and recall is best; of equals the one in the middle
    between it and the next lower probability. 0.5 where there aren't two classes."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(p[1:] != p[:-1], True))
    k = ends[np.argmax(2 * hits[ends] / (ends + 1 + y.sum()))]
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def fit_chain(train: DataFrame, categories: Sequence[str]) -> list[Model]:
    """The models, in order, each with its threshold. ``train`` gains each category's out-of-fold probability before the
    next is fitted."""
    chain = []
    for category in categories:
        models = _fit_groups(train, f"y_{category}")
        model = models.get(ALL, Model(0.0))
        chain.append(model)

        def extend(batches: Iterator[pd.DataFrame], models: dict[int, Model] = models) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found, numbers = _arrays(rows)
                fold = rows["fold"].to_numpy()
                p = np.zeros(len(rows))
                for f in np.unique(fold):
                    at = np.flatnonzero(fold == f)
                    p[at] = models.get(int(f), models[ALL]).predict([found[i] for i in at], numbers[at])
                yield rows.assign(numbers=list(np.column_stack([numbers, p])))

        train = written(train.mapInPandas(extend, train.schema))
        seen = train.select(F.element_at("numbers", -1).alias("p"), F.col(f"y_{category}").alias("y")).toPandas()  # two numbers for each row fitted on
        model.threshold = best_threshold(seen["p"].to_numpy(float), seen["y"].to_numpy(float))
    return chain


def score(docs: DataFrame, chain: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """(doc_id, p_<category>..., <category>...) of every document."""
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a in range(0, len(rows), 512):
                part = rows.iloc[a : a + 512]
                texts = part["t"].tolist()
                found = distinct_words(texts)
                numbers = shapes(texts, found)
                out = {"doc_id": part["doc_id"]}
                for name, model in zip(names, chain, strict=True):
                    out[name] = p = model.predict(found, numbers)
                    numbers = np.column_stack([numbers, p])
                for c, name, model in zip(categories, names, chain, strict=True):
                    out[c] = out[name] >= model.threshold
                yield pd.DataFrame(out)

    return docs.select("doc_id", whole(F.col("text")).cast("binary").alias("t")).mapInPandas(run, "doc_id long, " + ", ".join([f"{n} double" for n in names] + [f"{c} boolean" for c in categories]))


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    categories = categories or CATEGORIES
    chain = fit_chain(labelled(docs, labels, categories), list(categories))
    return score(docs, chain, list(categories))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
