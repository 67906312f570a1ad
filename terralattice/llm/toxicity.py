"""Toxicity by a classifier chain of linear models over words and word beginnings.

Categories are predicted in order; the probability of every earlier category is a feature of the later
models.  For training these probabilities come from folds that did not see the row (out of fold), so
that a later model learns from the errors it will meet.  The labels table of the contract query has no several kinds of toxicity: its
chain goes from ``low_quality`` to ``toxic``.

A word gives two features, itself and its first BEGINNING letters; features are hashed to WIDTH numbers, so every word of every text
counts and the model's size is fixed.  A feature's value is the sum of log(1 + 100 n / total) over its words, n of the text's total.

Fitting uses at most about ``train_docs`` labelled rows (the documented bound, picked by a hash of the id).  Only that sample's labels are
broadcast.  Scoring reads every whole text and shuffles nothing.

Null and empty texts have no features and score the models' base rates.  Very long texts are read in pieces cut between words.  Label rows
with a null in any category, or without an id, are left out; repeated label rows, and documents that repeat an id, count as often as they
stand.  Without labelled rows, or with one class only, a category's probability is its base rate (0 without rows) and nothing is flagged.
An empty table gives no rows.  Extra columns pass through; the results' names get more underscores if they are taken.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.llm._common import column, columns, free_prefix, map_rows, prepare, salted_id_fraction
from terralattice.llm.language_id import _WORD, pieces

TRAIN_DOCS, WIDTH = 8000, 1 << 18
FOLDS = 3
BEGINNING = 5
#: Words that a task remembers, and distinct words of texts that it scores at once.
CACHE, AT_ONCE = 200_000, 200_000


def features_of(word: str) -> tuple[int, int]:
    """The numbers of a word and of its beginning; WIDTH, which weighs nothing, where a word is no longer than a beginning."""
    beginning = zlib.crc32(f"{word[:BEGINNING]}*".encode()) % WIDTH if len(word) > BEGINNING else WIDTH
    return zlib.crc32(word.encode()) % WIDTH, beginning


def word_values(text: str | None) -> tuple[list[str], np.ndarray]:
    """A text's distinct words and their values."""
    counts: Counter = Counter()
    for piece in pieces(text or ""):
        counts.update(_WORD.findall(piece.lower()))
    n = np.fromiter(counts.values(), float, len(counts))
    return list(counts), np.log1p(100 * n / max(1.0, n.sum()))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """Logistic regression on sparse rows plus dense extra columns, by gradient descent with a step of its own for every weight."""

    def __init__(self, indptr, indices, values, extra, y, n_features: int, steps: int = 40, penalty: float = 1e-3):
        n = len(y)
        rows = np.repeat(np.arange(n), np.diff(indptr))
        weights, dense, bias = np.zeros(n_features), np.zeros(extra.shape[1]), 0.0
        rate = float(np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6))
        bias = math.log(rate / (1 - rate))
        if 0 < y.sum() < n:
            # Steps shrink with the size of past gradients, so rare features move as readily as common ones.
            x = np.concatenate((weights, dense, [bias]))
            first, second = np.zeros_like(x), np.zeros_like(x)
            cut = (n_features, n_features + extra.shape[1])
            for t in range(1, steps + 1):
                error = (_logistic(np.bincount(rows, values * x[indices], n) + extra @ x[cut[0] : cut[1]] + x[-1]) - y) / n
                gradient = np.concatenate(
                    (np.bincount(indices, values * error[rows], n_features) + penalty * x[: cut[0]], extra.T @ error, [error.sum()])
                )
                first += 0.1 * (gradient - first)
                second += 0.01 * (gradient * gradient - second)
                x -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
            weights, dense, bias = x[: cut[0]], x[cut[0] : cut[1]], float(x[-1])
        self.weights, self.dense, self.bias = weights, dense, bias

    def of_rows(self, indptr, indices, values, extra) -> np.ndarray:
        n = len(indptr) - 1
        rows = np.repeat(np.arange(n), np.diff(indptr))
        return _logistic(np.bincount(rows, values * self.weights[indices], n) + extra @ self.dense + self.bias)


class Chain:
    """Categories in order, a final linear model and a threshold for each."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.thresholds = names, [], []

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, fold: np.ndarray) -> Chain:
        """``rows``: feature numbers and values of each document."""
        lengths = np.array([len(at) for at, _ in rows], np.int64)
        indices = np.concatenate([np.empty(0, np.int32), *(at for at, _ in rows)]).astype(np.int64)
        values = np.concatenate([np.empty(0, np.float32), *(value for _, value in rows)]).astype(float)
        indptr = np.concatenate(([0], np.cumsum(lengths)))

        def part(mask: np.ndarray):
            keep = np.repeat(mask, lengths)
            return np.concatenate(([0], np.cumsum(lengths[mask]))), indices[keep], values[keep]

        extra = np.zeros((len(rows), 0))
        for j in range(len(self.names)):
            y, unseen = labels[:, j].astype(float), np.zeros(len(rows))
            for f in range(FOLDS):
                train, test = fold != f, fold == f
                unseen[test] = Linear(*part(train), extra[train], y[train], WIDTH).of_rows(*part(test), extra[test])
            self.models.append(Linear(indptr, indices, values, extra, y, WIDTH))
            self.thresholds.append(best_threshold(unseen, y))
            extra = np.column_stack((extra, unseen))
        return self


class Scorer:
    """Scores many texts at once; remembers what each word adds to every model's sum."""

    def __init__(self, chain: Chain):
        self.models = chain.models
        self.weights = np.column_stack([np.append(m.weights, 0.0) for m in chain.models])
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(chain.models)))

    def _rows(self, flat: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self.rows, self.table = {}, self.table[:0]
        at = np.fromiter(map(self.rows.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = dict.fromkeys(flat[i] for i in missing)
            numbers = np.array([features_of(w) for w in fresh], np.int64)
            for word in fresh:
                self.rows[word] = len(self.rows)
            self.table = np.concatenate((self.table, self.weights[numbers[:, 0]] + self.weights[numbers[:, 1]]))
            for i in missing:
                at[i] = self.rows[flat[i]]
        return at

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities for each text, in the chain's order."""
        sums = np.zeros((len(texts), len(self.models)))
        flat, values, starts, owners = [], [], [], []

        def add():
            at = self._rows(flat)
            sums[owners] = np.add.reduceat(self.table[at] * np.concatenate(values)[:, None], starts)

        for i, text in enumerate(texts):
            words, value = word_values(text)
            if words:
                starts.append(len(flat))
                owners.append(i)
                flat += words
                values.append(value)
            if len(flat) >= AT_ONCE:
                add()
                flat, values, starts, owners = [], [], [], []
        if flat:
            add()
        out = np.zeros_like(sums)
        for j, model in enumerate(self.models):
            out[:, j] = _logistic(sums[:, j] + out[:, :j] @ model.dense + model.bias)
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on unseen predictions, in the middle of its gap; above 1 if there is but one class."""
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(p[1:] < p[:-1], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def _vectors(batches):
    for batch in batches:
        at, values = [], []
        for text in batch.column(1).to_pylist():
            words, value = word_values(text)
            numbers = np.array([features_of(w) for w in words], np.int32).reshape(-1, 2)
            both = numbers.ravel()
            real = both < WIDTH
            at.append(both[real].tobytes())
            values.append(np.repeat(value, 2)[real].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.string()), batch.column(2), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
            names=["id", "labels", "at", "value"],
        )


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    train_docs: int = TRAIN_DOCS,
) -> Chain:
    """``categories``: name to a 0/1 expression over ``labels``, which shares ``doc_id``."""
    prepare(docs.sparkSession)
    known = labels.select(
        column(doc_id).alias("id"), F.array(*(c.cast("int") for c in categories.values())).alias("labels")
    ).filter(F.col("id").isNotNull() & ~F.exists("labels", lambda x: x.isNull()))
    share = min(1.0, train_docs / max(1, known.count()))
    # Bounded by train_docs, so it may be broadcast whatever the tables' size.
    picked = known.filter(salted_id_fraction(F.col("id")) < share)
    sample = docs.select(column(doc_id).alias("id"), column(text).alias("text")).join(F.broadcast(picked), "id")
    found = sample.select("id", "text", "labels").mapInArrow(_vectors, "id string, labels array<int>, at binary, value binary").collect()
    found.sort(key=lambda r: (r["id"], r["at"], r["value"], r["labels"]))
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]
    y = np.array([r["labels"] for r in found], int).reshape(len(found), len(categories))
    fold = np.array([zlib.crc32(r["id"].encode()) % FOLDS for r in found], int)
    return Chain(list(categories)).fit(rows, y, fold)


def names_of(chain: Chain) -> list[str]:
    """The columns that come after a prefix: each category's probability, and whether it passes its threshold."""
    return [f"{kind}_{c}" for kind in ("p", "is") for c in chain.names]


def score(docs: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """``docs`` and, after ``free_prefix(docs, names_of(chain))``, p_<category> and is_<category> for every category."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(chain)
    prefix = free_prefix(docs, names_of(chain))
    extra = [T.StructField(f"{prefix}p_{c}", T.DoubleType()) for c in chain.names]
    schema = T.StructType([*docs.schema.fields, *extra])
    at_text, names = docs.columns.index(text), schema.names

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.score(batch.column(at_text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in found.T)], names=names)

    out = map_rows(docs, run, schema)
    flags = {f"{prefix}is_{c}": F.col(f"{prefix}p_{c}") >= F.lit(t) for c, t in zip(chain.names, chain.thresholds)}
    return out.withColumns(flags)


def drop_flagged(docs: DataFrame, chain: Chain, category: str, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not put in a category, with their columns."""
    prefix = free_prefix(docs, names_of(chain))
    return score(docs, chain, text=text).filter(~F.col(f"{prefix}is_{category}")).select(*columns(docs))


#: Expressions over the labels table, in the chain's order.
def categories() -> dict[str, Column]:
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), categories())
    return score(docs, chain).select(
        "doc_id",
        F.col("_p_low_quality").alias("p_low_quality"),
        F.col("_p_toxic").alias("p_toxic"),
        F.col("_is_toxic").alias("toxic"),
    )
