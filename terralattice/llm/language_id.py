"""Language identification: word log frequencies first, shorter and shorter character n-grams for unseen words.

Training takes about ``train_docs`` labelled rows of each language (the documented bound; rows are picked by
a hash of their id against the language's count) and keeps every word and every character n-gram of theirs, so the model that goes to the
tasks is bounded by the sample.  Prediction reads every whole text.  Nothing is shuffled but the sample's counts.

A known word adds its log frequency in every language.  An unseen word is cut, with its borders marked,
into n-grams of the longest size of which the model knows any; their mean takes the word's place.

Null texts and texts without a letter are ``und`` with score 0, empty ones too.  Very long texts are read in pieces cut between words.  Rows
without language or text teach nothing.  Rows without an id are never learned from.  Without any training rows every text is ``und``; an
empty table gives no rows.  Equal totals go to the language first by name.  Repeated rows count as often as they stand.  Extra columns pass
through; the results' names get more underscores if they are taken.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.llm._common import column, free_prefix, map_rows, prepare, salted_id_fraction

TRAIN_DOCS = 1500
LONGEST_GRAM = 5
SMOOTHING = 0.5
#: Unseen words whose n-grams a task remembers, and words and characters that it handles at once.
CACHE, AT_ONCE, PIECE = 100_000, 200_000, 1 << 18
UNDETERMINED = "und"
#: The columns that come after a prefix.
NAMES = ("lang_pred", "score")
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut where no word goes on."""
    first = 0
    while len(text) - first > size:
        gap = _GAP.search(text, first + size)
        if gap is None:
            break
        yield text[first : gap.start()]
        first = gap.start()
    yield text[first:]


def is_word(run: str) -> bool:
    """Whether a run of word characters has a letter."""
    return run.isalpha() or any(map(str.isalpha, run))


def grams_of(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _counts(batches):
    words: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in pieces(text):
                words.update(zip(itertools.repeat(lang), _WORD.findall(piece.lower())))
    grams: Counter = Counter()
    for lang, word in [key for key in words if not is_word(key[1])]:
        del words[lang, word]
    for (lang, word), n in words.items():
        for size in range(1, LONGEST_GRAM + 1):
            for g in grams_of(word, size):
                grams[lang, g] += n
    for known, counter in ((True, words), (False, grams)):
        keys = list(counter)
        for first in range(0, len(keys), 50_000):
            part = keys[first : first + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in part], pa.string()),
                    pa.array([known] * len(part), pa.bool_()),
                    pa.array([k[1] for k in part], pa.string()),
                    pa.array([counter[k] for k in part], pa.int64()),
                ],
                names=["lang", "is_word", "unit", "n"],
            )


class Model:
    """Log frequencies: one row per word and n-gram, one column per language; the first row is that of runs without a letter."""

    def __init__(self, langs: list[str], known: np.ndarray, units: list[str], counts: np.ndarray):
        """``known``: whether a unit is a word; ``counts``: a row per unit, a column per language."""
        self.langs = langs
        self.words, self.grams = {}, {}
        table = np.zeros((len(units) + 1, len(langs)))
        table[1:] = counts
        sizes = np.array([-1, *(0 if w else len(u) for w, u in zip(known.tolist(), units))])
        for size in range(LONGEST_GRAM + 1):
            group = sizes == size
            if group.any():
                part = table[group] + SMOOTHING
                table[group] = np.log(part / part.sum(axis=0))
        for i, (w, unit) in enumerate(zip(known.tolist(), units), 1):
            (self.words if w else self.grams)[unit] = i
        self.table = table

    def backed_off(self, word: str) -> np.ndarray:
        """What an unseen word adds: the mean over its longest n-grams of which any is known."""
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            rows = [i for g in grams_of(word, size) if (i := self.grams.get(g)) is not None]
            if rows:
                return self.table[rows].mean(axis=0)
        return np.zeros(len(self.langs))


class Reader:
    """Predicts with a model, many texts at once; rows of unseen words are added behind the model's and forgotten when they are many."""

    def __init__(self, model: Model):
        self.model, self.table, self.size = model, model.table, len(model.table)
        self.unseen: dict[str, int] = {}

    def _row(self, word: str) -> int:
        if not is_word(word):
            return 0
        if self.size == len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(1024, self.size // 8), self.table.shape[1]))))
        self.table[self.size] = self.model.backed_off(word)
        self.size += 1
        self.unseen[word] = self.size - 1
        return self.size - 1

    def _add(self, total: np.ndarray, letters: np.ndarray, flat: list[str], starts: list[int], owners: list[int]) -> None:
        rows = np.fromiter(map(self.model.words.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        for i in np.flatnonzero(rows < 0).tolist():
            known = self.unseen.get(flat[i])
            rows[i] = self._row(flat[i]) if known is None else known
        np.add.at(total, owners, np.add.reduceat(self.table[rows], starts))
        np.add.at(letters, owners, np.add.reduceat((rows > 0).astype(np.int64), starts))
        if len(self.unseen) > CACHE:
            self.unseen, self.size = {}, len(self.model.table)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model = self.model
        total, letters = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
        flat, starts, owners = [], [], []
        for i, text in enumerate(texts if model.langs else ()):
            for piece in pieces(text or ""):
                words = _WORD.findall(piece.lower())
                if words:
                    starts.append(len(flat))
                    owners.append(i)
                    flat += words
                if len(flat) >= AT_ONCE:
                    self._add(total, letters, flat, starts, owners)
                    flat, starts, owners = [], [], []
        if flat:
            self._add(total, letters, flat, starts, owners)
        if not model.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [model.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist())]
        return langs, np.where(letters > 0, score, 0.0)


def train(labelled: DataFrame, *, train_docs: int) -> Model:
    """``labelled``: id, lang, text without nulls."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.empty(0, bool), [], np.empty((0, 0)))
    share: Column = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))).otherwise(share)
    sample = labelled.filter(salted_id_fraction(F.col("id")) < share).select("lang", "text")
    counted = (
        sample.mapInArrow(_counts, "lang string, is_word boolean, unit string, n long")
        .groupBy("is_word", "unit")
        .agg(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)))
    ).toArrow()
    counts = np.column_stack([counted.column(f"n{i}").to_numpy() for i in range(len(langs))])
    return Model(langs, counted.column("is_word").to_numpy(), counted.column("unit").to_pylist(), counts)


def identify(
    docs: DataFrame,
    learn: Column,
    *,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    train_docs: int = TRAIN_DOCS,
) -> DataFrame:
    """``docs`` and, after ``free_prefix(docs, NAMES)``, the columns NAMES; learns from the rows for which ``learn`` is true."""
    spark = docs.sparkSession
    prepare(spark)
    labelled = docs.select(
        column(doc_id).alias("id"), column(lang).alias("lang"), column(text).alias("text"), learn.alias("learn")
    ).filter("learn AND id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    shared = spark.sparkContext.broadcast(train(labelled, train_docs=train_docs))
    prefix = free_prefix(docs, NAMES)
    extra = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *extra])
    at_text, names = docs.columns.index(text), schema.names

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            langs, scores = reader.predict(batch.column(at_text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return map_rows(docs, run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = identify(docs, ~held_out(F.col("doc_id")))
    # The language column stops at the model: predictions see the text alone.
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )
