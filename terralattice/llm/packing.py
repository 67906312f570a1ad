"""Sequence packing by lexical retrieval: a sharded BM25 index gives each seed document its unused neighbours.

1. Texts become token ids with an end id, stored once.
2. Document frequencies of all token ids are summed over all documents; with the number of documents and the mean length they
   make one global BM25 weighting, whose size is bounded by the vocabulary.
3. Documents are range-partitioned and sorted by a lexical key (the smallest hash among their rarer tokens) and id, so that
   documents that share rare tokens tend to meet, and a key that many share is spread.  A task cuts its rows into shards of about
   ``shard_tokens`` tokens, which bounds its memory whatever the lengths of the texts.
4. A shard has its own inverted index; other shards are not searched.  The first unused document is a seed; the shard's documents are
   scored over all its terms, and its unused neighbours fill the window from the best score down.  What is cut off at the
   window's end seeds the next window.  When no neighbour is left, the next unused document follows, so only a shard's last sequence is padded.

Null and empty texts are the end id alone.  Very long texts are cut over as many sequences as they need; their ids are held whole, two to four
bytes each.  Documents without an id and repeated rows are packed like any other.  No rows give no sequences.  Extra columns, whatever
their names, are left out: a piece has the columns named in ``pack``.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralattice.llm._common import Stored, column, mix64, prepare, release_shuffles

LENGTH, END_ID = 2048, 1
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
#: Share of a shard's documents from which on a term's postings are a dense row.
COMMON = 1 / 12
#: Byte-pair ids are numbered from common to rare merges; ids from here on make the lexical key.
RARE_FROM = 3000

_encoders: dict[str, object] = {}


def tokenizer_file(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the tokenizers file of a rank file's vocabulary finds in texts as they stand, with their ids."""
    beside = f"{path.removesuffix('.tiktoken')}.json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"{beside} has added tokens that are not matched as they stand")
    return {t["content"]: t["id"] for t in added}


def encoder(path: str):
    """The byte-level BPE of a rank file.  It gives the ids of the same vocabulary's tokenizers file, several times as fast.

    A rank file lacks the vocabulary's added tokens, which are taken from the tokenizers file beside it.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path)
        )
    return _encoders[path]


def _tokenised(path: str, end_id: int):
    def run(batches):
        encoding = encoder(path)
        added = list(encoding.special_tokens_set)

        def encode(text):
            # Most texts hold no added token, and looking for them inside the encoder costs time.
            found = encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)
            found.append(end_id)
            return np.frombuffer(array("I", found), np.uint32)  # faster from a list than numpy by itself

        alone = np.array([end_id], np.uint32)
        for batch in batches:
            packed, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text) if text else alone
                rare = ids[ids >= RARE_FROM]
                packed.append(ids.astype(np.uint16 if ids.max() < 65536 else np.uint32).tobytes())
                sizes.append(len(ids))
                keys.append(int(mix64(rare.astype(np.uint64)).min() >> np.uint64(1)) if len(rare) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                names=["doc_id", "ids", "n", "lexical"],
            )

    return run


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32)


def _frequencies(batches):
    """Documents per token id within one task."""
    counts, last = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for batch in batches:
        for packed, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = unpacked(packed, n)
            if int(ids.max()) >= len(counts):
                more = np.zeros(int(ids.max()) + 1 - len(counts), np.int64)
                counts, last = np.concatenate((counts, more)), np.concatenate((last, more.astype(np.int32)))
            # Of equal ids the last one counts, which takes no sorting.
            at = np.arange(n, dtype=np.int32)
            last[ids] = at
            counts[ids[last[ids] == at]] += 1
    found = np.flatnonzero(counts)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["token", "df"])


class Index:
    """BM25 over one shard with the corpus's statistics: postings by term, and each document's terms.

    Terms that COMMON or more of the documents hold have their postings as dense rows, the others as lists sorted by term.  Postings of used
    documents are dropped whenever half of the documents still listed are used.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.used = np.zeros(len(docs), bool)
        self.live = np.arange(len(docs))
        self.terms, counts = zip(*(np.unique(ids, return_counts=True) for ids in docs))
        owners = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(counts)
        lengths = np.array([len(d) for d in docs], float)
        damp = K1 * (1 - B + B * lengths[owners] / max(mean_length, 1.0))
        weights = idf[terms] * counts * (K1 + 1) / (counts + damp)
        df = np.bincount(terms, minlength=len(idf))
        common = np.flatnonzero(df >= max(2, COMMON * len(docs)))
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[terms] >= 0
        self.dense = np.zeros((len(common), len(docs)), np.float32)
        self.dense[self.row[terms[dense]], owners[dense]] = weights[dense]
        terms, owners, weights = terms[~dense], owners[~dense], weights[~dense]
        order = np.argsort(terms, kind="stable")
        self.owners, self.weights = owners[order], weights[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(idf)))))

    def _drop_used(self) -> None:
        keep = ~self.used[self.owners]
        self.starts = np.concatenate(([0], np.cumsum(keep)))[self.starts]
        self.owners, self.weights = self.owners[keep], self.weights[keep]
        left = ~self.used[self.live]
        self.live, self.dense = self.live[left], np.ascontiguousarray(self.dense[:, left])

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score over all terms of ``doc``; 0 for used ones."""
        if 2 * int((~self.used).sum()) <= len(self.live):
            self._drop_used()
        terms, out = self.terms[doc], np.zeros(len(self.used))
        rows = self.row[terms]
        lists = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist()) if a < b]
        if lists:
            owners, weights = (np.concatenate([x[s] for s in lists]) for x in (self.owners, self.weights))
            out = np.bincount(owners, weights, len(self.used))
        out[self.live] += self.dense[rows[rows >= 0]].sum(axis=0)
        out[self.used] = 0
        return out

    def neighbours(self, doc: int, first: int = 16) -> Iterator[int]:
        """Unused documents that share a term with ``doc``, best first, ties in shard order."""
        scores = self.scores(doc)
        found = np.flatnonzero(scores > 0)
        # A window takes few documents, so the best few are sorted before the rest.
        if len(found) > first:
            least = np.partition(scores[found], len(found) - first)[len(found) - first]
            parts = [found[scores[found] >= least], found[scores[found] < least]]
        else:
            parts = [found]
        for part in parts:
            yield from part[np.argsort(-scores[part], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, length: int):
    """Yields (document, start, size, sequence, offset), windows one after another."""
    index, sequence, rest, upcoming = Index(docs, idf, mean_length), 0, None, 0
    while True:
        if rest is None:
            while upcoming < len(docs) and index.used[upcoming]:
                upcoming += 1
            if upcoming == len(docs):
                return
            rest = (upcoming, 0)
            index.used[upcoming] = True
        (seed, start), offset = rest, 0
        queue, rest = None, None
        doc = seed
        while True:
            size = min(len(docs[doc]) - start, length - offset)
            yield doc, start, size, sequence, offset
            offset += size
            if start + size < len(docs[doc]):
                rest = (doc, start + size)
            if offset == length:
                break
            if queue is None:
                queue = index.neighbours(seed)
            doc = next(queue, None)
            if doc is None:
                while upcoming < len(docs) and index.used[upcoming]:
                    upcoming += 1
                if upcoming == len(docs):
                    break
                doc = upcoming
            index.used[doc], start = True, 0
        sequence += 1


def _shards(batches, shard_tokens: int):
    """Ids and token arrays of the rows, in their order, cut where a shard has its tokens."""
    ids, docs, size = [], [], 0
    for batch in batches:
        for doc_id, packed, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids.append(doc_id)
            docs.append(unpacked(packed, n))
            size += n
            if size >= shard_tokens:
                yield ids, docs
                ids, docs, size = [], [], 0
    if docs:
        yield ids, docs


def _packed(shared, length: int, shard_tokens: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def run(batches):
        idf, mean_length = shared.value
        before, rows = TaskContext.get().partitionId() << 32, []
        for ids, docs in _shards(batches, shard_tokens):
            sequence = -1
            for doc, start, size, sequence, offset in pack_shard(docs, idf, mean_length, length):
                piece = docs[doc][start : start + size].astype("<u4").tobytes()
                rows.append((ids[doc], start, size, zlib.crc32(piece), len(docs[doc]), before + sequence, offset))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            before += sequence + 1
        if rows:
            yield batch_of(rows)

    return run


def pack(
    docs: DataFrame,
    *,
    length: int = LENGTH,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    tokens = Stored(
        docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).mapInArrow(
            _tokenised(tokenizer or tokenizer_file(), end_id), "doc_id long, ids binary, n long, lexical long"
        ),
        "tokens",
    )
    total = tokens.df.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).first()
    frequencies = (
        tokens.df.select("ids", "n").mapInArrow(_frequencies, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    ).collect()
    df = np.zeros(max((r["token"] for r in frequencies), default=0) + 1)
    for r in frequencies:
        df[r["token"]] = r["df"]
    count = total["docs"]
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, (total["tokens"] or 0) / max(1, count)))
    release_shuffles(spark)
    shards = max(1, -(-(total["tokens"] or 0) // shard_tokens))
    return (
        tokens.df.repartitionByRange(shards, "lexical", "doc_id")
        # The same rows in the same order give the same sequences, whatever order they came in.
        .sortWithinPartitions("lexical", "doc_id", "ids")
        .select("doc_id", "ids", "n")
        .mapInArrow(
            _packed(shared, length, shard_tokens),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
