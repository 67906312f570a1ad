"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector x becomes integers floor(scale * x).  A vector is cut into 1, 2, 4, ... segments, down to four components each; with the
segments' means and deviations, for a segment of length l

    |q - x|^2 >= l * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

so the sum over segments bounds a distance from below, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 from
above.  From coarse to fine, candidates whose bound cannot reach the query's current k-th best score
fall out and are not looked at again; survivors get the exact integer product.  A query starts with the k-th best score among a few
rows of the table, which its true k-th best reaches for sure.

Queries are taken in blocks of at most ``block_rows`` rows and ``block_bytes`` bytes, one at a time: a block is broadcast (a bound
whatever the input's size) and one pass goes over all rows, without a shuffle of vectors; each task keeps the best k per query,
and those few rows are ranked together and, if further blocks follow, stored before the next block is read.

Vectors that are null, hold null or non-finite components, or have no id take no part.  Only vectors of a
query's own length are its candidates, however long.  Rows that repeat a query's id count as the query's own row; repeated query rows are
answered once (of equal ids, the vector with the smallest hash).  Ties go to the smaller id; rows that repeat a candidate's id are
candidates each.  Empty vectors score 0.  Products beyond 64 bits are cut to the largest or smallest 64-bit number.  Empty tables of vectors
or queries give no rows.  Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralattice.llm._common import Stored, column, prepare

SCALE, K = 1024, 10
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Rows of the table that give a block's first thresholds.
SEED_ROWS = 1024
#: Share of pairs alive from which on a level's bounds, or exact products, come from one matrix product.
DENSE = 0.1
_EXACT = float(1 << 53)
_LONG = 1 << 63
_FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    bad = F.exists(
        column(embedding),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return vectors.filter(column(vec_id).isNotNull() & column(embedding).isNotNull() & ~bad).select(
        column(vec_id).alias("vec_id"), column(embedding).cast("array<double>").alias("x")
    )


class Side:
    """Integer vectors of one length with their segment statistics, from coarse to fine."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norm = np.einsum("ij,ij->i", x, x)
        self.largest = float(np.abs(x).max(initial=0))
        self.levels = []
        size, segments = x.shape[1], 1
        while size and segments <= max(1, size // 4):
            edges = np.linspace(0, size, segments + 1).astype(int)
            lengths = np.diff(edges).astype(float)
            mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
            square = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
            dev = np.sqrt(np.maximum(square - mean * mean, 0.0))
            weight = np.sqrt(lengths)
            self.levels.append(np.concatenate((mean * weight, dev * weight), axis=1))
            segments *= 2


def sides(ids: list[int], vectors: list[np.ndarray], scale: int) -> dict[int, Side]:
    grouped: dict[int, list[int]] = defaultdict(list)
    for i, v in enumerate(vectors):
        grouped[len(v)].append(i)
    return {
        size: Side(np.array([ids[i] for i in at], np.int64), np.floor(scale * np.stack([vectors[i] for i in at])))
        for size, at in grouped.items()
    }


def exact_in_floats(queries: Side, rows: Side) -> bool:
    """Whether all products of two sides are integers that doubles hold."""
    return queries.largest * rows.largest * max(1, rows.x.shape[1]) < _EXACT


def exact_products(queries: Side, rows: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of query i with row j: in floats while they are exact, else in Python's integers, cut to 64 bits."""
    if exact_in_floats(queries, rows):
        at_once = max(1, (1 << 20) // max(1, rows.x.shape[1]))
        parts = [
            np.einsum("ij,ij->i", queries.x[i[a : a + at_once]], rows.x[j[a : a + at_once]]) for a in range(0, len(i), at_once)
        ]
        return np.concatenate([np.empty(0), *parts]).astype(np.int64)
    values = [sum(int(a) * int(b) for a, b in zip(queries.x[m], rows.x[n])) for m, n in zip(i, j)]
    return np.array([min(max(v, -_LONG), _LONG - 1) for v in values], np.int64)


class Best:
    """The best k (score, id) of one query; ``least`` is the score that a newcomer must reach."""

    def __init__(self, k: int, least: float):
        self.k, self.heap, self.seed = k, [], least

    @property
    def least(self) -> float:
        return max(self.seed, self.heap[0][0]) if len(self.heap) == self.k else self.seed

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            top = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[top], ids[top]
        for score, i in zip(scores.tolist(), ids.tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -i))
            elif (score, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (score, -i))


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of the pairs i, j at one level."""
    at_once = max(1, (1 << 20) // a.shape[1])
    parts = [((a[i[n : n + at_once]] - b[j[n : n + at_once]]) ** 2).sum(1) for n in range(0, len(i), at_once)]
    return np.concatenate(parts) if parts else np.empty(0)


def search(queries: Side, rows: Side, best: list[Best], at_once: int = 256) -> int:
    """Coarse to fine over one batch of rows, for all queries of a block, ``at_once`` queries at a time; returns the exact products made.

    While many pairs are alive a level is one matrix product; as soon as few are, only these are looked at, pair by pair.
    """
    made = 0
    for first in range(0, len(queries.ids), at_once):
        part = slice(first, first + at_once)
        least = np.array([b.least for b in best[part]])
        alive, i, j = queries.ids[part, None] != rows.ids[None, :], None, None
        both = queries.norm[part, None] + rows.norm[None, :]
        # Rounding of the float bounds is far below this slack; a bound never drops a true neighbour.
        goal = 2 * least[:, None] - both * (1 + 2e-9) - 2.0
        for a, b in zip(queries.levels, rows.levels):
            if i is None:
                a = a[part]
                near = (2 * (a @ b.T) - (a * a).sum(1)[:, None]) - (b * b).sum(1)[None, :]
                alive &= near >= goal
                if np.count_nonzero(alive) < DENSE * alive.size:
                    i, j = np.nonzero(alive)
            else:
                keep = -_distances(a, b, i + first, j) >= goal[i, j]
                i, j = i[keep], j[keep]
        if i is None and exact_in_floats(queries, rows):
            scores = queries.x[part] @ rows.x.T
            made += int(np.count_nonzero(alive))
            i, j = np.nonzero(alive & (scores >= least[:, None]))
            scores = scores[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(alive) if i is None else (i, j)
            scores = exact_products(queries, rows, i + first, j)
            made += len(i)
            keep = scores >= least[i]
            i, j, scores = i[keep], j[keep], scores[keep]
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
            best[i[a] + first].add(scores[a:b], rows.ids[j[a:b]])
    return made


def seeds(queries: Side, some: Side | None, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for sure, from some rows of the table."""
    out = np.full(len(queries.ids), -np.inf)
    if some is None or not exact_in_floats(queries, some):
        return out
    for first in range(0, len(out), 256):
        scores = queries.x[first : first + 256] @ some.x.T
        scores[queries.ids[first : first + 256, None] == some.ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out[first : first + 256] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return out


def _scan(shared, k: int, scale: int):
    schema_names = ["query_id", "vec_id", "score"]

    def run(batches):
        block, start = shared.value
        best = {size: [Best(k, s) for s in start[size]] for size in block}
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = batch.column(0).to_pylist()
            for size, rows in sides(ids, np.split(flat, ends[:-1]) if len(ids) else [], scale).items():
                if size in block:
                    search(block[size], rows, best[size])
        out = [
            (int(q), -negative, score)
            for size in block
            for q, b in zip(block[size].ids, best[size])
            for score, negative in b.heap
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=schema_names)

    return run


def query_blocks(queries: DataFrame, block_rows: int, block_bytes: int):
    rows, size = [], 0
    for row in queries.toLocalIterator():
        rows.append((row[0], np.array(row[1], float)))
        size += 8 * len(row[1]) + 16
        if len(rows) >= block_rows or size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = K,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but its own, ties to the smaller id."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, vec_id, embedding)
    asked = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    some = [(r[0], np.array(r[1], float)) for r in rows.limit(SEED_ROWS).collect()]
    some = sides([r[0] for r in some], [r[1] for r in some], scale)

    def ranked(block) -> DataFrame:
        asked_sides = sides([b[0] for b in block], [b[1] for b in block], scale)
        shared = spark.sparkContext.broadcast((asked_sides, {n: seeds(s, some.get(n), k) for n, s in asked_sides.items()}))
        found = rows.mapInArrow(_scan(shared, k, scale), _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    blocks = query_blocks(asked, block_rows, block_bytes)
    last, out = next(blocks, None), None
    if last is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for following in blocks:
        done = Stored(ranked(last), "nearest").df
        out, last = done if out is None else out.unionAll(done), following
    return ranked(last) if out is None else out.unionAll(ranked(last))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024e0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
