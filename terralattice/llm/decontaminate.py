"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a run of documents of about ``SHARD_BYTES`` of text in one task.  Words are numbered by the benchmark's own vocabulary; a
suffix can match only while its words are in that vocabulary, so the shard's suffix array holds the
suffixes that start a long enough run of known words, sorted by their first ``window`` words.
Every benchmark suffix is binary-searched in every shard, by its first ``window`` words; equal ranges give the places.
Places of one item that follow one another on one diagonal (the same distance between the two positions) join into the longest verbatim
match, given with its place in the document and in the item.

The benchmark goes to the tasks in blocks of at most about ``block_bytes`` of text, one at a time: a block is broadcast, searched in all
documents and given up before the next one comes, so one bounded block is in memory whatever the benchmark's size.  With one
block nothing is shuffled; with several, the matches of the earlier ones are stored by the text's hash and joined to the last one's.

Null texts have no words; empty ones neither.  Very long texts are searched whole, in a shard of their own.  An item without words matches
nothing; an item whose id is null still marks words but is not listed.  Items that repeat an id are one item.  Documents that repeat an id
are judged row by row.  An empty table gives no rows, an empty benchmark no matches.  Extra columns pass through; the results' names get
more underscores if they are taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.llm._common import Stored, column, columns, free_prefix, joined_spans, map_rows, prepare, ranges, release_shuffles, texts_of

#: Upper-case ASCII to lower case; every other byte that is no word byte to a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
#: The columns that come after a prefix: words, word runs hit (half-open), ids of the items found, longest matches; then the verdict's two.
NAMES = ("n_words", "spans", "items", "matches", "n_hit", "contaminated")
_EXTRA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("words", T.LongType()),
                        T.StructField("item", T.StringType()),
                        T.StructField("item_start", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Block:
    """A block of benchmark items: vocabulary, and by length the sorted windows with the items and places that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids, self.vocabulary = [item_id for item_id, _ in items], {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1) if ids else ():
                found[tuple(ids[start : start + size])].append((number, start))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(x) for x in found}):
            windows = sorted(x for x in found if len(x) == size)
            places = np.array([place for x in windows for place in found[x]], np.int64)
            self.by_length[size] = (_packed(np.array(windows, dtype=np.int64)), np.array([len(found[x]) for x in windows]), places)
        self.least = min(self.by_length, default=0)
        self.most = max(self.by_length, default=0)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()
_END = np.zeros(1, np.uint32)


def shard_matches(docs: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words per document, and the longest matches as rows (document, start, words, item number, item start)."""
    get, counts, pieces = block.vocabulary.get, np.zeros(len(docs), np.int64), []
    for i, text in enumerate(docs):
        words = words_of(text)
        counts[i] = len(words)
        pieces.append(np.fromiter(map(get, words, _ZEROS), np.uint32, len(words)))
        pieces.append(_END)
    none = np.empty((0, 5), np.int64)
    if not block.by_length or not docs:
        return counts, none
    ids = np.concatenate(pieces)
    breaks = np.flatnonzero(ids == 0)
    run = breaks[np.searchsorted(breaks, np.arange(len(ids)))] - np.arange(len(ids))  # known words from here on
    starts = np.flatnonzero(run >= block.least)
    if not len(starts):
        return counts, none
    depth = np.arange(block.most)
    table = ids[np.minimum(starts[:, None] + depth, len(ids) - 1)]
    table[depth[None, :] >= run[starts][:, None]] = 0
    suffixes = _packed(table)
    order = np.argsort(suffixes, kind="stable")
    suffixes, places = suffixes[order], starts[order]
    firsts = np.concatenate(([0], np.cumsum(counts + 1)))
    parts = []
    for size, (windows, n_items, item_places) in block.by_length.items():
        cut = suffixes.astype(f"S{4 * size}") if size < block.most else suffixes
        left, right = np.searchsorted(cut, windows, "left"), np.searchsorted(cut, windows, "right")
        # A row for every place of a window in the shard, times its places in the benchmark.
        at = places[ranges(left, right - left)]
        window = np.repeat(np.arange(len(windows)), right - left)
        first_item = (np.cumsum(n_items) - n_items)[window]
        item = item_places[ranges(first_item, n_items[window])]
        at = np.repeat(at, n_items[window])
        doc = np.searchsorted(firsts, at, "right") - 1
        start = at - firsts[doc]
        diagonal = start - item[:, 1]
        order = np.lexsort((start, diagonal, item[:, 0], doc))
        doc, start, item, diagonal = doc[order], start[order], item[order], diagonal[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:, 0] != item[:-1, 0]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        words = np.diff(np.append(heads, len(doc))) + size - 1
        parts.append(np.column_stack((doc[heads], start[heads], words, item[heads])))
    rows = np.concatenate(parts)
    return counts, rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 1], rows[:, 0]))]


def benchmark_blocks(
    benchmark: DataFrame, window: int, block_bytes: int, item_id: str = "item_id", text: str = "text"
) -> Iterator[Block]:
    rows, size = [], 0
    for row in benchmark.select(column(item_id).cast("string"), column(text)).toLocalIterator():
        rows.append((row[0], (row[1] or "").encode()))
        size += len(rows[-1][1])
        if size >= block_bytes:
            yield Block(rows, window)
            rows, size = [], 0
    if rows:
        yield Block(rows, window)


def _shards(batches):
    """Lists of batches with their texts (the last column), each of about SHARD_BYTES of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        found = texts_of(batch.column(batch.num_columns - 1))
        held.append(batch)
        texts += found
        size += sum(map(len, found))
        if size >= SHARD_BYTES:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def _search(shared, names: list[str], only_found: bool):
    """Adds the results to each row; the last column, the text to search, goes away."""

    def run(batches):
        block = shared.value
        for held, texts in _shards(batches):
            counts, rows = shard_matches(texts, block)
            cuts, first = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)), 0
            for batch in held:
                spans, items, matches = [], [], []
                for i in range(first, first + batch.num_rows):
                    own = [(a, n, block.ids[item], at) for _, a, n, item, at in rows[cuts[i] : cuts[i + 1]].tolist()]
                    spans.append([{"a": a, "b": b} for a, b in joined_spans((a, a + n) for a, n, _, _ in own)])
                    items.append(sorted({item for _, _, item, _ in own if item is not None}))
                    matches.append([dict(zip(("start", "words", "item", "item_start"), x)) for x in own])
                made = [pa.array(counts[first : first + batch.num_rows]), pa.array(spans, _SPANS)]
                made += [pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES)]
                out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)
                yield out.filter(pa.array([bool(m) for m in matches], pa.bool_())) if only_found else out
                first += batch.num_rows

    return run


def _with(batches):
    """The results of all blocks together: those of the last, and a list of those of the earlier ones (the last column)."""
    for batch in batches:
        n = batch.num_columns - 5
        spans, items, matches = (batch.column(n + i).to_pylist() for i in (1, 2, 3))
        for i, earlier in enumerate(batch.column(n + 4).to_pylist()):
            for found in earlier or ():
                spans[i] = spans[i] + found["spans"]
                items[i] = items[i] + found["items"]
                matches[i] = matches[i] + found["matches"]
            if earlier:
                spans[i] = [{"a": a, "b": b} for a, b in joined_spans((x["a"], x["b"]) for x in spans[i])]
                items[i] = sorted(set(items[i]))
                matches[i].sort(key=lambda m: (m["start"], m["words"], m["item"] is not None, m["item"] or "", m["item_start"]))
        made = [pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *made], names=batch.schema.names[:-1])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` and, after ``free_prefix(docs, NAMES)``, the first four columns of NAMES."""
    spark = docs.sparkSession
    prepare(spark)
    prefix = free_prefix(docs, NAMES)
    extra = [T.StructField(f"{prefix}{f.name}", f.dataType) for f in _EXTRA.fields]
    schema = T.StructType([*docs.schema.fields, *extra])
    searched = docs.select(*columns(docs), column(text).alias("searched"))
    keys = [F.xxhash64(column(text)).alias("key_a"), F.xxhash64(F.lit(7), column(text)).alias("key_b")]

    blocks = benchmark_blocks(benchmark, window, block_bytes, item_id, item_text)
    block, earlier = next(blocks, Block([], window)), None
    for following in blocks:
        shared = spark.sparkContext.broadcast(block)
        found = Stored(
            docs.select(*keys, column(text).alias("searched"))
            .mapInArrow(
                _search(shared, ["key_a", "key_b", *_EXTRA.names], True),
                T.StructType([T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()), *_EXTRA.fields]),
            )
            .dropDuplicates(["key_a", "key_b"]),
            "matches",
        )
        shared.destroy()
        release_shuffles(spark)
        earlier = found.df if earlier is None else earlier.unionAll(found.df)
        block = following
    shared = spark.sparkContext.broadcast(block)
    out = map_rows(searched, _search(shared, schema.names, False), schema)
    if earlier is None:
        return out
    # A text's matches in the earlier blocks are few rows; documents that share a text may be many, and can be split.
    stored = Stored(
        earlier.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("spans", "items", "matches")).alias("earlier")), "matches"
    )
    own = free_prefix(out, ["key_a", "key_b", "earlier"])
    right = stored.df.select(*(F.col(c).alias(f"{own}{c}") for c in ("key_a", "key_b", "earlier")))
    left = out.select(*columns(out), keys[0].alias(f"{own}key_a"), keys[1].alias(f"{own}key_b"))
    joined = left.join(right, [f"{own}key_a", f"{own}key_b"], "left")
    return map_rows(joined.select(*columns(out), f"{own}earlier"), _with, schema)


def with_verdict(found: DataFrame, prefix: str = "_") -> DataFrame:
    """Adds ``n_hit`` and ``contaminated`` behind the prefix: words hit are at least a twentieth of all."""
    hit = F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    n_hit = F.col(f"{prefix}n_hit")
    return found.withColumn(f"{prefix}n_hit", hit).withColumn(
        f"{prefix}contaminated", (n_hit > 0) & (20 * n_hit >= F.col(f"{prefix}n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    prefix = free_prefix(docs, NAMES)
    found = with_verdict(find_contamination(docs, benchmark, **options), prefix)
    return found.filter(~F.col(f"{prefix}contaminated")).select(*columns(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_verdict(found).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[s : s + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS m FROM bw),
dw AS (
  SELECT doc_id, s, m, w[s : s + m - 1] AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)
),
hits AS (SELECT dw.doc_id, dw.s, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = len(bw.win) AND dw.win = bw.win),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hits)) GROUP BY doc_id
),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ks, '')) AS items_sha256,
       (coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
