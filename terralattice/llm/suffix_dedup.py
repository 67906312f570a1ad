"""Exact substring deduplication by sorting suffixes, cut to those that can matter.

A string of ``length`` bytes is repeated if it also starts anywhere else.  Sorting every suffix of a large corpus costs many
times its size, so suffixes are cut down in exact steps:

1. Each window of ``length`` bytes names one anchor: the place with the smallest hash among the ``ANCHOR``-byte
   strings inside it.  Equal windows name equal anchors at equal offsets.  Neighbouring windows with one anchor are a
   segment, so a corpus has about one segment per seventy bytes.
2. Segments are counted by anchor, and equal ones (by 128 bits of hash) by content.  An anchor that occurs once has no repeated window, and a
   content that occurs twice is repeated as a whole.  One copy of each content goes on if its anchor has others too: these lie at the
   borders of repeats.
3. Such a copy is shipped as bytes: the suffix that begins at its anchor, and what of the segment lies before it.  Sampled splitters
   range-partition the suffixes by their leading bytes.  A bucket sorts its suffixes, and its reversed left sides, by multikey quicksort
   over their bytes and takes the longest common prefixes of neighbours.  A window that begins d bytes before its anchor equals another
   of the same anchor exactly if the two share d bytes to the left and ``length`` - d bytes to the right, so runs of the two sorted
   orders at these depths give all equal windows, by comparison of bytes.
4. Splitters never part equal leading bytes and anchors, so there are no equal suffixes across a boundary and nothing to compare there.  An
   anchor with more than BLOCK contents is cut further: its windows are dealt by their hash to blocks, as many as its contents ask for;
   a content goes to the blocks of its windows and each block is sorted and compared as any other.
5. A segment's repeated windows all cover its anchor, so the first and the last one give the bytes to remove.

Null and empty texts have no bytes.  Very long texts are hashed in windows of CHUNK bytes, and buckets are as many as their bytes ask
for, so memory does not grow with either.  Rows that repeat an id are documents of their own, and equal rows repeat each other.  An empty
table gives no rows.  Extra columns pass through ``remove_repeats``, whatever their names; the kept bytes of a text are valid UTF-8 only if
its cuts fall between characters, so ``remove_repeats`` shortens removed runs to whole characters while the query reports bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.llm._common import (
    Stored,
    apart,
    column,
    columns,
    free_prefix,
    joined_spans,
    map_rows,
    mix64,
    prepare,
    release_shuffles,
    text_hash,
    texts_of,
)

LENGTH, ANCHOR = 200, 64
#: Contents of one anchor from which on its windows are dealt to several blocks, and contents that a block is meant to hold.
BLOCK = 4096
#: Bytes of text that are hashed at once, and of suffixes that a bucket is meant to hold.
CHUNK, BUCKET_BYTES = 1 << 17, 8 << 20
_REACH = "anchor long, content long, low long, high long"
_POSITION = np.uint64((1 << 28) - 1)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEVELS = mix64(np.arange(1001, 1064, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _join(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    out = left * _LEVELS[level]
    out += right
    out ^= out >> np.uint64(29)
    return out


def window_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size the hash of every string of that size in ``data``, made from strings of powers of two."""
    powers, level, width = {1: _BYTES[data]}, 0, 1
    while 2 * width <= min(max(sizes), len(data)):
        h = powers[width]
        powers[2 * width] = _join(h[: len(h) - width], h[width:], level)
        width, level = 2 * width, level + 1
    out = []
    for size in sizes:
        count = len(data) - size + 1
        if count <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        total, at = None, 0
        for width in sorted(powers, reverse=True):
            if size - at >= width:
                part = powers[width][at : at + count]
                total = part if total is None else _join(total, part, 20 + level + int(np.log2(width)))
                at += width
        out.append(mix64(total))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(pieces: list[bytes], length: int, anchor: int):
    """Arrays (piece number, first window, last window, place of the anchor, anchor hash, hash of first window, of last window)."""
    sizes = np.array([len(t) for t in pieces], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < length:
        return None
    small, large = window_hashes(data, (anchor, length))
    place = np.arange(len(small), dtype=np.uint64)
    least = sliding_least((small & ~_POSITION) | place, length - anchor + 1) & _POSITION
    at = np.arange(len(large))
    owner = np.searchsorted(ends, at, "right")
    valid = np.flatnonzero(at + length <= ends[owner])
    if not len(valid):
        return None
    new = np.flatnonzero(
        np.concatenate(([True], (np.diff(valid) > 1) | (np.diff(least[valid].view(np.int64)) != 0) | (np.diff(owner[valid]) != 0)))
    )
    first, last = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    begin = (ends - sizes)[owner[first]]
    return (
        owner[first],
        first - begin,
        last - begin,
        least[first].astype(np.int64) - begin,
        small[least[first].astype(np.int64)].view(np.int64),
        large[first].view(np.int64),
        large[last].view(np.int64),
    )


def _chunks(texts: list[bytes], length: int, size: int):
    """Lists of (text number, offset, piece), of about ``size`` bytes each.

    A longer text is cut into pieces that overlap by a window less a byte, so that each of its windows lies in one.
    """
    held, total = [], 0
    for i, text in enumerate(texts):
        for first in range(0, max(1, len(text) - length + 1), size):
            piece = text if len(text) <= size else text[first : first + size + length - 1]
            held.append((i, first, piece))
            total += len(piece)
            if total >= size:
                yield held
                held, total = [], 0
            if piece is text:
                break
    if held:
        yield held


def _segmented(length: int, anchor: int, size: int):
    names = ["doc_id", "text_hash", "a", "b", "p", "anchor", "content"]

    def run(batches):
        for batch in batches:
            for held in _chunks(texts_of(batch.column(2)), length, size):
                found = segments([piece for _, _, piece in held], length, anchor)
                if found is None:
                    continue
                owner, a, b, p, anchors, head, tail = found
                content = mix64(
                    mix64(head.view(np.uint64) + (b - a).astype(np.uint64)) * np.uint64(3) + tail.view(np.uint64)
                ).view(np.int64)
                offset = np.array([first for _, first, _ in held], np.int64)[owner]
                at = pa.array(np.array([i for i, _, _ in held], np.int64)[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        *(pa.array(x + offset, pa.int64()).cast(pa.int32()) for x in (a, b, p)),
                        pa.array(anchors, pa.int64()),
                        pa.array(content, pa.int64()),
                    ],
                    names=names,
                )

    return run


_SUFFIX = "lead long, anchor long, block int, content long, left int, bytes binary, asked binary"


def _suffixes(length: int):
    """A row per listed content and block: the segment's bytes, how many of them lie left of the anchor, and the windows asked for.

    ``asked`` has a byte per window; it is empty where the anchor has one block, which asks for all.
    """
    names = [c.split()[0] for c in _SUFFIX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for text, listed in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for x in listed:
                    data = text[x["a"] : x["b"] + length]
                    # Shifted into the signed range, with the order of the bytes.
                    lead = int.from_bytes(text[x["p"] : x["p"] + 8].ljust(8, b"\0"), "big") - (1 << 63)
                    head = (lead, x["anchor"])
                    tail = (x["content"], x["p"] - x["a"], data)
                    if x["blocks"] == 1:
                        rows.append((*head, 0, *tail, b""))
                    else:
                        (large,) = window_hashes(np.frombuffer(data, np.uint8), (length,))
                        block = (large % np.uint64(x["blocks"])).astype(np.int64)
                        for k in np.unique(block).tolist():
                            rows.append((*head, k, *tail, (block == k).astype(np.uint8).tobytes()))
                    size += len(data)
                if size >= BUCKET_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _sides(data: list[bytes], left: list[int], length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the bytes from its anchor on, and those before it from right to left; both padded to whole words."""
    wide = lambda n: -(-max(n, 1) // 8) * 8
    right = np.zeros((len(data), wide(length)), np.uint8)
    before = np.zeros((len(data), wide(length - anchor)), np.uint8)
    for i, (bytes_, n) in enumerate(zip(data, left)):
        row = np.frombuffer(bytes_, np.uint8)
        right[i, : len(row) - n] = row[n:]
        before[i, :n] = row[:n][::-1]
    return right, before


def _sorted(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by group and bytes, and the common prefix of each with the row before it (-1 where a group begins)."""
    words = rows.view(">u8").astype(np.uint64)
    order = multikey_quicksort([group, *words.T])
    a, b = rows[order[1:]], rows[order[:-1]]
    differs = a != b
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def repeated_windows(group, data: list[bytes], left: list[int], asked: list[bytes], length: int, anchor: int):
    """First and last window of each row that another row of its group holds at the same distance from the anchor; -1 if there is none."""
    right, before = _sides(data, left, length, anchor)
    (by_right, right_common), (by_left, left_common) = _sorted(group, right), _sorted(group, before)
    left = np.array(left, np.int64)
    lowest = left - (np.array([len(x) for x in data], np.int64) - length)
    low, high = np.full(len(left), -1, np.int64), np.full(len(left), -1, np.int64)
    right_run, left_run = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    some = np.array([len(x) > 0 for x in asked])
    for d in range(int(lowest.min()), int(left.max()) + 1):
        rows = np.flatnonzero((lowest <= d) & (d <= left))
        if some.any():
            rows = rows[np.array([not asked[i] or asked[i][left[i] - d] == 1 for i in rows], bool)]
        if len(rows) < 2:
            continue
        right_run[by_right] = np.cumsum(right_common < length - d)
        left_run[by_left] = np.cumsum(left_common < d)
        key = right_run[rows] * len(left) + left_run[rows]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        # Windows come from the last one (least d) to the first one.
        high[hit] = np.where(high[hit] < 0, left[hit] - d, high[hit])
        low[hit] = left[hit] - d
    return low, high


def _bucket(length: int, anchor: int):
    """anchor, content, low, high: first and last window of each segment that another segment of the bucket holds too."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        anchors, blocks, contents = (rows.column(c).to_numpy() for c in ("anchor", "block", "content"))
        order = np.lexsort((contents, blocks, anchors))
        new, other = np.ones(len(order), bool), np.ones(len(order), bool)
        new[1:] = (np.diff(anchors[order]) != 0) | (np.diff(blocks[order]) != 0)
        other[1:] = new[1:] | (np.diff(contents[order]) != 0)
        group, order = np.cumsum(new)[other], order[other]
        anchors, contents, rows = anchors[order], contents[order], rows.take(pa.array(order))
        data, left, asked = (rows.column(c).to_pylist() for c in ("bytes", "left", "asked"))
        low, high = repeated_windows(group, data, left, asked, length, anchor)
        hit = low >= 0
        found = [x[hit] for x in (anchors, contents, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["anchor", "content", "low", "high"])

    return run


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """The order that sorts rows by their key words: three-way splits on one word, the next word only among equals."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(keys):
            continue
        part = order[a:b]
        if b - a <= 4096:
            order[a:b] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        word = keys[depth][part]
        sample = word[:: max(1, len(word) // 1023)]
        middle = np.partition(sample, len(sample) // 2)[len(sample) // 2]
        low, equal, high = part[word < middle], part[word == middle], part[word > middle]
        order[a:b] = np.concatenate((low, equal, high))
        todo += [(a, a + len(low), depth), (a + len(low), b - len(high), depth + 1), (b - len(high), b, depth)]
    return order


def repeated_spans(docs: DataFrame, *, length: int, anchor: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents with repeats; spans are half-open and may overlap."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(column(doc_id).alias("doc_id"), text_hash(column(text)).alias("text_hash"), column(text).alias("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    found = Stored(
        texts.mapInArrow(
            _segmented(length, anchor, CHUNK),
            f"doc_id {id_type}, text_hash long, a int, b int, p int, anchor long, content long",
        ),
        "segments",
    )
    anchors = (
        found.df.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("n > 1")
        .select(apart(F.col("anchor")).alias("anchor"), (F.col("low") < F.col("high")).alias("mixed"))
    )
    shared = Stored(found.df.join(anchors, "anchor"), "shared")
    found.drop()
    release_shuffles(spark)

    whole = shared.df.filter("NOT mixed").select("doc_id", "text_hash", "a", (F.col("b") + length).alias("e"))
    mixed = shared.df.filter("mixed")
    contents = Stored(
        mixed.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "a", "b", "p")).alias("one")
        ),
        "contents",
    )
    many = (
        contents.df.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("k"))
        .filter(F.col("k") > BLOCK)
        .select(apart(F.col("anchor")).alias("anchor"), F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    )
    listed = (
        contents.df.join(many, "anchor", "left")
        .select("one.*", "anchor", "content", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("a", "b", "p", "anchor", "content", "blocks")).alias("listed"))
        .select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), "listed")
    )
    # Equal rows share id and hash; a bucket drops the contents that come twice for that.
    source = texts.join(listed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")))
    suffixes = Stored(
        source.select("text", "listed").mapInArrow(_suffixes(length), _SUFFIX), "suffixes"
    )
    release_shuffles(spark)
    total = suffixes.df.agg(F.sum(F.length("bytes") + F.length("asked"))).first()[0] or 0
    reach = (
        suffixes.df.repartitionByRange(-(-total // BUCKET_BYTES) or 1, "lead", "anchor", "block")
        .select("anchor", "block", "content", "left", "bytes", "asked")
        .mapInArrow(_bucket(length, anchor), _REACH)
        .groupBy("anchor", "content")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    ends = Stored(
        contents.df.join(reach, ["anchor", "content"], "left")
        .filter("n > 1 OR low IS NOT NULL")
        .select("anchor", "content", F.expr("IF(n > 1, NULL, low)").alias("low"), F.expr("IF(n > 1, NULL, high)").alias("high")),
        "ends",
    )
    for old in (suffixes, contents):
        old.drop()
    release_shuffles(spark)
    border = mixed.join(ends.df, ["anchor", "content"]).select(
        "doc_id",
        "text_hash",
        F.expr("IF(low IS NULL, a, a + low)").alias("a"),
        F.expr(f"IF(low IS NULL, b, a + high) + {length}").alias("e"),
    )
    return whole.unionAll(border).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "e")).alias("spans"))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, e in spans:
        parts.append(data[at:a])
        at = e
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, length: int, anchor: int, text: str, doc_id: str, name: str) -> DataFrame:
    """``docs`` and a column of the spans to remove."""
    own = free_prefix(docs, ["id", "hash"])
    spans = repeated_spans(docs, length=length, anchor=anchor, text=text, doc_id=doc_id)
    right = spans.select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"), F.col("spans").alias(name))
    same = column(doc_id).eqNullSafe(F.col(f"{own}id")) & (text_hash(column(text)) == F.col(f"{own}hash"))
    # The spans have a row per document and are fewer bytes than the texts, which need not be sorted.
    return docs.join(right.hint("shuffle_hash"), same, "left").drop(f"{own}id", f"{own}hash")


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``text`` cut, at whole characters, and behind ``free_prefix(docs, ["removed_bytes"])`` the bytes it lost."""
    name = f"{free_prefix(docs, ['removed_bytes'])}removed_bytes"
    found = _with_spans(docs, length, anchor, text, doc_id, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at_text, n, names = docs.columns.index(text), len(docs.columns), schema.names

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for value, spans in zip(batch.column(at_text).to_pylist(), batch.column(n).to_pylist()):
                if not spans:
                    texts.append(value)
                    removed.append(0)
                    continue
                data, cut = value.encode(), []
                for a, e in joined_spans((s["a"], s["e"]) for s in spans):
                    while a < e and data[a] & 0xC0 == 0x80:
                        a += 1
                    while e > a and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    cut.append((a, e))
                kept = without(data, cut)
                texts.append(kept.decode())
                removed.append(len(data) - len(kept))
            made = [batch.column(i) for i in range(n)]
            made[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*made, pa.array(removed, pa.int64())], names=names)

    return map_rows(found.select(*columns(docs), name), run, schema)


def _digest(batches):
    for batch in batches:
        sizes, gone, runs, digests = [], [], [], []
        for data, spans in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
            cut = joined_spans((s["a"], s["e"]) for s in spans or ())
            kept = without(data, cut)
            sizes.append(len(data))
            gone.append(len(data) - len(kept))
            runs.append(len(cut))
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, gone, runs)), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _with_spans(docs, LENGTH, ANCHOR, "text", "doc_id", "spans").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
