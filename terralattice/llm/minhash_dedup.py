"""MinHash near-duplicate detection: universal hash minima, banding, signature verification, components.

A document's set holds the hashes of its word shingles.  Equal sets form a class, shown by the class's
smallest id; only classes go on.  ``bands * rows`` universal hashes give minima; a band's minima are a
bucket.  Candidates come from buckets without making all pairs:

1. every class pairs with the smallest class of each of its buckets;
2. pairs whose signatures cannot belong to similar sets fall out, the others are confirmed on their full sets;
3. large-star and small-star steps give components;
4. in buckets that still hold several components, the classes outside the bucket's most common component are compared with the
   bucket's members, block by block: first by signatures alone, which marks the classes that have a plausible partner in another
   component; only the marked ones' texts are then sent to blocks and compared on full sets.  Only links come out, never pairs.
   Then 3 again.

After step 4 every two classes that share a bucket are in one component or were compared, so a
bucket's members lose no link, whatever the bucket's size.  With 32 bands of 4 rows, two sets of similarity 0.8 share no
bucket with a probability of 5e-8.  Step 4's signatures still meet block by block, so its work grows with a bucket's members times
those outside its main component.

Null and empty texts have the empty set, which is linked with nothing.  Very long texts are hashed in windows; what stays in memory is their
set, eight bytes a shingle.  Documents without an id are linked with nothing and have no component.  Rows that repeat an id are one node
of the graph; equal texts are one class.  An empty table gives no rows.  Extra columns pass through ``drop_near_duplicates``,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralattice.llm._common import Stored, apart, column, free_prefix, mix64, prepare, release_shuffles, texts_of
from terralattice.llm.components import connected_components
from terralattice.llm.shingles import shingle_set

BANDS, ROWS = 32, 4
#: Standard deviations of the signature's estimate that a refuted pair lies below the threshold.
MARGIN = 6.5
#: Rows of a bucket whose signatures are compared with as many others at once, and shingles of the texts that are.
SIGNED, SHINGLES = 4096, 1 << 19
#: Rows with a signature in a file of a bounded table.
SIGNED_ROWS = 25_000


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n universal hashes a * x + b on 64-bit words; the family is fixed by its seed."""
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 1 << 63, n, dtype=np.uint64
    )


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The high half of every hash's minimum over the set, by blocks that fit a cache."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(shingles), 256):
        np.minimum(out, (shingles[first : first + 256, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _signatures(words: int, bands: int, rows: int):
    a, b = _hash_family(bands * rows)
    names = ["doc_id", "set_a", "set_b", "n", "buckets", "signature"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            set_a, set_b, sizes, buckets, signatures = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, words)
                sizes.append(len(s))
                set_a.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                set_b.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
                if not len(s):
                    buckets.append([])
                    signatures.append(b"")
                    continue
                low = minima(s, a, b)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for column in low.reshape(bands, rows).T:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                buckets.append(key.view(np.int64).tolist())
                signatures.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(set_a, pa.int64()),
                    pa.array(set_b, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(buckets, pa.list_(pa.int64())),
                    pa.array(signatures, pa.binary()),
                ],
                names=names,
            )

    return run


def _similar_signatures(least_equal: int):
    """Keeps x, y of pairs whose signatures agree often enough."""

    def run(batches):
        for batch in batches:
            sx, sy = (b"".join(batch.column(i).to_pylist()) for i in (2, 3))
            n = batch.num_rows
            if not n:
                continue
            equal = (np.frombuffer(sx, np.uint8) == np.frombuffer(sy, np.uint8)).reshape(n, -1).sum(1)
            keep = pa.array(equal >= least_equal)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return run


def _similar_sets(words: int, percent: int):
    """Confirms x, y on the full sets; neighbouring rows share x, whose set is made once."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last, x_set = None, None
        for batch in batches:
            keep = []
            for zx, zy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if zx != last:
                    last, x_set = zx, shingle_set(unpack(zx), words)
                keep.append(similar(x_set, shingle_set(unpack(zy), words), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _runs(names: list[str]):
    """Batches of rows sorted by ``names`` as one table per run of equal values."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for first, end in zip(cuts, cuts[1:]):
                key = tuple(keys[first])
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(first, end - first))
                last = key
        if held:
            yield pa.Table.from_batches(held)

    return run


class _Block:
    """A block of a bucket: members, and rows outside the main component that are compared with them."""

    def __init__(self, rows: pa.Table, percent: int, least_equal: int):
        self.percent, self.least_equal = percent, least_equal
        self.rep, self.comp, outer, self.n = (rows.column(c).to_numpy() for c in ("rep", "comp", "outer", "n"))
        self.signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(self.rep), -1)
        self.members, self.outer = np.flatnonzero(~outer), np.flatnonzero(outer)

    def plausible(self):
        """For each outer row the members of other components whose signatures may belong to a similar set, likeliest first."""
        sizes, comps, signatures = self.n[self.members], self.comp[self.members], self.signature[self.members]
        for i in self.outer:
            near = 100 * np.minimum(sizes, self.n[i]) >= self.percent * np.maximum(sizes, self.n[i])
            at = np.flatnonzero(near & (comps != self.comp[i]))
            if len(at):
                equal = (signatures[at] == self.signature[i]).sum(1)
                keep = equal >= self.least_equal
                if keep.any():
                    yield i, self.members[at[keep][np.argsort(-equal[keep], kind="stable")]]


def _marked(percent: int, least_equal: int):
    """bucket, rep of all rows of a block that have a plausible partner."""

    def run(batches):
        for rows in _runs(["bucket", "i", "o"])(batches):
            block, found = _Block(rows, percent, least_equal), set()
            for i, partners in block.plausible():
                found.add(int(block.rep[i]))
                found.update(block.rep[partners].tolist())
            if found:
                bucket = rows.column("bucket")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["bucket", "rep"]
                )

    return run


def _links(words: int, percent: int, least_equal: int):
    """For a block of a bucket: a link from each outer row to each other component that holds a similar member."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for rows in _runs(["bucket", "i", "o"])(batches):
            block, packed, sets = _Block(rows, percent, least_equal), rows.column("packed"), {}

            def of(i, sets=sets, packed=packed):
                if i not in sets:
                    sets[i] = shingle_set(unpack(packed[int(i)].as_py()), words)
                return sets[i]

            links = []
            for i, partners in block.plausible():
                linked = set()
                for m in partners:
                    if block.comp[m] not in linked and similar(of(i), of(m), percent):
                        linked.add(block.comp[m])
                        links.append((int(block.rep[i]), int(block.rep[m])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 times the sets' intersection is at least ``percent`` times their union."""
    low, high = sorted((len(x), len(y)))
    if 100 * low < percent * high:
        return False
    joint = np.sort(np.concatenate((x, y)))
    common = int((joint[1:] == joint[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pack(t) for t in texts_of(batch.column(1))], pa.binary())], names=["id", "packed"]
        )


class NearDuplicates:
    """One run over ``docs``; ``members`` has doc_id, n_shingles, component_id for every row with an id."""

    def __init__(self, docs: DataFrame, words: int, percent: int, bands: int, rows: int, text: str, doc_id: str):
        spark = docs.sparkSession
        prepare(spark)
        self.spark, self.words, self.percent = spark, words, percent
        j = percent / 100
        self.least_equal = int(bands * rows * j - MARGIN * (bands * rows * j * (1 - j)) ** 0.5)
        texts = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).filter("doc_id IS NOT NULL")
        signed = Stored(
            texts.mapInArrow(
                _signatures(words, bands, rows),
                "doc_id long, set_a long, set_b long, n long, buckets array<long>, signature binary",
            ),
            "signed",
        )
        classes = Stored(
            signed.df.filter("n > 0")
            .groupBy("set_a", "set_b", "n")
            .agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature")),
            "classes",
            signed.rows,
            SIGNED_ROWS,
        )
        self.signatures = classes.df.select("rep", "n", "signature")
        shared = self._shared(classes.df.select("rep", F.explode("buckets").alias("bucket")), bands * classes.rows)
        in_buckets = shared.rows
        packed = Stored(
            texts.join(shared.df.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
            .select("doc_id", "text")
            .mapInArrow(_packed, "id long, packed binary"),
            "packed",
        )
        self.packed = packed.df
        release_shuffles(spark)

        first = shared.df.filter("rep <> pivot").select(F.col("pivot").alias("x"), F.col("rep").alias("y")).distinct()
        stars = connected_components(self._confirmed(first), in_buckets)
        more = self._stragglers(shared.df, stars.df, in_buckets)
        if more is not None:
            wider = connected_components(stars.df.unionAll(more.df), stars.rows + more.rows)
            for old in (stars, more):
                old.drop()
            stars = wider
        for old in (packed, shared):
            old.drop()
        release_shuffles(spark)

        # doc_id -> class -> component; neither join keeps an aggregate's partitioning, so that hot classes can be split.
        labels = (
            classes.df.select("set_a", "set_b", "n", "rep")
            .join(stars.df.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep", "left")
            .select("set_a", "set_b", "n", F.coalesce("to", "rep").alias("component_id"))
        )
        of = signed.df.select("doc_id", "n", "set_a", "set_b").join(labels, ["set_a", "set_b", "n"], "left")
        self.members = of.select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )

    def _shared(self, rows: DataFrame, at_most: int) -> Stored:
        """bucket, rep, pivot of the buckets that hold several classes."""
        pivots = rows.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last")
        return Stored(rows.join(pivots.select(apart(F.col("bucket")).alias("bucket"), "pivot"), "bucket"), "shared", at_most)

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """u, v of the pairs x, y that are similar."""
        side = lambda k: self.signatures.select(
            F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}")
        )
        likely = (
            pairs.join(side("y"), "y")
            .join(side("x"), "x")
            .filter((100 * F.least("nx", "ny")) >= self.percent * F.greatest("nx", "ny"))
            .select("x", "y", "sx", "sy")
            .mapInArrow(_similar_signatures(self.least_equal), "x long, y long")
        )
        text = lambda k: self.packed.select(F.col("id").alias(k), F.col("packed").alias(f"z{k}"))
        return (
            likely.join(text("y"), "y")
            .join(text("x"), "x")
            .select("x", "y", "zx", "zy")
            .mapInArrow(_similar_sets(self.words, self.percent), "u long, v long")
        )

    def _stragglers(self, shared: DataFrame, stars: DataFrame, at_most: int) -> Stored | None:
        """u, v: links across components within one bucket, found without making its pairs; None if there is none to look for."""
        placed = Stored(
            shared.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep", "left").select(
                "bucket", "rep", F.coalesce("to", "rep").alias("comp")
            ),
            "placed",
            at_most,
        )
        per = placed.df.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"))
        # Two members were compared in the first round, and buckets of the same members need one look.
        main = (
            per.groupBy("bucket")
            .agg(
                F.max_by("comp", F.struct("n", "comp")).alias("main"),
                F.count(F.lit(1)).alias("k"),
                F.sum("n").alias("m"),
                F.bit_xor("x").alias("x"),
            )
            .filter("k > 1 AND m > 2")
            .groupBy("x", "m")
            .agg(F.min(F.struct("bucket", "main")).alias("one"))
            .select(apart(F.col("one.bucket")).alias("bucket"), "one.main")
        )
        mixed = Stored(
            placed.df.join(main, "bucket")
            .select("bucket", "rep", "comp", (F.col("comp") != F.col("main")).alias("outer"))
            .join(self.signatures, "rep"),
            "mixed",
            at_most,
            SIGNED_ROWS,
        )
        placed.drop()
        marked = Stored(
            _in_blocks(mixed.df, F.lit(1), SIGNED)
            .mapInArrow(_marked(self.percent, self.least_equal), "bucket long, rep long")
            .distinct(),
            "marked",
            at_most,
        )
        found = marked.rows
        if not found:
            for old in (marked, mixed):
                old.drop()
            return None
        asked = Stored(mixed.df.join(marked.df, ["bucket", "rep"], "left_semi"), "asked", found, SIGNED_ROWS)
        for old in (marked, mixed):
            old.drop()
        out = Stored(
            _in_blocks(asked.df, F.col("n"), SHINGLES, self.packed.withColumnRenamed("id", "rep"))
            .mapInArrow(_links(self.words, self.percent, self.least_equal), "u long, v long")
            .distinct(),
            "links",
        )
        asked.drop()
        return out


def _in_blocks(rows: DataFrame, weight: Column, most: int, beside: DataFrame | None = None) -> DataFrame:
    """Rows of buckets dealt to blocks (i, o), sorted by bucket and block.

    A bucket's members, and those outside its main component, are each cut into blocks of a weight of about ``most``; every
    block of the ones meets every block of the others.
    """
    sizes = rows.groupBy("bucket").agg(
        F.ceil(F.sum(weight) / most).cast("int").alias("n_in"),
        F.ceil(F.sum(F.when(F.col("outer"), weight)) / most).cast("int").alias("n_out"),
    )
    cut = rows.join(sizes.filter("n_out > 0").select(apart(F.col("bucket")).alias("bucket"), "n_in", "n_out"), "bucket")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(every("n_out"), lambda o: F.struct(F.lit(False).alias("outer"), spread("n_in").alias("i"), o.alias("o")))
    as_outer = F.transform(every("n_in"), lambda i: F.struct(F.lit(True).alias("outer"), i.alias("i"), spread("n_out").alias("o")))
    places = F.when(F.col("outer"), F.concat(as_member, as_outer)).otherwise(as_member)
    dealt = cut.select("bucket", "rep", "comp", "n", "signature", F.explode(places).alias("at")).select(
        "bucket", "rep", "comp", "n", "signature", "at.*"
    )
    if beside is not None:
        dealt = dealt.join(beside, "rep")
    return dealt.repartition("bucket", "i", "o").sortWithinPartitions("bucket", "i", "o")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest id) of every row."""
    run = NearDuplicates(docs, words, percent, bands, rows, text, doc_id)
    nameless = docs.filter(column(doc_id).isNull()).select(
        column(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return run.members.unionAll(nameless).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component; rows without an id stay."""
    gone = f"{free_prefix(docs, ['gone'])}gone"
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found.hint("shuffle_hash"), column(doc_id) == F.col(gone), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, u AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS u FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r(u, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b.v, r.c FROM r JOIN b ON b.u = r.u WHERE r.c < b.v
), k AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN k ON d.doc_id = k.u
"""
