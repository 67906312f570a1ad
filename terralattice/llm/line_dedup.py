"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A task explodes a text once: for each of its distinct keys (lines stripped, A-Z lower-cased, long enough) a 128-bit hash and the
positions of the lines that have it.  These rows are stored, counted by hash, and joined with the hashes that are repeated; the join is on
hashes of lines alone, so that adaptive execution can split a line that a third of all documents share.  What a document loses is then
joined to it by its id and text.

Every row is one document.  Null and empty texts hold one empty line.  A row whose id is
null counts as a document but never keeps a repeated line that a row with an id holds;
if only rows without an id hold it, all lose it but none can be the keeper, so the line stays.
Rows that repeat an id are separate documents: a repeated line stays in every row with the keeper's id.  Very long texts are
split whole, lines of any length.  An empty table gives no rows.
Extra columns are passed through untouched, whatever their names; the results' names get more underscores if they are taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralattice.llm._common import LOWER_BYTES, Stored, apart, column, columns, free_prefix, map_rows, prepare, text_hash, texts_of

SPACE = b" \t\n\x0b\x0c\r"
#: The columns that come after a prefix.
NAMES = ("n_lines", "n_dropped")


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points, of up to four bytes each."""
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return len(key.decode("utf-8", "replace")) >= least


def line_keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """A text's distinct keys of at least ``least`` code points, each with the places of its lines."""
    found: dict[bytes, list[int]] = {}
    if len(text) >= least:
        for place, line in enumerate(text.translate(LOWER_BYTES).split(b"\n")):
            if len(line) >= least and long_enough(key := line.strip(SPACE), least):
                found.setdefault(key, []).append(place)
    return found


def _exploded(least: int):
    names = ["doc_id", "text_hash", "a", "b", "places"]

    def run(batches):
        for batch in batches:
            at, digests, places = [], [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                for key, found in line_keys(text, least).items():
                    at.append(i)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    places.append(found)
            if at:
                hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(np.ascontiguousarray(hashes[:, 0])),
                        pa.array(np.ascontiguousarray(hashes[:, 1])),
                        pa.array(places, pa.list_(pa.int32())),
                    ],
                    names=names,
                )

    return run


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text_hash, lost) for documents that lose a line: the places of their lost lines, in lists."""
    prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    lines = Stored(
        docs.select(column(doc_id).alias("doc_id"), text_hash(column(text)).alias("text_hash"), column(text).alias("text")).mapInArrow(
            _exploded(min_chars), f"doc_id {id_type}, text_hash long, a long, b long, places array<int>"
        ),
        "lines",
    ).df
    common = (
        lines.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
        .select(apart(F.col("a")).alias("a"), "b", "keeper")
    )
    lost = lines.join(common, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Equal rows lose the same places; a set holds them once.
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("places").alias("lost"))


def drop_repeated_lines(
    docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten and, after ``free_prefix(docs, NAMES)``, the columns NAMES.

    A null text that loses nothing stays null.
    """
    lost = repeated_lines(docs, min_chars, min_docs, text, doc_id)
    own = free_prefix(docs, ["id", "hash", "lost"])
    right = lost.select(*(F.col(c).alias(f"{own}{n}") for c, n in (("doc_id", "id"), ("text_hash", "hash"), ("lost", "lost"))))
    same = column(doc_id).eqNullSafe(F.col(f"{own}id")) & (text_hash(column(text)) == F.col(f"{own}hash"))
    # The lost places are fewer bytes than the texts and have a row per document: they are hashed, and the texts aren't sorted.
    joined = docs.join(right.hint("shuffle_hash"), same, "left").select(*columns(docs), f"{own}lost")
    prefix = free_prefix(docs, NAMES)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"{prefix}{n}", T.LongType()) for n in NAMES)])
    names, at_text, at_lost = schema.names, docs.columns.index(text), len(docs.columns)

    def rebuild(batches):
        for batch in batches:
            texts, lost = batch.column(at_text), batch.column(at_lost)
            total = np.array(pc.fill_null(pc.count_substring(texts, "\n"), 0), np.int64) + 1
            gone = np.zeros(len(total), np.int64)
            loses = pc.is_valid(lost)
            made = []
            for i in np.flatnonzero(np.array(loses)).tolist():
                places = {p for part in lost[i].as_py() for p in part}
                made.append("\n".join(x for p, x in enumerate(texts[i].as_py().split("\n")) if p not in places))
                gone[i] = len(places)
            out = [batch.column(i) for i in range(at_lost)]
            if made:
                out[at_text] = pc.replace_with_mask(texts, loses, pa.array(made, texts.type))
            yield pa.RecordBatch.from_arrays([*out, pa.array(total), pa.array(gone)], names=names)

    return map_rows(joined, rebuild, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), c AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.k IS NOT NULL AND l.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.k IS NULL OR l.doc_id = c.keeper), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.k = c.k GROUP BY l.doc_id
"""
