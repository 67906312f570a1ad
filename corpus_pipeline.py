"""The corpus pipeline: toxicity filter, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes a stage's
rows as Parquet in the cluster's shared folder and reads them back for the next.  All stages but the last return the columns of their
input, extra ones too, whatever their names.  Null and empty texts are kept by every stage (they are not toxic, lose no line, resemble nothing
and hold no benchmark text) and packed as an end id alone; rows without an id are kept too.  Repeated rows are one text to the
near-duplicate stage, which keeps all rows of the id it keeps.  Ties go to the smallest id there, to the largest in line dedup.  Very long texts
are worked on whole.  An empty table goes through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralattice.llm import decontaminate, line_dedup, minhash_dedup, packing, toxicity
from terralattice.llm._common import Stored, columns, free_prefix, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, does not call toxic."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), toxicity.categories())
    return toxicity.drop_flagged(docs, chain, "toxic")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them repeat; n_chars follows the text."""
    kept, prefix = line_dedup.drop_repeated_lines(docs), free_prefix(docs, line_dedup.NAMES)
    if "n_chars" in docs.columns:
        changed = F.col(f"{prefix}n_dropped") > 0
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL expresses the classifier chain or retrieval packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if stored is not None:
            stored.drop()
        docs, stored = done.df, done
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    stored.drop()  # the pieces are made from tokens, which packing has stored by now
    return pieces
