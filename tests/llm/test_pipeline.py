"""The pipeline's stages on small, awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralattice.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_is_toxic` string, `_lost` string"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Documents of known fate: id to what becomes of them."""
    rng = random.Random(1)
    line = "This very line stands in a number of the documents."
    passage = prose(rng, 60)
    rows, labels, fate = [], [], {}

    def add(text, what):
        i = len(rows)
        rows.append((i, text, "en", "s", len(text or ""), "mine", "too"))
        fate[i] = what
        return i

    for k in range(120):
        toxic = k % 3 == 0
        i = add(prose(rng, 40) + (" you vile worthless moron" if toxic else ""), "toxic" if toxic else "kept")
        if k < 90:
            labels.append((i, 1, int(toxic)))
    for k in range(6):
        add(f"{prose(rng, 30)}\n{line}\n{prose(rng, 20)}", "cut" if k < 5 else "kept")
    base = prose(rng, 200)
    for k in range(5):
        add(f"{base} tail{k}", "copy" if k else "kept")
    for k in range(4):
        add(f"{prose(rng, 50)} {passage} {prose(rng, 20)}", "contaminated")
    add(f"{prose(rng, 3000)} {' '.join(passage.split()[:13])}", "kept")  # hit, but in a hundredth of its words
    for text in (None, "", " "):
        add(text, "kept")
    rows.append((None, "a row without an id", None, None, None, None, None))
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, fate, line


def test_stages_one_after_another(spark, world):
    folder, rows, fate, line = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
        got = docs.collect()
        assert all(r["_is_toxic"] in ("mine", None) and r["_lost"] in ("too", None) for r in got)
        gone = {"toxicity": "toxic", "minhash_dedup": "copy", "decontaminate": "contaminated"}.get(name, "none")
        left = {i: t for i, t in left.items() if fate.get(i) != gone}
        if name == "line_dedup":
            left = {i: "\n".join(x for x in t.split("\n") if x != line) if fate.get(i) == "cut" else t for i, t in left.items()}
        assert {r["doc_id"]: r["text"] for r in got} == left, name
        assert all(r["n_chars"] == len(r["text"] or "") for r in got if r["doc_id"] is not None)
        docs = spark.createDataFrame(got, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    encoder = packing.encoder(packing.tokenizer_file())
    assert sum(p["length"] for p in pieces) == sum(len(encoder.encode_ordinary(t or "")) + 1 for t in left.values())


def test_run_gives_the_pieces_of_what_is_kept(spark, world):
    folder, rows, fate, _ = world
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in rows if fate.get(r[0]) in (None, "kept", "cut")}


def test_run_on_empty_tables(spark, world, tmp_path):
    folder = world[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
