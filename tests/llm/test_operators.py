"""The training-data operators against brute force on small, awkward tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralattice.llm import (
    components,
    decontaminate,
    exact_search,
    language_id,
    line_dedup,
    minhash_dedup,
    packing,
    pii,
    shingles,
    suffix_dedup,
    toxicity,
    warc,
)
from terralattice.llm._common import joined_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string"


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(rng):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = prose(rng, 120, 3000)
    near = base.split()
    texts = [None, "", " ", "one", "one", base, base, base.upper()]
    for i in range(6):
        words = list(near)
        words[i * 7] = f"changed{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 60, 900) for _ in range(12)]
    texts += ["x" * 900, "ab " * 700, "é" * 500, prose(rng, 9000, 4000), base + "\n" + prose(rng, 50, 500)]
    rows = [(i, t, "en", "s", 0, -1, "clash") for i, t in enumerate(texts)]
    return rows + [(5, base, "en", "s", 0, -1, "clash"), (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(11))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- near duplicates ---------------------------------------------------------------------------


def brute_components(rows, size):
    sets = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)) if x]
            k = min(size, len(w))
            sets[r[0]].append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    got = minhash_dedup.near_duplicates(docs, words=size).collect()
    want = brute_components(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_nothing(empty):
    assert minhash_dedup.near_duplicates(empty).collect() == []


def test_stragglers_link_through_a_hot_group(spark):
    """A large group, with copies that resemble only some of its members."""
    rng = random.Random(2)
    base = prose(rng, 100, 5000).split()
    made = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(100), rng.choice([1, 3, 6, 9])):
            words[k] = f"n{i}x{k}"
        made.append((i, " ".join(words), "en", "s", 0, 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(made, SCHEMA), words=2).collect()}
    assert got == brute_components(made, 2)


def test_stragglers_in_many_blocks(spark, monkeypatch):
    """Groups of which many members resemble others but not the group's first; blocks of a few rows."""
    monkeypatch.setattr(minhash_dedup, "SIGNED", 16)
    monkeypatch.setattr(minhash_dedup, "SHINGLES", 900)
    rng = random.Random(3)
    made = []
    for g in range(3):
        base = prose(rng, 100, 5000).split()
        for i in range(70):
            words, family = list(base), i % 9
            for k in range(family * 2, family * 2 + 14):
                words[k] = f"g{g}f{family}x{k}"
            for k in rng.sample(range(100), 2):
                words[k] = f"g{g}i{i}x{k}"
            made.append((len(made), " ".join(words), "en", "s", 0, 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(made, SCHEMA), words=2).collect()}
    assert got == brute_components(made, 2)


def test_word_hashes_in_windows():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\tXé") for _ in range(rng.randrange(60))).encode()
        for window in (1, 2, 3, 7):
            assert np.array_equal(shingles.word_hashes(text, window), shingles.word_hashes(text))


def test_drop_keeps_columns_and_one_of_each(docs, rows):
    kept = minhash_dedup.drop_near_duplicates(docs, words=5)
    assert kept.columns == docs.columns
    want = {i for i, c in brute_components(rows, 5).items() if i == c}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 512)]
    got = {r["u"]: r["v"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    parent = {i: i for e in edges for i in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {i: find(i) for i in parent if find(i) != i}


# --- decontamination ----------------------------------------------------------------------------


def brute_contamination(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        m = min(window, len(w))
        for s in range(len(w) - m + 1) if w else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[s : s + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, docs, rows, block):
    long = rows[5][1].split()
    items = [(1, " ".join(long[10:30])), (2, "W1, w2"), (3, None), (None, " ".join(long[50:70])), (10, " ".join(long[20:34])), (1, "ONE")]
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = decontaminate.with_verdict(found).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = brute_contamination(r["text"], items)
        assert (r["_n_words"], r["_n_hit"], sorted(r["_items"])) == (n, hit, ids)
        assert r["_contaminated"] == (hit > 0 and 20 * hit >= n)
        assert r["n_words"] in (-1, None)  # the clashing column is left alone


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_longest_matches_and_their_places(spark, block, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(30, 200), 6) for _ in range(25)] + [None, "", "w1"]
    items = [(i, prose(rng, rng.randrange(1, 60), 6)) for i in range(8)] + [(50, texts[3][20:140]), (51, texts[3][20:140]), (52, "w1 w1")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = decontaminate.find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), window=5, block_bytes=block)
    for r in found.collect():
        words, want = (r["text"] or "").split(), set()
        for item, t in items:
            w = t.split()
            m = min(5, len(w))
            starts = {(a, b) for a in range(len(words) - m + 1) for b in range(len(w) - m + 1) if words[a : a + m] == w[b : b + m]}
            for a, b in starts:
                if (a - 1, b - 1) not in starts:
                    n = 0
                    while (a + n, b + n) in starts:
                        n += 1
                    want.add((a, m + n - 1, str(item), b))
        assert {tuple(x) for x in r["_matches"]} == want and len(r["_matches"]) == len(want)


def test_drop_contaminated_keeps_columns(spark, docs, rows):
    items = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    clash = docs.withColumn("_n_hit", F.lit("mine")).withColumn("_Spans", F.lit(7))
    kept = decontaminate.drop_contaminated(clash, items)
    assert kept.columns == clash.columns
    want = sum(1 for r in rows if not (lambda x: x[1] and 20 * x[1] >= x[0])(brute_contamination(r[1], [(1, rows[5][1])])))
    got = kept.collect()
    assert len(got) == want and all(r["_n_hit"] == "mine" and r["_Spans"] == 7 for r in got)


def test_decontamination_without_benchmark(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.with_verdict(decontaminate.find_contamination(docs, none)).collect()
    assert len(got) == len(rows) and not any(r["_contaminated"] for r in got)


# --- packing ------------------------------------------------------------------------------------


def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs).collect()
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for p in pieces:
        cut = [np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes() for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in {zlib.crc32(c) for c in cut}
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    for group in by.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.LENGTH
    shards = {s >> 32 for s in by}
    assert sum(sum(p["length"] for p in g) < packing.LENGTH for g in by.values()) <= len(shards)


def test_packing_of_odd_texts_matches_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    pool = "aZ09 \t\n\r  'é漢字😀́ß-_.,!?'s'll"
    for _ in range(200):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert packing.encoder(packing.tokenizer_file()).encode_ordinary(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_finds_added_tokens_in_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " the", "é", "漢", "'s", "<", "12"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "<|EndOfText|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    got = {p["doc_id"]: p for p in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=10**6).collect()}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["doc_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t


def test_neighbours_share_windows():
    docs = [np.array([5000 + i % 7, 9000 + i % 7, 4000, 1]) for i in range(70)]
    idf = np.full(20_000, 0.1)
    idf[4999:5010] = 5
    groups = collections.defaultdict(list)
    for doc, _, _, sequence, _ in packing.pack_shard(docs, idf, 4.0, 40):
        groups[sequence].append(doc % 7)
    assert all(len(set(g)) == 1 for g in groups.values())


def test_neighbours_are_scored_over_all_terms():
    rng = np.random.default_rng(4)
    # Only the last document shares terms with the seed, and just the common ones of its sixty.
    docs = [np.arange(60), *(np.arange(100 + 40 * i, 140 + 40 * i) for i in range(4)), np.arange(40, 60)]
    idf = np.linspace(9, 1, 400)
    index = packing.Index(docs, idf, 30.0)
    index.used[0] = True
    assert list(index.neighbours(0)) == [5]
    docs = [rng.integers(0, 400, rng.integers(50, 200)) for _ in range(40)]
    index, mean = packing.Index(docs, idf, 120.0), 120.0
    want = []
    for d in docs:
        damp = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
        counts = collections.Counter(d.tolist())
        want.append(sum(idf[t] * counts[t] * (packing.K1 + 1) / (counts[t] + damp) for t in sorted(set(docs[7].tolist())) if t in counts))
    index.used[7] = True
    got = list(index.neighbours(7, first=5))
    assert sorted(got) == [i for i in range(40) if i != 7]
    assert np.all(np.diff(np.array(want)[got]) < 1e-4)  # common terms are summed in single precision
    # The same, for what is left, when most documents are used and their postings dropped.
    index.used[:30] = True
    assert list(index.neighbours(7)) == [i for i in got if i >= 30] and len(index.live) == 10
    assert np.allclose(index.scores(7)[30:], np.array(want)[30:], rtol=1e-5)


def test_packing_in_shards_of_tokens(spark):
    """Shards are cut by tokens inside a task; each id still lies in one piece and only a shard's last sequence is short."""
    rng = random.Random(14)
    made = [(i, prose(rng, rng.choice([0, 3, 50, 700]), 500)) for i in range(120)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    pieces = packing.pack(frame, length=64, shard_tokens=1500).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    for i, _ in made:
        at = 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == by[i][0]["doc_tokens"]
    total = sum(p["length"] for p in pieces)
    sequences = collections.Counter()
    for p in pieces:
        sequences[p["sequence_id"]] += p["length"]
    short = sum(n < 64 for n in sequences.values())
    assert short <= 2 * (total // 1500 + 1) + 4 and max(sequences.values()) <= 64


def test_packing_of_nothing(empty):
    assert packing.pack(empty).collect() == []


# --- exact substrings ---------------------------------------------------------------------------


def brute_repeats(texts, length):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [joined_spans([(i, i + length) for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1]) for t in texts]


@pytest.mark.parametrize(("block", "chunk", "bucket"), [(4096, 1 << 17, 8 << 20), (1, 900, 2000), (2, 300, 500)])
def test_suffix_dedup(spark, docs, rows, block, chunk, bucket, monkeypatch):
    """One block, piece and bucket; and several of each."""
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("BUCKET_BYTES", bucket)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = suffix_dedup._with_spans(docs, 200, 64, "text", "doc_id", "_spans").select("doc_id", "text", "_spans").collect()
    texts = [(r[1] or "").encode() for r in rows]
    want = collections.defaultdict(set)
    for r, spans in zip(rows, brute_repeats(texts, 200)):
        want[r[0], r[1]].add(tuple(spans))
    assert len(got) == len(rows)
    for r in got:
        assert {tuple(joined_spans([(s["a"], s["e"]) for s in r["_spans"] or ()]))} == want[r["doc_id"], r["text"]]


def test_suffix_dedup_random_bytes_and_small_alphabets(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 120))) for _ in range(40)]
    texts += [texts[3] + texts[7] + "é" * 9, "a" * 90, "ab" * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["_spans"] for r in suffix_dedup._with_spans(frame, 20, 8, "text", "doc_id", "_spans").collect()}
    for i, spans in enumerate(brute_repeats([t.encode() for t in texts], 20)):
        assert joined_spans([(s["a"], s["e"]) for s in got[i] or ()]) == spans


def test_remove_repeats_keeps_characters(spark):
    shared = "é" * 130
    frame = spark.createDataFrame([(1, "a" + shared + "b", 7), (2, shared + "zz", 8), (3, None, 9)], "doc_id long, text string, _x int")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got[1]["text"].startswith("a") and got[1]["text"].endswith("b") and got[1]["_removed_bytes"] > 0
    assert got[3]["text"] is None and got[2]["_x"] == 8


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_dedup_at_the_borders_of_a_hot_passage(spark, monkeypatch):
    """A passage that many documents share, cut short by some, between bytes that differ: its border anchors have many contents."""
    rng = random.Random(21)
    letters = "".join(map(chr, range(97, 123))) + " "
    passage = "".join(rng.choice(letters) for _ in range(500))
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [noise(rng.randrange(150)) + passage[rng.randrange(3) * 90 : 500 - rng.randrange(3) * 90] + noise(rng.randrange(150)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats([t.encode() for t in texts], 200)
    for block in (4096, 5):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        got = {r["doc_id"]: r["s"] for r in suffix_dedup._with_spans(frame, 200, 64, "text", "doc_id", "s").collect()}
        assert [joined_spans([(x["a"], x["e"]) for x in got[i] or ()]) for i in range(60)] == want


def test_repeated_windows_by_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        data, left, group = [], [], []
        for g in range(6):
            for _ in range(rng.randrange(1, 7)):
                n = rng.randrange(0, 9)
                data.append(bytes(rng.choice(b"ab") for _ in range(n)) + b"ANCH" + bytes(rng.choice(b"ab") for _ in range(12 - 4)))
                left.append(n)
                group.append(g)
        low, high = suffix_dedup.repeated_windows(np.array(group), data, left, [b""] * len(data), 12, 4)
        for i, (row, n) in enumerate(zip(data, left)):
            hits = [
                a
                for a in range(len(row) - 11)
                if any(
                    j != i and group[j] == group[i] and 0 <= a - n + left[j] <= len(data[j]) - 12
                    and data[j][a - n + left[j] : a - n + left[j] + 12] == row[a : a + 12]
                    for j in range(len(data))
                )
            ]
            assert (low[i], high[i]) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 3, 20_000), rng.integers(0, 50, 20_000), rng.integers(0, 1 << 40, 20_000)]
    order = suffix_dedup.multikey_quicksort(keys)
    got = list(zip(*(k[order].tolist() for k in keys)))
    assert got == sorted(zip(*(k.tolist() for k in keys)))


# --- languages and toxicity -----------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(3)
    stock = {"aa": "the and with house tree walk", "bb": "der und mit haus baum gehen", "cc": "le et avec maison arbre marcher"}
    made = []
    for i in range(300):
        lang = rng.choice(list(stock))
        made.append((i, " ".join(rng.choice(stock[lang].split()) for _ in range(8)), lang))
    made += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "hause baume", None), (None, "the tree", "aa")]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    found = language_id.identify(frame, ~language_id.held_out(F.col("doc_id"))).collect()
    by = {r["doc_id"]: r for r in found}
    assert all(r["_lang_pred"] == r["lang"] for r in found if r["doc_id"] is not None and r["doc_id"] < 300)
    assert [by[i]["_lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["_score"] == 0.0
    assert by[903]["_lang_pred"] == "bb"  # unseen words, by their n-grams
    assert all(0 <= r["_score"] <= 1 for r in found)


def test_language_id_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(17)
    stock = {"aa": "the and with house tree walk", "bb": "der und mit haus baum gehen", "cc": "le et avec maison arbre marcher"}
    letters = "abcdehimnorstuwé"
    made = []
    for i in range(150):
        lang = rng.choice(list(stock))
        words = [rng.choice(stock[lang].split()) for _ in range(rng.randrange(1, 12))]
        words += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(6))]
        made.append((i, rng.choice([" ", "-", " 7 "]).join(words).title(), lang))
    made += [(200, "²³ Ⅷ", "aa"), (201, "7 x²y", "bb")]
    learn = [(t, lang) for i, t, lang in made if i < 100]
    model_words, model_grams = collections.Counter(), collections.Counter()
    split = lambda t: [w for w in re.findall(r"[^\W\d_]+", t.lower()) if any(c.isalpha() for c in w)]
    for t, lang in learn:
        for w in split(t):
            model_words[lang, w] += 1
            for size in range(1, 6):
                for g in language_id.grams_of(w, size):
                    model_grams[lang, g] += 1
    langs = sorted(stock)
    known = {w for _, w in model_words}
    grams = {g for _, g in model_grams}

    def logs(unit, counter, units):
        return [np.log((counter[x, unit] + 0.5) / sum(counter[x, u] + 0.5 for u in units)) for x in langs]

    of_size = {n: [g for g in grams if len(g) == n] for n in range(1, 6)}

    def plain(text):
        total = np.zeros(3)
        words = split(text)
        for w in words:
            if w in known:
                total += logs(w, model_words, known)
                continue
            for size in range(min(5, len(w) + 2), 0, -1):
                have = [g for g in language_id.grams_of(w, size) if g in grams]
                if have:
                    total += np.mean([logs(g, model_grams, of_size[size]) for g in have], axis=0)
                    break
        p = np.exp(total - total.max())
        return (langs[int(p.argmax())], p.max() / p.sum()) if words else ("und", 0.0)

    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(frame, F.col("doc_id") < 100).collect()}
    for i, t, _ in made:
        lang, p = plain(t)
        assert got[i]["_lang_pred"] == lang and abs(got[i]["_score"] - p) < 1e-6, t


def test_texts_in_pieces():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab é7_\n") for _ in range(rng.randrange(80)))
        cut = list(language_id.pieces(text, rng.randrange(1, 9)))
        assert "".join(cut) == text
        assert sum((language_id._WORD.findall(p) for p in cut), []) == language_id._WORD.findall(text)


def test_language_id_without_training(spark, empty):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(frame, F.lit(True)).first()["_lang_pred"] == "und"
    assert language_id.identify(empty, F.lit(True)).collect() == []


def test_held_out_remainder(spark):
    got = spark.range(50).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_chain(spark):
    rng = random.Random(6)
    clean = [f"word{i}" for i in range(300)]
    made, labels = [], []
    for i in range(500):
        words = [rng.choice(clean) for _ in range(rng.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["nastyfoo", "nastybar", "vile"])
        made.append((i, " ".join(words), "keep"))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    labels += [(1, None, 1), (None, 1, 1)]
    made += [(900, None, "keep"), (901, "", "keep")]
    docs = spark.createDataFrame(made, "doc_id long, text string, toxic string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, known, toxicity.categories())
    got = toxicity.score(docs, chain).collect()
    wrong = sum(r["_is_toxic"] != (r["doc_id"] % 4 == 0) for r in got if 400 <= r["doc_id"] < 500)
    assert wrong <= 3 and not any(r["_is_toxic"] for r in got if r["doc_id"] >= 900)
    assert got[0]["toxic"] == "keep" and not any(r["_is_low_quality"] for r in got)


def test_toxicity_scores_against_a_plain_version(spark):
    rng = random.Random(16)
    made = [(i, prose(rng, rng.choice([0, 1, 9, 80]), 60) + rng.choice(["", " Stupidity", " stupid stupid"])) for i in range(240)]
    made += [(300, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 3 % 2, int("stupid" in (t or ""))) for i, t in made[:200]], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, known, toxicity.categories())
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    for i, text in made:
        words, earlier = collections.Counter(re.findall(r"[^\W\d_]+", (text or "").lower())), []
        for model, threshold, name in zip(chain.models, chain.thresholds, chain.names):
            z = model.bias + sum(w * p for w, p in zip(model.dense, earlier))
            for word, n in words.items():
                for f in toxicity.features_of(word):
                    if f < toxicity.WIDTH:
                        z += model.weights[f] * np.log1p(100 * n / sum(words.values()))
            earlier.append(1 / (1 + np.exp(-z)))
            assert abs(got[i][f"_p_{name}"] - earlier[-1]) < 1e-9
            assert got[i][f"_is_{name}"] == (got[i][f"_p_{name}"] >= threshold)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, none, toxicity.categories())
    assert not any(r["_is_toxic"] for r in toxicity.score(docs, chain).collect())


# --- search ------------------------------------------------------------------------------------


def brute_top(rows, k=10):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_exact_search(spark, block_rows):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)]) for i in range(450)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(600, None), (700, [1.0] * 15 + [None]), (800, [float("nan")] * 16), (900, [float("inf")] * 16), (None, [1.0] * 16), (1000, [0.5] * 4), (1001, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_search.top_k(frame, frame.filter("vec_id % 100 = 0"), block_rows=block_rows)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_exact_search_for_queries_from_elsewhere(spark, block_rows):
    rng = random.Random(18)
    rows = [(i, [rng.gauss(rng.choice([-2, 2]), 0.3) for _ in range(12)]) for i in range(300)]
    asked = [(1000 + i, [rng.uniform(-3, 3) for _ in range(12)]) for i in range(20)] + [(5, rows[5][1]), (2000, [1.0] * 3)]
    schema = "vec_id long, embedding array<double>"
    got = exact_search.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k=4, block_rows=block_rows)
    ints = lambda v: [int(np.floor(1024 * x)) for x in v]
    want = set()
    for q, a in asked:
        scores = sorted((-sum(x * y for x, y in zip(ints(a), ints(b))), i) for i, b in rows if i != q and len(b) == len(a))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:4])}
    assert {tuple(r) for r in got.collect()} == want


def test_bounds_leave_few_exact_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (20, 32))
    vectors = np.floor(1024 * (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.1, (4000, 32))))
    rows, queries = exact_search.Side(np.arange(4000), vectors), exact_search.Side(np.arange(40), vectors[:40])
    best = [exact_search.Best(10, s) for s in exact_search.seeds(queries, exact_search.Side(np.arange(1000), vectors[:1000]), 10)]
    made = exact_search.search(queries, rows, best)
    assert made < 0.2 * 40 * 4000
    products = (vectors[:40] @ vectors.T).astype(np.int64)
    for i, b in enumerate(best):
        scores = sorted(((-products[i, j], j) for j in range(4000) if j != i))[:10]
        assert sorted((-s, -j) for s, j in b.heap) == scores


def test_exact_search_large_components_and_nothing(spark):
    rows = [(0, [1e9, -3e8]), (1, [2e9, 1e9]), (2, [-1.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in exact_search.top_k(frame, frame.filter("vec_id = 0")).collect()}
    cut = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    assert got == {(q, r, i, cut(s)) for q, r, i, s in brute_top(rows)}
    assert exact_search.top_k(frame.limit(0), frame.limit(0)).collect() == []


# --- lines -------------------------------------------------------------------------------------


def test_line_dedup(spark):
    line = "A line of more than twenty characters"
    made = [
        (1, f"{line}\nkeep\n{line}", 1), (2, f"  {line.upper()}\t\nown line", 2), (3, f"x\n{line}", 3), (4, "short\nshort", 4),
        (5, "short", 5), (6, "short", 6), (7, None, 7), (8, "", 8), (9, "two documents share this one\n", 9), (10, "two documents share this one", 10),
        (3, "another text of the same id", 3), (None, line, 0),
    ]
    frame = spark.createDataFrame(made, "doc_id long, text string, n_lines long")
    got = line_dedup.drop_repeated_lines(frame).collect()
    by = {(r["doc_id"], r["n_lines"]): r for r in got}
    assert by[1, 1]["text"] == "keep" and by[1, 1]["_n_dropped"] == 2 and by[1, 1]["_n_lines"] == 3
    assert by[2, 2]["text"] == "own line"
    assert {r["text"] for r in got if r["doc_id"] == 3} == {f"x\n{line}", "another text of the same id"}
    assert by[None, 0]["text"] == "" and by[4, 4]["text"] == "short\nshort"
    assert by[7, 7]["text"] is None and by[8, 8]["text"] == "" and by[9, 9]["text"] == "two documents share this one\n"
    assert len(got) == len(made)
    assert line_dedup.drop_repeated_lines(frame.limit(0)).collect() == []


# --- archives ----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(20_000))
    made = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/\r\nx", None), (5, "u", ""), (6, "u", noise), (None, "u", "lone"), (7, "u", "é漢")]
    frame = spark.createDataFrame([(*m, "extra") for m in made], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_archives(frame, path)
    for size in (1 << 20, 3000):
        got = {r["page_id"]: r for r in warc.read_archives(spark, path, range_bytes=size).collect()}
        assert set(got) == {m[0] for m in made}
        for page, _, html in made:
            r, payload = got[page], (html or "").encode()
            assert r["payload_length"] == len(payload)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if page in (1, 2):
                assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 3, None)
            elif page == 4:
                assert (r["record_type"], r["refers_to"]) == ("revisit", 5)
            else:
                assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)


def test_warc_files_are_plain_gzip(spark, tmp_path):
    import glob
    import gzip

    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abcd")], "page_id long, url string, html string"), path)
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert data.count(b"WARC/1.1\r\n") == 2


def test_warc_min_bytes_and_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "a"), min_bytes=3)
    assert {r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()} == {"response"}
    warc.write_archives(frame.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []


def test_warc_magic_inside_a_member():
    import io

    inner = warc.gzip_member(b"WARC-less data that only looks like a member")
    record = warc.record_bytes(1, "u", b"x" * 10 + inner + b"y" * 10, 20 + len(inner), "D", None, False, "2024-01-01T00:00:00Z")
    raw = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner magic shows
    member = raw.compress(record) + raw.flush()
    data = b"\x00junk" + member + warc.gzip_member(record)
    for cut in range(1, len(data), 37):
        found = [list(warc.records_in_range(io.BytesIO(data), a, b)) for a, b in ((0, cut), (cut, len(data)))]
        assert sum(map(len, found)) == 2, cut


# --- personal data -------------------------------------------------------------------------------

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_personal_data_is_fitted_on_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "Boosted", seen.append)
    pii.fit(spark.range(24_000).selectExpr("id AS doc_id", "concat('mail ', id, '@host.org') AS text"))
    assert sum(n for _, n in seen[0].values()) == 24_000 and sum(y for y, _ in seen[0].values()) == 24_000


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(12)
    pieces = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "4111111111111111 2", "+1 (203) 555-8282", "+12", "++1 203 555 8282 9", "é", " ", "\n", ".", "-", "7", "password=e3b3ed3cc8548923d6", "@", "漢"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "9" * 30_000, "a" * 30_000, "1." * 5000, "a.b@c.de " * 300, "+" * 2000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email int")
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [(x["s"], x["k"], x["e"]) for x in got[i]["_base"]]
        assert base == brute_pii(t), t
        assert set(base) <= {(x["s"], x["k"], x["e"]) for x in got[i]["_spans"]}
        assert got[i]["n_email"] == 1
    assert pii.find_personal_data(frame.limit(0)).collect() == []


def test_redaction(spark):
    rows = [(i, f"mail a{i}@b.example or call +1 203 555 82{i:02d} now") for i in range(30)] + [(99, None)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == "mail [email] or call [phone] now" and got[99] is None


def test_boosted_trees_learn():
    vectors = [(k, d, 0, 0, 0, 0, w, 0, 0, 0) for k in (0, 3) for d in range(9) for w in (0, 1)]
    counts = {(fold, v): ((10 if v[6] else 0), 10) for v in vectors for fold in range(3)}
    model = pii.Boosted(counts)
    assert len(model.trees) == pii.ROUNDS
    scores = model.score_of(np.array(vectors))
    assert all((z >= model.thresholds[v[0]]) == bool(v[6]) for z, v in zip(scores, vectors))
    # Kinds without a candidate, or without a calibrated step that is sure enough, accept nothing.
    assert model.thresholds[1] == float("inf")
    noisy = pii.Boosted({(fold, v): (5, 10) for v in vectors for fold in range(3)})
    assert set(noisy.thresholds.values()) == {float("inf")}


def test_isotonic_steps_rise():
    rng = np.random.default_rng(2)
    z, n = rng.integers(0, 12, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    y = np.minimum(n, np.floor(n * np.clip(z / 12 + rng.normal(0, 0.3, 300), 0, 1)))
    steps = pii.isotonic(z, y, n)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(steps, steps[1:]))
    assert abs(sum(y) - sum(p * sum(n[(z >= a) & (z < b)]) for (a, p), b in zip(steps, [s for s, _ in steps[1:]] + [99]))) < 1e-6


def test_looser_spellings_and_secrets_are_found(spark):
    """Weak labels teach formats: what no base pattern matches is found by its likeness to what the labels speak for."""
    rng = random.Random(19)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: rng.choice("abcdef") + digits(2) + "".join(rng.choice("0123456789abcdef") for _ in range(n - 3))

    def card(gap):
        head = "4" + digits(14)
        whole = next(head + c for c in "0123456789" if luhn(head + c))
        return gap.join(whole[i : i + 4] for i in range(0, 16, 4))

    texts = []
    for i in range(400):
        texts.append(f"write to user{i} (at) mail{i % 7} (dot) example (dot) com now, or u{i}@mail{i % 7}.example.com")
        texts.append(f"pay with {card('.')} or {card('')} please, order {digits(14)} of today")
        texts.append(f"ring (2{digits(2)}) 5{digits(2)}-{digits(4)} soon, ratio {digits(2)}.{digits(3)}.{digits(2)}")
        texts.append(rng.choice(['set token = "{}" there', "password={} or so", "the secret key {} of theirs"]).format(hexes(40)))
    extra = [f"lone {hexes(40)} here" for _ in range(4)] + ["version 1.2.3.4 came", "a plain sentence with 12 numbers 345"]
    frame = spark.createDataFrame(list(enumerate(texts + extra)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame).collect()}

    def found(i, kind):
        base = {(x["s"], x["e"]) for x in got[i]["_base"]}
        return [x for x in got[i]["_spans"] if x["k"] == pii.KINDS.index(kind) and (x["s"], x["e"]) not in base]

    assert sum(len(found(i, "email")) for i in range(0, 1600, 4)) >= 390
    assert sum(len(found(i, "card")) for i in range(1, 1600, 4)) >= 300
    assert sum(len(found(i, "phone")) for i in range(2, 1600, 4)) >= 390
    assert sum(len(found(i, "secret")) for i in range(3, 1600, 4)) >= 390
    # No word before these says so; their labels are negative, as few as to leave the others' format sure enough.
    assert sum(len(found(i, "secret")) for i in range(1600, 1604)) == 4
    assert not got[1605]["_spans"]


# --- clashing names and long texts, all operators --------------------------------------------------


def test_extra_columns_with_clashing_names(spark):
    taken = ["_text", "_base", "_loose", "_more0", "_email", "_spans", "_ID", "_hash", "_lost", "_n_words", "_items", "_matches", "_n_lines",
             "_lang_pred", "_score", "_p_toxic", "_is_toxic", "_removed_bytes", "_gone", "a", "b", "rep", "labels", "odd.name", "learn"]
    long = "a passage of the benchmark that has a good many words in it and goes on for a while yet " * 3
    made = [(i, f"{long}mail a{i}@b.example\n{i}", "en", *[f"{c}{i}" for c in taken]) for i in range(6)]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in taken)
    frame = spark.createDataFrame(made, schema)
    benchmark = spark.createDataFrame([(1, long)], "item_id long, text string")
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(frame, known, toxicity.categories())
    results = {
        "lines": line_dedup.drop_repeated_lines(frame),
        "copies": minhash_dedup.drop_near_duplicates(frame),
        "benchmark": decontaminate.find_contamination(frame, benchmark),
        "benchmark in blocks": decontaminate.find_contamination(frame, benchmark.unionAll(benchmark), block_bytes=10),
        "repeats": suffix_dedup.remove_repeats(frame),
        "language": language_id.identify(frame, F.lit(True)),
        "toxicity": toxicity.score(frame, chain),
        "flagged": toxicity.drop_flagged(frame, chain, "low_quality"),
        "data": pii.find_personal_data(frame),
        "redacted": pii.redact(frame),
    }
    for name, result in results.items():
        rows = result.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in taken), name
    assert len(packing.pack(frame).collect()) >= 6
    vectors = frame.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), "*")
    assert exact_search.top_k(vectors, vectors).count() == 30


def test_very_long_texts(spark):
    """Some megabytes in one text, with one word and one line of a megabyte."""
    rng = random.Random(20)
    body = prose(rng, 400_000, 5000)
    passage = "Nothing else in these texts has this passage in it, " * 6
    made = [(1, body), (2, body + " end"), (3, "x" * 1_000_000 + "\n" + passage), (4, passage + body[:3000]), (5, passage), (6, "é" * 300_000)]
    frame = spark.createDataFrame([(*m, "en") for m in made], "doc_id long, text string, lang string")
    near = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame, words=2).collect()}
    assert near[2]["component_id"] == 1 and near[3]["component_id"] == 3
    assert near[1]["n_shingles"] == len({tuple(x) for x in zip(body.split(), body.split()[1:])})
    cut = {r["doc_id"]: r["_removed_bytes"] for r in suffix_dedup.remove_repeats(frame).collect()}
    assert cut[1] == len(body) and cut[2] >= len(body) and cut[5] == len(passage) and cut[6] >= 599_000
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    hit = {r["doc_id"]: r["_n_hit"] for r in decontaminate.with_verdict(decontaminate.find_contamination(frame, items)).collect()}
    assert hit[1] == 0 and hit[3] == hit[5] == len(re.findall("[a-zA-Z]+", passage))
    assert all(r["_lang_pred"] == "en" for r in language_id.identify(frame, F.lit(True)).collect())
    assert {r["doc_id"] for r in line_dedup.drop_repeated_lines(frame, min_docs=1).filter("_n_dropped = 0").collect()} == {1, 2, 4, 5, 6}
    pieces = packing.pack(frame).collect()
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
