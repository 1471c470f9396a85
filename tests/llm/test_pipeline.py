"""The pipeline: every stage against its operator's own decisions."""

import itertools
import re

import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F

from corpusloom.llm import common, queries


def smallest_of_similar(texts):
    """The smallest id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, from all pairs."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in sets if root[d] == d}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            assert kept[name] == {r.doc_id for r in queries.op10_quality(spark, SF).where("predicted = 1").collect()}
        if name == "near_dedup":
            assert kept[name] == smallest_of_similar({r.doc_id: r.text or "" for r in docs.collect()})
        docs = out
    assert kept["repeats"] <= kept["near_dedup"] and kept["decontaminate"] < kept["repeats"]
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == kept["decontaminate"]


def test_odd_rows(spark):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A plain sentence that stays as it is, and is long enough to be one.", "en", "s", 67), (3, "A plain sentence that stays as it is, and is long enough to be one.", "en", "s", 67), (None, "No id here but text.", "en", "s", 20)]
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "odd")
    assert 3 in {r.doc_id for r in docs.collect()}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.stored(stage(spark, empty, SF), "empty")
    assert empty.count() == 0


def test_near_dedup_takes_similar_shingles(spark):
    """Pairs of a similarity of 0.8 and more go, however many bits of a fingerprint differ; others stay."""
    import random

    from corpusloom.llm import near_texts, simhash

    pick, texts = random.Random(5), {}
    for k in range(60):
        words = [f"w{pick.randrange(5000)}" for _ in range(300)]
        texts[2 * k] = " ".join(words)
        for at in range(7 + k % 20, 300, 300 // (1 + k % 8)):
            words[at] = "other"
        texts[2 * k + 1] = " ".join(words)
    sets = {d: set(near_texts.shingles(t).tolist()) for d, t in texts.items()}
    far = lambda a, b: (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > simhash.MOST_BITS
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(far(a, b) for a, b in links) > 10 and len(links) < 60
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(texts) - {b for _, b in links}


def test_near_texts_against_all_pairs(spark):
    """Chains, copies, empty and null texts and null ids on the test table: components as all pairs give them."""
    import itertools

    from corpusloom.llm import near_texts

    odd = [(-1, None), (-2, " "), (-3, "one two"), (-4, "ONE  two"), (None, "one two"), (None, "only here"), (-5, "a b c d e f g h i j k l"), (-5, "z y x w v u t s r q")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, set(near_texts.shingles(r.text).tolist())) for r in docs.collect()]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (a, x), (b, y) in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if len(x & y) >= 0.8 * len(x | y) and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = near_texts.near_texts(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(d, find(d)) for d in root}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [-4, None]
    assert len(got) == len(rows)


def test_encode_hands_on_ids_and_text(spark):
    import public_tokenizers
    import tiktoken.load

    from corpusloom.llm import bpe

    rows = [(1, "Plain words, and 12 numbers.", "en", "s", 28), (1, "über 東京 \U0001f600\n\n  x", "en", "s", 15), (None, "no id", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encode(spark, docs, SF).collect()
    assert [(r.doc_id, r.text) for r in got] == [(d, t or "") for d, t, *_ in rows]
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [r.ids for r in got] == [r.ids for r in ids]
    vocabulary = {n: b for b, n in tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).items()}
    assert all(b"".join(vocabulary[i] for i in r.ids).decode() == r.text for r in got)


def test_rows_that_share_an_id_lose_no_text(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, "another text altogether, of its own", "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted([(0, text), (1, text), (2, text), (2, "another text altogether, of its own")])


def test_near_dedup_takes_op7s_operator(spark, monkeypatch):
    """The stage's groups come from SimHash and Golay keys, by five-word shingles."""
    from corpusloom.llm import simhash

    asked, real = [], simhash.near_copies
    monkeypatch.setattr(simhash, "near_copies", lambda df, *args, **named: asked.append(named) or real(df, *args, **named))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert asked == [{"n": 5}]
    assert kept == smallest_of_similar({r.doc_id: r.text or "" for r in docs.collect()})


def test_near_texts_hands_on_forests():
    """A bucket of many near texts hands on fewer links than it has members, and the components of all its pairs."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm import near_texts

    pick = np.random.default_rng(7)
    base = pick.integers(0, 1 << 60, 80)
    sets = [np.unique(np.where(pick.random(80) < pick.choice([0.03, 0.08, 0.3]), pick.integers(0, 1 << 60, 80), base)).astype(np.uint64) for _ in range(120)]
    pairs = [(i, j) for i, j in itertools.combinations(range(120), 2) if near_texts.alike(sets[i], sets[j])]
    rows = pa.record_batch([pa.array([5] * 120), pa.array(range(120)), pa.array(range(120)), pa.array([s.tobytes() for s in sets])], names=["piece", "node", "label", "own"])
    found = [(a, b) for out in near_texts.links(iter([rows.slice(0, 50), rows.slice(50)])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert set(found) <= set(pairs) and len(found) < 120 < len(pairs)

    def groups(edges):
        label = list(range(120))
        for a, b in edges:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    assert groups(found) == groups(pairs) and len(set(groups(pairs))) > 10


def test_near_texts_cuts_large_buckets(monkeypatch):
    """Every two members of a bucket with different labels meet in a piece, and no piece is larger than two blocks."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm import near_texts

    monkeypatch.setattr(near_texts, "BLOCK_ROWS", 8)
    pick = np.random.default_rng(8)
    bucket, label, node = np.sort(mix(pick, 3, 200)), pick.integers(0, 20, 200), np.arange(200)
    rows = pa.record_batch([pa.array(c) for c in (bucket, label, node, np.ones(200, dtype=np.int64))], names=["bucket", "label", "node", "size"])
    met = {}
    for out in near_texts.pieces([rows]):
        for piece, n, own in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert own == label[n]
            met.setdefault(piece, []).append(n)
    assert max(map(len, met.values())) <= 16 and len(met) > 10
    together = {(a, b) for own in met.values() for a, b in itertools.combinations(sorted(own), 2)}
    assert together >= {(a, b) for a, b in itertools.combinations(range(200), 2) if bucket[a] == bucket[b] and label[a] != label[b]}


def mix(pick, kinds, n):
    """``n`` values of so many random longs."""
    return pick.integers(-(1 << 62), 1 << 62, kinds)[pick.integers(0, kinds, n)]
