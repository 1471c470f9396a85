"""Training-data operators against brute force, the original libraries and each other, with the odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from corpusloom.llm import block_labeller, bpe, chat, chunks, decontaminate, html_blocks, idfiles, lcp, page_samples, quality, queries, simhash, spelling, suffix_dedup, suffix_tree_lm

LONG = "the of and " * 4000 + "é" * 3000 + "ababab" * 2000
#: Nulls, empties, white space, very long, repeated rows, ties of id, clashing column names.
ODD = [(1, "Plain text about nothing at all in here.", "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "c"), (5, LONG, "d"), (6, "Plain text about nothing at all in here.", "e"), (6, "Plain text about nothing at all in here.", "e"), (7, "word", "f"), (None, "no id but text, long enough to hold fifty bytes and more of them", "g"), (9, "日本語 テスト \U0001f600 ß", "h")]
NAMES = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, NAMES)
    for name in ("fp", "component_id", "leaks", "removed", "kept", "ids", "part", "tail"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in rows]


# --- 1: fingerprints


def test_lcp_query(spark, docs):
    got = {r.doc_id: r for r in queries.op1_lcp_fingerprints(spark, SF).collect()}
    down = sorted(docs, reverse=True)
    for k, (doc, text) in enumerate(down):
        edit = lcp.edited(text, down[(k + 1) % len(down)][1])
        assert got[doc].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert got[doc].n_chars == len(text)
    long = [r for r in got.values() if r.n_chars > 400]
    assert abs(np.mean([r.near_edited for r in long]) - 0.5) < 0.05
    assert np.mean([r.near_next for r in long]) < 0.05


def test_lcp_shares_interiors_at_any_offset():
    r = np.random.default_rng(1)
    middle = bytes(r.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = lcp.sketches([b"x" * 3 + middle, b"another start, of another length" + middle])[:, None]
    assert lcp.likeness(a, b)[0] > 0.95


def test_lcp_rules(odd, empty):
    rows = lcp.compare_neighbours(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[6].fingerprint
    assert by[2].n_chars == 0 and by[2].near_edited == 1.0 and by[3].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert lcp.compare_neighbours(empty).count() == 0
    assert len(lcp.fingerprints(odd).collect()) == len(ODD)


def test_lcp_single_document(spark):
    r = lcp.compare_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


# --- 2: byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, docs, tiktoken_encoding):
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    for doc, text in docs:
        ids = tiktoken_encoding.encode_ordinary(text)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_long_pretokens(tiktoken_encoding):
    c = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for piece in ("ab" * 5000, "é" * 3000, "a" * 7000, "thththeonn" * 900, "=" * 4096, "\U0001f600" * 500):
        assert bpe.merge(piece.encode(), c.ranks) == tiktoken_encoding.encode_ordinary(piece)


def test_bpe_rules(odd, empty):
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(odd, *args)
    back = bpe.decode(ids, *args)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back.collect()) == sorted((d or 0, t or "") for d, t, _ in ODD)
    assert bpe.round_trip(empty, *args).count() == 0 and bpe.encode(empty, *args).count() == 0


def test_rank_queue():
    r, q, mine = np.random.default_rng(0), bpe.RankQueue(), []
    for rank, place in zip(r.integers(0, 60_000, 3000).tolist(), r.integers(0, 99, 3000).tolist(), strict=True):
        q.push(rank, place)
        mine.append((rank, place))
    assert [q.pop() for _ in mine] == sorted(mine) and q.pop() is None


# --- 3: language model


def suffix_tree_by_hand(texts, held):
    """Scores of a word suffix tree from dictionaries of contexts: (score, score of the root alone) by id."""
    words = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(suffix_tree_lm.LOWER.tobytes())), b"\n"] for d, t in texts}
    train = [w for d, w in words.items() if not held[d]]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    free = once / (once + 2 * twice) if once and twice else 0.5
    after = defaultdict(Counter)
    for ws in train:
        h = (b"", *ws)
        for i in range(1, len(h)):
            for k in range(1, suffix_tree_lm.DEPTH + 1):
                if i >= k:
                    after[h[i - k : i]][h[i]] += 1
    states = {}

    def probability(h, w, most):
        p = (c[w] - free if c[w] else free * v) / n
        for k in range(1, min(most, len(h)) + 1):
            if h[-k:] in states:
                total, seen = states[h[-k:]]
                p = (max(seen[w] - suffix_tree_lm.DISCOUNT, 0) + suffix_tree_lm.DISCOUNT * len(seen) * p) / total
        return p

    for k in range(1, suffix_tree_lm.DEPTH + 1):
        new = {}
        for s, seen in after.items():
            total = sum(seen.values())
            if len(s) == k and total >= suffix_tree_lm.LEAST_COUNT:
                gain = sum(x * (np.log(x / total) - max(-255, np.rint(8 * np.log(probability(s, w, k - 1)))) / 8) for w, x in seen.items())
                if gain >= suffix_tree_lm.LEAST_GAIN:
                    new[s] = total, seen
        states.update(new)
    out = {}
    for d, ws in words.items():
        h = (b"", *ws)
        out[d] = [sum(np.log10(probability(h[max(0, i - most) : i], h[i], most)) for i in range(1, len(h))) for most in (suffix_tree_lm.DEPTH, 0)]
    return out, len(states)


def test_lm_base_and_gain(spark, docs):
    got = {r.doc_id: r for r in queries.op3_suffix_tree_lm(spark, SF).collect()}
    words = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b"\n"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    hand, states = suffix_tree_by_hand(docs, held)
    assert states > 1000
    for d, (own, _) in hand.items():
        assert abs(got[d].score - own) < 1e-6 * max(1, abs(own))
        assert got[d].spelled_score <= got[d].score + 1e-9
    out = [d for d in words if held[d]]
    tokens = sum(len(words[d]) for d in out)
    tree, root, base = (sum(x) / tokens for x in ((got[d].score for d in out), (hand[d][1] for d in out), (got[d].base_score for d in out)))
    assert tree > root + 0.2 and root > base


def test_lm_contexts_in_several_buckets(spark, docs, monkeypatch):
    """Contexts that are spread over buckets give the scores that they give in one."""
    few = docs[:40]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    seen = []
    plain = suffix_tree_lm.Model.__init__

    def small(self, buckets, *sums):
        plain(self, buckets, *sums)
        self.limit = 3
        seen.append(self)

    monkeypatch.setattr(suffix_tree_lm.Model, "__init__", small)
    monkeypatch.setattr(suffix_tree_lm, "partitions", lambda spark: 7)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(df, held_out=lambda d: d % 5 == 0).collect()}
    hand, _ = suffix_tree_by_hand(few, {d: d % 5 == 0 for d, _ in few})
    assert sum(len(keys) for keys, _ in seen[0].spread) > 20
    for d, (own, _) in hand.items():
        assert abs(got[d] - own) < 1e-6 * max(1, abs(own))


def test_lm_words_with_equal_hashes(spark, monkeypatch):
    words = [b"ab", b"cde", b"ab", b"f", b"cde"]
    letters, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    first = np.cumsum(sizes) - sizes
    rep, of = suffix_tree_lm.distinct(np.full(5, 9, dtype=np.uint64), letters, first, sizes)
    assert [words[i] for i in rep[of]] == words and len(rep) == 3
    # two long words that differ by a letter 4096 places on
    a, b = "b" + "a" * 4999, "a" * 4096 + "b" + "a" * 903
    df = spark.createDataFrame([(1, f"{a} {b} {a}"), (3, a), (4, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree_lm.score(df, held_out=lambda d: d == 4).collect()}
    assert got[1].train_tokens == 6 and (got[3].n_known, got[4].n_known) == (2, 2)
    hand, _ = suffix_tree_by_hand([(1, f"{a} {b} {a}"), (3, a), (4, b)], {1: False, 3: False, 4: True})
    assert all(abs(got[d].score - hand[d][0]) < 1e-6 for d in got)
    base = {3: np.log10(4 / 10) + np.log10(3 / 10), 4: np.log10(2 / 10) + np.log10(3 / 10)}
    assert all(abs(got[d].base_score - x) < 1e-9 for d, x in base.items())


def test_lm_spelling_is_a_distribution():
    """A state's next symbols share one unit of probability; symbols go by the longest suffix that is a state."""
    syms, _, place = spelling.symbols(np.array([11]), np.frombuffer(b"abracadabra", np.uint8))
    keys, counts = [], []
    for d in range(spelling.DEPTH + 1):
        key, there = spelling.contexts(syms, place, d)
        k, n = np.unique(key[there] << np.uint64(8) | syms[there].astype(np.uint64) | np.uint64(d) << np.uint64(56), return_counts=True)
        keys.append(k)
        counts.append(n * 100.0)
    tree = spelling.Tree(np.concatenate(keys), np.concatenate(counts))
    assert len(tree.states) > 3
    assert np.allclose((10.0 ** tree.rows.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    # brute force: the longest suffix of the history that is a state
    states = {int(s): i for i, s in enumerate(tree.states)}
    want, history = 0.0, b" "
    for s in b"abracadabra ":
        for d in range(min(spelling.DEPTH, len(history)), -1, -1):
            key = int.from_bytes(history[len(history) - d :], "big") | d << 48
            if key in states:
                want += float(tree.rows[states[key], s])
                break
        history += bytes([s])
    assert abs(tree.scores(np.array([11]), np.frombuffer(b"abracadabra", np.uint8))[0] - (want - tree.opened)) < 1e-4
    # all words of up to two letters and the mass of longer ones: no more than one
    two = np.array([b for b in range(256) if not spelling.IS_SPACE[b]], np.uint8)
    one = (10 ** tree.scores(np.ones(len(two), dtype=int), two)).sum()
    pairs = np.stack(np.meshgrid(two, two), -1).reshape(-1)
    assert 0 < one + (10 ** tree.scores(np.full(len(pairs) // 2, 2), pairs)).sum() <= 1


def test_lm_rules(odd, empty):
    rows = {r.doc_id: r for r in suffix_tree_lm.score(odd).collect()}
    assert rows[2].n_tokens == 1 and rows[4].n_tokens == 1 and rows[7].n_tokens == 2
    assert all(np.isfinite(r.spelled_score) and r.spelled_score <= r.score <= 0 for r in rows.values())
    assert suffix_tree_lm.score(empty).count() == 0
    alone = suffix_tree_lm.score(odd, held_out=lambda d: True).collect()
    assert len(alone) == len(ODD) and {(r.train_tokens, r.base_score, r.score) for r in alone} == {(0, 0.0, 0.0)}


# --- 4: chat


def test_chat_folding(spark):
    log = [(1, 1, "a", "message", "user", "Hi"), (1, 2, "b", "delta", "assistant", "He"), (1, 3, "b", "delta", None, "llo"), (1, 4, "a", "edit", "user", "Hi!"), (1, 5, "b", "regenerate", "assistant", "New"), (1, 6, "b", "delta", None, " one"), (1, 7, "c", "message", "user", "bye"), (1, 8, "c", "delete", None, None), (2, 1, "a", "message", None, None), (None, 1, "a", "message", "user", "x")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, "a"): ("user", "Hi!"), (1, "b"): ("assistant", "New one"), (2, "a"): ("", ""), (None, "a"): ("user", "x")}
    whole = {r.conv_id: r.formatted for r in chat.conversations(chat.render(chat.fold(events))).collect()}
    assert whole[1] == "### user: Hi!</turn>\n### assistant: New one</turn>\n"
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(events.withColumn("kind", F.lit("odd"))).collect()


def test_chat_escapes(spark):
    texts = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\n", "", "a\r\n b", "<|x|> # < \\<"]
    rows = [(k, 0, role, t) for k, t in enumerate(texts) for role in ("assistant",)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.render(chat.fold(chat.log_of_turns(d)))
    for r in turns.collect():
        assert chat.parse(r.formatted) == [("assistant", texts[r.conv_id], r.loss_start, r.loss_end)]
    for r in chat.read_back(turns).collect():
        assert r.loss_sha256 == hashlib.sha256(texts[r.conv_id].encode()).hexdigest()


def test_chat_query_is_its_sql(spark, duck):
    from helpers import assert_same

    assert_same(queries.op4_chat_format(spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL["op4_chat_format"]).df())


def test_chat_rules(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, None), (None, 1, "assistant", "x" * 100_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.log_of_turns(d)))).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 100_000
    assert chat.read_back(chat.render(chat.fold(chat.log_of_turns(d.limit(0))))).count() == 0


# --- 5: suffix-array dedup


def brute_dedup(rows, length=50):
    first: dict[bytes, int] = {}
    top = 1 << 62
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, top), top if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (top if d is None else d):
                gone[s : s + length] = True
        out.append((d, len(b), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_dedup_query(spark, docs):
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, SF).collect()}
    for d, size, kept in brute_dedup(docs):
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (size, size - len(kept), hashlib.sha256(kept).hexdigest())


def test_dedup_rules(odd, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(odd, rest=("score",)).collect())
    assert got == sorted((d or 0, n, k) for d, n, k in brute_dedup([(d, t) for d, t, _ in ODD]))
    assert suffix_dedup.dedup(empty).count() == 0


def test_dedup_small_alphabet_and_levels():
    """Many near matches, and batches small enough for several levels to merge."""
    r = np.random.default_rng(3)
    pool = [bytes(r.integers(97, 100, 70, dtype=np.uint8)) for _ in range(8)]
    rows = [(d, b"".join(pool[k][int(a) : int(a) + 60] for k, a in zip(r.integers(0, 8, 4), r.integers(0, 10, 4), strict=True)).decode()) for d in range(60)]
    parts = []
    for d, t in rows:
        at, h = suffix_dedup.anchors_of(np.frombuffer(t.encode(), np.uint8))
        parts.append((d, t.encode(), at, h))
    hashes, records, owners, spots = [], [], [], []
    for d, b, at, h in parts:
        for a, x in zip(at.tolist(), h.tolist(), strict=True):
            left, right = b[max(0, a - suffix_dedup.BEFORE) : a], b[a : a + suffix_dedup.AFTER]
            rec = left.rjust(suffix_dedup.BEFORE, b"\0") + right.ljust(suffix_dedup.AFTER, b"\0") + bytes([len(left), len(right)])
            hashes.append(x)
            records.append(np.frombuffer(rec, np.uint8))
            owners.append(d)
            spots.append(a)
    args = np.array(hashes, dtype=np.uint64), np.array(records), np.array(owners, dtype=np.int64)
    for batch, most in ((7, 1 << 17), (7, 40), (1 << 18, 1 << 18), (1 << 16, 1)):
        # a batch may not part the entries of one document
        order = np.argsort(args[2], kind="stable")
        found = suffix_dedup.masks(*(x[order] for x in args), batch=batch, most=most)
        gone = {d: np.zeros(len(b), dtype=bool) for d, b, _, _ in parts}
        for k, m in zip(order.tolist(), found.tolist(), strict=True):
            for delta in range(31):
                if m >> delta & 1:
                    gone[owners[k]][spots[k] - delta : spots[k] - delta + 50] = True
        for d, _, kept in brute_dedup(rows):
            b = parts[d][1]
            assert bytes(np.frombuffer(b, np.uint8)[~gone[d]]) == kept


def test_dedup_levels():
    """Equal-sized levels merge geometrically, and matches are found in all of them."""
    r = np.random.default_rng(2)
    records = np.zeros((64, suffix_dedup.RECORD), dtype=np.uint8)
    records[:, : suffix_dedup.BEFORE + suffix_dedup.AFTER] = r.integers(97, 123, (64, suffix_dedup.BEFORE + suffix_dedup.AFTER))
    records[:, -2], records[:, -1] = suffix_dedup.BEFORE, suffix_dedup.AFTER
    records[48:] = records[:48:3]
    index, sizes, found = suffix_dedup.LogIndex(), [], []
    for at in range(0, 64, 4):
        found.append(index.add(np.full(4, 7, dtype=np.uint64), records[at : at + 4], np.arange(at, at + 4)))
        sizes.append([len(x) for x in index.levels])
    assert sizes[0] == [4] and sizes[1] == [8] and sizes[2] == [8, 4] and sizes[6] == [16, 8, 4] and sizes[15] == [64]
    every = suffix_dedup.valid(records)
    assert (np.concatenate(found) == np.where(np.arange(64) < 48, 0, every)).all()


def test_dedup_of_long_repetitive_texts(spark):
    """Runs of one byte and of a short period: every place is an anchor, and memory stays near that of the anchors."""
    import tracemalloc

    size = 1 << 21
    texts = [(1, "a" * 400 + "ab" * 300), (2, "a" * size), (3, "x" * 60 + "ab" * 1000), (4, "b" * 49), (5, "b" * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(df).collect()}
    assert got == {1: (1000, texts[0][1].encode()), 2: (size, b""), 3: (2060, b"x" * 60), 4: (49, b"b" * 49), 5: (3000, b"b" * 3000)}
    data = np.full(size, 97, dtype=np.uint8)

    class One:
        doc_ids, ends, order_ids = [1], np.array([0, size]), staticmethod(lambda: np.array([1]))

    One.data = data
    tracemalloc.start()
    a = suffix_dedup.Anchors(One)
    left, right = suffix_dedup.reach(One, a)
    _, first = suffix_dedup.classes(One, a, One.order_ids()[a.row], left, right)
    assert len(first) < 100 and tracemalloc.get_traced_memory()[1] < 150 * size
    tracemalloc.stop()


# --- 6: id files


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, top in ((1, 0), (2, 5), (500, 3), (1000, 10**6), (3000, 10**9)):
        v = np.sort(r.integers(0, top + 1, n))
        v[0] = 0
        back, size = idfiles.Boundaries.read(memoryview(idfiles.Boundaries.of(v).to_bytes()))
        assert (back.all() == v).all() and [back.select(i) for i in range(n)] == v.tolist()
        assert size < 8 * n + 64


def test_id_files_are_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: r for r in queries.op6_id_files(spark, SF).collect()}
    for d, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_id_files_pieces():
    w = idfiles.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "  a  b ", "It's 's x's don't ß İI Σς ΑΣ ΑΣ. Å fi \x1c\x85 x y", "a\nb\tc  d\r\n", "日本語 テスト 123 4५6", "É é H̱ ẖ Å.", "foo.,bar foo.'s it.'ll", "ǅ ŉ ﬁ Ω K", "A.B.C, (D)-E_F!", "x" * 5000, "'s't A's,'t"] * 3
    assert w.encode(texts) == [w.one(t) for t in texts]


def test_id_files_added_tokens(spark):
    """Added tokens written in a text are what the library makes of them, and later documents start after them."""
    w = idfiles.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["see a<|endoftext|> b", "plain text", "a <|ENDOFTEXT|> b", "x<|startoftext|>Y, z", "<|endoftext|><|endoftext|>", "", "<|endoftext |>"]
    assert w.one(texts[0]) == np.array([862, 320, 49407, 321], dtype=w.kind).tobytes()
    assert w.encode(texts) == [w.one(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted((r.doc_id, r.start, r.n_tokens) for r in idfiles.read(idfiles.write(docs, public_tokenizers.path("word_bpe_49k.json"), 1)).collect())
    sizes = [len(w.one(t)) // w.id_bytes + 1 for t in texts]
    assert rows == [(k, sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def test_id_files_rules(odd, empty):
    blocks = idfiles.write(odd, public_tokenizers.path("word_bpe_49k.json"), 1)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in idfiles.read(blocks).collect())
    assert [d for _, d, _ in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 9]
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert idfiles.read(idfiles.write(empty, public_tokenizers.path("word_bpe_49k.json"), 1)).count() == 0


# --- 7: SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_query(spark, docs):
    got = {r.doc_id: r for r in queries.op7_simhash_components(spark, SF).collect()}
    fps = np.array([plain_fingerprint(t) for _, t in docs], dtype=np.uint64)
    for (d, _), fp, comp in zip(docs, fps.tolist(), plain_components([d for d, _ in docs], fps), strict=True):
        assert (got[d].fingerprint, got[d].component_id) == (f"{fp:016x}", comp)


def test_golay_keys_find_every_link():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for flips in range(5):
        b = a.copy()
        for i in range(len(b)):
            for bit in r.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        (ra, ka), (rb, kb) = simhash.bucket_keys(a), simhash.bucket_keys(b)
        assert len(np.intersect1d(ra.astype(np.int64) << 32 | ka, rb.astype(np.int64) << 32 | kb) >> 32) and set((np.intersect1d(ra.astype(np.int64) << 32 | ka, rb.astype(np.int64) << 32 | kb) >> 32).tolist()) == set(range(4000))


def test_simhash_chains_and_large_groups(spark):
    """Chains of links, a large dense group, and buckets beyond the small ones."""
    r = np.random.default_rng(6)
    base = int(r.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 400:
        fps.add(base ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 4)), replace=False)))
    chain = [int(r.integers(0, 1 << 62))]
    for k in range(30):
        chain.append(chain[-1] ^ (0b1111 << (2 * k)))
    all_fps = np.array([*sorted(fps), *chain], dtype=np.uint64)
    key = np.zeros(len(all_fps), dtype=np.int64)
    a, b = simhash.forest(key, all_fps)
    nodes, root = simhash.roots(a, b)
    want = plain_components(list(range(len(all_fps))), all_fps)
    assert [dict(zip(nodes.tolist(), root.tolist(), strict=True)).get(i, i) for i in range(len(all_fps))] == want
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100), (300, 200)], "a long, b long")
    assert {r.a: r.root for r in simhash.components(edges).collect()} == {**{k: 0 for k in range(1, 61)}, 200: 100, 300: 100}


def test_simhash_rules(odd, empty):
    rows = simhash.near_copies(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == 0 and {by[k].component_id for k in (2, 3, 4)} == {2} and by[6].component_id == 1
    assert simhash.near_copies(empty).count() == 0


# --- 8: HTML


def test_blocks_of_broken_pages():
    page = "<html><script>var t='</p>';</script><p><b>One.<br><p>Two&nbsp;&amp;\n <i>three</i><ul><li>a<li><a href=x>b</a></ul><!-- <p>no</p> --><div>4 &lt; 5"
    assert [b.text for b in html_blocks.blocks(page)] == ["One.", "Two & three", "a", "b", "4 < 5"]
    assert [b.linked for b in html_blocks.blocks(page)][2:4] == [0.0, 1.0]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<style>unclosed") == [] and [b.text for b in html_blocks.blocks("a < b <")] == ["a < b <"]


def test_labeller_on_unseen_pages():
    net = block_labeller.shipped()
    pages, labels = block_labeller.samples(range(500_000, 500_200))
    got = net.scores(block_labeller.Features(pages)) > 0
    assert (got == np.array([x for own in labels for x in own])).mean() > 0.985
    assert len(page_samples.Maker(1).labels) > 0


def test_labeller_training_gives_the_same_again():
    a, b = (block_labeller.trained(n=64, epochs=1) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a.weights, b.weights, strict=True))
    assert [w.shape for w in block_labeller.shipped().weights] == [w.shape for w in a.weights]


def test_labeller_reads_context_not_names(spark):
    """Pages whose elements have other names, other tags, or neither, give the same texts."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = ["\n\n".join(b.text for b in html_blocks.blocks(h[h.index("<article>") + 9 : h.index("</article>")])) for h in pages]
    plain = lambda h: re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\\b", r"<\\1div", h)
    bare = lambda h: re.sub(r' (?:class|id)="[^"]*"', "", h)
    odd = lambda h: re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="q{zlib.crc32(m[2].encode())}x"', h)
    boxed = lambda h: h.replace("<article>", '<div class="zorblax">').replace("</article>", "</div>")
    for change in (odd, plain, bare, boxed, lambda h: odd(plain(h)), lambda h: bare(plain(h))):
        got = block_labeller.main_texts(block_labeller.shipped(), [change(h) for h in pages])
        assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.9


def test_blocks_of_deep_pages():
    """Unclosed elements cost time and memory in proportion to the page."""
    import tracemalloc

    tracemalloc.start()
    own = html_blocks.blocks("<div><p>" + "<b>some text<span><p>more</i>" * 40_000)
    assert len(own) == 40_001 and all(len(b.path) <= html_blocks.DEEPEST for b in own)
    block_labeller.Features([own])
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_blocks_around_drawings():
    page = "<p>a<svg viewBox='x'/>b</p><p>c<svg><text>no</text></svg>d</p><p>e<object data=x>f</p><p>g</p>"
    assert [b.text for b in html_blocks.blocks(page)] == ["a b", "c d", "e f", "g"]


def test_labeller_gradient():
    net = block_labeller.Labeller()
    pages, labels = block_labeller.samples(range(3))
    f, y = block_labeller.Features(pages), np.array([x for own in labels for x in own], dtype=np.float32)
    g = net.gradients(f, y)
    loss = lambda: float(np.mean(np.logaddexp(0, net.scores(f).astype(np.float64)) - y * net.scores(f)))
    for k in (2, 3, 4, 6):
        w = net.weights[k]
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 0.01
        up = loss()
        w[at] = old - 0.01
        down = loss()
        w[at] = old
        assert abs((up - down) / 0.02 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4


def test_main_text_of_pages(spark):
    for r in queries.op8_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [b.text for b in html_blocks.blocks(inner)]
        assert r.text == "\n\n".join(parts) and r.n_chars == len(r.text)


def test_main_text_rules(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><ul><li><a href=/>Home</a></ul></nav>"), (4, "u", "<article>" + "<p>Some words of it.</p>" * 3000 + "</article>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in block_labeller.extract(d).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4].count("Some words of it.") == 3000
    assert block_labeller.extract(d.limit(0)).count() == 0


# --- 9: decontamination


def test_planted_leaks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()][:8]
    r = np.random.default_rng(4)
    rows, want = [], set()
    clean = [t for _, t in docs if t][:8]
    for k, (item, text) in enumerate(items):
        words = text.split()
        for kind in range(3):
            w = list(words)
            if kind == 1:
                w = [("replaced" if i % 6 == 3 else x) for i, x in enumerate(w)]
            if kind == 2:
                w = [x for i, x in enumerate(w) if i % 8 != 4]
            rows.append((k * 10 + kind, f"{clean[k]} {' '.join(w).upper() if kind == 0 else ' '.join(w)} {clean[-k - 1]}"))
            if len(words) >= 15:
                want.add((k * 10 + kind, item))
        r.shuffle(words)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.leak.item_id) for x in decontaminate.leaks(d, bench).select("doc_id", F.explode("leaks").alias("leak")).collect()}
    assert want <= got


def test_leaks_are_what_contains_an_item(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {(d, i) for d, t in docs for i, b in bench if flat(b) in flat(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, SF).collect()}
    assert want <= got and len(got - want) <= 0.02 * max(1, len(want)) + 1


def test_alignment():
    one = np.arange(1, 21, dtype=np.uint64)
    assert decontaminate.align(one, np.r_[np.uint64(99), one, np.uint64(98)].astype(np.uint64)) == (40, 20, 20, 1, 21)
    edited = one.copy()
    edited[10] = 77
    assert decontaminate.align(one, edited)[:3] == (37, 19, 10)


def align_by_hand(item, words):
    """Best Smith-Waterman score and longest run of matches from the whole table."""
    best = longest = 0
    above, run = [0] * (len(words) + 1), [0] * (len(words) + 1)
    for w in item:
        now, streak = [0], [0]
        for j, x in enumerate(words):
            now.append(max(0, above[j] + (2 if x == w else -1), above[j + 1] - 1, now[j] - 1))
            streak.append(run[j] + 1 if x == w else 0)
        above, run = now, streak
        best, longest = max(best, *now), max(longest, *streak)
    return best, longest


def test_alignment_by_hand():
    r = np.random.default_rng(5)
    for _ in range(60):
        item, words = r.integers(0, 6, r.integers(1, 12)), r.integers(0, 6, r.integers(1, 40))
        score, matched, run, start, end = decontaminate.align(item.astype(np.uint64), words.astype(np.uint64))
        assert (score, run) == align_by_hand(item.tolist(), words.tolist())
        assert matched <= len(item) and 0 <= start <= end <= len(words)
        assert align_by_hand(item.tolist(), words[start:end].tolist())[0] == score


def test_leaks_against_all_pairs(spark, docs):
    """Items of all lengths and edits against all documents: every pair whose alignment reaches the limit is found."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    r = np.random.default_rng(8)
    rows = [(d, " ".join(t.split()[:300])) for d, t in docs[:60]]
    for k in range(120):
        w = bench[k % len(bench)][1].split()
        w = [x if r.random() > (k % 7) / 14 else f"other{r.integers(99)}" for x in w if r.random() > (k % 5) / 20]
        rows.append((1000 + k, f"{rows[k % 60][1][:200]} {' '.join(w)} {rows[k % 50][1][:200]}"))
    hashed = lambda t: decontaminate.word_hashes([t])[0]
    items = [(i, hashed(t)) for i, t in bench]
    want = set()
    for d, t in rows:
        words = hashed(t)
        for i, own in items:
            if np.isin(own, words).sum() >= min(decontaminate.RUN, len(own) / 2):
                score, run = align_by_hand(own.tolist(), words.tolist())
                if score >= decontaminate.COVERED * 2 * len(own) or run >= decontaminate.RUN:
                    want.add((d, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.leak.item_id) for x in decontaminate.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", F.explode("leaks").alias("leak")).collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.97 * len(want)


def test_leaks_of_all_scripts(spark):
    item = "what is the capital of the small island of wherever and who was its first mayor"
    bench = [(1, item), (2, "日本の首都はどこですか東京です"), (3, "two words"), (4, "—  …"), (5, "ОДИН два три четыре пять шесть")]
    rows = [(k, f"well {sep.join(item.split())} done") for k, sep in enumerate(("\u00a0", "\u3000", "—", " – ", "...", "\u200b "))]
    rows += [(10, "前文です。日本の首都はどこですか、東京です。後文"), (11, "Two  WORDS, in a row"), (12, "words two"), (13, "один ДВА три четыре пять шесть"), (14, "日本のどこか"), (15, None), (16, f"{item} " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.leak.item_id) for x in decontaminate.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", F.explode("leaks").alias("leak")).collect()}
    assert got == {*((k, 1) for k in range(6)), (10, 2), (11, 3), (13, 5), (16, 1)}


def test_leak_rules(spark, odd, empty):
    bench = spark.createDataFrame([(1, "nothing at all in here"), (2, None), (3, "word"), (1, "nothing at all in here")], "item_id long, text string")
    rows = {(r.doc_id, len(r.leaks)) for r in decontaminate.leaks(odd, bench).collect()}
    assert (1, 2) in rows and (2, 0) in rows and (7, 1) in rows
    assert decontaminate.leaks(empty, bench).count() == 0
    assert {len(r.leaks) for r in decontaminate.leaks(odd, bench.limit(0)).collect()} == {0}


# --- 10: quality


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_covers_whole_texts():
    texts = [bytes(np.random.default_rng(k).integers(97, 123, n, dtype=np.uint8)) for k, n in enumerate((0, 1, 511, 512, 513, 2000, 100_001))]
    own, counts = quality.chunks(texts)
    at = np.cumsum(counts) - counts
    for t, a, n in zip(texts, at.tolist(), counts.tolist(), strict=True):
        got = bytearray()
        for k in range(n):
            got[k * quality.STEP :] = own[a + k].tobytes()
        assert bytes(got[: len(t)]) == t and not any(got[len(t) :])


def test_quality_gradient():
    r = np.random.default_rng(0)
    texts, y = [bytes(r.integers(97, 110, 700, dtype=np.uint8)) for _ in range(4)], np.array([0, 1, 1, 0], dtype=np.float32)
    net = quality.ConvNet()
    g = net.step(texts, y)
    loss = lambda: float(-np.mean(np.log(np.where(y == 1, net.scores(texts), 1 - net.scores(texts)))))
    for k in (1, 2, 3, 4):
        w = net.weights[k]
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 0.002
        up = loss()
        w[at] = old - 0.002
        down = loss()
        w[at] = old
        assert abs((up - down) / 0.004 - g[k][at]) < 0.1 * abs(g[k][at]) + 1e-3


def test_quality_step_on_a_long_text():
    import tracemalloc

    size = 4 << 20
    text = bytes(np.random.default_rng(1).integers(97, 122, size, dtype=np.uint8))
    tracemalloc.start()
    grads = quality.ConvNet().step([text], np.ones(1, dtype=np.float32))
    assert all(np.isfinite(g).all() for g in grads) and tracemalloc.get_traced_memory()[1] < 20 * size
    tracemalloc.stop()


def test_quality_rules(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (2, None), (None, 1), (7, 1)], "doc_id long, quality int")
    net = quality.fit(odd, labels)
    rows = quality.scored(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(empty, net).count() == 0


# --- chunks


def test_chunks_hold_every_row(odd):
    for size in (10, 1 << 23):
        seen = []
        for b in chunks.build(odd, rest=("score",), size=size).toArrow().to_batches():
            for c, _ in chunks.rows_of([b], ()):
                names = c.rest().column("score").to_pylist()
                seen += [(d, c.text(i).decode(), names[i]) for i, d in enumerate(c.doc_ids)]
        assert sorted(map(str, seen)) == sorted(str((d, t or "", s)) for d, t, s in ODD)


def test_a_table_dealt_by_key_stays_in_joins(spark):
    """The texts of op3 are joined with answers at every level; only the answers move."""
    from pyspark.sql import functions as F

    from corpusloom.llm import common

    rows = spark.range(50).select(F.col("id").alias("chunk"), F.array("id").alias("own"))
    table = common.stored_by(rows, "dealt", "chunk")
    joined = table.join(rows.select("chunk", F.lit(1).alias("n")).hint("merge"), "chunk", "left")
    assert joined._jdf.queryExecution().sparkPlan().toString().count("Scan parquet") == 1
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.chunk for r in joined.where("n = 1 and own[0] = chunk").collect()) == list(range(50))
    common.drop_stored(table)


def test_lm_sorts_by_upper_bits(rng=np.random.default_rng(5)):
    """The fast order is the stable one, also where the upper bits don't tell values apart."""
    close = np.uint64(1 << 63) + rng.integers(0, 300, 5000).astype(np.uint64)
    small, wide = rng.integers(0, 40, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2)
    for x in (close, small, wide, np.repeat(wide, 3)[::-1], np.zeros(4, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.array([2**64 - 1, 0, 2**64 - 1], dtype=np.uint64)):
        assert suffix_tree_lm.in_order(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_lm_asks_for_all_buckets_in_one_batch():
    """A small chunk's questions to 40 buckets come together, not as a batch for each; its texts are taken apart once, and words come back whole."""
    texts = [" ".join(f"W{i}" for i in range(300)), "", "w1 w2  w1"]
    ends = np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes()
    row = (7, [1, 2, 3], ends, chunks.squeezed("".join(texts).encode()), b"")
    kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3)
    (words,) = suffix_tree_lm._words([pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=list(chunks.COLUMNS))])
    (asked,) = suffix_tree_lm._ask_words(40, lambda d: d == 3)([words])
    assert asked.num_rows > 30 and asked.column(0).to_pylist() == sorted(asked.column(0).to_pylist())
    count = {}
    for _, _, n, blob in zip(*(c.to_pylist() for c in asked.columns), strict=True):
        data = chunks.expanded(blob)
        sizes, letters = np.frombuffer(data, "<u4", n, 16 * n), data[20 * n :]
        cut = np.cumsum([0, *sizes])
        count |= {letters[a:b].decode(): c for a, b, c in zip(cut[:-1], cut[1:], np.frombuffer(data, np.int64, n, 8 * n).tolist(), strict=True)}
    assert count == {f"w{i}": 1 for i in range(300)}  # w1 and w2 of the held-out text don't count
