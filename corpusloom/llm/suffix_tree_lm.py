"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the tokens of the training texts (words and one end a text) and one class for all
unknown words, the same events as those of the base score. Contexts are the 0 to ``DEPTH`` tokens
before a symbol; the start of a text counts as a token there.

* The root holds single tokens: (c - D) / N for a known one and D V / N for the unknown class,
  with D = n1 / (n1 + 2 n2). (c: the token's count, N: all, V: distinct, n1 and n2: distinct ones
  that occur once and twice.)
* A longer context s is a state if it occurs ``LEAST_COUNT`` times and its next-symbol distribution
  diverges from that of its longest suffix t that is a state: the sum over next symbols w of
  c(s, w) ln(c(s, w) / c(s) / P(w | t)) is at least ``LEAST_GAIN`` nats. (ln P(w | t) goes into this
  test in steps of an eighth, 255 of them at most.)
* P(w | s) = (max(c(s, w) - DISCOUNT, 0) + DISCOUNT d(s) P(w | t)) / c(s), where d(s) is the number of
  different symbols seen after s. It sums to one, unknown class included.

A token is scored in the longest suffix of its history that is a state; ``score`` is the sum of
the log10 probabilities of a text's tokens. ``spelled_score`` adds, for each unknown word, the log10
probability of its spelling among all unknown words (``spelling``), which makes it a distribution
over all texts.

Counting goes by chunk of documents, one level of contexts after the other. A chunk sends its
distinct pairs of a context and a next symbol to the buckets of a hash space and gets their counts
and the states back. A pair whose shorter one nobody has seen, or nobody but this chunk, needs no asking: such ones go
as sums of their context. The count of a context is that of a pair one level below, so a chunk asks
for contexts with ``LEAST_COUNT`` only. Buckets grow in number with the texts; a context that
would fill more than one is dealt out by its next symbols too, and its sums meet in an aggregation.
There is no cap on contexts: what is kept grows with the corpus.

Counts of single tokens, and with them all columns but the scores, are exact: words with equal
hashes are told apart by their bytes. Longer contexts go by hashes of 48 bits within a bucket (some less beyond 65,536 buckets)
and their next symbols by 40 bits within a context, so that two that share one count as one.

Null texts count as empty and have one token, the end. Without any training text every token is
unknown, with probability one, and scores are zero, as base scores are. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, spelling
from .common import crc_of_id, drop_stored, hash_runs, mix64, partitions, stored, stored_by, tidy

DEPTH = 3
LEAST_COUNT = 2
LEAST_GAIN = 4.0
DISCOUNT = 0.75
#: Bytes of text in a chunk, and for each bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: A context is spread over several buckets beyond this count and its fair share of all tokens.
HOT = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = spelling.IS_SPACE
_U = np.uint64
PLACED = mix64(np.arange(1, 257, dtype=np.uint64))
END_HASH, START_HASH = mix64(np.array([11, 12], dtype=np.uint64))
BY_LEVEL = mix64(np.arange(101, 102 + DEPTH, dtype=np.uint64)) | _U(1)
SALT = _U(0xD6E8FEB86659FD93)
LN10 = np.log(10.0)
#: Marks a count of one for which other chunks asked too.
SHARED = 1 << 62


def marked(total: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return total | np.where((total == 1) & (np.bincount(inverse, minlength=len(total)) > 1), SHARED, 0)


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words lower-cased, and the start, size and text of each word."""
    there = ~IS_SPACE[data]
    cut = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    begins = there.copy()
    begins[1:] &= ~there[:-1]
    begins[cut] |= there[cut]
    closes = there.copy()
    closes[:-1] &= ~there[1:]
    closes[cut - 1] |= there[cut - 1]
    at = np.flatnonzero(begins)
    sizes = np.flatnonzero(closes) + 1 - at
    return LOWER[data[there]], np.cumsum(sizes) - sizes, sizes, np.searchsorted(ends, at, side="right") - 1


def hashes(letters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words follow each other without gaps."""
    return hash_runs(letters, PLACED, first, sizes)


def gather(letters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The letters of the given words, one after the other."""
    total = np.cumsum(sizes)
    return letters[np.repeat(first - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]


def mixed(x: np.ndarray) -> np.ndarray:
    """``mix64`` in place, a stretch that stays in the cache at a time."""
    for at in range(0, len(x), 1 << 14):
        part = x[at : at + (1 << 14)]
        part[:] = mix64(part)
    return x


def in_order(x: np.ndarray) -> np.ndarray:
    """``argsort`` of 64-bit values, equal ones in order of place. Sorts the upper bits with the places below them, which is several times faster where these tell the values apart."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    place, free = _U(len(x).bit_length()), _U(64 - int(x.max()).bit_length())
    key = x << free
    key >>= place
    key <<= place
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= (_U(1) << place) - _U(1)
    order = key.view(np.int64)
    own = x[order]
    return order if (own[1:] >= own[:-1]).all() else np.argsort(x, kind="stable")


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different value stands first, in order of value, and which of these each value is."""
    order = in_order(x)
    ranked = x[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(x) else np.zeros(0, dtype=bool)
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def distinct(h: np.ndarray, letters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word for each different one, in order of hash, and which of these each word is; equal hashes are told apart by the bytes."""
    rep, inverse = unique(h)
    stands = rep[inverse]
    parts = range(0, len(h), 1 << 13)  # some words at a time, which stay in the cache
    if (sizes[stands] == sizes).all() and all((letters[first[a] : first[a] + sizes[a : a + (1 << 13)].sum()] == gather(letters, first[stands[a : a + (1 << 13)]], sizes[a : a + (1 << 13)])).all() for a in parts):
        return rep, inverse
    own: dict[tuple[int, bytes], list[int]] = {}
    for i, (value, a, n) in enumerate(zip(h.tolist(), first.tolist(), sizes.tolist(), strict=True)):
        own.setdefault((value, letters[a : a + n].tobytes()), []).append(i)
    order = sorted(own)
    for k, key in enumerate(order):
        inverse[own[key]] = k
    return np.array([own[key][0] for key in order]), inverse


#: A chunk's distinct words in order of hash, with sizes and letters; its texts as numbers of them, the most frequent first, and which word each number is.
_WORDS = "chunk bigint, doc_ids array<bigint>, sizes binary, hash binary, long binary, letters binary, number binary, ids binary"


def _words(batches):
    names = [c.split()[0] for c in _WORDS.split(", ")]
    for c, _ in chunks.rows_of(batches, ()):
        letters, first, sizes, row = words_of(c.data, c.ends)
        h = hashes(letters, first, sizes)
        rep, where = distinct(h, letters, first, sizes)
        order = np.argsort(-np.bincount(where, minlength=len(rep)), kind="stable")
        number = np.empty(len(order), dtype=np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        ids = number[where]
        planes = np.concatenate([(ids >> 16).astype("<u2"), ids.astype("<u2")])
        blobs = (np.bincount(row, minlength=len(c.doc_ids)).astype("<u4"), h[rep], sizes[rep].astype("<u4"), gather(letters, first[rep], sizes[rep]), order.astype("<u4"), planes)
        yield pa.record_batch([pa.array([c.number], pa.int64()), pa.array([c.doc_ids], pa.list_(pa.int64())), *(pa.array([chunks.squeezed(x.tobytes())], pa.binary()) for x in blobs)], names=names)


class Vocabulary:
    """The distinct words of a chunk in order of bucket and hash."""

    def __init__(self, buckets: int, own: bytes, long: bytes, letters: bytes, number: bytes) -> None:
        self.hash = np.frombuffer(chunks.expanded(own), np.uint64)
        self.cut = np.searchsorted(chunks.bucket_of(self.hash, buckets), np.arange(buckets + 1))
        self.sizes = np.frombuffer(chunks.expanded(long), "<u4").astype(np.int64)
        self.letters = np.frombuffer(chunks.expanded(letters), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.number = np.frombuffer(chunks.expanded(number), "<u4")

    def pick(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and letters of some of the words."""
        return self.sizes[some], self.letters[np.repeat(some, self.sizes)]


def numbers(planes: bytes) -> np.ndarray:
    data = np.frombuffer(chunks.expanded(planes), "<u2")
    half = len(data) // 2
    return data[:half].astype(np.int32) << 16 | data[half:]


def rows_together(rows, names: list[str], kinds: list):
    """Rows as Arrow batches of about a megabyte of blobs each; the last column is the blob."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= 1 << 20:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _ask_words(buckets: int, held_out):
    def asked(batches):
        for b in batches:
            for chunk, doc_ids, sizes, own, long, letters, number, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = Vocabulary(buckets, own, long, letters, number)
                training = np.repeat([not held_out(d) for d in doc_ids], np.frombuffer(chunks.expanded(sizes), "<u4"))
                count = np.zeros(len(v.hash), dtype=np.int64)
                count[v.number] = np.bincount(numbers(ids), weights=training, minlength=len(v.hash)).astype(np.int64)
                for k in np.flatnonzero(np.diff(v.cut)).tolist():
                    lo, hi = v.cut[k], v.cut[k + 1]
                    letters = v.letters[v.starts[lo] : v.starts[hi - 1] + v.sizes[hi - 1]]
                    yield k, chunk, int(hi - lo), chunks.squeezed(v.hash[lo:hi].tobytes() + count[lo:hi].tobytes() + v.sizes[lo:hi].astype("<u4").tobytes() + letters.tobytes())

    def run(batches):
        yield from rows_together(asked(batches), ["bucket", "chunk", "n", "blob"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])

    return run


_COUNTED = "chunk bigint, bucket int, blob binary, sizes binary, letters binary, tokens bigint, known bigint, once bigint, twice bigint"


def _count_words(batches):
    """For each bucket a row of its distinct training words and their sums, and a row for each chunk with the counts it asked for."""
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4]

    def row(*values):
        return pa.record_batch([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)

    for bucket, rows in chunks.by_bucket(batches):
        h, count, sizes, letters = [], [], [], []
        for _, _, n, blob in rows:
            data = chunks.expanded(blob)
            h.append(np.frombuffer(data, np.uint64, n))
            count.append(np.frombuffer(data, np.int64, n, 8 * n))
            sizes.append(np.frombuffer(data, "<u4", n, 16 * n).astype(np.int64))
            letters.append(np.frombuffer(data, np.uint8, -1, 20 * n))
        h, count, sizes, letters = (np.concatenate(x) for x in (h, count, sizes, letters))
        first = np.cumsum(sizes) - sizes
        rep, inverse = distinct(h, letters, first, sizes)
        total = np.bincount(inverse, weights=count).astype(np.int64)
        known = rep[total > 0]
        sums = (int(total.sum()), len(known), int((total == 1).sum()), int((total == 2).sum()))
        yield row(None, bucket, None, sizes[known].astype("<u4").tobytes(), gather(letters, first[known], sizes[known]).tobytes(), *sums)
        total, at, told = marked(total, inverse), 0, []
        for _, chunk, n, _ in rows:
            told.append((chunk, bucket, chunks.squeezed(total[inverse[at : at + n]].astype("<u8").tobytes())))
            at += n
        for b in rows_together(told, names[:3], kinds[:3]):
            zero = pa.array(np.zeros(b.num_rows, dtype=np.int64))
            yield pa.record_batch([*b.columns, *(pa.nulls(b.num_rows, pa.binary()) for _ in range(2)), *[zero] * 4], names=names)


class Model:
    """What every task knows: the sums of the root, how unknown words are spelled, and the states that are spread over buckets."""

    def __init__(self, buckets: int, texts: int, tokens: int, known: int, once: int, twice: int) -> None:
        self.buckets, self.texts, self.tokens, self.known = buckets, texts, tokens, known
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.limit = max(HOT, tokens // buckets)
        self.tree: spelling.Tree | None = None
        self.rest = 0.0  # log10 of the spelling tree's probability of all unknown words together
        self.spread: list[tuple[np.ndarray, np.ndarray]] = []

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.known + 1))

    def root(self, count: np.ndarray) -> np.ndarray:
        """ln probability at the root by a token's count."""
        if not self.tokens:
            return np.zeros(np.shape(count))
        return np.log(np.where(count > 0, count - self.discount, self.discount * self.known) / self.tokens)

    def spread_state(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """d(s) of spread contexts that are states, else 0."""
        own, d = self.spread[level - 1]
        if not len(own):
            return np.zeros(len(contexts), dtype=np.int64)
        at = np.minimum(np.searchsorted(own, contexts), len(own) - 1)
        return np.where(own[at] == contexts, d[at], 0)


_TOKENS = "chunk bigint, doc_ids array<bigint>, sizes binary, spelled binary, words binary, ids binary"


def _tokens(model, names):
    """Each chunk's texts as numbers of its distinct words, with their hashes and counts; and the spelling of each text's unknown words."""

    def run(batches):
        for b in batches:
            for chunk, doc_ids, sizes, own, long, letters, number, ids, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, n = model.value, len(doc_ids)
                v = Vocabulary(m.buckets, own, long, letters, number)
                count = np.zeros(len(v.hash), dtype="<u8")
                for a in answers or []:
                    lo, hi = v.cut[a["bucket"]], v.cut[a["bucket"] + 1]
                    count[lo:hi] = np.frombuffer(chunks.expanded(a["blob"]), "<u8", hi - lo)
                spelling_of = np.zeros(len(v.hash))
                new = count == 0
                if m.tokens and new.any():
                    spelling_of[new] = m.tree.scores(*v.pick(new)) - m.rest
                row = np.repeat(np.arange(n), np.frombuffer(chunks.expanded(sizes), "<u4"))
                spelled = np.bincount(row, weights=spelling_of[v.number][numbers(ids)], minlength=n)
                blobs = (spelled, np.concatenate([v.hash[v.number], count[v.number]]))
                cols = [pa.array([chunk], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), *(pa.array([chunks.squeezed(x.tobytes())], pa.binary()) for x in blobs), pa.array([ids], pa.binary())]
                yield pa.record_batch(cols, names=names)

    return run


class Tokens:
    """The texts of a chunk as tokens: a start, the words and an end each; their ln probabilities so far, and how often the next context occurs."""

    def __init__(self, model: Model, held_out, doc_ids, sizes, spelled, words, ids, answers: list) -> None:
        self.model, self.doc_ids, n = model, doc_ids, len(doc_ids)
        self.spelled = np.frombuffer(chunks.expanded(spelled))
        self.training = np.array([not held_out(d) for d in doc_ids], dtype=bool)
        own = np.frombuffer(chunks.expanded(words), np.uint64)
        known = len(own) // 2
        told = np.r_[own[known:].astype(np.int64), model.texts | SHARED, model.texts]
        count = told & (SHARED - 1)
        sizes = np.frombuffer(chunks.expanded(sizes), "<u4").astype(np.int64)
        said = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(n), sizes) + 1
        starts = np.cumsum(sizes + 2) - sizes - 2
        self.ids = np.full(int(sizes.sum()) + 2 * n, known, dtype=np.int32)
        self.ids[said] = numbers(ids)
        self.ids[starts] = known + 1
        self.text = np.repeat(np.arange(n, dtype=np.int32), sizes + 2)
        self.back = np.arange(len(self.ids), dtype=np.int32) - starts.astype(np.int32)[self.text]
        self.hash = np.r_[own[:known], END_HASH, START_HASH]
        self.weight = self.training.astype(np.float64)[self.text]
        self.by_level = [self.hash * by for by in BY_LEVEL]
        self.nearest = mix64(self.by_level[1])  # hash of the context of one token
        self.count = count[self.ids]
        self.ln = model.root(count)[self.ids]
        self.before = np.r_[0, self.count[:-1]]  # count of the context of the next level
        self.so_far = told[self.ids]  # count of the symbol in the context of the level so far
        self.level = 0
        for k in range(1, 1 + max((a["level"] for a in answers or []), default=0)):
            self.ask()
            self.learn([a for a in answers if a["level"] == k])

    def ask(self) -> None:
        """Go one level deeper: the distinct pairs of a context and a next symbol, in order of bucket."""
        self.level += 1
        k = self.level
        self.at = np.flatnonzero((self.back >= k) & (self.before >= LEAST_COUNT))
        context = self.nearest[self.ids[self.at - 1]]
        for j in range(2, k + 1):
            context += self.by_level[j][self.ids[self.at - j]]
            context = mixed(context)
        rep, inverse = unique(mixed(context + self.by_level[0][self.ids[self.at]]))
        pair_at = self.at[rep]
        context, often = context[rep], self.before[pair_at]
        route = context.copy()
        hot = np.flatnonzero(often > self.model.limit)
        route[hot] += (self.hash[self.ids[pair_at[hot]]] >> _U(24)) % ((often[hot] - 1) // self.model.limit + 1).astype(np.uint64) * SALT
        route = mixed(route)
        buckets = self.model.buckets
        free = _U(min(48, 64 - buckets.bit_length()))
        route = chunks.bucket_of(route, buckets).astype(np.uint64) << free | route & ((_U(1) << free) - _U(1))
        order = in_order(route)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair = place[inverse]  # of each asked place
        route, self.pair_at, self.often = route[order], pair_at[order], often[order]
        turns = np.r_[True, route[1:] != route[:-1]] if len(order) else np.zeros(0, dtype=bool)
        self.run = np.cumsum(turns) - 1
        self.begins = np.r_[np.flatnonzero(turns), len(order)]
        heads = self.begins[:-1]
        self.often_run, self.run_route = self.often[heads], route[heads] & ((_U(1) << free) - _U(1))
        self.hot = np.flatnonzero(self.often_run > self.model.limit)
        self.hot_context = context[order[heads[self.hot]]]
        self.cut = np.r_[np.searchsorted(route, np.arange(buckets, dtype=np.uint64) << free), len(route)]
        self.here = np.bincount(self.pair, weights=self.weight[self.at], minlength=len(order)).astype(np.int64)
        shorter = self.so_far[self.pair_at]
        self.known = np.where(shorter == 0, 0, np.where((shorter == 1) & (self.here == 1), 1, -1))  # counts without asking

    def questions(self):
        """``(bucket, pairs, runs, blob)``: contexts with their counts and sums of pairs known already, and the other next symbols with counts in this chunk and ln probabilities in the states so far."""
        ln = np.minimum(np.rint(-8 * self.ln[self.pair_at]), 255).astype(np.uint8)
        words = self.hash[self.ids[self.pair_at]] >> _U(24)
        for k in np.flatnonzero(np.diff(self.cut)).tolist():
            lo, hi = self.cut[k], self.cut[k + 1]
            a, b = np.searchsorted(self.begins, [lo, hi])
            run, ask, one = self.run[lo:hi] - a, self.known[lo:hi] < 0, self.known[lo:hi] == 1
            often = self.often_run[a:b]
            word, rows = words[lo:hi][ask], int(b - a)
            once = np.bincount(run[one], minlength=rows)
            gain = np.bincount(run[one], weights=ln[lo:hi][one] / 8 - np.log(often[run[one]]), minlength=rows)
            step = np.diff(self.run_route[a:b], prepend=_U(0))
            hot = self.hot_context[slice(*np.searchsorted(self.hot, [a, b]))]
            parts = ((step >> _U(32)).astype("<u4"), step.astype("<u4"), often.astype("<u8"), np.bincount(run[ask], minlength=rows).astype("<u4"), once.astype("<u4"), gain.astype("<f4"), (word >> _U(32)).astype(np.uint8), word.astype("<u4"), self.here[lo:hi][ask].astype("<u4"), ln[lo:hi][ask], hot)
            yield k, int(ask.sum()), rows, chunks.squeezed(b"".join(x.tobytes() for x in parts))

    def learn(self, answers: list) -> None:
        """Take the counts and states of this level in."""
        total, symbols = np.maximum(self.known, 0), np.zeros(len(self.begins) - 1, dtype=np.int64)
        for a in answers:
            lo, hi = self.cut[a["bucket"]], self.cut[a["bucket"] + 1]
            x, y = np.searchsorted(self.begins, [lo, hi])
            data = chunks.expanded(a["blob"])
            symbols[x:y] = np.frombuffer(data, "<u8", y - x)
            total[lo + np.flatnonzero(self.known[lo:hi] < 0)] = np.frombuffer(data, "<u8", -1, 8 * (y - x))
        symbols[self.hot] = self.model.spread_state(self.level, self.hot_context)
        # all places of a pair have one probability
        own, d = total & (SHARED - 1), symbols[self.run]
        there = np.flatnonzero(d > 0)
        ln = self.ln[self.pair_at]
        ln[there] = np.log((np.maximum(own[there] - DISCOUNT, 0) + DISCOUNT * d[there] * np.exp(ln[there])) / self.often[there])
        self.ln[self.at] = ln[self.pair]
        told = total[self.pair]
        self.so_far = np.zeros_like(self.before)
        self.so_far[self.at] = told
        self.before = np.zeros_like(self.before)
        inside = len(self.at) - (len(self.at) > 0 and self.at[-1] + 1 == len(self.before))
        self.before[self.at[:inside] + 1] = told[:inside] & (SHARED - 1)


def _read(batches, model, held_out):
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield row[0], Tokens(model.value, held_out, *row[1:])


def _questions(model, held_out):
    def asked(batches):
        for chunk, t in _read(batches, model, held_out):
            t.ask()
            for k, pairs, runs, blob in t.questions():
                yield k, chunk, pairs, runs, blob

    def run(batches):
        yield from rows_together(asked(batches), ["bucket", "chunk", "n", "runs", "blob"], [pa.int32(), *[pa.int64()] * 3, pa.binary()])

    return run


def _states(limit: int):
    """Counts and states of a bucket's pairs, for each chunk that asked; and the sums of contexts that are spread."""

    def run(batches):
        names = ["chunk", "bucket", "blob", "context", "symbols", "gain"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
        for bucket, rows in chunks.by_bucket(batches):
            parts = []
            for _, _, n, runs, blob in rows:
                data = chunks.expanded(blob)
                own, at = [], 0
                for many, kind in [*((runs, x) for x in ("<u4", "<u4", "<u8", "<u4", "<u4", "<f4")), *((n, x) for x in ("u1", "<u4", "<u4", "u1")), (-1, "<u8")]:
                    own.append(np.frombuffer(data, kind, many, at))
                    at += many * np.dtype(kind).itemsize
                own[:2] = [np.cumsum(own[0].astype(np.uint64) << _U(32) | own[1])]
                spread = np.zeros(runs, dtype=np.uint64)
                spread[own[1] > limit] = own.pop()
                parts.append([*own, spread])
            heads, often, long, once, alone, high, low, count, ln, spread = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            run_of = np.repeat(np.arange(len(heads)), long)
            word = high.astype(np.uint64) << _U(32) | low
            # shares of a spread context are one here
            rep, state_of = unique(np.where(often > limit, mix64(spread), heads))
            contexts = spread[rep]
            rep, inverse = unique(mix64(heads[run_of] * BY_LEVEL[1] + word * BY_LEVEL[0]))
            total = np.bincount(inverse, weights=count).astype(np.int64)
            mine = np.flatnonzero(total > 0)
            of = state_of[run_of[rep[mine]]]
            occurs = np.zeros(len(contexts), dtype=np.int64)
            occurs[state_of] = often
            symbols = np.bincount(of, minlength=len(contexts)) + np.bincount(state_of, weights=once, minlength=len(contexts)).astype(np.int64)
            seen = total[mine]
            gain = np.bincount(state_of, weights=alone, minlength=len(contexts)) + np.bincount(of, weights=seen * (np.log(seen / occurs[of]) + ln[rep[mine]] / 8), minlength=len(contexts))
            hot = np.flatnonzero(occurs > limit)
            if len(hot):
                yield pa.record_batch([pa.nulls(len(hot), pa.int64()), pa.array(np.full(len(hot), bucket), pa.int32()), pa.nulls(len(hot), pa.binary()), pa.array(contexts[hot].view(np.int64)), pa.array(symbols[hot], pa.int64()), pa.array(gain[hot])], names=names)
            state = np.where((gain >= LEAST_GAIN) & (occurs <= limit), symbols, 0)
            total, at, start, told = marked(total, inverse), 0, 0, []
            for _, chunk, n, runs, _ in rows:
                blob = chunks.squeezed(state[state_of[start : start + runs]].astype("<u8").tobytes() + total[inverse[at : at + n]].astype("<u8").tobytes())
                told.append((chunk, bucket, blob))
                at, start = at + n, start + runs
            for b in rows_together(told, names[:3], kinds[:3]):
                yield pa.record_batch([*b.columns, *(pa.nulls(b.num_rows, k) for k in kinds[3:])], names=names)

    return run


def _sum(model, held_out):
    def run(batches):
        for _, t in _read(batches, model, held_out):
            m, n, said = model.value, len(t.doc_ids), t.back > 0
            text, count = t.text[said], t.count[said]
            score = np.bincount(text, weights=t.ln[said], minlength=n) / LN10
            cols = [
                pa.array(t.doc_ids, pa.int64()),
                pa.array(~t.training),
                pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                pa.array(np.bincount(text, weights=count > 0, minlength=n).astype(np.int64)),
                pa.array(np.full(n, m.tokens, dtype=np.int64)),
                pa.array(np.bincount(text, weights=m.base(count), minlength=n)),
                pa.array(score),
                pa.array(score + t.spelled),
            ]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"])

    return run


def score(df: DataFrame, held_out=lambda doc_id: crc_of_id(doc_id) % 7 == 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score`` for each row; ``held_out(doc_id)`` tells which rows aren't learned from."""
    spark = df.sparkSession
    own = chunks.build(df, id_col, text_col, size=CHUNK_BYTES)

    def trained(batches):
        for b in batches:
            yield pa.record_batch([pa.array([sum(not held_out(d) for d in ids) for ids in b.column(0).to_pylist()], pa.int64())], names=["n"])

    numbered = stored_by(own.mapInArrow(tidy(_words), _WORDS), "words", "chunk")
    drop_stored(own)
    texts = numbered.select("doc_ids").mapInArrow(tidy(trained), "n bigint").agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), numbered.count() * CHUNK_BYTES // BUCKET_BYTES)

    asked = numbered.mapInArrow(tidy(_ask_words(buckets, held_out)), "bucket int, chunk bigint, n bigint, blob binary")
    counted = stored(chunks.spread(asked, buckets).mapInArrow(tidy(_count_words), _COUNTED), "counted")
    tokens, known, once, twice = (x or 0 for x in counted.agg(*(F.sum(x) for x in ("tokens", "known", "once", "twice"))).first())
    model = Model(buckets, texts, tokens + texts, known + (texts > 0), once + (texts == 1), twice + (texts == 2))
    words = counted.where("chunk is null").select("sizes", "letters")
    model.tree = spelling.learn(words)
    model.rest = float(np.log10(max(1e-12, 1 - spelling.mass(words, model.tree))))
    sent = spark.sparkContext.broadcast(model)
    counts = chunks.answers(counted.where("chunk is not null").select("chunk", "bucket", "blob"), "answers")
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    # every level joins answers to the tokens, which stay where they are
    read = stored_by(numbered.join(counts, "chunk", "left").mapInArrow(tidy(_tokens(sent, names)), _TOKENS), "tokens", "chunk")
    drop_stored(numbered, counted)
    model.tree = None

    answers: list[DataFrame] = []

    def told() -> DataFrame:
        if not answers:
            return read.withColumn("answers", F.expr("cast(null as array<struct<level:int,bucket:int,blob:binary>>)"))
        every = reduce(DataFrame.unionByName, answers)
        return read.join(every.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("level", "bucket", "blob"))).alias("answers")), "chunk", "left")

    for level in range(1, DEPTH + 1):
        sent = spark.sparkContext.broadcast(model)
        asked = told().mapInArrow(tidy(_questions(sent, held_out)), "bucket int, chunk bigint, n bigint, runs bigint, blob binary")
        found = stored(chunks.spread(asked, buckets).mapInArrow(tidy(_states(model.limit)), "chunk bigint, bucket int, blob binary, context bigint, symbols bigint, gain double"), f"level{level}")
        # a context is spread beyond its fair share of all tokens, so at most `buckets` contexts come here
        whole = found.where("chunk is null").groupBy("context").agg(F.sum("symbols").alias("symbols"), F.sum("gain").alias("gain"))
        hot = whole.where(F.col("gain") >= LEAST_GAIN).select("context", "symbols").toPandas()
        keys = hot["context"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        model.spread.append((keys[order], hot["symbols"].to_numpy(dtype=np.int64)[order]))
        answers.append(found.where("chunk is not null").select("chunk", F.lit(level).alias("level"), "bucket", "blob"))

    sent = spark.sparkContext.broadcast(model)
    return told().mapInArrow(tidy(_sum(sent, held_out)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, spelled_score double")
