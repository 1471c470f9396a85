"""How unknown words are spelled: a probabilistic suffix tree over bytes.

It learns each distinct training word once, as its letters and a closing space. Contexts are up to
``DEPTH`` bytes of the word, the space before it included. A context stays if its share of all
symbols is at least ``LEAST_SHARE`` and its next-symbol distribution diverges from that of its
suffix by at least ``LEAST_GAIN`` nats in all (its count times the Kullback-Leibler divergence).
Each distribution is smoothed with that of the suffix, down to a uniform root; a symbol is scored
in the longest suffix of its history that is a state. The probabilities of all words sum to one.

At most ``1 / LEAST_SHARE`` contexts of each length can reach the share, whatever the corpus's
size, so the tree can be sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, tidy

DEPTH = 6
LEAST_SHARE = 1e-4
LEAST_GAIN = 20.0
#: Weight of the suffix's distribution, in symbols, for each distinct symbol seen after a context.
SMOOTH = 1.0
SPACE = 32  # the symbol after a word
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Letters, and the space that closes a word.
BASE = (~IS_SPACE | (np.arange(256) == SPACE)) / float((~IS_SPACE).sum() + 1)
_U = np.uint64


def symbols(sizes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word as its letters and a closing space: the symbols, the word and the place of each."""
    long = sizes + 1
    first = np.cumsum(long) - long
    out = np.full(int(long.sum()), SPACE, dtype=np.uint8)
    word = np.repeat(np.arange(len(sizes)), long)
    place = np.arange(len(out)) - first[word]
    out[place < sizes[word]] = letters
    return out, word, place


def contexts(syms: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth`` symbols before each place as a number, and where the word (and the space before it) is long enough for it."""
    key = np.zeros(len(syms), dtype=np.uint64)
    before = np.empty_like(syms)
    for d in range(1, depth + 1):
        before[d:] = syms[:-d]
        before[:d] = SPACE
        key |= np.where(place >= d, before, SPACE).astype(np.uint64) << _U(8 * (d - 1))
    return key, place + 1 >= depth


def _gather_contexts(batches):
    """``(key, count)``: length, context and next symbol packed in a long, summed within a row's words."""
    for b in batches:
        for sizes, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            syms, _, place = symbols(np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(letters, np.uint8))
            for d in range(DEPTH + 1):
                key, there = contexts(syms, place, d)
                values, sums = np.unique(key[there] << _U(8) | syms[there].astype(np.uint64) | _U(d) << _U(56), return_counts=True)
                for at in range(0, len(values), 50_000):
                    yield pa.record_batch([pa.array(values[at : at + 50_000].view(np.int64)), pa.array(sums[at : at + 50_000])], names=["key", "count"])


class Tree:
    """States in order of their packed context; a row of log10 probabilities of all bytes for each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        context = keys >> _U(8)
        self.states, self.rows = np.array([0], dtype=np.uint64), None
        root = np.zeros(256)
        np.add.at(root, (keys[context == 0] & _U(255)).astype(np.int64), counts[context == 0])
        rows = {0: self._smoothed(root, BASE)}
        for d in range(1, DEPTH + 1):
            mine = np.flatnonzero(context >> _U(48) == d)
            by = mine[np.argsort(context[mine], kind="stable")]
            own, start = np.unique(context[by], return_index=True)
            for state, a, b in zip(own.tolist(), start.tolist(), [*start.tolist(), len(by)][1:], strict=True):
                pick = by[a:b]
                suffix = state & (1 << 8 * (d - 1)) - 1 | d - 1 << 48
                parent = rows.get(suffix)
                if parent is None:
                    continue
                seen = np.zeros(256)
                seen[(keys[pick] & _U(255)).astype(np.int64)] = counts[pick]
                share = seen / seen.sum()
                at = share > 0
                if (seen[at] * np.log(share[at] / parent[at])).sum() >= LEAST_GAIN:
                    rows[state] = self._smoothed(seen, parent)
        self.states = np.array(sorted(rows), dtype=np.uint64)
        with np.errstate(divide="ignore"):
            self.rows = np.log10(np.array([rows[s] for s in self.states.tolist()])).astype(np.float32)
        deepest = self._start()
        self.opened = float(np.log10(1 - 10.0 ** float(self.rows[deepest, SPACE])))

    def _start(self) -> int:
        """The state at the begin of a word: after a space, or the root."""
        key = _U(SPACE) | _U(1) << _U(48)
        at = int(np.searchsorted(self.states, key))
        return at if at < len(self.states) and self.states[at] == key else 0

    @staticmethod
    def _smoothed(seen: np.ndarray, parent: np.ndarray) -> np.ndarray:
        weight = SMOOTH * max(1, int((seen > 0).sum()))
        return (seen + weight * parent) / (seen.sum() + weight)

    def scores(self, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """log10 probability of each word, its closing space included, given that it has a letter."""
        if not len(sizes):
            return np.zeros(0)
        syms, word, place = symbols(sizes, letters)
        state = np.zeros(len(syms), dtype=np.int64)
        left = np.arange(len(syms))
        for d in range(1, DEPTH + 1):
            # a suffix of every state is a state, so only places that found one go deeper
            key, there = contexts(syms, place, d)
            left = left[there[left]]
            packed = key[left] | _U(d) << _U(48)
            at = np.minimum(np.searchsorted(self.states, packed), len(self.states) - 1)
            hit = self.states[at] == packed
            left = left[hit]
            state[left] = at[hit]
        return np.bincount(word, weights=self.rows[state, syms].astype(np.float64), minlength=len(sizes)) - self.opened


def learn(words: DataFrame) -> Tree:
    """The tree over the words of ``(sizes, letters)`` blobs. Only contexts of the least share come to the driver."""
    found = words.mapInArrow(tidy(_gather_contexts), "key bigint, count bigint").groupBy("key").agg(F.sum("count").alias("count"))
    found = stored(found.withColumn("context", F.shiftrightunsigned("key", 8)), "contexts")
    of = found.groupBy("context").agg(F.sum("count").alias("total"))
    all_symbols = found.where("context = 0").agg(F.sum("count")).first()[0] or 0
    kept = of.where(F.col("total") >= LEAST_SHARE * all_symbols)
    rows = found.join(kept, "context").select("key", "count").toPandas()
    drop_stored(found)
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    return Tree(rows["key"].to_numpy()[order].view(np.uint64), rows["count"].to_numpy()[order].astype(np.float64))


def mass(words: DataFrame, tree: Tree) -> float:
    """The probability of all words of ``(sizes, letters)`` blobs together."""
    sent = words.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            for sizes, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sent.value.scores(np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(letters, np.uint8))
                yield pa.record_batch([pa.array([float((10**own).sum())])], names=["mass"])

    return words.mapInArrow(tidy(run), "mass double").agg(F.sum("mass")).first()[0] or 0.0
