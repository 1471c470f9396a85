"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters, marks, digits and underscores of any script, case folded; every letter
of a script that is written without spaces is a word by itself. All else separates words. Word
counts over all documents give the chance frequency of every pair of neighbours of a test item;
those that at most ``RARE`` documents would hold by chance are its seeds, and the rarest half always
are. Chance frequency, not the count of the pair itself, decides, so an item that leaked into very
many documents keeps its seeds. Seeds join documents to items; around every seed the document's
words are aligned to the item's (match 2, mismatch and gap -1). A document leaks an item if the
best alignment reaches ``COVERED`` of the item's full score, or matches ``RUN`` words in a row. Items of
fewer than ``WHOLE`` words are too short to be told from chance when edited, so they leak where all
their words stand in a row. An item without words never leaks.

The benchmark is the stated query set: it is taken in blocks of bounded size, each of which is
sent to all tasks and run against all documents. Null texts count as empty. Repeated items and
rows each get their matches; an empty benchmark or table gives none. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import hash_runs, mix64, tidy

N = 2
RARE = 1e-4
COVERED, RUN = 0.5, 13
WHOLE = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
#: Words of a document that are aligned at once, besides three times those of the item.
WINDOW = 4096
_U = np.uint64
LETTERS = mix64(np.arange(1, 0x110001, dtype=np.uint64))
#: Blocks of scripts that are written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs).
SPACELESS = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point: 0 separates words, 1 is part of one, 2 is one."""
    out = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x20000)] + [False] * 0xF0000, dtype=np.uint8)
    out[0x20000:0x40000] = 1
    out[ord("_")] = 1
    for low, high in SPACELESS:
        out[low : high + 1] *= 2
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the offset of each text's first word, closed by their number."""
    folded = [t.casefold() for t in texts]
    data = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "replace"), dtype="<u4")
    kind = kinds()[data]
    there = kind > 0
    begins = there.copy()
    begins[1:] &= ~there[:-1] | (kind[1:] == 2) | (kind[:-1] == 2)
    closes = there.copy()
    closes[:-1] &= ~there[1:] | begins[1:]
    at = np.flatnonzero(begins)
    sizes = np.flatnonzero(closes) + 1 - at
    h = hash_runs(data[there], LETTERS, np.cumsum(sizes) - sizes, sizes)
    return h, np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in folded)]))


def grams(h: np.ndarray, n: int = N) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = mix64(out + h[k : k + len(out)] + _U(k + 1))
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, matches on the way, longest run of matches anywhere, and the span in ``words``.

    A cell holds score, place of the start and matches in one number, so one row is enough.
    """
    m = len(words)
    place, unit = np.arange(m + 1) << 21, 1 << 42
    drop = np.arange(m + 1) * (-GAP * unit)
    above, run = place, np.zeros(m + 1, dtype=np.int64)
    best, end, longest = 0, 0, 0
    for w in item:
        same = words == w
        now = place.copy()
        now[1:] = np.maximum(now[1:], np.maximum(above[:-1] + np.where(same, MATCH * unit + 1, MISMATCH * unit), above[1:] + GAP * unit))
        now = np.maximum.accumulate(now + drop) - drop
        now = np.maximum(now, place)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = max(longest, int(run.max()))
        k = int((now >> 42).argmax())
        if now[k] >> 42 > best >> 42:
            best, end = int(now[k]), k
        above = now
    start = best >> 21 & (1 << 21) - 1
    return best >> 42, best & (1 << 21) - 1, longest, start if best else 0, end


class Index:
    """Seeds of one block of items."""

    def __init__(self, items: list[tuple[object, np.ndarray]], chance: dict[int, float], doc_words: float) -> None:
        """``chance``: share of a word among all; ``doc_words``: words of a mean document."""
        self.items = items
        key, item, offset = [], [], []
        for number, (_, h) in enumerate(items):
            if len(h) < WHOLE:
                continue
            share = np.array([chance.get(int(x), 0.0) for x in h])
            expected = np.prod([share[k : len(h) - N + 1 + k] for k in range(N)], axis=0) * doc_words
            rare = (expected <= RARE) | (expected <= np.quantile(expected, 0.5))
            g = grams(h)[rare]
            key.append(g)
            item.append(np.full(len(g), number))
            offset.append(np.flatnonzero(rare))
        none = np.zeros(0, dtype=np.int64)
        key = np.concatenate([none.astype(np.uint64), *key])
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], np.concatenate([none, *item])[order], np.concatenate([none, *offset])[order]
        self.short: dict[int, dict[int, list[int]]] = {}
        for number, (_, h) in enumerate(items):
            if 0 < len(h) < WHOLE:
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(number)
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(self.key & _U(0xFFFFF)).astype(np.int64)] = True

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """The leaked items of each text."""
        h, starts = word_hashes(texts)
        out: list[list[dict]] = [[] for _ in texts]
        seen: set[tuple[int, int]] = set()
        for size, own in self.short.items():
            g = grams(h, size)
            for at in np.flatnonzero(np.isin(g, np.array(list(own), dtype=np.uint64))).tolist():
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                if at + size <= starts[doc + 1]:
                    start = at - int(starts[doc])
                    out[doc] += [{"item_id": self.items[i][0], "score": 1.0, "n_matched": size, "start_word": start, "end_word": start + size} for i in own[int(g[at])] if (doc, i) not in seen]
                    seen.update((doc, i) for i in own[int(g[at])])
        g = grams(h)
        at = np.flatnonzero(self.low[(g & _U(0xFFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, g[at]), np.searchsorted(self.key, g[at], side="right")
        at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return out
        which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = np.repeat(at, many)
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + N <= starts[doc + 1]
        at, which, doc = at[inside], which[inside], doc[inside]
        item, begin = self.item[which], at - self.offset[which]
        order = np.lexsort((begin, item, doc))
        item, begin, doc = item[order], begin[order], doc[order]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]).tolist()
        for a, b in zip(new, [*new[1:], len(doc)], strict=True):
            found = self.best(h, int(starts[doc[a]]), int(starts[doc[a] + 1]), int(item[a]), begin[a:b])
            if found:
                out[doc[a]].append(found)
        return out

    def best(self, h: np.ndarray, low: int, high: int, number: int, begin: np.ndarray) -> dict | None:
        """Align an item around its seeds in the document at ``low`` to ``high``; windows that meet are one."""
        name, own = self.items[number]
        size = len(own)
        cuts = np.flatnonzero(np.diff(begin) > 2 * size) + 1
        top = None
        for part in np.split(begin, cuts):
            first, last = max(low, int(part[0]) - size // 2), min(high, int(part[-1]) + size + size // 2)
            # an alignment that counts spans at most three times the item, so it lies in one of the windows whole
            for a in range(first, max(first + 1, last - 3 * size), WINDOW):
                b = min(last, a + WINDOW + 3 * size)
                words = h[a:b]
                shared = int(np.isin(own, words).sum())
                if shared < COVERED * size and shared < RUN:
                    continue  # no alignment can match more than that
                score, matched, run, start, end = align(own, words)
                if score >= COVERED * MATCH * size or run >= RUN:
                    got = (score / (MATCH * size), matched, a - low + start, a - low + end)
                    top = max(top, got) if top else got
        return top and {"item_id": name, "score": top[0], "n_matched": top[1], "start_word": top[2], "end_word": top[3]}


def _counts(docs: DataFrame, text_col: str, words: np.ndarray) -> tuple[dict[int, int], int, int]:
    """Counts over all documents of the given words (sorted hashes), of all words, and of documents."""
    low = np.zeros(1 << 20, dtype=bool)
    low[(words & _U(0xFFFFF)).astype(np.int64)] = True

    def run(batches):
        count, total, rows = np.zeros(len(words), dtype=np.int64), 0, 0
        for b in batches:
            h, _ = word_hashes([t or "" for t in b.column(0).to_pylist()])
            total, rows = total + len(h), rows + b.num_rows
            h = h[low[(h & _U(0xFFFFF)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            count += np.bincount(at[words[at] == h], minlength=len(words))
        for at in range(0, len(words), 50_000):
            part = slice(at, at + 50_000)
            yield pa.record_batch([pa.array(words[part].view(np.int64)), pa.array(count[part]), *(pa.array([x if at == 0 and i == 0 else 0 for i in range(len(words[part]))], pa.int64()) for x in (total, rows))], names=["word", "n", "total", "docs"])

    got = docs.select(text_col).mapInArrow(tidy(run), "word bigint, n bigint, total bigint, docs bigint").groupBy("word").agg(F.sum("n"), F.sum("total"), F.sum("docs")).collect()
    chance = {r[0] & (1 << 64) - 1: r[1] for r in got}
    return chance, sum(r[2] for r in got), sum(r[3] for r in got)


def blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in blocks of about ``BLOCK_BYTES``, one after the other."""
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == k).select(item_col, text_col).collect()
        rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        items = [(name, word_hashes([text])[0]) for name, text in rows]
        if items:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` and ``leaks array<struct<item_id, score, n_matched, start_word, end_word>>``, one entry for each item that the text leaks. A column ``leaks`` that ``docs`` has is replaced."""
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    at, plain = docs.columns.index(text_col), docs.schema
    kind = benchmark.schema[item_col].dataType.simpleString()
    entry = StructType.fromDDL(f"leaks array<struct<item_id:{kind},score:double,n_matched:bigint,start_word:bigint,end_word:bigint>>")["leaks"]
    out = docs.withColumn("leaks", F.array().cast(entry.dataType))
    schema = StructType([*plain.fields, StructField("leaks", entry.dataType)])
    for items in blocks(benchmark, item_col, item_text_col):
        words = np.unique(np.concatenate([h for _, h in items]))
        counts, total, rows = _counts(docs, text_col, words)
        sent = spark.sparkContext.broadcast(Index(items, {w: n / max(1, total) for w, n in counts.items()}, total / max(1, rows)))

        def run(batches, sent=sent):
            for b in batches:
                index, found, held, size = sent.value, [], [], 0
                for t in b.column(at).to_pylist():
                    held.append(t or "")
                    size += len(held[-1])
                    if size >= 1 << 20:
                        found += index.matches(held)
                        held, size = [], 0
                found += index.matches(held)
                before = b.column(len(b.schema) - 1).to_pylist()
                own = pa.array([x + y for x, y in zip(before, found, strict=True)], b.schema.field(len(b.schema) - 1).type)
                yield pa.record_batch([*b.columns[:-1], own], names=b.schema.names)

        out = out.mapInArrow(tidy(run), schema)
    return out
