"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is read as the mean of learned vectors of
its hashed path features (tags, class and id names on the way from the root), the mean of learned
vectors of its hashed words, and its length, link share, place, and the elements that close and open
between it and its neighbours. A bidirectional LSTM in numpy
runs over the whole sequence, so every block is labelled with the context of the whole page; the
blocks labelled as article are joined in page order.

The network is trained on made-up pages (``page_samples``) from a fixed seed; many of them have no
names, or names that say nothing, or no tags that say anything, so that it reads them by what
stands around a block. ``python -m corpusloom.llm.block_labeller`` trains it and writes the weights
that lie beside this module. Null pages count as empty and give an empty text; a page without article blocks, too.
Repeated rows each get their text.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .html_blocks import PATHS, WORDS, Block, blocks, path_features, word_features
from .page_samples import KNOWN, Maker

VECTOR, HIDDEN, NUMBERS = 24, 24, 9
PAGES, EPOCHS, BATCH = 5000, 6, 32
WEIGHTS = Path(__file__).with_name("block_labeller.npz")


def between(a: tuple, b: tuple) -> tuple[float, float]:
    """How many elements close and open from one block to the next, in quarters, up to one: the same element, not one of the same kind, is what two blocks share."""
    shared = len({id(x) for x in a} & {id(x) for x in b})
    return min(1.0, (len(a) - shared) / 4), min(1.0, (len(b) - shared) / 4)


class Features:
    """Flat feature ids with offsets, and numbers, of a list of blocks."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        paths, words, numbers, memo = [], [], [], {}
        for page in pages:
            steps = [between(a.path, b.path) for a, b in zip(page, page[1:], strict=False)]
            for i, b in enumerate(page):
                own = memo.get(b.path)
                if own is None:
                    own = memo[b.path] = path_features(b.path, KNOWN)
                paths.append(own)
                w = word_features(b.text)
                words.append(w)
                numbers.append((np.log1p(len(w)) / 4, b.linked, i / max(1, len(page) - 1), b.text[-1:] in ".!?", len(b.path) / 10, *(steps[i - 1] if i else (1, 1)), *(steps[i] if i < len(steps) else (1, 1))))
        self.numbers = np.array(numbers, dtype=np.float32).reshape(-1, NUMBERS)
        self.paths, self.words = _flat(paths), _flat(words)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))
    return flat, sizes


def _means(vectors: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), vectors.shape[1]), dtype=np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(vectors[flat], starts) / sizes[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        width = 2 * VECTOR + NUMBERS
        self.path = r.normal(0, 0.3, (PATHS, VECTOR)).astype(np.float32)
        self.word = r.normal(0, 0.3, (WORDS, VECTOR)).astype(np.float32)
        self.cells = []
        for _ in range(2):
            w = r.normal(0, 1 / np.sqrt(width + HIDDEN), (width + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.cells += [w, bias]
        self.out = r.normal(0, 0.1, 2 * HIDDEN + width).astype(np.float32)
        self.offset = np.zeros(1, dtype=np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.cells, self.out, self.offset]

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_means(self.path, *f.paths), _means(self.word, *f.words), f.numbers], axis=1)

    def _run(self, x: np.ndarray, there: np.ndarray, w: np.ndarray, bias: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
        """One direction over (time, page, width); states pass unchanged where a page has no block."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), dtype=np.float32), np.zeros((pages, HIDDEN), dtype=np.float32)
        out = np.zeros((steps, pages, HIDDEN), dtype=np.float32)
        fed = (x.reshape(-1, x.shape[2]) @ w[: x.shape[2]] + bias).reshape(steps, pages, -1)
        own = w[x.shape[2] :]
        for t in order:
            z = fed[t] + h @ own
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = there[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def _padded(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        page = np.repeat(np.arange(len(sizes)), sizes)
        time = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        big = np.zeros((int(sizes.max()), len(sizes), x.shape[1]), dtype=np.float32)
        there = np.zeros(big.shape[:2], dtype=bool)
        big[time, page], there[time, page] = x, True
        return big, there, time, page

    def scores(self, f: Features) -> np.ndarray:
        """Logit of being article for each block of all pages; pages of like length go together."""
        x = self.inputs(f)
        out = np.zeros(len(x), dtype=np.float32)
        first = np.cumsum(f.sizes) - f.sizes
        order = np.argsort(f.sizes, kind="stable")
        order = order[f.sizes[order] > 0]
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            sizes = f.sizes[pick]
            rows = np.repeat(first[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            big, there, time, page = self._padded(x[rows], sizes)
            ahead = self._run(big, there, *self.cells[:2], range(len(big)))
            back = self._run(big, there, *self.cells[2:], range(len(big) - 1, -1, -1))
            both = np.concatenate([ahead[time, page], back[time, page], x[rows]], axis=1)
            out[rows] = both @ self.out + self.offset[0]
        return out

    def gradients(self, f: Features, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over all blocks of the batch."""
        x = self.inputs(f)
        big, there, time, page = self._padded(x, f.sizes)
        kept: list[list] = [[], []]
        orders = range(len(big)), range(len(big) - 1, -1, -1)
        states = [self._run(big, there, self.cells[2 * k], self.cells[2 * k + 1], orders[k], kept[k]) for k in (0, 1)]
        both = np.concatenate([s[time, page] for s in states] + [x], axis=1)
        d = (_sigmoid(both @ self.out + self.offset[0]) - labels) / len(x)
        d_both = d[:, None] * self.out[None, :]
        dx = d_both[:, 2 * HIDDEN :].copy()
        cells = []
        for k in (0, 1):
            w = self.cells[2 * k]
            given = np.zeros((*there.shape, HIDDEN), dtype=np.float32)
            given[time, page] = d_both[:, k * HIDDEN : (k + 1) * HIDDEN]
            dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, dtype=np.float32)
            dh, dc = np.zeros(given.shape[1:], dtype=np.float32), np.zeros(given.shape[1:], dtype=np.float32)
            d_big = np.zeros_like(big)
            for t, h, c, i, fg, o, g, tanh in reversed(kept[k]):
                m = there[t][:, None]
                dh = dh + given[t]
                dc_new = np.where(m, dc + dh * o * (1 - tanh * tanh), 0)
                dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * fg * (1 - fg), np.where(m, dh * tanh * o * (1 - o), 0), dc_new * i * (1 - g * g)], axis=1)
                joined = np.concatenate([big[t], h], axis=1)
                dw += joined.T @ dz
                db += dz.sum(axis=0)
                back = dz @ w.T
                d_big[t] = back[:, : big.shape[2]]
                dh = np.where(m, back[:, big.shape[2] :], dh)
                dc = np.where(m, dc_new * fg, dc)
            dx += d_big[time, page]
            cells += [dw, db]
        out = []
        for vectors, (flat, sizes), lo in ((self.path, f.paths, 0), (self.word, f.words, VECTOR)):
            g = np.zeros_like(vectors)
            np.add.at(g, flat, np.repeat(dx[:, lo : lo + VECTOR] / np.maximum(1, sizes)[:, None], sizes, axis=0))
            out.append(g)
        return [*out, *cells, (d[:, None] * both).sum(axis=0), np.array([d.sum()])]


def samples(seeds: range) -> tuple[list[list[Block]], list[list[int]]]:
    pages, labels = [], []
    for seed in seeds:
        made = Maker(seed)
        own = blocks(made.html)
        if len(own) != len(made.labels):
            raise ValueError(f"page {seed}: {len(own)} blocks, {len(made.labels)} labels")
        pages.append(own)
        labels.append(made.labels)
    return pages, labels


@functools.cache
def shipped() -> Labeller:
    """The network whose weights come with the package."""
    net = Labeller()
    with np.load(WEIGHTS) as kept:
        for k, w in enumerate(net.weights):
            w[...] = kept[f"w{k}"]
    return net


def trained(n: int = PAGES, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.01) -> Labeller:
    """The network, trained with Adam on ``n`` made-up pages."""
    pages, labels = samples(range(n))
    net, r = Labeller(seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    by_size = np.argsort([len(p) for p in pages], kind="stable")
    groups = [by_size[at : at + BATCH] for at in range(0, n, BATCH)]
    fed = [(Features([pages[i] for i in g]), np.array([x for i in g for x in labels[i]], dtype=np.float32)) for g in groups]
    steps, total = 0, epochs * len(groups)
    for _ in range(epochs):
        for k in r.permutation(len(groups)):
            steps += 1
            now = rate * (1 - 0.95 * steps / total)
            for w, g, a, b in zip(net.weights, net.gradients(*fed[k]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (now * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    own = [blocks(p or "") for p in pages]
    logits = net.scores(Features(own))
    out, at = [], 0
    for page in own:
        out.append("\n\n".join(b.text for b, s in zip(page, logits[at : at + len(page)].tolist(), strict=True) if s > 0))
        at += len(page)
    return out


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text`` for each row."""
    net = shipped()
    src = df.select(*keep, html_col)

    def run(batches):
        for b in batches:
            texts, held, size = [], [], 0
            for page in b.column(len(keep)).to_pylist():
                held.append(page)
                size += len(page or "")
                if size >= 1 << 21:
                    texts += main_texts(net, held)
                    held, size = [], 0
            texts += main_texts(net, held)
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])
    return src.mapInArrow(tidy(run), f"{kinds}, text string")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{f"w{k}": w.astype(np.float16) for k, w in enumerate(trained().weights)})
