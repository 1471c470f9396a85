"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its UTF-8 bytes. Each byte has a learned
vector and one channel that tells how far the bytes around it repeat what stands up to ``LAGS``
bytes before (equality of bytes at a distance, which filters over byte vectors can't express).
Learned filters slide over every chunk, their responses are max-pooled within the chunk,
and the mean and the maximum over all chunks feed one logistic unit. Nothing but the bytes of the
text enters a score.

Training uses at most ``SAMPLE`` labelled rows of the training fold, those with the smallest hash
of their id, with whole texts. A step holds some ten bytes for each byte of its texts. Rows with a null label are left out; of several labels of one id
the largest counts. Without any labelled row every score is 0.5. Null texts count as empty, which
is scored like any other text: one chunk of padding. Repeated rows each get their score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Most labelled rows that training reads.
SAMPLE = 3000
CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
VECTOR, FILTERS = 8, 24
CHANNELS = VECTOR + 1
#: Distances at which four bytes are compared, and the bytes over which the matches are averaged.
LAGS, AVERAGED = range(2, 25), 32
THRESHOLD = 0.3


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks of all texts, padded with zeros, and the number of chunks of each text."""
    counts = np.array([max(1, -(-(len(t) - (CHUNK - STEP)) // STEP)) for t in texts], dtype=np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), dtype=np.uint8)
    row = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
        padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        out[row : row + n] = np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))
        row += n
    return out, counts


def repeats(own: np.ndarray) -> np.ndarray:
    """For each byte of each chunk, the share of the bytes around it that repeat those a small distance before."""
    four = own[:, :-3].astype(np.uint32)
    for j in range(1, 4):
        four |= own[:, j : CHUNK - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    same = np.zeros(own.shape, dtype=bool)
    for lag in LAGS:
        same[:, lag:-3] |= (four[:, lag:] == four[:, :-lag]) & (four[:, lag:] != 0)
    sums = np.zeros((len(own), CHUNK + AVERAGED), dtype=np.float32)
    np.cumsum(same, axis=1, out=sums[:, AVERAGED:])
    return (sums[:, AVERAGED:] - sums[:, :-AVERAGED]) / AVERAGED


class ConvNet:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.vectors = r.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.vectors[0] = 0
        self.filters = r.normal(0, 1 / np.sqrt(WIDTH * CHANNELS), (WIDTH * CHANNELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.head = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, dtype=np.float32)

    def windows(self, own: np.ndarray, again: np.ndarray | None = None) -> np.ndarray:
        x = np.empty((*own.shape, CHANNELS), dtype=np.float32)
        x[..., :VECTOR] = self.vectors[own]
        x[..., VECTOR] = repeats(own) if again is None else again
        places = (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(own), places, WIDTH * CHANNELS), (a, b * STRIDE, c))

    def pooled(self, own: np.ndarray) -> np.ndarray:
        """Filter responses of every chunk, max-pooled within it."""
        out = np.empty((len(own), FILTERS), dtype=np.float32)
        for at in range(0, len(own), 128):
            part = np.ascontiguousarray(self.windows(own[at : at + 128]))
            out[at : at + 128] = (part.reshape(-1, WIDTH * CHANNELS) @ self.filters).reshape(*part.shape[:2], FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not texts:
            return np.zeros(0)
        own, counts = chunks(texts)
        p = self.pooled(own)
        at = np.cumsum(counts) - counts
        both = np.concatenate([np.add.reduceat(p, at) / counts[:, None], np.maximum.reduceat(p, at)], axis=1)
        return 1 / (1 + np.exp(-(both.astype(np.float64) @ self.head + self.offset[0])))

    def step(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss, in the order of ``weights``."""
        own, counts = chunks(texts)
        p, best = np.empty((len(own), FILTERS), dtype=np.float32), np.empty((len(own), FILTERS), dtype=np.int16)
        again = np.empty(own.shape, dtype=np.float32)
        for at in range(0, len(own), 128):
            again[at : at + 128] = repeats(own[at : at + 128])
            part = np.ascontiguousarray(self.windows(own[at : at + 128], again[at : at + 128]))
            r = (part.reshape(-1, WIDTH * CHANNELS) @ self.filters).reshape(*part.shape[:2], FILTERS)
            best[at : at + 128] = r.argmax(axis=1)
            p[at : at + 128] = r.max(axis=1)
        p = np.maximum(p + self.bias, 0)
        at = np.cumsum(counts) - counts
        mean, top = np.add.reduceat(p, at) / counts[:, None], np.maximum.reduceat(p, at)
        both = np.concatenate([mean, top], axis=1)
        prob = 1 / (1 + np.exp(-(both @ self.head + self.offset[0])))
        d = ((prob - labels) / len(texts)).astype(np.float32)
        back = d[:, None] * self.head[None, :]
        owner = np.repeat(np.arange(len(texts)), counts)
        dp = back[owner, :FILTERS] / counts[owner][:, None]
        is_top = p == top[owner]
        dp += np.where(is_top, back[owner, FILTERS:] / np.maximum(1, np.add.reduceat(is_top, at))[owner], 0)
        dp = (dp * (p > 0)).astype(np.float32)
        d_filters, d_vectors = np.zeros_like(self.filters), np.zeros_like(self.vectors)
        for at in range(0, len(own), 128):  # only the bytes under the best places are looked at again
            row, col = np.nonzero(dp[at : at + 128])
            row += at
            g = dp[row, col]
            places = row[:, None], best[row, col].astype(np.int64)[:, None] * STRIDE + np.arange(WIDTH)
            seen = np.concatenate([self.vectors[own[places]], again[places][..., None]], axis=2).reshape(-1, WIDTH * CHANNELS)
            np.add.at(d_filters.T, col, g[:, None] * seen)
            np.add.at(d_vectors, own[places].ravel(), (g[:, None] * self.filters.T[col]).reshape(-1, CHANNELS)[:, :VECTOR])
        d_vectors[0] = 0
        return [d_vectors, d_filters, dp.sum(axis=0), (d[:, None] * both).sum(axis=0), np.array([d.sum()])]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.head, self.offset]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ConvNet:
    """Adam over shuffled batches; the same rows give the same network."""
    net, r = ConvNet(seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net.offset[0] = np.log(share / (1 - share))
    steps, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            steps += 1
            now = rate * (1 - 0.9 * steps / total)
            for w, g, a, b in zip(net.weights, net.step([texts[i] for i in pick], labels[pick]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (now * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> ConvNet | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold; None without any."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds
    picked = labels.where(F.col(label_col).isNotNull() & (fold != held_out)).groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda x: x[id_col])
    if not rows:
        return None
    return train([x["text"].encode() for x in rows], np.array([x["label"] for x in rows], dtype=np.float32))


def scored(docs: DataFrame, net: ConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a column ``score`` after the others."""
    if "score" in docs.columns:
        docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            found, held, size = [], [], 0
            for t in b.column(at).to_pylist():
                held.append((t or "").encode())
                size += len(held[-1])
                if size >= 1 << 19:
                    found.append(net.scores(held) if net else np.full(len(held), 0.5))
                    held, size = [], 0
            found.append(net.scores(held) if net else np.full(len(held), 0.5))
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(found), pa.float64())], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
