"""Supervised subword embeddings: a quality classifier over hashed n-gram vectors.

A text's features are its words, neighbouring word pairs, marks for a word that
repeats its predecessor, and byte n-grams of 3 and 4 (case kept), all hashed into
``2**bits`` buckets. Each bucket has a learned vector; a text is the average of its
features' vectors, and a softmax over a linear layer gives the class probabilities.
Vectors and layer are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows.

Scoring uses that a linear layer over an average is the average of the layer over each
vector: with two classes the probability is the logistic function of the mean of one
number per bucket, so a text costs one table look-up per feature, and memory is bounded
by a piece of a text.

Defined cases: null texts count as empty; a text without features scores the layer's
bias; rows without label, and labelled rows without text row, are not trained on;
repeated rows are each scored; without labelled rows of both classes the score is the
share of label 1 (0.5 without any); extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from demandflow.llm.common import release, stored
from demandflow.session import ship_package

BITS, GRAMS = 17, (3, 4)
#: Bound of the training sample: labelled rows, and characters of their texts in all.
MAX_ROWS, MAX_CHARS = 4000, 48_000_000
#: Bytes of a text whose features are made at a time (cut at white space where there is some).
PIECE = 1 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int32)


def piece_features(b: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every feature of one piece of text (bytes)."""
    out = []
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        place = np.arange(len(b)) - np.repeat(begin, np.diff(np.r_[begin, len(b)])) if begin[0] == 0 else (
            np.arange(len(b)) - np.r_[np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.r_[begin, len(b)]))])
        value = np.where(inside, _BYTE[b] * _PLACE[place & 63], np.uint64(0))
        word = np.add.reduceat(value, begin)
        out.append(_bucket(word, bits))
        out.append(_bucket(word[:-1] * np.uint64(3) + word[1:], bits))
        again = (end - begin)[1:][word[:-1] == word[1:]]  # as many marks as the repeated word has bytes
        out.append(np.full(int(again.sum()), _bucket(np.full(1, 7, np.uint64), bits)[0], np.int32))
    code = _BYTE[b]
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        code = code[:-1] * _PLACE[n] + _BYTE[b[n - 1:]]
        if n in GRAMS:
            out.append(_bucket(code, bits))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def features(text: str | None, bits: int) -> Iterator[np.ndarray]:
    data = (text or "").encode()
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
            stop = cut if cut > at else stop
        yield piece_features(np.frombuffer(data, np.uint8, stop - at, at), bits)
        at = stop


def train(texts: list[str | None], labels: np.ndarray, bits: int = BITS, dim: int = 12, epochs: int = 6,
          rate: float = 0.8, seed: int = 5) -> tuple[np.ndarray, float]:
    """Number per bucket and bias, so that P(label 1) = logistic(bias + mean of the numbers)."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return np.zeros(2 ** bits, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    known = []
    for t in texts:
        ids = np.concatenate([*features(t, bits), np.zeros(0, np.int32)])
        u, n = np.unique(ids, return_counts=True)
        known.append((u, (n / max(1, len(ids))).astype(np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 ** bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    squares = np.full(2 ** bits, 1e-12, np.float32)  # per-bucket step sizes
    total, done = epochs * len(known), 0
    for _ in range(epochs):
        for i in rng.permutation(len(known)):
            step = rate * (1 - done / total)
            done += 1
            u, w = known[i]
            mean = w @ vectors[u]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ layer
            layer -= step * np.outer(p, mean)
            bias -= 0.05 * step * p
            squares[u] += w * w * float(back @ back)
            vectors[u] -= step * (w / np.sqrt(squares[u]))[:, None] * back * 0.1
    way = layer[1] - layer[0]
    return vectors @ way, float(bias[1] - bias[0])


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of labels on log-odds ``z`` (smoothed targets, so a
    perfect separation keeps a finite slope), by Newton steps."""
    pos, neg = int(y.sum()), int((1 - y).sum())
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([(z - z.mean()) / (z.std() + 1e-9), np.ones_like(z)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w @ x)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - t))
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    slope = w[0] / (z.std() + 1e-9)
    return float(slope), float(w[1] - slope * z.mean())


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Train on four fifths of the rows, calibrate the log-odds on the rest."""
    rest = np.random.default_rng(seed).permutation(len(labels)) % 5 == 0
    numbers, bias = train([t for t, r in zip(texts, rest) if not r], labels[~rest], bits, seed=seed)
    z = np.array([log_odds(t, numbers, bias, bits) for t, r in zip(texts, rest) if r])
    slope, offset = calibrate(z, labels[rest]) if len(z) else (1.0, 0.0)
    return (numbers * slope).astype(np.float32), bias * slope + offset


def log_odds(text: str | None, numbers: np.ndarray, bias: float, bits: int) -> float:
    total = count = 0.0
    for ids in features(text, bits):
        total += float(numbers[ids].sum(dtype=np.float64))
        count += len(ids)
    return bias + (total / count if count else 0.0)


def score(text: str | None, numbers: np.ndarray, bias: float, bits: int) -> float:
    """Probability of label 1."""
    return float(1 / (1 + np.exp(-np.clip(log_odds(text, numbers, bias, bits), -500, 500))))


def sample(labelled: DataFrame, docs: DataFrame, key: str, text: str, label: str, max_rows: int, max_chars: int) -> list:
    """Training rows: the first by a hash of the key, at most ``max_rows``. All of them are kept;
    where their texts pass ``max_chars`` in all, the longest give their beginnings, as many
    characters each as the bound leaves."""
    ids = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    ids = stored(ids.orderBy(F.xxhash64(key), key).limit(max_rows), "sample-ids")
    rows = docs.select(F.col(key), F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars).alias("text")).join(ids, key)
    rows = stored(rows.groupBy(key, "label").agg(F.min("text").alias("text")), "sample")
    longest = _share([r.n for r in rows.select(F.length("text").alias("n")).collect()], max_chars)  # max_rows numbers
    return rows.orderBy(key).select(F.col(key).alias("key"), "label", F.substring("text", 1, longest).alias("text")).collect()


def _share(lengths: list[int], bound: int) -> int:
    """The greatest length such that the texts, cut to it, keep within the bound."""
    for i, n in enumerate(sorted(lengths)):
        level = bound // (len(lengths) - i)
        if n > level:
            return level
        bound -= n
    return max(lengths, default=0)


def with_score(docs: DataFrame, labelled: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
               max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, bits: int = BITS, out: str = "_score") -> DataFrame:
    """``docs`` with column ``out``: the probability of label 1, learned from ``labelled`` (key, label)."""
    ship_package(docs.sparkSession)
    rows = sample(labelled, docs, key, text, label, max_rows, max_chars)
    numbers, bias = fit([r.text for r in rows], np.array([r.label for r in rows], dtype=np.int64), bits)
    model = docs.sparkSession.sparkContext.broadcast((numbers, bias))  # 2**bits numbers, whatever the data

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, b = model.value
        for texts in batches:  # few texts at a time are Python strings
            yield pa.array([score(t, table, b, bits) for at in range(0, len(texts), 64) for t in texts.slice(at, 64).to_pylist()],
                           pa.float64())
        release()

    return docs.withColumn(out, scored(F.col(text).cast("string")))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text (a null key: the empty text) has that remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == fold
