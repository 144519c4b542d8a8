"""Toxicity by nearest labelled examples.

A bounded, documented sample of labelled texts becomes an index of TF-IDF vectors
(logarithmic counts, unit length) over the terms whose presence depends on the label
(chi-square). The index is inverted with block maxima: examples lie in blocks, and each
term keeps its postings by block and its largest weight per block. A query's bound for a
block is the sum of its weights times those maxima; blocks are visited from the largest
bound down until no bound can reach the k-th similarity, so the k nearest by exact
cosine are found without scoring every example. Votes are weighted by inverse distance
and blended with the base rate of the examples; a logistic fit on leave-one-out votes
calibrates them. Each score carries its evidence: the nearest examples, their labels and
similarities.

Defined cases: null and empty texts, and texts without a known term, have no neighbours
and score the calibrated base rate of examples without known terms; equal similarities
are ordered by example; repeated texts count once among the examples and are each
scored; rows without label are not examples; without examples the score is 0.5; extra
columns are passed through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandflow.llm.subword import calibrate, sample
from demandflow.session import ship_package

#: Bound of the sample: labelled rows and characters of their texts.
MAX_ROWS, MAX_CHARS = 6_000, 48_000_000
STEMS = (4, 5, 6, 7)
#: Words whose known terms a Python worker remembers.
CACHE = 200_000
K, BLOCK = 15, 64
#: Chi-square and number of examples from which a term is used; the most terms.
MIN_CHI2, MIN_DOCS, MAX_TERMS = 40.0, 8, 4096
#: Distance that is added to every distance, and votes that the base rate counts as.
NEAR, PRIOR = 0.05, 1.0

_TERM = re.compile(r"\w+")


def forms(word: str) -> list[str]:
    """The terms of a word: itself, and its beginnings of 4 to 7 letters (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def tokens(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


class BlockMaxIndex:
    """Exact cosine search over labelled examples."""

    def __init__(self, ids: list, texts: list[str], labels: np.ndarray):
        seen, keep = set(), []
        for i, t in enumerate(texts):
            if t not in seen:
                seen.add(t)
                keep.append(i)
        del seen
        self.labels = np.asarray(labels, dtype=np.float64)[keep] if keep else np.zeros(0)
        self.ids = [ids[i] for i in keep]
        n, pos = len(keep), float(self.labels.sum())
        have, with_label = Counter(), Counter()
        for i, y in zip(keep, self.labels):
            found = {f for w in set(tokens(texts[i])) for f in forms(w)}
            have.update(found)
            if y:
                with_label.update(found)
        chi2 = {}
        for w, d in have.items():
            if d >= MIN_DOCS:
                a = with_label[w]
                low = d * (n - d) * pos * (n - pos)
                x = n * (a * n - d * pos) ** 2 / low if low else 0.0
                if x >= MIN_CHI2:
                    chi2[w] = x
        chosen = sorted(chi2, key=lambda w: (-chi2[w], w))[:MAX_TERMS]
        self.vocabulary = {w: j for j, w in enumerate(chosen)}
        self.known: dict[str, list[int]] = {}
        self.idf = np.array([np.log((n + 1) / (have[w] + 0.5)) for w in chosen])
        del have, with_label
        vectors = [self.vector(texts[i]) for i in keep]
        none = [i for i, (t, _) in enumerate(vectors) if not len(t)]
        self.base = float((self.labels[none].sum() + 0.5) / (len(none) + 1)) if n else 0.5
        # neighbours in a block share their strongest term, which keeps the maxima tight
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.order = np.array(order, dtype=np.int64)
        self.blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((len(chosen), self.blocks), np.float64)
        self.postings: list[dict] = [{} for _ in range(self.blocks)]  # per block: term -> (places, weights)
        gathered: list[dict] = [{} for _ in range(self.blocks)]
        for place, i in enumerate(order):
            block, at = divmod(place, BLOCK)
            for t, w in zip(*vectors[i]):
                gathered[block].setdefault(int(t), []).append((at, w))
                self.most[t, block] = max(self.most[t, block], w)
        for block, found in enumerate(gathered):
            for t, x in found.items():
                self.postings[block][t] = (np.array([a for a, _ in x]), np.array([w for _, w in x]))
        raw = np.full(n, self.base)
        for i in order:
            raw[i] = self.vote(self.nearest(*vectors[i], skip=i))
        self.slope, self.offset = calibrate(_logit(raw), self.labels) if 0 < pos < n else (1.0, 0.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, unit length."""
        known, vocabulary, found = self.known, self.vocabulary, []
        for w in tokens(text):
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[w] = [vocabulary[f] for f in forms(w) if f in vocabulary]
            if got:
                found += got
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        t, c = np.unique(np.array(found), return_counts=True)
        w = (1 + np.log(c)) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = K, skip: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the k most similar, best first; ties by example."""
        if not len(t):
            return []
        bounds = w @ self.most[t]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(best) == k and bounds[block] < -best[-1][0] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            posting = self.postings[block]
            for term, weight in zip(t.tolist(), w.tolist()):
                if term in posting:
                    at, x = posting[term]
                    scores[at] += weight * x
            hit = np.flatnonzero(scores > 0)
            near = [(-float(scores[a]), int(self.order[block * BLOCK + a])) for a in hit]
            best = sorted([*best, *(x for x in near if x[1] != skip)])[:k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        w = np.array([1 / (NEAR + max(0.0, 1 - s)) for s, _ in near])
        prior = PRIOR / (1 + NEAR)  # one vote at distance 1
        return float((w @ self.labels[[i for _, i in near]] + prior * self.base) / (w.sum() + prior))

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(*self.vector(text))
        z = _logit(np.array([self.vote(near)]))[0]
        return float(1 / (1 + np.exp(-(self.slope * z + self.offset)))), near


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def with_neighbours(docs: DataFrame, labelled: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
                    max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, shown: int = 3) -> DataFrame:
    """``docs`` with ``_near``: struct of score and evidence (nearest examples: id, label, similarity)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = sample(labelled, docs, key, text, label, max_rows, max_chars)
    index = spark.sparkContext.broadcast(BlockMaxIndex(  # bounded by max_rows and max_chars
        [r.key for r in rows], [r.text for r in rows], np.array([r.label for r in rows])))
    one = pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])
    out = pa.struct([("score", pa.float64()), ("evidence", pa.list_(one))])

    @F.arrow_udf("struct<score: double, evidence: array<struct<id: bigint, label: int, similarity: double>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = index.value
        for texts in batches:
            made = []
            for at in range(0, len(texts), 256):
                for t in texts.slice(at, 256).to_pylist():
                    s, near = known.score(t)
                    made.append({"score": s, "evidence": [
                        {"id": known.ids[i], "label": int(known.labels[i]), "similarity": sim} for sim, i in near[:shown]]})
            yield pa.array(made, out)

    return docs.withColumn("_near", scored(F.col(text).cast("string")))
