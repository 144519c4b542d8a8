"""Personal data by candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card and phone numbers exactly. Beside
them, high-recall generators propose overlapping candidates: anything around an ``@`` or
a spelled-out one, dotted or colon-separated groups, digit runs with separators. Each
candidate is described by format features (digits, groups, separators, checksum, range
of parts) and context features (neighbouring characters, cue words before it). Boosted
trees learn on a bounded sample from weak labels: base spans, and candidates that a word of
their kind announces, are personal data, the others are not, and what overlaps a base span
without being one is left out. The base rules' own tests (checksum, range of parts, leading
plus) are no features, so a candidate is judged by its shape and surroundings. The output is
calibrated on the sample's other documents, and per kind the threshold is the least at which
the selected candidates are right with the wanted precision. A selected candidate that
overlaps no base span is added, with the kind's name and ``_like``, best first, without
overlaps; base spans always stay.

Every rule runs in time linear in the text. Defined cases: null and empty texts have no
spans; repeated rows are each scanned; without candidates in the sample nothing is added;
extra columns are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandflow.llm.subword import calibrate
from demandflow.session import ship_package

KINDS = ("email", "ip", "card", "phone")
#: Bound of the sample: documents looked at, and candidates kept of them.
MAX_DOCS, MAX_CANDIDATES = 20_000, 40_000
#: Share of the selected candidates that must be right by the weak labels of the documents kept for
#: calibration (the labels miss what no rule and no word marks, so the true share is higher).
PRECISION = 0.9
#: Words that announce personal data.
CUES = ("mail email e-mail contact write", "ip address host server client", "card visa mastercard credit account",
        "phone tel telephone call mobile fax")

_SPELLED = re.compile(r"[ (\[](?:dot|DOT)[ )\]]")
_ANY = re.compile(r"[0-9@]|[ (\[](?:dot|DOT)[ )\]]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost, without overlaps per kind, failing
    matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        begin = at
        while m and begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if m and begin < at:
            out.append((0, begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = list(re.finditer("[0-9]+", m.group()))
            for k in range(0, len(parts) - 3, 4):
                if all(int(x) <= 255 for x in (p.group()[-19:] if not p.group()[:-19].strip("0") else "999" for p in parts[k:k + 4])):
                    out.append((1, m.start() + parts[k].start(), m.start() + parts[k + 3].end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_WIDE = (
    (0, re.compile(r"[^\s@,;<>()\[\]\"']{1,64}+@[^\s@,;<>()\[\]\"']{1,255}+")),
    (0, re.compile(r"\b[\w.-]{1,64}(?: (?:at|AT) | ?[(\[](?:at|AT)[)\]] ?)[\w-]{1,63}(?:(?: (?:dot|DOT) | ?[(\[](?:dot|DOT)[)\]] ?)[\w-]{1,63}){1,4}")),
    (1, re.compile(r"[0-9]{1,10}+(?:[.][0-9]{1,10}+){2,7}+")),
    (1, re.compile(r"[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}+")),
    (2, re.compile(r"[0-9](?:[ .-]?[0-9]){12,23}+")),
    (3, re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,3}[0-9]){6,17}+")),
)


#: A run of digits with separators, and the groups in it.
_RUN = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,3}[0-9])*+")
_GROUP = re.compile(r"[^ ]+")


def _parts(text: str) -> set[tuple[int, int, int]]:
    """The numbers of runs that hold several, as phones and cards: a run is cut before a plus and
    around a group of 13 digits or more, or four groups of four."""
    out = set()
    for m in _RUN.finditer(text):
        groups = list(_GROUP.finditer(m.group()))
        digits = [len(_digits(g.group())) for g in groups]
        cuts = {0, len(groups)}
        for i, g in enumerate(groups):
            if g.group()[:1] == "+":
                cuts.add(i)
            if digits[i] >= 13:
                cuts |= {i, i + 1}
            elif digits[i:i + 4] == [4] * 4 and all(len(x.group()) == 4 for x in groups[i:i + 4]):
                cuts |= {i, i + 4}
        cuts = sorted(cuts)
        for i, j in zip(cuts, cuts[1:]) if len(cuts) > 2 else ():
            n, span = sum(digits[i:j]), (m.start() + groups[i].start(), m.start() + groups[j - 1].end())
            out |= {(kind, *span) for kind, least, most in ((2, 13, 24), (3, 7, 18)) if least <= n <= most}
    return out


class Spans:
    """Disjoint intervals in order; whether one overlaps them takes a binary search."""

    def __init__(self, spans=()):
        self.start, self.end = [], []
        for a, b in sorted(spans):
            if self.end and a < self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.start, b) - 1
        return i >= 0 and self.end[i] > a

    def add(self, a: int, b: int) -> None:
        """A further interval that meets none."""
        i = bisect_left(self.start, a)
        self.start.insert(i, a)
        self.end.insert(i, b)


def candidates(text: str, base: list | None = None) -> list[tuple[int, int, int]]:
    """Overlapping proposals (kind, start, end), the base spans among them."""
    out = set(base_spans(text) if base is None else base)
    for n, (kind, pattern) in enumerate(_WIDE):
        if n == 0 and "@" not in text or n == 1 and not _SPELLED.search(text):
            continue
        out |= {(kind, m.start(), m.end()) for m in pattern.finditer(text)}
    return sorted(out | _parts(text))


def announced(text: str, kind: int, start: int) -> bool:
    """Whether a word of the kind stands shortly before."""
    lead = text[max(0, start - 40):start].lower()
    return bool(lead.strip()) and any(re.search(rf"\b{w}\b", lead) for w in CUES[kind].split())


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    s = text[start:end]
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    lead = text[max(0, start - 40):start].lower()
    tail = s.rpartition(".")[2]
    return [
        kind, len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"), s.count("/") + s.count(":"), s.count("@"),
        len(s.partition("@")[0]), tail.isalpha() * len(tail), sum(c.isalpha() for c in s),
        before.isalnum(), before.isspace() or not before, after.isalnum(), after.isspace() or not after, after in tuple(".,;:!?"),
        *(any(re.search(rf"\b{w}\b", lead) for w in c.split()) if lead.strip() else False for c in CUES),
    ]


class BoostedTrees:
    """Logistic gradient boosting with histogram trees of fixed depth."""

    def __init__(self, depth: int = 4, trees: int = 40, rate: float = 0.25, bins: int = 32):
        self.depth, self.trees, self.rate, self.bins = depth, trees, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.forest, score = [], np.full(len(y), self.start)
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h, node, tree = y - p, p * (1 - p) + 1e-6, np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                for n in range(2 ** level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == n)
                    best = (1e-6, None)
                    for f in range(x.shape[1]) if len(rows) > 1 else ():
                        if not len(cuts[f]):
                            continue
                        gs = np.cumsum(np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1))
                        hs = np.cumsum(np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1))
                        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (f, float(cuts[f][k]), k))
                    if best[1]:
                        tree[n] = best[1][:2]
                        node[rows] = np.where(code[rows, best[1][0]] > best[1][2], 2 * n + 2, 2 * n + 1)
            for n in np.unique(node):
                rows = node == n
                tree[int(n), "leaf"] = float(self.rate * g[rows].sum() / (h[rows].sum() + 1))
                score[rows] += tree[int(n), "leaf"]
            self.forest.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start if hasattr(self, "start") else 0.0)
        for tree in self.forest:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                for n in np.unique(node):
                    if int(n) in tree:
                        f, cut = tree[int(n)]
                        rows = node == n
                        node[rows] = np.where(x[rows, f] > cut, 2 * n + 2, 2 * n + 1)
            out += np.array([tree.get((int(n), "leaf"), 0.0) for n in node])
        return out


class Selector:
    """Trees, calibration and a threshold per kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.limits = np.full(len(KINDS), 2.0)  # nothing is selected
        self.trees = None
        if not len(x) or not 0 < y[~held].sum() < (~held).sum() or not held.any():
            return
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        z = self.trees.raw(x[held])
        self.slope, self.offset = calibrate(z, y[held])
        p, right, kinds = self.probability(x[held]), y[held], x[held][:, 0]
        for k in range(len(KINDS)):
            order = np.argsort(-p[kinds == k], kind="stable")
            if len(order):
                q, r = p[kinds == k][order], right[kinds == k][order]
                good = np.cumsum(r) / np.arange(1, len(r) + 1) >= PRECISION
                last = np.r_[q[1:] != q[:-1], True]  # thresholds do not cut ties
                if (good & last).any():
                    self.limits[k] = max(0.5, float(q[np.flatnonzero(good & last)[-1]]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x) + self.offset, -500, 500)))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Selected candidates that overlap no base span and no better one."""
        if self.trees is None:
            return []
        own = Spans((a, b) for _, a, b in base)
        free = [c for c in candidates(text, base) if not own.meets(c[1], c[2])]
        if not free:
            return []
        p = self.probability(np.array([describe(text, *c) for c in free], dtype=np.float64))
        taken, got = Spans(), []
        for _, _, c in sorted((-q, c[1] - c[2], c) for q, c in zip(p, free) if q >= self.limits[c[0]]):  # best, then longest
            if not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                got.append(c)
        return sorted(got)


def _examples(df: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and calibration marks of the sample's candidates: documents by a hash of
    the key, as many as the bound on average."""
    n = df.count()
    share = min(1.0, MAX_DOCS / max(1, n))
    low = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(3))
    some = df.where(F.pmod(low, F.lit(10 ** 9)) < F.lit(int(share * 10 ** 9))).select(
        F.col(text).cast("string").alias("text"), (F.pmod(F.shiftright(low, 32), F.lit(3)) == 0).alias("held"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and _ANY.search(t):
                    base = set(base_spans(t))
                    own = Spans((a, b) for _, a, b in base)
                    rows += [([float(v) for v in describe(t, *c)], c in base or announced(t, c[0], c[1]), held)
                             for c in candidates(t, base) if c in base or not own.meets(c[1], c[2])]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.bool_()),
                                   pa.array([r[2] for r in rows], pa.bool_())], names=["x", "y", "held"])

    got = some.mapInArrow(make, "x array<double>, y boolean, held boolean").orderBy(F.xxhash64("x")).limit(MAX_CANDIDATES).collect()
    return (np.array([r.x for r in got], dtype=np.float64), np.array([r.y for r in got], dtype=np.float64),
            np.array([r.held for r in got], dtype=bool))


def with_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``_personal``: spans (kind, start, end, base) in code points, end exclusive; the
    base spans by kind, then start, and after them the added ones."""
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(Selector(*_examples(df, key, text)))  # some trees
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    @F.arrow_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = []
            for at in range(0, len(texts), 256):
                for t in texts.slice(at, 256).to_pylist():
                    if not t or not _ANY.search(t):
                        made.append([])
                        continue
                    base = base_spans(t)
                    made.append([{"kind": KINDS[k], "start": a, "end": b, "base": True} for k, a, b in base] + [
                        {"kind": KINDS[k] + "_like", "start": a, "end": b, "base": False} for k, a, b in model.value.added(t, base)])
            yield pa.array(made, out)

    return df.withColumn("_personal", spans(F.col(text).cast("string")))
