"""Secret scan with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over the trigrams that a
match must contain (lower-cased): literal runs, alternatives and small character classes
are followed through the parsed expression; a part with no mandatory trigram asks for
nothing. Texts are indexed in blocks of a few megabytes: the postings of the trigrams
that any rule mentions are made with array operations over the block's bytes. A rule's
candidates are the intersections and unions of postings that its query names; only they
are verified with the expression itself. A rule without mandatory trigrams scans all
texts of the block.

A block lives inside one task, so nothing is shuffled and a lost executor costs its
blocks only. Expressions run in time linear in the text.

Defined cases: null and empty texts have no secrets; matches of one rule do not
overlap; repeated rows are each scanned; extra columns are passed through; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C, _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandflow.session import ship_package

#: Bytes and texts of an index block (one longer text is a block of its own).
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 2048
#: Most strings a literal run may stand for.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """``check`` drops a match (no retry); spans are those of the whole match."""

    kind: str
    pattern: str
    check: Callable[[re.Match], bool] | None = None


#: Base rules in the order of their kinds, then well-known token formats.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m.group(2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]+-[A-Za-z0-9-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
)
BASE_KINDS = ("assign", "access", "hex")

# A query is True (anything), a trigram, or ("and" | "or", parts).


def _all(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal(strings: set[str]):
    """What one of the strings must contain."""
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg) -> set[str] | None:
    """All strings a part stands for (lower case, ASCII), if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out = set()
        for o, a in arg:
            if o is C.LITERAL and a < 128:
                out.add(chr(a).lower())
            elif o is C.RANGE and a[1] < 128 and a[1] - a[0] < MOST:
                out |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        one = _sequence_strings(inner)
        if one is None or high > 8:
            return None
        out, run = set(), {""}
        for n in range(high + 1):
            if n >= low:
                out |= run
            run = {a + b for a in run for b in one}
            if len(run) > MOST or len(out) > MOST:
                return None
        return out
    return {""} if op is C.AT else None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _strings(op, arg)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(items):
    parts, run = [], {""}
    for op, arg in items:
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_literal(run))
        run = one if one is not None and len(one) <= MOST else {""}
        if one is None:
            if op is C.SUBPATTERN:
                parts.append(_query(arg[-1]))
            elif op is C.BRANCH:
                parts.append(_any([_query(x) for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2]))
    return _all([*parts, _literal(run)])


def trigram_query(pattern: str):
    """The Boolean query that every match of ``pattern`` satisfies (True: no trigram is mandatory)."""
    return _query(P.parse(pattern))


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class TrigramIndex:
    """Postings of the trigrams that a set of queries mentions, over a block of texts."""

    def __init__(self, queries: list):
        self.ids = {g: i + 1 for i, g in enumerate(sorted(set().union(*map(trigrams, queries), set())))}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.ids.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Trigram number to the ascending places of the texts that contain it."""
        flat = np.frombuffer(b"\0\0".join(x.lower() for x in texts), np.uint8)
        if len(flat) < 3 or not self.ids:
            return {}
        code = flat[:-2].astype(np.uint32)
        code <<= 8
        code |= flat[1:-1]
        code <<= 8
        code |= flat[2:]
        number = self.table[code]
        at = np.flatnonzero(number)
        starts = np.cumsum([0] + [len(x) + 2 for x in texts[:-1]])
        pair = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        which, place = pair // len(texts), pair % len(texts)
        cut = np.flatnonzero(np.diff(which)) + 1
        return {int(w[0]): p for w, p in zip(np.split(which, cut), np.split(place, cut)) if len(w)}

    def candidates(self, query, postings: dict, n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings.get(self.ids[query], np.zeros(0, np.int64))
        parts = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for p in sorted(parts[1:], key=len):
            out = np.intersect1d(out, p, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex([q for _, _, q in self.rules])

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule, end), ordered."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.postings([t.encode() for t in texts])
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.index.candidates(query, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[i]):
                    if rule.check is None or rule.check(m):
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]

    def scan(self, texts: Iterator[str]) -> Iterator[list[tuple[int, int, int]]]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BLOCK_BYTES or len(held) >= BLOCK_TEXTS:
                yield from self.block(held)
                held, size = [], 0
        if held:
            yield from self.block(held)


_SCANNER: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


SPAN = "array<struct<kind: string, start: int, end: int>>"


def with_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_secrets``: spans (kind, start, end) in code points, end exclusive, ordered
    by start, then rule."""
    ship_package(df.sparkSession)
    kinds = [r.kind for r in RULES]
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPAN)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = (t or "" for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist())
            yield pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in _scanner().scan(each)], out)

    return df.withColumn("_secrets", spans(F.col(text).cast("string")))
