"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is a bag of lower-cased words weighted by their counts. For each slot ``k`` and
word, hashes of (word, k) give ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``, the same for
every document. With weight ``w`` the word's sample is
``t = floor(ln w / r + b)``, ``ln a = ln c - r (t - b) - r``, and a document's sample in
slot ``k`` is its word of least ``a``. Two documents choose the same (word, t) with a
probability equal to their generalised Jaccard similarity sum(min) / sum(max). ``a`` is
a function of (k, word, t), so the least ``a`` itself names the choice: a slot is one
grouped minimum, and the likeness of two fingerprints is the share of equal slots.

The next document in key order comes from ranges of keys: split points are keys of the
table (a bounded list), each range's first document is also sent to the range before
it, and ``lead`` runs inside a range. Texts are shuffled once, by range; counting,
sampling and comparing stay in that partitioning.

Defined cases: null texts count as empty; texts without words have an empty sample in
every slot, equal to each other only; null keys come first; rows of equal key are
ordered by text; repeated rows are kept; extra columns are ignored; one document is
its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from demandflow.llm.common import words

#: Documents per key range, and the most ranges (beyond it ranges grow, results stay).
RANGE_ROWS, MAX_RANGES = 2_000, 65_536
LOWEST = -(2 ** 63)
#: Slots handled by one row.
AT_ONCE = 4


def _key_ranges(df: DataFrame, order: Column) -> list[int]:
    """Sorted first keys of the ranges; every one is a key of the table."""
    rows, least = df.agg(F.count("*"), F.min(order)).first()
    n = min(MAX_RANGES, -(-rows // RANGE_ROWS))
    if n < 2:
        return [] if least is None else [least]
    at = [i / n for i in range(1, n)]
    inner = df.agg(F.percentile_approx(order, at, max(10_000, 4 * n))).first()[0]
    return sorted({least, *inner})


def _range_of(order: Column, firsts: list[int]) -> Column:
    """Index of the last first key not above ``order``, by binary search."""
    table = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # folded to a constant
    steps = [1 << b for b in reversed(range(len(firsts).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        (at + s < len(firsts)) & (F.get(table, at + s) <= order), at + s).otherwise(at))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """range, place, copy, key, text, next: every row with the text of the next row in key order
    (after the last: the first). Rows with ``copy`` only repeat a range's first row."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    firsts = _key_ranges(df, order)
    body = df.select(order.alias("order"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if not firsts:
        firsts = [0]
    body = body.withColumn("at", _range_of(F.col("order"), firsts))
    first = F.get(F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>"), F.col("at")) == F.col("order")
    before = F.pmod(F.col("at") - 1, F.lit(len(firsts)))
    places = F.when(first, F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("copy")), F.struct(before.alias("range"), F.lit(True).alias("copy")))
                    ).otherwise(F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("copy"))))
    dealt = body.select(F.explode(places).alias("p"), "order", "key", "text").select("p.range", "p.copy", "order", "key", "text")
    w = Window.partitionBy("range").orderBy("copy", "order", "text")
    return dealt.select("range", F.row_number().over(w).alias("place"), "copy", "key", "text", F.lead("text").over(w).alias("next"))


def _gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) at probabilities ``u``: the root of 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 64.0)
    for _ in range(100):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """A constant array (one literal string that the optimizer folds)."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _random(k: Column) -> tuple[Column, Column, Column]:
    """ln c, r and b of a word in slot ``k``, from the bits of one hash: quantiles of the gamma law,
    4096 equal parts, the lowest of c in 4096 further parts (that is where the least are found)."""
    mid = (np.arange(4096) + 0.5) / 4096
    h = F.xxhash64("term", k)
    part = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(4095).cast("long")).cast("int")
    ln_c = F.when(part(12) == 0, F.get(_table(np.log(_gamma_quantiles(mid / 4096))), part(24))).otherwise(
        F.get(_table(np.log(_gamma_quantiles(mid))), part(12)))
    b = (F.shiftrightunsigned(h, 36).cast("double") + 0.5) * F.lit(2.0 ** -28)
    return ln_c, F.get(_table(_gamma_quantiles(mid)), part(0)), b


def signatures(rows: DataFrame, slots: int, facts: list[Column]) -> DataFrame:
    """``rows`` (range, place, text, edited) to (range, place, own, other, facts): arrays of the least
    ln a per slot of the text and of the edited text, and the given whole numbers of the row. Both
    texts' words are counted together, so a word's random numbers are made once. A row's facts
    travel as further rows among its words, so that texts are neither shuffled again nor joined.
    A row handles a few slots at a time: code of that size is compiled well."""
    both = rows.select("range", "place", words(F.lower("text")).alias("w"), words(F.lower("edited")).alias("e"),
                       F.array(*[f.cast("string") for f in facts]).alias("f"))
    n, m = F.size("w"), F.size("w") + F.coalesce(F.size("e"), F.lit(0))
    items = both.select("range", "place", n.alias("n"), m.alias("m"), F.concat("w", "e", "f").alias("items"))
    items = items.select("range", "place", "n", "m", F.posexplode_outer("items").alias("pos", "word"))
    is_fact = F.col("pos") >= F.col("m")
    counted = items.groupBy("range", "place", F.when(is_fact, F.col("pos") - F.col("m") + 1).otherwise(0).alias("fact"),
                            F.when(is_fact, F.col("word").cast("long")).otherwise(F.xxhash64("word")).alias("term")).agg(
        F.sum((F.col("pos") < F.col("n")).cast("int")).alias("c0"),
        F.sum(((F.col("pos") >= F.col("n")) & ~is_fact).cast("int")).alias("c1"))
    groups = F.when(F.col("fact") == 0, F.array(*[F.lit(g) for g in range(0, slots, AT_ONCE)])).otherwise(F.array(-F.col("fact")))
    logs = counted.select("range", "place", "term", F.when(F.col("c0") > 0, F.log("c0")).alias("l0"), F.when(F.col("c1") > 0, F.log("c1")).alias("l1"),
                          F.explode_outer(groups).alias("g"))
    some = range(min(AT_ONCE, slots))
    random = logs.select("range", "place", "g", "l0", "l1", F.when(F.col("g") < 0, F.col("term")).alias("value"),
                         *[c.alias(f"{n}{k}") for k in some for n, c in zip("crb", _random(F.col("g") + k))])

    def least(log: str, k: int) -> Column:
        c, r, b = (F.col(f"{n}{k}") for n in "crb")
        return F.min(c - r * (F.floor(F.col(log) / r + b) - b) - r).alias(f"{log}_{k}")

    found = random.groupBy("range", "place", "g").agg(F.max("value").alias("value"), *[least(x, k) for x in ("l0", "l1") for k in some])
    arrays = [F.array(*[F.col(f"{x}_{k}") for k in some]).alias(x) for x in ("l0", "l1")]
    lists = found.select("range", "place", F.struct("g", "value", *arrays).alias("s")).groupBy("range", "place").agg(F.array_sort(F.collect_list("s")).alias("s"))
    none = F.array_repeat(F.lit(None).cast("double"), slots)
    after = lambda x: F.when(F.size("s") > len(facts), F.flatten(F.slice(x, len(facts) + 1, F.size("s")))).otherwise(none)
    return lists.select("range", "place", after("s.l0").alias("own"), after("s.l1").alias("other"),
                        F.reverse(F.slice("s.value", 1, len(facts))).alias("facts"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)) / F.size(a)


def fingerprint_text(signature: Column) -> Column:
    """Eight hex digits per slot."""
    return F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.lower(F.hex(
        F.xxhash64(x).bitwiseAND(F.lit(2 ** 32 - 1).cast("long")))), 8, "0")))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = 64) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last half replaced by the beginning of the next text."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(df, key, text).withColumn("edited", F.when(~F.col("copy"), F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    quarters = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10) for i in range(4)]  # signed: they fit a long
    made = signatures(rows, slots, [F.col("key"), n, F.col("copy").cast("int"), *quarters])
    following = F.lead("own").over(Window.partitionBy("range").orderBy("place"))
    out = made.withColumn("following", following).where(F.get("facts", F.lit(2)) == 0)
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.get("facts", F.lit(3 + i)))), 16, "0") for i in range(4)])
    return out.select(F.get("facts", F.lit(0)).alias("key"), F.get("facts", F.lit(1)).alias("n_chars"), sha.alias("edited_sha256"),
                      fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("other")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
