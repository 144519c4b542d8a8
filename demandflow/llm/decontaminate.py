"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts are turned into templates: punctuation is dropped, letters are lower-cased, and
numbers (digits or number words), names (capitalised words inside a sentence) and units
that follow a number become typed placeholders. Every window of ``window`` template
tokens is hashed and joined with the windows of the benchmark, so a question whose
numbers and names were exchanged still meets its source. The exchanged names
are then checked: over all windows on one diagonal of a document and an item, a name is odd
if it stands for two. Exchanged windows that hold an odd pair of names do not count, and
none of a diagonal where half of the different pairs or more are odd; numbers and units may
become equal or differ as they like. An exchanged window needs ``min_literal`` tokens that are no placeholders. Beside the
templates every window is hashed with its words as they are (lower case, no punctuation),
whatever they are: identical passages are found however many numbers and names they
hold and whatever stands before them.

The documents are read once and not shuffled: only windows that meet a benchmark window are. The
benchmark's windows are written to the shared folder, so their true size decides
whether Spark broadcasts them; otherwise both sides are exchanged and adaptive
execution splits frequent windows.

Defined cases: null texts count as empty and match nothing; items with fewer tokens
than ``window`` are searched as one shorter window of all their tokens, items of fewer than
``min_tokens`` not at all; repeated documents and items are each reported; null
ids are kept; extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandflow.llm.common import SPACES, free_name, stored

NUMBER, NAME, UNIT = "", "", ""
#: Words that stand for numbers, and units that may follow one.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                "hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
         "pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes "
         "hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent "
         "degree degrees mph kmh meter meters metre metres").split()


#: Letters, digits and the space of ASCII, which most characters are: looked up in one table before any category.
PLAIN = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _clean(text: Column) -> Column:
    """Letters and digits in words with spaces between; names carry a mark in front.
    Patterns begin with one plain character or class, which the matcher skips to fastest."""
    t = F.coalesce(text, F.lit(""))
    for c in SPACES[1:] + NUMBER + NAME + UNIT:  # a search for bytes each; marks in the text go
        t = F.replace(t, F.lit(c), F.lit(" " if c in SPACES else ""))
    # the branch that never matches makes the look-behind reach letters of two UTF-16 units
    t = F.regexp_replace(t, r" (?=\p{Lu}\p{Ll})(?<=(?:[\p{L}\p{N},;]|(?!)..) )", " " + NAME)
    return F.regexp_replace(t, rf"[[^{PLAIN}]&&[^\p{{L}}\p{{M}}\p{{N}}{NAME}]]+", "")


def _template(low: Column) -> Column:
    """Lower-case clean text with placeholders of names and of numbers in digits; a word from its
    first digit on is a number."""
    return F.regexp_replace(F.regexp_replace(low, rf"{NAME}[^ ]+", NAME), r"\p{N}[^ ]*", NUMBER)


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _split(t: Column) -> Column:
    """Words of a string that only holds spaces as white space, of which some may be side by side."""
    return F.array_remove(F.split(t, " "), "")


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row_hash, tok (words of the template), val (the words as they are, null if equal)."""
    t = F.col(text).cast("string")
    base = df.select(F.col(key).alias("key"), F.xxhash64(F.col(key), t).alias("row_hash"), F.lower(_clean(t)).alias("low"))
    # columns that are used more than once are computed once per document, so each step is a select
    base = base.select("key", "row_hash", _split(_template(F.col("low"))).alias("tok"), _split(F.replace("low", F.lit(NAME), F.lit(""))).alias("val"))
    base = base.withColumn("tok", F.transform("tok", lambda x: F.when(x.isin(NUMBER_WORDS), NUMBER).otherwise(x)))
    unit = lambda x, i: x.isin(UNITS) & F.endswith(F.get("tok", i - 1), F.lit(NUMBER))
    base = base.withColumn("tok", F.transform("tok", lambda x, i: F.when(unit(x, i), UNIT).otherwise(x)))
    return base.withColumn("val", F.when(F.col("tok") != F.col("val"), F.col("val")))


def _windows(words: DataFrame, sizes: list[int]) -> DataFrame:
    """The columns of ``words`` without tok and val, and n, pos, typed, hash, values of every window
    of n tokens, for each n of ``sizes``. Each window gives one row hashed over its words (typed
    false); one with placeholders gives a second, hashed over its template. ``values``: hashes of
    the window's words as they are.

    Every word is hashed once; the hashes of 2, 4, ... words join two of half as many, and those of
    n words two of the longest such stretches, which overlap unless n is a power of two."""
    kept = [c for c in words.columns if c not in ("tok", "val")]
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    level = words.select(*kept, hashed("tok").alias("t"), hashed("val").alias("v"))
    # values as they are, template or null; a window's hash stands at its first word, the last ones reach past the end
    level = level.select(*kept, F.coalesce("v", "t").alias("values"), F.when(F.col("v").isNotNull(), F.col("t")).alias("t1"))
    level = level.withColumn("v1", F.col("values"))

    def joined(c: str, apart: int, *n: Column) -> Column:
        return F.zip_with(c, F.slice(c, apart + 1, F.size("values")), lambda x, y: F.xxhash64(*n, x, y))

    half = {n: 1 << max(n - 1, 1).bit_length() - 1 for n in sizes}  # the longest stretch below n
    step = 1
    while step < max(half.values()):
        level = level.select("*", *[joined(f"{c}{step}", step).alias(f"{c}{2 * step}") for c in "vt"])
        step *= 2
    whole = lambda c, n: F.slice(joined(f"{c}{half[n]}", n - half[n], F.lit(n)), 1, F.greatest(F.size("values") - (n - 1), F.lit(0)))
    level = level.select(*kept, "values", *[whole(c, n).alias(f"{c}_{n}") for n in sizes for c in "vt"])
    # a template without placeholders has the hash of its words: no second row
    level = level.select(*kept, "values", *[c for n in sizes for c in (
        F.col(f"v_{n}"), F.zip_with(f"v_{n}", f"t_{n}", lambda x, y: F.when(x != y, y)).alias(f"t_{n}"))])
    blocks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c == "t").alias("typed"), F.col(f"{c}_{n}").alias("hashes")) for n in sizes for c in "vt"])
    level = level.select(*kept, "values", F.inline(blocks)).select(*kept, "values", "n", "typed", F.posexplode("hashes").alias("pos", "hash"))
    return level.where("hash is not null").select(*kept, "n", "pos", "typed", "hash", F.slice("values", F.col("pos") + 1, F.col("n")).alias("values"))


def _benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int, min_literal: int, min_tokens: int) -> DataFrame:
    """item, item_hash, n, item_pos, typed, hash, item_values, names (offsets of the names) of the
    windows of the benchmark that count: those of ``window`` tokens, all tokens of a shorter item
    of ``min_tokens`` or more, by their templates if ``min_literal`` tokens are no placeholders.
    A document's window with the same hash has the same template, so it counts as well."""
    words = _words(benchmark, item, text).withColumn("template", F.col("tok"))
    n = F.size("template")
    sizes = [*range(max(1, min(min_tokens, window)) if min_tokens else window, window + 1)]
    found = _windows(words, sizes).where(F.col("n") == F.least(n, F.lit(window)))
    found = found.withColumn("template", F.slice("template", F.col("pos") + 1, F.col("n")))
    found = found.where(~F.col("typed") | (F.size(F.filter("template", lambda x: ~_is_slot(x))) >= min_literal))
    names = F.filter(F.transform("template", lambda x, i: F.when(x == NAME, i)), lambda i: i.isNotNull())
    return found.select(F.col("key").alias("item"), F.col("row_hash").alias("item_hash"), "n", F.col("pos").alias("item_pos"), "hash",
                        F.when(F.col("typed"), F.col("values")).alias("item_values"), F.when(F.col("typed"), names).alias("names"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text", window: int = 8, min_literal: int = 5, min_tokens: int = 3) -> DataFrame:
    """Evidence windows: key, row_hash, pos, item, item_pos, exchanged (boolean)."""
    bench = stored(_benchmark_windows(benchmark, item, item_text, window, min_literal, min_tokens), "benchmark")
    sizes = sorted(r.n for r in bench.select("n").distinct().collect())  # at most ``window`` numbers
    # one pass over the documents for all sizes; hashes of different sizes or kinds differ
    hits = _windows(_words(docs, key, text), sizes or [window]).drop("n").join(bench.drop("n"), "hash")
    pair = lambda i: F.struct(F.get("values", i).alias("ours"), F.get("item_values", i).alias("theirs"))
    hits = stored(hits.select("key", "row_hash", "pos", "item", "item_hash", "item_pos", "typed", F.transform("names", pair).alias("pairs"),
                              (F.col("typed") & (F.col("values") != F.col("item_values"))).alias("exchanged")), "hits")
    diagonal = ["row_hash", "item_hash", "diagonal"]
    typed = hits.where("typed").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    # a diagonal has at most as many pairs of names as the item has words
    names = typed.select(*diagonal, F.explode("pairs").alias("p")).distinct()
    ours, theirs = (F.count("*").over(Window.partitionBy(*diagonal, F.col(f"p.{side}"))) for side in ("ours", "theirs"))
    names = names.select(*diagonal, "p", ((ours > 1) | (theirs > 1)).alias("odd"))
    odd = names.groupBy(*diagonal).agg(F.count("*").alias("n_names"), F.collect_set(F.when(F.col("odd"), F.col("p"))).alias("odd"))
    odd = stored(odd.where(F.size("odd") > 0), "odd")
    exchanged = typed.where("exchanged").join(odd, diagonal, "left").where(
        F.col("odd").isNull() | ((2 * F.size("odd") < F.col("n_names")) & ~F.arrays_overlap("pairs", "odd")))
    cols = ["key", "row_hash", "pos", "item", "item_pos", "exchanged"]
    # windows with equal values are there once more with their words
    return hits.where("not typed").select(*cols).union(exchanged.select(*cols))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """One row per document (key, row_hash) that holds a passage of the benchmark: the number of
    evidence windows, of exchanged ones, and the items, ascending."""
    found = matches(docs, benchmark, key=key, **parameters)
    per_item = found.groupBy("key", "row_hash", "item").agg(F.count("*").alias("n"), F.sum(F.col("exchanged").cast("long")).alias("x"))
    return per_item.groupBy("key", "row_hash").agg(F.sum("n").alias("n_windows"), F.sum("x").alias("n_exchanged"), F.array_sort(F.collect_list("item")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark; columns unchanged."""
    row, other = free_name(docs, "_row"), free_name(docs, "_bad")
    bad = stored(contaminated(docs, benchmark, key=key, text=text, **parameters).select(F.col("row_hash").alias(other)).distinct(), "contaminated")
    marked = docs.withColumn(row, F.xxhash64(F.col(key), F.col(text).cast("string")))
    return marked.join(bad, F.col(row) == F.col(other), "left_anti").select(*docs.columns)
