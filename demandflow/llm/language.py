"""Language identification by word-first backoff.

A word (a run of letters and marks, lower-cased) that the model knows adds the logarithm of
its relative frequency in each language. An unseen word falls back to its character n-grams,
the word's ends marked: the longest length of which any n-gram is known decides, by the mean
of their logarithms, less a penalty per step down; a word without any known n-gram says
nothing. The sum over all words of a text, damped by the root of their number, gives the
languages' probabilities by softmax.

Training takes a sample of each language's labelled rows by a hash, ``max_rows`` expected
(all, if fewer): tasks return the words of each language with their numbers, added up as
they go and again by Spark; n-gram counts follow from the distinct words. The languages
with most rows, and in each the most frequent words and n-grams of each length, make the
model: its size is bounded by parameters, whatever the data.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text with
letters of which nothing is known gets the most frequent language; without a learned
language everything is ``und``; null labels are not learned from; equal scores go by the
language's name; repeated rows each count and each get a result; an empty table gives no
row; extra columns are passed through. Memory: a text, its distinct words, and the model.
"""

from __future__ import annotations

from collections import ChainMap, Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from demandflow.llm.common import stored
from demandflow.session import ship_package

#: Lengths of the n-grams, longest first, and what each step down costs.
GRAMS, STEP = (5, 4, 3, 2, 1), 0.5
#: Bounds of training and model: rows per language (expected), languages, words per language,
#: n-grams per language and length, numbers in a table (which bounds words and n-grams further
#: where there are many languages).
MAX_ROWS, MAX_LANGUAGES, MAX_WORDS, MAX_GRAMS, MAX_NUMBERS = 10_000, 64, 30_000, 10_000, 16_000_000
#: Words held by a training task before it hands them on, and the longest word (in characters)
#: that is learned as a word; longer ones still give n-grams of their beginning when learned.
HELD, LONGEST = 200_000, 64

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between end marks."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        lang, word = zip(*held) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(held.values(), pa.int64())],
                                          names=["lang", "word", "n"])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # few texts at a time are Python strings
            for lang, text in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()):
                for word, n in Counter(words(text)).items():
                    held[lang, word[:LONGEST]] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
    yield out()


def all_grams(word: str) -> list[str]:
    return [g for n in GRAMS for g in grams(word, n)]


class Model:
    """Languages by name, the logarithm of their share of rows, and per length of unit (0: whole
    words) the row of each unit in a table of log frequencies."""

    def __init__(self, langs: list[str], rows: list[int], units: list[tuple[str, str, int, int]]):
        """``units``: (language, word or n-gram, its length as an n-gram or 0, count)."""
        self.langs = langs
        place = {x: i for i, x in enumerate(langs)}
        self.prior = np.log(np.array(rows, np.float64) / max(1, sum(rows)))
        self.row: dict[int, dict[str, int]] = {size: {} for size in (0, *GRAMS)}
        for _, unit, size, _ in units:
            self.row[size].setdefault(unit, len(self.row[size]))
        self.logs = {}
        for size, row in self.row.items():
            count = np.full((len(row), len(langs)), 0.5)  # an absent unit counts a half
            for x, unit, s, n in units:
                if s == size:
                    count[row[unit], place[x]] += n
            self.logs[size] = np.log(count / (count.sum(axis=0) + 0.5)).astype(np.float32)

    def of_words(self, some: list[str]) -> np.ndarray:
        """A row per word: log frequencies of the word or of its longest known n-grams; a last
        column is 1, or 0 where nothing is known (then all are)."""
        out = np.zeros((len(some), len(self.langs) + 1))
        which: dict[int, tuple[list, list, list]] = {size: ([], [], []) for size in self.row}
        whole = self.row[0]
        for i, word in enumerate(some):
            if word in whole:
                found, size = [whole[word]], 0
            else:
                for size in GRAMS:
                    row = self.row[size]
                    found = [row[g] for g in grams(word, size) if g in row]
                    if found:
                        break
            if found:
                at, count, rows = which[size]
                at.append(i)
                count.append(len(found))
                rows += found
        for size, (at, count, rows) in which.items():
            if at:
                n = np.array(count)
                sums = np.add.reduceat(self.logs[size][rows].astype(np.float64), np.cumsum(n) - n)
                step = 0 if size == 0 else STEP * (GRAMS.index(size) + 1)
                out[at, :-1] = sums / n[:, None] - step
                out[at, -1] = 1
        return out

    def predict(self, texts: list[str | None], memory: Memory) -> list[tuple[str, float]]:
        """Language and probability of each text."""
        found = [Counter(words(t)) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        place = memory.places({w for c in found for w in c}, self)
        out = []
        for count in found:
            if not count:
                out.append(("und", 0.0))
                continue
            n = np.fromiter(count.values(), np.float64, len(count))
            total = n @ memory.rows[np.fromiter(map(place.__getitem__, count), np.int64, len(count))]
            z = self.prior + total[:-1] / max(1.0, total[-1]) ** 0.5
            p = np.exp(z - z.max())
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best] / p.sum())))
        return out


class Memory:
    """Rows of the words met by a task: the first ``HELD`` stay, the others are made anew."""

    def __init__(self, langs: int):
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, langs + 1))

    def places(self, some: set[str], model: Model) -> dict[str, int]:
        new = [w for w in some if w not in self.known]
        if not new:
            return self.known
        at = len(self.known)
        if at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:at], np.zeros((at + 2 * len(new), self.rows.shape[1]))])
        self.rows[at:at + len(new)] = model.of_words(new)
        places = dict(zip(new, range(at, at + len(new))))
        if at + len(new) <= HELD and max(map(len, new)) <= LONGEST:
            self.known.update(places)
            return self.known
        return ChainMap(places, self.known)


def _most_frequent(units: DataFrame, words: int, grams: int) -> DataFrame:
    """At most so many units per language and length, the most frequent first and ties by hash,
    without sorting a language's units: they are counted by (frequency, hash part) first."""
    units = stored(units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(256))), "units")
    group = ["lang", "size", "n", "part"]
    before = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "part").rowsBetween(Window.unboundedPreceding, 0)
    steps = units.groupBy(*group).agg(F.count("*").alias("c")).withColumn("total", F.sum("c").over(before))
    return units.join(steps.where(F.col("total") <= F.when(F.col("size") == 0, words).otherwise(grams)).select(*group), group)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS,
        max_languages: int = MAX_LANGUAGES, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the rows of ``labelled`` whose ``lang`` is not null."""
    ship_package(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    sizes = sorted(map(tuple, sizes.collect()))
    if not sizes:
        return Model([], [], [])
    share = F.create_map(*[F.lit(v) for x, n in sizes for v in (x, min(1.0, max_rows / n))])
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < F.try_element_at(share, "lang") * (1 << 20)
    counts = rows.where(drawn).select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
    counts = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams_of = F.udf(all_grams, "array<string>", useArrow=True)
    pieces = counts.select("lang", F.explode(grams_of("word")).alias("unit"), "n").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    units = counts.select("lang", F.col("word").alias("unit"), F.lit(0).alias("size"), "n").unionByName(
        pieces.select("lang", "unit", F.char_length("unit").alias("size"), "n"))
    most = MAX_NUMBERS // len(sizes) ** 2
    kept = _most_frequent(units, min(max_words, most), min(max_grams, most)).select("lang", "unit", "size", "n")
    return Model([x for x, _ in sizes], [n for _, n in sizes], sorted(map(tuple, kept.collect())))  # bounded by the parameters


def with_language(docs: DataFrame, labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
                  out: str = "_lang", **bounds) -> DataFrame:
    """``docs`` with struct ``out`` (lang, score), learned from ``labelled`` (lang, text)."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, lang, text, key, **bounds))

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory(len(model.value.langs))
        for some in texts:
            found = []
            for at in range(0, len(some), 64):  # few texts at a time are Python strings
                found += model.value.predict(some.slice(at, 64).to_pylist(), memory)
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                                             names=["lang", "score"])

    return docs.withColumn(out, predicted(F.col(text).cast("string")))
