"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. A document of n terms has the normaliser m = 100 - b + (b * n * N) div L
(b = 75; N documents with terms, L terms in all); a term of weight w occurring tf times adds
w * (10**9 * tf div (1000 * tf + 8 * m)).

Index: documents are cut into segments of bounded length, in place, and grouped by equal m
within a segment. Such a stratum is one row of the index table, its postings a compressed
Arrow record: the documents, the terms in order, and each term's postings in runs of equal
tf, highest tf first. Inside a stratum the
impact depends on tf alone, so it is computed once per tf, and the first run of a term gives
its bound. Every document lies in one stratum, so index rows are searched where they are
stored: no posting is exchanged.

Search: the queries are read in blocks of bounded length. One pass over the index counts the
documents of each term of the block; a second one ranks: for each query a task visits its
strata by descending bound and stops where the bound falls below the k-th best score so far.
At most k rows per query leave a task, and Spark merges them. The result is exact.

Defined cases: null and empty texts have no terms, are never found and do not count in N;
a query without known terms has no rows; documents that repeat (same key) are found one by
one; equal scores go by ascending key, null keys first; queries that repeat in key and text
are one query, queries with equal key and different texts are ranked each; empty tables give
no rows; other columns are ignored. Memory: a segment (or one longer document) when the
index is made, an Arrow batch of strata and a block of queries when it is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from demandflow.llm.common import release, stored
from demandflow.session import ship_package

#: Characters of a segment, and of a block of queries.
SEGMENT_CHARS, BLOCK_CHARS = 4_000_000, 1_000_000
#: Strata whose bounds are held at a time.
STRATA = 64
SLOPE = 75
INDEX = "segment long, m long, n_docs int, postings binary"
NULL_KEY = -(1 << 63)  # stands for a null key inside tasks: sorts first

#: Separators (ASCII but letters and digits) to a space, A-Z to a-z, other bytes as they are.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Index:
    """The table of strata with the number of documents that have terms, and of all their terms."""
    strata: DataFrame
    n_docs: int
    n_terms: int


class _Numbers(dict):
    """Numbers 0, 1, ... in the order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            size = [len(terms(t)) for t in batch.column(0).slice(at, 256).to_pylist()]
            docs, total = docs + sum(n > 0 for n in size), total + sum(size)
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=["docs", "total"])


_PACK = ipc.IpcWriteOptions(compression="zstd", use_threads=False)
_FIELDS = ("m", "keys", "terms", "term_runs", "run_tf", "run_docs", "docs")


def _stored(record: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with ipc.new_stream(sink, record.schema, options=_PACK) as writer:
        writer.write_batch(record)
    return sink.getvalue().to_pybytes()


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Positions where a sorted row of keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _segment(number: int, keys: list[int], held: list[np.ndarray], names: list[bytes], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    size = np.array([len(x) for x in held], np.int64)
    m = 100 - SLOPE + (SLOPE * size * n_docs) // n_terms
    order = np.lexsort((np.array(keys, np.int64), m))  # strata, then keys in ascending order
    m, key = m[order], np.array(keys, np.int64)[order]
    flat = np.concatenate([held[i] for i in order])
    rank = np.empty(len(names), np.int64)  # terms in the order of their bytes
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    doc, size = np.repeat(np.arange(len(order)), size[order]), None
    posting, tf = np.unique(doc * len(names) + rank[flat], return_counts=True)
    doc, term, sorted_names = posting // len(names), posting % len(names), sorted(names)
    first = _heads(m)  # first document of each stratum
    stratum = np.searchsorted(first, doc, "right") - 1
    order = np.lexsort((-tf, stratum * len(names) + term))  # documents stay in order
    doc, term, tf, stratum = doc[order], term[order], tf[order].astype(np.int32), stratum[order]
    runs, lists = _heads(stratum, term, tf), _heads(stratum, term)
    run_docs = np.diff(np.r_[runs, len(tf)]).astype(np.int32)
    list_run = np.searchsorted(runs, lists)
    term_runs = np.diff(np.r_[list_run, len(runs)]).astype(np.int32)
    of = np.arange(len(first) + 1)
    at, run_at, list_at = (np.searchsorted(stratum[x], of) for x in (np.arange(len(doc)), runs, lists))
    def lists_of(values, ends):
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    ends = np.r_[first, len(m)]
    names = pa.array(sorted_names, pa.binary()).take(pa.array(term[lists]))
    record = pa.RecordBatch.from_arrays(
        [pa.array(m[first]), lists_of(pa.array(key, mask=key == NULL_KEY), ends), lists_of(names, list_at), lists_of(term_runs, list_at),
         lists_of(tf[runs], run_at), lists_of(run_docs, run_at), lists_of((doc - first[stratum]).astype(np.int32), at)],
        names=list(_FIELDS))
    for s in range(0, len(first), STRATA):
        some = range(s, min(s + STRATA, len(first)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), number)), pa.array(m[first[some]]), pa.array(np.diff(ends[s:s + len(some) + 1]).astype(np.int32)),
             pa.array([_stored(record.slice(i, 1)) for i in some], pa.binary())], names=["segment", "m", "n_docs", "postings"])


def _build(n_docs: int, n_terms: int, segment_chars: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chars = TaskContext.get().partitionId() << 32, 0
        keys, held, names = [], [], _Numbers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time are Python strings
                for key, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist()):
                    words = terms(text)
                    if not words:
                        continue
                    keys.append(NULL_KEY if key is None else key)
                    held.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
                    chars += len(text)
                    if chars >= segment_chars:
                        yield from _segment(number, keys, held, list(names), n_docs, n_terms)
                        keys, held, names, chars, number = [], [], _Numbers(), 0, number + 1
        if keys:
            yield from _segment(number, keys, held, list(names), n_docs, n_terms)
        del keys, held, names
        release()
    return make


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_chars: int = SEGMENT_CHARS) -> Index:
    """The index of every row of ``docs``, written to the shared folder."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    n = rows.select("text").mapInArrow(_sizes, "docs long, total long").agg(F.sum("docs").alias("d"), F.sum("total").alias("t")).first()
    strata = rows.mapInArrow(_build(n.d or 0, n.t or 0, segment_chars), INDEX)
    return Index(stored(strata, "strata"), n.d or 0, n.t or 0)


def _flat(rows: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and where each row's begin."""
    column = rows.column(name)
    return column.flatten(), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return _flat(rows, name)[0].to_numpy().astype(np.int64)


class _Strata:
    """The postings of the block's terms in some strata."""

    def __init__(self, rows: pa.RecordBatch, words: pa.Array):
        self.m = rows.column("m").to_numpy()
        keys, self.doc_at = _flat(rows, "keys")
        self.keys = keys.fill_null(NULL_KEY).to_numpy()
        found, at = _flat(rows, "terms")
        term = pc.index_in(found, value_set=words).fill_null(-1).to_numpy()
        stratum = np.repeat(np.arange(rows.num_rows), np.diff(at))
        n_runs, tf, n_docs, docs = (_numbers(rows, n) for n in ("term_runs", "run_tf", "run_docs", "docs"))
        run_at = np.r_[0, np.cumsum(n_runs)]
        doc_at = np.r_[0, np.cumsum(n_docs)]
        keep = np.flatnonzero(term >= 0)
        self.term, self.stratum = term[keep], stratum[keep]
        self.first, self.last = doc_at[run_at[keep]], doc_at[run_at[keep + 1]]  # postings of each list kept
        self.docs, self.tf, self.n_docs = docs, tf, n_docs
        self.head, self.run_stratum = run_at[keep], np.repeat(stratum, n_runs)

    def impacts(self) -> np.ndarray:
        """Impact of every run, computed once per tf of a stratum."""
        pairs, of = np.unique(self.run_stratum << 32 | self.tf, return_inverse=True)
        tf = pairs & 0xFFFFFFFF
        return ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[pairs >> 32]))[of]


def _batches(batches: Iterator[pa.RecordBatch], fields: tuple = _FIELDS) -> Iterator[pa.RecordBatch]:
    options = ipc.IpcReadOptions(use_threads=False, included_fields=[_FIELDS.index(f) for f in fields])
    for batch in batches:
        packed = batch.column("postings")
        for at in range(0, batch.num_rows, STRATA):
            some = [b for i in range(at, min(at + STRATA, batch.num_rows))
                    for b in ipc.open_stream(packed[i].as_buffer(), options=options)]
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _counter(block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(block.value[1], pa.binary())
        df = np.zeros(len(words), np.int64)
        for rows in _batches(batches, ("terms", "term_runs", "run_docs")):
            term = pc.index_in(_flat(rows, "terms")[0], value_set=words).fill_null(-1).to_numpy()
            run_at = np.r_[0, np.cumsum(_numbers(rows, "term_runs"))]
            doc_at = np.r_[0, np.cumsum(_numbers(rows, "run_docs"))]
            keep = np.flatnonzero(term >= 0)
            np.add.at(df, term[keep], doc_at[run_at[keep + 1]] - doc_at[run_at[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])
    return count


def _ranker(block, k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, words, weights = block.value
        words = pa.array(words, pa.binary())
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]  # scores and keys, best first
        for rows in _batches(batches):
            s = _Strata(rows, words)
            impact = s.impacts()
            bound = np.zeros((len(words), rows.num_rows), np.int64)  # of each term in each stratum
            bound[s.term, s.stratum] = impact[s.head]
            where = np.full(bound.shape, -1, np.int64)
            where[s.term, s.stratum] = np.arange(len(s.term))
            impact = np.repeat(impact, s.n_docs)
            for q, (term, times) in enumerate(queries):
                w = weights[term] * times
                most = w @ bound[term]
                score, key = best[q]
                for i in np.argsort(-most, kind="stable").tolist():
                    if most[i] <= 0 or (len(score) == k and most[i] < score[-1]):
                        break
                    acc = np.zeros(s.doc_at[i + 1] - s.doc_at[i], np.int64)
                    for at, x in zip(where[term, i].tolist(), w.tolist()):
                        if at >= 0:
                            a, b = s.first[at], s.last[at]
                            acc[s.docs[a:b]] += x * impact[a:b]
                    hit = np.flatnonzero(acc >= (score[-1] if len(score) == k else 1))
                    if len(hit):
                        score = np.r_[score, acc[hit]]
                        key = np.r_[key, s.keys[s.doc_at[i] + hit]]
                        order = np.lexsort((key, -score))[:k]
                        score, key = score[order], key[order]
                best[q] = score, key
        n = [len(x) for x, _ in best]
        key = np.concatenate([np.zeros(0, np.int64)] + [x for _, x in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), n)), pa.array(key, mask=key == NULL_KEY),
             pa.array(np.concatenate([np.zeros(0, np.int64)] + [x for x, _ in best]))], names=["query", "key", "score"])
        release()
    return rank


def _blocks(queries: DataFrame, block_chars: int) -> Iterator[list]:
    """The distinct queries with text, in blocks of bounded length."""
    held, chars = [], 0
    for row in queries.distinct().where("text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        held.append(row)
        chars += len(row.text) + 100
        if chars >= block_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _ranked(spark: SparkSession, index: Index, rows: list, k: int) -> DataFrame:
    words, queries = _Numbers(), []
    for row in rows:
        ids, times = np.unique(np.array([words[t] for t in terms(row.text)], np.int64), return_counts=True)
        queries.append((ids, times))
    block = spark.sparkContext.broadcast((queries, list(words)))  # a block of queries: bounded
    df = index.strata.mapInArrow(_counter(block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    n = F.lit(2 * index.n_docs + 2).cast("double")
    weight = F.floor(1000 * F.log(n / (2 * F.col("df") + 1).cast("double"))).alias("w")
    weights = np.zeros(len(words), np.int64)
    for r in df.select("term", weight).collect():  # a number per term of the block
        weights[r.term] = r.w
    block = spark.sparkContext.broadcast((queries, list(words), weights))
    found = index.strata.mapInArrow(_ranker(block, k), "query long, key long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("key")))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], "query long, id long")
    return found.join(F.broadcast(ids), "query").select("id", "rank", "key", "score")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, rank, key, score): the ``k`` best documents of each query, scores above 0."""
    spark = queries.sparkSession
    ship_package(spark)
    rows = queries.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], "id long, rank int, key long, score long")
    if index.n_docs:
        for block in _blocks(rows, block_chars):
            out = out.unionByName(_ranked(spark, index, block, k))
    return out
