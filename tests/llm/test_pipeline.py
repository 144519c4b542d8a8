"""The pipeline against a version that applies the operators' brute-force forms."""

import collections
import zlib

import corpus_pipeline as cp
import numpy as np
import pyarrow.dataset as ds
import pytest

from demandflow.llm import queries, subword

from conftest import SMALL

from .test_operators import VOCABULARY, plain_components, plain_fingerprint, tokenizers


def test_stages():
    assert [len(x) for x in cp.STAGES] == [2] * 5 and cp.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    docs = ds.dataset(f"{SMALL}/documents.parquet").to_table().to_pandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r._score for r in queries.quality(spark.read.parquet(f"{SMALL}/documents.parquet"), labels).select("doc_id", "_score").collect()}
    docs = docs[[scores[i] >= 0.5 for i in docs.doc_id]].reset_index(drop=True)
    roots = plain_components([plain_fingerprint(t) for t in docs.text], 3)
    docs = docs[[r == i for i, r in enumerate(roots)]].reset_index(drop=True)
    bench = ds.dataset(f"{SMALL}/benchmark.parquet").to_table().to_pandas()
    import re
    grams = lambda t: {tuple(w[k:k + 8]) for w in [re.sub(r"[^\w\s]+", "", (t or "").lower()).split()] for k in range(len(w) - 7)}
    leaked = set().union(*map(grams, bench.text))
    docs = docs[[not grams(t) & leaked for t in docs.text]].reset_index(drop=True)
    import duckdb
    con = duckdb.connect()
    con.register("documents", docs)
    taken = {r[0]: (r[4], r[1]) for r in con.execute(queries.MIX_SQL).fetchall()}
    tok = tokenizers.Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    for i, t in zip(docs.doc_id, docs.text):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        words, size = taken[i]
        for _ in range(words // size if size else 0):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, SMALL).orderBy("start").collect()]
    # texts without words carry no words of the mix: their copies are not fixed by SQL
    empty = {i for i, (w, s) in taken.items() if not s}
    assert collections.Counter((g[0], g[2], g[3]) for g in got if g[0] not in empty) == collections.Counter((w[0], w[2], w[3]) for w in want)
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:]))


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Each stage takes all odd rows, keeps the columns and does not fail on none."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, odd_docs, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.columns == odd_docs.columns, name
        assert out.count() <= 2 * odd_docs.count()
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0
