"""Ranked lexical search, language identification and tokenizer alignment: odd rows, empty
tables, and against brute-force versions."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest

from demandflow.llm import alignment, language, lexical, queries, subword
from pyspark.sql import functions as F

from conftest import SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs():
    return ds.dataset(f"{SMALL}/documents.parquet").to_table().to_pandas().sort_values("doc_id").reset_index(drop=True)


def run(spark, name):
    return queries.REGISTRY[name][0](spark, SMALL)


# --- 11: lexical search ---------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(rows, items, k=10):
    """Every document scored for every item, in Python integers."""
    held = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms = TERM.findall((text or "").translate(LOWER))
        found = []
        for d, c, size in held:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if c[t])
            if score > 0:
                found.append((-score, (d is not None, d or 0), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return tuple((v is not None, v) for v in r)


def test_terms_are_the_contracts():
    for text in ["Don't STOP, Äpfel-2 x_y", "a\x00b\x7fc", "日本 語é\u00a0É", "", "  ", "ÀB{c}|d~e^f`g", "\U0001F600x"]:
        assert [t.decode() for t in lexical.terms(text)] == TERM.findall(text.translate(LOWER)), text
    assert lexical.terms(None) == []


def test_search_query_equals_sql_and_brute_force(spark, docs):
    got = sorted(map(tuple, run(spark, "op11_lexical_search").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    assert got == sorted(con.execute(queries.REGISTRY["op11_lexical_search"][1]).fetchall())
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert got == sorted(brute_search(zip(docs.doc_id.tolist(), docs.text), items))


@pytest.mark.parametrize("segment,block", [(4_000_000, 1_000_000), (300, 150)])
def test_search_on_odd_rows(spark, odd_docs, segment, block):
    """Null ids and texts, repeated rows, ties, terms in no document, small segments and blocks."""
    items = [(1, "the quick fox"), (2, None), (3, ""), (4, "same TEXT twice twice"), (5, "nowhere"), (None, "a row"), (6, "word1 and1 x"), (1, "the quick fox")]
    queries_ = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(odd_docs, segment_chars=segment)
    got = [tuple(r) for r in lexical.search(index, queries_, k=3, block_chars=block).collect()]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_search(rows, list(dict.fromkeys(items)), k=3)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r.n_docs for r in index.strata.collect()) == sum(bool(TERM.findall(t or "")) for _, t in rows)


def test_search_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    weight = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=weight / weight.sum()))) for i in range(600)]
    items = [(i, " ".join(rng.choice(vocabulary, 8, p=weight / weight.sum()))) for i in range(20)]
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), segment_chars=5000)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(rows, items))


def test_search_of_empty_tables(spark, odd_docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(lexical.build(odd_docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build(odd_docs.where("text IS NULL OR text = ''")), items).count() == 0
    assert lexical.search(lexical.build(odd_docs), items.limit(0)).count() == 0


# --- 12: language ----------------------------------------------------------------

def brute_predict(model, text):
    """Word by word, in plain Python."""
    words = language.words(text)
    if not words or not model.langs:
        return "und", 0.0
    total, known = np.zeros(len(model.langs)), 0
    for w in words:
        if w in model.row[0]:
            logs = model.logs[0][model.row[0][w]].astype(float)
        else:
            for step, n in enumerate((5, 4, 3, 2, 1), 1):
                marked = f"<{w}>" if n > 1 else w
                rows = [model.logs[n][model.row[n][marked[i:i + n]]].astype(float) for i in range(len(marked) - n + 1)
                        if marked[i:i + n] in model.row[n]]
                if rows:
                    logs = np.mean(rows, axis=0) - 0.5 * step
                    break
            else:
                continue
        total += logs
        known += 1
    z = model.prior + (total / known ** 0.5 if known else 0)
    p = np.exp(z - z.max())
    return model.langs[int(p.argmax())], float(p.max() / p.sum())


def test_language_query_is_right_on_held_out_rows(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op12_language_id").collect()}
    assert sorted(got) == docs.doc_id.tolist()
    held = [(got[i], lang) for i, lang, t in zip(docs.doc_id, docs.lang, docs.text) if got[i].held_out and t]
    assert len(held) > 20 and np.mean([r.lang_pred == lang for r, lang in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_equals_brute_force(spark, docs, odd_docs):
    df = spark.createDataFrame([(int(i), t, x) for i, t, x in zip(docs.doc_id, docs.text, docs.lang)], "doc_id long, text string, lang string")
    train = df.where(~subword.in_fold(F.col("doc_id"), 3, 1))
    model = language.fit(train, max_words=200)          # most words are unseen: n-grams decide
    rows = df.unionByName(odd_docs.select("doc_id", "text", "lang"))
    got = language.with_language(rows, train, max_words=200).collect()
    for r in got:
        lang, score = brute_predict(model, r.text)
        assert (r._lang.lang, r._lang.score) == (lang, pytest.approx(score, abs=1e-6)), r.text[:50]


def test_language_of_odd_texts(spark, odd_docs):
    train = spark.createDataFrame([(1, "der die und", "de"), (2, "the and of", "en"), (3, "nobody knows", None), (4, None, "en")],
                                  "doc_id long, text string, lang string")
    docs_ = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \u0301"), (4, "UND die"), (5, "of OF of"), (6, "日本"), (7, "b" * 100_000)],
                                  "doc_id long, text string").withColumn("lang", F.lit("zz")).withColumn("score", F.lit(1))
    got = {r.doc_id: (r._lang.lang, r._lang.score) for r in language.with_language(docs_, train).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert (got[4][0], got[5][0]) == ("de", "en") and got[6][0] == "en" and got[7][0] in ("de", "en")
    none = language.with_language(odd_docs, train.limit(0), out="_odd").collect()
    assert len(none) == odd_docs.count() and all(r._odd.lang == "und" for r in none)
    assert language.with_language(odd_docs.limit(0), train).count() == 0


def test_language_model_is_bounded(spark):
    train = spark.createDataFrame([(i, f"word{i} other{i % 7}", f"l{i % 9}") for i in range(900)], "doc_id long, text string, lang string")
    model = language.fit(train, max_languages=4, max_words=20, max_grams=30)
    assert len(model.langs) == 4 and len(model.row[0]) <= 80 and all(len(model.row[n]) <= 120 for n in language.GRAMS)


# --- 13: alignment -----------------------------------------------------------------

def brute_align(rows):
    two = alignment.Pair(A, B)
    per, count = [], collections.Counter()
    for doc, text in rows:
        groups, links = [], collections.Counter()
        a = two.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.b.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if text and b"".join(two.a_bytes[i] for i in a) == data == b"".join(two.b_bytes[i] for i in b):
            ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((two.a_bytes, a), (two.b_bytes, b))]
            at, place = [0, 0], [{e: i for i, e in enumerate(side)} for side in ends]
            for cut in sorted(set(ends[0]) & set(ends[1])):
                to = [p[cut] + 1 for p in place]
                groups.append((a[at[0]:to[0]], b[at[1]:to[1]]))
                links.update((x, y) for x in groups[-1][0] for y in groups[-1][1])
                at = to
        else:
            a = b = []
        per.append((doc, len(a), len(b), groups, links))
        count.update(links.keys())
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(doc, na, nb, len(groups), sum(links.values()), sum(m for p, m in links.items() if count[p] == top[p[0]]),
             sum(m * count[p] for p, m in links.items()),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "")
            for doc, na, nb, groups, links in per]


ODD = [(-1, None), (-2, ""), (-3, " \t\n "), (-4, "a\u2581b c"), (-5, "<|endoftext|> x </s> <0x41>"), (-6, "\n\nfoo  bar\n"),
       (-7, "日本語のテキスト 漢字 é ﬁ"), (None, "a b"), (None, "a b"), (-8, "x" * 5000), (-9, "word\n"), (-10, " lead"), (-11, "tail "),
       (-12, "a\nb\nc d"), (-13, "\u00a0nb\u00a0sp"), (-14, "🙂🙂 🙃 👩‍👩‍👧 a"), (-15, "\nx y\nz")]


@pytest.mark.parametrize("chars", [5_000_000, 2_000])
def test_alignment_equals_brute_force(spark, docs, odd_docs, chars):
    rows = ODD + [(int(i), t) for i, t in zip(docs.doc_id, docs.text)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit(1)).repartition(3)
    got = alignment.align(df, A, B, chunk_chars=chars).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_align(rows), key=key)


def test_alignment_with_counts_joined_by_exchange(spark, docs, monkeypatch):
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(alignment, "SENT_PAIRS", 0)
    assert sorted(map(tuple, alignment.align(df, A, B).collect())) == sorted(brute_align(rows))


def test_alignment_query(spark, docs):
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in run(spark, "op13_tokenizer_alignment").collect()]
    assert sorted(got) == sorted(brute_align([(int(i), t) for i, t in zip(docs.doc_id, docs.text)]))


def test_alignment_of_an_empty_table(spark, odd_docs):
    assert alignment.align(odd_docs.limit(0), A, B).count() == 0


def test_groups_break_where_a_start_reaches_the_running_maximum():
    start, end = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])
    order, group = alignment.coalesce(start, end, np.array([0, 0, 0, 1, 1, 1]))
    assert [sorted(order[group == g].tolist()) for g in range(group[-1] + 1)] == [[0, 1, 3, 4], [2, 5]]
