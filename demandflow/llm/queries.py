"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandflow.llm import alignment, decontaminate, html_text, language, lexical, mixing, neighbours, pii, secrets, simhash, subword, token_files as tf, weighted_sampling
from demandflow.llm.common import read_table, shared_path

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "tokens")
    manifest = tf.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tf.read_token_files(spark, folder, manifest)


@query("op1_token_output")
def _op1(spark, sf):
    return token_output(spark, read_table(spark, sf, "documents"))


@query("op5_simhash_near_dedup")
def _op5(spark, sf):
    found = simhash.near_duplicates(read_table(spark, sf, "documents"), shingle=3, max_bits=3)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, list_extract([5.0, 2.0, 1.0], ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1)::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS k FROM w),
c AS (SELECT *, (1.5 * sum(source_size) OVER ())::DOUBLE
                - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
l AS (SELECT coalesce((SELECT rest / open FROM c WHERE 2.0 * source_size > rest / open * weight ORDER BY k LIMIT 1), 'infinity'::DOUBLE) AS rate),
t AS (SELECT source, source_size, least(2.0 * source_size, rate * weight) AS target FROM w, l),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, d.u,
             CASE WHEN t.source_size > 0 THEN least(2.0, t.target / t.source_size * 1.0) ELSE 0.0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(e)::BIGINT AS whole,
             CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS r FROM e),
n AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need,
             sum(CASE WHEN r IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY r NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM r)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN r IS NOT NULL AND total + total - size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n
"""


@query("op9_mix_sources", MIX_SQL)
def _op9(spark, sf):
    mixed = mixing.mix(read_table(spark, sf, "documents"))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


@query("op10_benchmark_decontamination")
def _op10(spark, sf):
    found = decontaminate.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_windows", "n_exchanged", F.col("items").alias("item_ids"))


@query("op2_weighted_fingerprints")
def _op2(spark, sf):
    return weighted_sampling.edited_fingerprints(read_table(spark, sf, "documents")).withColumnRenamed("key", "doc_id")


def quality(docs: DataFrame, labels: DataFrame, out: str = "_score") -> DataFrame:
    """``docs`` with column ``out``, learned from the labels outside fold 1 of 3."""
    return subword.with_score(docs, labels.where(~subword.in_fold(F.col("doc_id"), 3, 1)), "quality", out=out)


@query("op6_quality_classifier")
def _op6(spark, sf):
    scored = quality(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    scored = scored.select("doc_id", subword.in_fold(F.col("doc_id"), 3, 1).alias("held_out"), F.col("_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_toxicity_neighbours")
def _op8(spark, sf):
    labels = read_table(spark, sf, "labels").where(~subword.in_fold(F.col("doc_id"), 5, 0))
    scored = neighbours.with_neighbours(read_table(spark, sf, "documents"), labels, "toxic")
    scored = scored.select("doc_id", subword.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_near.score").alias("score"), "_near.evidence")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


@query("op3_personal_data")
def _op3(spark, sf):
    found = pii.with_personal_data(read_table(spark, sf, "documents")).select("doc_id", "_personal")
    base = F.filter("_personal", lambda s: s.base)
    return found.select("doc_id", *[_count(F.col("_personal"), k) for k in pii.KINDS],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_personal")).alias("spans"))


@query("op4_secret_scan")
def _op4(spark, sf):
    found = secrets.with_secrets(read_table(spark, sf, "documents")).select("doc_id", "_secrets")
    base = F.filter("_secrets", lambda s: s.kind.isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *[_count(F.col("_secrets"), k) for k in secrets.BASE_KINDS],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_secrets")).alias("spans"))


@query("op7_html_main_text")
def _op7(spark, sf):
    pages = html_text.with_main_text(read_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))


LEXICAL_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM l, g),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op11_lexical_search", LEXICAL_SQL)
def _op11(spark, sf):
    index = lexical.build(read_table(spark, sf, "documents"))
    found = lexical.search(index, read_table(spark, sf, "benchmark"), k=10)
    return found.select(F.col("id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@query("op12_language_id")
def _op12(spark, sf):
    docs = read_table(spark, sf, "documents")
    held_out = subword.in_fold(F.col("doc_id"), 3, 1)
    found = language.with_language(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


@query("op13_tokenizer_alignment")
def _op13(spark, sf):
    import public_tokenizers

    found = alignment.align(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("key", "doc_id")
