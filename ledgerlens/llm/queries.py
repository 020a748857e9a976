"""One thin query per operator over its whole test table, and SQL where SQL can
say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import (collocations, langid, mixing, quality, quality_classifier, sentencepiece_fst, simhash, suffix_dedup,
                            tokens, topk, toxicity, urls, whitening)

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), report=BASE_MEASURES, keep=["doc_id"])
    return judged.select(
        "row.doc_id", *BASE_MEASURES,
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_fst.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return coded.select("row.doc_id", "n_bytes", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.crc_fold("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_texts(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.crc_fold("doc_id", 5) == 0
    told = langid.identify(docs, langid.fit(docs.where(~held)), keep=["doc_id"])
    return told.select("row.doc_id", "lang_pred", "score").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality_classifier.describe(table(spark, sf_dir, "documents"), keep=["doc_id"])
    held = langid.crc_fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", "quality")
    scored = quality_classifier.score(described, quality_classifier.fit(described, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality_classifier.LIMIT).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = whitening.cleaned(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return whitening.whiten(clean, whitening.fit(clean)).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality, op2_topk, op3_tokens, op4_sentencepiece, op5_suffix_dedup, op6_toxicity, op7_simhash,
    op8_urls, op9_language, op10_mixing, op11_quality_classifier, op12_collocations,
    op13_whitening)}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), win AS (
  SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), cov AS (
  SELECT r, count(DISTINCT i + j) AS n FROM rep, range(8) AS k(j) GROUP BY r
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes, len(ln) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_echoes > 30 * n_words OR 10 * n_dup_lines > 6 * n_lines OR 2 * n_upper > n_letters
            OR word_chars > 30 * n_words) AS kept
FROM m""",
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS ss FROM d GROUP BY source
), w AS (
  SELECT source, ss, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w,
         (SELECT sum(ss) FROM s)::HUGEINT AS total FROM s
), c AS (
  SELECT *, 3 * ss * sum(w) OVER (ORDER BY ss::DOUBLE / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            < w * (total - coalesce(sum(3 * ss) OVER (ORDER BY ss::DOUBLE / w::DOUBLE, source
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stopped FROM w
), g AS (
  SELECT *, total - coalesce((SELECT sum(3 * ss) FROM c WHERE stopped), 0) AS share,
         (SELECT sum(w) FROM c WHERE NOT stopped) AS over_w FROM c
), t AS (
  SELECT source, ss::BIGINT AS source_size,
         CASE WHEN stopped THEN (3 * ss)::DOUBLE ELSE (w * share)::DOUBLE / over_w::DOUBLE END AS target FROM g
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS want,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (want // greatest(source_size, 1) * size
        + greatest(0, least(size, want - want // greatest(source_size, 1) * source_size - done)))::BIGINT AS taken
FROM p""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), f AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS g, count(*) AS c FROM places, (SELECT unnest([1, 2, 3, 4]) AS m)
  WHERE i + m - 1 <= len(w) GROUP BY ALL
), n AS (
  SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang
), cand AS (
  SELECT lang, g, c AS a FROM f WHERE len(g) > 1 AND c >= 30
), cut AS (
  SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand
), scored AS (
  SELECT cut.lang, cut.g, cut.a, k, x.c AS l, y.c AS r, (2000000::HUGEINT * cut.a // (x.c + y.c))::BIGINT AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.g = list_slice(cut.g, 1, k)
  JOIN f AS y ON y.lang = cut.lang AND y.g = list_slice(cut.g, k + 1, len(cut.g))
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, k) = 1
), part AS (
  SELECT lang, a, g, m, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM cand)
), inside AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS most FROM part GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, l, r, score
  FROM scored AS s LEFT JOIN inside AS i ON i.lang = s.lang AND i.g = s.g
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
