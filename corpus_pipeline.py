"""A corpus pipeline of five stages, each one operator of ``ledgerlens.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it leaves, with
the columns of ``documents``; the last returns the encoded documents.  Each
result is written as Parquet and reread as the next one's docs.  All stages keep
columns that they don't know, and a stage over no documents returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import mixing, quality, sentencepiece_fst, simhash, suffix_dedup
from ledgerlens.llm.common import materialise

#: No SQL: fingerprints and pieces have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts go."""
    return quality.judge(docs).where("rejected_by is null").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least id, of several
    such the one whose text's hash is least, once.  Null ids come last."""
    tied = docs.withColumn("__tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = simhash.near_duplicates(tied, keep=["doc_id", "__tie"]).select("row.*", "fp", "component_id")
    # A component is told by its least id, one of null ids alone by its fingerprints.
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")]
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__tie").alias("tie"))
    stay = materialise(found.groupBy(*group).agg(F.min(first).alias("first"))
                       .select(F.col("first.id").alias("__stays"), F.col("first.tie").alias("__as")).distinct())
    return (tied.join(stay, F.col("doc_id").eqNullSafe(F.col("__stays")) & (F.col("__tie") == F.col("__as")), "left_semi")
            .dropDuplicates(["doc_id", "__tie"]).drop("__tie"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occur earlier are cut out; a character
    that a cut has split goes with it.  Documents stay, cut empty or not."""
    cut = suffix_dedup.cut_repeats(docs)
    text = F.when(F.col("row.text").isNull() | (F.size("spans") == 0), F.col("row.text")).otherwise(_readable("kept"))
    rows = cut.select("row.*", text.alias("__text"))
    columns = [F.col("__text").alias(c) if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars"
               else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(columns)


def _readable(column: str) -> F.Column:
    """Bytes as text without the pieces of characters that are not whole."""
    return F.regexp_replace(F.expr(f"make_valid_utf8(cast({column} as string))"), "�", "")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it and each copy
    where its own pass is due; a copy of less than half its words goes, as do documents not taken."""
    return mixing.mix_copies(docs).where("2 * words >= size").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    coded = sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return coded.select("row.doc_id", "n_bytes", "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
