"""The corpus pipeline: quality rules, exact and near deduplication, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
the packed pieces.  Rows with a null ``doc_id`` are kept by the near-duplicate
stage unless their component has a smallest id; rows that share a ``doc_id``
stay or go there together.  An empty table passes through as an empty table.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.exact import keep_first
from kestrel.llm.jaccard import similar_components
from kestrel.llm.packing import pack
from kestrel.llm.pii import pseudonymise
from kestrel.llm.queries import tokenizer_path
from kestrel.llm.rules import keep_good
from kestrel.session import cut_lineage, drop_tables
from kestrel.sources.tables import read_table

#: Session setting with the secret key of the pseudonyms; without one a run draws its own.
KEY_SETTING = "spark.kestrel.pseudonym.key"
#: Near duplicates share 0.8 or more of their 5-word shingles (op8's own query: 3 words, 0.9).
NEAR = {"size": 5, "num": 80, "den": 100}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays."""
    found = similar_components(docs, **NEAR)
    kept = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__kept")).distinct())
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session names.  One drawn here stays in the session, so
    its runs agree; values of other sessions are then not linked, and nobody
    can undo the permutation."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows a changed text."""
    out = pseudonymise(docs, pseudonym_key(spark), count_col="__found")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__found") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("pseudonyms", pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)


Q = {"pipeline": (run, ORACLE_SQL)}
