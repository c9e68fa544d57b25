"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: a null text counts as empty and fails the quality rules; every row is judged by its own text, also where rows share
a doc_id or have none; of near copies the row with the smallest doc_id stays, rows without one come last, and of rows with one doc_id
and equal text one stays; extra columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import ngram_join, packing, pii, quality, suffix_dedup
from skeinwork.llm.runtime import settle, table

#: Words in the encoder's table of a worker that packs.
WORDS_KEPT = 200_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart and orders them by doc_id, rows without doc_id last; and the column's name."""
    name = "_".join([*docs.columns, "key"])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    # Numbers given after a sort follow its order; they are written, so that they stay what they are.
    text, row = f"{name}_text", f"{name}_row"
    placed = docs.withColumn(text, F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id())
    order = placed.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), text, row).drop(text, row)
    return settle(order.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep."""
    return quality.judge(docs, whole=True).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id."""
    keyed, key = _keyed(docs)
    first = ngram_join.join(keyed, key=key).filter("component_id = doc_id").select(F.col("doc_id").alias(f"{key}_first"))
    return keyed.join(first, F.col(key) == F.col(f"{key}_first"), "left_semi").drop(key)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages that an earlier one has; n_chars follows the text."""
    keyed, key = _keyed(docs)
    out = suffix_dedup.remove(keyed, key=key).drop(key)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences.  The encoder's table is small, as executors still hold the memory of the stages before."""
    return packing.pack(docs, words_kept=WORDS_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packed),
]

#: Language statistics, suffix arrays and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
