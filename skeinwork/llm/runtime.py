"""What the text operators share: input columns, shared tables, Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.tables import settle as settle

#: Rows in one Arrow batch.  Texts can be long, so a batch is kept to a few MB in the usual case.
BATCH_ROWS = 512


#: Tables that a worker keeps from task to task.
KEPT: list[dict] = []


def lean(own: dict | None = None) -> None:
    """In a worker: drop tables kept by other operators than the own one, give freed memory back, and take large arrays straight from the system."""
    for table in KEPT:
        if table is not own:
            table.clear()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to tune
        return
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    libc.malloc_trim(0)


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker's memory follows the batch and not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def bounded(df: DataFrame, n: int, *names: str) -> DataFrame:
    """n rows of df at most, those of the least hashes of the named columns: the same for the same rows, however they lie.

    A threshold from the number of rows leaves few more than n of them to be sorted, so no task gets more at any size of df.
    """
    total, mark = df.count(), F.xxhash64(*names)
    if total > 4 * n:
        df = df.filter(F.pmod(mark, F.lit(1 << 40)) < int(2 * n / total * (1 << 40)) + 1)
    return df.orderBy(mark, *names).limit(n)


def two_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the id (as long) and the text; other columns, whatever their names, are left behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
