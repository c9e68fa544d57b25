"""Importance resampling: the documents that look most like a target, drawn without replacement.

Words are runs of ASCII digits and letters (A-Z as a-z) and of characters beyond ASCII.  Features are runs of words, hashed into
buckets.  A bucket's gain is the log ratio of its share in the target to its share in the documents, one added to every count;
a document's weight is the sum of its features' gains, which are looked up for a whole batch at once in an array.  Adding Gumbel noise
to the weight, from a hash of the id, turns the greatest scores into a weighted draw without replacement.

The draw is a distributed radix selection.  The composite key is (score descending, doc_id, place of the row).  Each round counts the
rows that are still in question by the next 16 bits of the key, from the first bit that differs anywhere; only these counts, 65,536
at most, come to the driver.  It ends as soon as a digit's rows are taken whole.  Only the chosen rows are sorted, by range, and ranked.

Defined results: a null text has no features, weight 0 and is never eligible (unless min_words is 0); texts are read whole; repeated rows are
each scored, and each can be drawn; rows without doc_id are hashed as the empty id and stand last among ties; equal score and doc_id: the
rows are alike but for their place in the scored table, which decides; an empty target leaves all counts of it 0; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.runtime import lean, settle, texts_of, tune, two_columns
from skeinwork.tables import literal_table

BUCKETS = 10_000
SEED = 2024
#: Bits of the key that one round of the selection looks at.
DIGIT = 16
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FIRST = -(1 << 63)


def words_of(text: str) -> list[bytes]:
    """The words of one text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def feature_buckets(words: list[bytes], shortest: int, longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of shortest to longest words."""
    parts = []
    for k in range(shortest, longest + 1):
        runs = words if k == 1 else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        parts.append(np.fromiter(map(crc32, runs), np.uint32, len(runs)))
    return np.concatenate(parts).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket is met in all texts; one number for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in texts_of(b):
                total += np.bincount(feature_buckets(words_of(x), shortest, longest, buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    given = texts.select(F.col(text).cast("string").alias("text"))
    found = given.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths of a nat, rounded down."""
    size, all_own, all_target = len(own), float(own.sum()), float(target.sum())
    ratio = [(t + 1.0) * (all_own + size) / ((s + 1.0) * (all_target + size)) for s, t in zip(own.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of (doc_id, text)."""
    packed, buckets = gain.tobytes(), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        table = np.frombuffer(packed, np.int64)
        for b in batches:
            n_words, found = [], []
            for x in texts_of(b):
                words = words_of(x)
                n_words.append(len(words))
                found.append(feature_buckets(words, shortest, longest, buckets))
            sizes = np.array([len(f) for f in found], np.int64)
            run_up = np.concatenate([[0], np.cumsum(table[np.concatenate(found)])]) if found else np.zeros(1, np.int64)
            ends = np.cumsum(sizes)
            weight = run_up[ends] - run_up[ends - sizes]
            score = weight + np.array([noise(k, seed) for k in b.column("doc_id").to_pylist()], np.int64)
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(sizes), pa.array(weight), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def smallest(rows: DataFrame, key: list[str], k: int) -> Column:
    """A condition that holds for exactly the k rows with the smallest keys; key names columns of longs, whose rows are all different."""
    if k <= 0:
        return F.lit(False)
    ends = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(key) for f in (F.min, F.max))).first()
    if ends["n"] <= k:
        return F.lit(True)
    chosen, open_ = F.lit(False), F.lit(True)
    for i, c in enumerate(key):
        least, most = ends[f"min{i}"] - _FIRST, ends[f"max{i}"] - _FIRST
        left = (least ^ most).bit_length()  # bits above are the same in all rows
        while left:
            left, wide = max(0, left - DIGIT), min(left, DIGIT)
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(_FIRST)), left).bitwiseAND(F.lit((1 << wide) - 1))
            counts = sorted((r["d"], r["count"]) for r in rows.filter(open_).groupBy(digit.alias("d")).count().collect())
            for d, n in counts:
                if n >= k:
                    break
                k -= n
            chosen, open_ = chosen | (open_ & (digit < d)), open_ & (digit == d)
            if n == k:
                return chosen | open_
    raise ValueError("two rows have the same key")


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with their place in the order of key, from 1: sorted by range, and each range's start from the sizes of those before."""
    placed = settle(rows.orderBy(*key).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, start, starts = F.shiftright("place", 33), 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # one row for each range
        starts.append((r["part"], start))
        start += r["count"]
    places = F.broadcast(literal_table(rows.sparkSession, starts, "part long, start long"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(places, "part").withColumn("rank", F.col("start") + within + 1).drop("part", "place", "start")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, shortest: int = 1, longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where the document is not drawn."""
    tune(docs.sparkSession)
    docs = two_columns(docs, key, text)
    gain = gains(bucket_counts(docs, "text", shortest, longest, buckets), bucket_counts(target, target_text, shortest, longest, buckets))
    rows = scored(docs, gain, shortest, longest, seed)
    order = {"by_score": F.bitwise_not("score"), "by_id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "by_row": F.monotonically_increasing_id()}
    rows = settle(rows.withColumns(order), "scored")
    able = rows.filter(F.col("n_words") >= min_words)
    chosen = (F.col("n_words") >= min_words) & smallest(able, list(order), percent * able.count() // 100)
    names = ("doc_id", "n_features", "weight", "score", "rank")
    drawn = ranked(rows.filter(chosen), list(order)).select(*names)
    return drawn.unionByName(rows.filter(~chosen).withColumn("rank", F.lit(None).cast("long")).select(*names))
