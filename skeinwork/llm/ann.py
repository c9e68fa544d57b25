"""Nearest neighbours by an inverted multi-index.

Each half of a vector has its own centroids, so a cell is a pair of centroids.  For a query, a heap yields the pairs by summed
distance (for inner products: the negated sum of the two halves' products) until the cells met hold the wanted share of the
rows; the entries of those cells are then ranked by the true measure.  Centroids are fitted on a bounded sample; every
row is indexed.  Their number grows with the root of the rows, so that cells keep their size.

The share is measured and not set: some rows of the sample are searched for among the others by brute force, and the share is the
one within which RECALL of their true neighbours come.  Clustered vectors need a small share, which falls as cells get finer; nearly
isotropic ones need a large one at any number of rows, and the work then grows with the product of queries and rows.

Entries lie in blocks, runs of first centroids; a centroid with many entries is split by id.  A query goes once to each block that it
visits, with its cells there, and gets the best of the block back.

Defined results: null, empty or zero vectors, those of another length than the most frequent one, and those with a null, infinite
or NaN component take no part; rows with a null id take no part; repeated rows are candidates each; a query's own rows are
never its candidates; rows that share a query's id are one query, and a candidate has its best score for any of them; ties go to
the smaller id; fewer candidates than k give all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.runtime import bounded, settle, tune

#: Rows that the centroids are fitted on and the share is measured with, at most, and rows of these that are searched for.
SAMPLE, PROBES = 16384, 256
#: Rows for each cell, and the least and the greatest number of centroids of a half.
CELL, CENTROIDS = 50, (16, 1024)
#: The share of the true neighbours that the visited cells should hold; a little above what is asked for.
RECALL = 0.95
#: Entries in a block, about; queries scored at once.
BLOCK, AT_ONCE = 8192, 128
_PARTITION_BITS = 36


def _fit(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from rows spread evenly over the sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        for j in range(len(c)):
            if (m := near == j).any():
                c[j] = x[m].mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance, until they hold the wanted number of entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if n := sizes[o1[i], o2[j]]:
            out.append((int(o1[i]), int(o2[j])))
            held += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def share_of(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
    """The share of entries, in the order in which cells are visited, that holds recall of the k nearest, measured within x."""
    half, n = c1.shape[1], len(x)
    if n <= 2 * k:
        return 1.0
    a1, a2 = _nearest(x[:, :half], c1), _nearest(x[:, half:], c2)
    places = []
    for at in np.linspace(0, n - 1, min(probes, n)).astype(int).tolist():
        true, coarse = x @ x[at], (c1 @ x[at, :half])[a1] + (c2 @ x[at, half:])[a2]
        true[at], coarse[at] = -np.inf, -np.inf
        best = np.argpartition(-true, k)[:k]
        places.append(np.searchsorted(np.sort(-coarse), -coarse[best], side="right") / n)
    return float(np.quantile(np.concatenate(places), recall))


def _best(ids: np.ndarray, x: np.ndarray, scores: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, place and score of the k best entries for each query.

    scores are the products as a matrix product gives them, -inf where not visited; those near the k-th are computed anew in one
    order of summation, so that equal vectors have equal scores.
    """
    scores[ids[None, :] == own[:, None]] = -np.inf
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        bound = np.where(kth > -np.inf, kth - 1e-9 * (1 + np.abs(kth)), -np.finfo(float).max)
        number, near = np.nonzero(scores >= bound[:, None])
    else:
        number, near = np.nonzero(scores > -np.inf)
    exact = (x[near] * q[number]).sum(axis=1)
    order = np.lexsort((ids[near], -exact, number))
    number, near, exact = number[order], near[order], exact[order]
    starts = np.searchsorted(number, number)
    keep = np.arange(len(number)) - starts < k
    return number[keep], near[keep], exact[keep]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vec of the rows that take part, but for the length."""
    v = F.col(vector).cast("array<double>")
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & sound)


def blocks_of(sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each first centroid: small ones share a block, large ones are split."""
    first, parts, number, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            number, held = number + 1, 0
        first[k], parts[k] = number, max(1, -(-n // block))
        held += n
        if parts[k] > 1:
            number, held = number + int(parts[k]), 0
    return first, parts


def search(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", centroids: int | None = None, share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id is divisible by every."""
    spark = tune(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    given = usable(vectors, key, vector)
    widest = given.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widest is None:
        return spark.createDataFrame([], schema)
    dim, total = widest["n"], widest["count"]
    given = given.filter(F.size("vec") == dim)
    half = max(1, dim // 2)
    rows = bounded(given, sample, "vec_id", "vec").select("vec").collect()
    x = np.array([r["vec"] for r in rows], float)
    centroids = centroids or int(min(max(np.sqrt(total / CELL), CENTROIDS[0]), CENTROIDS[1], max(1, len(x) // 16)))
    c1 = _fit(x[:, :half], centroids)
    c2 = _fit(x[:, half:], centroids) if half < dim else np.zeros((1, 0))
    share = share or share_of(x, c1, c2, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << _PARTITION_BITS
        for b in batches:
            v = np.array(b.column("vec").to_pylist(), float).reshape(b.num_rows, dim)
            a1, a2 = _nearest(v[:, :half], c1), _nearest(v[:, half:], c2) if half < dim else np.zeros(len(v), int)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.arange(row, row + len(v))), pa.array(a1, pa.int32()), pa.array(a2, pa.int32()), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "row", "c1", "c2", "vec"])
            row += len(v)

    entries = settle(given.mapInArrow(assign, "vec_id long, row long, c1 int, c2 int, vec binary"), "entries")
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # as many rows as cells, at most
        sizes[r["c1"], r["c2"]] = r["count"]
    first, parts = blocks_of(sizes.sum(axis=1))
    at_block = F.array(*[F.lit(int(f)) for f in first])[F.col("c1")] + F.pmod(F.xxhash64("vec_id"), F.array(*[F.lit(int(p)) for p in parts])[F.col("c1")])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("block", "query_id", "form", "vec", "cells")}
            for q, own, form, raw in zip(*(b.column(c).to_pylist() for c in ("vec_id", "own", "form", "vec")), strict=True):
                v = np.frombuffer(raw)
                by: dict[int, list[int]] = {}
                for i, j in traverse(-(c1 @ v[:half]), -(c2 @ v[half:]), sizes, max(share * total, k + own)):
                    for p in range(int(parts[i])):
                        by.setdefault(int(first[i]) + p, []).append(i * len(c2) + j)
                for block, cells in by.items():
                    for n, value in zip(out, (block, q, form, raw, cells), strict=True):
                        out[n].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["query_id"], pa.int64()), pa.array(out["form"], pa.int32()), pa.array(out["vec"], pa.binary()), pa.array(out["cells"], pa.list_(pa.int32()))], list(out))

    # The rows of one id are one query, in as many forms as they have vectors.
    asked = entries.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.count("*").alias("own"), F.sort_array(F.collect_set("vec")).alias("vecs"))
    # A query is a small row and much work, so the queries are spread by number and not by size.
    spread = asked.select("vec_id", "own", F.posexplode("vecs").alias("form", "vec")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id", "form")
    queries = spread.mapInArrow(visit, "block long, query_id long, form int, vec binary, cells array<int>")
    blocks = entries.withColumn("block", at_block.cast("long"))

    def rerank(entry: pa.Table, query: pa.Table) -> pa.Table:
        ids, rows = entry.column("vec_id").to_numpy(), entry.column("row").to_numpy()
        cell = entry.column("c1").to_numpy() * len(c2) + entry.column("c2").to_numpy()
        e = np.frombuffer(b"".join(entry.column("vec").to_pylist())).reshape(-1, dim)
        here, place = np.unique(cell, return_inverse=True)
        qid, forms = query.column("query_id").to_numpy(), query.column("form").to_numpy()
        raws, cells = query.column("vec").to_pylist(), query.column("cells").to_pylist()
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for at in range(0, len(qid) if len(ids) else 0, AT_ONCE):
            q = np.frombuffer(b"".join(raws[at : at + AT_ONCE])).reshape(-1, dim)
            open_ = np.array([np.isin(here, c) for c in cells[at : at + AT_ONCE]])
            scores = np.where(open_[:, place], q @ e.T, -np.inf)
            number, got, score = _best(ids, e, scores, q, qid[at : at + AT_ONCE], k)
            for c, v in zip(found, (qid[at + number], forms[at + number], rows[got], ids[got], score), strict=True):
                c.append(v)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table([*(pa.array(c.astype(np.int64)) for c in flat[:4]), pa.array(flat[4].astype(float))], ["query_id", "form", "row", "vec_id", "score"])

    part = blocks.groupBy("block").cogroup(queries.groupBy("block")).applyInArrow(rerank, "query_id long, form long, row long, vec_id long, score double")
    # A candidate row may come back for several forms of a query: the best of each form first, then of all, a row once.
    of_form = Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id", "row")
    few = part.withColumn("rank", F.row_number().over(of_form)).filter(F.col("rank") <= k)
    once = few.repartition("query_id").groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
