"""Packing of token sequences by lexical retrieval.

Documents are dealt to shards of about SHARD tokens by their words and not by where they lie, so that related ones meet.  A document
has a place in a lexical order: the nearest of the centroids of weighted terms, the nearest centroid within it, and then its
least term by a hash that favours rare terms, which near copies share.  Shards are runs of that order; a run of one place that is
larger than a shard is split by row.  Weights come from the number of documents that hold each term, counted over all of them, and
centroids are means over all documents: ROUNDS rounds of Lloyd, each a pass over the documents' vectors.

A shard has its own BM25 inverted index, and is searched by its own documents only.  A document's full windows are sequences of
their own; what is left over is packed: the next unused
document is the seed of a window, the index returns its unused neighbours by score, and they fill the window in
that order, whole ones first among the LOOK best, then the best of the others, cut to what room is left.  The rest of a
cut document is the seed of the next window.  Only the last window of a shard can have padding.

Defined results: a null or empty text is the one end token; a null id is kept; repeated rows are each packed; extra
columns are ignored; texts of any length are packed whole.  sequence_id is unique over the result: shard, then a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.ann import _fit, _nearest
from skeinwork.llm.bpe import TOGETHER, WORDS_KEPT, encoder
from skeinwork.llm.runtime import lean, settle, tokenizer_path, tune, two_columns
from skeinwork.llm.shingles import mix

SIZE, END = 2048, 1
#: Tokens in a shard, about.
SHARD = 1_500_000
LOOK = 32
K1, B = 1.2, 0.75
_SHARD_BITS = 36
#: Centroids, centroids within all of them together, and runs within each of those.
COARSE, CELLS, RUNS = 16, 256, 64
#: Passes over all vectors in which centroids move, and tasks of a pass for each core.
ROUNDS, TASKS = 4, 4
#: Terms are added up in so many dimensions.
DIMS = 256
#: A vector's length in its whole numbers, so that sums of vectors are exact in any order.
UNIT = 16384


class Bm25:
    """Inverted index over the documents of a shard.  Terms in half of the documents or more have no positive weight and no list."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found])
        self.terms = [t for t, _ in found]
        term = np.concatenate([t for t, _ in found]) if n else np.zeros(0, np.uint32)
        times = np.concatenate([c for _, c in found]).astype(np.float32) if n else np.zeros(0, np.float32)
        doc = np.repeat(np.arange(n), sizes)
        length = np.array([len(d) for d in docs], float)
        weight = times * (K1 + 1) / (times + (K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1)))[doc])
        df = np.bincount(term, minlength=1)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        keep = idf[term] > 0
        term, doc, weight = term[keep], doc[keep], weight[keep]
        o = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[o], (weight * idf[term])[o].astype(np.float64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the terms of the seed."""
        t = self.terms[seed]
        a, b = self.start[t], self.start[t + 1]
        sizes = b - a
        total = int(sizes.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(docs: list[np.ndarray], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    out: list[tuple[int, int, int, int, int]] = []
    left = np.array([len(d) for d in docs], np.int64)
    start = np.zeros(len(docs), np.int64)
    sequence = 0
    for d, n in enumerate(left.tolist()):
        for k in range(n // size):
            out.append((d, k * size, size, sequence, 0))
            sequence += 1
        start[d] = n // size * size
    left -= start
    index = Bm25(docs)
    unused = left > 0
    carry, at = -1, 0
    while True:
        if carry < 0:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                return out
            carry = at
        seed, carry, room = carry, -1, size

        def take(d: int) -> None:
            nonlocal room
            n = min(int(left[d]), room)
            out.append((d, int(start[d]), n, sequence, size - room))
            start[d] += n
            left[d] -= n
            room -= n
            unused[d] = False

        take(seed)
        if room and unused.any():
            scores = index.scores(seed)
            scores[~unused] = -1
            ranked = np.argsort(-scores, kind="stable")[: int(unused.sum())]
            for d in ranked[:LOOK].tolist():
                if left[d] <= room and room:
                    take(d)
            for d in ranked.tolist():
                if not room:
                    break
                if unused[d]:
                    take(d)
                    if left[d]:
                        carry = d
        sequence += 1


class LexicalOrder:
    """Places of documents in an order in which documents with common terms are near each other."""

    def __init__(self, df: np.ndarray, n: int):
        """df: how many of the n documents hold each term."""
        weight = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        term = np.arange(len(df), dtype=np.uint64)
        h, g = mix(term), mix(term + np.uint64(1))
        #: By term: dimension, signed weight, and rank by the hash that favours rare terms.
        self.dim = (h % np.uint64(DIMS)).astype(np.int64)
        self.signed = np.where(h >> np.uint64(63), -weight, weight)
        self.rank = -np.log(((g >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / np.maximum(weight, 1e-9)
        self.cells = self.coarse = np.zeros((1, DIMS))
        self.first = np.array([0, 1])

    def start(self, x: np.ndarray) -> None:
        """Centroids to begin with: these vectors, and groups of them."""
        if not len(x):
            return
        coarse = _fit(x / UNIT, COARSE)
        near = _nearest(x / UNIT, coarse)
        o = np.argsort(near, kind="stable")
        groups, first = np.unique(near[o], return_index=True)
        #: Cells of a coarse centroid are those from its first to that of the next.
        self.coarse, self.cells, self.first = coarse[groups], x[o] / UNIT, np.append(first, len(x))

    def move(self, n: np.ndarray, total: np.ndarray) -> None:
        """Each centroid to the mean of its documents; n and total are the number and sum of the vectors in each cell."""
        for c, ks in [(self.cells, [(k, k + 1) for k in range(len(self.cells))]), (self.coarse, list(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)))]:
            for k, (a, b) in enumerate(ks):
                if m := int(n[a:b].sum()):
                    c[k] = total[a:b].sum(axis=0) / (m * UNIT)

    def vectors(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each document's weighted terms added up in DIMS dimensions, as a vector of length UNIT in whole numbers."""
        at = np.repeat(np.arange(len(sizes)) * DIMS, sizes) + self.dim[flat]
        v = np.bincount(at, self.signed[flat], len(sizes) * DIMS).reshape(-1, DIMS)
        return np.rint(v * (UNIT / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))).astype(np.int16)

    def runs(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The run within its cell of each document, by its least term."""
        least = np.minimum.reduceat(self.rank[flat], np.cumsum(sizes) - sizes)
        return (mix(least.view(np.uint64)) % np.uint64(RUNS)).astype(np.int64)

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        x = x / UNIT
        coarse = _closest(x, self.coarse)
        out = np.zeros(len(x), np.int64)
        for k in np.unique(coarse).tolist():
            own = coarse == k
            out[own] = self.first[k] + _closest(x[own], self.cells[self.first[k] : self.first[k + 1]])
        return out


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """_nearest without the matrix library, whose threads cost a worker more than so small a product."""
    return np.argmin((c**2).sum(axis=1) - 2 * np.einsum("ij,kj->ik", x, c), axis=1)


def _shards(tokens: dict[int, int], shard: int) -> list[tuple[int, int, int]]:
    """(place, first shard, number of shards) of each place: consecutive places share a shard until it is full."""
    out, number, held = [], 0, 0
    for place in sorted(tokens):
        n = tokens[place]
        if held and held + n > shard:
            number, held = number + 1, 0
        split = max(1, -(-n // shard))
        out.append((place, number, split))
        held += n
        if split > 1:
            number, held = number + split, 0
    return out


def _frequencies(tokens: DataFrame, tasks: int) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and the number of documents: one row for each term of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1, np.int64), 0
        for b in batches:
            if b.num_rows:
                terms = np.concatenate([np.unique(np.frombuffer(r, np.uint32)) for r in b.column("ids").to_pylist()])
                more, n = np.bincount(terms, minlength=len(df)), n + b.num_rows
                more[: len(df)] += df
                df = more
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], n))], ["term", "n"])

    found = {r["term"]: r["n"] for r in tokens.select("ids").coalesce(tasks).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, df = found.pop(-1, 0), np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return df, n


def _order(tokens: DataFrame, tasks: int) -> tuple[LexicalOrder, dict[int, int]]:
    """The lexical order of all documents, and the tokens in each of its places."""
    order = LexicalOrder(*_frequencies(tokens, tasks))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                docs = [np.frombuffer(r, np.uint32) for r in b.column("ids").to_pylist()]
                flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
                yield pa.RecordBatch.from_arrays([pa.array(order.runs(flat, sizes)), pa.array(sizes), pa.array([v.tobytes() for v in order.vectors(flat, sizes)], pa.binary())], ["run", "n", "x"])

    seen = settle(tokens.select("ids").mapInArrow(project, "run long, n long, x binary"), "vectors").coalesce(tasks)
    begin = seen.select("x").orderBy(F.xxhash64("x"), "x").limit(4 * CELLS).collect()
    order.start(_rows(list(dict.fromkeys(bytes(r["x"]) for r in begin))[:CELLS]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(order.cells), np.int64), np.zeros((len(order.cells), DIMS), np.int64)
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("x").to_pylist())
                cell = order.cells_of(x)
                n += np.bincount(cell, minlength=len(n))
                o = np.argsort(cell, kind="stable")
                held, first = np.unique(cell[o], return_index=True)
                total[held] += np.add.reduceat(x[o].astype(np.int64), first)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array([t.tobytes() for t in total[held]], pa.binary())], ["cell", "n", "total"])

    def together(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t, np.int64) for t in part.column("total").to_pylist()], axis=0)
        return pa.table([pa.array([part.column("cell")[0].as_py()], pa.int64()), pa.array([sum(part.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["cell", "n", "total"])

    for _ in range(ROUNDS):  # a row for each cell comes to the driver
        n, total = np.zeros(len(order.cells), np.int64), np.zeros((len(order.cells), DIMS), np.int64)
        for r in seen.select("x").mapInArrow(add, "cell long, n long, total binary").groupBy("cell").applyInArrow(together, "cell long, n long, total binary").collect():
            n[r["cell"]], total[r["cell"]] = r["n"], np.frombuffer(r["total"], np.int64)
        order.move(n, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(order.cells) * RUNS, np.int64)
        for b in batches:
            if b.num_rows:
                at = order.cells_of(_rows(b.column("x").to_pylist())) * RUNS + b.column("run").to_numpy()
                np.add.at(held, at, b.column("n").to_numpy())
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["place", "n"])

    tokens_at = seen.mapInArrow(place, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # CELLS * RUNS rows at most
    return order, {r["place"]: r["n"] for r in tokens_at}


def _rows(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.int16).reshape(-1, DIMS)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many bytes, about; a larger batch stays as it is."""
    held, n = [], 0
    for b in batches:
        if held and n + b.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(b)
        n += b.nbytes
    if held:
        yield pa.concat_batches(held)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, shard: int = SHARD, words_kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    words_kept bounds the encoder's table of words in a worker: a smaller one takes less memory and more time, and gives the same ids.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([END], np.uint32).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, speculate=False, words_kept=words_kept)
        row = TaskContext.get().partitionId() << _SHARD_BITS
        for b in _together(batches, TOGETHER):
            raws = [r + end for r in bpe.encode_column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(row, row + len(raws))), pa.array(raws, pa.binary())], ["doc_id", "row", "ids"])
            row += len(raws)

    spark = tune(docs.sparkSession)
    tokens = settle(two_columns(docs, key, text).mapInArrow(encode, "doc_id long, row long, ids binary"), "tokens")
    order, tokens_at = _order(tokens, TASKS * spark.sparkContext.defaultParallelism)
    places, first, split = np.array(_shards(tokens_at, shard), np.int64).reshape(-1, 3).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if b.num_rows:
                found = [np.frombuffer(r, np.uint32) for r in b.column("ids").to_pylist()]
                flat, sizes = np.concatenate(found), np.array([len(d) for d in found])
                at = np.searchsorted(places, order.cells_of(order.vectors(flat, sizes)) * RUNS + order.runs(flat, sizes), "right") - 1
                at = np.maximum(at, 0)
                number = first[at] + (mix(b.column("row").to_numpy().astype(np.uint64)) % split[at].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(number), b.column("ids")], ["doc_id", "shard", "ids"])

    placed = tokens.mapInArrow(deal, "doc_id long, shard long, ids binary")

    def packed(held: pa.Table) -> pa.Table:
        first = held.column("shard")[0].as_py() << _SHARD_BITS
        # The order within a shard follows from the rows and not from how they came here.
        rows = sorted(zip(held.column("doc_id").to_pylist(), held.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        raws = [r for _, r in rows]
        pieces = pack_shard([np.frombuffer(r, np.uint32) for r in raws], size)
        crc = [zlib.crc32(raws[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
        doc, start, length, sequence, offset = zip(*pieces, strict=True)
        return pa.table([pa.array(x, pa.int64()) for x in ([rows[d][0] for d in doc], start, length, crc, [len(raws[d]) // 4 for d in doc], [first + q for q in sequence], offset)], names)

    return placed.groupBy("shard").applyInArrow(packed, ", ".join(f"{n} long" for n in names))
