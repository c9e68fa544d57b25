"""Removal of repeated passages by difference-cover suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts earlier: in a document with a smaller id, or before in the
same one.

1. Every window of SPAN bytes has an anchor: the place of its least gram of GRAM bytes, grams that are frequent in the
   corpus ordered last, the leftmost among equals.  Equal windows have equal anchors at equal offsets, so
   equal windows meet if anchors are brought together.  The windows with one anchor are one segment, of 2 * SPAN bytes at most.
2. Segments equal as a whole are one; the earliest stands for them and the others are repeats.  This is done in each worker
   before anything is shuffled, so a passage with very many copies is a row for each run of documents.
3. Anchors with several different segments go on.  Their segments' bytes are fetched, dealt out by anchor, and in each
   part a suffix array is built by the difference cover of 3: sampled triples are sorted and named, names recursed on, the
   remaining suffixes sorted by them and merged; adjacent suffixes that agree in SPAN bytes form groups, of which the
   earliest stays.

A difference-cover array over all suffixes of the corpus would shuffle tens of times the input; step 2 leaves the
suffixes whose order is in question.

Defined results: null or empty text and texts below SPAN bytes lose nothing; rows without doc_id have no place in the order: they
lose nothing and make no other row lose; rows with one doc_id and equal text stand at the same places, so neither comes
before the other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.runtime import lean, settle, texts_of, tune, two_columns
from skeinwork.llm.shingles import mix, powers

SPAN, GRAM = 100, 32
_GRAMS = SPAN - GRAM + 1
#: Bytes hashed at once: their places fit in the low bits of a key.
_BITS = 20
BLOCK = 1 << _BITS
#: Bytes gathered in a worker before equal segments are merged, and segments in a part.
RUN, PART = 8 << 20, 300_000
#: Frequent grams that the order knows, at most, and the least count in a block that is reported.
HEAVY, BLOCK_LEAST = 500_000, 16
SLOTS = 1 << 23
_U = np.uint64
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---- hashing


def _sums(raw: np.ndarray) -> np.ndarray:
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(BLOCK)[0][: len(raw)], out=run[1:])
    return run


def _hash(run: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, down: np.ndarray) -> np.ndarray:
    return mix((run[end] - run[start]) * down)


def _gram_hashes(run: np.ndarray) -> np.ndarray:
    n = len(run) - GRAM
    return _hash(run, slice(0, n), slice(GRAM, None), powers(BLOCK)[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def _blocks(ids: list[int | None], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, offset in the row's text, end) of blocks: several short texts, or a part of a long one; parts overlap by SPAN - 1.

    The last three have one entry for each text in the block: its row, the offset of its part, and where its bytes end.
    """
    rows, parts, offsets, size = [], [], [], 0

    def block():
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), np.cumsum([len(p) for p in parts])

    for row, (key, text) in enumerate(zip(ids, texts, strict=True)):
        if key is None:
            continue
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - SPAN + 1), BLOCK - SPAN + 1):
            part = data[at : at + BLOCK]
            if len(part) < SPAN:
                continue
            if size + len(part) > BLOCK and parts:
                yield block()
                rows, parts, offsets, size = [], [], [], 0
            rows.append(row)
            parts.append(part)
            offsets.append(at)
            size += len(part)
    if parts:
        yield block()


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width keys."""
    k = 1
    m = keys
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Frequent:
    """A set of grams: a table of their upper bits passes most others over before they are searched for."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.table = np.zeros(1 << 20, bool)
        self.table[(grams >> _U(44)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where grams has one of the set."""
        if not len(self.grams):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(grams >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, grams[near]), len(self.grams) - 1)
        return near[self.grams[at] == grams[near]]


def _segments(raw: np.ndarray, ends: np.ndarray, heavy: Frequent) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, gram hash, segment hash) of each segment of a block; places are in the block."""
    if len(raw) < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    run = _sums(raw)
    grams = _gram_hashes(run)
    keys = grams >> _U(1)
    keys[heavy.places(grams)] |= _U(1 << 63)
    keys = (keys & ~_U(BLOCK - 1)) | np.arange(len(keys), dtype=np.uint64)
    anchor = (_least(keys, _GRAMS) & _U(BLOCK - 1)).astype(np.int64)
    # A text of a block has SPAN bytes at least; the windows that run over its end are no windows.
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins - SPAN + 1
    owner = np.repeat(np.arange(len(ends)), counts)
    starts = np.arange(len(owner)) + (begins - np.concatenate([[0], np.cumsum(counts)[:-1]]))[owner]
    anchor = anchor[starts]
    if not len(starts):
        return _segments(raw[:0], ends, heavy)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(owner) != 0)]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    spot = anchor[new]
    whole = (run[last + SPAN] - run[first]) * powers(BLOCK)[1][first]
    whole = mix(whole + (last - first).astype(np.uint64) * _U(0x9E3779B1) + (spot - first).astype(np.uint64) * _U(0x85EBCA77C2B2AE63))
    return owner[new], first, last, grams[spot], whole


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Grams met very often: counted in blocks over all texts; those of the largest sums, by a threshold that bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for raw, _, _, _ in _blocks(b.column("doc_id").to_pylist(), texts_of(b)):
                grams = np.sort(_gram_hashes(_sums(raw)))
                starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                times = np.diff(np.append(starts, len(grams)))
                often = times >= BLOCK_LEAST
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array(grams[starts[often]].view(np.int64)), pa.array(times[often])], ["gram", "times"])

    counted = docs.mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    found = settle(counted, "grams")
    total = found.agg(F.sum("times")).first()[0] or 0
    rows = found.filter(F.col("times") > total // HEAVY).select("gram").toPandas()  # fewer than HEAVY
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


# ---- equal segments

_DEALT = "part long, doc_id long, ids binary, docs binary, firsts binary, spans binary, grams binary, wholes binary"


def _firsts(order_keys: tuple[np.ndarray, ...], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order by keys, id and place; where groups of equal keys start; for each in order, whether it comes after its group's first."""
    o = np.lexsort((first, doc, *reversed(order_keys)))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in order_keys:
        new[1:] |= k[o][1:] != k[o][:-1]
    starts = np.flatnonzero(new)
    lead = np.repeat(o[starts], np.diff(np.append(starts, len(o))))
    after = (doc[o] != doc[lead]) | (first[o] != first[lead])
    return o, starts, after


def _spans_by_doc(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Spans of each document as pairs of 64-bit numbers, runs that touch joined."""
    if not len(doc):
        return [], []
    o = np.lexsort((first, doc))
    doc, first, last = doc[o], first[o], last[o]
    joins = (doc[1:] == doc[:-1]) & (first[1:] <= last[:-1] + SPAN)
    starts = np.flatnonzero(np.concatenate([[True], ~joins]))
    ends = np.maximum.reduceat(last, starts)
    doc, pairs = doc[starts], np.stack([first[starts], ends], axis=1)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return doc[np.concatenate([[0], cuts])].tolist(), [p.tobytes() for p in np.split(pairs, cuts)]


def _deal(docs: DataFrame, heavy: np.ndarray, parts: int) -> DataFrame:
    """Segments dealt to parts by gram, equal ones of a run merged; repeats found here are rows of part -1."""
    known = docs.sparkSession.sparkContext.broadcast(Frequent(heavy))

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, first, last, gram, whole = (np.concatenate(c) for c in zip(*held, strict=True))
        o, _, after = _firsts((gram, whole), doc, first)
        again, stay = o[after], o[~after]
        rows = [(-1, d, b"", b"", s, b"", b"", b"") for d, s in zip(*_spans_by_doc(doc[again], first[again], last[again]), strict=True)]
        doc, first, last, gram, whole = (x[stay] for x in (doc, first, last, gram, whole))
        # Anchors are least grams, so their values crowd at the low end: they are mixed before they are dealt.
        part = ((mix(gram) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        doc, first, last, gram, whole, part = (x[o] for x in (doc, first, last, gram, whole, part))
        cuts = np.flatnonzero(np.diff(part)) + 1
        for d, f, n, g, w, k in zip(*(np.split(x, cuts) for x in (doc, first, last - first, gram, whole)), part[np.concatenate([[0], cuts])].tolist() if len(part) else [], strict=False):
            own, back = np.unique(d, return_inverse=True)
            rows.append((k, None, own.tobytes(), back.astype(np.uint32).tobytes(), f.astype(np.uint32).tobytes() if f.max() < 1 << 32 else f.tobytes(), n.astype(np.uint8).tobytes(), g.astype(np.uint32).tobytes(), w.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(2)] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(2, 8)], ["part", "doc_id", "ids", "docs", "firsts", "spans", "grams", "wholes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for raw, rows, offsets, ends in _blocks(ids, texts_of(b)):
                own, first, last, gram, whole = _segments(raw, ends, known.value)
                if not len(own):
                    continue
                shift = (offsets - np.concatenate([[0], ends[:-1]]))[own]
                doc = np.array([ids[r] for r in rows], np.int64)[own]
                held.append((doc, first + shift, last + shift, gram, whole))
                size += len(raw)
                if size >= RUN:
                    yield flush(held)
                    held, size = [], 0
                    lean()
        if held:
            yield flush(held)

    return docs.mapInArrow(run, _DEALT)


def _match(dealt: DataFrame) -> DataFrame:
    """doc_id, wanted (null: repeats; else what is to be compared) and spans, for each document of a part.

    wanted has a gram for each segment whose bytes are needed.
    """

    def run(table: pa.Table) -> pa.Table:
        lean()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, d, f, n, g, w in zip(*(table.column(k).to_pylist() for k in ("ids", "docs", "firsts", "spans", "grams", "wholes")), strict=True):
            back = np.frombuffer(d, np.uint32)
            first = np.frombuffer(f, np.uint32 if len(f) == 4 * len(back) else np.int64).astype(np.int64)
            for c, x in zip(cols, (np.frombuffer(i, np.int64)[back], first, first + np.frombuffer(n, np.uint8), np.frombuffer(g, np.uint32), np.frombuffer(w, np.uint64)), strict=True):
                c.append(x)
        doc, first, last, gram, whole = map(np.concatenate, cols)
        o, starts, after = _firsts((gram, whole), doc, first)
        again = o[after]
        ids, spans = _spans_by_doc(doc[again], first[again], last[again])
        lead = o[starts]
        g = gram[lead]
        differ = np.zeros(len(g), bool)
        differ[1:] |= g[1:] == g[:-1]
        differ[:-1] |= g[1:] == g[:-1]
        lead = lead[differ]
        lead = lead[np.argsort(doc[lead], kind="stable")]
        part = np.uint64(table.column("part")[0].as_py()) << _U(32)
        d = doc[lead]
        cuts = np.flatnonzero(np.diff(d)) + 1
        pairs = np.stack([first[lead], last[lead]], axis=1)
        named = part | gram[lead].astype(np.uint64)
        more = [x for x in zip(d[np.concatenate([[0], cuts])].tolist() if len(d) else [], np.split(pairs, cuts), np.split(named, cuts), strict=False)]
        return pa.table([pa.array(ids + [m[0] for m in more], pa.int64()), pa.array([None] * len(ids) + [m[2].tobytes() for m in more], pa.binary()), pa.array(spans + [m[1].tobytes() for m in more], pa.binary())], ["doc_id", "wanted", "spans"])

    return dealt.filter("part >= 0").groupBy("part").applyInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("wanted", T.BinaryType()), T.StructField("spans", T.BinaryType())]))


# ---- difference cover


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of tuples of numbers."""
    rank = keys[0]
    for k in keys[1:]:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64) * _U(int(k.max(initial=0)) + 1) + k.astype(np.uint64)
    return np.unique(rank, return_inverse=True)[1] + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of an array of numbers from 0, by the difference cover {1, 2} of 3."""
    n = len(s)
    if n < 8:
        items = s.tolist()
        return np.array(sorted(range(n), key=lambda i: items[i:]), np.int64)
    # A text of length 1 mod 3 gets a sample suffix beyond its end, so that every sampled place has its neighbours sampled.
    t = np.concatenate([s.astype(np.uint64) + _U(1), np.zeros(4, np.uint64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    top = int(t.max()) + 1
    if top < 1 << 21:
        names = np.unique((t[sample] * _U(top) + t[sample + 1]) * _U(top) + t[sample + 2], return_inverse=True)[1] + 1
    else:
        names = _ranked(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    rank = np.zeros(n + 5, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zeros = np.arange(0, n, 3)
    wide = _U(len(sample) + 1)
    key0 = t[zeros] * wide + rank[zeros + 1]
    o = np.argsort(key0, kind="stable")
    zeros, key0 = zeros[o], key0[o]
    mod1, mod2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    below1 = np.searchsorted(t[mod1] * wide + rank[mod1 + 1], key0)
    pair = np.unique(np.concatenate([t[zeros] * _U(top) + t[zeros + 1], t[mod2] * _U(top) + t[mod2 + 1]]), return_inverse=True)[1].astype(np.uint64)
    below2 = np.searchsorted(pair[len(zeros) :] * wide + rank[mod2 + 2], pair[: len(zeros)] * wide + rank[zeros + 2])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = np.arange(len(zeros)) + below1 + below2
    out[at] = zeros
    taken[at] = True
    out[~taken] = sorted_sample
    return out


def repeats(texts: list[bytes], docs: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of the windows of SPAN bytes for which an equal one has a smaller (id, place in the document)."""
    ends = np.cumsum([len(x) + 1 for x in texts])
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = flat.astype(np.int64) + 1
    symbols[ends - 1] = 0
    array = suffix_array(symbols)
    owner = np.searchsorted(ends, array, side="right")
    fits = array + SPAN <= ends[owner] - 1
    array, owner = array[fits], owner[fits]
    if not len(array):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(array), bool)
    view = np.lib.stride_tricks.sliding_window_view(flat, SPAN)
    for at in range(1, len(array), 1 << 16):
        to = min(len(array), at + (1 << 16))
        same[at:to] = (view[array[at:to]] == view[array[at - 1 : to - 1]]).all(axis=1)
    group = np.cumsum(~same)
    begin = np.concatenate([[0], ends[:-1]])
    place = array - begin[owner]
    doc, where = docs[owner], firsts[owner] + place
    o, _, after = _firsts((group,), doc, where)
    hit = o[after]
    return owner[hit], place[hit]


def _compare(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """doc_id and spans of the repeats among the wanted segments."""
    given = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted", "spans")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            owners, names, pairs, texts = [], [], [], []
            for doc, text, named, spans in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "wanted", "spans")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                own = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
                fits = own[:, 1] + SPAN <= len(data)  # rows with this id and another text may be shorter
                own = own[fits]
                names.append(np.frombuffer(b"".join(named), np.uint64)[fits])
                pairs.append(own)
                owners.append(np.full(len(own), doc, np.int64))
                texts += [data[i : j + SPAN] for i, j in own.tolist()]
            if not texts:
                continue
            doc, pair = np.concatenate(owners), np.concatenate(pairs)
            part = ((mix(np.concatenate(names)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[o])) + 1
            sizes = (pair[:, 1] - pair[:, 0] + SPAN).astype(np.int32)
            packed = [(int(part[g[0]]), doc[g].tobytes(), pair[g, 0].tobytes(), sizes[g].tobytes(), b"".join([texts[k] for k in g.tolist()])) for g in np.split(o, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64())] + [pa.array([p[j] for p in packed], pa.binary()) for j in range(1, 5)], ["part", "docs", "firsts", "sizes", "bytes"])

    def run(table: pa.Table) -> pa.Table:
        lean()
        doc, first, texts = [], [], []
        for d, f, n, raw in zip(*(table.column(k).to_pylist() for k in ("docs", "firsts", "sizes", "bytes")), strict=True):
            doc.append(np.frombuffer(d, np.int64))
            first.append(np.frombuffer(f, np.int64))
            at = 0
            for size in np.frombuffer(n, np.int32).tolist():
                texts.append(raw[at : at + size])
                at += size
        d, f = np.concatenate(doc), np.concatenate(first)
        own, place = repeats(texts, d, f)
        ids, spans = _spans_by_doc(d[own], f[own] + place, f[own] + place)
        return pa.table([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "spans"])

    dealt = given.mapInArrow(fetch, "part long, docs binary, firsts binary, sizes binary, bytes binary")
    return dealt.groupBy("part").applyInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.BinaryType())]))


# ---- removal


def cut(text: str, spans: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What is left of the text's bytes, and the maximal removed runs as (start, end)."""
    data = text.encode("utf-8", "surrogatepass")
    if not len(spans):
        return data, np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    first, end = spans[:, 0], np.maximum.accumulate(spans[:, 1] + SPAN)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    runs = np.stack([first[starts], end[np.append(starts[1:], len(first)) - 1]], axis=1)
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), runs


def _bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits of hashed ids, at the driver."""
    s = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    rows = ids.select(s.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(SLOTS // 8 + 8192, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _with_hits(docs: DataFrame, bits: np.ndarray) -> tuple[DataFrame, callable]:
    """docs with the place of their id in the bitmap, and a function that tells for a batch which rows it has."""
    known = docs.sparkSession.sparkContext.broadcast(bits)
    s = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))

    def hit(b: pa.RecordBatch) -> np.ndarray:
        at, bit = (b.column(k).to_numpy(zero_copy_only=False) for k in ("__at", "__bit"))
        here = (known.value[(at - 1) * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
        return here.astype(bool) & ~np.asarray(b.column("doc_id").is_null())

    return docs.withColumn("__at", F.bitmap_bucket_number(s)).withColumn("__bit", F.bitmap_bit_position(s)), hit


def _hits(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows that the bitmap has."""
    marked, hit = _with_hits(docs, bits)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            yield b.filter(pa.array(hit(b))).select(names)

    return marked.mapInArrow(run, docs.schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (an array of packed pairs: first and last window start) of the documents that lose bytes; docs has doc_id and text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(-(-size // (PART * _GRAMS // 2)), least)
    dealt = settle(_deal(docs, frequent_grams(docs), parts), "segments")
    matched = settle(_match(dealt), "matched")
    wanted = matched.filter("wanted is not null").groupBy("doc_id").agg(F.collect_list(F.struct("wanted", "spans")).alias("x")).select("doc_id", F.col("x.wanted").alias("wanted"), F.col("x.spans").alias("spans"))
    near = _hits(docs, _bits(matched.filter("wanted is not null")))
    more = _compare(near, wanted, 4 * parts)  # an array takes some hundred bytes for each of its places
    here = dealt.filter("part = -1").select("doc_id", F.col("firsts").alias("spans"))
    every = here.unionByName(matched.filter("wanted is null").select("doc_id", "spans")).unionByName(more)
    return settle(every.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "repeats")


def _apply(docs: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """run over docs with their spans; only documents that may lose bytes are shuffled."""
    bits = _bits(found)
    marked, hit = _with_hits(docs, bits)
    names = docs.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = b.filter(pa.array(~hit(b))).select(names)
                yield kept.append_column("spans", pa.nulls(kept.num_rows, pa.list_(pa.binary())))

        yield from run(left())

    return marked.mapInArrow(whole, schema).unionByName(_hits(docs, bits).join(found, "doc_id", "left").mapInArrow(run, schema))


def _pairs(spans: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(spans or []), np.int64).reshape(-1, 2)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    tune(docs.sparkSession)
    docs = two_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            sizes, removed, runs, shas = [], [], [], []
            for x, s in zip(texts_of(b), b.column("spans").to_pylist(), strict=True):
                left, gone = cut(x, _pairs(s))
                lost = int((gone[:, 1] - gone[:, 0]).sum())
                sizes.append(len(left) + lost)
                removed.append(lost)
                runs.append(len(gone))
                shas.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _apply(docs, find(docs), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages taken out of the text.  Parts of a character that a cut leaves behind are dropped too."""
    tune(docs.sparkSession)
    whole = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields])
    # The row travels as one column, so its columns cannot clash with those used here.
    packed = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.struct(*[F.lit(None).cast("string").alias(c) if c == text else F.col(c) for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            new = [x if x is None or not s else cut(x, _pairs(s))[0].decode("utf-8", "ignore") for x, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], ["row", "new"])

    found = find(packed.select("doc_id", "text"))
    out = _apply(packed, found, run, T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("new", T.StringType())]))
    return out.select(*[F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in whole.fieldNames()])
