"""Phrase collocations: frequent phrases of two to five words, with the score of their weakest cut.

Frequent words are numbered, and every text becomes an array of numbers, -1 for all else and at the end of a piece.  Phrases then grow by a
word at a time.  A phrase is the pair (slot of its first words, slot of its last words), so it can only come up where both of its shorter
parts are frequent.  The pairs that are met are added up, each task's count cut off at the least count: a sum reaches that count exactly if the
phrase is frequent, so candidates are safe, though their sums mean nothing.  A minimal perfect hash over the candidates gives
their slots; mappers look their pairs up in it, verified by the stored pairs, and count slots in numpy arrays, which are summed as a tree.
The counts of a phrase's beginnings and ends are carried along from slot to slot, and the cuts read from them.

Whatever goes to all tasks is cut into blocks of at most WORDS words or PHRASES pairs; more of them take more rounds over the arrays, each
of which fills in the slots of one block.  The first phrases of a language are found in groups of bounded size, whose firsts meet again.

Defined results: a null text is empty; a null lang is `und`; repeated rows count each time; occurrences overlap; phrases of equal score and count
stand in the byte order of their words; extra columns are ignored; an empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.perfect_hash import PerfectHash
from skeinwork.llm.resample import ranked
from skeinwork.llm.runtime import lean, settle, texts_of, tune

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Words and pairs that are sent to all tasks at once: about 60 MB each.
WORDS, PHRASES = 400_000, 2_000_000
#: Keys that a task holds before it adds them up, and words likewise.
HELD = 2_000_000
#: Slots in one array of counts, arrays that are added at once, phrases that are sorted together.
CHUNK, ARMS, SORTED = 1 << 16, 16, 100_000
_BREAK = b"\xff"  # never part of a text in UTF-8
_FOLD = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text, with _BREAK between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(_BREAK, b" \xff ").split()


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, a) of the words met least times; a null word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            langs, words, n = [], [], []
            for lang, c in found.items():
                c.pop(_BREAK, None)
                langs += repeat(lang, len(c) + 1)
                words += [None, *(w.decode("utf-8", "surrogatepass") for w in c)]
                n += [c.total(), *c.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "a"])

        for b in batches:
            for lang, x in zip(b.column("lang").to_pylist(), texts_of(b), strict=True):
                found[lang].update(tokens(x))
            if sum(map(len, found.values())) > HELD // 4:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a")).filter(F.col("word").isNull() | (F.col("a") >= least))


def _flat(column: pa.BinaryArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays as one array, and where each row's end; rows end with -1, so none runs into the next."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype)[offsets[0] // size : offsets[-1] // size] if data else np.zeros(0, dtype), (offsets[1:] - offsets[0]) // size


def _packed(flat: np.ndarray, ends: np.ndarray, dtype: type) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(np.dtype(dtype).itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, dtype))])


def _width(n: int) -> type:
    """The kind of number that n slots need."""
    return np.int32 if n < 1 << 31 else np.int64


def numbered(docs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """seq: the word slots of each text, packed; texts without a frequent word are left out.  A round for each block of words."""
    sc, dtype, blocks = docs.sparkSession.sparkContext, _width(n_words), max(1, math.ceil(n_words / WORDS))
    docs = docs.select("lang", "text", F.lit(None).cast("binary").alias("seq"))
    for block in range(blocks):
        part = words.filter((F.col("slot") >= block * WORDS) & (F.col("slot") < (block + 1) * WORDS)).select("lang", "text", "slot").toArrow()
        slots: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, w, s in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            slots[lang][w.encode("utf-8", "surrogatepass")] = s
        sent, last = sc.broadcast(dict(slots)), block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            lean()
            for b in batches:
                langs, out = b.column("lang").to_pylist(), []
                for lang, x, old in zip(langs, texts_of(b), b.column("seq").to_pylist(), strict=True):
                    ts = tokens(x)
                    ids = np.full(len(ts) + 1, -1, dtype)
                    ids[:-1] = np.fromiter(map(sent.value.get(lang, {}).get, ts, repeat(-1)), dtype, len(ts))
                    out.append((ids if old is None else np.maximum(ids, np.frombuffer(old, dtype))).tobytes())
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x in out if np.frombuffer(x, dtype).max() >= 0], pa.binary())], ["seq"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("text"), pa.array(out, pa.binary())], ["lang", "text", "seq"])

        docs = settle(docs.mapInArrow(run, "seq binary" if last else "lang string, text string, seq binary"), "numbered")
    return docs


def _pairs(flat: np.ndarray) -> np.ndarray:
    """Where a number and the next are both slots."""
    return np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))


def candidates(seq: DataFrame, dtype: type, least: int) -> DataFrame:
    """(p, q) of the pairs of neighbours that are met least times."""

    def added(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(parts, axis=1)
        if dtype is np.int32:
            both, n = np.unique((keys[0].astype(np.int64) << 32) | keys[1], return_counts=True)
            p, q = both >> 32, both & 0xFFFFFFFF
        else:
            (p, q), n = np.unique(keys, axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(np.minimum(n, least), pa.int32())], ["p", "q", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        parts, held = [], 0
        for b in batches:
            flat, _ = _flat(b.column("seq"), dtype)
            at = _pairs(flat)
            parts.append(np.stack([flat[at], flat[at + 1]]))
            held += len(at)
            if held > HELD:
                yield added(parts)
                parts, held = [], 0
        if parts:
            yield added(parts)

    return seq.mapInArrow(run, "p long, q long, n int").groupBy("p", "q").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("p", "q")


def _mapped(seq: DataFrame, sent, base: int, dtype: type, wide: type, last: bool) -> DataFrame:
    """seq with the slots of one block of candidates filled in as cur; the last block's result has cur alone, as seq."""
    names = ["seq"] if last else ["seq", "cur"]
    first = "cur" not in seq.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            flat, ends = _flat(b.column("seq"), dtype)
            out = np.full(len(flat), -1, wide) if first else _flat(b.column("cur"), wide)[0].copy()
            at = _pairs(flat)
            slots = sent.value.find(flat[at].astype(np.int64), flat[at + 1].astype(np.int64))
            out[at[slots >= 0]] = base + slots[slots >= 0]
            cur = _packed(out, ends, wide)
            if last:
                met = np.diff(np.concatenate([[0], np.cumsum(out >= 0)[ends - 1]])) > 0 if len(ends) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([cur.filter(pa.array(met))], names)
            else:
                yield pa.RecordBatch.from_arrays([b.column("seq"), cur], names)

    return seq.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def _branches(column: str, base: int, slots: int, wide: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that counts the slots of one block in an array and gives it out in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(slots, np.int64)
        for b in batches:
            flat = _flat(b.column(column), wide)[0]
            total += np.bincount(flat[(flat >= base) & (flat < base + slots)] - base, minlength=slots)
        cut = [(k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(-(-slots // CHUNK))]
        cut = [(k, c) for k, c in cut if c.any()]
        branch = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int64()), pa.array([branch] * len(cut), pa.int64()), pa.array([c.tobytes() for _, c in cut], pa.binary())], ["chunk", "branch", "n"])

    return run


def slot_counts(seq: DataFrame, column: str, base: int, slots: int, wide: type) -> DataFrame:
    """(slot, a): how often each slot from base on is met.  The tasks' arrays are added up ARMS at a time."""

    def add(group: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x.as_py(), np.int64) for x in group.column("n")]
        return pa.table({"chunk": group.column("chunk")[:1], "branch": group.column("branch")[:1], "n": pa.array([np.sum(arrays, axis=0).tobytes()], pa.binary())})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
                n = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(base + k * CHUNK + np.arange(len(n))), pa.array(n)], ["slot", "a"])

    out, branches = seq.mapInArrow(_branches(column, base, slots, wide), "chunk long, branch long, n binary"), seq.rdd.getNumPartitions()
    while branches > 1:
        out = out.withColumn("branch", F.expr(f"branch div {ARMS}")).groupBy("chunk", "branch").applyInArrow(add, "chunk long, branch long, n binary")
        branches = math.ceil(branches / ARMS)
    return out.mapInArrow(opened, "slot long, a long")


def grown(seq: DataFrame, n_parts: int, least: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Phrases one word longer than the slots of seq, of which there are n_parts: their seq, (slot, p, q, a), and their number; None without any."""
    sc, dtype = seq.sparkSession.sparkContext, _width(n_parts)
    found = settle(candidates(seq, dtype, least), "candidates")
    n = found.count()
    if not n:
        return None
    wide, blocks, base, levels = _width(n), math.ceil(n / PHRASES), 0, []
    for block in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("p", "q"), F.lit(blocks)) == block)
        part = own.toArrow()  # PHRASES pairs or little more
        sent = sc.broadcast(PerfectHash(part.column("p").to_numpy(), part.column("q").to_numpy()))
        size = part.num_rows
        seq = settle(_mapped(seq, sent, base, dtype, wide, block == blocks - 1), "mapped")

        def placed(batches: Iterator[pa.RecordBatch], sent=sent, base=base) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slots = sent.value.find(b.column("p").to_numpy(), b.column("q").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(base + slots), b.column("p"), b.column("q")], ["slot", "p", "q"])

        counts = slot_counts(seq, "seq" if block == blocks - 1 else "cur", base, size, wide)
        levels.append(settle(own.mapInArrow(placed, "slot long, p long, q long").join(counts, "slot"), "level"))
        base += size
    level = levels[0]
    for x in levels[1:]:
        level = level.unionByName(x)
    return seq, level, n


def _described(level: DataFrame, parts: DataFrame) -> DataFrame:
    """level with lang, text, last word, and the counts of all beginnings and ends, from those of the two parts."""
    p = parts.select(F.col("slot").alias("p"), "lang", F.col("text").alias("head"), "firsts")
    q = parts.select(F.col("slot").alias("q"), "last", "rests")
    own = F.array("a")
    return level.join(p, "p").join(q, "q").select("slot", "p", "q", "lang", F.concat_ws(" ", "head", "last").alias("text"), "last", "a", F.concat("firsts", own).alias("firsts"), F.concat("rests", own).alias("rests"))


def _not_inside(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """The phrases of level without those that a phrase one word longer is as frequent as.

    One step is enough: whatever lies between a phrase and a longer one as frequent is as frequent too.
    """
    if longer is None:
        return level
    around = longer.select(F.col("p").alias("slot"), F.col("a").alias("most")).unionByName(longer.select(F.col("q").alias("slot"), F.col("a").alias("most")))
    most = around.groupBy("slot").agg(F.max("most").alias("most"))
    return level.join(most, "slot", "left").filter(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("a"))).drop("most")


def _scored(level: DataFrame, words: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of so many words; level has n.  All products fit into 38 digits."""
    a, n = F.col("a").cast("decimal(18,0)"), (1000 * F.col("n").cast("decimal(15,0)")).cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("firsts")[k - 1], F.col("rests")[words - k - 1]
        floor = F.call_function("div", a * n, left.cast("decimal(18,0)") * right.cast("decimal(19,0)"))
        cuts.append(F.struct(floor.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    least = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    return level.withColumn("cut", least).select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each language with their rank; groups of bounded size give their firsts until one group is left."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    size = max(SORTED, 2 * n)
    groups = math.ceil(rows.count() / size)
    while groups > 1:
        part = F.pmod(F.xxhash64("phrase"), F.lit(groups)).alias("part")
        rows = settle(rows.withColumn("at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("at") <= n).drop("at"), "firsts")
        groups = math.ceil(groups * n / size)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    tune(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counts = settle(word_counts(docs, least), "words")
    totals = counts.filter("word is null").select("lang", F.col("a").alias("n"))
    words = ranked(counts.filter("word is not null"), ["lang", "word"])
    words = settle(words.select((F.col("rank") - 1).alias("slot"), "lang", F.col("word").alias("text"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("rests")), "slots")
    n = words.count()
    seq, parts, levels = numbered(docs, words, n), words, []
    while len(levels) < longest - 1 and (step := grown(seq, n, least)):
        seq, level, n = step
        parts = settle(_described(level, parts), "described")
        levels.append(parts)
    out = None
    for k, level in enumerate(levels):
        kept = _not_inside(level, levels[k + 1] if k + 1 < len(levels) else None)
        part = _scored(kept.join(totals, "lang"), k + 2)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = totals.limit(0).select("lang", F.lit("").alias("phrase"), *(F.col("n").alias(c) for c in ("a", "l", "r", "n", "score")))
    return _first(settle(out, "scored"), first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
