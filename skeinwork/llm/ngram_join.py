"""N-gram Jaccard join: a prefix-tree join of shingle sets.

All sets are ordered alike: shingles that are frequent in the corpus last, by frequency class, else by hash.  Two sets that
reach the threshold share a shingle in their prefixes, the first n - ceil(t * n) + 1 of n.  Prefixes are dealt to buckets by
range of hash; shingles that no other prefix has are dropped, which leaves few.  In a bucket the sets' parts, their
shingles in one order, go into a trie.  A probe set walks the nodes that
hold its shingles from the root down: what a node shares with the probe is counted once for all sets below it, and a subtree
is left if the shingles that are still to come on either side, here and in other buckets, cannot make up the least overlap.
The overlaps of a pair over all buckets give the exact size of the prefixes' intersection, hence a bound; pairs that
stay are verified on the whole sets.

What is wanted are components, so links between sets already known to be connected need not be found.  Equal sets are one set
from the start.  The trie is walked twice.  In the first walk a node stands by its leader, so each set meets only the
leaders of the nodes that hold its shingles; verified links make first components, and a large group of near copies is joined with few leaders instead
of pair by pair.  The second walk meets all sets, but enters no subtree that lies in the probe's own component, so no link between
components is lost.  A bucket with much to compare is walked by several tasks, each with its share of the probes.

Shingles are told apart by 64-bit hashes.  Document frequencies are counted over all
documents; the list of frequent shingles is bounded (HEAVY), and any order gives the same result.

Defined results: null or empty text, or one without words, has the empty set, size 0, and is linked with nothing; rows with
one doc_id are one document; rows without doc_id have their size and a null component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinwork.llm.components import components
from skeinwork.llm.runtime import lean, settle, texts_of, tune, two_columns
from skeinwork.llm.shingles import mix, shingle_sets

#: Jaccard threshold as a fraction.
NUM, DEN = 3, 4
WIDTH = 5
#: Frequent shingles that the order knows, at most: 5 bytes each on the driver and in each worker.
HEAVY = 4_000_000
#: Sets with a shingle from which on it counts as frequent, if there are not too many.
FREQUENT = 5
#: Shingles counted at once in a worker, and in a part of the count.
RUN, PART = 2_000_000, 1_000_000
#: Prefix shingles in a bucket, about.
BUCKET = 1_000_000
#: Slots of the bitmap that keeps unneeded sets from being shuffled: 1 MB.  A full bitmap only costs time.
SLOTS = 1 << 23
#: Pairs that share a shingle in a bucket, about, from which on it is walked by one more task; and rows given on at once.
WORK, CHUNK = 20_000_000, 100_000
#: Leaders that a set is compared with after the first walk, and sets that are compared with one copy of a leader.
LEADERS, MEMBERS = 3, 64


def prefix_length(n: Column | np.ndarray | int) -> Column | np.ndarray | int:
    """n - ceil(n * NUM / DEN) + 1 for n > 0."""
    return n - (n * NUM + DEN - 1) // DEN + 1


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """For each row: n and a digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            sets = shingle_sets(texts_of(b), width)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, sets), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "n", "digest"])

    return docs.mapInArrow(run, "doc_id long, n int, digest binary")


def _classes(times: np.ndarray) -> np.ndarray:
    """Frequency classes, eight to a doubling."""
    return np.clip(8 * np.log2(np.maximum(times, 1)), 1, 255).astype(np.uint8)


def _counted(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """The frequent shingles of all documents: packed hashes (their upper 32 bits) and classes, and how many there are of each class.

    Sets are counted in runs first, so a shingle of very many documents is one number for each run.
    """

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        part = (found.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        rows = [(k, f.tobytes(), t.astype(np.uint32).tobytes() if t.max() > 1 else b"") for k, f, t in zip(part[np.concatenate([[0], cuts])].tolist(), np.split(found, cuts), np.split(times, cuts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "hashes", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0
        for b in batches:
            for s in shingle_sets(texts_of(b), width):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
            if size >= RUN:
                yield flush(held)
                held, size = [], 0
                lean()
        if size:
            yield flush(held)

    def add_up(table: pa.Table) -> pa.Table:
        lean()
        hashes, times = [], []
        for h, t in zip(table.column("hashes").to_pylist(), table.column("times").to_pylist(), strict=True):
            hashes.append(np.frombuffer(h, np.uint32))
            times.append(np.frombuffer(t, np.uint32) if t else np.ones(len(hashes[-1]), np.uint32))
        h, t = np.concatenate(hashes), np.concatenate(times)
        o = np.argsort(h, kind="stable")
        h, t = h[o], t[o]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(t.astype(np.int64), starts)
        often = total >= FREQUENT
        classes = _classes(total[often])
        return pa.table([pa.array([h[starts[often]].tobytes()], pa.binary()), pa.array([classes.tobytes()], pa.binary()), pa.array([np.bincount(classes, minlength=256).tolist()], pa.list_(pa.int64()))], ["hashes", "classes", "sizes"])

    fields = [T.StructField("hashes", T.BinaryType()), T.StructField("classes", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, "part long, hashes binary, times binary").groupBy("part").applyInArrow(add_up, T.StructType(fields))


def _order(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their classes: the highest classes of which there are HEAVY at most."""
    sizes = np.zeros(256, np.int64)
    for r in counted.select(F.posexplode("sizes").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r["k"]] = r["n"]
    above = np.cumsum(sizes[::-1])[::-1]
    least = int(np.argmax(above <= HEAVY))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.frombuffer(b"".join(b.column("hashes").to_pylist()), np.uint32)
            c = np.frombuffer(b"".join(b.column("classes").to_pylist()), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([h[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], ["hashes", "classes"])

    rows = counted.select("hashes", "classes").mapInArrow(pick, "hashes binary, classes binary").collect()
    h = np.frombuffer(b"".join(bytes(r["hashes"]) for r in rows), np.uint32)
    c = np.frombuffer(b"".join(bytes(r["classes"]) for r in rows), np.uint8)
    o = np.argsort(h, kind="stable")
    return h[o], c[o]


def _linked(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold, each once, the smaller id as a.

    The set of an a is sent once for MEMBERS of its b; the rows stream past in order, an a before its b's.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    found = ends.select(slot("id").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()  # SLOTS bits at most
    wanted = np.zeros(SLOTS // 8 + 8192, np.uint8)
    for r in found:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["k"] - 1) * 4096
        wanted[at : at + len(bits)] |= bits
    kept = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        bits = kept.value
        for b in batches:
            # A value's bucket and place as the bitmap functions give them: buckets of 32768 from 1, in which value 0 has one of its own.
            bucket, bit = b.column("bucket").to_numpy(zero_copy_only=False), b.column("bit").to_numpy(zero_copy_only=False)
            at = (bucket - 1) * 4096 + bit // 8
            here = np.flatnonzero((bits[at] >> (bit % 8).astype(np.uint8)) & 1)
            part = b.take(pa.array(here))
            found = [s.tobytes() for s in shingle_sets(texts_of(part), width)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["id", "items"])

    s = slot("doc_id")
    given = docs.filter("doc_id is not null").select("doc_id", "text", F.bitmap_bucket_number(s).alias("bucket"), F.bitmap_bit_position(s).alias("bit"))
    items = given.mapInArrow(sets, "id long, items binary")
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("runs"))
    dealt = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), "runs").alias("run"))
    roles = dealt.select(F.col("a").alias("id"), "a", "run", F.lit(None).cast("long").alias("b")).distinct().unionByName(dealt.select(F.col("b").alias("id"), "a", "run", "b"))
    rows = roles.join(items, "id").repartition("a", "run").sortWithinPartitions("a", "run", "b").select("a", "run", "b", "items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, leaders = None, []
        for batch in batches:
            good: list[tuple[int, int]] = []
            for a, run, b, raw in zip(batch.column("a").to_pylist(), batch.column("run").to_pylist(), batch.column("b").to_pylist(), batch.column("items"), strict=True):
                if (a, run) != now:
                    now, leaders = (a, run), []
                if b is None:
                    leaders.append(np.frombuffer(raw.as_py(), np.uint64))
                    continue
                q = np.frombuffer(raw.as_buffer(), np.uint64)
                for p in leaders:
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if DEN * common >= NUM * (len(p) + len(q) - common):
                        good.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefixes(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """doc_id, n and the hashes of the prefix of each set that is not empty."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        heavy, classes = known.value
        for b in batches:
            rows = []
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(texts_of(b), width), strict=True):
                if not len(s):
                    continue
                p = prefix_length(len(s))
                if len(heavy):
                    upper = (s >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(heavy, upper), len(heavy) - 1)
                    rank = np.where(heavy[at] == upper, classes[at], 0)
                    if rank.any():
                        s = s[np.argsort(rank, kind="stable")]
                rows.append((doc, s[:p].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "prefix"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, prefix binary")


def _dealt(prefixes: DataFrame, buckets: int) -> DataFrame:
    """A row for each batch and bucket: the sets with a shingle there, and (set, shingle) pairs, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column("rep").to_numpy()
            raws = b.column("prefix").to_pylist()
            flat = np.frombuffer(b"".join(raws), np.uint64)
            doc = np.repeat(np.arange(len(raws)), [len(r) // 8 for r in raws])
            # Prefixes hold the least hashes, so they are mixed before they are dealt.
            bucket = ((mix(flat) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            o = np.lexsort((doc, bucket))
            flat, doc, bucket = flat[o], doc[o], bucket[o]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for d, f, k in zip(np.split(doc, cuts), np.split(flat, cuts), bucket[np.concatenate([[0], cuts])].tolist(), strict=True):
                own, back = np.unique(d, return_inverse=True)
                rows.append((k, rep[own].tobytes(), back.astype(np.uint16).tobytes(), f.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 4)], ["bucket", "reps", "docs", "items"])

    return prefixes.select("rep", "prefix").mapInArrow(run, "bucket long, reps binary, docs binary, items binary")


def _shared(prefixes: DataFrame, buckets: int) -> DataFrame:
    """(item, rep, owner) for each shingle that is in the prefixes of two sets or more; owner is the smallest id that has it."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        reps, docs, items = [], [], []
        for r, d, f in zip(*(table.column(k).to_pylist() for k in ("reps", "docs", "items")), strict=True):
            reps.append(np.frombuffer(r, np.int64)[np.frombuffer(d, np.uint16)])
            items.append(np.frombuffer(f, np.uint64))
        rep, item = np.concatenate(reps), np.concatenate(items)
        o = np.lexsort((rep, item))
        rep, item = rep[o], item[o]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        often = np.diff(np.append(starts, len(item)))
        keep = np.repeat(often > 1, often)
        return pa.table([pa.array(x[keep]) for x in (item.view(np.int64), rep, np.repeat(rep[starts], often))], ["item", "rep", "owner"])

    return _dealt(prefixes, buckets).groupBy("bucket").applyInArrow(run, "item long, rep long, owner long")


_ARRAYS = ("ids", "labels", "sizes", "totals", "lengths", "ranks")


def _parts(items: DataFrame, split: bool) -> DataFrame:
    """A row for each bucket and each task that is to walk it: the sets that share a shingle with one of another label, and these shingles.

    items has bucket, rep, label, n, total and item.
    """

    def run(table: pa.Table) -> pa.Table:
        lean()
        rep, doc = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        label, n, total = (np.zeros(len(rep), np.int64) for _ in range(3))
        for x, k in ((label, "label"), (n, "n"), (total, "total")):
            x[doc] = table.column(k).to_numpy()
        item = table.column("item").to_numpy()
        o = np.lexsort((doc, item))
        part = shared_part(rep, label, n, total, doc[o], item[o])
        rows = []
        if part is not None:
            work, arrays = part
            tasks = 1 + work // WORK if split else 1
            rows = [(table.column("bucket")[0].as_py(), k, tasks, *[a.tobytes() for a in arrays]) for k in range(tasks)]
        kinds = [pa.int64()] * 3 + [pa.binary()] * len(_ARRAYS)
        return pa.table([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["bucket", "task", "tasks", *_ARRAYS])

    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("bucket", "task", "tasks")] + [T.StructField(k, T.BinaryType()) for k in _ARRAYS])
    return items.select("bucket", "rep", "label", "n", "total", "item").groupBy("bucket").applyInArrow(run, schema)


def shared_part(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, totals: np.ndarray, doc: np.ndarray, item: np.ndarray) -> tuple[int, tuple[np.ndarray, ...]] | None:
    """Pairs that share a shingle here, counted by shingle, and the arrays of a bucket; None if no shingle is shared between labels.

    doc and item are (set, shingle) pairs by shingle.  Shingles are numbered in the bucket's order, those of many sets first, so that
    sets share long paths.
    """
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    often, lab = np.diff(np.append(starts, len(item))), labels[doc]
    mixed = np.minimum.reduceat(lab, starts) != np.maximum.reduceat(lab, starts)
    if not mixed.any():
        return None
    rank = np.zeros(len(often), np.int64)
    order = np.flatnonzero(mixed)[np.argsort(-often[mixed], kind="stable")]
    rank[order] = np.arange(len(order))
    keep = np.repeat(mixed, often)
    number, doc = np.repeat(rank, often)[keep], doc[keep]
    o = np.lexsort((number, doc))
    number, doc = number[o], doc[o]
    own, lengths = np.unique(doc, return_counts=True)
    pairs = int((often[mixed] * (often[mixed] - 1) // 2).sum())
    return pairs, (ids[own], labels[own], sizes[own], totals[own], lengths, number.astype(">u4"))


def needed(nx: int, ny: int) -> int:
    """The least intersection of the prefixes: what is common beyond them is at most the rest of one of the two sets."""
    total = -(-NUM * (nx + ny) // (NUM + DEN))
    return max(1, total - max(nx - prefix_length(nx), ny - prefix_length(ny)))


def least_needed(a: int, b: int, c: int, d: int) -> int | None:
    """At most needed(x, y) for all x in a..b and y in c..d; None if no two such sizes can be linked.

    needed grows with the smaller size and falls with the larger one, so it is least in a corner, up to rounding.
    """
    if DEN * d < NUM * a or DEN * b < NUM * c:
        return None
    corners = [(x, y) for x in {a, b} for y in {c, d}]
    if any(DEN * min(p) < NUM * max(p) for p in corners):
        return 1
    return max(1, min(needed(*p) for p in corners) - 1) if len(corners) > 1 else needed(a, c)


class Trie:
    """The prefix tree of the sets' parts in one bucket.

    Equal parts are one leaf; leaves are numbered in the tree's order, so the leaves below a node are a range.  Nodes are numbered
    in preorder.  A node knows of the sets below it: the least and greatest size, the longest part, the most that one shares with others
    in other buckets, the leader, and the best one of another label than the leader's.  The leader is the set of whose prefix others have
    most, then the one with the smallest id: of edited copies the one with the fewest edits.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, totals: np.ndarray, lengths: np.ndarray, ranks: np.ndarray):
        self.ids, self.labels, self.sizes, self.spares = ids.tolist(), labels.tolist(), sizes.tolist(), (totals - lengths).tolist()
        self.worth = list(zip((-(1000 * totals // prefix_length(sizes))).tolist(), self.ids, strict=True))
        raw, ends = ranks.tobytes(), (4 * np.cumsum(lengths)).tolist()
        parts: dict[bytes, list[int]] = {}
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            parts.setdefault(raw[a:b], []).append(k)
        keys = sorted(parts)
        self.members = [parts[k] for k in keys]
        self.items = [np.frombuffer(k, ">u4").tolist() for k in keys]
        self.first: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.item: list[int] = []
        self.holders: dict[int, list[int]] = {}
        self.paths: list[list[int]] = []
        path: list[int] = []
        before: list[int] = []
        for leaf, items in enumerate(self.items):
            same = 0
            for x, y in zip(before, items, strict=False):
                if x != y:
                    break
                same += 1
            for n in path[same:]:
                self.end[n] = leaf
            path = path[:same]
            for x in items[same:]:
                self.holders.setdefault(x, []).append(len(self.item))
                path.append(len(self.item))
                self.item.append(x)
                self.first.append(leaf)
                self.end.append(len(self.items))
                self.depth.append(len(path))
            self.paths.append(path)
            before = items
        self._gather()

    def _gather(self) -> None:
        """What nodes know, from the leaves up."""
        n = len(self.item)
        self.low, self.high, self.longest, self.spare = [1 << 62] * n, [0] * n, [0] * n, [0] * n
        self.lead, self.other = [-1] * n, [-1] * n
        self.of_leaf = []
        for leaf, members in enumerate(self.members):
            sizes = [self.sizes[m] for m in members]
            labels = {self.labels[m] for m in members}
            self.of_leaf.append((min(sizes), max(sizes), max(self.spares[m] for m in members), labels.pop() if len(labels) == 1 else None))
            self._add(self.paths[leaf][-1], *self.of_leaf[-1][:2], len(self.items[leaf]), self.of_leaf[-1][2], members)
        up = [-1] * n
        for path in self.paths:
            for a, b in zip(path, path[1:], strict=False):
                up[b] = a
        for k in range(n - 1, -1, -1):
            if up[k] >= 0:
                self._add(up[k], self.low[k], self.high[k], self.longest[k], self.spare[k], (self.lead[k], self.other[k]))

    def _add(self, n: int, low: int, high: int, longest: int, spare: int, leaders: Iterable[int]) -> None:
        self.low[n], self.high[n] = min(self.low[n], low), max(self.high[n], high)
        self.longest[n], self.spare[n] = max(self.longest[n], longest), max(self.spare[n], spare)
        for m in leaders:
            self.lead[n], self.other[n] = self._best(self.lead[n], self.other[n], m)

    def _best(self, lead: int, other: int, m: int) -> tuple[int, int]:
        """The leader, and the best one of another label than its, when m comes to them; -1 is none."""
        worth, labels = self.worth, self.labels
        if m < 0:
            return lead, other
        if lead < 0 or worth[m] < worth[lead]:
            return m, lead if lead >= 0 and labels[lead] != labels[m] else other
        if labels[m] != labels[lead] and (other < 0 or worth[m] < worth[other]):
            return lead, m
        return lead, other

    def leaders(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(a, b, overlap, size of a, size of b): each set b with the leaders a of the nodes that hold its shingles.

        All nodes of a shingle have one leader between them; a set of the leader's label meets the best one of another label.  The
        overlap counts the shingles that led to a.
        """
        best: dict[int, tuple[int, int]] = {}
        for x, nodes in self.holders.items():
            pair = (-1, -1)
            for n in nodes:
                pair = self._best(*self._best(*pair, self.lead[n]), self.other[n])
            best[x] = pair
        for items, members in zip(self.items, self.members, strict=True):
            pairs = [best[x] for x in items]
            for m in members:
                label = self.labels[m]
                for lead, times in Counter(a if self.labels[a] != label else b for a, b in pairs).items():
                    if lead >= 0:
                        yield self.ids[lead], self.ids[m], times, self.sizes[lead], self.sizes[m]

    def walk(self, k: int) -> Iterator[tuple[int, int, int]]:
        """(first leaf, end, overlap) of the leaves from k on that may be linked with leaf k and share something with it here."""
        items, (low, high, spare, label) = self.items[k], self.of_leaf[k]
        left = {x: len(items) - j - 1 for j, x in enumerate(items)}
        open_: list[int] = []  # ends of the nodes above that hold shingles of the probe: as many as are shared
        at = k
        for n in sorted(n for x in items for n in self.holders[x] if self.end[n] > k):
            if self.end[n] <= at:
                continue  # below a node that was left
            first = max(self.first[n], at)
            while open_ and open_[-1] <= first:
                if open_[-1] > at:
                    yield at, open_[-1], len(open_)
                at = max(at, open_.pop())
            if first > at:
                if open_:
                    yield at, first, len(open_)
                at = first
            least = least_needed(low, high, self.low[n], self.high[n])
            to_come = min(left[self.item[n]], self.longest[n] - self.depth[n]) + min(spare, self.spare[n])
            if least is None or len(open_) + 1 + to_come < least or (label is not None and self.other[n] < 0 and label == self.labels[self.lead[n]]):
                at = self.end[n]
            else:
                open_.append(self.end[n])
        while open_:
            if open_[-1] > at:
                yield at, open_[-1], len(open_)
            at = max(at, open_.pop())

    def pairs(self, task: int = 0, tasks: int = 1) -> Iterator[tuple[int, int, int, int, int]]:
        """(a, b, overlap here, size of a, size of b), a < b, of the pairs that share a shingle here, have different labels and may be linked."""
        ids, labels, sizes, spares = self.ids, self.labels, self.sizes, self.spares
        for k in range(task, len(self.items), tasks):
            mine = self.members[k]
            for first, end, common in self.walk(k):
                for other in range(first, end):
                    for i, x in enumerate(mine):
                        for y in mine[i + 1 :] if other == k else self.members[other]:
                            nx, ny = sizes[x], sizes[y]
                            if labels[x] == labels[y] or ids[x] == ids[y] or DEN * min(nx, ny) < NUM * max(nx, ny):
                                continue
                            if common + min(spares[x], spares[y]) >= needed(nx, ny):
                                yield (ids[x], ids[y], common, nx, ny) if ids[x] < ids[y] else (ids[y], ids[x], common, ny, nx)


def _walked(shared: DataFrame, leaders: bool) -> DataFrame:
    """(a, b, common, na, nb) over all buckets: the first walk, or the second one; common is summed over the buckets."""
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, np.dtype(">u4"))
    names, types = ["a", "b", "common", "na", "nb"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("task", "tasks", *_ARRAYS)), strict=True):
                trie = Trie(*[np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row[2:], kinds, strict=True)])
                found = trie.leaders() if leaders else trie.pairs(row[0].as_py(), row[1].as_py())
                while rows := list(islice(found, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # Tasks of one bucket go to different partitions.
    each = shared.repartition("bucket", "task").mapInArrow(run, "a long, b long, common int, na int, nb int")
    return each.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _least(na: str = "na", nb: str = "nb") -> Column:
    """needed as a Column."""
    rest = lambda n: F.expr(f"({NUM} * {n} + {DEN - 1}) div {DEN} - 1")
    total = F.expr(f"({NUM} * ({na} + {nb}) + {NUM + DEN - 1}) div {NUM + DEN}")
    return F.greatest(F.lit(1), total - F.greatest(rest(na), rest(nb)))


def leader_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each set b with the leaders a that share most with it on its paths; LEADERS of them at most, as the second walk finds what these miss."""
    near = _walked(shared, leaders=True).filter((F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & (4 * F.col("common") >= _least()))
    best = Window.partitionBy("b").orderBy(F.desc("common"), "a")
    return near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS).select("a", "b")


def all_pairs(shared: DataFrame) -> DataFrame:
    """(a, b) of different labels whose prefixes share enough."""
    return _walked(shared, leaders=False).filter(F.col("common") >= _least()).select("a", "b")


def _by_family(items: DataFrame, label: DataFrame | None, buckets: int) -> DataFrame:
    """items with label and bucket: a set's component so far, and shingles together whose owners are in one component.

    So the shingles that members of a family share lie in one bucket, and the trie sees whole overlaps.  A family with more than
    BUCKET of them is cut into several buckets by shingle; small families share buckets.
    """
    if label is None:
        items = items.withColumns({"label": F.col("rep"), "family": F.col("owner")})
    else:
        of = lambda c, to: label.select(F.col("node").alias(c), F.col("label").alias(to))
        items = items.join(of("rep", "label"), "rep", "left").join(of("owner", "family"), "owner", "left").withColumns({"label": F.coalesce("label", "rep"), "family": F.coalesce("family", "owner")})
    large = items.groupBy("family").count().filter(F.col("count") > BUCKET).select("family", F.ceil(F.col("count") / BUCKET).alias("cuts"))
    cut = F.pmod(F.xxhash64("item"), F.coalesce("cuts", F.lit(1)))
    # One row for each BUCKET of the items at most: small enough to be broadcast at any size of the input, and so no family lands in one task.
    return items.join(F.broadcast(large), "family", "left").withColumn("bucket", F.pmod(F.xxhash64("family", cut), F.lit(buckets)))


def links(docs: DataFrame, rows: DataFrame, sets: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The verified links (a, b) after the first walk, and those that the second one adds between components."""
    spark = docs.sparkSession
    total, every = sets.agg(F.sum("n")).first()[0] or 0, rows.agg(F.sum("n")).first()[0] or 0
    least = min(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = _order(settle(_counted(docs.filter("doc_id is not null"), width, max(-(-every // PART), least)), "frequent"))
    own = sets.select("rep", F.col("n").cast("long").alias("n")).dropDuplicates(["rep"])
    prefixes = _prefixes(docs, order, width).join(own.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").withColumnRenamed("doc_id", "rep")
    shared = settle(_shared(prefixes, max(-(-total // (DEN * BUCKET)), least)), "shared")
    totals = shared.groupBy("rep").agg(F.count("*").alias("total")).join(own, "rep")
    items = settle(shared.join(totals, "rep"), "items")
    parts = max(-(-items.count() // BUCKET), least)
    first = settle(_linked(docs, settle(leader_pairs(_parts(_by_family(items, None, parts), split=False)), "leaders"), width), "links")
    label = settle(components(first), "labels")
    return first, settle(_linked(docs, settle(all_pairs(_parts(_by_family(items, label, parts), split=True)), "pairs"), width), "more-links")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    tune(docs.sparkSession)
    docs = two_columns(docs, key, text)
    rows = settle(_describe(docs, width), "sets")
    sets = settle(rows.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "reps")
    first, second = links(docs, rows, sets, width)
    final = components(first.unionByName(second))
    classes = sets.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    return rows.join(classes, "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"))
