"""Token counts by trie-shared dynamic programming over a unigram model.

Pre-tokens are the runs between white space, each with the word mark U+2581 before it.  The distinct pre-tokens of a batch go
into a trie; the best score of a prefix is computed once for all pre-tokens that share it, and the number of pieces of
the best segmentation is stored where a pre-token ends.  Documents then add up their pre-tokens' counts.

The model: the pieces of a public vocabulary file, which is taken as it is.  The probability of a piece is its share of all pieces when
the file's own rule cuts up all documents, one added to every piece's count; so a first pass counts pieces, and as
many numbers as the file has pieces come to the driver.  A character that no piece covers costs one piece for each of its UTF-8 bytes, each
e times less likely than a piece that was never met.  Among segmentations of equal score the one with fewer pieces wins.

Defined results: null or empty text, or only white space, has no pre-tokens and no tokens; texts are counted whole;
repeated rows are each counted, also for the model; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.runtime import KEPT, texts_of, tokenizer_path, tune, two_columns

MARK = "▁"
#: Words kept in a worker's table; past half of it, those not met again since the last time go.
WORDS_KEPT = 1_400_000


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The file's processor, and its pieces by id; null for ids that are no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, names


class Words:
    """A bounded table of words: two generations, of which the older is dropped when the newer is half full."""

    def __init__(self, kept: int):
        self.kept, self.now, self.older = kept, {}, {}

    def clear(self) -> None:
        self.now, self.older = {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words that have no entry yet; the others are in now afterwards."""
        if len(self.now) > self.kept // 2:
            self.older, self.now = self.now, {}
        new = words - self.now.keys()
        if self.older:
            known = [w for w in new if w in self.older]
            self.now.update(zip(known, map(self.older.__getitem__, known), strict=True))
            new.difference_update(known)
        return list(new)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


class UnigramCounts:
    """Piece counts of the best segmentation under given counts of pieces by id."""

    def __init__(self, path: str, counts: dict[int, int]):
        names = _pieces(path)[1]
        known = [i for i, n in enumerate(names) if n is not None]
        total = math.log(sum(counts.get(i, 0) for i in known) + len(known))
        #: Negated log probability, and the number of pieces breaks ties: a sum of pairs, smaller is better.
        self.cost = {names[i]: total - math.log(counts.get(i, 0) + 1) for i in known}
        self.spare = total + 1
        #: The longest piece by its last character, so that a prefix looks only at ends that fit.
        self.longest: dict[str, int] = {}
        for p in self.cost:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.most = max(self.longest.values())
        self.words = Words(WORDS_KEPT)

    def _extend(self, full: str, n: int, best: deque[tuple[float, int]]) -> tuple[float, int]:
        """Best cost and piece count of the first n characters, from those of the shorter prefixes, which best ends with."""
        last, shift, cost = full[n - 1], len(best) - n, self.cost.get
        size = len(last.encode("utf-8", "surrogatepass"))
        b = best[-1]
        out = (b[0] + size * self.spare, b[1] + size)
        for k in range(max(0, n - self.longest.get(last, 0)), n):
            if (c := cost(full[k:n])) is not None:
                b = best[shift + k]
                now = (b[0] + c, b[1] + 1)
                if now < out:
                    out = now
        return out

    def learn(self, words: list[str]) -> None:
        """Walk the trie of these words depth first.

        In sorted order a word's path shares with the one before exactly their common prefix, so a walk goes on from that node.  Only the nodes
        of the path where a later word leaves it are kept, each with the scores of the last few prefixes, which is all that a piece can reach
        back to; so pre-tokens of any length are walked alike, and the memory does not grow with their length.
        """
        known, full = self.words.now, [MARK + w for w in sorted(words)]
        shared = [_common(a, b) for a, b in itertools.pairwise(full)] + [0]
        # The next word that leaves the path nearer to the root than this word's successor does.
        nearer, open_ = [len(full)] * len(full), []
        for i, depth in enumerate(shared):
            while open_ and shared[open_[-1]] > depth:
                nearer[open_.pop()] = i
            open_.append(i)
        kept, start = [(0, ((0.0, 0),))], 0
        for i, word in enumerate(full):
            while kept[-1][0] > start:
                kept.pop()
            leaves, j = [], i
            while j < len(full) and shared[j] > start:
                leaves.append(shared[j])
                j = nearer[j]
            best, at = deque(kept[-1][1], maxlen=self.most), start
            for stop in reversed(leaves):
                for n in range(at + 1, stop + 1):
                    best.append(self._extend(word, n, best))
                kept.append((stop, tuple(best)))
                at = stop
            for n in range(at + 1, len(word) + 1):
                best.append(self._extend(word, n, best))
            known[word[len(MARK) :]] = best[-1][1]
            start = shared[i]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        lists = [x.split() for x in texts]
        self.learn(self.words.missing(set().union(*lists)))
        return [(sum(map(self.words.now.__getitem__, x)), len(x)) for x in lists]


_CUT: dict[str, Words] = {}
KEPT.append(_CUT)


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often each piece of the file is met in all texts; docs has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, names = _pieces(path)
        words, total = _CUT.setdefault(path, Words(WORDS_KEPT)), np.zeros(len(names), np.int64)
        for b in batches:
            found = Counter()
            for x in texts_of(b):
                found.update(x.split())
            new = words.missing(set(found))
            for w, ids in zip(new, sp.encode(new, num_threads=1), strict=True):
                words.now[w] = np.array(ids, np.uint32).tobytes()
            cut = [words.now[w] for w in found]
            total += np.bincount(np.frombuffer(b"".join(cut), np.uint32), np.repeat(list(found.values()), [len(c) // 4 for c in cut]), len(names)).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["piece", "n"])

    return docs.select("text").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


_OPEN: dict[tuple, UnigramCounts] = {}
KEPT.append(_OPEN)


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every row."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    tune(docs.sparkSession)
    docs = two_columns(docs, key, text)
    met = {r["piece"]: r["n"] for r in piece_counts(docs, path).collect()}  # as many as the file has pieces, at most
    mark = (path, hash(frozenset(met.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _OPEN:
            _OPEN.clear()
            _OPEN[mark] = UnigramCounts(path, met)
        for b in batches:
            found = _OPEN[mark].counts(texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
