"""Word hashes and shingle sets of texts, with array operations.

A word's hash is a polynomial over random values of its bytes, taken from one running sum over the text, then mixed; a
shingle's is a mixed sum of its words' hashes with a factor for each place.  All are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RATIO = 0x9E3779B97F4A7C15
_BACK = pow(_RATIO, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE[~_WORD] = 0
_PLACE = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
#: Bytes hashed at once.
BLOCK = 1 << 21
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers without visible structure."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_RATIO, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a block."""
    raw = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = _WORD[raw]
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of all words of one text, A-Z as a-z; long texts are cut between words."""
    if len(data) <= BLOCK:
        return _words(data)[0] if data else np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and _WORD[data[to]]:
            to += 1
        out.append(_words(data[at:to])[0])
        at = to
    return np.concatenate(out)


def each_words(texts: list[str]) -> Iterator[np.ndarray]:
    """word_hashes of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at + len(parts) < len(texts) and (not parts or size < BLOCK // 2):
            parts.append(texts[at + len(parts)].encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
        if size > BLOCK:
            for p in parts:
                yield word_hashes(p)
        else:
            hashes, starts = _words(b"\n".join(parts) or b"\n")
            bounds = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
            for a, b in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True):
                yield hashes[a:b]
        at += len(parts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; with fewer words, one of the whole sequence."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _PLACE[j]
    return mix(total + _U(k))


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, in ascending order."""
    return [np.unique(shingles(w, width)) for w in each_words(texts)]
