"""Quality rules: distance of distributions from language references.

A document has two histograms: classes of characters, and common words.  A reference has both for one language.  The
Jensen-Shannon distance is the square root of the divergence in bits.  A document is measured against the reference whose common
words are nearest, and rejected if either distance is above its limit; documents below a least length are not judged.

References are stored here under a version and owe nothing to the documents that are judged, so a verdict depends on the
document alone.  Common words follow Zipf's law, the k-th of a language having ZIPF / k of all words; the shares of characters are
those of ordinary printed text, rounded.  A limit on the divergence has two parts: the square of a least distance, for
texts of another kind or topic, and twice the divergence that a sample of n from the reference itself has on average, (cells - 1) /
(8 n ln 2), which is what short documents need.  A text in a language without a reference is far from all of
them: more references can be passed to judge.

Defined results: null or empty text has no words and fails the base rules; without any reference only the base rules count;
of references whose words are equally near, to nine decimals, the first by name counts; repeated rows are each judged; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.runtime import lean, texts_of, tune, two_columns

#: Version of the references below; it changes with any value of theirs.
REFERENCE_VERSION = 1
#: Share of a language's most frequent word; the k-th has 1 / k of it.
ZIPF = 0.065
# Function words of each language by falling frequency.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it was on with as be by this are from at",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
}
# Shares of characters: lower case, upper case, digits, white space, punctuation, other ASCII, all others.
CHARACTERS = {
    "de": (0.755, 0.045, 0.005, 0.150, 0.025, 0.0, 0.020),
    "en": (0.780, 0.025, 0.005, 0.170, 0.020, 0.0, 0.000),
    "es": (0.760, 0.020, 0.005, 0.165, 0.025, 0.0, 0.025),
    "fr": (0.750, 0.020, 0.005, 0.165, 0.025, 0.0, 0.035),
}
_WORDS = sorted({w.encode() for v in COMMON_WORDS.values() for w in v.split()})
_PLACE = {w: k for k, w in enumerate(_WORDS)}
_SPACE = b" \t\n\r\x0b\x0c"
_PUNCT = b".,;:!?'\"()-"
_SYMBOLS = b"#*$%&|<>"
#: Byte classes in the order of CHARACTERS, the first byte of another character in the last; then the rest of its bytes.
N_CLASSES = 7
_CLASS = np.full(256, 5, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(_SPACE)] = 3
_CLASS[list(_PUNCT)] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7
_BLANK = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))

MIN_WORDS = 50
#: Least distances that tell texts of another kind; see above for what short texts get on top.  A text without any common word is at 0.37,
#: one whose common words are frequent but not by Zipf's law at 0.2 to 0.3; text of symbols or capitals is at 0.2 to 0.45 by its characters.
CHAR_LIMIT, WORD_LIMIT = 0.16, 0.29
#: Distances are equal if they are to so many decimals.
DECIMALS = 9


@dataclass(frozen=True)
class Reference:
    """Histograms of one language: of the classes of characters, and of the common words of all languages, the last entry being all other words."""

    language: str
    characters: tuple[float, ...]
    words: tuple[float, ...]
    common: int  # words of the language itself


def reference(language: str) -> Reference:
    """The stored reference of a language."""
    own = COMMON_WORDS[language].split()
    words = np.zeros(len(_WORDS) + 1)
    words[[_PLACE[w.encode()] for w in own]] = ZIPF / np.arange(1, len(own) + 1)
    words[-1] = 1 - words.sum()
    characters = np.array(CHARACTERS[language])
    return Reference(language, tuple((characters / characters.sum()).tolist()), tuple(words.tolist()), len(own))


REFERENCES = tuple(reference(x) for x in COMMON_WORDS)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that are found twice or more in the text, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    keys = ids[: n - window + 1]
    for k in range(1, window):
        m = int(keys.max()) + 1
        if m > (1 << 62) // len(place):
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(place) + ids[k : n - window + 1 + k]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    hit = np.zeros(n, bool)
    for k in range(window):
        hit[k : n - window + 1 + k] |= again
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    return sum(c - 1 for line, c in Counter(lines).items() if c > 1 and line.encode().strip(_SPACE))


def measure(text: str) -> tuple[list[int], list[int], list[int]]:
    """Base figures, histogram of character classes, histogram of common words (the last entry: all other words)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) if data else np.zeros(8, np.int64)
    base = [len(words), len(text) - int(classes[3]), sum(data.count(s) for s in _SYMBOLS), repeated_lines(text), repeated_words(words)]
    plain = data.lower().translate(_BLANK).split()
    found = Counter(map(_PLACE.get, plain))
    common = [found.get(k, 0) for k in range(len(_WORDS))] + [found.get(None, 0)]
    return base, classes[:N_CLASSES].tolist(), common


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from q."""
    m = (p + q) / 2

    def half(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return (half(p) + half(np.broadcast_to(q, p.shape))) / 2


def limit(least: float, cells: int, n: np.ndarray) -> np.ndarray:
    """The greatest distance of a histogram of n things in so many cells."""
    return np.sqrt(least**2 + 2 * (cells - 1) / (8 * math.log(2) * np.maximum(n, 1)))


def compared(classes: np.ndarray, common: np.ndarray, references: Sequence[Reference]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of histograms: place of the nearest reference, both distances from it, and whether they keep their limits.

    Terms are added up in an order that depends on the reference, so distances that ought to be equal differ in their last bits.
    """
    p, c = _shares(classes), _shares(common)
    by_words = np.array([np.sqrt(divergence(c, np.array(r.words))) for r in references])
    by_chars = np.array([np.sqrt(divergence(p, np.array(r.characters))) for r in references])
    near = np.argmin(np.round(by_words, DECIMALS), axis=0)  # the first among equals
    rows = np.arange(len(near))
    chars, words = by_chars[near, rows], by_words[near, rows]
    cells = np.array([r.common + 1 for r in references])[near]
    good = (chars <= limit(CHAR_LIMIT, N_CLASSES, classes.sum(axis=1))) & (words <= limit(WORD_LIMIT, cells, common.sum(axis=1)))
    return near, chars, words, good


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", references: Sequence[Reference] = REFERENCES, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Every row with its base figures, language, distances and verdict; whole: also the row itself, as one column named row.

    language and the distances are null where they do not count: below min_words, or without any reference.
    """
    references = sorted(references, key=lambda r: r.language)
    names = [*(["row"] if whole else []), "doc_id", *_BASE, "base_failed", "language", "char_distance", "word_distance", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            found = [measure(x) for x in texts_of(b)]
            base = np.array([r[0] for r in found], np.int64).reshape(-1, len(_BASE))
            n, again = base[:, 0], base[:, 4]
            failed = (n < MIN_WORDS) | (100 * again > 50 * n)
            judged = (n >= min_words) & bool(references)
            kept, told = ~failed, [[None] * len(found) for _ in range(3)]
            if judged.any():
                at = np.flatnonzero(judged)
                near, chars, words, good = compared(np.array([found[k][1] for k in at], float), np.array([found[k][2] for k in at], float), references)
                kept[at] &= good
                for k, j, c, w in zip(at.tolist(), near.tolist(), chars.tolist(), words.tolist(), strict=True):
                    told[0][k], told[1][k], told[2][k] = references[j].language, c, w
            own = [b.column(k) for k in ("row", "doc_id") if k in b.schema.names]
            cols = [*own, *(pa.array(base[:, k]) for k in range(len(_BASE))), pa.array(failed), pa.array(told[0], pa.string()), pa.array(told[1], pa.float64()), pa.array(told[2], pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names)

    tune(docs.sparkSession)
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) if whole else two_columns(docs, key, text)
    figures = T.StructType.fromDDL(f"doc_id long, {', '.join(f'{k} long' for k in _BASE)}, base_failed boolean, language string, char_distance double, word_distance double, kept boolean")
    return given.mapInArrow(run, T.StructType([*[f for f in given.schema.fields if f.name == "row"], *figures.fields]))
