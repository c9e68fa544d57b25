"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries.  A cut is what the merges would give exactly when
every adjacent pair of its tokens is: merging the characters of the two tokens alone must give back those two tokens.
Pairs are tested together, against a table of pairs already judged; only words with a failing pair go through the
exact merges.  Distinct words are encoded once and kept in a bounded table.

Text to words follows the vocabulary file: special tokens are found in the raw text, then NFC, one space for white
space, lower case, and the file's split.  Texts of plain letters below U+0250 need no normalising but lower case and are cut
at white space; for any other text the library's own normaliser and splitter give the words.

Defined results: a null text is the empty text, which has no tokens, an empty id list and an empty decoding; repeated rows
are each encoded; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skeinwork.llm.runtime import KEPT, lean, texts_of, tokenizer_path, tune, two_columns

#: Words and pieces kept in a worker's table; past half of it, those not met again since the last time go.
WORDS_KEPT = 1_400_000
PAIRS_KEPT = 1_000_000
#: Anything but letters, marks and spaces on which all Unicode versions agree.
_UNUSUAL = re.compile("[^\x09-\x0d\x20-\x7e\xa0-ɏ]")
#: The same for columns, with special tokens and the one letter whose lower case has two characters.
_NOT_PLAIN = r"[^\x09-\x0d\x20-\x7e\x{a0}-\x{12f}\x{131}-\x{24f}]|<\|"
_MARKS = string.punctuation.replace("'", "")
_LETTERS = "".join({c for c in map(str.lower, map(chr, range(0x250))) if c.isalpha()})
#: Bytes of text that are cut and looked up together.
TOGETHER = 4 << 20
#: Words that are merged in one call.
WORDS_MERGED = 20_000


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends, lower case and byte symbols."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT, speculate: bool = True):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.bytes = _byte_symbols()
        if speculate:  # what proposals and their test need
            self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
            self.open_ = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
            self.closed = {t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)}
            #: The longest entry that begins with given two symbols.
            self.reach: dict[str, int] = {}
            for t in (*self.open_, *self.closed):
                self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        else:  # the library's merges alone, of words between spaces
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
            self.merger = Tokenizer(self.lib.model)
            self.merger.pre_tokenizer = WhitespaceSplit()
            self.ends = np.zeros(max(self.tokens) + 1, bool)
            self.ends[[i for t, i in self.vocab.items() if t.endswith(self.end)]] = True
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept, self.speculate = words_kept, speculate
        self.exact_words = self.judged_words = 0

    # ---- words

    def _symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.bytes.__getitem__, word.encode()))

    def merge(self, parts: list[str]) -> list[str]:
        """The exact merges: the pair of the lowest rank first, leftmost among equals."""
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i] == low and self.rank.get((parts[i], parts[i + 1])) == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def exact(self, symbols: str) -> list[int]:
        """The library's own merges of one word."""
        return [t.id for t in self.lib.model.tokenize(symbols)]

    def _exact_bytes(self, symbols: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.lib.model.tokenize(symbols)])

    def _exact_many(self, words: list[str]) -> list[bytes]:
        """The library's own merges of words, in one call: only the last token of each carries the word's end."""
        ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(words):
            return [self._exact_bytes(w) for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def propose(self, symbols: str) -> list[int]:
        """Greedy longest match; the last token must end the word."""
        out, i, n = [], 0, len(symbols)
        open_, closed, reach = self.open_.get, self.closed.get, self.reach.get
        while True:
            most = reach(symbols[i : i + 2], 1)
            if n - i <= most and (t := closed(symbols[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + most), i, -1):
                if (t := open_(symbols[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:  # cannot happen: every byte symbol is an entry, open and closed
                raise ValueError(f"no entry fits {symbols[i:]!r}")

    def _judge(self, pair: int) -> bool:
        a, b = self.tokens[pair >> 20], self.tokens[pair & 0xFFFFF]
        if b.endswith(self.end):
            return self.exact(a + b.removesuffix(self.end)) == [pair >> 20, pair & 0xFFFFF]
        if (a, b) in self.rank:
            return False
        return self.merge(list(a + b)) == [a, b]

    def _encode(self, words: list[str]) -> None:
        """Make the table hold these words."""
        words = [w for w in dict.fromkeys(words) if w not in self.chunks]
        if self.speculate:
            self.encode_words(words)
            return
        for at in range(0, len(words), WORDS_MERGED):
            some = words[at : at + WORDS_MERGED]
            self.chunks.update(zip(some, self._exact_many([self._symbols(w) for w in some]), strict=True))

    def encode_words(self, words: list[str]) -> None:
        """Propose for all words, test all adjacent pairs at once, and merge exactly where a pair fails."""
        if not words:
            return
        symbols = [self._symbols(w) for w in words]
        guessed = [self.propose(s) for s in symbols]
        flat = np.fromiter((t for g in guessed for t in g), np.int64)
        sizes = np.fromiter(map(len, guessed), np.int64, len(guessed))
        owner = np.repeat(np.arange(len(guessed)), sizes)
        inside = owner[1:] == owner[:-1]
        keys = ((flat[:-1] << 20) | flat[1:])[inside]
        found, back = np.unique(keys, return_inverse=True)
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        for k in found.tolist():
            if k not in self.pairs:
                self.pairs[k] = self._judge(k)
        fits = np.fromiter((self.pairs[k] for k in found.tolist()), bool, len(found))
        wrong = set(owner[1:][inside][~fits[back]].tolist()) if len(keys) else set()
        self.judged_words += len(words)
        self.exact_words += len(wrong)
        packed, at = flat.astype(np.uint32).tobytes(), 0
        for k, w in enumerate(words):
            to = at + 4 * len(guessed[k])
            self.chunks[w] = self._exact_bytes(symbols[k]) if k in wrong else packed[at:to]
            at = to

    # ---- texts

    def _learn(self, chunks: set[str]) -> None:
        """Make the table hold these pieces between white space.  A word is a piece of its own, so one table serves both."""
        table = self.chunks
        if len(table) > self.kept // 2:
            self.older, self.chunks = table, {}
            table = self.chunks
        new = chunks.difference(table)
        if self.older:
            known = [c for c in new if c in self.older]
            table.update(zip(known, map(self.older.__getitem__, known), strict=True))
            new.difference_update(known)
        if new:
            order = list(new)
            parts = [[low] if (low := c.lower()).isalpha() else self.split.findall(low) for c in order]
            self._encode([w for p in parts for w in p])
            for c, p in zip(order, parts, strict=True):
                table[c] = table[p[0]] if len(p) == 1 else b"".join([table[w] for w in p])

    def _plain(self, text: str) -> bytes:
        chunks = text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            self._learn(set(chunks))
            return b"".join(map(self.chunks.__getitem__, chunks))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode_bytes of each text; new words of several texts are judged together."""
        out, at = [], 0
        while at < len(texts):
            size, to, lists = 0, at, []
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1_000_000):
                size += len(texts[to])
                plain = "<|" not in texts[to] and not _UNUSUAL.search(texts[to])
                lists.append(texts[to].split() if plain else None)
                to += 1
            self._learn(set().union(*[x for x in lists if x]))
            for x, chunks in zip(texts[at:to], lists, strict=True):
                if chunks is None:
                    out.append(self.encode_bytes(x))
                    continue
                try:
                    out.append(b"".join(map(self.chunks.__getitem__, chunks)))
                except KeyError:  # an unusual text between has turned the table over
                    out.append(self._plain(x))
            at = to
        return out

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word or piece as bytes."""
        found = words.dictionary_encode()
        named = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(named))
        return pa.array([self.chunks[w] for w in named], pa.large_binary()).take(found.indices)

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """encode_bytes of each text, null the empty one: plain texts are lowered, cut and put together as columns, and each distinct piece is looked up once."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
        rows = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(plain)))
        found = rows.flatten().dictionary_encode()
        pieces = found.dictionary
        # Letters before marks are a word and the marks another; other pieces stay whole.
        heads = pc.ascii_rtrim(pieces, _MARKS)
        two = pc.or_(pc.utf8_is_alpha(heads), pc.equal(heads, ""))
        parts = self._words(pc.if_else(two, heads, pieces)), self._words(pc.if_else(two, pc.utf8_ltrim(pieces, _LETTERS), ""))
        ids = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary())).take(found.indices)
        raw, at = ids.buffers()[2] or b"", np.frombuffer(ids.buffers()[1], np.int64)[rows.offsets.to_numpy()].tolist()
        raw, ends = memoryview(raw), iter(zip(at, at[1:], strict=False))
        return [bytes(raw[slice(*next(ends))]) if p else self.encode_bytes(t.as_py()) for p, t in zip(plain.to_pylist(), texts, strict=True)]

    def _segment(self, text: str) -> bytes:
        if not _UNUSUAL.search(text):
            return self._plain(text)
        back = {s: b for b, s in enumerate(self.bytes)}
        words = []
        for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text)):
            words.append(bytes(back[c] for c in w).decode())
        self._learn(set())
        self._encode(words)
        return b"".join([self.chunks[w] for w in words])

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.special_at is None or "<|" not in text:
            return self._segment(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out.append(self._segment(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], np.uint32).tobytes())
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by one space: the file names no decoder, and the library then does just that."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


def _byte_symbols() -> list[str]:
    """The printable symbol for each byte: printable bytes stand for themselves, the rest for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + spare)
            spare += 1
    return out


_OPEN: dict[tuple[str, bool, int], WordBpe] = {}
KEPT.append(_OPEN)


def encoder(path: str, speculate: bool = True, words_kept: int = WORDS_KEPT) -> WordBpe:
    """One encoder for each worker process, file and size of table.  speculate=False merges every new word exactly: the same ids."""
    lean(_OPEN)
    own = (path, speculate, words_kept)
    if own not in _OPEN:
        _OPEN.clear()  # one table at a time
        _OPEN[own] = WordBpe(path, words_kept, speculate)
        # The tables hold no cycles: let the collector pass over them, and come by less often.
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
    return _OPEN[own]


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = [np.frombuffer(x, np.uint32) for x in bpe.encode_many(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; ids and decodings stay in the worker."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        number = {i: str(i) for i in bpe.tokens}
        for b in batches:
            n, a, d = [], [], []
            for x in bpe.encode_many(texts_of(b)):
                ids = np.frombuffer(x, np.uint32)
                listed = ids.tolist()
                n.append(len(listed))
                a.append(hashlib.sha256(" ".join([number[i] for i in listed]).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
