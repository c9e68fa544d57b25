"""Encoding with a SentencePiece BPE file, with the place of every piece in the original bytes, and decoding.

Normalisation takes the longest prefix that the file's compiled character map knows, writes what the map says, and goes on behind it;
a character without an entry stays.  Space becomes the word mark U+2581, one mark is put in front.  For every normalised byte the
original byte where its prefix began is recorded, so the end of a piece, as a place in the normalised text, leads to its end in the original.

No piece has a mark behind another character, so merges never cross the border before a run of marks; control characters that are
in no longer piece are borders as well.  The parts between borders are merged once each and kept in a bounded table.  Merging takes the
pair with the best score first, the leftmost among equals; what is no piece in the end becomes its UTF-8 bytes.

Defined results: a null text is the empty text, whose only id is the end id; repeated rows are each encoded; extra columns are ignored; texts
of any length are encoded whole; the pieces of one character's bytes end where it begins but for the last, which ends with it; the end id ends with the text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.runtime import KEPT, lean, texts_of, tokenizer_path, tune, two_columns
from skeinwork.llm.token_counts import Words

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Parts kept in a worker's table; past half of it, those not met again since the last time go.
PARTS_KEPT = 1_000_000
#: Characters from which on a part is merged with a heap; below, looking through all pairs is faster.
LONG = 100
#: Characters of texts that are looked up together.
TOGETHER = 2_000_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_NONE = float("-inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the protocol buffer format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, whose values are places in a block of strings ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        root = self._under(self.units[0]) if self.units else 0
        starts = bytes(b for b in range(1, 256) if self.units and self.units[root ^ b] & 0x800000FF == b)
        #: Bytes with which an entry begins.
        self.starts = re.compile(b"[" + re.escape(starts) + b"]") if starts else None

    @staticmethod
    def _under(unit: int) -> int:
        """What a unit's children are offset by."""
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest entry that data has at this place becomes, and where it ends."""
        units, found = self.units, None
        node = self._under(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._under(unit)
            if unit & 256:
                found = units[node] & 0x7FFFFFFF, k + 1
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


class Normaliser:
    """The normalisation of a file, with alignment."""

    def __init__(self, spec: bytes):
        given = dict(fields(spec))
        self.map = CharMap(given.get(2, b""))
        self.prefix, self.squeeze = bool(given.get(3, 1)), bool(given.get(4, 1))
        if not given.get(5, 1):
            raise ValueError("files that keep spaces are not served")

    def _rewritten(self, raw: bytes) -> Iterator[tuple[bytes, int, bool]]:
        """(bytes, start, whether from the map) of one stretch of the original after another."""
        at = begun = 0
        while self.map.starts and (m := self.map.starts.search(raw, at)):
            found = self.map.longest(raw, m.start())
            if found is None:
                at = m.start() + 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if begun < m.start():
                yield raw[begun : m.start()], begun, False
            yield found[0], m.start(), True
            at = begun = found[1]
        if begun < len(raw):
            yield raw[begun:], begun, False

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text with a space for each word mark, and for each byte of the text with marks, and its end, the original byte."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, np.int64)
        out, begin = [], []
        for data, start, mapped in self._rewritten(raw):
            marked = data.replace(MARK.encode(), b" ")
            out.append(marked)
            begin.append(np.full(len(marked), start) if mapped else _starts(data, marked) + start)
        data, begin = b"".join(out), np.concatenate(begin)
        if self.squeeze:
            byte = np.frombuffer(data, np.uint8)
            space = byte == 32
            keep = ~space | np.concatenate([[False], ~space[:-1]])
            data, begin, space = byte[keep].tobytes(), begin[keep], space[keep]
            end = len(raw)
            if data.endswith(b" "):
                data, end, begin = data[:-1], int(begin[-1]), begin[:-1]
            if not data:
                return "", np.zeros(1, np.int64)
        else:
            end = len(raw)
        wide = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        begin = np.repeat(begin, wide)
        if self.prefix:
            first = int(begin[0]) if self.squeeze else 0
            data, begin = b" " + data, np.concatenate([[first] * 3, begin])
        return data.decode("utf-8", "surrogatepass"), np.concatenate([begin, [end]])


def _starts(raw: bytes, data: bytes) -> np.ndarray:
    """For each byte of data the start of its character in raw; data is raw with one byte for each word mark."""
    byte = np.frombuffer(raw, np.uint8)
    place = np.maximum.accumulate(np.where(byte & 0xC0 == 0x80, 0, np.arange(len(byte))))
    if len(raw) == len(data):
        return place
    keep, at, mark = np.ones(len(byte), bool), raw.find(MARK.encode()), MARK.encode()
    while at >= 0:
        keep[at + 1 : at + 3] = False
        at = raw.find(mark, at + 3)
    return place[keep]


class PieceBpe:
    """Encoder and decoder for a SentencePiece file of kind BPE with byte fallback."""

    def __init__(self, path: str, kept: int = PARTS_KEPT):
        with open(path, "rb") as f:
            self._load(f.read())
        self.parts = Words(kept)

    def _load(self, data: bytes) -> None:
        self.names, scores, kinds, spec, trainer = [], [], [], b"", {}
        for k, v in fields(data):
            if k == 1:
                piece = dict(fields(v))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif k == 2:
                trainer = dict(fields(v))
            elif k == 3:
                spec = v
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE files with byte fallback, without pieces of users, are served")
        self.normaliser = Normaliser(spec)
        self.end = trainer.get(42, 2)
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.score = {self.names[i]: scores[i] for i in normal}
        self.ids = {self.names[i]: i for i in normal}
        self.byte_ids = [next(i for i, k in enumerate(kinds) if k == BYTE and self.names[i] == f"<0x{b:02X}>") for b in range(256)]
        self.sizes = np.array([1 if k == BYTE else len(n.encode()) if k == NORMAL else 0 for n, k in zip(self.names, kinds, strict=True)], np.int64)
        #: What an id becomes in a decoded text; bytes beyond ASCII are put together first.
        self.shown = [n.replace(MARK, " ") if k == NORMAL else "" for n, k in zip(self.names, kinds, strict=True)]
        for b in range(128):
            self.shown[self.byte_ids[b]] = chr(b)
        self.high = {self.byte_ids[b]: b for b in range(128, 256)}
        self.is_high = np.zeros(len(self.names), bool)
        self.is_high[list(self.high)] = True
        if any(MARK in n.lstrip(MARK) for n in self.score):
            self.cut = re.compile("(?s).+")  # marks inside pieces: a text is one part
        else:
            alone = "".join(c for c in "\n\r\t" if not any(c in n and len(n) > 1 for n in self.score))
            self.cut = re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else ""))

    # ---- merging

    def merge(self, symbols: list[str]) -> list[str]:
        """The pieces that merging leaves of these symbols."""
        return self._merge_long(symbols) if len(symbols) > LONG else self._merge_short(symbols)

    def _merge_short(self, parts: list[str]) -> list[str]:
        score = self.score.get
        found = [score(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := max(found)) > _NONE:
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = score(parts[i] + parts[i + 1], _NONE)
            if i:
                found[i - 1] = score(parts[i - 1] + parts[i], _NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs; entries whose ends have changed since are passed over."""
        n, score = len(parts), self.score.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or parts[i] + parts[j] != both or not parts[i]:
                continue
            parts[i], parts[j] = both, ""
            after[i] = k = after[j]
            after[j] = -2
            if k >= 0:
                before[k] = i
                if (s := score(both + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, both + parts[k]))
            if (h := before[i]) >= 0 and (s := score(parts[h] + both)) is not None:
                heapq.heappush(heap, (-s, h, i, parts[h] + both))
        return [x for x in parts if x]

    def _part(self, part: str) -> bytes:
        out = []
        for x in self.merge(list(part.replace(" ", MARK))):
            if (i := self.ids.get(x)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")]
        return np.array(out, np.uint32).tobytes()

    # ---- texts

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, with the end id, and for each piece the original byte where it ends."""
        at = 0
        while at < len(texts):
            to, size, cut, aligned = at, 0, [], []
            while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
                size += len(texts[to])
                normal, place = self.normaliser.normalise(texts[to])
                cut.append(self.cut.findall(normal))
                aligned.append(place)
                to += 1
            for part in self.parts.missing(set().union(*cut)):
                self.parts.now[part] = self._part(part)
            known = self.parts.now.__getitem__
            for parts, place in zip(cut, aligned, strict=True):
                ids = np.frombuffer(b"".join([*map(known, parts), struct.pack("<I", self.end)]), np.uint32)
                yield ids, place[np.cumsum(self.sizes[ids])]
            at = to

    def decode(self, ids: np.ndarray) -> str:
        """The text of these ids; the mark that encoding puts in front goes."""
        listed = ids.tolist()
        if not self.is_high[ids].any():
            out = "".join(map(self.shown.__getitem__, listed))
        else:
            parts, run = [], bytearray()
            for i in listed:
                if i in self.high:
                    run.append(self.high[i])
                    continue
                if run:
                    parts.append(_lenient(bytes(run)))
                    run.clear()
                parts.append(self.shown[i])
            out = "".join([*parts, _lenient(bytes(run))])
        first = next((i for i in listed if self.sizes[i]), None)
        strip = (self.normaliser.prefix or self.normaliser.squeeze) and first is not None and self.names[first].startswith(MARK)
        return out[1:] if strip else out


def _lenient(data: bytes) -> str:
    """Bytes as text, with U+FFFD for each byte that begins no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _lenient(data[e.start + 1 :])


_OPEN: dict[str, PieceBpe] = {}
KEPT.append(_OPEN)


def encoder(path: str) -> PieceBpe:
    """One encoder for each worker process and file."""
    lean(_OPEN)
    if path not in _OPEN:
        _OPEN[path] = PieceBpe(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
    return _OPEN[path]


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends (original bytes of every piece) and decoded of every row."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids, starts, ends, decoded = [], [], [], []
            for x, e in bpe.encode_many(texts_of(b)):
                ids.append(x.astype(np.int32))
                ends.append(e)
                starts.append(np.concatenate([[0], e[:-1]]))
                decoded.append(bpe.decode(x))
            cols = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "starts", "ends", "decoded"])

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ends_crc32 (of little-endian 64-bit ends) of every row; the rest stays in the worker."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        number = [str(i) for i in range(len(bpe.names))]
        for b in batches:
            n, a, d, c = [], [], [], []
            for ids, ends in bpe.encode_many(texts_of(b)):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(number.__getitem__, ids.tolist())).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                c.append(crc32(ends.astype("<i8").tobytes()))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(c, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"])

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")
