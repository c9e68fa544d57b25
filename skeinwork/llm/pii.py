"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, the end of a scheme, and cues of identifiers.  A local parser
for each kind grows the anchor to both sides and validates what it gets.  Anchors are met in text order and each kind
keeps the end of its last match, so matches of a kind are leftmost and do not overlap.

Kinds: email, ip, card (Luhn), phone; and, beyond these, url (a scheme and a host with a dot), iban (mod 97), ssn (after a cue)
and secret (a long token after a cue and = or :).

Defined results: a null text is empty and has no spans; offsets count code points; repeated rows are each searched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.runtime import texts_of, tune, two_columns

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "secret")
BASE = KINDS[:4]
_ORDER = {k: n for n, k in enumerate(KINDS)}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_ADDRESS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_IBAN = re.compile(r"[\s:#=-]{1,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:#=]{1,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_\-+/]{16,}={0,2})")
_CUES = {"iban": ("iban",), "ssn": ("ssn", "social security number"), "secret": ("token", "secret", "password", "api_key", "apikey", "access_key")}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "scheme")
    for kind, cues in _CUES.items():
        for c in cues:
            for form in (c, c.upper(), c.capitalize()):
                a.add_word(form, kind)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(KINDS, 0)
    ip_from = card_from = 0
    for last, kind in _automaton().iter(text):
        if kind == "digit":
            if last >= ip_from:
                if m := _QUAD.match(text, last):
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((last, m.end(), "ip"))
                else:  # nor can a match begin further on in this run of digits
                    ip_from = _DIGITS.match(text, last).end()
            if last >= card_from:
                if m := _CHAIN.match(text, last):
                    card_from = m.end()
                    if 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                        out.append((last, m.end(), "card"))
        elif kind == "@":
            start = last
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                out.append((start, m.end(), "email"))
                ends["email"] = m.end()
        elif kind == "+":
            if (m := _PHONE.match(text, last)) and 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((last, m.end(), "phone"))
        elif kind == "scheme":
            if (s := _SCHEME.search(text, max(ends["url"], last - 14), last - 2)) and (m := _ADDRESS.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                out.append((s.start(), end, "url"))
                ends["url"] = end
        elif kind == "iban":
            if last >= ends[kind] and (m := _IBAN.match(text, last + 1)) and _iban_valid(m[1].replace(" ", "")):
                out.append((m.start(1), m.end(1), kind))
                ends[kind] = m.end(1)
        elif kind == "ssn":
            if last >= ends[kind] and (m := _SSN.match(text, last + 1)):
                out.append((m.start(1), m.end(1), kind))
                ends[kind] = m.end(1)
        elif last >= ends["secret"] and (m := _SECRET.match(text, last + 1)) and any(map(str.isdigit, m[1])):
            out.append((m.start(1), m.end(1), "secret"))
            ends["secret"] = m.end(1)
    out.sort(key=lambda x: (x[0], _ORDER[x[2]], x[1]))
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its spans as an array of (start, end, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(x)] for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, spans array<struct<start: int, end: int, kind: string>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in the text replaced; the other columns and null texts stay as they are."""
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([x if x is None else redacted(x, spans_of(x)) for x in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names)

    tune(docs.sparkSession)
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, docs.withColumn(text, F.col(text).cast("string")).schema)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, alls = {k: [] for k in BASE}, [], []
            for x in texts_of(b):
                found = spans_of(x)
                base = [s for s in found if s[2] in BASE]
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                alls.append(joined(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(shas, pa.string()), pa.array(alls, pa.string())], names)

    tune(docs.sparkSession)
    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
