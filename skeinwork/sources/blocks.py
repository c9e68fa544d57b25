"""Records in YAML files as a data source: spark.read.format("records_yaml").load(path).

A file holds a mapping of ids to records, or a list of records, in block style; its records begin at the left edge, so a file is read in
ranges of bytes, each by its own task: a task passes over what comes before the first line at the left edge and reads on to the first such line
past its end.  A file that is one flow collection (JSON among them) is read by one task.

Rows are (collection, id, data): the file's or folder's name up to the first dot, the key or the record's own id, and the record as JSON with sorted keys.
Equality and IN on collection choose the files; on id they choose records before their bodies are parsed.

The part of YAML that is read: block mappings and lists, flow collections, plain, single- and double-quoted scalars, also over several lines,
literal and folded blocks, comments, document marks, and the core types (null, booleans, integers, floats; everything else is text).
Anchors, tags and complex keys raise ValueError.  Empty text is null; the last line may lack its break.  A key that comes twice gives two rows; a record
of a list without an id has a null id.  Files whose names begin with a dot or underscore are passed over; an empty folder or file gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skeinwork.sources.files import opened

#: Bytes that one task reads, unless option rangeBytes says otherwise; and bytes read at once.
RANGE, PIECE = 32 << 20, 1 << 20
COLUMNS = "collection string, id string, data string"

# ---- text to values

_INT, _FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
# Words of the core types and the escapes of double quotes.
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", '"': '"', "/": "/", "\\": "\\", " ": " ", "_": "\xa0", "N": "\x85", "L": "\u2028", "P": "\u2029"}
_HEX = {"x": 2, "u": 4, "U": 8}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},?:-][^\n]*?|[?:-][^\s][^\n]*?):(?=\s|$)""")
_COMMENT = re.compile(r"(^|[ \t])#.*")


def scalar(text: str) -> object:
    """The value of a plain scalar."""
    if text in _WORDS:
        return _WORDS[text]
    if text[0] in "&*!@`%|>":
        raise ValueError(f"not read: {text[:40]!r}")
    if _INT.fullmatch(text):
        return int(text)
    return float(text) if _FLOAT.fullmatch(text) else text


def _folded(lines: list[str]) -> str:
    """Lines of a flow scalar: one break is a space, n breaks are n - 1 breaks."""
    out, gaps = lines[0].rstrip(" \t") if len(lines) > 1 else lines[0], 0
    for k, raw in enumerate(lines[1:], 2):
        line = raw.lstrip(" \t") if k == len(lines) else raw.strip(" \t")
        if not line and k < len(lines):
            gaps += 1
            continue
        out += ("\n" * gaps or " ") + line
        gaps = 0
    return out


class _Flow:
    """Flow values in a text, from a place on."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def blank(self) -> None:
        while m := re.compile(r"[ \t\n]+|(?:(?<=\s)|^)#[^\n]*").match(self.text, self.at):
            self.at = m.end()

    def quoted(self) -> str:
        text, quote = self.text, self.text[self.at]
        m = re.compile(r'"((?:[^"\\]|\\.)*)"' if quote == '"' else r"'((?:[^']|'')*)'", re.S).match(text, self.at)
        if not m:
            raise ValueError(f"quote is not closed: {text[self.at : self.at + 40]!r}")
        self.at, body = m.end(), m[1]
        if quote == "'":
            return _folded(body.split("\n")).replace("''", "'")
        # A break after a backslash joins the lines; escapes are undone after folding, so that their breaks stay.
        body = _folded(re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", body).split("\n"))

        def undo(m: re.Match) -> str:
            if m[1][0] in _HEX:
                return chr(int(m[1][1:], 16))
            if m[1] not in _ESCAPES:
                raise ValueError(f"escape {m[0]!r}")
            return _ESCAPES[m[1]]

        out = re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", undo, body, flags=re.S)
        # Pairs of surrogates, as JSON writes them, are one character.
        return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out

    def value(self) -> object:
        self.blank()
        c = self.text[self.at : self.at + 1]
        if c in ("{", "["):
            return self.collection("}" if c == "{" else "]")
        if c in ('"', "'"):
            return self.quoted()
        m = re.compile(r"(?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*").match(self.text, self.at)
        self.at = m.end()
        return scalar(_folded(m[0].strip().split("\n")))

    def collection(self, end: str) -> object:
        self.at += 1
        out: dict | list = {} if end == "}" else []
        while True:
            self.blank()
            if self.at >= len(self.text):
                raise ValueError(f"no {end} at the end")
            if self.text[self.at] == end:
                self.at += 1
                return out
            item, pair = self.value(), False
            self.blank()
            if self.text[self.at : self.at + 1] == ":":
                self.at, pair = self.at + 1, True
                value = self.value()
                self.blank()
            if end == "}":
                out[_key(item)] = value if pair else None
            else:
                out.append({_key(item): value} if pair else item)
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != end:
                raise ValueError(f"no comma: {self.text[self.at : self.at + 40]!r}")


def _key(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


class _Block:
    """Block values: the lines of a text with a cursor."""

    def __init__(self, text: str):
        self.lines, self.at = text.removesuffix("\n").split("\n"), 0

    def next(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has content."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.strip(" \t")
            if body and body[0] != "#" and not (line[:3] in ("---", "...") and not line[3:].strip()):
                return len(line) - len(line.lstrip(" ")), body
            self.at += 1
        return None

    def value(self, least: int) -> object:
        """The value whose lines are indented by at least so much; null if there is none."""
        found = self.next()
        if found is None or found[0] < least:
            return None
        indent, body = found
        if body == "-" or body.startswith("- "):
            return self.items(indent)
        return self.pairs(indent) if _KEY.match(body) else self.inline(body, least)

    def items(self, indent: int) -> list:
        out = []
        while (found := self.next()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip(" ")
            if not rest or rest[0] == "#":
                self.at += 1
                out.append(self.value(indent + 1))
            else:
                # The rest of the line is the first line of a block that stands where it begins.
                inner = indent + len(found[1]) - len(rest)
                self.lines[self.at] = " " * inner + rest
                out.append(self.value(inner) if rest == "-" or rest.startswith("- ") or _KEY.match(rest) else self.inline(rest, indent + 1))
        return out

    def pairs(self, indent: int) -> dict:
        out = {}
        while (found := self.next()) and found[0] == indent and (m := _KEY.match(found[1])):
            key = _key(_Flow(m[1]).quoted() if m[1][0] in "'\"" else scalar(m[1].strip()))
            rest = found[1][m.end() :].lstrip(" \t")
            if not rest or rest[0] == "#":
                self.at += 1
                after = self.next()
                # A list may stand at its key's own indentation.
                flush = after and after[0] == indent and (after[1] == "-" or after[1].startswith("- "))
                out[key] = self.items(indent) if flush else self.value(indent + 1)
            else:
                out[key] = self.inline(rest, indent + 1)
        if found and found[0] >= indent and not (found[0] == indent and _KEY.match(found[1])):
            raise ValueError(f"line {found[1][:40]!r}")
        return out

    def inline(self, rest: str, least: int) -> object:
        """A value that begins on the current line; further lines of it are indented by at least so much."""
        self.at += 1
        if m := re.fullmatch(r"([|>])([-+]?)([1-9]?)([-+]?)(?:\s+#.*)?", rest):
            return self.text(m[1] == "|", m[2] or m[4], least - 1 + int(m[3]) if m[3] else None, least)
        if rest[0] in "\"'[{":
            try:
                return json.loads(rest)
            except ValueError:
                text = rest
            while True:
                flow = _Flow(text)
                try:
                    out = flow.value()
                    break
                except ValueError:
                    if self.at >= len(self.lines):
                        raise
                    # Lines are taken in doubling numbers, so that long values are not tried at every line; what is left over goes back.
                    more = self.lines[self.at : self.at + text.count("\n") + 1]
                    self.at, text = self.at + len(more), "\n".join([text, *more])
            left = text[flow.at :].split("\n")
            if _COMMENT.sub("", left[0]).strip():
                raise ValueError(f"after a value: {left[0][:40]!r}")
            self.at -= len(left) - 1
            return out
        lines = [_COMMENT.sub("", rest).rstrip()]
        while self.at < len(self.lines) and lines[-1] == _COMMENT.sub("", lines[-1]):
            line = self.lines[self.at]
            if line.strip() and (len(line) - len(line.lstrip(" ")) < least or line.lstrip()[0] == "#"):
                break
            lines.append(_COMMENT.sub("", line).strip())
            self.at += 1
        while len(lines) > 1 and not lines[-1]:
            lines.pop()
        if any(re.search(r":(\s|$)", line) for line in lines):
            raise ValueError(f"a mapping inside a plain value: {lines[0][:40]!r}")
        return scalar(_folded(lines))

    def text(self, literal: bool, chomp: str, indent: int | None, least: int) -> str:
        """A literal or folded block."""
        lines = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            depth = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                indent = max(depth, least) if indent is None else indent
                if depth < indent:
                    break
            lines.append(line[indent:] if indent is not None else "")
            self.at += 1
        ends = 0
        while lines and not lines[-1]:
            lines.pop()
            ends += 1
        tail = "" if chomp == "-" else "\n" * (ends + bool(lines)) if chomp == "+" else "\n" * bool(lines)
        if literal:
            return "\n".join(lines) + tail
        first = next((k for k, line in enumerate(lines) if line), 0)
        out, gaps, before = "\n" * first, 0, True
        for k, line in enumerate(lines[first:]):
            if line:
                deeper = line[0] in " \t"
                if k:  # breaks beside lines that stand deeper are kept
                    out += "\n" * (gaps + 1) if deeper or before else "\n" * gaps or " "
                out, gaps, before = out + line, 0, deeper
            else:
                gaps += 1
        return out + tail


def loads(text: str) -> object:
    """The value of a YAML text."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    try:
        return json.loads(text)  # JSON is YAML, and most of what machines write
    except ValueError:
        block = _Block(text)
    out = block.value(0)
    if block.next() is not None:
        raise ValueError(f"line {block.at + 1}: {block.lines[block.at][:40]!r}")
    return out


# ---- files


def _suffix(name: str) -> bool:
    return name.lower().endswith((".yaml", ".yml"))


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each line of an open file from a line's start on."""
    f.seek(at)
    rest = b""
    while piece := f.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield at, line + b"\n"
            at += len(line) + 1
    if rest:
        yield at, rest


def _content(line: bytes) -> bool:
    body = line.strip()
    return bool(body) and body[:1] != b"#" and body not in (b"---", b"...")


def _at_edge(line: bytes, listed: bool) -> bool:
    """Whether a record begins with this line."""
    return line[:1] not in b" \t" and _content(line) and (line[:2] in (b"- ", b"-\n", b"-")) == listed


@dataclass
class Range(InputPartition):
    uri: str
    collection: str
    start: int
    end: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))
        self.chosen: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("collection", "id"):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chosen[f.attribute[0]] = self.chosen.get(f.attribute[0], given) & given
            else:
                yield f

    def _takes(self, column: str, value: str | None) -> bool:
        return column not in self.chosen or value in self.chosen[column]

    def partitions(self) -> list[Range]:
        from pyarrow import fs as arrow_fs

        fs, top = opened(self.path)
        top = top.rstrip("/")
        info = fs.get_file_info(top)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(arrow_fs.FileSelector(top, recursive=True))
        home, out = top if _suffix(top) else None, []
        for f in sorted((f for f in found if f.is_file and f.size), key=lambda f: f.path):
            below = f.path[len(top) :].strip("/").split("/") if f.path != top else []
            if any(n[:1] in "._" for n in below) or not _suffix(f.base_name):
                continue
            name = (home or below[0]).rsplit("/", 1)[-1].split(".")[0]
            if self._takes("collection", name):
                out += [Range(f.path, name, at, min(at + self.range, f.size)) for at in range(0, f.size, self.range)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        for key, record in self._records(part):
            if self._takes("id", key):
                yield part.collection, key, json.dumps(record, sort_keys=True, ensure_ascii=False)

    def _records(self, part: Range) -> Iterator[tuple[str | None, object]]:
        with opened(self.path)[0].open_input_file(part.uri) as f:
            head = next((line for _, line in _lines(f, 0) if _content(line)), b"")
            if head.lstrip(b"\xef\xbb\xbf \t")[:1] in (b"{", b"["):
                if part.start == 0:
                    f.seek(0)
                    yield from _named(loads(f.read().decode("utf-8-sig")))
                return
            listed = head[:2] in (b"- ", b"-\n", b"-")
            lines = _lines(f, max(part.start - 1, 0))
            if part.start:
                next(lines, None)  # the rest of a line that begins before the range, or only its break
            held: list[bytes] = []
            for at, line in lines:
                if _at_edge(line.lstrip(b"\xef\xbb\xbf") if at == 0 else line, listed):
                    yield from self._parsed(held, listed)
                    held = []
                    if at >= part.end:
                        return
                    held = [line]
                elif held:
                    held.append(line)
                elif _content(line) and part.start == 0:
                    raise ValueError(f"{part.uri}: {line[:40]!r} belongs to no record")
            yield from self._parsed(held, listed)

    def _parsed(self, held: list[bytes], listed: bool) -> Iterator[tuple[str | None, object]]:
        if not held:
            return
        if "id" in self.chosen and not listed and (m := _KEY.match(held[0].decode("utf-8-sig"))):
            # The body of a record that is not asked for is not parsed.
            if not any(self._takes("id", key) for key in loads(m[0].rstrip()) or ()):
                return
        yield from _named(loads(b"".join(held).decode("utf-8-sig")))


def _named(value: object) -> Iterator[tuple[str | None, object]]:
    """(id, record) of a mapping or a list."""
    if isinstance(value, dict):
        yield from value.items()
    elif isinstance(value, list):
        for r in value:
            id_ = r.get("id") if isinstance(r, dict) else None
            yield None if id_ is None else _key(id_), r
    elif value is not None:
        raise ValueError(f"neither a mapping nor a list: {str(value)[:40]!r}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class BlockWriter(DataSourceWriter):
    """Each task writes its files aside; the driver moves those of the tasks that count, so a task that runs twice leaves nothing double."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, top = opened(self.path)
        aside, part, open_ = f"{top}/.writing-{self.job}", uuid.uuid4().hex, {}
        fs.create_dir(aside, recursive=True)
        for r in rows:
            if "/" in r["collection"] or r["collection"][:1] in "._" or "." in r["collection"]:
                raise ValueError(f"no name of a collection: {r['collection']!r}")
            if r["collection"] not in open_:
                open_[r["collection"]] = fs.open_output_stream(f"{aside}/{r['collection']}-{part}.yaml")
            record = json.loads(r["data"]) if r["data"] is not None else None
            body = "".join(f"\n  {_text(k)}: {_text(v)}" for k, v in record.items()) if isinstance(record, dict) and record else f" {_text(record)}"
            open_[r["collection"]].write(f"{_text(r['id'])}:{body}\n".encode())
        for f in open_.values():
            f.close()
        return Written([(f"{aside}/{n}-{part}.yaml", f"{top}/{n}.yaml/part-{part}.yaml") for n in open_])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as arrow_fs

        fs, top = opened(self.path)
        old = fs.get_file_info(arrow_fs.FileSelector(top, allow_not_found=True)) if self.overwrite else []
        for f in old:
            if _suffix(f.base_name):
                (fs.delete_file if f.is_file else fs.delete_dir)(f.path)
        for made, place in [pair for m in messages if m for pair in m.files]:
            fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
            fs.move(made, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.path)
        if fs.get_file_info(f"{top}/.writing-{self.job}").type.name != "NotFound":
            fs.delete_dir(f"{top}/.writing-{self.job}")


_UNPRINTED = re.compile("[\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff\ud800-\udfff]")


def _text(value: object) -> str:
    """A value as flow text, which is JSON with what YAML does not print escaped."""
    return _UNPRINTED.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records_yaml"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.dataSource.register(RecordFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
