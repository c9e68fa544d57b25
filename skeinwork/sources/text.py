"""Design notes, rules, anchors and configuration."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.functions.scalars import coerced, deep_merge, token_estimate
from skeinwork.sources.blocks import loads
from skeinwork.tables import dealt


def note_summary(text: Column, chars: int = S.NOTE_CHARS) -> Column:
    """The Decision section up to the next heading, else the head of the text."""
    blank = " \t\n\r\x0b\x0c"
    at = F.instr(text, "## Decision")
    rest = F.substring(text, at + F.lit(len("## Decision")), F.length(text))
    section = F.concat(F.lit("## Decision"), F.substring_index(rest, "\n##", 1))
    return F.substring(F.btrim(F.when(at > 0, section).otherwise(text), F.lit(blank)), 1, chars)


def notes(texts: DataFrame) -> DataFrame:
    """S9 on rows (path, text): (ref, content, raw_tokens) by name."""
    return texts.select(F.substring_index("path", "/", -1).alias("ref"), note_summary(F.col("text")).alias("content"), token_estimate("text").alias("raw_tokens")).orderBy("ref")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    return notes(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def load_mapping(path: str) -> dict:
    """A YAML (or JSON) mapping; {} if the file is missing or is no mapping.  Text that is not read as YAML raises ValueError."""
    p = Path(path)
    found = loads(p.read_text(encoding="utf-8")) if p.is_file() else None
    return found if isinstance(found, dict) else {}


def ownership_rules(config: dict) -> list[dict]:
    """Well-formed rules of a configuration, in order; a rule matches by symbol, name or path, whichever comes first."""
    out = []
    for entry in config.get("rules") if isinstance(config.get("rules"), list) else []:
        match = entry.get("match") if isinstance(entry, dict) else None
        kind = next((k for k in ("symbol", "name", "path") if isinstance(match, dict) and isinstance(match.get(k), str)), None)
        if kind:
            out.append({"kind": kind, "pattern": match[kind], **{a: entry.get(a) for a in ("domain", "layer", "criticality", "impact")}})
    return out


RULE = "path string, ordinal long, kind string, pattern string, domain string, layer string, criticality string, impact string"


def rule_files(texts: DataFrame) -> DataFrame:
    """S10 on rows (path, text): the rules of every YAML file with their place in it; a file that is no mapping, or null, has none."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RULE.split(", ")]
        for b in batches:
            found = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                config = loads(text or "")
                rules = ownership_rules(config) if isinstance(config, dict) else []
                found += [(path, k, *(None if r[c] is None else str(r[c]) for c in names[2:])) for k, r in enumerate(rules)]
            types = [pa.string(), pa.int64(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    return dealt(texts.select("path", "text")).mapInArrow(parsed, RULE)


def anchors(spark: SparkSession, config: dict) -> DataFrame:
    """(name, target)."""
    found = config.get("anchors") if isinstance(config.get("anchors"), dict) else {}
    return spark.createDataFrame([(str(k), str(v)) for k, v in found.items()], "name string, target string")


def layered_config(defaults: dict, *layers: dict, prefix: str = "SKEINWORK_", env: dict | None = None) -> dict:
    """Defaults, then each layer, then environment variables: PREFIX_A__B sets a.b."""
    out = defaults
    for layer in layers:
        out = deep_merge(out, layer)
    for name, value in sorted((os.environ if env is None else env).items()):
        if name.startswith(prefix):
            keys = name[len(prefix) :].lower().split("__")
            nested: object = coerced(value)
            for k in reversed(keys):
                nested = {k: nested}
            out = deep_merge(out, nested)
    return out
