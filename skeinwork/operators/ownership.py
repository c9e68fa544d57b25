"""Declared and observed ownership."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas as S
from skeinwork.functions.scalars import glob_to_regex, half_even
from skeinwork.operators.records import confident_calls
from skeinwork.tables import NAMED, dealt, literal_table, many, settle

AXES = ("domain", "layer", "criticality", "impact")
#: Least and greatest length of a key of the rule index.
SHORT, LONG = 3, 8
#: Patterns without a key that one pass over the texts tries.
LOOSE = 64
_MARKS = "dDwWsSbBAzZ"


def required_literal(regex: str, classes: bool = False) -> str:
    """The longest text that everything the pattern finds holds, as far as its outer sequence shows; empty if nothing is sure.

    With classes, a class of one character counts as that character.
    """
    if re.search(r"\(\?[^:=!<)]*[ix]|\\Q", regex):
        return ""
    best, run, i = "", "", 0
    while i < len(regex):
        c, i = regex[i], i + 1
        if c == "\\" and i < len(regex):
            c, i = regex[i], i + 1
            if not c.isalnum():
                run += c
                continue
            if c not in _MARKS:
                return ""
        elif c == "|":
            return ""
        elif c in "*?{":  # what stands before can be missing
            run = run[:-1]
            i = regex.find("}", i) + 1 if c == "{" else i
            i += regex[i : i + 1] in ("?", "+")
        elif c == "(":
            i = _closed(regex, i, ")")
        elif c == "[" and classes and regex[i + 1 : i + 2] == "]" and regex[i] not in "^[]\\":
            run, i = run + regex[i], i + 2
            continue
        elif c == "[":
            i = _closed(regex, i, "]")
        elif c == "+":
            i += regex[i : i + 1] in ("?", "+")
        elif c not in ".^$":
            run += c
            continue
        if i <= 0:
            return ""
        best, run = max(best, run, key=len), ""
    return max(best, run, key=len)


def _closed(regex: str, at: int, end: str) -> int:
    """The place behind the bracket that closes the one before at; -1 if that is not plain to see."""
    depth, first = 1, at + (regex[at : at + 1] == "^")
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            at += 1
        elif end == "]":
            if c == "[":
                return -1  # a class in a class
            if c == "]" and at > first:
                return at + 1
        elif c == "[":
            at = _closed(regex, at + 1, "]") - 1
            if at < 0:
                return -1
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return -1


def _compiled(kind: str, pattern: str) -> tuple[str, str]:
    """The regular expression of a rule, and its required literal."""
    regex = glob_to_regex(pattern) if kind == "path" else pattern
    return regex, "" if kind == "symbol" else required_literal(regex, classes=True)


_SCHEMA = "ordinal long, kind string, pattern string, regex string, literal string, " + ", ".join(f"{a} string" for a in AXES)


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """Rules in order, the project's before the defaults."""
    defaults = [{"kind": k, "pattern": p, "layer": layer} for k, p, layer in S.DEFAULT_OWNERSHIP]
    rows = []
    for n, r in enumerate([*rules, *defaults]):
        if r.get("kind") in ("symbol", "name", "path") and isinstance(r.get("pattern"), str):
            rows.append((n, r["kind"], r["pattern"], *_compiled(r["kind"], r["pattern"]), *(r.get(a) if isinstance(r.get(a), str) else None for a in AXES)))
    return literal_table(spark, rows, _SCHEMA)


def rules_of(rows: DataFrame) -> DataFrame:
    """Rules from rows of ordinal, kind, pattern and any axes; rows of another kind or without a pattern are no rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_compiled(k, p) for k, p in zip(b.column("kind").to_pylist(), b.column("pattern").to_pylist(), strict=True)]
            cols = [*(b.column(c) for c in ("ordinal", "kind", "pattern")), pa.array([r for r, _ in made], pa.string()), pa.array([x for _, x in made], pa.string()), *(b.column(a) for a in AXES)]
            yield pa.RecordBatch.from_arrays(cols, ["ordinal", "kind", "pattern", "regex", "literal", *AXES])

    axes_ = [F.col(a).cast("string").alias(a) if a in rows.columns else F.lit(None).cast("string").alias(a) for a in AXES]
    known = rows.filter(F.col("kind").isin("symbol", "name", "path") & F.col("pattern").isNotNull())
    return dealt(known.select(F.col("ordinal").cast("long").alias("ordinal"), "kind", "pattern", *axes_)).mapInArrow(run, _SCHEMA)


def _windows(text: Column, size: int) -> Column:
    """The distinct parts of that length of a text."""
    n = F.length(text) - (size - 1)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.when(n > 0, parts).otherwise(F.array().cast("array<string>")))


def _parts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, key) of the keys that a text holds, each once."""
    begins = settle(keys.groupBy(F.substring("key", 1, SHORT).alias("head")).agg(F.collect_set(F.length("key")).alias("sizes")), "heads")
    runs = texts.select("text", F.explode(_windows(F.concat("text", F.lit("\0" * (LONG - SHORT))), LONG)).alias("run")).withColumn("head", F.substring("run", 1, SHORT))
    few = F.broadcast(begins) if begins.count() <= NAMED else many(begins)
    cut = runs.join(few, "head").select("text", "run", F.explode("sizes").alias("size")).select("text", F.substring("run", F.lit(1), F.col("size")).alias("key"))
    return many(cut).join(many(keys), "key", "left_semi").distinct()


def _hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, ordinal, axes) of the rules that find a text.

    A rule's key is a part of its required literal, the one that the fewest texts hold.  Texts meet rules by key; only what met is held against
    the pattern.  A text offers parts of those lengths only that keys with the same first characters have, once for counting and meeting.
    Rules without a key can find anything, so each is tried on all texts, a block of them in one pass.
    """
    rules = settle(rules, "rules")
    size = F.least(F.length("literal"), F.lit(LONG))
    keyed = rules.filter(F.length("literal") >= SHORT)
    sizes = sorted(r[0] for r in keyed.select(size).distinct().collect())  # LONG - SHORT + 1 at most
    out = None
    if sizes:
        of_size = F.flatten(F.array(*[F.when(size == n, _windows(F.col("literal"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
        offered = settle(keyed.select("ordinal", F.explode(of_size).alias("key")), "rule-keys")
        held = settle(_parts(texts, offered.select("key").distinct()), "held")
        counts = held.groupBy("key").agg(F.count("*").alias("n"))
        best = many(offered).join(many(counts), "key", "left").groupBy("ordinal").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
        out = many(held).join(many(many(keyed).join(many(best), "ordinal")), "key").filter(F.contains("text", F.col("literal")) & F.rlike("text", F.col("regex"))).select("text", "ordinal", *AXES)
    loose = rules.filter(F.length("literal") < SHORT)
    tried = loose.select("ordinal", "regex").collect()
    for at in range(0, len(tried), LOOSE):
        found = F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(r["regex"])), F.lit(r["ordinal"])) for r in tried[at : at + LOOSE]]))
        part = texts.select("text", F.explode(found).alias("ordinal")).join(loose.select("ordinal", *AXES), "ordinal").select("text", "ordinal", *AXES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else texts.join(rules.select("ordinal", *AXES).limit(0).withColumn("text", F.lit("")), "text")


def matches(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, tier, ordinal, axes) of each rule that fits a symbol: its exact label 3, a pattern found in the label 2, a glob on the file 1."""
    own = ("ordinal", *AXES)
    nodes = nodes.select("id", "label", "file")
    exact = rules.filter("kind = 'symbol'").select(F.col("pattern").alias("label"), *own)
    out = nodes.join(exact, "label").select("id", F.lit(3).alias("tier"), *own)
    for tier, kind, column in ((2, "name", "label"), (1, "path", "file")):
        texts = nodes.select(F.col(column).alias("text")).filter("text is not null").distinct()
        hits = _hits(texts, rules.filter(F.col("kind") == kind)).withColumnRenamed("text", column)
        out = out.unionByName(nodes.join(hits, column).select("id", F.lit(tier).alias("tier"), *own))
    return out


def axes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, each axis, domain_tier): the highest tier wins, then the earliest rule; one aggregation, no sort."""
    best = [F.max(F.when(F.col(a).isNotNull(), F.struct(F.col("tier"), (-F.col("ordinal")).alias("o"), F.col(a).alias("v")))).alias(a) for a in AXES]
    found = matches(nodes, rules).groupBy("id").agg(*best)
    return found.select("id", *[F.col(f"{a}.v").alias(a) for a in AXES], F.col("domain.tier").alias("domain_tier"))


def observed(calls: DataFrame, declared: DataFrame, floor: str = "resolved") -> DataFrame:
    """(id, observed_owner, observed_conf, caller_domains): the most frequent domain among direct callers, ties to the smaller name."""
    edges = confident_calls(calls, floor).filter("src_id <> dst_id").select("src_id", "dst_id").distinct()
    known = declared.filter("domain is not null").select(F.col("id").alias("src_id"), "domain")
    counts = edges.join(known, "src_id").groupBy(F.col("dst_id").alias("id"), "domain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "domain"))).withColumn("kinds", F.count("*").over(w))
    return ranked.filter("rank = 1").select("id", F.col("domain").alias("observed_owner"), half_even(F.col("n") / F.col("total"), 2).alias("observed_conf"), F.col("kinds").alias("caller_domains"))


def classify(nodes: DataFrame, calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Declared and observed owner, whether they agree, and a blended confidence."""
    declared = axes(nodes, rules)
    out = nodes.select("id").join(declared, "id", "left").join(observed(calls, declared), "id", "left")
    weight = F.when(F.col("domain_tier") == 3, F.lit(1.0)).when(F.col("domain_tier") == 2, 0.8).when(F.col("domain_tier") == 1, 0.6).otherwise(0.2)
    agree = F.coalesce(F.col("domain") == F.col("observed_owner"), F.lit(False))
    blended = F.when(F.col("observed_owner").isNull(), weight).otherwise(F.least(F.lit(1.0), 0.5 * weight + 0.5 * F.col("observed_conf") + F.when(agree, 0.1).otherwise(0.0)))
    unknown = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(
        F.col("id").alias("symbol"), F.coalesce("domain", F.lit("Unknown")).alias("declared_owner"), unknown("observed_owner", "Unknown"), agree.alias("agreement"),
        half_even(blended, 2).alias("confidence"), unknown("layer", "Unknown"), unknown("criticality", "Unclassified"), unknown("impact", "Unclassified"),
    )


def runtime_summary(nodes: DataFrame, calls: DataFrame, rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """The classification with direct consumers and dependencies as id=domain, by id."""
    domain = nodes.select("id").join(axes(nodes, rules).select("id", "domain"), "id", "left").select("id", F.coalesce("domain", F.lit("Unknown")).alias("domain"))
    edges = confident_calls(calls).filter("src_id <> dst_id").select("src_id", "dst_id").distinct()

    def side(own: str, other: str, name: str) -> DataFrame:
        pairs = edges.select(F.col(own).alias("symbol"), F.col(other).alias("id")).join(symbols.select(F.col("id").alias("symbol")), "symbol", "left_semi").join(domain, "id", "left")
        return pairs.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "id", F.coalesce("domain", F.lit("Unknown"))))), ",").alias(name))

    base = classify(nodes, calls, rules).join(symbols.select(F.col("id").alias("symbol")).distinct(), "symbol", "left_semi")
    out = base.join(side("dst_id", "src_id", "consumers"), "symbol", "left").join(side("src_id", "dst_id", "dependencies"), "symbol", "left")
    return out.fillna("", ["consumers", "dependencies"])
