"""Filters, projections and validity checks on records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.tables import NAMED, literal_table, many, numbered, settle


def where(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """every key equals its value; a missing column counts as null, and null equals null."""
    tests = [(F.col(k) if k in df.columns else F.lit(None)).eqNullSafe(F.lit(v)) for k, v in conditions.items()]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def memory_query(memory: DataFrame, scope: str | None = None, kind: str | None = None, status: str | None = None) -> DataFrame:
    """given filters, newest first, then by id."""
    given = {k: v for k, v in (("scope", scope), ("kind", kind), ("status", status)) if v is not None}
    return where(memory, given).orderBy(F.desc("created_at"), "id")


def of_type(nodes: DataFrame, type_: str) -> DataFrame:
    """nodes of a type, by id."""
    return nodes.filter(F.col("type") == type_).orderBy("id")


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    """the node with that label and the smallest id."""
    return nodes.filter(F.col("label") == label).orderBy("id").limit(1)


def first_by_label(nodes: DataFrame) -> DataFrame:
    """F4 for all labels at once: label and id."""
    return nodes.groupBy("label").agg(F.min("id").alias("id"))


def resolve(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id): an id equal to the target wins, else all ids with that label."""
    ids = targets.select("target").distinct()
    exact = ids.join(nodes.select(F.col("id").alias("target"), "id"), "target")
    rest = ids.join(exact.select("target"), "target", "left_anti")
    return exact.unionByName(rest.join(nodes.select(F.col("label").alias("target"), "id"), "target"))


def resolve_unique(nodes: DataFrame, targets: DataFrame, shown: int = 25) -> DataFrame:
    """(target, id, error, candidates): an id if there is exactly one, else 'not found' or 'ambiguous' with the first candidates."""
    found = resolve(nodes, targets).groupBy("target").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("id")), 1, shown).alias("c"))
    out = targets.select("target").distinct().join(found, "target", "left")
    return out.select(
        "target",
        F.when(F.col("n") == 1, F.col("c")[0]).alias("id"),
        F.when(F.col("n").isNull(), F.lit("not found")).when(F.col("n") > 1, F.lit("ambiguous")).alias("error"),
        F.when(F.col("n") > 1, F.col("c")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def search_label(nodes: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """labels that contain the text, case counting, the first by id."""
    return nodes.filter(F.col("label").contains(part)).orderBy("id").limit(limit)


def confident_calls(edges: DataFrame, floor: str = "resolved") -> DataFrame:
    """F8: call edges from the floor up; an unknown floor means resolved."""
    least = S.CONFIDENCE_RANK.get(floor, S.CONFIDENCE_RANK["resolved"])
    return edges.filter((F.col("type") == "calls") & (C.confidence_rank("confidence") >= least))


def brief(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id with type, label and file; an unknown id keeps only itself."""
    cols = [F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in ("type", "label", "file")]
    return ids.join(nodes.select("id", *cols), "id", "left")


def edge_rules(df: DataFrame) -> DataFrame:
    """The registry as rows: type, from_type, to_type; * for any."""
    rows = [(e, s, d) for e, (src, dst) in S.EDGE_RULES.items() for s in (src or ("*",)) for d in (dst or ("*",))]
    return literal_table(df.sparkSession, rows, "type string, from_type string, to_type string")


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with ok: both ends exist and the registry allows their types.  The registry is a few rows and is broadcast."""
    ends = nodes.select("id", "type")
    typed = edges.join(ends.select(F.col("id").alias("src_id"), F.col("type").alias("s")), "src_id", "left").join(ends.select(F.col("id").alias("dst_id"), F.col("type").alias("d")), "dst_id", "left")
    rules = edge_rules(edges).groupBy("type").agg(F.collect_set(F.struct("from_type", "to_type")).alias("rules"))
    fits = F.exists("rules", lambda r: ((r["from_type"] == "*") | (r["from_type"] == F.col("s"))) & ((r["to_type"] == "*") | (r["to_type"] == F.col("d"))))
    ok = F.coalesce(F.col("s").isNotNull() & F.col("d").isNotNull() & fits, F.lit(False))
    return typed.join(F.broadcast(rules), "type", "left").withColumn("ok", ok).drop("s", "d", "rules")


def inserted_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after an insert, and the refused ones with the reason: a missing end, or types that the edge may not connect."""
    cols = ["src_id", "dst_id", "type"]
    ids = nodes.select("id")
    checked = checked_edges(new.select(*cols).distinct(), nodes)
    bad = checked.filter("not ok").join(ids.withColumnRenamed("id", "__s"), F.col("src_id") == F.col("__s"), "left").join(ids.withColumnRenamed("id", "__d"), F.col("dst_id") == F.col("__d"), "left")
    reason = F.when(F.col("__s").isNull(), "missing source").when(F.col("__d").isNull(), "missing target").otherwise("forbidden types")
    return edges.select(*cols).unionByName(checked.filter("ok").select(*cols)).distinct(), bad.select(*cols, reason.alias("reason"))


def valid_cards(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """cards with valid: a File's card must have the hash that the file has now."""
    now = nodes.select(F.col("id").alias("ref"), F.col("type").alias("t"), F.col("hash").alias("h"))
    return cards.join(now, "ref", "left").withColumn("valid", F.when(F.col("t") == "File", F.col("source_hash").eqNullSafe(F.col("h"))).otherwise(True)).drop("t", "h")


CARD_FIELDS = ("schema_version", "card_id", "target", "generated_at", "source_hash", "provider", "purpose", "modules", "dependencies", "key_decisions", "risks", "recent_changes", "extensions")


def card_errors(raw: Column) -> Column:
    """what is wrong with a card given as JSON text, or null: not an object, unknown or missing keys, version, empty id."""
    keys = F.json_object_keys(raw)
    known = F.array(*map(F.lit, CARD_FIELDS))
    return (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown key")
        .when(F.size(F.array_except(known, keys)) > 0, "missing key")
        .when(~F.get_json_object(raw, "$.schema_version").eqNullSafe(F.lit(str(S.SCHEMA_VERSION))), "version")
        .when(F.coalesce(F.get_json_object(raw, "$.card_id"), F.lit("")) == "", "empty id")
    )


def fits(used: Column, limit: Column) -> Column:
    """no limit fits everything."""
    return limit.isNull() | (used <= limit)


def pending(proposals: DataFrame) -> DataFrame:
    """proposals that wait for a decision, newest first."""
    return proposals.filter(F.col("status") == "proposed").orderBy(F.desc("created_at"), "id")


def skill(nodes: DataFrame, target: str) -> DataFrame:
    """F16: a Skill by id, else by label."""
    skills = nodes.filter(F.col("type") == "Skill").withColumn("by_label", F.col("id") != target)
    return skills.filter((F.col("id") == target) | (F.col("label") == target)).orderBy("by_label", "id").limit(1).drop("by_label")


def newest_first(sessions: DataFrame) -> DataFrame:
    """F17"""
    return sessions.orderBy(F.desc("created_at"), "id")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """O1: rank within each key, from 1; an order that ends with an id leaves no ties.

    All rows are numbered in one sort by ranges, and a key's ranks begin at its first number: no task holds a key whole.
    """
    placed = numbered(df, *keys, *order, name="rank")
    first = settle(placed.groupBy(*[F.col(k).alias(f"{k}__key") for k in keys]).agg(F.min("rank").alias("rank__first")), "first-ranks")
    own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    begun = placed.join(F.broadcast(first) if first.count() <= NAMED else many(first), own)
    return begun.withColumn("rank", F.col("rank") - F.col("rank__first") + 1).select(*df.columns, "rank")


def united(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src_id, dst_id, type): the earliest."""
    return first_of_each(edges, ["src_id", "dst_id", "type"], [F.col("created_at"), F.col("id")])


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New label and props, but the time of creation of the node that was there."""
    o = old.select("id", *[F.col(c).alias(f"o_{c}") for c in ("type", "label", "props", "created_at")])
    out = new.withColumn("here", F.lit(True)).join(o, "id", "full")
    pick = lambda c: F.when(F.col("here"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return out.select("id", pick("type"), pick("label"), pick("props"), F.coalesce("o_created_at", "created_at").alias("created_at"))


def set_difference(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys stored before that are not there now."""
    return stored.join(now.select(key).distinct(), key, "left_anti")
