"""Context selection under a token budget."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.operators.graph import traverse
from skeinwork.operators.records import valid_cards
from skeinwork.tables import numbered, settle

#: Order of gathering: source class, then place in it.
ITEM = ("bundle", "ref", "kind", "content", "tokens", "raw_tokens", "tier", "order")


#: Items in one block of a bundle.
BLOCK = 1024


def _greedy(tokens: np.ndarray, used: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of these items are taken, in order, and the tokens used after each."""
    taken, after = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    for k, n in enumerate(tokens.tolist()):
        if used + n <= budget:
            taken[k], used = True, used + n
        after[k] = used
    return taken, after


def _descended(rows: DataFrame, open_: DataFrame, budget: int) -> DataFrame:
    """(head, block, used): the tokens used after each of the open blocks."""

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        used = _greedy(table.column("tokens").to_numpy(), table.column("before")[0].as_py(), budget)[1][-1]
        return pa.table([table.column("head")[:1], table.column("block")[:1], pa.array([used], pa.int64())], ["head", "block", "used"])

    return rows.select("head", "block", "seq", "tokens").join(open_, ["head", "block"]).groupBy("head", "block").applyInArrow(walk, "head long, block long, used long")


def _entered(blocks: DataFrame, known: DataFrame, budget: int) -> DataFrame:
    """(head, block, before, stop): the tokens used before each block of a bundle, up to the first that must be looked into and is not known."""

    def walk(summaries: pa.Table, known: pa.Table) -> pa.Table:
        summaries = summaries.sort_by("block")
        after = dict(zip(known.column("block").to_pylist(), known.column("used").to_pylist(), strict=True))
        used, before, stop = 0, [], False
        for block, whole, least in zip(*(summaries.column(c).to_pylist() for c in ("block", "whole", "least")), strict=True):
            before.append(used)
            if block in after:
                used = after[block]
            elif used + whole <= budget:
                used += whole
            elif least is not None and used + least <= budget:
                stop = True
                break
        n = len(before)
        return pa.table([summaries.column("head")[:n], summaries.column("block")[:n], pa.array(before, pa.int64()), pa.array([False] * (n - 1) + [stop], pa.bool_())], ["head", "block", "before", "stop"])

    return blocks.groupBy("head").cogroup(known.groupBy("head")).applyInArrow(walk, "head long, block long, before long, stop boolean")


def packed(items: DataFrame, budget: int = S.TOKEN_BUDGET) -> DataFrame:
    """The manifest of each bundle: every item with seq, included and used (tokens so far).

    Items are taken by tier, order and ref; one that does not fit is dropped and later, smaller ones are still tried.  A bundle is cut into blocks of
    BLOCK items, each known by the sum and the least of its tokens.  With the tokens used so far a block is taken whole, passed over, or
    has to be looked into; a walk over the summaries stops there, the block's items are walked in a task of their own, and the walk goes on in
    the next round, for all bundles at once.  A block that is looked into takes at least one more item, so there are no more rounds
    than items that fit after the first drop, and rarely more than a few.  At last each block is walked from where it is entered.
    """
    given = items.select("bundle", "ref", "kind", F.col("tier").cast("int").alias("tier"), F.col("tokens").cast("long").alias("tokens"), F.col("raw_tokens").cast("long").alias("raw_tokens"), F.col("order").cast("long").alias("order"))
    placed = numbered(given, "bundle", "tier", "order", "ref", "kind", "tokens", "raw_tokens")
    heads = placed.groupBy(F.col("bundle").alias("own")).agg(F.min("place").alias("head"), F.sum("raw_tokens").alias("raw_equiv"))
    seq = F.col("place") - F.col("head")
    rows = placed.join(heads, F.equal_null(F.col("bundle"), F.col("own"))).select("head", F.floor(seq / BLOCK).alias("block"), "bundle", "raw_equiv", seq.alias("seq"), "ref", "kind", "tier", "tokens")
    rows = settle(rows, "items")
    blocks = settle(rows.groupBy("head", "block").agg(F.sum("tokens").alias("whole"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")), "blocks")
    open_ = blocks.filter((F.col("block") == 0) & (F.col("whole") > budget)).select("head", "block", F.lit(0).cast("long").alias("before"))
    known = settle(_descended(rows, open_, budget), "known")
    while True:
        entered = settle(_entered(blocks, known, budget), "entered")
        open_ = entered.filter("stop").select("head", "block", "before")
        if open_.isEmpty():
            break
        known = settle(known.unionByName(_descended(rows, open_, budget)), "known")

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        taken, after = _greedy(table.column("tokens").to_numpy(), table.column("before")[0].as_py(), budget)
        return table.select(_MANIFEST[:-2]).append_column("included", pa.array(taken)).append_column("used", pa.array(after))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {types.get(n, 'boolean' if n == 'included' else 'bigint')}" for n in _MANIFEST)
    return rows.join(entered.select("head", "block", "before"), ["head", "block"]).groupBy("head", "block").applyInArrow(finish, schema)


_MANIFEST = ["bundle", "raw_equiv", "seq", "ref", "kind", "tier", "tokens", "included", "used"]


def bundle_totals(manifest: DataFrame) -> DataFrame:
    """Per bundle: tokens used, raw equivalent of all items, saved, and how many were dropped."""
    used = F.sum(F.when(F.col("included"), F.col("tokens")).otherwise(0)).cast("long")
    out = manifest.groupBy("bundle").agg(used.alias("used"), F.first("raw_equiv").alias("raw_equiv"), F.count_if(~F.col("included")).alias("dropped"))
    return out.withColumn("saved", F.greatest(F.lit(0).cast("long"), F.col("raw_equiv") - F.col("used")))


def rendered(manifest: DataFrame, items: DataFrame, title: str = "## Grounding") -> DataFrame:
    """C17: the text of each bundle."""
    kept = manifest.filter("included").join(items.select("bundle", "ref", "kind", "content"), ["bundle", "ref", "kind"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind", "content"))), lambda x: F.struct(x["kind"].alias("kind"), x["content"].alias("content")))
    return kept.groupBy("bundle").agg(C.rendered(lines, title).alias("text"))


def recent(nodes: DataFrame, type_: str, used: DataFrame, limit: int = S.RECENT) -> DataFrame:
    """The newest nodes of a type that are not used yet."""
    left = nodes.filter(F.col("type") == type_).join(used.select("id").distinct(), "id", "left_anti")
    return left.orderBy(F.desc("created_at"), "id").limit(limit)


def top_memories(memory: DataFrame, used: DataFrame, limit: int = S.RECENT) -> DataFrame:
    """Active project and user memories by salience and age; of equal ones project comes before user."""
    live = memory.filter("status = 'active' and scope in ('project', 'user')").join(used.select("id").distinct(), "id", "left_anti")
    return live.orderBy(F.desc("salience"), F.desc("created_at"), F.when(F.col("scope") == "project", 0).otherwise(1), "id").limit(limit)


def subject_memory(memory: DataFrame) -> DataFrame:
    """(id, memory, content): the newest active memory that links to a node."""
    links = memory.filter("status = 'active'").select(F.explode("links").alias("node"), "id", "content", "created_at")
    w = Window.partitionBy("node").orderBy(F.desc("created_at"), "id")
    return links.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("node").alias("id"), F.col("id").alias("memory"), "content")


def gathered(parts: list[DataFrame]) -> DataFrame:
    """Items of several sources with one running order: source by source, place by place."""
    every = reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(k)) for k, p in enumerate(parts)])
    return every.withColumn("order", F.row_number().over(Window.partitionBy("bundle").orderBy("source", "place")) - 1).drop("source", "place")


def subject_items(subjects: DataFrame, nodes: DataFrame, cards: DataFrame, memory: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """For each subject (bundle, id, place) the best content: a valid card, a memory, the source of a File if allowed, or its label."""
    fresh = valid_cards(cards, nodes).filter("valid").select(F.col("ref").alias("id"), "purpose")
    at = subjects.join(nodes.select("id", "type", "label", "size"), "id").join(fresh, "id", "left").join(subject_memory(memory).select("id", "memory", F.col("content").alias("noted")), "id", "left")
    if sources is None:
        at = at.withColumn("text", F.lit(None).cast("string"))
    else:
        at = at.join(sources.select(F.col("path").alias("label"), F.substring("source", 1, S.SOURCE_CHARS).alias("text")), "label", "left")
        at = at.withColumn("text", F.when(F.col("type") == "File", F.coalesce("text", "label")))
    kind = F.when(F.col("purpose").isNotNull(), "card").when(F.col("noted").isNotNull(), "memory").when(F.col("text").isNotNull(), "source").otherwise("stub")
    content = F.coalesce("purpose", "noted", "text", "label")
    tokens = C.token_estimate(content)
    raw = F.when(kind == "card", F.greatest(tokens, F.floor((F.coalesce("size", F.lit(0)) + 3) / 4).cast("long"))).otherwise(tokens)
    return at.select("bundle", F.col("id").alias("ref"), kind.alias("kind"), content.alias("content"), tokens.alias("tokens"), raw.alias("raw_tokens"), C.tier_of(kind).alias("tier"), "place", F.when(kind == "memory", F.col("memory")).alias("memory"))


def _items(df: DataFrame, kind: str, ref: str, content: str, place: str, raw: str | None = None) -> DataFrame:
    tokens = C.token_estimate(content)
    return df.select("bundle", F.col(ref).alias("ref"), F.lit(kind).alias("kind"), F.col(content).alias("content"), tokens.alias("tokens"), (F.col(raw) if raw else tokens).alias("raw_tokens"), C.tier_of(F.lit(kind)).alias("tier"), F.col(place).alias("place"))


def build(nodes: DataFrame, edges: DataFrame, cards: DataFrame, seeds: DataFrame, depth: int = 2, budget: int = S.TOKEN_BUDGET) -> DataFrame:
    """P5: the manifest for each seed: the seed and what it reaches, cards before labels."""
    reached = traverse(nodes, edges, seeds, depth).select(F.col("seed").alias("bundle"), "id", "depth", "parent")
    start = seeds.select(F.col("id").alias("bundle"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    at = start.unionByName(reached).join(nodes.select("id", "type", "label", "size"), "id").join(cards.select(F.col("ref").alias("id"), "purpose"), "id", "left")
    order = F.row_number().over(Window.partitionBy("bundle").orderBy("depth", "parent", "id")) - 1
    kind = F.when(F.col("purpose").isNotNull(), "card").otherwise("stub")
    content = F.coalesce("purpose", "label")
    tokens = C.token_estimate(content)
    items = at.select("bundle", F.col("id").alias("ref"), kind.alias("kind"), content.alias("content"), tokens.alias("tokens"), C.raw_tokens("type", "size", tokens).alias("raw_tokens"), C.tier_of(kind).alias("tier"), order.alias("order"))
    return packed(items, budget)


def _reach_both(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """What is reached in either direction, with its place in the order of the search."""
    found = traverse(nodes, edges, seeds, depth, direction="both")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "parent", "id")).cast("long")).withColumnRenamed("seed", "bundle")


def _most(df: DataFrame) -> int:
    """The largest number of rows of a bundle: one number."""
    return df.groupBy("bundle").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _reached_then_recent(nodes: DataFrame, reached: DataFrame, seeds: DataFrame, type_: str, content: Column) -> DataFrame:
    """Reachable nodes of a type, then for each seed the newest others.

    The newest that a seed has not reached are among the newest of all, as many more as a seed has reached at most; only
    those are paired with the seeds.
    """
    near = reached.filter(F.col("type") == type_).select("bundle", "id", "place")
    newest = nodes.filter(F.col("type") == type_).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(S.RECENT + _most(near))
    rest = seeds.select(F.col("id").alias("bundle")).join(newest).join(near.select("bundle", "id"), ["bundle", "id"], "left_anti")
    w = Window.partitionBy("bundle").orderBy(F.desc("created_at"), "id")
    late = rest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= S.RECENT).select("bundle", "id", (F.col("n") + 1_000_000_000).cast("long").alias("place"))
    return near.unionByName(late).join(nodes.withColumn("text", content).select("id", "text"), "id")


def mentor_items(nodes: DataFrame, edges: DataFrame, cards: DataFrame, memory: DataFrame, seeds: DataFrame, depth: int = 2, notes: DataFrame | None = None, profile: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Subjects, decisions, findings, design notes (ref, content, raw_tokens), the profile line and top memories of each seed.

    There are few seeds: each is a request.
    """
    reached = _reach_both(nodes, edges, seeds, depth)
    own = seeds.join(nodes.select("id", "type"), "id").select(F.col("id").alias("bundle"), "id", "type", F.lit(0).cast("long").alias("place"))
    subjects = own.unionByName(reached.select("bundle", "id", "type", "place")).filter("type in ('File', 'Module')").select("bundle", "id", "place")
    subject = subject_items(subjects, nodes, cards, memory, sources)
    label = F.col("label")
    decisions = _items(_reached_then_recent(nodes, reached, seeds, "Decision", label), "decision", "id", "text", "place")
    findings = _items(_reached_then_recent(nodes, reached, seeds, "AuditFinding", C.finding_text(label, F.col("recommendation"), F.col("violations")) if "violations" in nodes.columns else label), "finding", "id", "text", "place")
    bundle = seeds.select(F.col("id").alias("bundle")).distinct()
    parts = [subject.drop("memory"), decisions, findings]
    if notes is not None:
        parts.append(_items(bundle.join(notes.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ref")).cast("long"))), "adr", "ref", "content", "place", "raw_tokens"))
    if profile is not None:
        parts.append(_items(bundle.join(profile.select("content")).select("bundle", F.lit("repo_profile").alias("ref"), "content", F.lit(0).cast("long").alias("place")), "repo_profile", "ref", "content", "place"))
    used = subject.filter("memory is not null").select("bundle", F.col("memory").alias("id")).distinct()
    top = top_memories(memory, used.limit(0), S.RECENT + _most(used))
    live = bundle.join(top).join(used, ["bundle", "id"], "left_anti")
    w = Window.partitionBy("bundle").orderBy(F.desc("salience"), F.desc("created_at"), F.when(F.col("scope") == "project", 0).otherwise(1), "id")
    parts.append(_items(live.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= S.RECENT), "memory", "id", "content", "place"))
    return gathered(parts)


def auditor_items(nodes: DataFrame, edges: DataFrame, cards: DataFrame, memory: DataFrame, seeds: DataFrame, criteria: str = "", evidence: str = "", depth: int = 2) -> DataFrame:
    """Criteria and evidence, the subjects' valid cards only, decisions and findings of each seed."""
    reached = _reach_both(nodes, edges, seeds, depth)
    own = seeds.join(nodes.select("id", "type"), "id").select(F.col("id").alias("bundle"), "id", "type", F.lit(0).cast("long").alias("place"))
    subjects = own.unionByName(reached.select("bundle", "id", "type", "place")).filter("type in ('File', 'Module')").select("bundle", "id", "place")
    bundle = seeds.select(F.col("id").alias("bundle")).distinct()
    parts = []
    for kind, ref, text in (("criteria", "acceptance-criteria", criteria), ("evidence", "available-evidence", evidence)):
        if text:
            parts.append(_items(bundle.select("bundle", F.lit(ref).alias("ref"), F.lit(text).alias("content"), F.lit(0).cast("long").alias("place")), kind, "ref", "content", "place"))
    parts.append(subject_items(subjects, nodes, cards, memory).filter("kind = 'card'").drop("memory"))
    label = F.col("label")
    parts.append(_items(_reached_then_recent(nodes, reached, seeds, "Decision", label), "decision", "id", "text", "place"))
    parts.append(_items(_reached_then_recent(nodes, reached, seeds, "AuditFinding", label), "finding", "id", "text", "place"))
    return gathered(parts)
