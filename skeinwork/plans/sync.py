"""Sync of source facts that costs what changed.

What a reference of a file is resolved against is kept as its probes: the module names it imports, the places its calls are looked up in,
the class names of its bases and typed accesses.  An edit changes the answers of some keys: symbols and classes that came or went, and the tails of
paths that did.  Files that have a probe on such a key are resolved anew, together with those that changed; all other rows are taken over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.operators import code, extract
from skeinwork.sources.store import Store
from skeinwork.tables import settle

#: The tables of a state, each with the path that a row belongs to; in the order in which they may be written one by one: a sync that
#: broke off is repeated whole, as long as the facts and the hashes it starts from are still the old ones.
TABLES = ("calls", "bases", "accesses", "states", "probes", "facts", "files")


def _probes(facts: DataFrame, nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(path, kind, key): what the references of these facts are resolved against."""
    at = sites.select("path", F.explode("places").alias("at"))
    typed = extract.state_accesses(facts).filter("type is not null")
    parts = [
        extract.imported_names(facts).select("path", F.lit("module").alias("kind"), F.col("module").alias("key")),
        at.select("path", F.lit("symbol").alias("kind"), F.concat_ws("#", "at.path", "at.name").alias("key")),
        nodes.filter("type = 'class'").select(F.col("file").alias("path"), F.lit("class").alias("kind"), F.explode("bases").alias("key")),
        typed.select("path", F.lit("class").alias("kind"), F.col("type").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts).filter("key is not null").distinct()


def _answers(facts: DataFrame) -> DataFrame:
    """(kind, key, value): what these facts answer to the probes of all files."""
    nodes = code.symbols(facts)
    symbols = nodes.select(F.lit("symbol").alias("kind"), F.regexp_replace("id", "^(func|class):", "").alias("key"), F.col("id").alias("value"))
    classes = facts.filter("fact = 'scope' and (kind = 'class' or type = 'class')")
    return symbols.unionByName(classes.select(F.lit("class").alias("kind"), F.col("name").alias("key"), F.concat_ws("#", "path", "id", "direct").alias("value"))).distinct()


def _tails(path: str) -> Column:
    """The module names that a path can answer to."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _changed_keys(old: DataFrame, new: DataFrame, moved: DataFrame) -> DataFrame:
    """(kind, key) whose answers differ between the old and the new facts of changed files; moved has the paths that came or went."""
    a, b = _answers(old), _answers(new)
    on = ["kind", "key", "value"]
    both = a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti")).select("kind", "key")
    return both.unionByName(moved.select(F.lit("module").alias("kind"), F.explode(_tails("path")).alias("key"))).distinct()


def _derived(facts: DataFrame, every: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables that resolving these facts against every file's gives."""
    own, nodes = code.symbols(facts), settle(code.symbols(every), "symbols")
    sites = code.placed_calls(facts, files)
    edges = code.state_edges(facts, every)
    of_file = F.regexp_extract("src_id", "^[a-z]+:([^#]*)", 1)
    held = extract.class_states(facts).select("path", F.concat(F.lit("state:"), "path", F.lit("#"), "label").alias("id"), "label", F.col("path").alias("file"))
    met = edges.select(of_file.alias("path"), F.col("dst_id").alias("id"), F.regexp_extract("dst_id", "#(.*)$", 1).alias("label"), F.regexp_extract("dst_id", "^state:(.*?)#", 1).alias("file"))
    return {
        "calls": code.resolved_calls(facts, nodes, files, sites),
        "bases": code.extends(nodes, own).select(of_file.alias("path"), "*"),
        "accesses": edges.select(of_file.alias("path"), "*"),
        "states": held.unionByName(met).distinct(),
        "probes": _probes(facts, own, sites),
    }


def synced(scan: DataFrame, state: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state after this scan (path, language, source, hash), and one row of counts.

    files are all Python files, parsed those read anew, removed those that went, resolved those whose references were resolved again; references and
    again are the references of all files and of those.
    """
    now = settle(scan.filter("language = 'python'").select("path", "source", "hash"), "scan")
    if state is None:
        facts = settle(extract.python_facts(now), "facts")
        redo, removed, parsed = now.select("path"), None, now.select("path")
        out = _derived(facts, facts, now)
    else:
        status = settle(code.reuse(now, state["files"]), "status")
        parsed, removed = status.filter("status = 'parsed'").select("path"), status.filter("status = 'removed'").select("path")
        gone = parsed.unionByName(removed)
        fresh = settle(extract.python_facts(now.join(parsed, "path", "left_semi")), "fresh")
        moved = removed.unionByName(parsed.join(state["files"], "path", "left_anti"))
        keys = _changed_keys(state["facts"].join(gone, "path", "left_semi"), fresh, moved)
        hit = state["probes"].join(keys, ["kind", "key"], "left_semi").select("path")
        redo = settle(parsed.unionByName(hit).join(removed, "path", "left_anti").distinct(), "redo")
        facts = settle(state["facts"].join(gone, "path", "left_anti").unionByName(fresh), "facts")
        left = redo.unionByName(removed).distinct()
        out = {n: state[n].join(left, "path", "left_anti").unionByName(df) for n, df in _derived(facts.join(redo, "path", "left_semi"), facts, now).items()}
    out |= {"facts": facts, "files": now.select("path", "hash")}
    out = {n: settle(out[n], n) for n in TABLES}
    refs = lambda df: df.filter("fact in ('call', 'attr')")
    counts = [
        out["files"].agg(F.count("*").alias("files")), parsed.agg(F.count("*").alias("parsed")),
        (removed if removed is not None else parsed.limit(0)).agg(F.count("*").alias("removed")), redo.agg(F.count("*").alias("resolved")),
        refs(facts).agg(F.count("*").alias("references")), refs(facts).join(redo, "path", "left_semi").agg(F.count("*").alias("again")),
    ]
    return out, reduce(lambda a, b: a.join(b), counts)


def graphs(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The symbol and state graphs of a state: exec_nodes, exec_edges, df_nodes, df_edges."""
    facts = state["facts"]
    nodes = code.symbols(facts)
    edges = [code.defines(facts), state["bases"].drop("path"), code.calls(state["calls"])]
    return {
        "exec_nodes": nodes.select("id", "type", "label", "file", F.col("line").cast("int").alias("lineno")),
        "exec_edges": reduce(DataFrame.unionByName, edges),
        "df_nodes": state["states"].select("id", F.lit("attr").alias("kind"), "label", "file").distinct(),
        "df_edges": state["accesses"].select("src_id", "dst_id", "type", "resolution"),
    }


def sync_into(store: Store, kept: Store, scan: DataFrame) -> DataFrame:
    """Bring the store's graphs to this scan, from the state that the sync before left in kept; one row of counts."""
    state = {n: kept.scan(n) for n in TABLES} if kept.path("files") else None
    after, counts = synced(scan, state)
    for name, rows in graphs(after).items():
        _, base = store.read(name)
        schema = store.spark.createDataFrame([], S.COLLECTIONS[name]).schema
        given = rows if "src_id" not in rows.columns else rows.withColumn("id", C.surrogate_id("edge", "src_id", "type", "dst_id"))
        cols = [F.col(f.name).cast(f.dataType) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        store.replace(name, given.select(*cols), base)
    for name in TABLES:
        kept.overwrite(name, after[name])
    return counts
