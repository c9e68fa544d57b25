"""Joins and summaries over source facts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.functions.scalars import half_even
from skeinwork.operators import extract
from skeinwork.operators.extract import is_stdlib
from skeinwork.operators.records import first_of_each
from skeinwork.tables import settle


def symbols(facts: DataFrame) -> DataFrame:
    """Symbol nodes; of two with one id, the one further down."""
    rows = facts.filter("fact = 'scope' and direct").select("id", "type", "label", F.col("path").alias("file"), "line", "name", F.col("names").alias("bases"))
    return first_of_each(rows, ["id"], [F.desc("line")])


def defines(facts: DataFrame) -> DataFrame:
    """Edges from a file, class or function to what is defined in its body."""
    return facts.filter("fact = 'scope' and direct").select(F.col("owner").alias("src_id"), F.col("id").alias("dst_id"), F.lit("defines").alias("type"), F.lit("exact").alias("confidence")).distinct()


def extends(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A base whose simple name is that of exactly one class, and of another one; for the classes of nodes, or of some of them."""
    classes = nodes.filter("type = 'class'")
    unique = classes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1").select(F.col("name").alias("base"), "target")
    own = classes if of is None else of.filter("type = 'class'")
    pairs = own.select("id", F.explode("bases").alias("base")).join(unique, "base").filter("id <> target")
    return pairs.select(F.col("id").alias("src_id"), F.col("target").alias("dst_id"), F.lit("extends").alias("type"), F.lit("heuristic").alias("confidence")).distinct()


def module_index(files: DataFrame) -> DataFrame:
    """(module, path) of Python files; of two files of one module the later path, component by component."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."), r"\.__init__$", "")
    rows = files.filter(F.col("path").endswith(".py")).select(dotted.alias("module"), "path")
    return first_of_each(rows, ["module"], [F.desc(F.split("path", "/"))])


def resolve_modules(names: DataFrame, index: DataFrame) -> DataFrame:
    """(module, path): the file of that dotted name, else the one file whose name ends with its parts."""
    wanted = names.select("module").distinct()
    exact = wanted.join(index, "module").withColumnRenamed("path", "exact")
    parts = F.split("module", r"\.")
    tails = index.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("module"))
    near = wanted.join(tails, "module").groupBy("module").agg(F.count_distinct("path").alias("n"), F.min("path").alias("near")).filter("n = 1").drop("n")
    return wanted.join(exact, "module", "left").join(near, "module", "left").select("module", F.coalesce("exact", "near").alias("path")).filter("path is not null")


def local_symbols(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names (path, name) with id: the function of that name in the file, else the class, else null."""
    ids = nodes.select("id")
    out = names.select("path", "name").distinct()
    for kind in ("func", "class"):
        own = ids.filter(F.col("id").startswith(f"{kind}:")).select(F.col("id").alias(kind))
        out = out.join(own, F.concat(F.lit(f"{kind}:"), "path", F.lit("#"), "name") == F.col(kind), "left")
    return out.select("path", "name", F.coalesce("func", "class").alias("id"))


def placed_calls(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Call sites (call, path, caller) with the places to look the callee up in, in order.

    A call has at most one place to look in: its own class for a method of self; for a plain name its own file, then the file that an
    import binds the name to; for an attribute the file of the imported receiver.
    """
    bound = extract.imported_names(facts)
    homes = resolve_modules(bound, module_index(files)).select("module", F.col("path").alias("home"))
    bound = bound.join(homes, "module", "left").select("path", F.col("bound").alias("first"), "home", "original")
    one, first, attr = F.size("names") == 1, F.col("names")[0], F.col("names")[1]
    sites = extract.call_sites(facts).withColumn("call", F.monotonically_increasing_id()).withColumns({"first": first, "on_self": F.coalesce(first == "self", F.lit(False)) & ~one})
    sites = sites.join(bound, ["path", "first"], "left")
    place = lambda order, file, name, functions: F.struct(F.lit(order).alias("order"), file.alias("path"), name.alias("name"), F.lit(functions).alias("only_functions"))
    there = F.when(one, F.coalesce("original", "first")).otherwise(F.concat_ws(".", "original", attr))
    places = (
        F.when(F.col("on_self"), F.array(place(0, F.col("path"), F.concat(F.col("cls"), F.lit("."), attr), True)))
        .when(one, F.array(place(0, F.col("path"), F.col("first"), False), place(1, F.col("home"), there, False)))
        .when(F.col("original").isNotNull(), F.array(place(0, F.col("home"), there, True)))
        .otherwise(F.array(place(0, F.col("home"), there, False)))
    )
    return settle(sites.select("call", "path", "caller", F.filter(places, lambda at: at["path"].isNotNull() & at["name"].isNotNull()).alias("places")), "calls")


def resolved_calls(facts: DataFrame, nodes: DataFrame, files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Call sites with callee or null.  All places of all calls are looked up in one join with the symbols, a function before a class, and the first that has something is the callee."""
    sites = placed_calls(facts, files) if sites is None else sites
    wanted = sites.select("call", F.explode("places").alias("at")).select("call", "at.*")
    known = local_symbols(wanted, nodes).filter("id is not null")
    found = wanted.join(known, ["path", "name"]).filter(~F.col("only_functions") | F.col("id").startswith("func:"))
    best = found.groupBy("call").agg(F.min_by("id", "order").alias("callee"))
    return sites.join(best, "call", "left").select("path", "caller", "callee")


def calls(resolved: DataFrame) -> DataFrame:
    return resolved.filter("callee is not null").select(F.col("caller").alias("src_id"), F.col("callee").alias("dst_id"), F.lit("calls").alias("type"), F.lit("resolved").alias("confidence")).distinct()


def scan_summary(files: DataFrame, nodes: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """A1: one row of counts."""
    n = nodes.agg(*[F.count_if(F.col("type") == t).alias(name) for t, name in (("function", "functions"), ("method", "methods"), ("class", "classes"))])
    e = edges.agg(*[F.count_if(F.col("type") == t).alias(f"{t}_edges") for t in ("defines", "extends", "calls")])
    return files.agg(F.count("*").alias("files")).join(n).join(e).join(resolved.agg(F.count_if(F.col("callee").isNull()).alias("unresolved_calls")))


def typed_accesses(facts: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Typed accesses (path, seq, src_id, type, resolution, dst_id); dst_id is null unless exactly one file of every defines a class of the type's name."""
    every = facts if every is None else every
    homes = every.filter("fact = 'scope' and kind = 'class'").groupBy(F.col("name").alias("known")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("home")).filter("n = 1")
    rows = extract.state_accesses(facts).filter("type is not null").withColumnRenamed("type", "known").join(homes, "known", "left")
    state = F.when(F.col("home").isNotNull(), F.concat(F.lit("state:"), "home", F.lit("#"), "known", F.lit("."), "attr"))
    return rows.select("path", "seq", F.col("accessor").alias("src_id"), _kind().alias("type"), F.col("how").alias("resolution"), state.alias("dst_id"))


def _kind() -> Column:
    return F.when(F.col("store"), "writes").otherwise("reads")


def state_edges(facts: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Reads and writes (src_id, dst_id, type, resolution) of self's attributes and of typed accesses whose class is known."""
    own = extract.state_accesses(facts).filter("how = 'self'").select("path", "seq", F.col("accessor").alias("src_id"), _kind().alias("type"), F.col("how").alias("resolution"), F.concat(F.lit("state:"), "path", F.lit("#"), "cls", F.lit("."), "attr").alias("dst_id"), F.lit(0).alias("late"))
    typed = typed_accesses(facts, every).filter("dst_id is not null").withColumn("late", F.lit(1))
    # The last writer of one edge decides its resolution: files in path order, own accesses of a file before its typed ones.
    return first_of_each(own.unionByName(typed), ["src_id", "dst_id", "type"], [F.desc(F.split("path", "/")), F.desc("late"), F.desc("seq")]).select("src_id", "dst_id", "type", "resolution")


def state_nodes(facts: DataFrame, edges: DataFrame) -> DataFrame:
    own = extract.class_states(facts).select(F.concat(F.lit("state:"), "path", F.lit("#"), "label").alias("id"), "label", F.col("path").alias("file"))
    more = edges.select(F.col("dst_id").alias("id"), F.regexp_extract("dst_id", "#(.*)$", 1).alias("label"), F.regexp_extract("dst_id", "^state:(.*?)#", 1).alias("file"))
    return own.unionByName(more).distinct().withColumn("kind", F.lit("attr"))


def resolution_stats(facts: DataFrame, edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """A2: one row: files, symbols, edges, accesses by how they were resolved, and the share resolved."""
    kinds = {"resolved_self": "self", "resolved_annotation": "annotation", "resolved_constructor": "constructor", "unresolved": "unresolved"}
    f = extract.state_accesses(facts).agg(F.count("*").alias("total"), *[F.count_if(F.col("how") == k).alias(name) for name, k in kinds.items()])
    e = edges.agg(F.count_if(F.col("type") == "reads").alias("reads"), F.count_if(F.col("type") == "writes").alias("writes"), F.count_if(F.col("resolution") != "self").alias("typed"))
    out = files.agg(F.count("*").alias("files")).join(nodes.agg(F.count("*").alias("symbols"))).join(e).join(f)
    good = F.col("resolved_self") + F.col("resolved_annotation") + F.col("resolved_constructor")
    return out.withColumn("rate", F.when(F.col("total") > 0, half_even(good / F.col("total"), 2)).otherwise(0.0))


# ---- repository graph


def packages(index: DataFrame) -> DataFrame:
    """(name, dir): folders with an __init__.py, by their base name; of two of one name the later path."""
    rows = index.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("dir"))
    return first_of_each(rows.withColumn("name", F.substring_index("dir", "/", -1)), ["name"], [F.desc(F.split("dir", "/"))]).select("name", "dir")


def package_of(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(path, dir) of the deepest package folder that holds the file: its ancestors are joined, so no prefix scan is needed."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = index.filter(F.instr("path", "/") > 0).select("path", F.explode(up).alias("dir"))
    return above.join(packs.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def dependency_edges(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(src_id, dst_id, kind, name) of files: internal to another package, else external; standard library and one's own package are no dependencies."""
    own = package_of(index, packs).select("path", F.substring_index("dir", "/", -1).alias("own"))
    named = index.select("path", "language", F.explode("imports").alias("name")).join(own, "path", "left").join(packs.withColumnRenamed("dir", "to"), "name", "left")
    py = (F.col("language") == "python") & ~is_stdlib(F.col("name")) & (F.col("to").isNull() | ~F.col("name").eqNullSafe(F.col("own")))
    js = F.col("language").isin("javascript", "typescript") & ~F.col("name").startswith(".")
    inside = (F.col("language") == "python") & F.col("to").isNotNull()
    kept = named.filter(py | js)
    return kept.select(F.concat(F.lit("file:"), "path").alias("src_id"), F.when(inside, F.concat(F.lit("mod:"), "to")).otherwise(F.concat(F.lit("dep:"), "name")).alias("dst_id"), F.when(inside, "internal").otherwise("external").alias("kind"), "name").distinct()


def repository_graph(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (src_id, dst_id, type) of files, packages and dependencies."""
    packs = packages(index)
    held = package_of(index, packs)
    deps = dependency_edges(index, packs)
    edges = held.select(F.concat(F.lit("mod:"), "dir").alias("src_id"), F.concat(F.lit("file:"), "path").alias("dst_id"), F.lit("contains").alias("type")).unionByName(deps.select("src_id", "dst_id", F.lit("depends_on").alias("type")))
    modules = held.select(F.concat(F.lit("mod:"), "dir").alias("id"), F.lit("Module").alias("type"), F.substring_index("dir", "/", -1).alias("label"))
    used = deps.select(F.col("dst_id").alias("id"), F.when(F.col("kind") == "internal", "Module").otherwise("Dependency").alias("type"), F.col("name").alias("label"))
    files = index.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("type"), F.col("path").alias("label"))
    return files.unionByName(modules).unionByName(used).distinct(), edges.distinct()


def reuse(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """Every path with status reused (same hash), parsed or removed."""
    p = prior.select("path", F.col("hash").alias("before"))
    out = scan.select("path", "hash").join(p, "path", "full")
    return out.select("path", F.when(F.col("hash").isNull(), "removed").when(F.col("hash").eqNullSafe(F.col("before")), "reused").otherwise("parsed").alias("status"))


def hotspots(churn: DataFrame, limit: int = S.HOTSPOTS) -> DataFrame:
    """The files that change most."""
    return churn.orderBy(F.desc("churn"), "path").limit(limit)


def scan_result(index: DataFrame, status: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """A3: one row: files, modules, distinct internal edges and externals, files parsed, reused and removed, and the hotspots (path, churn)."""
    packs = packages(index)
    deps = dependency_edges(index, packs)
    d = deps.agg(F.count_distinct(F.when(F.col("kind") == "internal", F.struct("src_id", "dst_id"))).alias("internal"), F.count_distinct(F.when(F.col("kind") == "external", F.col("name"))).alias("external"))
    s = status.agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("parsed", "reused", "removed")])
    out = index.agg(F.count("*").alias("files")).join(packs.agg(F.count("*").alias("modules"))).join(d).join(s)
    if churn is None:
        return out
    rows = F.sort_array(F.collect_list(F.struct((-F.col("churn")).alias("less"), "path", "churn")))
    return out.join(hotspots(churn).agg(F.transform(rows, lambda h: F.struct(h["path"].alias("path"), h["churn"].alias("churn"))).alias("hotspots")))


def ordered_digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest): the digest of all texts in the order of key.  A digest is one chain, so one task takes the sorted parts in turn; it holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for b in batches:
            digest.update("".join(b.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])

    return df.orderBy(key).select(text).coalesce(1).mapInArrow(run, "digest string")


def profile(index: DataFrame, root: str) -> DataFrame:
    """A4: languages, counts and a digest over path:hash in path order."""
    counts = index.agg(F.lit(root).alias("root"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count("*").alias("file_count"))
    lines = index.select("path", F.concat_ws(":", "path", F.coalesce("hash", F.lit(""))).alias("line"))
    return counts.join(ordered_digest(lines, "path", "line").withColumnRenamed("digest", "index_hash"))


def module_hashes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """A5: (id, source_hash) of modules: a digest over id:hash of the files they contain, by id."""
    held = edges.filter("type = 'contains'").select(F.col("src_id").alias("module"), F.col("dst_id").alias("id")).join(files.select("id", "hash"), "id")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("hash", F.lit("")).alias("hash")))), lambda r: F.concat_ws(":", r["id"], r["hash"]))
    return held.groupBy(F.col("module").alias("id")).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("source_hash"))
