"""Graph joins and traversals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.operators.records import brief, confident_calls, resolve
from skeinwork.tables import NAMED, many, numbered, settle


def directed(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Edges as (src, dst) in the direction of travel."""
    if types is not None:
        edges = edges.filter(F.col("type").isin(types))
    out = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbors(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(seed, edge_type, id) of the other end of each edge; ends that are no nodes are dropped.

    The edges at the seeds are taken first, and written: only their other ends are looked up among the nodes, by sorted ids.
    """
    if types is not None:
        edges = edges.filter(F.col("type").isin(types))
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.select(F.col("src_id").alias("seed"), F.col("type").alias("edge_type"), F.col("dst_id").alias("id")))
    if direction in ("in", "both"):
        parts.append(edges.select(F.col("dst_id").alias("seed"), F.col("type").alias("edge_type"), F.col("src_id").alias("id")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = settle(seeds.select(F.col("id").alias("seed")).distinct(), "seeds")
    touched = settle(every.join(_sized(wanted, wanted.count()), "seed", "left_semi"), "touched")
    return touched.join(many(nodes.select("id")), "id", "left_semi").select("seed", "edge_type", "id")


def reach(adjacency: DataFrame, seeds: DataFrame, depth: int | None = None, written: bool = False) -> DataFrame:
    """Breadth-first search from many seeds at once: (seed, id, depth, parent), seeds left out.

    Each level joins the frontier with the edges, drops what was seen, and keeps the least parent, so the order
    (depth, parent, id) is that of a search which visits neighbours by id.  A level is written to the shared
    folder; only its number of rows comes to the driver.  What was seen lies in parts of falling size, of which the last two are put
    together when they are about equal, so a level reads few files however deep the search goes.  Where only the set is asked for, see reachable.
    written: the adjacency holds each pair once and is read from files already.
    """
    if not written and (depth is None or depth > 2):  # read once for each level
        adjacency = settle(adjacency.distinct(), "adjacency")
    start = seeds.select(F.col("id").alias("seed")).distinct()
    frontier = start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    seen, level = [(frontier, 0)], 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select("seed", F.col("id").alias("src")).join(adjacency, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.lit(level).alias("depth"), F.min("src").alias("parent"))
        frontier = settle(step.join(_together(seen).select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", "depth", "parent"), "level")
        rows = frontier.count()
        if not rows:
            break
        seen.append((frontier, rows))
        while len(seen) > 2 and seen[-2][1] <= 2 * seen[-1][1]:
            (last, n), (before, m) = seen.pop(), seen.pop()
            seen.append((settle(before.unionByName(last), "seen"), n + m))
    return _together(seen).filter("depth > 0")


def _together(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p, _ in parts])


#: Levels that reachable searches one by one before it makes shortcuts, and shortcuts kept for a node.
PLAIN, SHORTCUTS = 3, 4


def reachable(adjacency: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id) of all that a seed reaches, the seed left out, in rounds that grow with the logarithm of the depth.

    Of many edges the nodes that only one node leads to are laid aside first: they are reached with that node, so chains and trees take no part in the rounds (see _lone).
    So are edges to nodes without edges of their own, layer by layer, as long as that takes away half of what is left; a layer is gone through once, after
    the search of what lies before it.

    After a few plain levels a round also takes shortcuts, from all that was found.  Shortcuts are paths of twice the length of the round
    before's.  Of a node's many only some are kept, by hash: a few ways on for each node, and for each node a few ways to it, so their number is bounded
    by that of the nodes.  Chains and trees, wherever they branch, lose none and are followed twice as far each time.  What is found goes through all
    its own edges as well, once, and the search ends when that brings nothing new: shortcuts only change how soon.  A round's result is one
    table, so the plan does not grow.
    """
    start = seeds.select(F.col("id").alias("seed")).distinct()
    edges, layers = settle(adjacency, "adjacency"), []
    while True:
        before = edges.count()
        edges, lone = _lone(edges, start) if before > NAMED else (settle(edges.distinct(), "adjacency"), [])
        edges, leaves = _peeled(edges)
        layers += [*[(layer, False) for layer in lone], *[(layer, True) for layer in leaves]]
        rows = edges.count()
        if rows <= NAMED or 2 * rows > before:
            break
    found = settle(start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("round")), "found")
    jumps, round_, fresh, rows = None, 0, start.count(), 0
    while fresh:
        round_, rows = round_ + 1, rows + fresh
        if round_ > PLAIN and (jumps is None or not jumps.isEmpty()):
            jumps = _doubled(jumps if jumps is not None else _doubled(_few(edges.withColumn("way", F.explode(F.array(F.lit("on"), F.lit("to")))))))
        step = _sized(found.filter(F.col("round") == round_ - 1), fresh).join(many(edges), F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"))
        if jumps is not None:
            step = step.unionByName(_sized(found, rows).join(many(jumps), F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")))
        every = found.unionByName(step.withColumn("round", F.lit(round_)))
        found = settle(every.groupBy("seed", "id").agg(F.min("round").alias("round")), "found")
        fresh = found.filter(F.col("round") == round_).count()
    for left, (layer, often) in reversed(list(enumerate(layers))):
        onward = _sized(found, rows).join(many(layer), F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"))
        # A layer's nodes are not among those found before it; only leaves are led to by several nodes.
        found = found.select("seed", "id").unionByName(onward.distinct() if often else onward)
        if left:
            found = settle(found, "reached")
            rows = found.count()
    return found.filter("seed <> id").select("seed", "id")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows for a join: few go to every task, more are sorted."""
    return F.broadcast(df) if rows <= NAMED else many(df)


def _peeled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges without those to nodes that no edge leaves, and the layers laid aside, the outermost first."""
    layers, rows = [], edges.count()
    while rows:
        leaves = settle(many(edges).join(many(edges.select(F.col("src").alias("dst")).distinct()), "dst", "left_anti").select("src", "dst"), "leaves")
        n = leaves.count()
        if 2 * n < rows:
            break
        edges = settle(many(edges).join(many(leaves.select("dst").distinct()), "dst", "left_anti").select("src", "dst"), "core")
        layers, rows = [*layers, leaves], rows - n
    return edges, layers


#: Of how many nodes one, by hash, is looked at to see whether it pays to lay nodes aside.
ONE_OF = 64


def _lone(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges without the nodes, seeds apart, that only one node leads to, and the layer of these: (src, dst), the node that dst is reached with and dst.

    Where such nodes seem to be less than half of all, all edges stay for the rounds, with the same result.  Those of them that lead nowhere are looked up once, at the end.
    """
    moves, no, by = edges.filter("src <> dst"), F.lit(False), F.xxhash64("src")
    some = moves.filter(F.pmod(F.xxhash64("dst"), F.lit(ONE_OF)) == 0).groupBy("dst").agg((F.min(by) == F.max(by)).alias("lone"))
    every, lone = some.agg(F.count("*"), F.count_if("lone")).first()
    if 2 * lone < every:
        return settle(edges.distinct(), "adjacency"), []
    # Dealt by dst first, so that a task sorts its part once for the groups and the join, and what is written stays in that order.
    ends = moves.repartition("dst").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"), F.max("src").alias("last"))
    inner = moves.select(F.col("src").alias("id")).distinct().withColumn("inner", F.lit(True))
    named = _sized(seeds.select(F.col("seed").alias("id"), F.lit(True).alias("named")), seeds.count())
    marked = many(ends).join(many(inner), "id", "left").join(named, "id", "left")
    ends = settle(marked.select("id", "up", ((F.col("up") == F.col("last")) & ~F.coalesce("named", no)).alias("lone"), F.coalesce("inner", no).alias("inner")), "ends")
    every, lone, ways = ends.agg(F.count("*"), F.count_if("lone"), F.count_if(F.col("lone") & F.col("inner"))).first()
    begins = _begins(ends.filter("lone AND inner").select("id", "up"), ways)
    begun = many(begins.withColumnRenamed("id", "up"))
    leaves = many(ends.filter("lone AND NOT inner").select("id", "up")).join(begun, "up", "left")
    layer = begins.select(F.col("begin").alias("src"), F.col("id").alias("dst")).unionByName(leaves.select(F.coalesce("begin", "up").alias("src"), F.col("id").alias("dst")))
    if lone == every:
        return edges.filter("false"), [layer]
    others = many(moves).join(many(ends.filter("NOT lone").select(F.col("id").alias("dst"))), "dst", "left_semi")
    core = many(others.withColumnRenamed("src", "up")).join(begun, "up", "left").select(F.coalesce("begin", "up").alias("src"), "dst")
    return settle(core.filter("src <> dst").distinct(), "core"), [layer]


#: Steps that one job of _begins takes where few pairs are left, and tables of its results that are read as they are.
STEPS, PARTS = 8, 8


def _begins(pairs: DataFrame, rows: int) -> DataFrame:
    """(id, begin) for pairs (id, up) in which no id comes twice: the first node on the way up that is no id, or any node of the circle in which the way ends.

    In each round every node draws 0 or 1, by hash.  Pairs from a 1 up to a 0 are laid aside, and the pairs that led up to them lead past them.
    That is a quarter of the pairs, however long the ways are, so all rounds together move a few times the pairs.  When few are left, they are followed up many
    steps a job.  What was laid aside gets its begin from the node above it, in the order back.
    """
    aside = []
    while rows > NAMED:
        drawn = lambda end: F.xxhash64(end, F.lit(len(aside))).bitwiseAND(1)  # noqa: B023, E731
        taken = pairs.filter((drawn("id") == 1) & (drawn("up") == 0))
        kept = pairs.filter((drawn("id") == 0) | (drawn("up") == 1))
        past = many(kept.filter(drawn("up") == 1)).join(many(taken.select(F.col("id").alias("up"), F.col("up").alias("above"))), "up", "left")
        step = kept.filter(drawn("up") == 0).unionByName(past.select("id", F.coalesce("above", "up").alias("up")))
        aside.append(taken)
        pairs = settle(step.filter("id <> up"), "pairs")
        rows = pairs.count()
    steps = 1
    while steps < rows:
        above, step = F.broadcast(pairs.select(F.col("id").alias("up"), F.col("up").alias("above"))), pairs
        for _ in range(STEPS - 1):
            step = step.join(above, "up", "left").select("id", F.coalesce("above", "up").alias("up"))
        pairs, steps = settle(step, "pairs"), steps * STEPS
    parts = [pairs.withColumnRenamed("up", "begin")]
    for taken in reversed(aside):
        known = reduce(DataFrame.unionByName, parts)
        parts.append(settle(many(taken).join(many(known.withColumnRenamed("id", "up")), "up", "left").select("id", F.coalesce("begin", "up").alias("begin")), "begins"))
        if len(parts) > PARTS:
            parts = [settle(reduce(DataFrame.unionByName, parts), "begins")]
    return reduce(DataFrame.unionByName, parts)


def _few(pairs: DataFrame) -> DataFrame:
    """At most SHORTCUTS of the pairs on from each src, and of those to each dst: the one of the least hash in each class of the other end."""
    on = F.col("way") == "on"
    own, other = F.when(on, F.col("src")).otherwise(F.col("dst")), F.when(on, F.col("dst")).otherwise(F.col("src"))
    kind = F.pmod(F.xxhash64(other), F.lit(SHORTCUTS)).alias("class")
    least = pairs.filter("src <> dst").groupBy("way", own.alias("own"), kind).agg(F.min_by(F.struct("src", "dst"), F.xxhash64("src", "dst")).alias("pair"))
    return settle(least.select("way", "pair.src", "pair.dst"), "shortcuts")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Shortcuts of twice the length."""
    onward = jumps.select("way", F.col("src").alias("dst"), F.col("dst").alias("to"))
    return _few(jumps.join(onward, ["way", "dst"]).select("way", "src", F.col("to").alias("dst")))


#: Levels that spread puts into one job, and words of 64 sources that one of its rows holds at most.
LEVELS, WIDE = 1, 16


def spread(adjacency: DataFrame, marks: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, node) of all nodes within depth steps of a node that keys mark, those nodes too.  Many sources are searched at once.

    Each distinct keys is a source with a number, and a row (node, block) holds 64 * WIDE sources as bits: those that have come to the node, and
    those that came last.  A level takes only the rows to which something came last along their edges, and puts the bits that meet together, and what
    was there, by bit_or.  So the work of a level follows from nodes and edges, not from the number of sources.  Edges are written once; the search
    ends when nothing new comes.  Repeated edges change no bits.
    """
    marks = settle(marks, "marks")
    sources = numbered(marks.select(*keys).distinct(), *keys, name="source")
    n_sources = sources.count()
    words = max(1, min(WIDE, -(-n_sources // 64)))
    at = F.col("source")
    bits = [F.bit_or(F.when(F.pmod(F.floor(at / 64), F.lit(words)) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))) for w in range(words)]
    start = marks.select("node", *keys).join(sources, keys).groupBy("node", F.floor(at / (64 * words)).alias("block")).agg(*[b.alias(f"s{w}") for w, b in enumerate(bits)])
    state = start.select("*", *[F.col(f"s{w}").alias(f"f{w}") for w in range(words)])
    state = settle(state, "spread")
    moves = settle(adjacency.select("src", "dst"), "moves")
    for level in range(1, depth + 1):
        state = _step(state, moves, words)
        if level % LEVELS == 0 and level < depth:
            state = settle(state, "spread")
            if _came(state, words).isEmpty():
                break
    found = [_numbers(f"s{w}", F.col("block") * (64 * words) + 64 * w) for w in range(words)]
    rows = state.select("node", F.explode(F.flatten(F.array(*found))).alias("source"))
    # A row of bits gives up to 64 * WIDE rows here, so the size before says nothing of them: they stay where they are, or are sorted.
    named = rows.join(F.broadcast(sources), "source") if n_sources <= NAMED else many(rows).join(many(sources), "source")
    return named.select(*keys, "node")


def _numbers(word: str, base: Column) -> Column:
    """The sources whose bits a word holds; base is the number of its first."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda bit: F.call_function("getbit", F.col(word), bit) == 1)
    return F.transform(held, lambda bit: base + bit)


def _came(state: DataFrame, words: int) -> DataFrame:
    """The rows to which a source came last."""
    return state.filter(reduce(lambda a, b: a | b, [F.col(f"f{w}") != 0 for w in range(words)]))


def _step(state: DataFrame, moves: DataFrame, words: int) -> DataFrame:
    """One level of spread."""
    fresh = _came(state, words)
    fresh = _sized(fresh, fresh.count()) if LEVELS == 1 else many(fresh)
    zero = F.lit(0).cast("long")
    moved = fresh.withColumnRenamed("node", "src").join(moves, "src").select(F.col("dst").alias("node"), "block", *[zero.alias(f"s{w}") for w in range(words)], *[f"f{w}" for w in range(words)])
    held = state.select("node", "block", *[f"s{w}" for w in range(words)], *[zero.alias(f"f{w}") for w in range(words)])
    out = held.unionByName(moved).groupBy("node", "block").agg(*[F.bit_or(f"{c}{w}").alias(f"{c}{w}") for c in "sf" for w in range(words)])
    return out.select(
        "node", "block", *[F.col(f"s{w}").bitwiseOR(F.col(f"f{w}")).alias(f"s{w}") for w in range(words)],
        *[F.col(f"f{w}").bitwiseAND(F.bitwise_not(F.col(f"s{w}"))).alias(f"f{w}") for w in range(words)],
    )


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, edge_types: list[str] | None = None, node_types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """G1: node types restrict what is returned, not where the search goes; edges to missing nodes are not followed."""
    known = nodes.select("id", "type", "label")
    alive = directed(edges, direction, edge_types).join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    out = reach(alive, seeds, depth).join(known, "id")
    if node_types is not None:
        out = out.filter(F.col("type").isin(node_types))
    return out.select("seed", "id", "type", "label", "depth", "parent")


def callees(edges: DataFrame, seeds: DataFrame, depth: int | None, floor: str = "resolved") -> DataFrame:
    """G3"""
    return reach(directed(confident_calls(edges, floor), "out"), seeds, depth)


def callers(edges: DataFrame, seeds: DataFrame, depth: int | None, floor: str = "resolved") -> DataFrame:
    """G4; without a depth everything that is hit if the seed changes, with the way there."""
    return reach(directed(confident_calls(edges, floor), "in"), seeds, depth)


def impacted(edges: DataFrame, seeds: DataFrame, floor: str = "resolved") -> DataFrame:
    """(seed, id) of everything that is hit if the seed changes, however far away."""
    return reachable(directed(confident_calls(edges, floor), "in"), seeds)


def impact_report(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, floor: str = "resolved") -> DataFrame:
    """For each seed, the number of symbols hit and the distinct files, sorted."""
    hit = impacted(edges, seeds, floor).join(nodes.select("id", "file"), "id", "left")
    return hit.groupBy("seed").agg(F.count("*").alias("n_impacted"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"))


def paths_to(edges: DataFrame, target: DataFrame, max_depth: int = 6, max_paths: int = 20, floor: str = "resolved") -> DataFrame:
    """Simple caller chains root to target: (target, chain), the first by the order of a depth-first search.

    A chain ends where no caller outside it is left, or at the depth bound.  Chains start as those of one node, so a
    target without callers is its own chain.  Arrays compare element by element, which is the order of the search.  Every chain
    begun comes to an end, so the first max_paths of a length hold the beginnings of the first max_paths of all: no more are kept.
    """
    back = settle(directed(confident_calls(edges, floor), "in").distinct(), "adjacency")
    chains = target.select(F.col("id").alias("target"), F.array("id").alias("chain"), F.lit(False).alias("ended")).distinct()
    for _ in range(max_depth):
        step = chains.join(back, ~F.col("ended") & (F.element_at("chain", -1) == F.col("src")), "left").filter(F.col("dst").isNull() | ~F.array_contains("chain", F.col("dst")))
        grown = step.filter("dst is not null").select("target", F.concat("chain", F.array("dst")).alias("chain"), F.lit(False).alias("ended"))
        ends = chains.join(grown.select("target", F.slice("chain", 1, F.size("chain") - 1).alias("chain")).distinct(), ["target", "chain"], "left_anti").withColumn("ended", F.lit(True))
        chains = settle(_first_paths(ends.unionByName(grown), ["target"], "chain", max_paths).drop("rank"), "chains")
        if chains.filter("not ended").isEmpty():
            break
    return _first_paths(chains, ["target"], "chain", max_paths).select("target", "rank", F.reverse("chain").alias("chain"))


def _first_paths(paths: DataFrame, keys: list[str], path: str, limit: int) -> DataFrame:
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(path))).filter(F.col("rank") <= limit)


def lineage_adjacency(calls: DataFrame, df_edges: DataFrame, floor: str = "resolved") -> DataFrame:
    """Calls, writes from function to state, reads from state to function, each pair once."""
    parts = [
        directed(confident_calls(calls, floor), "out"),
        directed(df_edges, "out", ["writes"]),
        directed(df_edges, "in", ["reads"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def find_paths(adjacency: DataFrame, pairs: DataFrame, max_depth: int = 8, max_paths: int = 10) -> DataFrame:
    """Simple paths (source, target, rank, path) of at most max_depth edges, the first by order; a path stops at its target.

    Steps that cannot reach the target any more are not taken: the distance to it is known from a search backwards.  Of the paths begun
    for a pair only the first are kept at each length.  A pair is done if max_paths of its paths come before everything that was
    let go; the others, for which too many beginnings came to nothing, are searched again with more kept.
    """
    pairs = settle(pairs.select("source", "target").distinct(), "pairs")
    adjacency = settle(adjacency.distinct(), "adjacency")
    back = adjacency.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    to = reach(back, pairs.select(F.col("target").alias("id")), max_depth, written=True).select(F.col("seed").alias("target"), F.col("id").alias("node"), F.col("depth").alias("left"))
    to = settle(to.unionByName(pairs.select("target", F.col("target").alias("node"), F.lit(0).alias("left")).distinct()), "distance")
    out, keep = None, 4 * max_paths
    while True:
        done, lost = _search(adjacency, pairs, to, max_depth, keep)
        first = _first_paths(done, ["source", "target"], "path", max_paths)
        if lost is None:
            return first if out is None else out.unionByName(first)
        sure = first.join(lost, ["source", "target"], "left").filter(F.col("lost").isNull() | (F.col("path") < F.col("lost")))
        full = sure.groupBy("source", "target").count().filter(F.col("count") == max_paths).select("source", "target")
        closed = settle(pairs.join(lost, ["source", "target"], "left_anti").unionByName(full.join(lost, ["source", "target"], "left_semi")), "closed")
        part = settle(first.join(closed, ["source", "target"], "left_semi").select("source", "target", "rank", "path"), "found")
        out = part if out is None else out.unionByName(part)
        pairs, keep = settle(pairs.join(closed, ["source", "target"], "left_anti"), "pairs"), 8 * keep
        if pairs.isEmpty():
            return out


def _search(adjacency: DataFrame, pairs: DataFrame, to: DataFrame, max_depth: int, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """Paths (source, target, path) found with at most keep begun for a pair, and the first path let go for each pair, if any was."""
    paths = pairs.select("source", "target", F.array("source").alias("path"))
    done, gone = paths.filter("source = target"), None
    paths = paths.filter("source <> target")
    for step in range(1, max_depth + 1):
        last = paths.select("source", "target", "path", F.element_at("path", -1).alias("src")).join(adjacency, "src").filter(~F.array_contains("path", F.col("dst")))
        near = last.join(to.filter(F.col("left") <= max_depth - step), (last["target"] == to["target"]) & (last["dst"] == to["node"])).select("source", last["target"], F.concat("path", F.array("dst")).alias("path"))
        grown = settle(near.withColumn("rank", F.row_number().over(Window.partitionBy("source", "target").orderBy("path"))).filter(F.col("rank") <= keep + 1), "paths")
        over = grown.filter(F.col("rank") > keep).select("source", "target", "path")
        gone = over if gone is None else gone.unionByName(over)
        paths = grown.filter(F.col("rank") <= keep).drop("rank")
        done = done.unionByName(paths.filter(F.element_at("path", -1) == F.col("target")))
        paths = paths.filter(F.element_at("path", -1) != F.col("target"))
        if paths.isEmpty():
            break
    lost = settle(gone.groupBy("source", "target").agg(F.min("path").alias("lost")), "lost") if gone is not None else None
    return done, None if lost is None or lost.isEmpty() else lost


def why(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, decision): Decisions that a node is decided by, or that affect it; by id or label."""
    found = resolve(nodes, targets)
    decisions = nodes.filter("type = 'Decision'").select(F.col("id").alias("decision"))
    by = edges.filter("type = 'decided_by'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("decision"))
    affects = edges.filter("type = 'affects'").select(F.col("dst_id").alias("id"), F.col("src_id").alias("decision"))
    return found.join(by.unionByName(affects), "id").join(decisions, "decision", "left_semi").select("target", "decision").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Module and Dependency nodes that no edge between existing nodes touches."""
    ids = nodes.select("id")
    alive = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    touched = alive.select(F.col("src_id").alias("id")).unionByName(alive.select(F.col("dst_id").alias("id"))).distinct()
    return nodes.filter(F.col("type").isin("Module", "Dependency")).join(touched, "id", "left_anti")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after removing nodes and every edge at them."""
    g = gone.select("id").distinct()
    left = edges.join(g.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(g.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(g, "id", "left_anti"), left


def accessors(df_edges: DataFrame, kind: str) -> DataFrame:
    """Distinct (state, func) that read or write; kind is reads or writes."""
    return df_edges.filter(F.col("type") == kind).select(F.col("dst_id").alias("state"), F.col("src_id").alias("func")).distinct()


def data_flow(df_edges: DataFrame, calls: DataFrame, states: DataFrame, depth: int = 6, floor: str = "resolved") -> DataFrame:
    """(state, side, func): upstream are writers, downstream are readers, each with its callers."""
    wanted = states.select(F.col("id").alias("state")).distinct()
    sides = [accessors(df_edges, kind).withColumn("side", F.lit(side)) for side, kind in (("upstream", "writes"), ("downstream", "reads"))]
    marks = sides[0].unionByName(sides[1]).join(wanted, "state", "left_semi").withColumnRenamed("func", "node")
    return spread(directed(confident_calls(calls, floor), "in"), marks, ["state", "side"], depth).withColumnRenamed("node", "func")


def flow_impact(df_edges: DataFrame, calls: DataFrame, states: DataFrame, depth: int = 6, floor: str = "resolved") -> DataFrame:
    """Readers, writers and their callers: (state, func)."""
    wanted = states.select(F.col("id").alias("state")).distinct()
    marks = accessors(df_edges, "reads").unionByName(accessors(df_edges, "writes")).join(wanted, "state", "left_semi").withColumnRenamed("func", "node")
    return spread(directed(confident_calls(calls, floor), "in"), marks, ["state"], depth).withColumnRenamed("node", "func")


def endpoint(exec_nodes: DataFrame, df_nodes: DataFrame, anchors: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, id): an anchor's target is looked up instead of its name; a unique symbol comes before a unique state."""
    named = tokens.select("token").distinct().join(anchors.select(F.col("name").alias("token"), F.col("target").alias("anchored")), "token", "left").select("token", F.coalesce("anchored", "token").alias("target"))

    def unique(nodes: DataFrame, out: str) -> DataFrame:
        return resolve(nodes, named).groupBy("target").agg(F.count("*").alias("n"), F.min("id").alias(out)).filter("n = 1").drop("n")

    return named.join(unique(exec_nodes, "e"), "target", "left").join(unique(df_nodes, "s"), "target", "left").select("token", F.coalesce("e", "s").alias("id"))


def lineage(exec_nodes: DataFrame, calls: DataFrame, df_nodes: DataFrame, df_edges: DataFrame, anchors: DataFrame, pairs: DataFrame, max_depth: int = 8, max_paths: int = 10, floor: str = "resolved") -> DataFrame:
    """Steps (source, target, rank, step, id, type, label, file) of the paths between named ends."""
    ends = endpoint(exec_nodes, df_nodes, anchors, pairs.select(F.col("source").alias("token")).unionByName(pairs.select(F.col("target").alias("token"))))
    ends = settle(ends, "ends")
    known = pairs.join(ends.select(F.col("token").alias("source"), F.col("id").alias("s")), "source").join(ends.select(F.col("token").alias("target"), F.col("id").alias("t")), "target").filter("s is not null and t is not null")
    paths = find_paths(lineage_adjacency(calls, df_edges, floor), known.select(F.col("s").alias("source"), F.col("t").alias("target")), max_depth, max_paths)
    steps = paths.select("source", "target", "rank", F.posexplode("path").alias("step", "id"))
    both = exec_nodes.select("id", "type", "label", "file").unionByName(df_nodes.select("id", F.col("kind").alias("type"), "label", "file"))
    return brief(steps, both)
