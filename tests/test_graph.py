"""Deep and many-seeded searches against plain searches."""

import random

from skeinwork.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string").repartition(3)


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def plain(pairs, seed, depth=None):
    """The depth of each node that is reached."""
    out, level, front = {seed: 0}, 0, {seed}
    while front and (depth is None or level < depth):
        level += 1
        front = {b for a, b in pairs if a in front} - out.keys()
        out |= dict.fromkeys(front, level)
    return out


def settles(monkeypatch):
    made, real = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="step": made.append((name, df)) or real(df, name))
    return made


def test_reachable_on_cyclic_graphs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        names = [f"n{k}" for k in range(60)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range((50, 70, 90, 200)[seed])} | {(names[k], names[k + 1]) for k in range(20, 58)}
        seeds = ["n0", "n20", "n33", "gone"]
        got = {(r.seed, r.id) for r in graph.reachable(edges_of(spark, list(pairs)), ids_of(spark, seeds)).collect()}
        assert got == {(s, n) for s in seeds for n in plain(pairs, s) if n != s}


def test_a_chain_takes_few_rounds_and_a_plan_of_one_size(spark, monkeypatch):
    made = settles(monkeypatch)
    n = 4096
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(n)]
    got = graph.reachable(edges_of(spark, pairs), ids_of(spark, ["c0"]))
    assert got.count() == n
    rounds = [df for name, df in made if name == "found"][1:]
    assert len(rounds) <= 15
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation") for df in rounds]
    assert max(scans[-5:]) == scans[4] <= 6
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_branches_do_not_slow_a_chain(spark, monkeypatch):
    made = settles(monkeypatch)
    n = 500
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(n)] + [(f"c{k}", f"leaf{k}_{j}") for k in range(n) for j in range(8)] + [(f"leaf{k}_0", f"twig{k}") for k in range(n)]
    assert graph.reachable(edges_of(spark, pairs), ids_of(spark, ["c0"])).count() == len(pairs)
    assert len([1 for name, _ in made if name == "found"]) - 1 <= 12
    made.clear()
    back = [(b, a) for a, b in pairs]
    assert graph.reachable(edges_of(spark, back), ids_of(spark, [f"c{n}", "twig9"])).count() == n + 11
    assert len([1 for name, _ in made if name == "found"]) - 1 <= 12


def test_leaves_take_no_part_in_the_rounds(spark, monkeypatch):
    made = settles(monkeypatch)
    n = 200
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(n)] + [(f"c{k}", f"leaf{k}_{j}") for k in range(n) for j in range(9)] + [("d0", "d1"), ("leaf0_0", "twig")]
    got = graph.reachable(edges_of(spark, pairs), ids_of(spark, ["c0", "d0", "twig"]))
    assert {(r.seed, r.id) for r in got.collect()} == {(s, i) for s in ("c0", "d0", "twig") for i in plain(pairs, s) if i != s}
    assert max(df.count() for name, df in made if name in ("found", "shortcuts")) <= 3 * n


def test_shortcuts_stay_few(spark, monkeypatch):
    made = settles(monkeypatch)
    pairs = [(f"x{k}", f"x{k + d}") for k in range(120) for d in (1, 2, 3, 5, 7, 11)] + [(f"x{k}", "hub") for k in range(120)] + [("hub", f"y{k}") for k in range(300)]
    got = graph.reachable(edges_of(spark, pairs), ids_of(spark, ["x0"]))
    assert {r.id for r in got.collect()} == plain(pairs, "x0").keys() - {"x0"}
    for name, df in made:
        if name == "shortcuts":
            assert df.filter("way = 'on'").groupBy("src").count().filter(f"count > {graph.SHORTCUTS}").isEmpty()
            assert df.filter("way = 'to'").groupBy("dst").count().filter(f"count > {graph.SHORTCUTS}").isEmpty()


def test_level_search_puts_parts_together(spark, monkeypatch):
    made = settles(monkeypatch)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(24)]
    got = {r.id: (r.depth, r.parent) for r in graph.reach(edges_of(spark, pairs), ids_of(spark, ["c0"])).collect()}
    assert got == {f"c{k}": (k, f"c{k - 1}") for k in range(1, 25)}
    levels = [df for name, df in made if name == "level"]
    assert max(df._jdf.queryExecution().optimizedPlan().toString().count("Relation") for df in levels) <= 8


def test_spread_is_the_level_search_of_each_source(spark, monkeypatch):
    for wide, levels in ((16, 3), (1, 2), (2, 1)):
        monkeypatch.setattr(graph, "WIDE", wide)
        monkeypatch.setattr(graph, "LEVELS", levels)
        rng = random.Random(wide)
        names = [f"n{k}" for k in range(80)]
        pairs = list({(rng.choice(names), rng.choice(names)) for _ in range(120)})
        marks = sorted({(f"s{rng.randrange(150)}", rng.choice("ab"), rng.choice(names)) for _ in range(400)})
        for depth in (0, 4):
            got = graph.spread(edges_of(spark, pairs), spark.createDataFrame(marks, "state string, side string, node string"), ["state", "side"], depth)
            want = {(s, d, n) for s, d, m in marks for n in plain(pairs, m, depth)}
            rows = [tuple(r) for r in got.select("state", "side", "node").collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want


def test_spread_holds_many_sources_in_a_row(spark, monkeypatch):
    rows = []
    real = graph._step
    monkeypatch.setattr(graph, "_step", lambda state, moves, words: rows.append(real(state, moves, words)) or rows[-1])
    pairs = [("f", "g"), ("g", "h")]
    marks = spark.createDataFrame([(f"s{k}", "f") for k in range(1000)], "state string, node string")
    assert graph.spread(edges_of(spark, pairs), marks, ["state"], 2).count() == 3000
    assert [r.count() for r in rows] == [2, 3]


def test_spread_of_nothing(spark):
    none = spark.createDataFrame([], "state string, node string")
    assert graph.spread(edges_of(spark, [("a", "b")]), none, ["state"], 3).count() == 0
    lone = spark.createDataFrame([("s", "z")], "state string, node string")
    assert [tuple(r) for r in graph.spread(edges_of(spark, []), lone, ["state"], 3).collect()] == [("s", "z")]
