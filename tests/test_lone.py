"""Nodes that only one node leads to are laid aside before the rounds, however long their chains are."""

import random

import pytest

from skeinwork.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string").repartition(3)


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def plain(pairs, seed):
    """All that is reached, by a plain search."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    out, front = {seed}, [seed]
    while front:
        front = [b for a in front for b in after.get(a, ()) if b not in out and not out.add(b)]
    return out - {seed}


def both_ways(spark, pairs, seeds):
    got = [(r.seed, r.id) for r in graph.reachable(edges_of(spark, pairs), ids_of(spark, seeds)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(s, n) for s in seeds for n in plain(pairs, s)}


@pytest.fixture
def made(monkeypatch):
    monkeypatch.setattr(graph, "NAMED", 12)
    monkeypatch.setattr(graph, "ONE_OF", 1, raising=False)
    tables, real = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="step": tables.append((name, real(df, name))) or tables[-1][1])
    return tables


def test_chains_and_trees_take_no_shortcuts_and_little_work(spark, made):
    n = 200
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(n)] + [(f"c{k}", f"leaf{k}_{j}") for k in range(n) for j in range(4)] + [("c7", "leaf7_0"), ("leaf9_1", "twig"), ("d0", "d1")]
    both_ways(spark, pairs, ["c0", "d0", "c150", "gone"])
    assert not [1 for name, _ in made if name == "shortcuts"]
    # A quarter of the chain is laid aside in each round, so all rounds together write a few times its nodes, not its nodes for each doubling.
    assert sum(df.count() for name, df in made if name == "pairs") <= 5 * n
    assert max(df.count() for name, df in made if name == "found") <= 10


def test_chains_between_other_nodes(spark, made):
    # Two ways to m, a chain from there back to a, one that ends in leaves with two ways to them, a circle that nothing leads to and what hangs on it.
    pairs = [("a", "b0"), ("a", "e0"), ("m", "x0"), ("x29", "a"), ("b9", "m"), ("e9", "m"), ("r0", "r0"), ("r0", "a")]
    pairs += [(f"{c}{k}", f"{c}{k + 1}") for c, n in (("b", 9), ("e", 9), ("x", 29), ("y", 20), ("o", 11)) for k in range(n)]
    pairs += [("x5", "y0"), ("y20", "z1"), ("y19", "z1"), ("y20", "z2"), ("x1", "z2"), ("o11", "o0"), ("o3", "p0"), ("p0", "p1"), ("b2", "b2")]
    both_ways(spark, pairs, ["a", "x3", "y20", "z1", "r0"])
    assert any(name == "ends" for name, _ in made)
    both_ways(spark, pairs, ["o5"])


def test_edges_stay_where_most_nodes_are_led_to_by_several(spark, made):
    both_ways(spark, [(f"n{k}", f"n{k + d}") for k in range(12) for d in (1, 2)] + [("n0", "n1"), ("n12", "c0"), ("c0", "c1")], ["n0", "c0"])
    assert not [1 for name, _ in made if name == "ends"]


def test_random_forests_and_graphs(spark, made):
    for seed in range(2):
        rng = random.Random(seed)
        pairs = {(f"n{rng.randrange(k) if rng.random() < 0.4 else k - 1}", f"n{k}") for k in range(1, 90)}  # each node has one node before it
        pairs |= {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range((4, 40)[seed])}
        both_ways(spark, pairs, ["n0", "n1", f"n{rng.randrange(90)}"])


def test_edges_without_an_end_lead_nowhere(spark, made):
    edges = edges_of(spark, [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c3", None), (None, "c5"), (None, None)])
    assert {r.id for r in graph.reachable(edges, ids_of(spark, ["c0"])).collect()} == {f"c{k}" for k in range(1, 13)}
