"""The flow search reads its edges once and has none of its own."""

from skeinwork.operators import graph


def counted(monkeypatch):
    made = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="step": made.append((name, settle(df, name))) or made[-1][1])
    return made


def test_spread_carries_what_was_there_without_edges_of_its_own(spark, monkeypatch):
    made = counted(monkeypatch)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    marks = spark.createDataFrame([("s", "a"), ("t", "b"), ("t", "x")], "state string, node string")
    got = graph.spread(edges, marks, ["state"], 6)
    assert sorted(map(tuple, got.select("state", "node").collect())) == [("s", "a"), ("s", "b"), ("s", "c"), ("t", "b"), ("t", "c"), ("t", "x")]
    moves = next(df for name, df in made if name == "moves")
    assert moves.columns == ["src", "dst"] and moves.filter("src = dst").count() == 0
    # The start, two levels that bring something new and one that does not; then the search ends.
    assert sum(name == "spread" for name, _ in made) == 4
