"""The path search writes its edges once."""

from skeinwork.operators import graph


def counted(monkeypatch):
    made = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="step": made.append((name, settle(df, name))) or made[-1][1])
    return made


def test_path_search_writes_its_edges_once(spark, monkeypatch):
    made = counted(monkeypatch)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    got = graph.find_paths(edges, spark.createDataFrame([("a", "c")], "source string, target string"), 4)
    assert sorted((r["rank"], r.path) for r in got.collect()) == [(1, ["a", "b", "c"]), (2, ["a", "c"])]
    assert sum(name == "adjacency" for name, _ in made) == 1
