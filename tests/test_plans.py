"""Plans and batches whose size must not follow from how well files compress or how many rows come at once."""

import pyarrow as pa

from skeinwork.operators import extract, graph


def test_the_flow_search_collects_only_source_names(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(50)], "src string, dst string")
    marks = spark.createDataFrame([(f"s{k}", f"n{k}") for k in range(20)], "state string, node string")
    got = graph.spread(edges, marks, ["state"], 4)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # The sources, and the starts of the ranges that number them.
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan
    assert got.count() == 20 * 5


def test_the_flow_search_sorts_many_source_names(spark, monkeypatch):
    monkeypatch.setattr(graph, "NAMED", 3)
    marks = spark.createDataFrame([(f"s{k}", f"n{k}") for k in range(20)], "state string, node string")
    got = graph.spread(spark.createDataFrame([("n0", "n1")], "src string, dst string"), marks, ["state"], 1)
    # The starts of the ranges that number the sources, which are read twice.
    assert got._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 2
    assert got.count() == 21


def test_facts_leave_in_small_batches(spark, monkeypatch):
    sizes = []
    real = pa.Table.from_pylist
    files = pa.RecordBatch.from_pylist([{"path": f"f{k}.py", "source": "import os\n" * 40} for k in range(300)] + [{"path": "none.py", "source": None}, {"path": "bad.py", "source": "def ("}])

    class Sources:
        """Hands the function its batches here, where they can be looked at."""

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([files, files.slice(0, 0)])))

    class Table:
        @staticmethod
        def from_pylist(rows, schema):
            sizes.append(len(rows))
            return real(rows, schema)

    monkeypatch.setattr(extract.pa, "Table", Table)
    out = extract.python_facts(Sources())
    assert sum(b.num_rows for b in out) == 300 * 80
    assert max(sizes) <= extract.ROWS
    assert [r["seq"] for r in out[0].to_pylist()[:80]] == list(range(80))
