"""Steps that must not grow into one task or the driver."""

from pyspark.sql import functions as F

from skeinwork.operators import extract, graph, ownership, records
from skeinwork.plans import ingest
from skeinwork.sources import text
from skeinwork.tables import dealt


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbors_do_not_send_the_nodes_to_every_task(spark):
    nodes = spark.range(50).selectExpr("concat('n', id) AS id")
    edges = spark.createDataFrame([("n1", "n2", "a"), ("n3", "n1", "b"), ("n1", "n99", "a"), ("n2", "n3", "a"), ("n1", "n2", "a")], "src_id string, dst_id string, type string")
    got = graph.neighbors(edges, nodes, spark.createDataFrame([("n1",), ("n1",), ("n7",)], "id string"), direction="both")
    assert "Broadcast" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [("n1", "a", "n2"), ("n1", "a", "n2"), ("n1", "b", "n3")]


def test_ranks_do_not_bring_a_key_into_one_task(spark):
    rows = [(["a", "b", None][k % 3], k * 37 % 101, f"i{k:03}") for k in range(100)]
    df = spark.createDataFrame(rows, "type string, at long, id string").repartition(5)
    got = records.ranked(df, ["type"], [F.desc("at"), F.col("id")])
    assert "Window" not in plan_of(got)
    want = {}
    for t, at, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(t, []).append(i)
    assert {(r.type, r["rank"], r.id) for r in got.collect()} == {(t, n, i) for t, ids in want.items() for n, i in enumerate(ids, 1)}
    assert records.ranked(df.filter("false"), ["type"], [F.col("id")]).count() == 0


def test_records_of_one_file_are_parsed_by_many_tasks(spark):
    yaml = spark.range(40).coalesce(1).selectExpr("concat(id, '.yaml') AS path", "concat('rules:\n  - match: {path: a', id, '}\n    domain: d\n') AS text")
    assert text.rule_files(yaml).rdd.getNumPartitions() >= 4
    assert text.rule_files(yaml).select("pattern").distinct().count() == 40
    files = spark.range(40).coalesce(1).selectExpr("concat('m', id, '.py') AS path", "'python' AS language", "concat('def f', id, '(): pass') AS source")
    assert ingest.ingest_symbols(files)["facts"].count() == 40
    assert extract.python_facts(dealt(files)).rdd.getNumPartitions() >= 4
    rules = spark.range(40).coalesce(1).selectExpr("id AS ordinal", "'name' AS kind", "concat('x', id) AS pattern")
    assert ownership.rules_of(rules).rdd.getNumPartitions() >= 4
