"""Small cases with known results: memory, ledgers, routing, ownership, context, proposals, store."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import scalars as C
from skeinwork.operators import graph, ledger, ownership, records
from skeinwork.plans import context, ingest, memory
from skeinwork.sources import files, store, text
from skeinwork.sources.bundles import is_safe_member
from skeinwork.sources.store import Conflict, Store

T0 = dt.datetime(2026, 1, 1)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def mem(spark, *given):
    base = {"id": "m", "scope": "project", "kind": "fact", "content": "x", "created_at": T0, "last_accessed_at": T0, "access_count": 0, "salience": 1.0, "ttl_seconds": None, "status": "active", "links": []}
    schema = "id string, scope string, kind string, content string, created_at timestamp, last_accessed_at timestamp, access_count bigint, salience double, ttl_seconds bigint, status string, links array<string>"
    return spark.createDataFrame([tuple((base | g).values()) for g in given], schema)


def test_ttl_is_strict_and_scope_decides(spark):
    m = mem(spark, {"id": "a", "scope": "session", "ttl_seconds": 10}, {"id": "b", "ttl_seconds": 10}, {"id": "c", "ttl_seconds": 20})
    got = dict(rows(memory.gc_actions(m, F.lit(T0 + dt.timedelta(seconds=20))), "id", "action"))
    assert got == {"a": "delete", "b": "archive", "c": "decay"}


def test_salience_halves_in_two_weeks(spark):
    m = mem(spark, {"id": "a"})
    out = memory.gc_actions(m, F.lit(T0 + dt.timedelta(days=14)))
    assert rows(out, "action", "salience") == [("decay", 0.5)]


def test_promotion_and_consolidation(spark):
    m = mem(spark, {"id": "s", "scope": "session", "access_count": 3}, {"id": "p1"}, {"id": "p2"}, {"id": "u", "scope": "user"}, {"id": "l", "scope": "learning"})
    assert rows(memory.promotions(m), "subject", "reuse_value", "status") == [("s", "medium", "proposed")]
    assert rows(memory.consolidations(m), "subject") == [("p1,p2",)]


def test_dedup_on_add(spark):
    here = mem(spark, {"id": "old"})
    new = mem(spark, {"id": "same"}, {"id": "other", "scope": "user"}, {"id": "other2", "scope": "user"})
    assert rows(memory.added(here, new), "id") == [("other",)]
    assert len(rows(memory.added(here, new, dedup=False))) == 3


def test_token_report(spark):
    e = spark.createDataFrame([("p", 20, None, 100), ("p", 10, None, 100)], "provider string, tokens_estimated bigint, tokens_actual bigint, tokens_raw_equiv bigint")
    e = e.withColumn("tokens_saved", C.tokens_saved("tokens_raw_equiv", "tokens_actual", "tokens_estimated"))
    assert rows(ledger.token_report(e), "tokens_saved", "tokens_compressed", "ratio") == [(170, 30, 0.15)]
    assert rows(ledger.token_report(e.filter("false")), "events", "ratio") == [(0, 1.0)]


def test_scorecard(spark):
    calls = spark.createDataFrame([(1, "p", "m", 10.0, True, None), (2, "p", "m", 30.0, True, None), (3, "p", "m", 5.0, False, "Timeout")], "seq bigint, provider string, model string, latency_ms double, ok boolean, error string").withColumn("tokens_in", F.lit(1)).withColumn("tokens_out", F.lit(1))
    stats = ledger.provider_stats(calls)
    assert stats.first()["error_breakdown"] == {"Timeout": 1}
    assert rows(ledger.scorecards(stats), "avg_latency_ms", "p95_latency_ms", "success_rate") == [(15.0, 30.0, 0.6667)]


@pytest.mark.parametrize(("policy", "first"), [("pinned", "claude"), ("cheapest", "ollama"), ("most_reliable", "ollama")])
def test_router(spark, policy, first):
    roll = spark.createDataFrame([("claude", 1.0, 5.0, 0.9), ("ollama", 0.0, 9.0, 0.9)], "provider string, cost_per_call double, avg_latency_ms double, success_rate double")
    names = roll.select(F.col("provider").alias("name"))
    assert rows(ledger.route(names, roll, policy, "claude").filter("rank = 1"), "name") == [(first,)]
    assert rows(ledger.route(names, roll.filter("false"), policy, "claude").filter("rank = 1"), "name") == [("claude",)]


def test_greedy_packing_goes_on_after_a_drop(spark):
    items = spark.createDataFrame([("b", f"r{k}", "stub", n, n, 9, k) for k, n in enumerate([4, 7, 3, 9, 2])], "bundle string, ref string, kind string, tokens bigint, raw_tokens bigint, tier int, order int")
    got = context.packed(items, 9)
    assert [r for (r,) in rows(got.filter("included"), "ref")] == ["r0", "r2", "r4"]
    assert rows(context.bundle_totals(got), "used", "raw_equiv", "dropped") == [(9, 25, 2)]


def test_ownership_declared_and_observed(spark):
    nodes = spark.createDataFrame([("run", "function", "run", "strat.py"), ("broker", "function", "place_order", "exec.py")], "id string, type string, label string, file string")
    calls = spark.createDataFrame([("run", "broker", "calls", "resolved")], "src_id string, dst_id string, type string, confidence string")
    rules = ownership.rule_table(spark, [{"kind": "path", "pattern": "exec.py", "domain": "Execution"}, {"kind": "path", "pattern": "strat.py", "domain": "Strategy"}])
    got = {r["symbol"]: r for r in ownership.classify(nodes, calls, rules).collect()}
    assert (got["broker"]["declared_owner"], got["broker"]["observed_owner"], got["broker"]["agreement"]) == ("Execution", "Strategy", False)
    assert got["run"]["observed_owner"] == "Unknown"


def test_cycle_search_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(rows(graph.reach(e, start), "id", "depth", "parent")) == [("b", 1, "a"), ("c", 2, "b"), ("d", 2, "b")]
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a")], "source string, target string")
    got = sorted(rows(graph.find_paths(e, pairs, 5), "source", "path"))
    assert got == [("a", ["a"]), ("a", ["a", "b", "d"])]


def test_paths_to_without_callers(spark):
    e = spark.createDataFrame([("a", "b", "calls", "exact"), ("b", "c", "calls", "exact")], "src_id string, dst_id string, type string, confidence string")
    t = spark.createDataFrame([("c",), ("a",)], "id string")
    assert sorted(rows(graph.paths_to(e, t), "target", "chain")) == [("a", ["a"]), ("c", ["a", "b", "c"])]


def test_learning_state_machine(spark):
    p = memory.proposed(spark.createDataFrame([("1", "k", '{"name": "S"}')], "key string, kind string, payload string"))
    pid = p.first()["id"]
    act = lambda a: spark.createDataFrame([(pid, a, "me", "", "now")], "id string, action string, actor string, note string, at string")
    refused = memory.decided(p, act("commit"))
    assert rows(refused, "status", "error") == [("proposed", "cannot commit a proposal in status proposed")]
    approved = memory.decided(p, act("approve")).drop("error", "done")
    done = memory.decided(approved, act("commit"))
    assert rows(done, "status", F.size("provenance")) == [("committed", 2)]
    assert rows(memory.skills(done), "type", "label") == [("Skill", "S")]


def test_findings(spark):
    f = spark.createDataFrame([("a", "x", "low", 0.5, 0), ("a", "y", "high", 0.1, 1), ("b", "x", "med", 0.9, 2), ("a", "x", "high", 0.9, 3)], "agent string, claim string, severity string, confidence double, arrival int")
    assert [r[2] for r in rows(ledger.merge_findings(f))] == ["high", "med", "low"]
    bad = spark.createDataFrame([("a", "nonsense"), ("b", '[{"claim": "c"}]')], "agent string, text string")
    assert rows(ingest.parsed_findings(bad), "agent", "claim", "severity") == [("b", "c", "low")]


def test_rounding_ties_to_even(spark):
    got = spark.range(1).select(*[C.half_even(F.lit(x), 2) for x in (0.125, 2.675, 0.545)]).first()
    assert tuple(got) == (0.12, 2.68, 0.55)


def test_config_layers():
    got = text.layered_config({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}, env={"SKEINWORK_A__B": "true", "OTHER": "x"})
    assert got == {"a": {"b": True, "c": 3}}


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.replace("df_nodes", spark.createDataFrame([("a", "attr", "x", "f", T0)], "id string, kind string, label string, file string, created_at timestamp"), 0)
    s.upsert("df_nodes", spark.createDataFrame([("a", "attr", "y", "f", T0), ("b", "attr", "z", "f", T0)], s.scan("df_nodes").schema))
    assert sorted(rows(s.scan("df_nodes"), "id", "label")) == [("a", "y"), ("b", "z")]
    assert s.reconcile("df_nodes", s.get("df_nodes", "b")) == {"added": 0, "removed": 1, "kept": 1}
    assert s.migrate() == 1 and s.collections() == ["df_nodes"]
    s.export_bundle(str(tmp_path / "x.tgz"))
    t = Store(spark, str(tmp_path / "t"))
    t.import_bundle(str(tmp_path / "x.tgz"))
    assert rows(t.scan("df_nodes"), "id") == [("b",)]
    assert len(s.backup(str(tmp_path / "b"), 1)) == 1
    assert is_safe_member("snapshots/a") and not is_safe_member("snapshots/../a")


def test_store_refuses_a_second_writer(spark, tmp_path, monkeypatch):
    s, row = Store(spark, str(tmp_path / "s")), "id string, kind string, label string, file string, created_at timestamp"
    s.replace("df_nodes", spark.createDataFrame([("a", "attr", "x", "f", T0)], row), 0)
    base, version = s._head("df_nodes")
    assert s._publish("df_nodes", base, version) == base + 1
    with pytest.raises(Conflict):
        s._publish("df_nodes", base, "other")
    assert s._head("df_nodes") == (base + 1, version)
    # A writer that failed leaves an empty entry: readers pass it over, and writers too after a while.
    s.fs.create(s.fs_path(f"{s.root}/df_nodes/log/{base + 2:020d}"), False).close()
    assert s._head("df_nodes") == (base + 1, version)
    with pytest.raises(Conflict):
        s._publish("df_nodes", base + 1, version)
    monkeypatch.setattr(store, "ABANDONED", -60)
    assert s._publish("df_nodes", base + 1, version) == base + 3
    for k in range(4):
        s.overwrite("df_nodes", spark.createDataFrame([(f"b{k}", "attr", "x", "f", T0)], row))
    assert rows(s.scan("df_nodes"), "id") == [("b3",)]


def test_an_update_is_not_lost(spark, tmp_path):
    row = "id string, kind string, label string, file string, created_at timestamp"
    record = lambda k: spark.createDataFrame([(k, "attr", k, "f", T0)], row)
    s, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    s.replace("df_nodes", record("a"), 0)
    mine, base = s.read("df_nodes")
    made = store.upserted(mine, record("x"))
    other.upsert("df_nodes", record("y"))
    with pytest.raises(Conflict):
        s.replace("df_nodes", made, base)
    assert sorted(rows(s.scan("df_nodes"), "id")) == [("a",), ("y",)]
    with pytest.raises(Conflict):
        s.replace("df_nodes", made, 0)
    # What was read first can still be read, and a change is made anew from what another has written meanwhile.
    assert rows(mine, "id") == [("a",)]
    tried = []

    def slow(old):
        if not tried:
            other.upsert("df_nodes", record("z"))
        tried.append(1)
        return store.upserted(old, record("x"))

    s.change("df_nodes", slow)
    assert sorted(rows(s.scan("df_nodes"), "id")) == [("a",), ("x",), ("y",), ("z",)] and len(tried) == 2
    assert len(s._names(f"{s.root}/df_nodes", folders=True)) == 1 + 4  # the log, and no folder of a refused version


def test_old_versions_go_in_time_and_clearing_is_a_version(spark, tmp_path):
    row = "id string, kind string, label string, file string, created_at timestamp"
    s = Store(spark, str(tmp_path / "s"), kept=-60)
    for k in range(4):
        s.overwrite("df_nodes", spark.createDataFrame([(f"b{k}", "attr", "x", "f", T0)], row))
    assert rows(s.scan("df_nodes"), "id") == [("b3",)] and len(s._names(f"{s.root}/df_nodes", folders=True)) == 2
    number = s.read("df_nodes")[1]
    assert s.migrate({}, 1) == 1
    s.clear()
    assert s.collections() == [] and s.read("df_nodes")[1] == number + 1 and s.scan("df_nodes").count() == 0 and s.schema_version() == 1
    with pytest.raises(Conflict):
        s.replace("df_nodes", spark.createDataFrame([], row), number)
    s.upsert("df_nodes", spark.createDataFrame([("c", "attr", "x", "f", T0)], row))
    assert rows(s.scan("df_nodes"), "id") == [("c",)]


def test_upsert_leaves_one_record_for_each_key(spark):
    from skeinwork.sources.store import upserted

    schema = "id string, label string, seq int"
    new = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("b", "only", 1)], schema)
    got = upserted(spark.createDataFrame([("a", "old", 0), ("c", "old", 0)], schema), new, order=["seq"])
    assert sorted(rows(got, "id", "label")) == [("a", "last"), ("b", "only"), ("c", "old")]


def test_snapshots_win_and_empty_ones_go(spark, tmp_path):
    s, row = Store(spark, str(tmp_path / "s")), "id string, kind string, label string, file string, created_at timestamp"
    s.replace("df_nodes", spark.createDataFrame([("a", "attr", "x", "f", T0)], row), 0)
    s.write_snapshots(str(tmp_path / "snap"))
    s.delete("df_nodes", s.scan("df_nodes"))
    assert s.scan("df_nodes").count() == 0 and s.rebuild(str(tmp_path / "snap")) == ["df_nodes"] and rows(s.scan("df_nodes"), "id") == [("a",)]
    s.delete("df_nodes", s.scan("df_nodes"))
    s.write_snapshots(str(tmp_path / "snap"))
    assert s.rebuild(str(tmp_path / "snap")) == []


def test_migrations_run_once_and_forward(spark, tmp_path):
    s, ran = Store(spark, str(tmp_path / "s")), []
    steps = {k: lambda _, k=k: ran.append(k) for k in (1, 2, 3)}
    assert s.migrate(steps, 2) == 2 and s.migrate(steps, 3) == 3 and s.migrate(steps, 3) == 3 and ran == [1, 2, 3]
    with pytest.raises(ValueError):
        s.migrate(steps, 1)


def test_edge_insert_refuses(spark):
    n = spark.createDataFrame([("m", "Module"), ("f", "File"), ("g", "File")], "id string, type string")
    schema = "src_id string, dst_id string, type string"
    e = spark.createDataFrame([("m", "f", "contains")], schema)
    new = spark.createDataFrame([("m", "f", "contains"), ("m", "g", "contains"), ("f", "g", "contains"), ("m", "none", "contains"), ("none", "f", "contains")], schema)
    after, refused = records.inserted_edges(e, new, n)
    assert sorted(rows(after, "src_id", "dst_id")) == [("m", "f"), ("m", "g")]
    assert sorted(rows(refused, "src_id", "dst_id", "reason")) == [("f", "g", "forbidden types"), ("m", "none", "missing target"), ("none", "f", "missing source")]


def test_path_search_ends_on_a_dense_graph(spark):
    rng = random.Random(4)
    ids = [f"n{k:03d}" for k in range(200)]
    adj = spark.createDataFrame([(a, b) for a in ids for b in rng.sample(ids, 40)], "src string, dst string")
    pairs = spark.createDataFrame([("n000", "n199"), ("n001", "n198")], "source string, target string")
    began = time.time()
    got = graph.find_paths(adj, pairs, 6, 10).collect()
    assert len(got) == 20 and all(p.path == q.path or p.path < q.path for p, q in zip(sorted(got, key=lambda r: (r.source, r["rank"])), sorted(got, key=lambda r: (r.source, r.path)), strict=True))
    calls = adj.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("calls").alias("type"), F.lit("exact").alias("confidence"))
    assert graph.paths_to(calls, pairs.select(F.col("target").alias("id")), 6, 20).count() == 40
    assert time.time() - began < 120


def test_first_paths_are_those_of_all_paths(spark):
    rng = random.Random(5)
    for _ in range(3):
        ids = [f"n{k}" for k in range(9)]
        edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(26)})
        out = {}

        def walk(path, out=out, edges=edges):
            if path[-1] == "n8" and len(path) > 1:
                out.setdefault(path[0], []).append(path)
                return
            for a, b in edges:
                if a == path[-1] and b not in path and len(path) <= 7:
                    walk([*path, b])

        for s in ids[:4]:
            walk([s])
        pairs = spark.createDataFrame([(s, "n8") for s in ids[:4]], "source string, target string")
        got = {}
        for r in graph.find_paths(spark.createDataFrame(edges, "src string, dst string"), pairs, 7, 2).collect():
            got.setdefault(r.source, []).append((r["rank"], r.path))
        assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:2] for k, v in out.items()}


def test_repository_scan(spark, tmp_path):
    for p, body in {"pkg/a.py": "import os\n", "pkg/__init__.py": "", "pkg/b.txt": "", "__pycache__/c.py": "", "web/x.JS": "import 'vue'"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(body)
    got = files.read_repository(spark, str(tmp_path))
    assert [r for (r,) in rows(got, "path")] == ["pkg/__init__.py", "pkg/a.py", "web/x.JS"]
    again = ingest.ingest_repository(got, ingest.ingest_repository(got)["index"])
    assert rows(again["result"], "files", "modules", "parsed", "reused", "removed") == [(3, 1, 0, 3, 0)]
    assert rows(files.git_churn(spark, str(tmp_path))) == []


def test_monorepo_dependencies(spark):
    given = [("libs/shared/shared/__init__.py", b""), ("libs/shared/shared/util.py", b"def now_iso():\n    import datetime\n"), ("services/auth/auth/__init__.py", b""), ("services/auth/auth/main.py", b"from shared.util import now_iso\ndef login_event():\n    return now_iso()\n"), ("services/billing/billing/__init__.py", b""), ("services/billing/billing/main.py", b"import shared.util as u\ndef invoice_stamp():\n    return u.now_iso()\n")]
    scan = files.scanned(spark.createDataFrame(given, "path string, content binary"))
    out = ingest.ingest_repository(scan)
    assert rows(out["result"], "files", "modules", "internal", "external") == [(6, 3, 2, 0)]
    calls = ingest.ingest_symbols(scan)["edges"].filter("type = 'calls'")
    assert sorted(r[0] for r in rows(calls, "src_id")) == ["func:services/auth/auth/main.py#login_event", "func:services/billing/billing/main.py#invoice_stamp"]


def test_edge_registry(spark):
    n = spark.createDataFrame([("m", "Module"), ("f", "File"), ("g", "File")], "id string, type string")
    e = spark.createDataFrame([("m", "f", "contains"), ("f", "g", "contains"), ("m", "none", "contains"), ("f", "m", "relates_to")], "src_id string, dst_id string, type string")
    assert sorted(rows(records.checked_edges(e, n), "src_id", "dst_id", "ok")) == [("f", "g", False), ("f", "m", True), ("m", "f", True), ("m", "none", False)]


def test_index_stream(spark, tmp_path):
    from skeinwork.streaming.incremental import index_stream

    schema = "path string, hash string, language string, size bigint, raw_imports array<string>, seq bigint"
    spark.createDataFrame([("a", "1", "python", 1, [], 1), ("a", "2", "python", 1, [], 2)], schema).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination(120)
    assert rows(store.scan("repo_index"), "path", "hash") == [("a", "2")]


def test_advisory_items(spark):
    nodes = spark.createDataFrame(
        [("m", "Module", "auth", 0, "", 1), ("f1", "File", "a.py", 400, "h1", 2), ("f2", "File", "b.py", 40, "h2", 3), ("d1", "Decision", "reach", 0, "", 1), ("d2", "Decision", "new", 0, "", 9), ("d3", "Decision", "old", 0, "", 0), ("a1", "AuditFinding", "audit", 0, "", 5)],
        "id string, type string, label string, size bigint, hash string, created_at bigint",
    )
    edges = spark.createDataFrame([("m", "f1", "contains"), ("m", "f2", "contains"), ("f1", "d1", "decided_by")], "src_id string, dst_id string, type string")
    cards = spark.createDataFrame([("f1", "h1", "card of f1"), ("f2", "stale", "card of f2")], "ref string, source_hash string, purpose string")
    m = mem(spark, {"id": "m1", "content": "note on f2", "links": ["f2"]}, {"id": "m2", "content": "free", "salience": 0.5}, {"id": "m3", "scope": "session"})
    seed = spark.createDataFrame([("m",)], "id string")
    items = context.mentor_items(nodes, edges, cards, m, seed, 2)
    got = [tuple(r) for r in items.orderBy("order").select("ref", "kind", "content").collect()]
    assert got == [("m", "stub", "auth"), ("f1", "card", "card of f1"), ("f2", "memory", "note on f2"), ("d1", "decision", "reach"), ("d2", "decision", "new"), ("d3", "decision", "old"), ("a1", "finding", "audit"), ("m2", "memory", "free")]
    assert rows(items.filter("ref = 'f1'"), "tokens", "raw_tokens") == [(3, 100)]
    audit = context.auditor_items(nodes, edges, cards, m, seed, "fast", "", 2)
    assert [tuple(r) for r in audit.orderBy("order").select("ref", "kind").collect()] == [("acceptance-criteria", "criteria"), ("f1", "card"), ("d1", "decision"), ("d2", "decision"), ("d3", "decision"), ("a1", "finding")]
    kinds = [r[0] for r in context.packed(audit, 8000).orderBy("seq").select("kind").collect()]
    assert kinds == ["card", "criteria", "decision", "decision", "decision", "finding"]


def test_runs_end_with_the_first_good_call(spark):
    good, log = '[{"claim": "c"}]', []
    runs = {  # latency, text, error of each call
        "first": [(1.0, good, None), (1.0, "x", None)],
        "second": [(1.0, "x", None), (30_000.0, " []", None)],
        "late": [(30_001.0, good, None), (None, None, None)],
        "third": [(1.0, None, "E: lost"), (1.0, '{"claim": "c"}', None), (1.0, good, None)],
        "part": [(1.0, '[{"claim": "c"}, {"x": 1}]', None)],
        "mixed": [(99_999.0, good, None), (1.0, good, "E: refused")],
        None: [(1.0, "[null]", None), (2.0, good, None)],
    }
    for agent, calls in runs.items():
        log += [("t", agent, k, *call, k, 1) for k, call in enumerate(calls)]
    df = spark.createDataFrame(log, "task string, agent string, at int, latency_ms double, text string, error string, tokens_in int, tokens_out int").repartition(3)
    got = {r.agent: (r.status, r.error, r.attempts, r.tokens_in) for r in ingest.run_outcomes(df, ["task", "agent"], ["at"]).collect()}
    none, slow = "answer is no list of findings", "provider call timed out"
    assert got == {
        "first": ("ok", None, 1, 0), "second": ("ok", None, 2, 1), "late": ("timeout", slow, 2, None), "third": ("error", none, 2, None),
        "part": ("error", none, 1, None), "mixed": ("error", "E: refused", 2, None), None: ("ok", None, 2, 1),
    }
    more = {r.agent: (r.status, r.attempts) for r in ingest.run_outcomes(df, ["task", "agent"], ["at"], retries=2, timeout=100).collect()}
    assert more["third"] == ("ok", 3) and more["late"] == ("ok", 1)
    ends = ingest.run_outcomes(df, ["task", "agent"], ["at"]).filter("status = 'ok'")
    assert sorted(rows(ingest.parsed_findings(ends, ["task", "agent"]), "agent", "claim", "severity", "confidence"), key=str) == [("first", "c", "low", 0.5), (None, "c", "low", 0.5)]
    assert ingest.run_outcomes(df.filter("false"), ["task", "agent"], ["at"]).count() == 0
