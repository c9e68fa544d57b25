"""Syncs from a state against syncs of everything."""

import random

from skeinwork.plans import sync
from skeinwork.sources.files import scanned
from skeinwork.sources.store import Store


def scan_of(spark, files):
    return scanned(spark.createDataFrame([(p, s.encode()) for p, s in sorted(files.items())], "path string, content binary"))


def source(rng, k, n):
    """A file that defines a class and functions and refers to those of others by several ways."""
    other = rng.randrange(n)
    name = rng.choice([f"K{k}", f"K{k}", f"K{k % 7}"])
    lines = [
        rng.choice([f"from p{other % 4}.m{other} import f{other}, K{other} as T", f"import p{other % 4}.m{other} as T", f"from m{other} import f{other}", ""]),
        f"class {name}({rng.choice([f'K{other}', 'T', 'object'])}):",
        f"    def go(self, x: K{other}):",
        "        self.n = x.n",
        f"        return self.{rng.choice(['go', 'stop'])}() or f{rng.choice([k, other])}()",
        f"def f{rng.choice([k, k, k % 5])}():",
        f"    t = K{rng.randrange(n)}()",
        "    t.size = 1",
        f"    return T.f{other}()",
        f"f{k}()",
    ]
    return "\n".join(lines) + "\n"


def tables(state):
    return {n: sorted(map(repr, df.collect())) for n, df in sync.graphs(state).items()}


def test_delta_is_the_full_sync(spark):
    rng = random.Random(2)
    n = 40
    files = {f"p{k % 4}/m{k}.py": source(rng, k, n) for k in range(n)} | {f"p{k}/__init__.py": "" for k in range(3)} | {"web/x.js": "import a from 'b'"}
    state, _ = sync.synced(scan_of(spark, files))
    for _ in range(2):
        paths = sorted(p for p in files if p.startswith("p"))
        for p in rng.sample(paths, 4):
            files[p] = source(rng, rng.randrange(n), n)
        for p in rng.sample(paths, 2):
            files.pop(p)
        files[f"q/m{rng.randrange(n)}.py"] = source(rng, rng.randrange(n), n)
        files["p1/m1.py"] = "def ("
        scan = scan_of(spark, files)
        state, counts = sync.synced(scan, state)
        full, _ = sync.synced(scan)
        assert tables(state) == tables(full)
        for t in sync.TABLES:
            cols = [c for c in full[t].columns if c != "call"]
            assert sorted(map(repr, state[t].select(*cols).collect())) == sorted(map(repr, full[t].select(*cols).collect())), t
        assert counts.first().again < counts.first().references


def test_few_edits_resolve_few_references(spark):
    n = 300
    text = lambda k, more="": f"from p.m{k - 1} import f{k - 1}\nclass K{k}(K{k - 1}):\n    def go(self, x: K{k - 1}):\n        return x.n\ndef f{k}():\n    return f{k - 1}()\n{more}"
    files = {f"p/m{k}.py": text(k) for k in range(n)}
    state, counts = sync.synced(scan_of(spark, files))
    assert counts.first().asDict() == {"files": n, "parsed": n, "removed": 0, "resolved": n, "references": counts.first().references, "again": counts.first().references}
    for k in (10, 150, 151):
        files[f"p/m{k}.py"] = text(k, f"def extra{k}():\n    return f{k}()\nclass K{k}b:\n    pass\n")
    state, counts = sync.synced(scan_of(spark, files), state)
    c = counts.first()
    assert (c.parsed, c.removed) == (3, 0) and c.again < 0.05 * c.references
    _, counts = sync.synced(scan_of(spark, files), state)
    assert (counts.first().parsed, counts.first().resolved, counts.first().again) == (0, 0, 0)
    files["p/m20.py"] = text(20).replace("f20", "g20")  # a name that another file calls
    state, counts = sync.synced(scan_of(spark, files), state)
    assert {r.path for r in state["calls"].filter("callee is null").select("path").distinct().collect()} >= {"p/m21.py"}
    assert (counts.first().parsed, counts.first().resolved) == (1, 2)


def test_store_follows(spark, tmp_path):
    store, kept = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "k"))
    files = {"a/x.py": "def f():\n    return g()\ndef g():\n    pass\n", "a/y.py": "from a.x import g\ndef h():\n    g()\n"}
    sync.sync_into(store, kept, scan_of(spark, files))
    calls = lambda: sorted((r.src_id, r.dst_id) for r in store.scan("exec_edges").filter("type = 'calls'").collect())
    assert calls() == [("func:a/x.py#f", "func:a/x.py#g"), ("func:a/y.py#h", "func:a/x.py#g")]
    files["a/x.py"] = "def f():\n    pass\n"
    counts = sync.sync_into(store, kept, scan_of(spark, files)).first()
    assert calls() == [] and (counts.parsed, counts.resolved) == (1, 2)
    del files["a/y.py"]
    assert sync.sync_into(store, kept, scan_of(spark, files)).first().removed == 1
    assert [r.id for r in store.scan("exec_nodes").collect()] == ["func:a/x.py#f"]
