"""Greedy packing over blocks against one walk."""

import random

from skeinwork.plans import context


def plain(items, budget):
    out = {}
    for bundle in {i[0] for i in items}:
        used = 0
        for seq, i in enumerate(sorted((i for i in items if i[0] == bundle), key=lambda i: (i[5], i[6], i[1], i[2], i[3], i[4]))):
            fits = used + i[3] <= budget
            used += i[3] if fits else 0
            out[bundle, seq] = (i[1], i[3], fits, used)
    return out


def frame(spark, items):
    return spark.createDataFrame(items, "bundle string, ref string, kind string, tokens long, raw_tokens long, tier int, order long")


def test_packing_is_one_walk(spark, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", 4)
    for seed, budget in ((0, 50), (1, 0), (2, 400), (3, 10_000)):
        rng = random.Random(seed)
        items = [(rng.choice(["a", "b", "big", "big"]), f"r{rng.randrange(40)}", rng.choice("xy"), rng.choice([0, 0, 1, 3, 8, 20, 60]), rng.randrange(90), rng.randrange(3), rng.randrange(4)) for _ in range(150)]
        items.append(("only", "r", "x", 70, 1, 0, 0))
        rows = context.packed(frame(spark, items), budget).collect()
        assert {(r.bundle, r.seq): (r.ref, r.tokens, r.included, r.used) for r in rows} == plain(items, budget) and len(rows) == len(items)
        assert {r.bundle: r.raw_equiv for r in rows} == {b: sum(i[4] for i in items if i[0] == b) for b in {i[0] for i in items}}


def test_a_large_bundle_is_spread(spark, monkeypatch):
    sizes, real = [], context._greedy
    monkeypatch.setattr(context, "_greedy", lambda tokens, used, budget: sizes.append(len(tokens)) or real(tokens, used, budget))
    n = 50_000
    rows = spark.range(n).selectExpr("'b' bundle", "concat('r', id) ref", "'x' kind", "id % 97 + 1 tokens", "1L raw_tokens", "0 tier", "id `order`")
    got = context.packed(rows, 100_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "head" in plan and "block" in plan
    used, want = 0, 0
    for k in range(n):
        if used + k % 97 + 1 <= 100_000:
            used, want = used + k % 97 + 1, want + 1
    assert (got.filter("included").count(), got.agg({"used": "max"}).first()[0]) == (want, used)
    assert got.select("seq").distinct().count() == n


def test_zero_tokens_ask_for_no_round(spark, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", 2)
    rounds, real = [], context._entered
    monkeypatch.setattr(context, "_entered", lambda *a: rounds.append(1) or real(*a))
    items = [("b", f"r{k:03}", "x", (0, 9)[k % 2], 1, 0, k) for k in range(60)]
    rows = {r.seq: (r.included, r.used) for r in context.packed(frame(spark, items), 20).collect()}
    assert rows == {k: v[2:] for (_, k), v in plain(items, 20).items()} and len(rounds) <= 2


def test_packing_of_nothing(spark):
    assert context.packed(frame(spark, []), 10).collect() == []
