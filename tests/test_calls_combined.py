"""Calls are added up in their tasks, and a batch goes through its states once."""

from collections import Counter

from skeinwork.operators import ledger
from skeinwork.sources.store import Store
from skeinwork.streaming import calls
from test_calls import SCHEMA, made_up, plain


def test_a_task_gives_few_rows_with_the_calls_of_all(spark):
    rows = [(k, *r, k % 4) for k, *r in made_up(2000, 3)] + [(5000, None, "m1", None, 3, None, None, None, 1), (5001, None, "m1", 2, 3, 1.0, False, None, 1)]
    given = spark.createDataFrame(rows, f"{SCHEMA}, part int").selectExpr("provider", "model", "part", "seq", "tokens_in", "tokens_out", "cast(tokens_in as double) as cost", "latency_ms", "ok", "error").coalesce(1)
    found = {r[:3]: r.asDict() for r in given.mapInArrow(calls._combined(20), calls._OUT).collect()}
    assert len(found) == 17
    for key, r in found.items():
        own = [x for x in rows if (x[1], x[2], x[8]) == key]
        assert (r["calls"], r["tokens_in"], r["tokens_out"], r["cost"], r["latency"]) == (len(own), *[sum(x[c] or 0 for x in own) for c in (3, 4, 3, 5)])
        assert (r["successes"], r["errors"]) == (sum(bool(x[6]) for x in own), sum(not x[6] for x in own))
        assert dict(zip(r["error_names"], r["error_counts"], strict=True)) == Counter(x[7] or "Unknown" for x in own if not x[6])
        if key[0] is not None:
            assert list(zip(r["seqs"], r["latencies"], strict=True)) == sorted((x[0], x[5]) for x in own)[-20:]
        else:
            assert r["seqs"] == [5000, 5001]


def test_states_are_gone_through_once_in_a_batch(spark, tmp_path, monkeypatch):
    rows, kept, seen = made_up(600, 2), Store(spark, str(tmp_path / "s")), spark.sparkContext.accumulator(0)
    for k in range(2):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))

    class Counted(calls._Calls):
        def handleInputRows(self, key, rows, timerValues):
            seen.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(calls, "_Calls", Counted)
    calls.call_stream(log, kept, str(tmp_path / "c"), keep=40).awaitTermination()
    # Two batches with four models in calls.PARTS parts each.
    assert seen.value == 2 * 4 * calls.PARTS
    assert plain(calls.stats_of(kept.scan(calls.NAME), 40)) == plain(ledger.provider_stats(spark.createDataFrame(rows, SCHEMA), 40))
