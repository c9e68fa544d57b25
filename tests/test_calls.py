"""The stream of provider calls against the statistics of the whole log."""

import random

from skeinwork.operators import ledger
from skeinwork.sources.store import Store
from skeinwork.streaming import calls

SCHEMA = "seq long, provider string, model string, tokens_in long, tokens_out long, latency_ms double, ok boolean, error string"


def made_up(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ok = rng.random() < 0.7
        rows.append((k, rng.choice(["claude", "claude", "ollama"]), rng.choice(["m1", "m2"]), rng.randrange(900), rng.randrange(300), rng.randrange(400) / 4, ok, None if ok else rng.choice(["Timeout", "Refused", None])))
    rng.shuffle(rows)
    return rows


def plain(df):
    cols = ("provider", "model", "calls", "tokens_in", "tokens_out", "est_cost", "sum_latency_ms", "successes", "errors", "error_breakdown", "latency_samples")
    return {r[:2]: r[2:] for r in (tuple(r[c] for c in cols) for r in df.collect())}


def test_stream_with_a_restart_is_the_whole_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "PARTS", 3)
    rows, kept = made_up(900, 1), Store(spark, str(tmp_path / "s"))
    whole = spark.createDataFrame(rows, SCHEMA)
    for half in (0, 1):
        for k in range(2):
            at = half * 450 + k * 225
            spark.createDataFrame(rows[at : at + 225], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        calls.call_stream(log, kept, str(tmp_path / "c"), keep=40).awaitTermination()
        seen = spark.createDataFrame(rows[: half * 450 + 450], SCHEMA)
        assert plain(calls.stats_of(kept.scan(calls.NAME), 40)) == plain(ledger.provider_stats(seen, 40))
    assert sorted(map(tuple, ledger.scorecards(calls.stats_of(kept.scan(calls.NAME), 40)).collect())) == sorted(map(tuple, ledger.scorecards(ledger.provider_stats(whole, 40)).collect()))
    # Nothing new: a further start changes nothing.
    before = kept.read(calls.NAME)[1]
    calls.call_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")), kept, str(tmp_path / "c"), keep=40).awaitTermination()
    assert kept.read(calls.NAME)[1] == before
    assert kept.scan(calls.NAME).filter("size(seqs) > 40").isEmpty()
