"""Statistics of provider calls (A7, W5) as a stateful stream.

The state of a (provider, model) is its sums, its errors by name and the ring of its last samples, one value that a batch reads and writes once.
A busy model's calls are dealt over PARTS states by a hash of their number, so that no key grows into one task; each keeps its own ring,
and the last samples of all are among them.  A task first adds its calls up to rows of a state's shape, a few for each key, and only those are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.sources.store import Store
from skeinwork.tables import work_dir

PARTS = 4
#: Tasks of a batch that hold states, at most: each has its own store and worker, and gets only a few rows for each key.
TASKS = 8
#: The collection that a stream keeps in its store.
NAME = "call_parts"
#: Calls that a task adds up at once, and samples that it holds before it lets its rows go.
_AT_ONCE, _HELD = 50_000, 500_000
_KEYS = ["provider", "model", "part"]
_SUMS = "calls long, tokens_in long, tokens_out long, cost double, latency double, successes long, errors long"
_STATE = f"{_SUMS}, error_names array<string>, error_counts array<long>, seqs array<long>, latencies array<double>"
_OUT = f"provider string, model string, part int, {_STATE}"


def _summed(rows: pa.Table, by: list[str], names: list[str]) -> pa.Table:
    return rows.group_by(by).aggregate([(n, "sum") for n in names]).select([*by, *[f"{n}_sum" for n in names]]).rename_columns([*by, *names])


def _last(rows: pa.Table, keep: int) -> pa.Table:
    """The last samples of each key."""
    provider, model = (rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for k in _KEYS[:2])
    part = rows["part"].to_numpy()
    key = (provider * rows.num_rows + model) * (int(part.max(initial=0)) + 1) + part
    o = np.lexsort((rows["latency"].to_numpy(), rows["seq"].to_numpy(), key))
    key = key[o]
    return rows.take(o[np.searchsorted(key, key, "right") - np.arange(len(key)) <= keep])


def _combined(keep: int):
    """The calls of a task as rows of a state's shape."""
    sums = [c.split()[0] for c in _SUMS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in _OUT.split(", "))])

    def added(held: list[pa.Table], calls: list[pa.RecordBatch]) -> list[pa.Table]:
        rows = pa.Table.from_batches(calls)
        ok = pc.fill_null(rows["ok"], False)
        one, keys = pa.array(np.ones(len(rows), np.int64)), [rows[k] for k in _KEYS]
        known = [pc.fill_null(rows[c], 0) for c in ("tokens_in", "tokens_out", "cost", "latency_ms")]
        new = pa.table([*keys, one, *known, ok.cast(pa.int64()), pc.invert(ok).cast(pa.int64())], [*_KEYS, *sums])
        wrong = pa.table([*keys, pc.fill_null(rows["error"], "Unknown"), one], [*_KEYS, "error", "n"]).filter(pc.invert(ok))
        samples = pa.table([*keys, rows["seq"], rows["latency_ms"]], [*_KEYS, "seq", "latency"])
        new, wrong, samples = (pa.concat_tables(t) for t in zip(*[h for h in [held, [new, wrong, samples]] if h], strict=True))
        return [_summed(new, _KEYS, sums), _summed(wrong, [*_KEYS, "error"], ["n"]), _last(samples, keep)]

    def rows_of(held: list[pa.Table]) -> pa.RecordBatch:
        new, wrong, samples = ([list(r.values()) for r in t.to_pylist()] for t in held)  # a few for each key
        lists = {tuple(r[:3]): ([], [], [], []) for r in new}
        for *key, a, b in wrong:
            lists[tuple(key)][0].append(a)
            lists[tuple(key)][1].append(b)
        for *key, a, b in samples:
            lists[tuple(key)][2].append(a)
            lists[tuple(key)][3].append(b)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*r, *lists[tuple(r[:3])]) for r in new], strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, calls = [], []
        for b in batches:
            calls.append(b)
            if sum(map(len, calls)) >= _AT_ONCE:
                held, calls = added(held, calls), []
                if len(held[2]) > _HELD:
                    yield rows_of(held)
                    held = []
        if sum(map(len, calls)):
            held = added(held, calls)
        if held:
            yield rows_of(held)

    return run


class _Calls(StatefulProcessor):
    """The state of one part of a model's calls; a batch gives the part's new values."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("calls", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *sums, names, counts, seqs, latencies = self.state.get() if self.state.exists() else (0, 0, 0, 0.0, 0.0, 0, 0, [], [], [], [])
        ring, errors = list(zip(seqs, latencies, strict=True)), Counter(dict(zip(names, counts, strict=True)))
        for b in rows:
            for _, _, _, *more, names, counts, seqs, latencies in b.itertuples(index=False):
                sums = [a + type(a)(m) for a, m in zip(sums, more, strict=True)]
                errors.update(dict(zip(names, map(int, counts), strict=True)))
                ring = sorted([*ring, *zip(map(int, seqs), map(float, latencies), strict=True)])[-self.keep :]
        named = sorted(errors.items())
        now = (*sums, [k for k, _ in named], [n for _, n in named], [s for s, _ in ring], [x for _, x in ring])
        self.state.update(now)
        yield pd.DataFrame({c.split()[0]: [v] for c, v in zip(_OUT.split(", "), (*key, *now), strict=True)})

    def close(self) -> None:
        pass


def call_stream(calls: DataFrame, store: Store, checkpoint: str | None = None, keep: int = S.SAMPLES, trigger: dict | None = None) -> StreamingQuery:
    """calls is a stream of (seq, provider, model, tokens_in, tokens_out, latency_ms, ok, error); the store follows it by batches.

    A batch that is run again writes the same rows under the same keys, so a restart changes nothing.  seq tells calls apart and orders them.
    """
    spark = calls.sparkSession
    rows = calls.withColumns({"cost": C.call_cost("provider", "model", "tokens_in", "tokens_out"), "part": F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int")})
    given = rows.select("provider", "model", "part", "seq", "tokens_in", "tokens_out", "cost", "latency_ms", "ok", "error")
    parts = given.mapInArrow(_combined(keep), _OUT).groupBy(*_KEYS).transformWithStateInPandas(_Calls(keep), _OUT, "Update", "None")

    def write(batch: DataFrame, _: int) -> None:
        keyed = batch.withColumn("id", F.to_json(F.struct("provider", "model", "part")))
        if store.path(NAME) is None:
            store.overwrite(NAME, keyed)
        else:  # an upsert reads its rows twice, and the states would be gone through each time
            keyed.persist()
            try:
                store.upsert(NAME, keyed)
            finally:
                keyed.unpersist()

    provider, shuffled = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, tasks = spark.conf.get(provider), spark.conf.get(shuffled)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(shuffled, str(min(TASKS, int(tasks))))
    try:
        out = parts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint or f"{work_dir(spark)}/{NAME}")
        return out.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(provider, before)
        spark.conf.set(shuffled, tasks)


def stats_of(parts: DataFrame, keep: int = S.SAMPLES) -> DataFrame:
    """A7 from the parts of a stream's store; the columns of ledger.provider_stats."""
    keys = ["provider", "model"]
    total = lambda c, name, kind="long": F.sum(c).cast(kind).alias(name)
    sums = parts.groupBy(*keys).agg(
        total("calls", "calls"), total("tokens_in", "tokens_in"), total("tokens_out", "tokens_out"), C.half_even(F.sum("cost"), 6).alias("est_cost"),
        total("latency", "sum_latency_ms", "double"), total("successes", "successes"), total("errors", "errors"),
    )
    named = parts.select(*keys, F.explode(F.arrays_zip("error_names", "error_counts")).alias("e")).groupBy(*keys, "e.error_names").agg(F.sum("e.error_counts").alias("n"))
    errors = named.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_names", "n")))).alias("error_breakdown"))
    # PARTS * keep samples of a model at most.
    held = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("seqs", "latencies"))))
    last = F.slice(held, F.greatest(F.lit(1), F.size(held) - keep + 1), keep)
    samples = parts.groupBy(*keys).agg(F.transform(last, lambda x: x["latencies"]).alias("latency_samples"))
    out = sums.join(errors, keys, "left").join(samples, keys, "left")
    return out.withColumn("error_breakdown", F.coalesce("error_breakdown", F.create_map().cast("map<string,bigint>")))
