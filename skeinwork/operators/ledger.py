"""Ledgers and scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.operators.records import first_of_each


def token_report(events: DataFrame) -> DataFrame:
    """Totals and tokens saved by provider.  Providers are aggregated first, so the second step sees one row each."""
    by = events.groupBy("provider").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("tokens_estimated", "tokens_actual", "tokens_raw_equiv", "tokens_saved")])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("events"), *map(total, ("tokens_estimated", "tokens_actual", "tokens_raw_equiv", "tokens_saved")), F.sort_array(F.collect_list(F.struct("provider", "tokens_saved"))).alias("by"))
    compressed = F.col("tokens_raw_equiv") - F.col("tokens_saved")
    ratio = F.when(F.col("tokens_raw_equiv") > 0, C.half_even(compressed / F.col("tokens_raw_equiv"), 4)).otherwise(1.0)
    listed = F.array_join(F.transform("by", lambda x: F.concat_ws("=", x["provider"], x["tokens_saved"].cast("string"))), ",")
    return out.select("events", "tokens_estimated", "tokens_actual", "tokens_raw_equiv", "tokens_saved", compressed.alias("tokens_compressed"), ratio.alias("ratio"), listed.alias("saved_by_provider"))


def last_samples(calls: DataFrame, keep: int = S.SAMPLES) -> DataFrame:
    """The last calls of each provider and model in order of arrival."""
    w = Window.partitionBy("provider", "model").orderBy(F.desc("seq"))
    return calls.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= keep)


def provider_stats(calls: DataFrame, keep: int = S.SAMPLES) -> DataFrame:
    """By provider and model: sums, an error histogram and the last latencies, oldest first."""
    keys = ["provider", "model"]
    cost = C.call_cost("provider", "model", "tokens_in", "tokens_out")
    sums = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").cast("long").alias("tokens_in"), F.sum("tokens_out").cast("long").alias("tokens_out"), C.half_even(F.sum(cost), 6).alias("est_cost"),
        F.sum("latency_ms").alias("sum_latency_ms"), F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("errors"),
    )
    errors = calls.filter(~F.col("ok")).groupBy(*keys, "error").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("error", F.lit("Unknown")), "n")))).alias("error_breakdown"))
    samples = last_samples(calls, keep).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "latency_ms"))), lambda x: x["latency_ms"]).alias("latency_samples"))
    out = sums.join(errors, keys, "left").join(samples, keys, "left")
    return out.withColumn("error_breakdown", F.coalesce("error_breakdown", F.create_map().cast("map<string,bigint>")))


def nearest_rank(samples: Column, p: float) -> Column:
    """The sample at the half-even rounded index p * (n - 1); 0.0 without samples."""
    n = F.size(samples)
    at = F.least(n - 1, C.half_even(F.lit(p) * (n - 1)).cast("int"))
    return F.when(n > 0, F.element_at(F.array_sort(samples), F.greatest(at, F.lit(0)) + 1)).otherwise(0.0)


def scorecards(stats: DataFrame) -> DataFrame:
    """A8"""
    return stats.select(
        "provider", "model", "calls", "est_cost", F.when(F.col("calls") > 0, C.half_even(F.col("sum_latency_ms") / F.col("calls"), 3)).otherwise(0.0).alias("avg_latency_ms"),
        nearest_rank(F.col("latency_samples"), 0.95).alias("p95_latency_ms"), F.when(F.col("calls") > 0, C.half_even(F.col("successes") / F.col("calls"), 4)).otherwise(0.0).alias("success_rate"),
    )


def provider_rollup(cards: DataFrame) -> DataFrame:
    """A10: per provider, weighted by calls; cards without calls do not count."""
    used = cards.filter("calls > 0")
    w = lambda c: F.sum(F.col(c) * F.col("calls")) / F.sum("calls")
    return used.groupBy("provider").agg(C.half_even(F.sum("est_cost") / F.sum("calls"), 6).alias("cost_per_call"), C.half_even(w("avg_latency_ms"), 3).alias("avg_latency_ms"), C.half_even(w("success_rate"), 4).alias("success_rate"))


# Metric, whether low is good, and its name, of each policy.
POLICIES = {"cheapest": ("cost_per_call", True, "lowest cost/call"), "fastest": ("avg_latency_ms", True, "lowest avg latency"), "most_reliable": ("success_rate", False, "highest success rate")}


def route(candidates: DataFrame, rollup: DataFrame, policy: str, default: str) -> DataFrame:
    """Candidates with rank, metric and policy; rank 1 is selected.

    Low is good: ties go to the smaller name, names without figures come last.  High is good: ties go to the larger name.  If
    no candidate has figures the configured default is chosen, else the smallest name.
    """
    if policy != "pinned" and policy not in POLICIES:
        raise ValueError(f"unknown routing policy: {policy}")
    names = candidates.select("name").distinct().join(rollup.withColumnRenamed("provider", "name"), "name", "left")
    w = Window.partitionBy(F.lit(1))
    pinned = [(F.col("name") != default), F.col("name")]
    metric, low, label = POLICIES.get(policy, ("cost_per_call", True, "pinned"))
    order = [F.asc_nulls_last(metric), F.asc("name")] if low else [F.desc_nulls_last(metric), F.desc("name")]
    known = names.withColumn("any_known", F.max(F.col(metric).isNotNull()).over(w))
    by_pin = F.row_number().over(w.orderBy(*pinned))
    by_metric = F.row_number().over(w.orderBy(*order))
    use_pin = F.lit(policy == "pinned") | ~F.col("any_known")
    out = known.withColumn("rank", F.when(use_pin, by_pin).otherwise(by_metric))
    reason = F.when(use_pin, F.when(F.col("rank") == 1, F.when(F.col("name") == default, "configured default").otherwise("default unavailable")).otherwise("not the configured default")).otherwise(F.when(F.col(metric).isNull(), "no stats available").otherwise(F.lit(label)))
    return out.select("name", "rank", F.when(~use_pin, F.col(metric)).alias("metric"), reason.alias("reason"), F.lit(policy).alias("policy"))


def duplicate_groups(memory: DataFrame) -> DataFrame:
    """Active project and user memories with equal scope, kind and content."""
    live = memory.filter("status = 'active' and scope in ('project', 'user')")
    groups = live.groupBy("scope", C.content_hash("scope", "kind", "content").alias("hash")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return groups.filter("n > 1").select("scope", "hash", "n", F.array_join("ids", ",").alias("ids"))


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, records) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("records")).select(F.lit(n).alias("name"), "records") for n, t in tables.items()])


def merge_findings(findings: DataFrame) -> DataFrame:
    """The first of each agent and claim, by severity, confidence, agent and claim: seq is the place."""
    one = first_of_each(findings, ["agent", "claim"], [F.col("arrival")])
    return one.withColumn("rank", C.severity_rank("severity")).orderBy("rank", F.desc("confidence"), "agent", "claim").select("agent", "claim", "severity", "confidence", "rank")


def run_report(results: DataFrame) -> DataFrame:
    """How many agents succeeded, and the names of those that failed."""
    return results.agg(F.count_if(F.col("ok")).alias("succeeded"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("agent")))), ",").alias("failed"))
