"""Ingest of a repository (P1-P4, P14) and small plans over records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork import schemas as S
from skeinwork.functions import scalars as C
from skeinwork.operators import code, extract
from skeinwork.tables import dealt, settle


def repository_index(scan: DataFrame) -> DataFrame:
    """The scan with the imports of each file."""
    imports = extract.imports_of(scan.select("path", "language", "source"))
    return scan.join(imports, "path", "left").select("path", "language", "size", "hash", "imports")


def ingest_repository(scan: DataFrame, prior: DataFrame | None = None, churn: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index, nodes, edges and the one-row result, with hotspots if churn (path, churn) is given; files whose hash did not change keep their imports unparsed."""
    if prior is None:
        index = settle(repository_index(scan), "index")
        status = scan.select("path", F.lit("parsed").alias("status"))
    else:
        status = code.reuse(scan, prior)
        fresh = scan.join(status.filter("status = 'parsed'").select("path"), "path", "left_semi")
        kept = scan.select("path", "language", "size", "hash").join(prior.select("path", "imports"), "path").join(status.filter("status = 'reused'").select("path"), "path", "left_semi")
        index = settle(repository_index(fresh).unionByName(kept), "index")
    nodes, edges = code.repository_graph(index)
    return {"index": index, "nodes": nodes, "edges": edges, "result": code.scan_result(index, status, churn)}


def ingest_symbols(scan: DataFrame) -> dict[str, DataFrame]:
    """Symbols, edges and the one-row summary of the Python files."""
    files = scan.filter("language = 'python'")
    facts = settle(extract.python_facts(dealt(files)), "facts")
    nodes = code.symbols(facts)
    resolved = code.resolved_calls(facts, nodes, files)
    edges = reduce(DataFrame.unionByName, [code.defines(facts), code.extends(nodes), code.calls(resolved)])
    return {"facts": facts, "nodes": nodes, "edges": edges, "calls": resolved, "result": code.scan_summary(files, nodes, edges, resolved)}


def ingest_states(scan: DataFrame, facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """States, their reads and writes, and how accesses were resolved."""
    files = scan.filter("language = 'python'")
    facts = settle(extract.python_facts(dealt(files)), "facts") if facts is None else facts
    edges = code.state_edges(facts)
    nodes = code.state_nodes(facts, edges)
    return {"nodes": nodes, "edges": edges, "result": code.resolution_stats(facts, edges, nodes, files)}


def cards(nodes: DataFrame, edges: DataFrame, files: DataFrame, churn: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """A card (card_id, ref, source_hash, purpose, risk, change, dependencies) for each node; one whose hash is cached is left out.

    A File's hash is its content's, a Module's that of the files it contains, any other node's is empty.
    """
    own = files.select(F.concat(F.lit("file:"), "path").alias("id"), "language", "size", F.col("hash").alias("file_hash"))
    held = edges.filter("type = 'contains'").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n_files"))
    hashes = code.module_hashes(edges, own.select("id", F.col("file_hash").alias("hash")))
    deps = edges.filter("type = 'depends_on'").join(nodes.select(F.col("id").alias("dst_id"), F.col("label").alias("name")), "dst_id").groupBy(F.col("src_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("dependencies"))
    at = nodes.join(own, "id", "left").join(held, "id", "left").join(hashes, "id", "left").join(deps, "id", "left")
    hot = (churn if churn is not None else nodes.sparkSession.createDataFrame([], "path string, churn bigint")).orderBy(F.desc("churn"), "path").limit(S.HOTSPOTS)
    at = at.join(F.broadcast(hot.select(F.col("path").alias("label"), "churn")), "label", "left")  # J16: HOTSPOTS rows
    times = F.when(F.col("type") == "File", F.coalesce("churn", F.lit(0))).otherwise(0)
    made = at.select(
        F.concat(F.lit("card:"), "type", F.lit(":"), "id").alias("card_id"), F.col("id").alias("ref"),
        F.when(F.col("type") == "File", F.coalesce("file_hash", F.lit(""))).when(F.col("type") == "Module", F.coalesce("source_hash", F.lit(""))).otherwise("").alias("source_hash"),
        C.purpose_text(F.col("type"), F.col("label"), F.col("language"), F.col("size"), F.col("n_files")).alias("purpose"),
        C.risk_text(F.col("label"), times).alias("risk"), C.change_text(times).alias("change"), F.coalesce("dependencies", F.lit("")).alias("dependencies"),
    )
    return made if cached is None else made.join(cached.select("card_id", "source_hash"), ["card_id", "source_hash"], "left_anti")


def sync(scan: DataFrame, churn: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole ingest: repository, cards, symbols, states."""
    repo = ingest_repository(scan, churn=churn)
    symbols = ingest_symbols(scan)
    return {"repository": repo["result"], "cards": cards(repo["nodes"], repo["edges"], repo["index"], churn), "symbols": symbols["result"], "states": ingest_states(scan, symbols["facts"])["result"]}


def metered(calls: DataFrame) -> DataFrame:
    """A token event for each provider call that succeeded; failed ones only count in the statistics."""
    return calls.filter("ok").select("provider", "model", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens_actual"), C.call_cost("provider", "model", "tokens_in", "tokens_out").alias("cost"))


FINDINGS = "array<struct<claim: string, severity: string, confidence: double>>"


def parsed_findings(answers: DataFrame, by: Sequence[str] = ("agent",)) -> DataFrame:
    """Findings of agents' JSON answers (by, text); text that is no list of objects gives none."""
    rows = F.from_json("text", FINDINGS, {"mode": "PERMISSIVE"})
    found = answers.select(*by, F.posexplode(rows).alias("arrival", "x")).filter("x.claim is not null")
    return found.select(*by, "arrival", "x.claim", F.coalesce("x.severity", F.lit("low")).alias("severity"), F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"))


def run_outcomes(calls: DataFrame, by: Sequence[str], order: Sequence[str], retries: int = 1, timeout: float = 30.0) -> DataFrame:
    """How each agent's run ended, from a log of its calls (by, order, latency_ms, text, error, tokens_in, tokens_out).

    A run has its first retries + 1 calls by order; later ones count for nothing.  A call is a timeout if it took longer than timeout seconds, or has no latency
    since it never came back; else an error if it has one, or if its text is no list of objects that all have a claim; else ok (an empty list is).
    The first ok call ends the run; a run without one has the status and error of its last call, and no latency, tokens or text.  attempts is the
    number of calls up to there.  A failed run touches no other.  Null keys are a run of their own; order should be unique within a run.
    """
    listed = F.from_json("text", FINDINGS, {"mode": "PERMISSIVE"})
    fits = F.coalesce(F.ltrim("text").startswith("[") & F.forall(listed, lambda x: x.isNotNull() & x["claim"].isNotNull()), F.lit(False))
    late = F.col("latency_ms").isNull() | (F.col("latency_ms") > timeout * 1000)
    error = F.when(late, "provider call timed out").when(F.col("error").isNotNull(), F.col("error")).when(~fits, "answer is no list of findings")
    status = F.when(late, "timeout").when(error.isNotNull(), "error").otherwise("ok")
    attempt = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    tried = calls.withColumn("attempt", attempt).filter(F.col("attempt") <= retries + 1)
    tried = tried.select(*by, "attempt", status.alias("status"), error.alias("why"), "latency_ms", "tokens_in", "tokens_out", "text")
    whole = F.struct("attempt", "status", "why", "latency_ms", "tokens_in", "tokens_out", "text")
    ended = tried.groupBy(*by).agg(F.min_by(whole, F.when(F.col("status") == "ok", F.col("attempt"))).alias("won"), F.max_by(whole, "attempt").alias("last"))
    end = lambda c: F.coalesce(f"won.{c}", f"last.{c}").alias(c)
    return ended.select(*by, end("status"), F.when(F.col("won").isNull(), F.col("last.why")).alias("error"), end("attempt").alias("attempts"), *[f"won.{c}" for c in ("latency_ms", "tokens_in", "tokens_out", "text")])


def attached(sessions: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Sessions with the references that their updates give; null leaves what was there.

    Of several updates of one session the last by order counts, column by column; without an order the greatest value.
    """
    cols = [c for c in updates.columns if c not in ("id", order)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))) if order else F.max(c)
    new = updates.groupBy("id").agg(*[last(c).alias(f"__{c}") for c in cols])
    out = sessions.join(new, "id", "left")
    return out.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in sessions.columns])


def advice_edges(advice: DataFrame, targets: DataFrame, nodes: DataFrame, audit: bool = False) -> DataFrame:
    """Edges from a recommendation or finding to the targets that exist."""
    found = targets.join(nodes.select(F.col("id").alias("target"), "type"), "target").join(advice.select("id"), "id", "left_semi")
    kind = F.lit("audits") if audit else F.when(F.col("type") == "Decision", "informs").otherwise("advises")
    return found.select(F.col("id").alias("src_id"), F.col("target").alias("dst_id"), kind.alias("type")).distinct()


def diagnosis(checks: DataFrame) -> DataFrame:
    """All checks as one verdict."""
    return checks.agg(F.count("*").alias("checks"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failed"))
