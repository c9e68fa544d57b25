"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.runtime import settle


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node reachable.

    Each round points the larger neighbours of a node, then the node and its smaller neighbours, to the smallest of them.  A
    round aggregates minima before any shuffle and joins them back, so a node with very many edges needs no list; such joins are split by
    Spark where one key is hot.  The number of rounds grows with the logarithm of a component's size.  Edges with a null end and
    loops link nothing; an empty input gives an empty result.
    """
    now = settle(_stars(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")), "stars")
    state = None
    for _ in range(rounds):
        n, total, low = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == (n, total, low):
            break
        state = (n, total, low)
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        now = settle(_star(_stars(large), larger=False), "stars")
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end u to its smaller end v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    if larger:
        m = F.least("u", "m")
        return joined.filter("v > u").select(F.col("v").alias("u"), m.alias("v")).filter("u <> v").distinct()
    out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
