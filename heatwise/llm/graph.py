"""Connected components as alternating star contractions, joins and grouped minima only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from heatwise.llm.scratch import Scratch


def _with_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and all v of u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes with an edge.

    Null ends and self links are left out.  Each round is two grouped minima joined back;
    a hub's rows are combined before the shuffle and its join is split by adaptive
    execution.  Every round is a written table, so plans stay short and a lost executor
    costs one round.  Rounds grow with the logarithm of the longest chain.
    """
    edges = (edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .distinct())
    edges = scratch.keep(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_min(both).where("v > u")
                 .select(F.col("m").alias("u"), "v").where("u < v").distinct())
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        small = _with_min(down)
        small = (small.select(F.col("m").alias("u"), "v")
                 .union(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
                 .where("u < v").distinct())
        after = scratch.keep(small, "edges")
        scratch.drop(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
