"""Ranks: delta PageRank and SybilRank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.plans.lineage import forget, measured, staged


def pagerank(graph: Graph, max_iterations: int, *, tolerance: float, reset_probability: float, source=None) -> DataFrame:
    """(id, rank, delta), not normalised. A vertex that hears something adds it, damped, to its rank; it sends its
    change on, dealt evenly over its edges, while the change is over the tolerance. With a source, ranks are personal:
    only the source starts, with rank 1. Rank of vertices without edges is lost."""
    damp, personal = 1.0 - reset_probability, source is not None
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("_n"))
    edges = graph.edges.select("src", F.col("dst").alias("_to")).join(degree, "src").select("src", "_to", (F.lit(1.0) / F.col("_n")).alias("_w")).persist()
    first = 0.0 if personal else reset_probability / damp
    state = graph.vertices.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("delta"), F.lit(False).alias("moved"))
    sends = F.col("moved") & (F.col("delta") > tolerance)
    seen: dict = {}
    for step in range(1, max_iterations + 1):
        if step == 1:
            heard = state.withColumn("sum", F.lit(first))
        else:
            if not seen["sends"]:
                break
            front = state.where(sends)
            sums = edges.join(front.select(F.col("id").alias("src"), "delta"), "src").groupBy(F.col("_to").alias("id")).agg(F.sum(F.col("delta") * F.col("_w")).alias("sum"))
            heard = state.join(sums, "id", "left")
        rank = F.when(F.col("sum").isNull(), F.col("rank")).otherwise(F.col("rank") + F.lit(damp) * F.col("sum"))
        if personal and step == 1:
            rank = F.when(F.col("id") == source, F.lit(1.0)).otherwise(rank)
        new = heard.select(
            "id", rank.alias("rank"),
            F.when(F.col("sum").isNull(), F.col("delta")).otherwise(rank - F.col("rank")).alias("delta"),
            F.col("sum").isNotNull().alias("moved"),
        )
        new, seen = measured(new, "ranks", sends=F.coalesce(F.bool_or(sends), F.lit(False)))
        forget(state)
        state = new
    edges.unpersist()
    return state.select("id", "rank", "delta")


def sybilrank(graph: Graph, *, total_trust: float | None = None, iteration_multiplier: int = 1) -> DataFrame:
    """(id, rank, trusted) of a graph whose vertex values are (rank, trusted). Trust starts evenly on the trusted and
    takes ceil(multiplier * log10(vertices)) steps along edges, dealt by their values; ranks are by weighted degree."""
    n, seeds = graph.vertices.agg(F.count("*"), F.coalesce(F.sum(F.col("value.trusted").cast("long")), F.lit(0))).first()
    share = (n if total_trust is None else total_trust) / seeds if seeds else 0.0
    degree = graph.edges.groupBy("src").agg(F.sum("value").alias("_d"))
    edges = graph.edges.join(degree, "src").select("src", F.col("dst").alias("_to"), (F.col("value") / F.col("_d")).alias("_w")).persist()
    state = graph.vertices.select("id", F.when(F.col("value.trusted"), F.lit(float(share))).otherwise(0.0).alias("r"))
    for _ in range(max(1, math.ceil(iteration_multiplier * math.log10(max(n, 1))))):
        sums = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("_to").alias("id")).agg(F.sum(F.col("r") * F.col("_w")).alias("s"))
        new = staged(graph.vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("r")), "trust")
        forget(state)
        state = new
    edges.unpersist()
    out = graph.vertices.select("id", F.col("value.trusted").alias("trusted")).join(state, "id").join(degree.withColumnRenamed("src", "id"), "id", "left")
    return out.select("id", (F.col("r") / F.col("_d")).alias("rank"), "trusted")
