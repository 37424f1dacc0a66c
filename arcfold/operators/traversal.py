"""Shortest paths by frontier relaxation: only vertices that improved in a step send in the next, distances are
combined before the shuffle, and each step's state is a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.plans.lineage import forget, measured

UNREACHED = (1 << 63) - 1


def _relax(edges: DataFrame, state: DataFrame, keys: list[str], cost: Column, most: int | None) -> tuple[DataFrame, int]:
    """state (id, *keys, dist, moved): lowest distances over (src, dst, cost) edges, and the steps taken."""
    keys = ["id", *keys]
    edges = edges.select("src", F.col("dst").alias("_to"), cost.alias("_cost")).persist()
    moved = F.coalesce(F.bool_or("moved"), F.lit(False))
    (state, seen), steps = measured(state, "paths", moved=moved), 0
    while seen["moved"] and (most is None or steps < most):
        front = state.where("moved")
        sent = edges.join(front.withColumnRenamed("id", "src"), "src")
        offers = sent.groupBy(F.col("_to").alias("id"), *keys[1:]).agg(F.min(F.col("dist") + F.col("_cost")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        new = state.drop("moved").join(offers, keys, "left" if len(keys) == 1 else "full")
        new = new.select(
            *keys, F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"),
            F.coalesce(better, F.lit(False)).alias("moved"),
        )
        new, seen = measured(new, "paths", moved=moved)
        forget(state)
        state, steps = new, steps + 1
    edges.unpersist()
    return state, steps


def bfs(graph: Graph, source, *, max_iterations: int | None = None) -> DataFrame:
    """(id, value): hops from the source along edges; UNREACHED where no path leads."""
    start = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("dist"), (F.col("id") == source).alias("moved"))
    state, _ = _relax(graph.edges, start, [], F.lit(1).cast("long"), max_iterations)
    return state.select("id", F.coalesce("dist", F.lit(UNREACHED)).alias("value"))


def sssp(graph: Graph, source, *, max_iterations: int | None = None) -> DataFrame:
    """(id, value): the least sum of edge values from the source; infinite where no path leads."""
    start = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0.0)).alias("dist"), (F.col("id") == source).alias("moved"))
    state, _ = _relax(graph.edges, start, [], F.col("value").cast("double"), max_iterations)
    return state.select("id", F.coalesce("dist", F.lit(float("inf"))).alias("value"))


def mssp(graph: Graph, landmarks: Iterable, *, max_iterations: int | None = None) -> DataFrame:
    """(id, landmark, value): the least sum of edge values from each landmark to each vertex."""
    marks = sorted(set(landmarks))
    ids = graph.vertices.select("id")
    start = ids.where(F.col("id").isin(marks)).select("id", F.col("id").alias("landmark"), F.lit(0.0).alias("dist"), F.lit(True).alias("moved"))
    state, _ = _relax(
        graph.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), start, ["landmark"],
        F.col("value").cast("double"), max_iterations,
    )
    every = ids.withColumn("landmark", F.explode(F.array(*(F.lit(m) for m in marks)).cast(f"array<{graph.types['id']}>")))
    return every.join(state.select("id", "landmark", "dist"), ["id", "landmark"], "left").select(
        "id", "landmark", F.coalesce("dist", F.lit(float("inf"))).alias("value"),
    )


def mssp_maps(graph: Graph, landmarks: Iterable, **options) -> DataFrame:
    """mssp() with one map of landmark to distance per vertex."""
    rows = mssp(graph, landmarks, **options)
    return rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("landmark", "value")))).alias("value"))
