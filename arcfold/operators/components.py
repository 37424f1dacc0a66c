"""Weakly connected components by alternating stars: no neighbour list is ever gathered, and rounds are logarithmic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.plans.lineage import forget, measured, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b): component is the smallest id that edges reach.

    The large star hangs each larger neighbour of a vertex on the smallest one, the small star each smaller one,
    until nothing moves; then every edge leads to its component's smallest id."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, mark = staged(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select("b", "m").where("b <> m").toDF("a", "b").unionByName(least.toDF("a", "b")).distinct()
        new, now = measured(small, "edges", rows=F.count("*"), hashes=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        forget(e)
        e = new
        if now == mark or not now["rows"]:
            break
        mark = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def wcc(graph: Graph) -> DataFrame:
    """(id, value): the smallest id of each vertex's weak component."""
    found = components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("value"))


def label_propagation(graph: Graph, max_iterations: int) -> DataFrame:
    """(id, value): labels start as ids; each step a vertex takes the most frequent label of its in-neighbours (the
    largest of equals) if that is greater than its own."""
    edges = graph.edges.select("src", F.col("dst").alias("_to")).persist()
    state = staged(graph.vertices.select("id", F.col("id").alias("value")), "labels")
    for _ in range(max_iterations):
        heard = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("_to").alias("id"), "value").agg(F.count("*").alias("n"))
        best = heard.groupBy("id").agg(F.max_by("value", F.struct("n", "value")).alias("new"))
        new = staged(state.join(best, "id", "left").select("id", F.greatest("value", "new").alias("value")), "labels")
        forget(state)
        state = new
    edges.unpersist()
    return state
