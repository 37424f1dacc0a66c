"""Greedy b-matching by mutual proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcfold.graph import Graph
from arcfold.plans.lineage import forget, staged


def b_matching(graph: Graph) -> DataFrame:
    """(src, dst, value) of the matched edges of a symmetric graph whose vertex values are capacities. In each round
    a vertex proposes along its heaviest edges, as many as it has room for (the largest neighbour of equals first);
    edges proposed from both ends are matched, and those of full vertices go."""
    if not graph.vertices.where("value < 0").isEmpty():
        raise ValueError("a capacity is negative")
    room = staged(graph.vertices.select("id", F.col("value").cast("long").alias("room")), "rooms")
    left = staged(graph.edges.where("src <> dst").select("src", "dst", F.col("value").cast("double").alias("value")), "edges")
    most = room.agg(F.coalesce(F.max("room"), F.lit(0))).first()[0]
    done = None
    while True:
        open_ = room.where("room > 0")
        live = left.join(open_.select(F.col("id").alias("src"), "room"), "src").join(open_.select(F.col("id").alias("dst")), "dst", "left_semi")
        # The literal bound lets Spark keep only that many rows of a vertex before the shuffle, however large its hub.
        order = Window.partitionBy("src").orderBy(F.desc("value"), F.desc("dst"))
        wanted = live.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).where("_k <= room").select("src", "dst", "value")
        met = staged(
            wanted.join(
                wanted.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi",
            ).select("src", "dst", "value"),
            "matched",
        )
        if met.isEmpty():
            break
        done = met if done is None else done.unionByName(met)
        used = met.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        rest = staged(live.select("src", "dst", "value").join(met.select("src", "dst"), ["src", "dst"], "left_anti"), "edges")
        rooms = staged(room.join(used, "id", "left").select("id", (F.col("room") - F.coalesce("n", F.lit(0))).alias("room")), "rooms")
        forget(left, room)
        left, room = rest, rooms
    return done if done is not None else left.limit(0)
