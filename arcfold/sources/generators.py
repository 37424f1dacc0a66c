"""Small graphs of known shape."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arcfold.graph import Graph


def complete_graph(spark: SparkSession, n: int) -> Graph:
    """All ordered pairs of different vertices; all values 1."""
    i = spark.range(n)
    e = i.select(
        F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"),
    ) if n else spark.createDataFrame([], "src long, dst long")
    return Graph(i.withColumn("value", F.lit(1).cast("long")), e.where("src <> dst").withColumn("value", F.lit(1).cast("long")))


def grid_graph(spark: SparkSession, rows: int, cols: int) -> Graph:
    """Edges lead right and down; a vertex's value is (row, column)."""
    i = spark.range(rows * cols).withColumns({"row": F.floor(F.col("id") / cols), "col": F.col("id") % cols})
    steps = F.array_compact(F.array(F.when(F.col("row") < rows - 1, F.col("id") + cols), F.when(F.col("col") < cols - 1, F.col("id") + 1)))
    e = i.select(F.col("id").alias("src"), F.explode(steps).alias("dst"), F.lit(1).cast("long").alias("value"))
    return Graph(i.select("id", F.struct("row", "col").alias("value")), e)


def star_graph(spark: SparkSession, n: int) -> Graph:
    """Every other vertex points at vertex 0."""
    e = spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1).cast("long").alias("value"))
    return Graph(spark.range(n).withColumn("value", F.lit(1).cast("long")), e)
