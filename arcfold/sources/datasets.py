"""Graph views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcfold.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    schema, path = table(spark, sf_dir, name).schema, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers; an order leads from its customer to one that its key picks, with its least price."""
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    n = v.count()
    o = table(spark, sf_dir, "orders")
    e = o.select(
        F.col("o_custkey").cast("long").alias("src"), ((F.col("o_orderkey") * 7 + 3) % n).cast("long").alias("dst"),
        F.col("o_totalprice").alias("value"),
    )
    e = e.where("src <> dst").groupBy("src", "dst").agg(F.min("value").alias("value"))
    return Graph(v.withColumn("value", F.col("id")), e)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating): suppliers rate parts with a tenth of the mean quantity."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(
        F.col("l_suppkey").cast("long").alias("user"), F.col("l_partkey").cast("long").alias("item"),
    ).agg((F.avg("l_quantity") / 10).cast("float").alias("rating"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, value): customers to their suppliers (ids behind the customers'), with the summed quantity."""
    n = table(spark, sf_dir, "customer").count()
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.groupBy(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + n).cast("long").alias("dst"))
    return x.agg(F.sum("l_quantity").alias("value"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, value, ts, seq): users and the numbers in their events' properties."""
    return as_edges(table(spark, sf_dir, "events"))


def as_edges(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").cast("long").alias("src"), k.alias("dst"), "value", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, point)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))
