"""Change logs: keyed records of which the last counts, read as tables or streams, and kept as Parquet or in Kafka."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str = "offset") -> DataFrame:
    """The last record of each key; a record whose value is null deletes its key."""
    rest = [c for c in log.columns if c not in (*keys, order)]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))
    return last.where("value is not null") if "value" in rest else last


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_log(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """The files of a log folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, *, stream: bool = False, **options) -> DataFrame:
    """A topic as (key, value, offset, timestamp); needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    return reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").options(**options).load()


def kafka_sink(df: DataFrame, servers: str, topic: str) -> None:
    """(key, value) rows to a topic, with idempotent delivery."""
    out = df.select(F.to_json(F.struct("key")).alias("key"), F.to_json(F.struct("value")).alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()


def table_from_collection(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def stream_from_collection(spark: SparkSession, rows: Iterable[tuple], schema: str, path: str, *, per_batch: int = 1) -> DataFrame:
    """Rows as a stream: files of `per_batch` rows each in `path`, read in order, one a trigger."""
    rows = list(rows)
    for i in range(0, len(rows), per_batch):
        spark.createDataFrame(rows[i : i + per_batch], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def sorted_rows(table: DataFrame, key: str = "id") -> list:
    """All rows in key order, for small tables."""
    return table.orderBy(key).collect()


def map_from_table(table: DataFrame, key: str = "id", value: str = "value") -> dict:
    """The rows of a small table as a dictionary in key order; structs become dictionaries, and maps are sorted."""

    def plain(x):
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items()}
        return dict(sorted((k, plain(v)) for k, v in x.items())) if isinstance(x, dict) else x

    def hashable(x):
        return tuple(x) if hasattr(x, "asDict") else x

    return {hashable(r[key]): plain(r[value]) for r in sorted_rows(table.select(key, value), key)}


#: Settings that a session that reads logs starts from; its own win.
SESSION = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(**own: str) -> SparkSession:
    """A session with SESSION's settings, each of which `own` may override."""
    return SparkSession.builder.config(map=SESSION | own).getOrCreate()
