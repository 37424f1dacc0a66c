"""Session helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from arcfold.plans.lineage import forget, partitions, shared_dir, staged, swept

__all__ = ["forget", "partitions", "sample", "shared_dir", "staged", "swept", "tune", "without"]


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that go to Python workers by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case: an operator's own columns replace them."""
    drop = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def sample(rows: DataFrame, key: Column, size: int, *extra: Column) -> list[Row]:
    """(h, *extra) of at most `size` rows, those with the smallest hash h of the key. A first bound on the hash, set by
    the number of rows, keeps tasks from handing over more than a few rows each."""
    share = min(1.0, 8 * size / max(1, rows.count()))
    bound = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)
    hashed = rows.select(F.xxhash64(key).alias("h"), *extra)
    return hashed.where(F.col("h") <= bound).orderBy(*hashed.columns).limit(size).collect()
