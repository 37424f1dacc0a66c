"""Runs streams over what is there now, and gives their last result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcfold.plans.lineage import shared_dir


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream once all present input is read: of complete mode the last batch's, of append mode all
    batches'. Batches are written in the shared folder by number, so a repeated one replaces itself."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        seen.append(epoch)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    keep = seen if mode == "append" else [max(seen)]
    return spark.read.schema(stream.schema).parquet(*(f"{path}/out/epoch={e}" for e in sorted(set(keep))))


class Fold:
    """A state table folded over the batches of a stream: state := merge(state, batch). Each batch's state is a table
    of its own in `path`, made from the one before, so a repeated batch gives the same again, and a run that is started
    again in the same path goes on from there. Only the last two states are kept."""

    def __init__(self, merge: Callable[[DataFrame | None, DataFrame], DataFrame], path: str | None = None):
        self.merge, self.path = merge, path

    def _folder(self, spark: SparkSession, epoch: int):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{epoch}")
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """The state after a batch, if that is there."""
        p, files = self._folder(spark, epoch)
        return spark.read.parquet(str(p)) if epoch >= 0 and files.exists(p) else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        self.merge(self.read(spark, epoch - 1), batch).write.mode("overwrite").parquet(f"{self.path}/state-{epoch}")
        p, files = self._folder(spark, epoch - 2)
        files.delete(p, True)

    def run(self, stream: DataFrame) -> DataFrame | None:
        """The state once all present input is read; None if there was none."""
        spark = stream.sparkSession
        self.path = self.path or f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}"
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True)
        query.start().awaitTermination()
        p, files = self._folder(spark, 0)
        done = [int(f.getPath().getName()[6:]) for f in files.listStatus(p.getParent()) if f.getPath().getName().startswith("state-")] if files.exists(p.getParent()) else []
        return self.read(spark, max(done)) if done else None
