"""Tables in the shared folder that cut the lineage of loops.

A loop writes each step's state and reads it again, so its plan stays small and a lost executor costs no more than
the tasks it ran. The folder is spark.checkpoint.dir; only where that is unset and the master is local, so that driver
and executors are one machine (tests), a temporary one is used.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        path = f"file://{tempfile.gettempdir()}/arcfold-shared"
    return f"{path.rstrip('/')}/arcfold-{spark.sparkContext.applicationId}"


_WATCHED: list[list[str]] = []


@contextlib.contextmanager
def written() -> Iterator[list[str]]:
    """The names of the tables that staged() writes meanwhile."""
    names: list[str] = []
    _WATCHED.append(names)
    try:
        yield names
    finally:
        _WATCHED.remove(names)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again."""
    spark = df.sparkSession
    for names in _WATCHED:
        names.append(name)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arcfold_path = path
    return out


def measured(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict[str, Any]]:
    """staged(), and aggregates of all rows that are taken while they are written, without a job of their own."""
    seen = Observation()
    out = staged(df.observe(seen, *(c.alias(n) for n, c in aggregates.items())), name)
    return out, seen.get


def swept(df: DataFrame, name: str) -> DataFrame:
    """staged(), and lets the files of earlier shuffles go: for large steps."""
    out = staged(df, name)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables made by staged() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_arcfold_path", None):
            context = t.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
