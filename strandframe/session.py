"""Session helpers shared by every operator: table access and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``, optionally pruned to ``columns``."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def durable_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is configured, a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), f"strandframe-{sc.applicationId}"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and returns it with its lineage cut; partitions and their order stay.

    The files are shared by all executors, so a lost executor costs a retry and nothing else. They are deleted with the
    frame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Shelf:
    """Tables of columns written to the checkpoint folder, whose size the planner knows; ``clear`` deletes all but the kept ones.

    What is left is deleted when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, **measures: Column) -> DataFrame | tuple[DataFrame, dict]:
        """The written table; with ``measures`` also their values over its rows, taken while it is written."""
        where = f"{durable_dir(self.spark)}/table-{uuid.uuid4().hex}"
        seen = Observation() if measures else None
        (df.observe(seen, *(c.alias(n) for n, c in measures.items())) if measures else df).write.option("compression", "zstd").parquet(where)
        system, path = _path(self.spark, where)
        system.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(where)
        self.paths[where] = out
        return (out, seen.get) if measures else out

    def where(self, df: DataFrame) -> str:
        return next(w for w, x in self.paths.items() if x is df)

    def read(self, *frames: DataFrame) -> DataFrame:
        """Several written tables of one form as one."""
        return self.spark.read.schema(frames[0].schema).parquet(*(self.where(x) for x in frames))

    def clear(self, *kept: DataFrame) -> None:
        for where, x in list(self.paths.items()):
            if not any(x is k for k in kept):
                system, path = _path(self.spark, where)
                system.delete(path, True)
                del self.paths[where]


def stored(df: DataFrame) -> DataFrame:
    """A written table of its own, which stays until the session's JVM ends."""
    return Shelf(df.sparkSession).put(df)


def rows_of(condition: str | None = None) -> Column:
    """A measure: the number of rows, or of those that meet a condition."""
    return F.count(F.lit(1)) if condition is None else F.count(F.when(F.expr(condition), 1))
