"""Tables that an estimation writes to the folder that the cluster names in spark.checkpoint.dir, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that all executors see. Where none is set, a temporary one if Spark runs on this machine alone; else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


class Run:
    """The tables that are written while it is entered: what a fit and its later requests need. cleanup() deletes them."""

    open: list[Run] = []

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Run:
        Run.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Run.open.remove(self)

    def cleanup(self) -> None:
        spark = SparkSession.getActiveSession()
        while self.paths:
            remove(spark, self.paths.pop())


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder as columns and read again: without lineage, pruned by whoever reads it, there if executors are lost."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    if Run.open:
        Run.open[-1].paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of cut() that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_cut_at", None)
        if path:
            for run in Run.open:
                if path in run.paths:
                    run.paths.remove(path)
            remove(t.sparkSession, path)
