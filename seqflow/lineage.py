"""The scratch folder that all machines share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import seqflow

# functions travel to the executors with their code, so the library need not be installed there
cloudpickle.register_pickle_by_value(seqflow)

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where the setting is absent, a local session (tests) gets a temporary folder and any other is refused.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="seqflow-"))
    return f"{base.rstrip('/')}/seqflow-{sc.applicationId}"


#: Drops a statement's shuffle files when it ends, where else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df below scratch() and read it back: the result has no lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that cut() wrote and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            path = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName() == f"seqflow-{sc.applicationId}":
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Remove all that cut() has written for this application. Results that still read it are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
