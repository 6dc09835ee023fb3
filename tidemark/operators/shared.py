"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, but only if all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes what kept() wrote for this application. Results that read it are to be stored before."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kept/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
