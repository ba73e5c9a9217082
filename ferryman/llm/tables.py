"""Written steps in the shared checkpoint folder, and the input tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ferryman.session import scratch_path
from ferryman.sources.tables import table  # noqa: F401  (re-exported for the queries)


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a finished step under ``spark.checkpoint.dir`` and read it back.

    A lost executor then costs that step's tasks only, never the ones before it.
    The shuffle files of the finished step are released.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    del df, writer
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no live frame needs; it acts on the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of written steps that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0].split("/batch=")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
