"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ferryman") -> SparkSession:
    """Build (or reuse) a session with AQE on, UI off and UTC time.

    On a cluster the master, memory and shuffle partition count come from
    spark-submit and are left alone (``getOrCreate`` would otherwise apply
    builder options to the running session). ``master`` and
    ``shuffle_partitions`` are passed by tests and the bench only. With AQE,
    a generous initial partition count is coalesced to the advisory size at
    run time, and skewed join partitions are split.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    if master:
        spark.sparkContext.setLogLevel("ERROR")
    # Folder listing of many partition directories runs as a Spark job with
    # one task per directory up to this cap (default 10 000). A few tasks per
    # core lists as fast with far less task overhead.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                   str(4 * spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3);
    it is read, never replaced. Tests and the bench run without one, and only
    then -- on a ``local`` master -- a local temp folder is used. A cluster
    without the setting is refused: a machine-local folder would leave each
    executor writing its own disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        d = tempfile.mkdtemp(prefix="ferryman-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not (hasattr(sc, "getCheckpointDir") and sc.getCheckpointDir()):
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root for sinks/streams."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/ferryman-scratch/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint root and read it back.

    Cuts lineage like ``checkpoint()`` but carries no optimizer constraints
    from the old plan (``checkpoint()`` keeps them, and Spark 4.1 fails to
    remap them through a later ``union`` of two checkpointed frames).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop FileSystem existence check (any scheme the cluster mounts)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
