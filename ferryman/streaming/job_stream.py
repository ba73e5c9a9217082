"""Structured Streaming forms of the job-step operators (E2, E6) and the
incremental model (G11).

Sources are file streams (parquet folders); results land in parquet folders
through ``foreachBatch`` with a checkpoint, so a restarted query resumes from
its offsets and state store instead of starting over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import sas
from ferryman.operators.jobs import job_state

EVENT_SCHEMA = "job_id bigint, event_id bigint, ts timestamp_ntz, step string, status string"


def write_event_files(ev: DataFrame, path: str, n_files: int | None = None) -> int:
    """Lay events down as parquet files, each a ts range; returns the count.

    Default: one file per shuffle partition of the session, so the write is
    as parallel as the cluster and each file a bounded slice.
    """
    spark = ev.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev.repartitionByRange(n, "ts").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return n


def job_state_stream(spark: SparkSession, src: str, out: str, checkpoint: str,
                     max_files_per_trigger: int = 2) -> DataFrame:
    """Per-job state over a stream: the batch aggregation (count, ``max_by``,
    ``min_by`` with a filter) in update mode. All of it merges in any order, so
    micro-batches out of ts order give the batch answer, and a hot job costs each
    task one partial row.

    Each micro-batch's updated states are appended to ``out`` with their
    batch id; the current state per job is the row of the latest batch.
    Runs to completion with an ``availableNow`` trigger.
    """
    ev = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
          .parquet(src))
    states = job_state(ev)

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (states.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return current_state(spark, out)


def current_state(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in ("job_id", "batch_id")]
    latest = F.max_by(F.struct(*cols), F.col("batch_id"))
    return rows.groupBy("job_id").agg(latest.alias("s")).select("job_id", "s.*")


def job_latest_stream(spark: SparkSession, src: str, out: str, checkpoint: str) -> DataFrame:
    """E2 streaming: ``groupBy(job).agg(max_by)`` in complete mode, each batch
    writing the next version of the result (one row per job) as its own folder, so
    that readers of an earlier one are not disturbed."""
    ev = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
    agg = ev.groupBy("job_id").agg(
        F.max_by(F.struct("step", "status", "ts"), F.struct("ts", "event_id")).alias("l"),
        F.count(F.lit(1)).alias("n_events"))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.select("job_id", "l.step", "l.status", F.col("l.ts").alias("latest_ts"), "n_events") \
            .write.mode("overwrite").parquet(f"{out}/v={batch_id:08d}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_version(spark, out)


def incremental_stream(spark: SparkSession, src: str, schema: str, target: str, keys: Sequence[str],
                       checkpoint: str) -> None:
    """G11 streaming form: each micro-batch is upserted into ``target`` by key.

    The target is a folder of versions: each batch writes the next version
    ``target/v=N+1`` as (version N LEFT ANTI batch) UNION ALL batch, never
    overwriting the version being read; readers take the highest committed
    version. Numbering follows the folder, not the batch id, so a restart
    with a new checkpoint continues the chain; a replayed batch re-applies an
    idempotent upsert.
    """
    stream = spark.readStream.schema(schema).parquet(src)

    def upsert(df: DataFrame, batch_id: int) -> None:
        n, prev = _versions(spark, target)
        new = df.dropDuplicates(list(keys))
        merged = new if prev is None else prev.join(new.select(*keys), list(keys), "left_anti") \
            .unionByName(new.select(*prev.columns))
        merged.write.mode("overwrite").parquet(f"{target}/v={n + 1:08d}")

    q = (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def incremental_bucket_stream(spark: SparkSession, src: str, schema: str, target: str, keys: Sequence[str], ts: str,
                              checkpoint: str, n_buckets: int = 64, order: Sequence[str] = ()) -> None:
    """G11 streaming form on a bucketed target: each micro-batch replaces the
    buckets it changes and no others; the newest row of a key wins whatever the order
    of the batches. A replayed batch finds its rows in place and writes nothing."""
    stream = spark.readStream.schema(schema).parquet(src)
    q = (stream.writeStream.foreachBatch(lambda df, _: sas.bucketed_upsert(spark, target, df, keys, ts, n_buckets, order) and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _versions(spark: SparkSession, target: str) -> tuple[int, DataFrame | None]:
    """(highest committed version number, its rows); (-1, None) when empty.

    Only folders holding ``_SUCCESS`` count, so a write cut off by a lost
    executor or driver is ignored and simply redone.
    """
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1, None
    done = sorted(
        st.getPath().getName() for st in fs.listStatus(p)
        if st.getPath().getName().startswith("v=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))
    if not done:
        return -1, None
    return int(done[-1][2:]), spark.read.parquet(f"{target}/{done[-1]}")


def latest_version(spark: SparkSession, target: str) -> DataFrame | None:
    return _versions(spark, target)[1]
