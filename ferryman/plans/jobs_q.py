"""Family E queries over the ``step_events`` fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferryman.operators import jobs
from ferryman.plans.registry import query
from ferryman.session import scratch_path
from ferryman.sources import fixtures as fx
from ferryman.streaming import job_stream

_TERM = "('finished', 'failed', 'stopped')"


def ev(spark, sf):
    return fx.step_events(spark, sf)


def with_ev(body):
    return fx.with_ctes(body, "step_events")


# E1 ---------------------------------------------------------------------
@query("step_progress", with_ev("""
SELECT job_id, event_id, CAST(n AS BIGINT) AS step_no,
       CAST(least(99, floor(CAST(n AS DOUBLE) / 6 * 100)) AS INTEGER) AS progress
FROM (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM step_events)"""))
def step_progress(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.step_progress(ev(spark, sf))


# E2 ---------------------------------------------------------------------
@query("job_latest", with_ev("""
SELECT job_id, arg_max(step, (ts, event_id)) AS step, arg_max(status, (ts, event_id)) AS status,
       max(ts) AS latest_ts, CAST(count(*) AS BIGINT) AS n_events
FROM step_events GROUP BY job_id"""))
def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_latest(ev(spark, sf))


# E3 ---------------------------------------------------------------------
@query("job_outcome", with_ev(f"""
SELECT j.job_id, coalesce(t.status, 'running') AS outcome, t.ts AS decided_at
FROM (SELECT DISTINCT job_id FROM step_events) j
LEFT JOIN (SELECT job_id, arg_min(status, (ts, event_id)) AS status, min(ts) AS ts
           FROM step_events WHERE status IN {_TERM} GROUP BY job_id) t USING (job_id)"""))
def job_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_outcome(ev(spark, sf))


# E4 ---------------------------------------------------------------------
@query("job_log", with_ev("""
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS BIGINT) AS seq, ts,
       concat_ws(':', step, status) AS entry
FROM step_events"""))
def job_log(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_log(ev(spark, sf))


# E5 ---------------------------------------------------------------------
@query("step_transitions", with_ev("""
SELECT from_step, to_step, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT step AS from_step, lead(step, 1, 'END') OVER (PARTITION BY job_id ORDER BY ts, event_id) AS to_step
  FROM step_events) GROUP BY from_step, to_step"""))
def step_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.step_transitions(ev(spark, sf))


# E6 ---------------------------------------------------------------------
@query("job_state_stream", with_ev(f"""
SELECT job_id, CAST(count(*) AS BIGINT) AS n_steps, arg_max(step, (ts, event_id)) AS latest_step,
       arg_max(status, (ts, event_id)) AS latest_status,
       CAST(least(99, floor(CAST(count(*) AS DOUBLE) / 6 * 100)) AS INTEGER) AS progress,
       coalesce(arg_min(status, (ts, event_id)) FILTER (WHERE status IN {_TERM}), 'running') AS outcome
FROM step_events GROUP BY job_id"""))
def job_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    # the event files are the stream's input: laid down once per application
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = fx.written_once(spark, sf, f"step_events_{n_files}",
                          lambda p: job_stream.write_event_files(ev(spark, sf), p, n_files))
    # about four micro-batches whatever the cluster size
    return job_stream.job_state_stream(spark, src, scratch_path(spark, "job_state_out"),
                                       scratch_path(spark, "job_state_ckpt"),
                                       max_files_per_trigger=max(1, n_files // 4))
