"""Job-step events (family E), batch form.

Events are ``(job_id, event_id, ts, step, status)``; the event order within a
job is ``(ts, event_id)``. Per-job aggregates use ``max_by``/``min_by`` in
one hash aggregation (partial aggregation map-side, so a hot job costs one
small partial row per task, not a skewed shuffle). Per-event positions use
``keyed_row_number`` (range-partitioned), never a window hashed on the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryman.operators.etl import keyed_row_number

# fixed values: progress denominator and cap of the runner, terminal statuses
TOTAL_STEPS = 6
PROGRESS_CAP = 99
TERMINAL = ["finished", "failed", "stopped"]


def _order() -> Column:
    return F.struct("ts", "event_id")


def progress(n: Column) -> Column:
    """E1 formula: ``min(99, floor(n / 6 * 100))``."""
    return F.least(F.lit(PROGRESS_CAP), F.floor(n / F.lit(TOTAL_STEPS) * 100)).cast("int")


def step_progress(ev: DataFrame) -> DataFrame:
    """Progress after each job's n-th step."""
    n = keyed_row_number(ev.select("job_id", "event_id", "ts"), ["job_id"], ["ts", "event_id"], "step_no")
    return n.withColumn("progress", progress(F.col("step_no"))) \
        .select("job_id", "event_id", "step_no", "progress")


def job_latest(ev: DataFrame) -> DataFrame:
    """Newest step/status per job, and the number of events so far."""
    latest = F.max_by(F.struct("step", "status", "ts"), _order())
    return ev.groupBy("job_id").agg(latest.alias("l"), F.count(F.lit(1)).alias("n_events")) \
        .select("job_id", "l.step", "l.status", F.col("l.ts").alias("latest_ts"), "n_events")


def job_outcome(ev: DataFrame) -> DataFrame:
    """The first terminal event decides (finished/failed/stopped); none -> running.
    A stop stays ``stopped``. One aggregation with a FILTER clause, no join."""
    first_term = F.expr(
        "min_by(named_struct('status', status, 'ts', ts), named_struct('ts', ts, 'event_id', event_id)) "
        f"FILTER (WHERE status IN ({', '.join(repr(t) for t in TERMINAL)}))")
    g = ev.groupBy("job_id").agg(first_term.alias("t"))
    return g.select("job_id", F.coalesce(F.col("t.status"), F.lit("running")).alias("outcome"),
                    F.col("t.ts").alias("decided_at"))


def job_log(ev: DataFrame, sep: str = ":") -> DataFrame:
    """The ordered, append-only log as rows ``(job_id, seq, entry)``.

    Kept as rows rather than one string per job, so a very large job never
    becomes one value; ``job_log_text`` folds it when a single text is wanted.
    """
    e = ev.select("job_id", "event_id", "ts", F.concat_ws(sep, "step", "status").alias("entry"))
    return keyed_row_number(e, ["job_id"], ["ts", "event_id"], "seq").select("job_id", "seq", "ts", "entry")


def job_log_text(ev: DataFrame, sep: str = ":", joiner: str = " > ") -> DataFrame:
    """E4 as one text per job (``listagg ... WITHIN GROUP``); bounded jobs only."""
    return ev.groupBy("job_id").agg(F.expr(
        f"listagg(concat_ws('{sep}', step, status), '{joiner}') WITHIN GROUP (ORDER BY ts, event_id)").alias("log"))


def step_transitions(ev: DataFrame, end: str = "END") -> DataFrame:
    """E5: counts of step -> next step per job trace (last step -> END).

    ``lead`` as an equi-join of each event to the one numbered after it on
    (job, seq): that pair is unique, so a hot job spreads evenly.
    """
    n = keyed_row_number(ev.select("job_id", "event_id", "ts", "step"), ["job_id"], ["ts", "event_id"], "seq")
    nxt = n.select("job_id", (F.col("seq") - 1).alias("seq"), F.col("step").alias("to_step"))
    t = n.join(nxt, ["job_id", "seq"], "left").select(
        F.col("step").alias("from_step"), F.coalesce(F.col("to_step"), F.lit(end)).alias("to_step"))
    return t.groupBy("from_step", "to_step").agg(F.count(F.lit(1)).alias("n"))


def job_state(ev: DataFrame) -> DataFrame:
    """E1+E2+E3 in one aggregation: the batch twin of the streaming state."""
    latest = F.max_by(F.struct("step", "status"), _order())
    first_term = F.expr(
        "min_by(status, named_struct('ts', ts, 'event_id', event_id)) "
        f"FILTER (WHERE status IN ({', '.join(repr(t) for t in TERMINAL)}))")
    g = ev.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_steps"), latest.alias("l"), first_term.alias("t"))
    return g.select("job_id", "n_steps", F.col("l.step").alias("latest_step"),
                    F.col("l.status").alias("latest_status"), progress(F.col("n_steps")).alias("progress"),
                    F.coalesce(F.col("t"), F.lit("running")).alias("outcome"))
