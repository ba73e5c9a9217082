"""Stream = batch parity (E2, E6, G11) and graph ordering / cycles (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryman.operators import graph, jobs
from ferryman.sources import fixtures as fx
from ferryman.streaming import job_stream

from .conftest import SF_SMOKE


def test_job_state_stream_equals_batch(spark, tmpdir_path):
    ev = fx.step_events(spark, SF_SMOKE)
    src = tmpdir_path + "/src"
    job_stream.write_event_files(ev, src, n_files=6)
    stream = job_stream.job_state_stream(spark, src, tmpdir_path + "/out", tmpdir_path + "/ckpt",
                                         max_files_per_trigger=1)
    batch = jobs.job_state(ev)
    cols = ["job_id", "n_steps", "latest_step", "latest_status", "progress", "outcome"]
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_job_latest_stream_equals_batch(spark, tmpdir_path):
    ev = fx.step_events(spark, SF_SMOKE)
    job_stream.write_event_files(ev, tmpdir_path + "/src", n_files=4)
    s = job_stream.job_latest_stream(spark, tmpdir_path + "/src", tmpdir_path + "/out", tmpdir_path + "/ckpt")
    b = jobs.job_latest(ev)
    assert sorted(s.collect()) == sorted(b.select(*s.columns).collect())


def test_stop_stays_stopped(spark):
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "validate", "stopped"),
                                (1, 2, "2024-01-01 00:01:00", "feedback", "failed"),
                                (2, 3, "2024-01-01 00:00:00", "parse", "running")],
                               "job_id bigint, event_id bigint, ts string, step string, status string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = {r.job_id: r.outcome for r in jobs.job_outcome(ev).collect()}
    assert out == {1: "stopped", 2: "running"}


def test_incremental_stream_upserts(spark, tmpdir_path):
    schema = "k bigint, v string"
    src = tmpdir_path + "/in"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src + "/p1")
    job_stream.incremental_stream(spark, src + "/p1", schema, tmpdir_path + "/t", ["k"], tmpdir_path + "/c1")
    spark.createDataFrame([(2, "B"), (3, "c")], schema).write.parquet(src + "/p2")
    job_stream.incremental_stream(spark, src + "/p2", schema, tmpdir_path + "/t", ["k"], tmpdir_path + "/c2")
    got = sorted(job_stream.latest_version(spark, tmpdir_path + "/t").collect())
    assert got == [(1, "a"), (2, "B"), (3, "c")]


def test_macro_edges_substring_semantics(spark):
    ch = spark.createDataFrame([
        (1, 1, "%MACRO foo;\n%MEND;"),
        (1, 2, "x%foobar;"),          # '%foo' is a substring of '%foobar' (kept as specified)
        (1, 3, "%FOO;"),              # case-sensitive: no edge
        (1, 4, "%macro bar; %mend;"),  # lower-case %macro does not define
        (1, 5, "call %foo;")], "script_id bigint, seq int, code string")
    defs = graph.macro_defs(ch)
    assert [r.name for r in defs.collect()] == ["foo"]
    edges = sorted((r.src, r.dst) for r in graph.macro_edges(ch, defs).collect())
    assert edges == [(1, 2), (1, 5)]


def test_peel_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(1, 7)], "g bigint, node int")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 4, 5), (1, 5, 4), (1, 5, 6)],
                                  "g bigint, src int, dst int")
    lv = {r.node: r.level for r in graph.peel_levels(nodes, edges, "g").collect()}
    assert lv == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    assert sorted(r.node for r in graph.cycle_report(graph.peel_levels(nodes, edges, "g"), "g").collect()) == [4, 5, 6]


def test_lineage_closure(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d")], "g bigint, src string, dst string")
    got = {(r.up, r.node) for r in graph.lineage_closure(e, "g").collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}


def test_macro_names_take_unicode_word_characters(spark):
    # Python's \w includes non-ASCII letters: %fooé is its own macro, not %foo
    ch = spark.createDataFrame([
        (1, 1, "%MACRO fooé;\n%MEND;"),
        (1, 2, "call %fooé;"),
        (1, 3, "call %foo;")], "script_id bigint, seq int, code string")
    defs = graph.macro_defs(ch)
    assert [r.name for r in defs.collect()] == ["fooé"]
    assert sorted((r.src, r.dst) for r in graph.macro_edges(ch, defs).collect()) == [(1, 2)]
