"""Bucketed, partitioned, fixed-length and XML storage; mergeable profiles; incremental loads."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from ferryman.operators import cobol, etl, sas, xmlcat
from ferryman.operators.cobol import Field
from ferryman.plans import cobol_q, etl_q, graph_q
from ferryman.sources import fixtures as fx
from ferryman.streaming import job_stream

from .conftest import SF_SMOKE

SCHEMA = "k bigint, ts bigint, v string"


@pytest.fixture()
def small_parts(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- G11

FIRST = [(k, 10 + k % 3, f"a{k}") for k in range(40)]
SECOND = [
    (1, 12, "at the watermark"), (2, 12, "a2"),  # k 2 as it is
    (3, 30, "older"), (3, 31, "newer"), (3, 31, "newer"),  # repeated keys
    (4, 5, "late: behind the watermark"), (100, 12, "new key at the watermark"), (None, 20, "no key"), (None, 21, "no key, later"),
]
WANT = {**{k: v for k, _, v in FIRST}, 1: "at the watermark", 3: "newer", 100: "new key at the watermark", None: "no key, later"}


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_incremental_load_replaces_touched_buckets_only(spark, tmpdir_path):
    path = tmpdir_path + "/t"
    load = lambda rows: sas.incremental_load(spark, path, spark.createDataFrame(rows, SCHEMA), ["k"], "ts", n_buckets=16)
    assert load([]).count() == 0
    assert {r.k: r.v for r in load(FIRST).collect()} == {k: v for k, _, v in FIRST}
    before = files(path)
    assert {r.k: r.v for r in load(SECOND).collect()} == WANT
    changed = [1, 3, 100, None]
    buckets = {r.b for r in spark.createDataFrame([(k,) for k in changed], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).collect()}
    after = files(path)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in buckets}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not {f for f in before if f not in kept} & set(after)
    # once more: every row lies as it is, nothing is written
    assert {r.k: r.v for r in load(SECOND).collect()} == WANT
    assert files(path) == after


def test_incremental_stream_agrees_with_the_batch(spark, tmpdir_path):
    src, target = tmpdir_path + "/src", tmpdir_path + "/t"
    # the newer rows come in an earlier batch than the older ones
    for i, rows in enumerate([SECOND[2:4], FIRST, SECOND[:2] + SECOND[6:], SECOND[4:5]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/b{i}")
        job_stream.incremental_bucket_stream(spark, f"{src}/b{i}", SCHEMA, target, ["k"], "ts", f"{tmpdir_path}/c{i}", n_buckets=8)
    got = sas.bucketed_table(spark, target, spark.createDataFrame([], SCHEMA))
    assert {r.k: r.v for r in got.collect()} == WANT and got.count() == len(WANT)


# ---- F37, F17

def test_bucketed_tables_join_and_aggregate_without_exchange(spark):
    out = etl_q.hash_partition(spark, SF_SMOKE)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_a_hot_partition_value_is_written_by_several_tasks(spark, tmpdir_path):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "400k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 6).select((F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 30))).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        etl.target_write(rows, tmpdir_path + "/t", partition_by=["p"])
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    per = {os.path.basename(d): len(glob.glob(d + "/*.parquet")) for d in glob.glob(tmpdir_path + "/t/p=*")}
    assert per["p=hot"] >= 3 and len(per) == 21
    assert spark.read.parquet(tmpdir_path + "/t").count() == 60_000
    assert sum(n for d, n in per.items() if d != "p=hot") <= 60  # six tasks and 20 values: 120 files unless rebalanced


# ---- F27

def test_profiles_merge_to_the_profile_of_the_whole(spark):
    df = spark.range(0, 30_000).select(F.col("id").alias("a"), (F.col("id") % 700).alias("b"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("c"),
                                       F.lit(None).cast("date").alias("d"), F.encode(F.col("id").cast("string"), "UTF-8").alias("e"))
    stored = etl.funnel(*[etl.profile_sketch(df.filter(f"id % 3 = {i}".replace("id", "a")), load=i) for i in range(3)])
    cols = ["column_name", "n_rows", "null_count", "distinct_estimate"]
    parts = sorted(etl.merge_profiles(stored).select(cols).collect())
    assert parts == sorted(etl.merge_profiles(etl.profile_sketch(df)).select(cols).collect())
    exact = {"a": 30_000, "b": 700, "c": 24_000, "d": 0, "e": 30_000}
    for r in parts:
        assert r.n_rows == 30_000 and r.null_count == {"c": 6_000, "d": 30_000}.get(r.column_name, 0)
        assert abs(r.distinct_estimate - exact[r.column_name]) <= 3 * etl.SKETCH_ERROR * exact[r.column_name]
    plan = etl.profile_sketch(spark.read.parquet(f"{SF_SMOKE}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1


# ---- H1

def test_records_hold_line_breaks_and_are_split(spark, tmpdir_path):
    layout = [Field("name", 1, 4), Field("amount", 5, 3, "P", 2)]
    amounts = [10, -10, 1310, 12345, -131, 0, 99999]
    body = b""
    for i in range(700):
        digits = f"{abs(amounts[i % 7]):05d}" + ("D" if amounts[i % 7] < 0 else "C")
        body += f"n{i:03d}".encode("cp037") + bytes.fromhex(digits)
    for rec in (b"\n\r\n\n\x0a\x0d\x0c",):
        body += rec
    with open(tmpdir_path + "/rec", "wb") as f:
        f.write(body)
    recs = cobol.fixed_length_records(spark, tmpdir_path + "/rec", 7, max_split=7 * 100)
    assert recs.select(F.spark_partition_id().alias("p")).distinct().count() >= 7
    out = cobol.fixed_width_bytes(recs, "rec", layout, "cp037").withColumn("v", cobol.comp3_decode(F.col("amount"), 5, 2))
    got = {r.name: r.v for r in out.collect()}
    assert len(got) == 701
    assert all(int(got[f"n{i:03d}"] * 100) == amounts[i % 7] for i in range(700))
    assert {bytes(r.amount) for r in out.filter("v is null").collect()} == {b"\x0a\x0d\x0c"} or got[b"\n\r\n\n".decode("cp037")] is not None


def test_code_pages_are_those_of_python(spark):
    every = bytes(range(256))
    row = spark.createDataFrame([(bytearray(every),)], "b binary")
    for page in ("cp037", "cp500", "latin-1"):
        assert row.select(cobol.code_page_text(F.col("b"), page)).first()[0] == every.decode(page)


def test_fixture_records_are_read_by_their_length(spark):
    path = cobol_q.record_file(spark, SF_SMOKE)
    rec = cobol.fixed_length_records(spark, path, cobol_q.BINARY_LENGTH, max_split=20 * cobol_q.BINARY_LENGTH)
    assert rec.count() == fx.cobol_records(spark, SF_SMOKE).count()
    assert {len(r.rec) for r in rec.collect()} == {cobol_q.BINARY_LENGTH}


# ---- F34, F35

def test_one_export_is_split_and_equals_single_documents(spark, small_parts):
    big = graph_q.exported(spark, SF_SMOKE)
    single = xmlcat.parse_mappings(fx.mapping_xml(spark, SF_SMOKE))
    assert big.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    for form in (xmlcat.transformations, xmlcat.connectors, xmlcat.flow_order):
        assert sorted(map(str, form(big).collect())) == sorted(map(str, form(single).collect()))


def test_elements_closed_in_their_own_tag(spark, tmpdir_path):
    text = """<?xml version="1.0"?>\n<R><MAPPINGS/><MAPPING NAME="a"/>\n<MAPPING NAME='b>c'/><MAPPINGVARIABLE NAME="no"/>
<MAPPING NAME="d">\n<TRANSFORMATION NAME="é" TYPE="t"/></MAPPING><MAPPING NAME="e"></MAPPING><MAPPING/>\n</R>"""
    with open(tmpdir_path + "/x.xml", "w") as f:
        f.write(text)
    got = {r.mapping: r.m.TRANSFORMATION for r in xmlcat.read_mappings(spark, tmpdir_path + "/x.xml").collect()}
    assert set(got) == {"a", "b>c", "d", "e", None} and got["d"][0]["_NAME"] == "é"


# ---- F26

def _build(df, stop=False):
    def build(tap):
        even = tap("even", tap("src", df).filter("id % 2 = 0"))
        if stop:
            even = even.withColumn("id", F.when(F.col("id") == 10, F.raise_error(F.lit("broken off"))).otherwise(F.col("id")))
        none = tap("none", tap("tens", even.filter("id % 10 = 0")).filter("id < 0"))
        return none

    return build


def _files(folder, no):
    return sorted(glob.glob(f"{folder}/stage-{no}/part-*"))


WANT_STAGES = [(1, "src", 1000, None), (2, "even", 500, -500), (3, "tens", 100, -400), (4, "none", 0, -100)]


def _stage_rows(df):
    return [tuple(r) for r in df.orderBy("stage_no").select("stage_no", "stage", "rows", "rows_delta").collect()]


def test_stage_counts_after_a_lost_part(spark, tmpdir_path):
    """A stage that lost the output of a task is written again; the others stay as they are, and no row counts twice."""
    df = spark.range(0, 1000, 1, 5)
    assert _stage_rows(etl.stage_counts(_build(df), tmpdir_path)) == WANT_STAGES
    before = {no: _files(tmpdir_path, no) for no in (1, 2, 3)}
    ledger = spark.read.parquet(f"{tmpdir_path}/counts")
    assert ledger.filter("stage_no = 1").count() == len(before[1]) > 1
    os.remove(before[2][1])
    assert _stage_rows(etl.stage_counts(_build(df), tmpdir_path)) == WANT_STAGES
    after = {no: _files(tmpdir_path, no) for no in (1, 2, 3)}
    assert (after[1], after[3]) == (before[1], before[3]) and not set(after[2]) & set(before[2])
    # rows that stand twice, as a task's second output would, do not go unseen either
    twin = after[1][0].replace("-c000", "-c001")
    with open(after[1][0], "rb") as a, open(twin, "wb") as b:
        b.write(a.read())
    assert _stage_rows(etl.stage_counts(_build(df), tmpdir_path)) == WANT_STAGES


def test_stage_counts_go_on_after_a_run_that_broke_off(spark, tmpdir_path):
    df = spark.range(0, 1000, 1, 5)
    with pytest.raises(Exception, match="broken off"):
        etl.stage_counts(_build(df, stop=True), tmpdir_path)
    before = _files(tmpdir_path, 1), _files(tmpdir_path, 2)
    assert _stage_rows(etl.stage_counts(_build(df), tmpdir_path)) == WANT_STAGES
    assert (_files(tmpdir_path, 1), _files(tmpdir_path, 2)) == before


def test_repeated_upsert_keys_stop_without_a_window(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", None), ("w", None)], "v string, k int")
    once = etl.one_per_key(rows, ["k"])
    assert once.columns == ["v", "k"] and once.count() == 4
    assert "Window" not in once._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="duplicate source key in an upsert: k, rows: 2"):
        etl.one_per_key(rows.unionAll(rows.filter("k = 1")), ["k"]).collect()
