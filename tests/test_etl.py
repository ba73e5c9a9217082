"""Invariants of the ETL catalogue (F) that an oracle row count cannot show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferryman.operators import etl
from ferryman.plans.sizing import fits_broadcast, maybe_broadcast
from ferryman.sources.tables import table

from .conftest import SF_CHECK


def test_sequence_key_dense_across_partitions(spark):
    df = spark.range(0, 5000).withColumn("g", F.col("id") % 7).repartition(13)
    out = etl.sequence_key(df, ["g", "id"], start=100, name="sk")
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy("g", "id")) + 99)
    bad = out.join(ref, ["id", "g"]).filter(F.col("sk") != F.col("ref")).count()
    assert bad == 0
    assert out.agg(F.min("sk"), F.max("sk"), F.count_distinct("sk")).first() == (100, 5099, 5000)


def test_hash_partition_keeps_each_key_in_one_partition(spark):
    li = table(spark, SF_CHECK, "lineitem").select("l_orderkey")
    p = etl.hash_partition(li, 8, ["l_orderkey"]).withColumn("pid", F.spark_partition_id())
    assert p.groupBy("l_orderkey").agg(F.count_distinct("pid").alias("n")).filter("n > 1").count() == 0
    assert p.select("pid").distinct().count() > 1


def test_lookup_many_matches_take_lowest_and_default(spark):
    src = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    lk = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z")], "k int, v string")
    out = dict(etl.lookup(src, lk, ["k"], ["v"], order_by=[F.col("v")], defaults={"v": "NONE"}).collect())
    assert out == {1: "a", 2: "z", 3: "NONE"}


def test_update_strategy_flags(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (3, None), (4, "d"), (2, "B")], "k int, v string")
    out = dict(etl.update_strategy(t, s, ["k"], ["v"]).collect())
    assert out == {1: "UNCHANGED", 2: "UPDATE", 3: "UNCHANGED", 4: "INSERT"}
    s2 = spark.createDataFrame([(1, "a")], "k int, v string")
    assert dict(etl.update_strategy(t, s2, ["k"], ["v"]).collect())[2] == "DELETE"


def test_merge_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(etl.merge_upsert(t, s, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_router_multi_default(spark):
    df = spark.createDataFrame([(1,), (5,), (20,)], "x int")
    out = sorted(etl.router_multi(df, [("small", F.col("x") < 10), ("odd", F.col("x") % 2 == 1)]).collect())
    assert out == [(1, "odd"), (1, "small"), (5, "odd"), (5, "small"), (20, "DEFAULT")]


def test_broadcast_only_behind_size_check(spark):
    # a parquet scan has a file-size estimate; a Python-list frame has none
    # (Long.MaxValue) and must never pass the check
    small = table(spark, SF_CHECK, "nation")
    big = table(spark, SF_CHECK, "lineitem")
    assert fits_broadcast(small)
    assert not fits_broadcast(spark.createDataFrame([(1, "x")], "k int, v string"))
    assert not fits_broadcast(big, max_bytes=1024)
    plan = maybe_broadcast(big, max_bytes=1024)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_partitioned_write_prunes(spark, tmpdir_path):
    o = table(spark, SF_CHECK, "orders")
    etl.target_write(o, tmpdir_path + "/o", partition_by=["o_orderpriority"])
    df = spark.read.parquet(tmpdir_path + "/o").filter(F.col("o_orderpriority") == "1-URGENT")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderpriority" in plan
    assert df.count() == o.filter(F.col("o_orderpriority") == "1-URGENT").count()


def test_contract_check_missing_field(spark):
    df = spark.createDataFrame([(1, "x"), (None, "2")], "a int, b string")
    out = {r.field: r for r in etl.contract_check(df, [("a", "int", True), ("b", "int", False),
                                                       ("c", "string", True)]).collect()}
    assert out["a"].null_violations == 1 and out["b"].type_violations == 1
    assert out["c"].present is False


def test_type_mapping_keeps_decimal_scale_drops_char_length(spark):
    df = spark.createDataFrame([("12.345", "ab")], "x string, y string")
    out = etl.type_mapping(df, {"x": "DECIMAL(10,3)", "y": "CHAR(2)"})
    assert dict(out.dtypes) == {"x": "decimal(10,3)", "y": "string"}


def test_keyed_row_number_matches_window_and_splits_hot_key(spark):
    # one key holds most rows; a null key is numbered like any other
    rows = [(1, i, i * 7 % 1000) for i in range(3000)] + [(k, i, i) for k in range(2, 60) for i in range(5)] \
        + [(None, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, id int, v int").repartition(6)
    got = etl.keyed_row_number(df, ["k"], ["v", "id"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    def key(r):
        return (r.k is None, r.k or 0, r.id, r.v, r.rn)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    # AQE would coalesce this tiny input into one partition; at scale it only
    # merges up to the advisory size, so look at the ranges themselves
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = df.repartitionByRange("k", "v", "id").withColumn("p", F.spark_partition_id()) \
            .filter("k = 1").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1


def test_range_numbering_exact_when_bounds_are_sampled(spark):
    # enough rows that range partitioning samples instead of seeing every key:
    # the numbered frame must be computed once, or counts and rows disagree
    n = 300_000
    df = spark.range(0, n).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("hot")) \
        .withColumn("k", F.when(F.col("hot") == 1, F.lit(0)).otherwise(F.col("id") % 97)).repartition(16)
    sk = etl.sequence_key(df.select("id"), ["id"], start=1, name="sk")
    assert sk.filter(F.col("sk") != F.col("id") + 1).count() == 0
    rn = etl.keyed_row_number(df.select("k", "id"), ["k"], ["id"], "rn")
    ref = df.select("k", "id").withColumn("ref", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert rn.join(ref, ["k", "id"]).filter(F.col("rn") != F.col("ref")).count() == 0
    assert rn.count() == n


def test_reject_split_and_sort_within(spark):
    df = spark.createDataFrame([(3, None), (1, "bad qty"), (2, None)], "k int, reject_reason string")
    assert sorted(r.k for r in etl.good_rows(df).collect()) == [2, 3]
    assert [r.k for r in etl.error_rows(df).collect()] == [1]
    s = etl.sort_within(df.coalesce(1), ["k"])
    assert [r.k for r in s.collect()] == [1, 2, 3]


def test_literal_table_binds_values_and_has_a_size(spark):
    from ferryman.plans.sizing import estimated_bytes
    from ferryman.sources.tables import literal_table
    rows = [("it's", "x'); DROP TABLE t; --"), ("a\nb", "")]
    t = literal_table(spark, rows, ["start", "label"])
    assert sorted(tuple(r) for r in t.collect()) == sorted(rows)
    assert estimated_bytes(t) < 10_000          # a local relation, not an RDD of unknown size


def test_get_spark_leaves_a_running_session_partitions_alone(spark):
    from ferryman.session import get_spark
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        s = get_spark()                      # as on a cluster: no master passed
        assert s.conf.get("spark.sql.shuffle.partitions") == "13"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_null_keys_are_flagged_by_their_side(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k bigint, v string")
    s = spark.createDataFrame([(1, "x"), (None, "c"), (2, "d")], "k bigint, v string")
    got = sorted((r.k or 0, r.change_flag) for r in etl.update_strategy(t, s, ["k"], ["v"]).collect())
    assert got == [(0, "DELETE"), (0, "INSERT"), (1, "UPDATE"), (2, "INSERT")]


def test_upsert_takes_the_newest_or_rejects_duplicate_keys(spark):
    import pytest
    t = spark.createDataFrame([(1, "a", 0), (3, "z", 0)], "k bigint, v string, at bigint")
    s = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k bigint, v string, at bigint")
    got = sorted(tuple(r) for r in etl.merge_upsert(t, s, ["k"], newest=["at"]).collect())
    assert got == [(1, "c", 2), (2, "d", 1), (3, "z", 0)]
    with pytest.raises(Exception, match="duplicate source key"):
        etl.merge_upsert(t, s, ["k"]).collect()


def test_scan_skips_runs_of_delimiters(spark):
    from ferryman.operators import sas
    df = spark.createDataFrame([("a  b c",), ("  x",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(sas.scan(F.col("s"), 2), sas.scan(F.col("s"), -1)).collect()]
    assert got == [("b", "c"), ("", "x"), ("", ""), (None, None)]


def test_csv_keeps_empty_strings_and_nulls_apart(spark, tmpdir_path):
    from ferryman.operators import corpus
    rows = [("", "y", 1), (None, "\\N", None), ("a\"b", "c\nd", 2)]
    schema = "a string, b string, n bigint"
    corpus.write_csv_all_quoted(spark.createDataFrame(rows, schema).coalesce(1), tmpdir_path + "/csv")
    got = [tuple(r) for r in corpus.read_csv_all_quoted(spark, tmpdir_path + "/csv", schema).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
