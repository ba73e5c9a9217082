"""Family G queries: SAS steps and dbt-style models/tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import etl, sas
from ferryman.plans.registry import query
from ferryman.session import scratch_path
from ferryman.sources.tables import literal_table, table


# G1 ---------------------------------------------------------------------
@query("data_step_set", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, NULL AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def data_step_set(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    b = o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                "o_orderpriority")
    return sas.data_step_set(a, b)  # SET a b; b's extra variable is missing in a's rows


# G2 ---------------------------------------------------------------------
@query("keep_drop_rename", "SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def keep_drop_rename(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    c = sas.keep(c, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    c = sas.drop(c, ["c_name"])
    return sas.rename(c, {"c_acctbal": "balance", "c_mktsegment": "segment"})


# G3 ---------------------------------------------------------------------
@query("where_if", """
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_discount >= 0.07 THEN 'deep' WHEN l_discount >= 0.03 THEN 'some' ELSE 'none' END AS tier
FROM lineitem WHERE l_quantity > 10""")
def where_if(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = sas.where_if(li, F.col("l_quantity") > 10, "tier",
                       [(F.col("l_discount") >= 0.07, "deep"), (F.col("l_discount") >= 0.03, "some")], "none")
    return out.drop("l_discount")


# G4 ---------------------------------------------------------------------
@query("proc_sql", """
SELECT c.c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'O' GROUP BY c.c_mktsegment""")
def proc_sql(spark: SparkSession, sf: str) -> DataFrame:
    return sas.proc_sql(spark, """
        SELECT c.c_mktsegment, count(*) AS n_orders,
               CAST(sum(CAST(o.o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        WHERE o.o_orderstatus = 'O' GROUP BY c.c_mktsegment""",
                        orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))


# G5 ---------------------------------------------------------------------
@query("proc_sort", """
SELECT s_suppkey, s_nationkey, s_acctbal,
       CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS BIGINT) AS pos
FROM supplier""")
def proc_sort(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return etl.sort_stage(s, [F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_suppkey")], "pos")


# G6 ---------------------------------------------------------------------
@query("transpose_wide", """
SELECT o_custkey,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_F,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_O,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS n_P
FROM orders GROUP BY o_custkey""")
def transpose_wide(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return sas.transpose_wide(o, ["o_custkey"], "o_orderstatus", ["F", "O", "P"],
                              F.count(F.lit(1)), prefix="n_", fill=0)


# G7 ---------------------------------------------------------------------
@query("transpose_long", """
SELECT p_partkey, 'p_size' AS _name_, CAST(p_size AS DOUBLE) AS col1 FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def transpose_long(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return sas.transpose_long(p, ["p_partkey"], ["p_size", "p_retailprice"], cast="double")


# G8 ---------------------------------------------------------------------
_BAL_RANGES = [(None, 0.0, "NEGATIVE"), (0.0, 1000.0, "LOW"), (1000.0, 5000.0, "MID"), (5000.0, None, "HIGH")]


@query("proc_format_case", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN 'LOW'
  WHEN c_acctbal >= 1000 AND c_acctbal < 5000 THEN 'MID' WHEN c_acctbal >= 5000 THEN 'HIGH' ELSE 'OTHER' END AS bal_band
FROM customer""")
def proc_format_case(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", sas.proc_format_case(F.col("c_acctbal"), _BAL_RANGES).alias("bal_band"))


# G9 ---------------------------------------------------------------------
_PRIO_FMT = [("1-URGENT", "P1"), ("2-HIGH", "P2"), ("3-MEDIUM", "P3"), ("5-LOW", "P5")]


@query("proc_format_table", """
SELECT o.o_orderkey, coalesce(f.label, 'OTHER') AS prio_label
FROM orders o LEFT JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _PRIO_FMT) + """) f(start, label)
  ON f.start = o.o_orderpriority""")
def proc_format_table(spark: SparkSession, sf: str) -> DataFrame:
    fmt = literal_table(spark, _PRIO_FMT, ["start", "label"])
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sas.proc_format_table(o, "o_orderpriority", fmt, out="prio_label").drop("o_orderpriority")


# G10 --------------------------------------------------------------------
@query("sas_scalars", """
SELECT o_orderkey,
  CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS intnx_month,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS intck_day,
  CAST(year(o_orderdate) AS INTEGER) AS yr,
  substring(o_orderpriority, 3) AS substr_prio,
  split_part(o_orderpriority, '-', 2) AS scan_prio,
  regexp_replace(o_orderpriority, '[- ]', '', 'g') AS compress_prio,
  concat_ws('|', o_orderstatus, o_orderpriority) AS catx_flags,
  CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.001 AS DECIMAL(4,3)), 1) AS DECIMAL(12,1)) AS k_price
FROM orders""")
def sas_scalars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select(
        "o_orderkey",
        sas.intnx_month(d, 1).alias("intnx_month"),
        sas.intck_day(d, F.lit("2002-01-01").cast("date")).alias("intck_day"),
        F.year(d).alias("yr"),
        F.substring("o_orderpriority", 3, 1 << 30).alias("substr_prio"),
        sas.scan(F.col("o_orderpriority"), 2, "-").alias("scan_prio"),
        sas.compress(F.col("o_orderpriority"), "- ").alias("compress_prio"),
        sas.catx("|", F.col("o_orderstatus"), F.col("o_orderpriority")).alias("catx_flags"),
        F.round(F.col("o_totalprice").cast("decimal(12,2)") * F.lit(0.001).cast("decimal(4,3)"), 1)
        .cast("decimal(12,1)").alias("k_price"),
    )


# G11 --------------------------------------------------------------------
_INITIAL_CUTOFF = "2024-01-10 00:00:00"
_G11_COLS = ["event_id", "ts", "user_id", "value"]
#: the second load: all events again, changed ones (each 14th twice, the later one counts), and late rows behind the watermark
_G11_SECOND = """
SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-09 00:00:00'
UNION ALL SELECT event_id, ts + INTERVAL '40' DAY, user_id, value + 1 FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, ts + INTERVAL '41' DAY, user_id, value + 2 FROM events WHERE event_id % 14 = 0
UNION ALL SELECT event_id, ts - INTERVAL '40' DAY, user_id, value + 3 FROM events WHERE event_id % 5 = 0"""


@query("incremental_model", f"""
WITH first AS (SELECT event_id, ts, user_id, value FROM events WHERE ts < TIMESTAMP '{_INITIAL_CUTOFF}'),
loads AS (
  SELECT *, 0 AS load_no FROM first
  UNION ALL SELECT *, 1 FROM ({_G11_SECOND}) WHERE ts >= (SELECT max(ts) FROM first))
SELECT event_id, ts, user_id, value FROM loads
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, load_no DESC, value DESC) = 1""")
def incremental_model(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(*_G11_COLS)
    path, n = scratch_path(spark, "incremental"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sas.incremental_load(spark, path, ev.filter(F.expr(f"ts < TIMESTAMP_NTZ'{_INITIAL_CUTOFF}'")), ["event_id"], "ts", n)
    second = spark.sql(_G11_SECOND.replace("FROM events", "FROM {ev}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), ev=ev)
    return sas.incremental_load(spark, path, second, ["event_id"], "ts", n)


# G12 --------------------------------------------------------------------
@query("step_models", """
WITH stg_part AS (SELECT p_partkey, p_brand FROM part),
stg_lines AS (SELECT l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS qty FROM lineitem WHERE l_returnflag <> 'R'),
int_lines AS (SELECT s.*, p.p_brand FROM stg_lines s JOIN stg_part p ON p.p_partkey = s.l_partkey)
SELECT p_brand, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(qty) AS DECIMAL(18,2)) AS qty
FROM int_lines GROUP BY p_brand""")
def step_models(spark: SparkSession, sf: str) -> DataFrame:
    stg_part = table(spark, sf, "part").select("p_partkey", "p_brand")
    stg_lines = spark.sql("SELECT l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS qty FROM {li} "
                          "WHERE l_returnflag <> 'R'", li=table(spark, sf, "lineitem"))
    int_lines = spark.sql("SELECT s.*, p.p_brand FROM {s} s JOIN {p} p ON p.p_partkey = s.l_partkey",
                          s=stg_lines, p=stg_part)
    return spark.sql("SELECT p_brand, count(*) AS n_lines, CAST(sum(qty) AS DECIMAL(18,2)) AS qty "
                     "FROM {i} GROUP BY p_brand", i=int_lines)


# G13 --------------------------------------------------------------------
@query("test_not_null", """
SELECT 'o_orderpriority' AS column_name, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS failures FROM orders
UNION ALL
SELECT 'o_custkey', CAST(count(*) FILTER (WHERE o_custkey % 50 = 0) AS BIGINT) FROM orders
UNION ALL
SELECT 'o_orderkey', CAST(0 AS BIGINT)""")
def test_not_null(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"))
    return sas.test_not_null(o, ["o_orderpriority", "o_custkey", "o_orderkey"])


# G14 --------------------------------------------------------------------
@query("test_unique", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def test_unique(spark: SparkSession, sf: str) -> DataFrame:
    return sas.test_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# G15 --------------------------------------------------------------------
@query("test_accepted_values", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_rows FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_orderpriority""")
def test_accepted_values(spark: SparkSession, sf: str) -> DataFrame:
    return sas.test_accepted_values(table(spark, sf, "orders"), "o_orderpriority",
                                    ["1-URGENT", "2-HIGH", "3-MEDIUM"])


# G16 --------------------------------------------------------------------
@query("test_relationships", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)""")
def test_relationships(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parent = table(spark, sf, "orders").filter("o_orderkey % 10 <> 0")
    return sas.test_relationships(li, parent, "l_orderkey", "o_orderkey")
