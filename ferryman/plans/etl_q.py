"""Family F queries: ETL mapping stages on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import etl
from ferryman.plans import flagship
from ferryman.plans.registry import query
from ferryman.session import scratch_path
from ferryman.sources import fixtures as fx
from ferryman.sources.tables import table

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _t(spark, sf, name):
    return table(spark, sf, name)


# F1 ---------------------------------------------------------------------
@query("source_read", "SELECT * FROM customer")
def source_read(spark: SparkSession, sf: str) -> DataFrame:
    return etl.source_read(spark, f"{sf}/customer.parquet", CUSTOMER_SCHEMA)


# F2 ---------------------------------------------------------------------
@query("file_read", "SELECT *, false AS is_corrupt FROM customer")
def file_read(spark: SparkSession, sf: str) -> DataFrame:
    # the flat file is input: laid down once per application from ``customer``
    path = fx.written_once(spark, sf, "customer_csv", lambda p: _t(spark, sf, "customer").write
                           .option("header", True).csv(p))
    df = etl.file_read(spark, path, CUSTOMER_SCHEMA)
    return df.select(*[c for c in df.columns if c != "_corrupt_record"],
                     F.col("_corrupt_record").isNotNull().alias("is_corrupt"))


# F3 ---------------------------------------------------------------------
@query("source_qualifier", """
SELECT l_orderkey, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate
FROM lineitem""")
def source_qualifier(spark: SparkSession, sf: str) -> DataFrame:
    return etl.source_qualifier(_t(spark, sf, "lineitem"), {
        "l_orderkey": "bigint", "l_quantity": "decimal(12,2)",
        "l_extendedprice": "decimal(12,2)", "l_shipdate": "date"})


# F4 ---------------------------------------------------------------------
@query("expression", """
SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS disc_price,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(24,6)) AS charge,
  CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS return_status,
  CAST(year(l_shipdate) AS INTEGER) AS ship_year,
  coalesce(nullif(l_linestatus, 'O'), 'open') AS line_state
FROM lineitem""")
def expression(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    disc = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    out = etl.expression(li, {
        "disc_price": disc.cast("decimal(18,4)"),
        "charge": (disc * (1 + F.col("l_tax").cast("decimal(4,2)"))).cast("decimal(24,6)"),
        "return_status": F.when(F.col("l_returnflag") == "R", "returned")
        .when(F.col("l_returnflag") == "A", "accepted").otherwise("none"),
        "ship_year": F.year("l_shipdate"),
        "line_state": F.coalesce(F.nullif(F.col("l_linestatus"), F.lit("O")), F.lit("open")),
    })
    return out.select("l_orderkey", "l_linenumber", "disc_price", "charge", "return_status",
                      "ship_year", "line_state")


# F5 ---------------------------------------------------------------------
@query("filter_stage", """
SELECT * FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_stage(spark: SparkSession, sf: str) -> DataFrame:
    return etl.filter_stage(_t(spark, sf, "orders"),
                            (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'"))
                            & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


_ROUTES = [("urgent", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
           ("large", "o_totalprice > 400000"),
           ("late", "o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'")]


def _route_groups():
    return [(n, F.expr(c.replace("TIMESTAMP '", "TIMESTAMP_NTZ'"))) for n, c in _ROUTES]


# F6 ---------------------------------------------------------------------
@query("router_first", """
SELECT o_orderkey, CASE WHEN """ + _ROUTES[0][1] + """ THEN 'urgent' WHEN """ + _ROUTES[1][1] + """ THEN 'large'
  WHEN """ + _ROUTES[2][1] + """ THEN 'late' ELSE 'DEFAULT' END AS route FROM orders""")
def router_first(spark: SparkSession, sf: str) -> DataFrame:
    return etl.router_first(_t(spark, sf, "orders"), _route_groups()).select("o_orderkey", "route")


# F7 ---------------------------------------------------------------------
@query("router_multi", "\nUNION ALL\n".join(
    [f"SELECT o_orderkey, '{n}' AS route FROM orders WHERE {c}" for n, c in _ROUTES]
    + ["SELECT o_orderkey, 'DEFAULT' AS route FROM orders WHERE NOT (" +
       " OR ".join(f"({c})" for _, c in _ROUTES) + ")"]))
def router_multi(spark: SparkSession, sf: str) -> DataFrame:
    return etl.router_multi(_t(spark, sf, "orders"), _route_groups()).select("o_orderkey", "route")


# F8 ---------------------------------------------------------------------
@query("aggregator", """
SELECT l_returnflag, l_linestatus,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,4)) AS sum_disc_price,
  min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
  CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders,
  CAST(count(*) AS BIGINT) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregator(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return etl.aggregator(li, ["l_returnflag", "l_linestatus"], [
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(18,2)").alias("sum_qty"),
        F.sum(price).cast("decimal(18,2)").alias("sum_base_price"),
        F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("sum_disc_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.count_distinct("l_orderkey").alias("n_orders"),
        F.count(F.lit(1)).alias("count_order"),
    ])


# F9 ---------------------------------------------------------------------
@query("joiner_inner", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, l.l_linenumber, l.l_quantity
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def joiner_inner(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return etl.joiner(o, li, "o_orderkey", "inner")


# F10 --------------------------------------------------------------------
@query("joiner_outer", """
WITH c AS (SELECT * FROM customer WHERE c_nationkey < 5),
o AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00')
SELECT 'full_outer' AS kind, c.c_custkey, o.o_orderkey, o.o_custkey, o.o_totalprice FROM c FULL OUTER JOIN o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'left_outer', c.c_custkey, o.o_orderkey, o.o_custkey, o.o_totalprice FROM c LEFT JOIN o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'right_outer', c.c_custkey, o.o_orderkey, o.o_custkey, o.o_totalprice FROM c RIGHT JOIN o ON o.o_custkey = c.c_custkey""")
def joiner_outer(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").filter("c_nationkey < 5").select("c_custkey")
    o = _t(spark, sf, "orders").filter(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'")) \
        .select("o_orderkey", "o_custkey", "o_totalprice")
    kinds = ("full_outer", "left_outer", "right_outer")
    return etl.funnel(*[etl.joiner(c, o, c.c_custkey == o.o_custkey, k).select(F.lit(k).alias("kind"), "*") for k in kinds])


def _part_lookup_side(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    dup = p.filter("p_partkey % 7 = 0").withColumn("p_brand", F.lit("Brand#0"))
    return p.filter("p_partkey % 10 <> 0").unionByName(dup)


# F11 --------------------------------------------------------------------
@query("lookup", """
WITH lk AS (
  SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_partkey % 10 <> 0
  UNION ALL SELECT p_partkey, 'Brand#0', p_retailprice FROM part WHERE p_partkey % 7 = 0),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p_brand) AS rn FROM lk) WHERE rn = 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(f.p_brand, 'NONE') AS p_brand,
       coalesce(f.p_retailprice, 0.0) AS p_retailprice
FROM lineitem l LEFT JOIN first f ON f.p_partkey = l.l_partkey""")
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"))
    lk = _part_lookup_side(spark, sf).withColumnRenamed("p_partkey", "l_partkey")
    return etl.lookup(li, lk, ["l_partkey"], ["p_brand", "p_retailprice"],
                      order_by=[F.col("p_brand")], defaults={"p_brand": "NONE", "p_retailprice": 0.0})


# F12 --------------------------------------------------------------------
@query("lookup_unconnected", """
SELECT o.o_orderkey, o.o_orderpriority, c.c_name
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'""")
def lookup_unconnected(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = _t(spark, sf, "customer").select("c_custkey", "c_name")
    return etl.lookup_unconnected(o, c, "o_custkey", "c_custkey", ["c_name"],
                                  F.col("o_orderpriority") == "1-URGENT").drop("o_custkey")


# F13 --------------------------------------------------------------------
@query("sequence_key", """
SELECT c_custkey, c_nationkey, CAST(999 + row_number() OVER (ORDER BY c_nationkey, c_custkey) AS BIGINT) AS sk
FROM customer""")
def sequence_key(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return etl.sequence_key(c, ["c_nationkey", "c_custkey"], start=1000, name="sk")


def _cust_old(spark, sf):
    return _t(spark, sf, "customer").filter("c_custkey % 10 <> 1")


def _cust_new(spark, sf):
    c = _t(spark, sf, "customer").filter("c_custkey % 10 <> 2")
    return c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, F.col("c_acctbal") + 1)
                        .otherwise(F.col("c_acctbal")))


_OLD_SQL = "(SELECT * FROM customer WHERE c_custkey % 10 <> 1)"
_NEW_SQL = ("(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 3 THEN c_acctbal + 1 "
            "ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 2)")


# F14 --------------------------------------------------------------------
@query("update_strategy", f"""
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey,
  CASE WHEN s.c_custkey IS NOT NULL AND s.c_acctbal < 0 THEN 'REJECT'
       WHEN t.c_custkey IS NULL THEN 'INSERT' WHEN s.c_custkey IS NULL THEN 'DELETE'
       WHEN t.c_name IS NOT DISTINCT FROM s.c_name AND t.c_nationkey IS NOT DISTINCT FROM s.c_nationkey
        AND t.c_acctbal IS NOT DISTINCT FROM s.c_acctbal AND t.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment
       THEN 'UNCHANGED' ELSE 'UPDATE' END AS change_flag
FROM {_OLD_SQL} t FULL OUTER JOIN {_NEW_SQL} s ON t.c_custkey = s.c_custkey""")
def update_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return etl.update_strategy(_cust_old(spark, sf), _cust_new(spark, sf), ["c_custkey"],
                               ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                               reject=F.col("s.c_acctbal") < 0)


# F15 --------------------------------------------------------------------
@query("merge_upsert", f"""
WITH t AS {_OLD_SQL}, s AS (SELECT * FROM {_NEW_SQL} n WHERE c_custkey % 10 IN (1, 3))
SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)
UNION ALL SELECT * FROM s""")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    src = _cust_new(spark, sf).filter("c_custkey % 10 IN (1, 3)")
    return etl.merge_upsert(_cust_old(spark, sf), src, ["c_custkey"])


# F16 --------------------------------------------------------------------
@query("target_write", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')")
def target_write(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "target_write")
    o = _t(spark, sf, "orders")
    etl.target_write(o.filter("o_orderstatus = 'P'"), path, mode="overwrite")
    etl.target_write(o.filter("o_orderstatus = 'F'"), path, mode="overwrite")  # replaces the P rows
    etl.target_write(o.filter("o_orderstatus = 'O'"), path, mode="append")
    return spark.read.parquet(path)


# F17 --------------------------------------------------------------------
@query("partitioned_write", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def partitioned_write(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "partitioned_write")
    etl.target_write(_t(spark, sf, "orders"), path, partition_by=["o_orderpriority"])
    # the filter on the partition column prunes directories (PartitionFilters in the scan)
    return spark.read.parquet(path).filter(F.col("o_orderpriority") == "1-URGENT")


# F18 --------------------------------------------------------------------
@query("funnel", """
SELECT 'customer' AS kind, c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey,
       c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return etl.funnel(c, s)


# F19 --------------------------------------------------------------------
@query("sort_stage", """
SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos
FROM orders""")
def sort_stage(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return etl.sort_stage(o, ["o_orderdate", "o_orderkey"], position="pos")


# F20 --------------------------------------------------------------------
@query("row_generator", """
SELECT id, id * 2 AS even, concat('row_', CAST(id AS VARCHAR)) AS label
FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM orders) - 1)) AS id)""")
def row_generator(spark: SparkSession, sf: str) -> DataFrame:
    # the row count comes from the data (one scalar aggregate), the rows from spark.range
    n = _t(spark, sf, "orders").count()
    return etl.row_generator(spark, n, {
        "even": F.col("id") * 2, "label": F.concat(F.lit("row_"), F.col("id").cast("string"))})


# F21 --------------------------------------------------------------------
@query("fixed_value", "SELECT o_orderkey, 'LEGACY' AS src_system, 42 AS batch_id FROM orders")
def fixed_value(spark: SparkSession, sf: str) -> DataFrame:
    return etl.fixed_value(_t(spark, sf, "orders").select("o_orderkey"),
                           {"src_system": "LEGACY", "batch_id": 42})


# F22 --------------------------------------------------------------------
@query("safe_cast", """
SELECT event_id,
  TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  coalesce(TRY_CAST(event_type AS INTEGER), -1) AS event_type_code,
  coalesce(TRY_CAST(props AS INTEGER), -1) AS props_int,
  TRY_CAST(CAST(ts AS VARCHAR) AS DATE) AS ts_date
FROM events""")
def safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select("event_id",
                    etl.safe_cast(F.get_json_object("props", "$.k"), "int").alias("k"),
                    etl.safe_cast("event_type", "int", -1).alias("event_type_code"),
                    etl.safe_cast("props", "int", -1).alias("props_int"),
                    etl.safe_cast(F.substring(F.col("ts").cast("string"), 1, 10), "date").alias("ts_date"))


# F23 --------------------------------------------------------------------
@query("null_default", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'UNSPECIFIED') AS o_orderpriority FROM orders""")
def null_default(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return etl.null_default(o, {"o_orderpriority": "UNSPECIFIED"})


# F24 --------------------------------------------------------------------
@query("window_filter", """
SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn
  FROM orders) WHERE rn <= 2""")
def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return etl.window_filter(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], keep=2)


# F25 --------------------------------------------------------------------
@query("null_safe_compare", """
SELECT a.c_custkey, a.seg = b.seg AS same_plain, a.seg IS NOT DISTINCT FROM b.seg AS same_null_safe
FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) a
JOIN (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer) b ON a.c_custkey = b.c_custkey""")
def null_safe_compare(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    a = c.select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg_a"))
    b = c.select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("seg_b"))
    j = a.join(b, "c_custkey")
    return j.select("c_custkey", (F.col("seg_a") == F.col("seg_b")).alias("same_plain"),
                    etl.null_safe_equal("seg_a", "seg_b").alias("same_null_safe"))


# F26 --------------------------------------------------------------------
_STAGES = ["src", "filter", "expression", "preagg", "join_orders", "join_customer", "lookup_nation", "aggregate"]
_STAGE_SQL_FROM = {"src": "src", "filter": "filtered", "expression": "expr", "preagg": "preagg",
                   "join_orders": "j_orders", "join_customer": "j_cust", "lookup_nation": "j_cust",
                   "aggregate": "agg"}


@query("stage_counts", "WITH " + flagship.FLAGSHIP_CTES + """,
counts AS (""" + "\nUNION ALL ".join(
    f"SELECT {i} AS stage_no, '{s}' AS stage, CAST(count(*) AS BIGINT) AS rows FROM {_STAGE_SQL_FROM[s]}"
    for i, s in enumerate(_STAGES, 1)) + """)
SELECT stage_no, stage, rows, CAST(rows - lag(rows) OVER (ORDER BY stage_no) AS BIGINT) AS rows_delta FROM counts""")
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return etl.stage_counts(lambda tap: flagship.pipeline_steps(spark, sf, tap)["aggregate"])


# F27 --------------------------------------------------------------------
_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("column_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, true AS sketch_within_bound FROM lineitem" for c in _LI_COLS))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select(*_LI_COLS)
    exact = etl.column_profile(li, _LI_COLS)
    # profiles of two loads, stored and merged, against the exact counts
    path = scratch_path(spark, "profiles")
    loads = [etl.profile_sketch(li.filter(f"l_orderkey % 2 = {i}"), _LI_COLS, load=i) for i in (0, 1)]
    etl.funnel(*loads).write.parquet(path)
    merged = etl.merge_profiles(spark.read.parquet(path)).select("column_name", "distinct_estimate", F.col("null_count").alias("nulls"))
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 3 * etl.SKETCH_ERROR * F.col("distinct_count") + 1
    return exact.join(merged, "column_name").select("column_name", "null_count", "distinct_count", (near & (F.col("nulls") == F.col("null_count"))).alias("sketch_within_bound"))


# F28 --------------------------------------------------------------------
_CONTRACT = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True),
             ("o_orderpriority", "string", True), ("o_totalprice", "decimal(7,2)", False),
             ("o_orderstatus", "int", False), ("o_comment", "string", True)]


def _duck_type(t: str) -> str:
    return {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER"}.get(t, t.upper())


def _contract_sql() -> str:
    defects = ("(SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, "
               "o_totalprice, o_orderstatus FROM orders)")
    parts = []
    for name, typ, nn in _CONTRACT:
        if name == "o_comment":
            parts.append(f"SELECT '{name}' AS field, '{typ}' AS declared_type, false AS present, "
                         "CAST(NULL AS BIGINT) AS null_violations, CAST(NULL AS BIGINT) AS type_violations")
            continue
        nulls = f"count(*) - count({name})" if nn else "0"
        parts.append(
            f"SELECT '{name}' AS field, '{typ}' AS declared_type, true AS present, CAST({nulls} AS BIGINT) AS null_violations, "
            f"CAST(count(*) FILTER (WHERE {name} IS NOT NULL AND TRY_CAST(CAST({name} AS VARCHAR) AS {_duck_type(typ)}) IS NULL) AS BIGINT) AS type_violations "
            f"FROM {defects} d")
    return "\nUNION ALL\n".join(parts)


@query("contract_check", _contract_sql())
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn(
        "o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return etl.contract_check(o, _CONTRACT)


# F29 --------------------------------------------------------------------
@query("type_check", """
SELECT 'part' AS table_name, 'p_name' AS column_name, 'int' AS target_type,
       CAST(count(*) FILTER (WHERE p_name IS NOT NULL AND TRY_CAST(p_name AS INTEGER) IS NULL) AS BIGINT) AS failures FROM part
UNION ALL
SELECT 'part', 'p_size', 'int', CAST(count(*) FILTER (WHERE p_size IS NOT NULL AND TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) IS NULL) AS BIGINT) FROM part
UNION ALL
SELECT 'events', 'props', 'int', CAST(count(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS INTEGER) IS NULL) AS BIGINT) FROM events
UNION ALL
SELECT 'events', 'props.k', 'int', CAST(count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL
   AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL) AS BIGINT) FROM events""")
def type_check(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").agg(
        etl.type_fail_count("p_name", "int").alias("a"),
        etl.type_fail_count(F.col("p_size").cast("string"), "int").alias("b"))
    e = _t(spark, sf, "events").agg(
        etl.type_fail_count("props", "int").alias("a"),
        etl.type_fail_count(F.get_json_object("props", "$.k"), "int").alias("b"))

    def rows(df, tname, c1, c2):
        return df.select(F.explode(F.array(
            F.struct(F.lit(tname).alias("table_name"), F.lit(c1).alias("column_name"),
                     F.lit("int").alias("target_type"), F.col("a").cast("bigint").alias("failures")),
            F.struct(F.lit(tname).alias("table_name"), F.lit(c2).alias("column_name"),
                     F.lit("int").alias("target_type"), F.col("b").cast("bigint").alias("failures")))).alias("r")
        ).select("r.*")
    return rows(p, "part", "p_name", "p_size").unionByName(rows(e, "events", "props", "props.k"))


# F30 --------------------------------------------------------------------
@query("reject_rows", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
  CASE WHEN l_discount > 0.08 THEN 'discount_above_8pct' WHEN l_quantity > 45 THEN 'quantity_above_45'
       WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned_but_open' END AS reject_reason
FROM lineitem""")
def reject_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    out = etl.reject_rows(li, [
        ("discount_above_8pct", F.col("l_discount") > 0.08),
        ("quantity_above_45", F.col("l_quantity") > 45),
        ("returned_but_open", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
    ])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "reject_reason")


# F31 --------------------------------------------------------------------
@query("runtime_params", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderpriority = '3-MEDIUM' AND o_totalprice > 1000""")
def runtime_params(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} "
        "WHERE o_orderdate >= to_timestamp_ntz(:start) AND o_orderpriority = :prio AND o_totalprice > :floor",
        args={"start": "1998-01-01 00:00:00", "prio": "3-MEDIUM", "floor": 1000}, orders=o)


# F32 --------------------------------------------------------------------
AS_OF = "2024-06-30 12:00:00"


@query("load_timestamp", f"SELECT *, TIMESTAMP '{AS_OF}' AS load_ts FROM customer")
def load_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return etl.load_timestamp(_t(spark, sf, "customer"), AS_OF)


# F33 --------------------------------------------------------------------
_SRC_TYPES = {"l_orderkey": "NUMBER", "l_linenumber": "INTEGER", "l_quantity": "DECIMAL(12,2)",
              "l_returnflag": "CHAR(1)", "l_shipdate": "DATETIME"}


@query("type_mapping", """
SELECT CAST(CAST(l_orderkey AS VARCHAR) AS DECIMAL(38,10)) AS l_orderkey,
       CAST(CAST(l_linenumber AS VARCHAR) AS INTEGER) AS l_linenumber,
       CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(12,2)) AS l_quantity,
       CAST(l_returnflag AS VARCHAR) AS l_returnflag,
       CAST(CAST(l_shipdate AS VARCHAR) AS TIMESTAMP) AS l_shipdate
FROM lineitem""")
def type_mapping(spark: SparkSession, sf: str) -> DataFrame:
    staged = _t(spark, sf, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in _SRC_TYPES])
    return etl.type_mapping(staged, _SRC_TYPES)


# F37 --------------------------------------------------------------------
@query("hash_partition", """
SELECT l_orderkey, o_custkey, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey""")
def hash_partition(spark: SparkSession, sf: str) -> DataFrame:
    li, o = stored_by_order(spark, sf)
    # both sides lie by the key, so join and aggregate read bucket by bucket
    return li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", "o_custkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(22,2)").alias("quantity"))


def stored_by_order(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """lineitem and orders as tables bucketed by the order key, stored once an application."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = []
    for name, key, cols in (("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"]), ("orders", "o_orderkey", ["o_orderkey", "o_custkey"])):
        def write(path, name=name, key=key, cols=cols):
            table_name = "bucketed_" + path.rstrip("/").rsplit("-", 1)[-1]
            etl.bucketed_table(_t(spark, sf, name).select(*cols), table_name, path, [key], n)

        path = fx.written_once(spark, sf, f"{name}_by_order_{n}", write)
        out.append(spark.table("bucketed_" + path.rstrip("/").rsplit("-", 1)[-1]))
    return out[0], out[1]


# F38 --------------------------------------------------------------------
@query("join_hints", """
SELECT h.hint, o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
CROSS JOIN (VALUES ('broadcast'), ('shuffle_hash'), ('merge')) h(hint)""")
def join_hints(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    outs = []
    for h in ("broadcast", "shuffle_hash", "merge"):
        # a side beyond the size check is not broadcast; the label names the join that runs
        applied = "shuffle_hash" if h == "broadcast" and not _fits(c) else h
        outs.append(o.join(etl.join_hint(c, applied), "o_custkey").select(F.lit(applied).alias("hint"), "o_orderkey", "c_name"))
    return etl.funnel(*outs)


def _fits(df) -> bool:
    from ferryman.plans.sizing import fits_broadcast
    return fits_broadcast(df)
