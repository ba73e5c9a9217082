"""Family H queries over the ``cobol_records`` fixture (74-byte records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import cobol
from ferryman.operators.cobol import Field
from ferryman.plans.registry import query
from ferryman.session import scratch_path
from ferryman.sources import fixtures as fx

# fixed values: the record layout of the cobol_records fixture
LAYOUT = [
    Field("rec_type", 1, 1),
    Field("cust_key", 2, 8, "9"),
    Field("cust_name", 10, 20),
    Field("FILLER", 30, 3),
    Field("bal_sign", 33, 1),
    Field("balance", 34, 11, "9", 2),
    Field("open_date", 45, 8),
    Field("overlay", 53, 10),
    Field("occurs_block", 63, 12),
]


def read_records(spark: SparkSession, sf: str) -> DataFrame:
    """Read the records from a flat text file with the text source (the file
    is input, laid down once per application from the record fixture)."""
    path = fx.written_once(spark, sf, "cobol_records",
                           lambda p: fx.cobol_records(spark, sf).select("rec").write.text(p))
    return spark.read.text(path).withColumnRenamed("value", "rec")


def parsed(spark: SparkSession, sf: str, from_file: bool = False) -> DataFrame:
    src = read_records(spark, sf) if from_file else fx.cobol_records(spark, sf)
    keep = [] if from_file else ["comp3_hex"]
    return cobol.fixed_width(src, "rec", LAYOUT, keep=keep)


def _cust_key():
    return cobol.pic_numeric(F.col("cust_key"), 8, 0).cast("bigint")


# H1 ---------------------------------------------------------------------
@query("fixed_width_read", fx.with_ctes("""
SELECT substr(rec, 1, 1) AS rec_type, substr(rec, 2, 8) AS cust_key, substr(rec, 10, 20) AS cust_name,
       substr(rec, 33, 1) AS bal_sign, substr(rec, 34, 11) AS balance, substr(rec, 45, 8) AS open_date,
       substr(rec, 53, 10) AS overlay, substr(rec, 63, 12) AS occurs_block,
       CAST(try_cast(substr(rec, 34, 11) AS DECIMAL(11,0)) * CASE WHEN substr(rec, 33, 1) = '-' THEN -1 ELSE 1 END / 100 AS DECIMAL(11,2)) AS packed_balance
FROM cobol_records""", "cobol_records"))
def fixed_width_read(spark: SparkSession, sf: str) -> DataFrame:
    rec = cobol.fixed_length_records(spark, record_file(spark, sf), BINARY_LENGTH, max_split=1 << 20)
    fields = cobol.fixed_width_bytes(rec, "rec", [*LAYOUT, Field("packed", 75, 6, "P")])
    return fields.withColumn("packed_balance", cobol.comp3_decode(F.col("packed"), 11, 2)).drop("packed")


#: the text record, the balance as packed decimal, which may hold any byte, line breaks too, and a filler byte
BINARY_LENGTH = 74 + 6 + 1


def record_file(spark: SparkSession, sf: str) -> str:
    """The records as files of fixed-length binary records (input, laid down once per
    application). The text sink writes the bytes as they are; what it puts behind each value is the filler byte."""
    def write(path: str) -> None:
        recs = fx.cobol_records(spark, sf)
        packed = F.lpad(F.col("comp3_hex"), 12, "0")
        one = F.concat(F.encode("rec", "US-ASCII"), F.unhex(packed)).cast("string").alias("value")
        recs.select(one).write.option("lineSep", "~").text(path)

    return fx.written_once(spark, sf, "cobol_binary", write)


# H2 ---------------------------------------------------------------------
@query("pic_numeric", """
SELECT c_custkey AS cust_key, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(11,2)) AS balance FROM customer""")
def pic_numeric(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    return p.select(_cust_key().alias("cust_key"),
                    cobol.pic_numeric(F.col("balance"), 9, 2, sign=F.col("bal_sign")).alias("balance"))


# H3 ---------------------------------------------------------------------
@query("comp3_decode", """
SELECT c_custkey AS cust_key, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(13,2)) AS amount FROM customer""")
def comp3_decode(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    return p.select(_cust_key().alias("cust_key"),
                    cobol.comp3_decode(F.unhex("comp3_hex"), 13, 2).alias("amount"))


# H4 ---------------------------------------------------------------------
@query("cobol_date", """
SELECT c_custkey AS cust_key,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE make_date(2024, CAST(1 + c_custkey % 12 AS INTEGER), CAST(1 + c_custkey % 28 AS INTEGER)) END AS open_date
FROM customer""")
def cobol_date(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    return p.select(_cust_key().alias("cust_key"), cobol.cobol_date(F.col("open_date")).alias("open_date"))


# H5 ---------------------------------------------------------------------
@query("strip_zeros", "SELECT CAST(c_custkey AS VARCHAR) AS cust_key_text FROM customer")
def strip_zeros(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select(cobol.strip_zeros(F.col("cust_key")).alias("cust_key_text"))


# H6 ---------------------------------------------------------------------
@query("redefines", """
SELECT c_custkey AS cust_key, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS rec_type,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(c_custkey * 37 AS DECIMAL(10,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(10,4)) END AS rate_value,
  CASE WHEN c_custkey % 2 = 1 THEN rtrim(c_mktsegment) END AS segment
FROM customer""")
def redefines(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    readings = cobol.redefines(F.col("rec_type"), {
        "A": ("rate_value", cobol.pic_numeric(F.col("overlay"), 6, 4)),
        "B": ("segment", F.rtrim(F.col("overlay"))),
    })
    return p.select(_cust_key().alias("cust_key"), "rec_type",
                    *[c.alias(n) for n, c in readings.items()])


# H7 ---------------------------------------------------------------------
@query("occurs_explode", """
SELECT c_custkey AS cust_key, 1 AS idx, CAST(c_custkey % 1000 AS INTEGER) AS qty FROM customer
UNION ALL SELECT c_custkey, 2, c_nationkey FROM customer
UNION ALL SELECT c_custkey, 3, 0 FROM customer""")
def occurs_explode(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    ex = p.select(_cust_key().alias("cust_key"),
                  F.posexplode(cobol.occurs(F.col("occurs_block"), 3, 4)).alias("pos", "item"))
    return ex.select("cust_key", (F.col("pos") + 1).alias("idx"),
                     cobol.pic_numeric(F.col("item"), 4, 0).cast("int").alias("qty"))


# H8 ---------------------------------------------------------------------
@query("evaluate_case", """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 300000 THEN 'TIER1' WHEN o_totalprice > 100000 THEN 'TIER2' ELSE 'TIER3' END AS tier,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.9 AS DECIMAL(2,1)) AS DECIMAL(14,3)) AS net_price,
  o_orderstatus AS ws_status
FROM orders""")
def evaluate_case(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 300000, "TIER1").when(F.col("o_totalprice") > 100000, "TIER2")
        .otherwise("TIER3").alias("tier"),                                           # EVALUATE TRUE
        (F.col("o_totalprice").cast("decimal(12,2)") * F.lit("0.9").cast("decimal(2,1)"))
        .cast("decimal(14,3)").alias("net_price"),                                   # COMPUTE
        F.col("o_orderstatus").alias("ws_status"))                                   # MOVE


# H9 ---------------------------------------------------------------------
@query("perform_steps", """
SELECT c_custkey AS cust_key, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(11,2)) AS balance,
  c_custkey % 9 <> 0 AS date_ok,
  CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' WHEN c_custkey % 9 = 0 THEN 'BAD_DATE' ELSE 'OK' END AS status
FROM customer""")
def perform_steps(spark: SparkSession, sf: str) -> DataFrame:
    """READ -> PARSE -> VALIDATE -> COMPUTE -> WRITE, one paragraph per step."""
    read = read_records(spark, sf)                                            # 1000-READ
    parse = cobol.fixed_width(read, "rec", LAYOUT)                            # 2000-PARSE
    validate = parse.select(                                                  # 3000-VALIDATE
        _cust_key().alias("cust_key"),
        cobol.pic_numeric(F.col("balance"), 9, 2, sign=F.col("bal_sign")).alias("balance"),
        cobol.cobol_date(F.col("open_date")).isNotNull().alias("date_ok"))
    compute = validate.withColumn(                                            # 4000-COMPUTE
        "status", F.when(F.col("balance") < 0, "OVERDRAWN").when(~F.col("date_ok"), "BAD_DATE").otherwise("OK"))
    out = scratch_path(spark, "perform_steps")                                # 9000-WRITE
    compute.write.parquet(out)
    return spark.read.parquet(out)
