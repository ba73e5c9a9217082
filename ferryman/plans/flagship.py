"""F39 staged_pipeline: the flagship, one named step per stage.

src(lineitem) -> filter -> expression(net price, quantity band)
  -> pre-aggregate per (order, band)       [shrinks the big side before any shuffle]
  -> join orders (custkey) -> join customer (nationkey)
  -> lookup nation (checked-size broadcast) -> aggregate -> target.

Money is computed in DECIMAL so sums are exact and order-independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import etl
from ferryman.plans.registry import query
from ferryman.sources.tables import table

SHIP_CUTOFF = "2000-01-01 00:00:00"


def _net_price() -> F.Column:
    return (F.col("l_extendedprice").cast("decimal(12,2)")
            * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))


BANDS = ("small", "medium", "large")


def _band() -> F.Column:
    q = F.col("l_quantity")
    return F.when(q < 10, "small").when(q < 30, "medium").otherwise("large")


class _Steps(dict):
    """Named steps; every assignment passes through ``tap`` (identity unless
    a caller writes and counts the steps, F26), so later steps build on the tapped one."""

    def __init__(self, tap):
        super().__init__()
        self._tap = tap

    def __setitem__(self, name: str, df: DataFrame) -> None:
        super().__setitem__(name, self._tap(name, df) if self._tap else df)


def pipeline_steps(spark: SparkSession, sf_dir: str, tap=None) -> dict[str, DataFrame]:
    steps: dict[str, DataFrame] = _Steps(tap)
    steps["src"] = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    steps["filter"] = etl.filter_stage(
        steps["src"], F.col("l_shipdate") < F.expr(f"TIMESTAMP_NTZ'{SHIP_CUTOFF}'"))
    steps["expression"] = etl.expression(steps["filter"], {
        "net_price": _net_price(), "qty_band": _band(),
        "qty": F.col("l_quantity").cast("decimal(12,2)")})
    # Aggregate before the big joins: rows per (order, band) instead of per line.
    # Grouped on l_orderkey alone (one conditional aggregate per band, then the
    # bands unfolded), so the result stays hash-partitioned on l_orderkey and a
    # sort-merge join with orders at scale reuses it instead of shuffling again.
    e, band_aggs = steps["expression"], []
    for b in BANDS:
        m = F.col("qty_band") == b
        band_aggs += [F.count_if(m).cast("bigint").alias(f"n_{b}"),
                      F.sum(F.when(m, F.col("qty"))).alias(f"q_{b}"),
                      F.sum(F.when(m, F.col("net_price"))).alias(f"v_{b}")]
    per_order = e.groupBy("l_orderkey").agg(*band_aggs)
    unfolded = per_order.select("l_orderkey", F.inline(F.array(*[
        F.struct(F.lit(b).alias("qty_band"), F.col(f"n_{b}").alias("n_lines"),
                 F.col(f"q_{b}").alias("qty"), F.col(f"v_{b}").alias("net")) for b in BANDS])))
    steps["preagg"] = unfolded.filter(F.col("n_lines") > 0)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    steps["join_orders"] = etl.joiner(steps["preagg"], orders, "l_orderkey", "inner")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    steps["join_customer"] = etl.joiner(steps["join_orders"], cust, "o_custkey", "inner")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name")
    steps["lookup_nation"] = etl.lookup(steps["join_customer"], nation, ["c_nationkey"],
                                        ["n_name"], defaults={"n_name": "UNKNOWN"})
    steps["aggregate"] = steps["lookup_nation"].groupBy("n_name", "qty_band").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("qty").cast("decimal(18,2)").alias("sum_qty"),
        F.sum("net").cast("decimal(18,4)").alias("revenue"),
    )
    return steps


def staged_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_steps(spark, sf_dir)["aggregate"]


FLAGSHIP_CTES = f"""
src AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem),
filtered AS (SELECT * FROM src WHERE l_shipdate < TIMESTAMP '{SHIP_CUTOFF}'),
expr AS (
  SELECT l_orderkey,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net_price,
         CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS qty_band,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty
  FROM filtered),
preagg AS (SELECT DISTINCT l_orderkey, qty_band FROM expr),
j_orders AS (SELECT p.*, o.o_custkey FROM preagg p JOIN orders o ON o.o_orderkey = p.l_orderkey),
j_cust AS (SELECT j.*, c.c_nationkey FROM j_orders j JOIN customer c ON c.c_custkey = j.o_custkey),
joined AS (
  SELECT e.*, coalesce(n.n_name, 'UNKNOWN') AS n_name
  FROM expr e JOIN orders o ON o.o_orderkey = e.l_orderkey
              JOIN customer c ON c.c_custkey = o.o_custkey
              LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
agg AS (
  SELECT n_name, qty_band,
       CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders,
       CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(qty) AS DECIMAL(18,2)) AS sum_qty,
       CAST(sum(net_price) AS DECIMAL(18,4)) AS revenue
  FROM joined GROUP BY n_name, qty_band)"""

FLAGSHIP_SQL = "WITH " + FLAGSHIP_CTES + "\nSELECT * FROM agg"

query("staged_pipeline", FLAGSHIP_SQL)(staged_pipeline)
