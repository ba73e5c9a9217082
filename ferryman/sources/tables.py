"""Readers for the driver's parquet tables.

Plain ``spark.read.parquet``: Catalyst prunes columns and pushes filters into
the scan on its own, so callers only ``select``/``filter`` what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views for the SQL-first operators."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def literal_table(spark: SparkSession, rows, columns) -> DataFrame:
    """A small constant table as an inline ``VALUES`` relation.

    Unlike ``createDataFrame`` (an RDD of unknown size to the optimizer), this
    is a local relation with a known size, so a size-checked broadcast of it
    can pass. Values are bound as named SQL parameters, never spliced in.
    """
    args, tuples = {}, []
    for i, row in enumerate(rows):
        names = []
        for j, v in enumerate(row):
            args[f"v{i}_{j}"] = v
            names.append(f":v{i}_{j}")
        tuples.append("(" + ", ".join(names) + ")")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({', '.join(columns)})", args=args)
