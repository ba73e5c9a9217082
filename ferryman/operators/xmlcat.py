"""Mapping XML catalogue (F34, F35): XML documents -> transformation and
connector rows with the built-in ``from_xml`` (JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators.graph import row_graph

# element and attribute layout of a mapping document (attributes carry "_")
MAPPING_SCHEMA = (
    "_NAME string, "
    "TRANSFORMATION array<struct<_NAME string, _TYPE string, "
    "TRANSFORMFIELD array<struct<_NAME string, _EXPRESSION string>>>>, "
    "CONNECTOR array<struct<_FROM string, _TO string>>"
)


def parse_mappings(df: DataFrame, xml: str = "xml", keys=("mapping_id",)) -> DataFrame:
    return df.select(*keys, F.from_xml(F.col(xml), MAPPING_SCHEMA).alias("m"))


def read_mappings(spark: SparkSession, path: str, row_tag: str = "MAPPING") -> DataFrame:
    """Mappings of repository exports, one row for each ``row_tag`` element: its
    ``mapping`` name and ``m`` as :func:`parse_mappings` gives it.

    The files are read as text whose records end at the closing tag. Such a read is split
    like any text file, so an export of any size is read by many tasks (the XML source
    reads a file whose elements run over lines in one task). Each record is cut to
    its element; elements closed in their own tag may stand before it. UTF-8; an element
    holds no other of its tag; text outside the elements is skipped."""
    end = f"</{row_tag}>"
    attributes = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?"""
    records = spark.read.option("lineSep", end).text(path)
    pieces = F.filter(F.split("value", rf"(?=<{row_tag}[\s>/])"), lambda p: p.rlike(rf"^<{row_tag}[\s>/]"))
    empty = rf"^<{row_tag}{attributes}/>"
    whole = F.transform(pieces, lambda p: F.when(p.rlike(empty), F.regexp_extract(p, empty, 0)).otherwise(F.concat(p, F.lit(end))))
    m = records.select(F.explode(whole).alias("xml")).select(F.from_xml(F.col("xml"), MAPPING_SCHEMA).alias("m"))
    return m.select(F.col("m._NAME").alias("mapping"), "m")


def transformations(parsed: DataFrame, keys=("mapping_id",)) -> DataFrame:
    """One row per (transformation, port); a transformation without ports
    still yields one row with null port and expression."""
    t = parsed.select(*keys, F.posexplode("m.TRANSFORMATION").alias("t_pos", "t"))
    f = t.select(*keys, "t_pos", F.col("t._NAME").alias("transformation"), F.col("t._TYPE").alias("type"),
                 F.explode_outer("t.TRANSFORMFIELD").alias("f"))
    return f.select(*keys, "transformation", "type", F.col("f._NAME").alias("port"),
                    F.col("f._EXPRESSION").alias("expression"))


def connectors(parsed: DataFrame, keys=("mapping_id",)) -> DataFrame:
    c = parsed.select(*keys, F.explode("m.CONNECTOR").alias("c"))
    return c.select(*keys, F.col("c._FROM").alias("from_stage"), F.col("c._TO").alias("to_stage"))


def flow_order(parsed: DataFrame, keys=("mapping_id",)) -> DataFrame:
    """``stage, level, n_upstream`` of each transformation of a mapping: its
    place along the connectors and how many stages feed it. The graph of a mapping is
    in its row and is folded there: no shuffle."""
    none = F.array().cast("array<struct<src:string,dst:string>>")
    links = F.coalesce(F.transform("m.CONNECTOR", lambda c: F.struct(c["_FROM"].alias("src"), c["_TO"].alias("dst"))), none)
    names = F.transform("m.TRANSFORMATION", lambda t: t["_NAME"])
    return parsed.select(*keys, F.inline(row_graph(names, links))).select(*keys, "stage", "level", "n_upstream")
