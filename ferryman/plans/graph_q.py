"""Family C queries (macro dependency graph) and the XML mapping catalogue
(F34-F36), which share the graph ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.operators import graph, segment as sg, xmlcat
from ferryman.plans.registry import query
from ferryman.plans.segment_q import B7_BUDGET, _b7_sql_ctes
from ferryman.session import materialize
from ferryman.sources import fixtures as fx

# chunks the graph is built on: greedy budget chunks of the comment-free script
# (the macro calls sit between blocks, so budget chunks are the unit that keeps them)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.sas_scripts(spark, sf).select("script_id", sg.strip_sas_comments("text").alias("clean"))
    return sg.budget_chunks(s, "clean", B7_BUDGET).select("script_id", F.col("chunk_no").alias("seq"), "code")


def _defs_edges(spark, sf):
    # chunked once and written: nodes, definitions and use tokens all read it
    ch = materialize(chunks(spark, sf), "sas_chunks")
    defs = graph.macro_defs(ch)
    return ch, defs, graph.macro_edges(ch, defs)


_C_CTES = _b7_sql_ctes() + [
    ("cch", "SELECT script_id, piece_no AS seq, code FROM b7"),
    ("cdef", """SELECT script_id, name, max(seq) AS def_seq FROM (
        SELECT script_id, seq, regexp_extract(code, '(?i)%MACRO\\s+(\\w+)', 1) AS name FROM cch
        WHERE contains(code, '%MACRO') AND contains(code, '%MEND')) WHERE name <> '' GROUP BY script_id, name"""),
    ("cedge", """SELECT DISTINCT d.script_id, d.def_seq AS src, c.seq AS dst FROM cdef d
        JOIN cch c ON c.script_id = d.script_id AND contains(c.code, '%' || d.name) AND c.seq <> d.def_seq"""),
]


def _levels_ctes(edges: str) -> list[tuple[str, str]]:
    """Longest-path level by bounded recursion; a level reaching the node
    count means the node is on or behind a cycle."""
    return [
        ("cn", "SELECT script_id, count(*) AS n FROM cch GROUP BY script_id"),
        ("cpath", f"""SELECT script_id, seq AS node, CAST(0 AS BIGINT) AS d FROM cch
            UNION
            SELECT p.script_id, e.dst, p.d + 1 FROM cpath p
            JOIN {edges} e ON e.script_id = p.script_id AND e.src = p.node
            JOIN cn ON cn.script_id = p.script_id WHERE p.d < cn.n"""),
        ("clv", """SELECT p.script_id, p.node, max(p.d) AS level, any_value(cn.n) AS n FROM cpath p
            JOIN cn USING (script_id) GROUP BY p.script_id, p.node"""),
    ]


def sas(body, extra, recursive=False):
    return fx.with_ctes(body, "sas_scripts", extra=extra, recursive=recursive)


# C1 ---------------------------------------------------------------------
@query("macro_defs", sas("SELECT script_id, name, CAST(def_seq AS INTEGER) AS def_seq FROM cdef", _C_CTES))
def macro_defs(spark: SparkSession, sf: str) -> DataFrame:
    return _defs_edges(spark, sf)[1]


# C2 ---------------------------------------------------------------------
@query("macro_edges", sas("SELECT script_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM cedge",
                          _C_CTES))
def macro_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _defs_edges(spark, sf)[2]


# C3 ---------------------------------------------------------------------
@query("dependency_order", sas("""
SELECT script_id, CAST(node AS INTEGER) AS seq, CAST(level AS INTEGER) AS level,
       CAST(row_number() OVER (PARTITION BY script_id ORDER BY level, node) AS INTEGER) AS ord
FROM clv WHERE level < n""", _C_CTES + _levels_ctes("cedge"), recursive=True))
def dependency_order(spark: SparkSession, sf: str) -> DataFrame:
    ch, _, edges = _defs_edges(spark, sf)
    lv = graph.peel_levels(ch.select("script_id", F.col("seq").alias("node")), edges, "script_id")
    out = graph.dependency_order(lv, "script_id")
    return out.select("script_id", F.col("node").alias("seq"), "level", "ord")


# C4 ---------------------------------------------------------------------
_MADE = [("cmade", """SELECT script_id, src, dst FROM cedge
    UNION SELECT script_id, min(seq), max(seq) FROM cch WHERE script_id % 5 = 0 GROUP BY script_id HAVING min(seq) < max(seq)
    UNION SELECT script_id, max(seq), min(seq) FROM cch WHERE script_id % 5 = 0 GROUP BY script_id HAVING min(seq) < max(seq)"""),
    ("creach", """SELECT script_id, src AS up, dst AS node FROM cmade
    UNION SELECT r.script_id, r.up, e.dst FROM creach r JOIN cmade e ON e.script_id = r.script_id AND e.src = r.node"""),
    ("con", """SELECT a.script_id, a.up AS node, min(a.node) AS cycle FROM creach a
    JOIN creach b ON b.script_id = a.script_id AND b.up = a.node AND b.node = a.up GROUP BY a.script_id, a.up"""),
    ("cbehind", """SELECT DISTINCT r.script_id, r.node FROM creach r JOIN con ON con.script_id = r.script_id AND con.node = r.up
    WHERE NOT EXISTS (SELECT 1 FROM con o WHERE o.script_id = r.script_id AND o.node = r.node)""")]


@query("cycle_report", sas("""
SELECT script_id, CAST(node AS INTEGER) AS seq, 'on' AS kind, CAST(cycle AS INTEGER) AS cycle FROM con
UNION ALL SELECT script_id, CAST(node AS INTEGER), 'behind', NULL FROM cbehind""", _C_CTES + _MADE, recursive=True))
def cycle_report(spark: SparkSession, sf: str) -> DataFrame:
    ch, _, edges = _defs_edges(spark, sf)
    nodes = ch.select("script_id", F.col("seq").alias("node"))
    lv = graph.peel_levels(nodes, graph.with_made_cycles(edges, nodes, "script_id", "node"), "script_id")
    return graph.cycle_report(lv, "script_id").withColumnRenamed("node", "seq")


# F34 --------------------------------------------------------------------
@query("xml_transformations", """
SELECT p_partkey AS mapping_id, 'SQ' AS transformation, 'Source Qualifier' AS type, NULL AS port, NULL AS expression FROM part
UNION ALL
SELECT p_partkey, 'EXP', 'Expression', concat('f', CAST(j AS VARCHAR)), concat(CAST(p_size AS VARCHAR), '+', CAST(j AS VARCHAR))
FROM (SELECT p_partkey, p_size, unnest(generate_series(1, 1 + p_size % 3)) AS j FROM part)
UNION ALL
SELECT p_partkey, 'AGG', 'Aggregator', NULL, NULL FROM part""")
def xml_transformations(spark: SparkSession, sf: str) -> DataFrame:
    return xmlcat.transformations(exported(spark, sf))


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """The mappings read back from one repository export by their row tag."""
    def write(path: str) -> None:
        docs = xmlcat.parse_mappings(fx.mapping_xml(spark, sf)).select("m.*")
        # input, laid down once: one file with one root, as a repository export is
        docs.coalesce(1).write.format("xml").option("rootTag", "REPOSITORY").option("rowTag", "MAPPING").save(path)

    m = xmlcat.read_mappings(spark, fx.written_once(spark, sf, "mapping_export", write))
    return m.select(F.substring("mapping", 2, 20).cast("bigint").alias("mapping_id"), "m")


# F35 --------------------------------------------------------------------
@query("xml_connectors", """
SELECT p_partkey AS mapping_id, 'EXP' AS from_stage, 'AGG' AS to_stage FROM part
UNION ALL SELECT p_partkey, 'SQ', 'EXP' FROM part""")
def xml_connectors(spark: SparkSession, sf: str) -> DataFrame:
    return xmlcat.connectors(exported(spark, sf))


# F36 --------------------------------------------------------------------
@query("flow_order", """
SELECT p_partkey AS mapping_id, s.stage, s.level, s.n_upstream
FROM part, (VALUES ('SQ', 0, CAST(0 AS BIGINT)), ('EXP', 1, CAST(1 AS BIGINT)), ('AGG', 2, CAST(2 AS BIGINT)))
  s(stage, level, n_upstream)""")
def flow_order(spark: SparkSession, sf: str) -> DataFrame:
    return xmlcat.flow_order(xmlcat.parse_mappings(fx.mapping_xml(spark, sf)))
