"""Whole-fixture properties: chunks give back the text,
every script yields a chunk, definitions precede uses, sequences are dense."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryman.operators import segment as sg
from ferryman.plans import registry
from ferryman.plans.graph_q import B7_BUDGET
from ferryman.sources import fixtures as fx

from .conftest import SF_CHECK


def test_budget_chunks_concatenate_to_the_text(spark):
    s = fx.sas_scripts(spark, SF_CHECK).select("script_id", sg.strip_sas_comments("text").alias("clean"))
    ch = sg.budget_chunks(s, "clean", B7_BUDGET)
    back = ch.groupBy("script_id").agg(F.expr(
        "listagg(code, '\\n') WITHIN GROUP (ORDER BY chunk_no)").alias("back"))
    bad = s.join(back, "script_id", "left").filter(~F.coalesce(F.col("back"), F.lit("")).eqNullSafe(
        F.when(F.col("clean") == "", F.lit("")).otherwise(F.col("clean"))))
    assert bad.count() == 0


def test_every_script_yields_a_chunk(spark):
    q = registry.queries()
    n_scripts = fx.scripts(spark, SF_CHECK).count()
    for key in ("empty_fallback", "dialect_dispatch"):
        assert q[key](spark, SF_CHECK).select("script_id").distinct().count() == n_scripts, key


def test_definitions_precede_uses(spark):
    q = registry.queries()
    edges = q["macro_edges"](spark, SF_CHECK)
    order = q["dependency_order"](spark, SF_CHECK)
    src = order.select("script_id", F.col("seq").alias("src"), F.col("ord").alias("o_src"))
    dst = order.select("script_id", F.col("seq").alias("dst"), F.col("ord").alias("o_dst"))
    j = edges.join(src, ["script_id", "src"]).join(dst, ["script_id", "dst"])
    assert j.count() == edges.count()            # the test fixture has no cycles
    assert j.filter(F.col("o_src") >= F.col("o_dst")).count() == 0


def test_dependency_order_is_dense_per_script(spark):
    order = registry.queries()["dependency_order"](spark, SF_CHECK)
    g = order.groupBy("script_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"),
                                      F.max("ord").alias("hi"), F.count_distinct("ord").alias("d"))
    assert g.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).count() == 0


def test_step_numbers_dense_per_job(spark):
    sp = registry.queries()["step_progress"](spark, SF_CHECK)
    g = sp.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("step_no").alias("hi"),
                                 F.count_distinct("step_no").alias("d"))
    assert g.filter((F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).count() == 0


def test_sas_blocks_follow_the_generator_parameters(spark):
    """Parse-free: a script's block count and kinds follow from doc_id alone
    (1 + doc_id % 6 pieces, reversed when doc_id % 3 == 0, kind by (doc_id + i) % 4)."""
    kinds = ["DATA", "PROC", "%MACRO", "PROC"]
    s = fx.sas_scripts(spark, SF_CHECK)
    blocks = sg.sas_blocks(s).select("script_id", "block_no", F.upper(F.split(F.ltrim("code"), r"\s")[0]).alias("kind"))
    got: dict[int, list[tuple[int, str]]] = {}
    for r in blocks.collect():
        got.setdefault(r.script_id, []).append((r.block_no, r.kind))
    ids = [r.script_id for r in s.select("script_id").collect()]
    assert ids and set(got) == set(ids)
    for d in ids:
        order = list(range(1, 2 + d % 6))
        if d % 3 == 0:
            order.reverse()
        assert [k for _, k in sorted(got[d])] == [kinds[(d + i) % 4] for i in order], d
