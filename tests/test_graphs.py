"""Graphs over rows and within a row against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ferryman.operators import graph, xmlcat
from ferryman.plans import graph_q

from .conftest import SF_SMOKE


def plain(nodes, edges):
    """node -> (level, kind, cycle, upstreams) by plain reach sets."""
    above = {v: {a for a, b in edges if b == v} for v in nodes}
    up = {v: set(above[v]) for v in nodes}
    for k in nodes:
        for v in nodes:
            if k in up[v]:
                up[v] |= up[k]
    on = {v for v in nodes if v in up[v]}
    level = {}

    def depth(v):
        if v not in level:
            level[v] = max((depth(a) + 1 for a in above[v]), default=0)
        return level[v]

    out = {}
    for v in nodes:
        if v in on:
            out[v] = (None, "on", min(u for u in up[v] if v in up[u]), len(up[v]))
        elif up[v] & on:
            out[v] = (None, "behind", None, len(up[v]))
        else:
            out[v] = (depth(v), None, None, len(up[v]))
    return out


def made_graphs():
    rng = random.Random(11)
    groups = {1: ([], []), 2: ([5], []), 3: ([1, 2], [(1, 2), (2, 1)]), 4: ([7, 8], [(7, 7), (7, 8)])}
    groups[5] = (list(range(90)), [(i, i + 1) for i in range(89)])
    groups[6] = (list(range(40)), [(i, (i + 1) % 33) for i in range(33)] + [(32, 33), (34, 3), (33, 35), (36, 37)])  # a long cycle, and a short one before it
    groups[6][1].extend([(38, 39), (39, 38), (39, 0)])
    for g in range(7, 30):
        n = rng.randrange(2, 12)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 2 * n))}
        if g % 2:
            edges = {(a, b) for a, b in edges if a < b}
        groups[g] = (list(range(n)), sorted(edges))
    return groups


def frames(spark, groups):
    nodes = spark.createDataFrame([(g, v) for g, (vs, _) in groups.items() for v in vs], "g bigint, node int")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in groups.items() for a, b in es] + [(2, None, 5), (2, 5, None)], "g bigint, src int, dst int")
    return nodes, edges


@pytest.mark.parametrize("row_edges", [graph.ROW_EDGES, 0, 6])
def test_levels_and_cycles_against_plain_reach(spark, row_edges):
    groups = made_graphs()
    nodes, edges = frames(spark, groups)
    got = {(r.g, r.node): (r.level, r.kind, r.cycle) for r in graph.peel_levels(nodes, edges, "g", row_edges=row_edges).collect()}
    assert got == {(g, v): x[:3] for g, (vs, es) in groups.items() for v, x in plain(vs, es).items()}


def test_a_long_chain_takes_few_rounds(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(199)] + [(2, 1, 2)], "g bigint, src int, dst int")
    paths, looped, rounds = graph.longest_paths(edges, "g")
    assert rounds <= 9 and looped.isEmpty()
    assert paths.filter("g = 1").agg(F.max("len")).first()[0] == 199
    assert graph.lineage_closure(edges, "g").count() == 199 * 200 // 2 + 1


def test_groups_without_edges_enter_no_round(spark):
    nodes = spark.createDataFrame([(g, 1) for g in range(50)], "g bigint, node int")
    none = spark.createDataFrame([], "g bigint, src int, dst int")
    assert graph.longest_paths(none, "g")[2] == 0
    assert {r.level for r in graph.peel_levels(nodes, none, "g").collect()} == {0}


def test_row_graph_against_plain_reach(spark):
    groups = made_graphs()
    rows = [(g, [f"n{v:03}" for v in vs], [(f"n{a:03}", f"n{b:03}") for a, b in es] + [("nowhere", f"n{v:03}") for v in vs[:1]]) for g, (vs, es) in groups.items()]
    df = spark.createDataFrame(rows, "g int, names array<string>, links array<struct<src:string,dst:string>>")
    got = {(r.g, r.stage): (r.level, r.n_upstream) for r in df.select("g", F.inline(graph.row_graph(F.col("names"), F.col("links")))).select("g", "stage", "level", "n_upstream").collect()}
    assert got == {(g, f"n{v:03}"): (x[0], x[3]) for g, (vs, es) in groups.items() for v, x in plain(vs, es).items()}


def test_flow_order_of_a_hundred_stages_without_shuffle(spark):
    n = 100
    xml = "<MAPPING NAME='m'>" + "".join(f"<TRANSFORMATION NAME='s{i}' TYPE='Expression'/>" for i in range(n)) \
        + "".join(f"<CONNECTOR FROM='s{i}' TO='s{i + 1}'/>" for i in range(n - 1)) + "</MAPPING>"
    out = xmlcat.flow_order(xmlcat.parse_mappings(spark.createDataFrame([(1, xml), (2, "<MAPPING NAME='x'/>")], "mapping_id int, xml string")))
    got = {(r.mapping_id, r.stage): (r.level, r.n_upstream) for r in out.collect()}
    assert got == {(1, f"s{i}"): (i, i) for i in range(n)}
    plan = graph_q.flow_order(spark, SF_SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan and "ferryman-scratch" not in plan


def test_macro_edges_against_containment(spark):
    rng = random.Random(3)
    names = ["a", "ab", "abc", "abd", "b", "ba", "bab", "é", "éa", "z", "zz", "_x", "A1"]
    rows = []
    for script in range(12):
        for seq in range(1, 9):
            code = "".join(rng.choice(["%", "%%", " ", ";", "x%"]) + "".join(rng.choice(["a", "b", "c", "é", "z", "1", "_x"]) for _ in range(rng.randrange(0, 5))) for _ in range(6))
            if rng.random() < 0.5 and script != 5:
                code = f"%MACRO {rng.choice(names)};\n{code}%MEND;"
            rows.append((script, seq, code))
    rows.append((20, 1, "%"))
    ch = spark.createDataFrame(rows, "script_id bigint, seq int, code string")
    defs = graph.macro_defs(ch)
    owner = {(r.script_id, r.name): r.def_seq for r in defs.collect()}
    want = {(s, d, seq) for s, seq, code in rows for (t, name), d in owner.items() if t == s and f"%{name}" in code and d != seq}
    edges = graph.macro_edges(ch, defs)
    assert {(r.script_id, r.src, r.dst) for r in edges.collect()} == want and len(want) > 20
    assert edges.count() == len(want)
