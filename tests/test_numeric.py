"""Python float rounding (prices) reproduced exactly, Spark and DuckDB twin."""

from __future__ import annotations

import random
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from ferryman.functions.num import duck_py_round, py_round

Q = Decimal("0.000001")


def _values():
    rnd = random.Random(11)
    rates = [(0.005, 0.015), (0.03, 0.06), (0.001, 0.002), (0.0015, 0.0015)]
    costs = []
    for _ in range(3000):
        a, b = rnd.choice(rates)
        costs.append((rnd.randrange(0, 100000) / 1e3) * a + (rnd.randrange(0, 20000) / 1e3) * b)
    general = [rnd.random() * 10 ** rnd.randint(-6, 5) for _ in range(1000)]
    # midpoints in decimal text (0.0003765, 1.65e-05), an exact binary tie, zero, tiny
    fixed = [(1 / 1e3) * 0.0015 + (250 / 1e3) * 0.0015, (11 / 1e3) * 0.0015, 0.0078125, 0.0, 1e-12, 2.5e-6]
    return costs + general + fixed


def _py(v):
    return Decimal(repr(round(v, 6))).quantize(Q)


def test_py_round_matches_python_round(spark):
    vals = _values()
    got = spark.createDataFrame([(v,) for v in vals], "v double").select("v", py_round(F.col("v")).alias("r"))
    bad = [(r.v, r.r, _py(r.v)) for r in got.collect() if r.r != _py(r.v)]
    assert not bad, bad[:5]


def test_duck_py_round_matches_python_round():
    vals = _values()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in vals])
    bad = [(v, r) for v, r in con.execute(f"SELECT v, {duck_py_round('v')} FROM t").fetchall() if r != _py(v)]
    assert not bad, bad[:5]
