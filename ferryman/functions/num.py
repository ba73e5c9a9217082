"""Python float rounding as JVM expressions (and its DuckDB twin).

Prices are computed as Python computes them: double arithmetic, then
``round(x, 6)``, which rounds the *exact binary value* of ``x`` half-even.
Rounding the decimal text of a double (what ``round``/``bround`` on DOUBLE
and every double->decimal cast do) differs whenever that text ends exactly on
a midpoint such as ``0.0003765`` -- about one gemini-priced cost in five.

Exact method, no UDF: write ``x = M / 2^k`` (``M`` the 53-bit integer
significand), so ``x * 10^nd = M * 10^nd / 2^k``; ``q = floor`` of that is
found from the double estimate and checked in DECIMAL(38,0) integers, and
the doubled remainder against ``2^k`` decides up, down or (exact tie) even.
Domain: ``0 <= x < 2^52``; below ``2^-30`` the result is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryman.functions.text import let

_TINY = 2.0 ** -30
_INT = "decimal(38,0)"


def _pow2(k: Column) -> Column:
    """2^k (0 <= k <= 62) as an exact DECIMAL(38,0); the SQL ``shiftleft``
    takes a column shift (the Python wrapper only an int)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k).cast(_INT)


def py_round(x: Column, nd: int = 6) -> Column:
    """``round(x, nd)`` of a Python float, as ``decimal(18, nd)``."""
    scale = 10 ** nd

    def on_x(v):
        def on_e0(e0):
            m0 = v / F.pow(F.lit(2.0), e0 - 52)
            return F.when(m0 >= F.lit(2.0 ** 53), e0 + 1).when(m0 < F.lit(2.0 ** 52), e0 - 1).otherwise(e0)

        def on_e(e):
            k = F.lit(52) - e
            parts = F.struct(
                (v / F.pow(F.lit(2.0), e - 52)).cast("bigint").cast(_INT).alias("m"),
                (_pow2(F.least(k, F.lit(62))) * _pow2(F.greatest(k - 62, F.lit(0)))).alias("d"),
                F.floor(v * F.lit(float(scale))).cast(_INT).alias("q0"))

            def on_parts(p):
                n = p["m"] * F.lit(scale).cast(_INT)
                d, q0 = p["d"], p["q0"]
                q = F.when(q0 * d > n, q0 - 1).when((q0 + 1) * d <= n, q0 + 1).otherwise(q0)

                def on_q(q):
                    r2 = (n - q * d) * 2
                    return q + F.when(r2 > d, 1).when(r2 == d, q % 2).otherwise(0)

                return let(q, on_q)

            return let(parts, on_parts)

        units = let(let(F.floor(F.log2(v)).cast("int"), on_e0), on_e)
        exact = (units * F.lit(1.0 / scale).cast(f"decimal({nd + 1},{nd})")).cast(f"decimal(18,{nd})")
        return F.when(v < F.lit(_TINY), F.lit(0).cast(f"decimal(18,{nd})")).otherwise(exact)

    return let(x.cast("double"), on_x)


def duck_py_round(x: str, nd: int = 6) -> str:
    """DuckDB twin of :func:`py_round` (HUGEINT integers, list lambdas as let)."""
    scale = 10 ** nd
    unit = f"CAST('{1 / scale:.{nd}f}' AS DECIMAL({nd + 1},{nd}))"
    m0 = "(v / pow(2.0, e0 - 52))"
    return f"""list_transform([CAST({x} AS DOUBLE)], lambda v:
  CASE WHEN v < {_TINY!r} THEN CAST(0 AS DECIMAL(18,{nd})) ELSE
  list_transform([CAST(floor(log2(v)) AS INTEGER)], lambda e0:
    list_transform([CASE WHEN {m0} >= {2.0 ** 53!r} THEN e0 + 1 WHEN {m0} < {2.0 ** 52!r} THEN e0 - 1 ELSE e0 END],
    lambda e:
      list_transform([struct_pack(n := CAST(CAST(v / pow(2.0, e - 52) AS BIGINT) AS HUGEINT) * {scale},
                                  d := (CAST(1 AS HUGEINT) << (52 - e)),
                                  q0 := CAST(floor(v * {float(scale)!r}) AS HUGEINT))], lambda p:
        list_transform([CASE WHEN p.q0 * p.d > p.n THEN p.q0 - 1
                             WHEN (p.q0 + 1) * p.d <= p.n THEN p.q0 + 1 ELSE p.q0 END], lambda q:
          CAST(CAST(q + CASE WHEN 2 * (p.n - q * p.d) > p.d THEN 1
                             WHEN 2 * (p.n - q * p.d) = p.d THEN q % 2 ELSE 0 END AS DECIMAL(38,0))
               * {unit} AS DECIMAL(18,{nd}))
        )[1])[1])[1])[1] END)[1]"""
