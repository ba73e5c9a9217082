"""Local twin of the driver's correctness gate: Spark query vs DuckDB oracle.

Row count, column names + coarse types, and an order-insensitive hash of the
values (columns sorted by name). Used by tests and ``tools/check.py``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb

from ferryman.sources.tables import TABLES


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v) -> str:
    if v is None:
        return "NULL"
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _kind_spark(t) -> str:
    s = t.simpleString()
    if s in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if s in ("float", "double"):
        return "float"
    if s.startswith("decimal"):
        return "decimal"
    if s.startswith("timestamp"):
        return "timestamp"
    return {"string": "string", "boolean": "bool", "date": "date"}.get(s, s.split("<")[0])


def _kind_duck(t: str) -> str:
    t = t.upper()
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    return {"VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date"}.get(t, t.lower())


def _digest(rows: list[tuple]) -> str:
    lines = sorted("\x1f".join(_canon(v) for v in r) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode("utf-8", "surrogatepass"))
        h.update(b"\x1e")
    return h.hexdigest()


def compare(spark, key: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    kinds = {f.name: _kind_spark(f.dataType) for f in df.schema.fields}
    srows = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    out = {"key": key, "spark_rows": len(srows), "spark_cols": cols}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dkinds = {c: _kind_duck(str(t)) for c, t in zip(dcols, rel.types)}
    drows_raw = rel.fetchall()
    out["duck_rows"] = len(drows_raw)
    if sorted(dcols) != cols:
        out["status"] = "schema-names"
        out["duck_cols"] = sorted(dcols)
        return out
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in drows_raw]
    bad_types = {c: (kinds[c], dkinds[c]) for c in cols if kinds[c] != dkinds[c]}
    if bad_types:
        out["types"] = bad_types
    if len(srows) != len(drows):
        out["status"] = "rowcount"
    elif _digest(srows) != _digest(drows):
        out["status"] = "values"
        s_set = sorted("\x1f".join(_canon(v) for v in r) for r in srows)
        d_set = sorted("\x1f".join(_canon(v) for v in r) for r in drows)
        only_s = [x for x in s_set if x not in set(d_set)][:3]
        only_d = [x for x in d_set if x not in set(s_set)][:3]
        out["sample_spark"] = only_s
        out["sample_duck"] = only_d
    else:
        out["status"] = "types" if bad_types else "ok"
    return out
