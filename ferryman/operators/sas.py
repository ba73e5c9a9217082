"""SAS DATA/PROC steps and dbt-style modelling as DataFrame operations (family G)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryman.plans.sizing import maybe_broadcast
from ferryman.session import materialize, path_exists


def data_step_set(*dfs: DataFrame) -> DataFrame:
    """G1: ``SET a b ...`` -- concatenates data sets by variable name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def where_if(df: DataFrame, where: Column | None, target: str,
             branches: Sequence[tuple[Column, object]], otherwise=None) -> DataFrame:
    """WHERE filter, then IF/THEN/ELSE IF chain into ``target``."""
    if where is not None:
        df = df.filter(where)
    expr = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return df.withColumn(target, expr.otherwise(o))


def proc_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """PROC SQL over named frames (``{name}`` placeholders -> temp views)."""
    return spark.sql(sql, **frames)


def proc_format_case(c: Column, ranges: Sequence[tuple[float | None, float | None, str]],
                     other: str = "OTHER") -> Column:
    """PROC FORMAT value ranges ``low <= x < high`` as a CASE chain."""
    expr = None
    for lo, hi, label in ranges:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(other)


def proc_format_table(df: DataFrame, col: str, fmt: DataFrame, start: str = "start",
                      label: str = "label", out: str = "formatted", other: str = "OTHER") -> DataFrame:
    """Value map held as a table (CNTLIN style); checked-size broadcast join + default."""
    f = maybe_broadcast(fmt.select(F.col(start).alias("_fmt_key"), F.col(label).alias(out)))
    return df.join(f, df[col] == f["_fmt_key"], "left").drop("_fmt_key") \
        .withColumn(out, F.coalesce(F.col(out), F.lit(other)))


def transpose_wide(df: DataFrame, by: Sequence[str], id_col: str, values: Sequence[str],
                   agg: Column, prefix: str = "", fill=None) -> DataFrame:
    """PROC TRANSPOSE long->wide. ``values`` are given, so no distinct pass."""
    out = df.groupBy(*by).pivot(id_col, list(values)).agg(agg)
    ren = {v: f"{prefix}{v}" for v in values}
    out = out.withColumnsRenamed(ren)
    if fill is not None:
        out = out.fillna(fill, subset=list(ren.values()))
    return out


def transpose_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], cast: str | None = None,
                   var: str = "_name_", val: str = "col1") -> DataFrame:
    """Wide->long (``unpivot``); columns cast to one type first."""
    src = df.select(*ids, *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in cols])
    return src.unpivot(list(ids), list(cols), var, val)


# --- SAS scalar functions mapped to Spark built-ins
def intnx_month(d: Column, n: int) -> Column:
    """INTNX('month', d, n): first day of the month n months on."""
    return F.add_months(F.trunc(d.cast("date"), "MM"), n)


def intck_day(a: Column, b: Column) -> Column:
    """INTCK('day', a, b): day boundaries crossed from a to b."""
    return F.datediff(b.cast("date"), a.cast("date"))


def scan(s: Column, n: int, delim: str = " ") -> Column:
    """SCAN(s, n, delim): n-th word (1-based; negative: from the end). Every character of
    ``delim`` is a delimiter, a run of them counts as one, and leading and trailing ones
    are skipped; '' where there is no such word."""
    words = F.filter(F.split(s, "[" + re.escape(delim) + "]+"), lambda w: w != "")
    return F.when(s.isNotNull(), F.coalesce(F.try_element_at(words, F.lit(n)), F.lit("")))


def compress(s: Column, chars: str = " ") -> Column:
    """COMPRESS(s, chars): remove every listed character."""
    return F.regexp_replace(s, "[" + re.escape(chars) + "]", "")


def catx(sep: str, *cols: Column) -> Column:
    """CATX(sep, ...): trimmed, non-missing items joined by sep."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def incremental_model(target: DataFrame, source: DataFrame, ts: str, keys: Sequence[str],
                      watermark=None) -> DataFrame:
    """Dbt-style incremental run.

    New rows are the source rows past the target's watermark (max ``ts``,
    one scalar aggregate; the literal filter then reaches the parquet scan),
    merged by unique key: (target LEFT ANTI new) UNION ALL new.
    """
    wm = F.lit(watermark) if watermark is not None else _max_literal(target, ts)
    new = source if wm is None else source.filter(F.col(ts) > wm)
    kept = target.join(new.select(*keys), on=list(keys), how="left_anti")
    return kept.unionByName(new.select(*target.columns))


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key, the last in ``order``: an aggregate that keeps one row a key
    and task before the shuffle, so a key of many versions is no hot group. Null
    keys are one key; a full tie goes to the row that is largest column by column."""
    cols = [F.col(c) for c in rows.columns]
    last = F.max(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*cols).alias("row")))
    return rows.groupBy(*keys).agg(last.alias("_last")).select("_last.row.*")


def bucketed_upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], ts: str, n_buckets: int,
                    order: Sequence[str] = ()) -> list[int]:
    """Upsert ``new`` by key into the table at ``path``, which is partitioned
    by ``bucket`` (hash of the keys). Returns the buckets written.

    Only buckets with a changed row are read and replaced (dynamic partition
    overwrite); the files of all others stay. Of several rows of a key the newest by
    ``ts`` (then ``order``) wins, in the target too; at equal ``ts`` the new row wins. Rows that
    the target already holds as they are touch nothing, so a replay writes nothing.

    The merged buckets are written aside first and then moved in: a run that
    breaks off is repeated from its source. The driver sees bucket numbers only.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")
    new = newest_per_key(new, keys, [ts, *order])
    columns = new.columns
    new = materialize(new.withColumn("bucket", bucket), "upsert_new")
    old = spark.read.schema(new.schema).parquet(path) if path_exists(spark, path) else None
    if old is not None:
        # new rows that the target has with the same values are no change
        o = old.select(*[F.col(c).alias(f"_t_{c}") for c in new.columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in ["bucket", *columns]])
        new = materialize(new.join(o, same, "left_anti"), "upsert_changed")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return []
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.filter(F.col("bucket").isin(touched)).withColumn("_new", F.lit(0)))
    merged = newest_per_key(both, keys, [ts, "_new", *order]).select(*columns, "bucket")
    merged = materialize(merged, "upsert_merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def incremental_load(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], ts: str, n_buckets: int = 64,
                     order: Sequence[str] = ()) -> DataFrame:
    """G11, batch form: rows of ``source`` at or past the watermark of the last
    finished load are upserted into the bucketed table at ``path``. ``>=``: rows that come
    late with the watermark's own time are not lost, and those already loaded touch nothing.

    The watermark (the newest ``ts`` of the source rows taken) is appended to ``<path>-loads`` after the buckets are in
    place, so a load that broke off starts again from the old one. Returns the table without its bucket column."""
    loads = f"{path}-loads"
    wm = _max_literal(spark.read.parquet(loads), ts) if path_exists(spark, loads) else None
    taken = source if wm is None else source.filter(F.col(ts) >= wm)
    bucketed_upsert(spark, path, taken, keys, ts, n_buckets, order)
    seen = taken.agg(F.max(ts).alias(ts))
    (seen if wm is None else seen.select(F.coalesce(ts, wm).alias(ts))).write.mode("append").parquet(loads)
    return bucketed_table(spark, path, source)


def bucketed_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of a bucketed target, with the columns of ``like``."""
    if not path_exists(spark, path):
        return like.filter(F.lit(False))
    return spark.read.schema(like.withColumn("bucket", F.lit(0)).schema).parquet(path).select(*like.columns)


def _max_literal(df: DataFrame, col: str) -> Column | None:
    """``max(col)`` as a literal of the column's own type (one scalar to the
    driver), rebuilt exactly: epoch microseconds for zoned timestamps, the
    value's text for everything else -- never a Python datetime, which would
    pass through the driver's local time zone."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampType):
        us = df.agg(F.unix_micros(F.max(col))).first()[0]
        return None if us is None else F.timestamp_micros(F.lit(us))
    txt = df.agg(F.max(col).cast("string")).first()[0]
    return None if txt is None else F.lit(txt).cast(dt)


def test_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Failing-row count per column (one aggregation pass)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("failures")) for c in cols
    ])).alias("r")).select("r.*")


def test_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def test_accepted_values(df: DataFrame, col: str, accepted: Sequence[str]) -> DataFrame:
    """Values outside the accepted list, with row counts (nulls pass, as in dbt)."""
    return df.filter(~F.col(col).isin(list(accepted))).groupBy(col) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


def test_relationships(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (left anti join)."""
    p = parent.select(F.col(parent_key).alias(child_key))  # anti join needs no distinct
    return child.filter(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")
