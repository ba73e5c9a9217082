"""ETL stage catalogue (Informatica / DataStage mapping stages) as DataFrame ops.

Every function takes and returns DataFrames with column names as parameters.
All of them are lazy plan builders; nothing here triggers a job except the
explicit sinks (``target_write``, ``partitioned_write``) and the stages of ``stage_counts``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryman.plans.sizing import maybe_broadcast
from ferryman.session import materialize, path_exists, scratch_path
from ferryman.sources.tables import literal_table

ColLike = str | Column


def _col(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------- sources
def source_read(spark: SparkSession, path: str, schema: T.StructType | str,
                fmt: str = "parquet", **options) -> DataFrame:
    """read with an explicit schema (no inference pass over the data)."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def file_read(spark: SparkSession, path: str, schema: T.StructType | str,
              corrupt_col: str = "_corrupt_record", header: bool = True, sep: str = ",") -> DataFrame:
    """sequential / staged flat file, PERMISSIVE with a corrupt-record column."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if corrupt_col not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())])
    return (spark.read.schema(schema)
            .option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt_col)
            .csv(path))


# --------------------------------------------------------------- row stages
def source_qualifier(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """explicit projection with casts (only the named columns survive)."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in casts.items()])


def expression(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """derived columns in one projection."""
    return df.withColumns(dict(derived))


def filter_stage(df: DataFrame, cond: Column) -> DataFrame:
    """row filter (pushed into the scan by Catalyst when possible)."""
    return df.filter(cond)


def router_first(df: DataFrame, groups: Sequence[tuple[str, Column]], default: str = "DEFAULT",
                 label: str = "route") -> DataFrame:
    """CASE routing, each row to the first matching group, else default."""
    expr = None
    for name, cond in groups:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(label, expr.otherwise(F.lit(default)) if expr is not None else F.lit(default))


def route(df: DataFrame, name: str, label: str = "route") -> DataFrame:
    """One output group of a router."""
    return df.filter(F.col(label) == name)


def router_multi(df: DataFrame, groups: Sequence[tuple[str, Column]], default: str = "DEFAULT",
                 label: str = "route") -> DataFrame:
    """independent group filters; a row goes to every group it matches,
    to ``default`` if none. One pass, no union of re-scans."""
    arr = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups]))
    return df.withColumn(label, F.explode(
        F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit(default)))))


def aggregator(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """F8: group + aggregate (Catalyst plans partial + final aggregation)."""
    return df.groupBy(*keys).agg(*aggs)


def joiner(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """equi-join; both sides shuffle on the key unless one is small."""
    return left.join(right, on=on, how=how)


def lookup(df: DataFrame, lkp: DataFrame, keys: Sequence[str], returns: Sequence[str],
           order_by: Sequence[Column] | None = None, defaults: Mapping[str, object] | None = None,
           max_broadcast_bytes: int | None = None) -> DataFrame:
    """connected lookup.

    Several matches per key -> the first by ``order_by`` (deduplicated on the
    lookup side, so the probe side never multiplies). Miss -> ``defaults``.
    The lookup side is broadcast only when its checked size allows.
    """
    lk = lkp.select(*keys, *returns)
    if order_by is not None:
        w = Window.partitionBy(*keys).orderBy(*order_by)
        lk = lk.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    lk = maybe_broadcast(lk) if max_broadcast_bytes is None else maybe_broadcast(lk, max_broadcast_bytes)
    out = df.join(lk, on=list(keys), how="left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def lookup_unconnected(df: DataFrame, lkp: DataFrame, left_key: str, right_key: str,
                       returns: Sequence[str], when: Column) -> DataFrame:
    """lookup evaluated only for rows where ``when`` holds (condition in ON)."""
    lk = maybe_broadcast(lkp.select(F.col(right_key).alias("_lk_key"), *returns))
    cond = (F.col(left_key) == F.col("_lk_key")) & when
    return df.join(lk, cond, "left").drop("_lk_key")


# ---------------------------------------------------------- surrogate keys
def sequence_key(df: DataFrame, order_cols: Sequence[ColLike], start: int = 1,
                 name: str = "sk") -> DataFrame:
    """dense surrogate key ``start .. start+n-1`` by a total order.

    Two passes, no single-partition window: range-partition + sort, count
    rows per partition (one small row per partition), prefix-sum the counts,
    then add the partition offset to a per-partition row number.
    """
    cols = [_col(c) for c in order_cols]
    # after the range shuffle and local sort, monotonically_increasing_id is
    # (partition << 33) + position-in-partition: a local row number, no window
    # written once (see keyed_row_number): counts and rows must come from the
    # same range partitioning, and its bounds are sampled per computation
    numbered = materialize(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_ln", F.monotonically_increasing_id()
                                       - F.shiftleft(F.col("_pid").cast("bigint"), 33) + 1), "seq_key")
    counts = numbered.groupBy("_pid").agg(F.max("_ln").alias("_cnt"))
    # one row per partition (bounded by the partition count, safe to broadcast)
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    out = numbered.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_ln") + F.lit(start - 1)).cast("bigint")) \
        .drop("_pid", "_ln", "_off")


def keyed_row_number(df: DataFrame, keys: Sequence[str], order_cols: Sequence[ColLike],
                     name: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order_cols)`` that
    never sends one key's rows to one task.

    A plain window hash-partitions on the key, so a key holding a third of
    the rows is numbered by one task. Here the rows are range-partitioned on
    (keys, order): a hot key spreads over several ranges. Each partition
    numbers its rows locally; a small table with one row per (key, partition)
    -- count and first local position -- gets per-key offsets by a window
    over at most #partitions rows per key, and is joined back on
    (key, partition), a composite key that carries no skew.
    """
    kc = [F.col(k) for k in keys]
    oc = [_col(c) for c in order_cols]
    # Written once to the shared checkpoint folder: the range bounds come from
    # a sample seeded by the RDD id, so two computations of this frame could
    # place rows in different partitions; both uses below must see one copy.
    numbered = materialize(df.repartitionByRange(*kc, *oc).sortWithinPartitions(*kc, *oc)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_ln", F.monotonically_increasing_id()
                                       - F.shiftleft(F.col("_pid").cast("bigint"), 33)), "keyed_rn")
    runs = numbered.groupBy(*keys, "_pid").agg(F.min("_ln").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    cond = F.col("r._pid") == F.col("n._pid")
    for k in keys:
        cond = cond & F.col(f"n.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = numbered.alias("n").join(runs.alias("r"), cond)
    rn = (F.col("n._ln") - F.col("r._first") + F.col("r._off") + 1).cast("bigint").alias(name)
    return out.select(*[F.col(f"n.{c}") for c in df.columns], rn)


# ----------------------------------------------------------- change capture
def _row_equal(cols: Sequence[str], l: str, r: str) -> Column:
    eq = F.lit(True)
    for c in cols:
        eq = eq & F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}"))
    return eq


def update_strategy(target: DataFrame, source: DataFrame, keys: Sequence[str],
                    compare: Sequence[str], reject: Column | None = None) -> DataFrame:
    """flag every key as INSERT / UPDATE / DELETE / UNCHANGED (/ REJECT).

    One full outer join on the keys; row compare is null-safe. Which side has the
    row is a flag of that side, so a row with a null key (equal to no other) is
    flagged by the side it comes from.
    """
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    cond = None
    for k in keys:
        c = F.col(f"t.{k}") == F.col(f"s.{k}")
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    s_present, t_present = F.col("s._in_s").isNotNull(), F.col("t._in_t").isNotNull()
    flag = (F.when(~t_present, "INSERT").when(~s_present, "DELETE")
            .when(_row_equal(compare, "t", "s"), "UNCHANGED").otherwise("UPDATE"))
    if reject is not None:
        flag = F.when(s_present & reject, "REJECT").otherwise(flag)
    out_keys = [F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")).alias(k) for k in keys]
    return j.select(*out_keys, flag.alias("change_flag"))


def one_per_key(source: DataFrame, keys: Sequence[str], newest: Sequence[ColLike] | None = None) -> DataFrame:
    """Source rows fit for an upsert. With ``newest``, the last row of each key in
    that order (a tie goes either way; name enough columns); without, a key that
    stands several times fails the job, since the target's key would not be unique.
    Rows with a null key match nothing and are all kept."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    if newest is not None:
        w = Window.partitionBy(*keys).orderBy(*[_col(c).desc() for c in newest])
        return source.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) | some_null).drop("_rn")
    # counted by a partial aggregate of the keys alone; the frame of repeated keys is empty or stops the job
    stop = F.raise_error(F.concat(F.lit("duplicate source key in an upsert: " + ", ".join(keys) + ", rows: "), F.col("_n")))
    repeated = source.select(*keys).filter(~some_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = repeated.filter(F.when(F.col("_n") > 1, stop.cast("boolean")).otherwise(F.col("_n") < 1))
    return source.join(repeated.select(*keys), list(keys), "left_anti").select(*source.columns)


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 newest: Sequence[ColLike] | None = None) -> DataFrame:
    """MATCHED -> source row, NOT MATCHED -> insert; other target rows kept.

    (target LEFT ANTI source) UNION ALL source; the caller writes it to a
    *new* path (never over the path being read). For duplicate source keys see
    :func:`one_per_key`.
    """
    source = one_per_key(source, keys, newest)
    kept = target.join(source.select(*keys), on=list(keys), how="left_anti")
    return kept.unionByName(source.select(*target.columns))


# --------------------------------------------------------------------- sinks
def target_write(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                 partition_by: Sequence[str] | None = None) -> None:
    """DataFrameWriter with a mode; optional partitioned layout.

    Rows are rebalanced by the partition values before they are written: AQE splits a
    value that holds many rows over several tasks, each of about the advisory size,
    and puts small ones together. So files have a bounded size, and a small
    value has one file instead of one from every task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# ----------------------------------------------------------------- set / sort
def funnel(*dfs: DataFrame) -> DataFrame:
    """union all by name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def sort_stage(df: DataFrame, order: Sequence[ColLike], position: str | None = "pos") -> DataFrame:
    """global order. The position column makes the order observable; it is
    assigned with the scalable two-pass key (F13), not a single-task window."""
    if position is None:
        return df.orderBy(*[_col(c) for c in order])
    return sequence_key(df, order, 1, position)


def sort_within(df: DataFrame, order: Sequence[ColLike]) -> DataFrame:
    return df.sortWithinPartitions(*[_col(c) for c in order])


def row_generator(spark: SparkSession, n: int, exprs: Mapping[str, Column],
                  partitions: int | None = None) -> DataFrame:
    """n rows from ``spark.range`` (split over partitions, no driver data)."""
    r = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    return r.withColumns(dict(exprs))


def fixed_value(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def safe_cast(c: ColLike, to: str, default=None) -> Column:
    """cast or fall back to ``default`` (never raises under ANSI)."""
    v = _col(c).try_cast(to)
    return v if default is None else F.coalesce(v, F.lit(default).cast(to))


def null_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """replace nulls per column."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def window_filter(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
                  keep: int = 1, rank_col: str | None = "rn") -> DataFrame:
    """QUALIFY row_number() <= keep (dedup-latest, top-k per group)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def null_safe_equal(a: ColLike, b: ColLike) -> Column:
    """IS NOT DISTINCT FROM."""
    return _col(a).eqNullSafe(_col(b))


# ------------------------------------------------------------ data checks
def _part_counts(written: DataFrame) -> DataFrame:
    """``part, rows``: rows by the task that wrote them, from the files' row counts alone."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))


def _stage_whole(spark: SparkSession, data: str, ledger: str, schema: T.StructType) -> bool:
    """The stage was written to its end and still has the rows that its ledger names, part by part."""
    if not (path_exists(spark, f"{data}/_SUCCESS") and path_exists(spark, f"{ledger}/_SUCCESS")):
        return False
    was = spark.read.schema("part int, rows bigint").parquet(ledger).select("part", F.col("rows").alias("was"))
    now = _part_counts(spark.read.schema(schema).parquet(data))
    return now.join(was, "part", "full_outer").filter(~F.col("rows").eqNullSafe(F.col("was"))).isEmpty()


def stage_counts(build: Callable[[Callable[[str, DataFrame], DataFrame]], DataFrame],
                 folder: str | None = None) -> DataFrame:
    """row count per stage and the change from the previous stage.

    ``build(tap)`` builds the pipeline, passing each stage through ``tap``. It writes
    the stage to ``folder``, counts it by part in a ledger beside it, and returns the
    written frame for the next stage to build on, so every stage runs once.
    Counts come from committed files: a task that ran twice, after a lost executor
    or speculatively, counts once, which a metric collected as the rows flow by
    does not guarantee.

    Without ``folder`` a run has a new one under the checkpoint folder. With the
    ``folder`` of an earlier run of the same pipeline, stages that are whole are taken as they
    are, and one that was not finished or has lost a part is written again from
    the stage before it. A stage without rows counts 0.
    """
    taps: list[str] = []
    sessions: list[SparkSession] = []
    root = folder

    def tap(name: str, df: DataFrame) -> DataFrame:
        nonlocal root
        spark = df.sparkSession
        root = root or scratch_path(spark, "stages")
        taps.append(name)
        sessions.append(spark)
        data, ledger = f"{root}/stage-{len(taps)}", f"{root}/counts/stage_no={len(taps)}"
        written = spark.read.schema(df.schema)
        if not (folder and _stage_whole(spark, data, ledger, df.schema)):
            df.write.mode("overwrite").parquet(data)
            _part_counts(written.parquet(data)).coalesce(1).write.mode("overwrite").parquet(ledger)
        return written.parquet(data)

    build(tap)
    spark = sessions[0]
    parts = spark.read.schema("part int, rows bigint, stage_no int").parquet(f"{root}/counts")
    found = parts.groupBy("stage_no").agg(F.sum("rows").alias("rows"))
    names = literal_table(spark, list(enumerate(taps, 1)), ["stage_no", "stage"])
    u = names.select(F.col("stage_no").cast("int").alias("stage_no"), "stage").join(found, "stage_no", "left")
    u = u.withColumn("rows", F.coalesce("rows", F.lit(0)).cast("bigint"))
    w = Window.orderBy("stage_no")  # a row a stage
    return u.select("stage_no", "stage", "rows", (F.col("rows") - F.lag("rows", 1).over(w)).cast("bigint").alias("rows_delta"))


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """null and distinct counts for every column.

    One aggregate per column, unioned: each reads its own column only and
    shuffles that column's (map-side de-duplicated) values. Several
    ``count(DISTINCT)`` in one aggregate would instead be planned as an
    ``Expand`` that copies every row once per column.
    """
    parts = []
    for c in list(cols or df.columns):
        d = F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))
        parts.append(df.agg(F.count_if(F.col(c).isNull()).cast("bigint").alias("null_count"),
                            d.cast("bigint").alias("distinct_count"))
                     .select(F.lit(c).alias("column_name"), "null_count", "distinct_count"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


# hll sketches of 2**12 registers: a relative standard error of 1.04 / sqrt(2**12)
SKETCH_LOG_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG_K / 2)


def profile_sketch(df: DataFrame, cols: Sequence[str] | None = None, **load) -> DataFrame:
    """F27, mergeable form: ``column_name, n_rows, null_count, sketch`` of each column
    from ONE scan, plus the columns of ``load`` (say a load date) as given. Store it by load
    and merge with :func:`merge_profiles`; no table is read again. Values are
    sketched by their text (binary as it is), so one sketch form serves all types."""
    cols = list(cols or df.columns)
    binary = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(F.col(c) if c in binary else F.col(c).cast("string"), F.lit(SKETCH_LOG_K)).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return one.select(F.inline(rows)).withColumns({k: F.lit(v) for k, v in load.items()})


def merge_profiles(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of several loads as one: counts add up, sketches are united. The
    estimate is that of a sketch of all rows, within about three times ``SKETCH_ERROR``."""
    out = stored.groupBy(*by, "column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("null_count").alias("null_count"), F.hll_union_agg("sketch").alias("sketch"))
    return out.withColumn("distinct_estimate", F.hll_sketch_estimate("sketch"))


def type_fail_count(c: ColLike, to: str) -> Column:
    """values present that do not cast to ``to``."""
    v = _col(c)
    return F.count_if(v.isNotNull() & v.try_cast(to).isNull())


def contract_check(df: DataFrame, expected: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """per expected field (name, type, not_null): present?, nulls where
    not-null is declared, values failing the declared type -- from the data."""
    present = set(df.columns)
    aggs = []
    for name, typ, not_null in expected:
        if name in present:
            aggs.append(F.count_if(F.col(name).isNull()).alias(f"{name}__n"))
            aggs.append(type_fail_count(F.col(name).cast("string"), typ).alias(f"{name}__t"))
    wide = df.agg(*aggs) if aggs else df.limit(1).select(F.lit(0).alias("_dummy"))
    rows = []
    for name, typ, not_null in expected:
        if name in present:
            nulls = F.col(f"{name}__n") if not_null else F.lit(0)
            rows.append(F.struct(F.lit(name).alias("field"), F.lit(typ).alias("declared_type"),
                                 F.lit(True).alias("present"), nulls.cast("bigint").alias("null_violations"),
                                 F.col(f"{name}__t").cast("bigint").alias("type_violations")))
        else:
            rows.append(F.struct(F.lit(name).alias("field"), F.lit(typ).alias("declared_type"),
                                 F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("null_violations"),
                                 F.lit(None).cast("bigint").alias("type_violations")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reject_rows(df: DataFrame, rules: Sequence[tuple[str, Column]],
                reason_col: str = "reject_reason") -> DataFrame:
    """first failing rule's name as the reason (null = good row)."""
    expr = None
    for name, bad in rules:
        expr = F.when(bad, F.lit(name)) if expr is None else expr.when(bad, F.lit(name))
    return df.withColumn(reason_col, expr)


def good_rows(df: DataFrame, reason_col: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason_col).isNull()).drop(reason_col)


def error_rows(df: DataFrame, reason_col: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason_col).isNotNull())


def load_timestamp(df: DataFrame, as_of: str, name: str = "load_ts") -> DataFrame:
    """F32: audit column from a passed-in as-of time (never the wall clock)."""
    return df.withColumn(name, F.lit(as_of).cast("timestamp_ntz"))


# ours: source-type -> Spark-type table for F33
TYPE_MAP = {
    "string": "string", "varchar": "string", "char": "string", "text": "string",
    "integer": "int", "int": "int", "smallint": "smallint", "bigint": "bigint", "number": "decimal(38,10)",
    "decimal": "decimal(18,2)", "double": "double", "float": "double",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
}


def type_mapping(df: DataFrame, source_types: Mapping[str, str],
                 type_map: Mapping[str, str] = TYPE_MAP, strict: bool = False) -> DataFrame:
    """cast columns by a source-type -> Spark-type table (try_cast unless strict)."""
    out = {}
    for c, st in source_types.items():
        key = st.lower().replace(" ", "")
        base, _, params = key.partition("(")
        mapped = type_map.get(key) or type_map.get(base, base)
        if params and mapped.startswith("decimal"):
            tgt = "decimal(" + params  # keep declared precision/scale
        else:
            tgt = mapped                # lengths of char/varchar are dropped
        out[c] = F.col(c).cast(tgt) if strict else F.col(c).try_cast(tgt)
    return df.withColumns(out)


def hash_partition(df: DataFrame, n: int | None, keys: Sequence[str]) -> DataFrame:
    """hash-partition by key (the Hash partitioner stage).

    ``n=None`` takes the session's shuffle partition count (sized for the
    cluster), which AQE may coalesce -- a key still lands in one partition.
    """
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def bucketed_table(df: DataFrame, name: str, path: str, keys: Sequence[str], n: int) -> DataFrame:
    """a table stored hash-partitioned by key: ``n`` buckets, each sorted by the
    keys. Joins and aggregates by these keys, of tables with equal ``n``, need no
    exchange any more: the shuffle is paid once, at the write. Rows are dealt by the
    bucket hash first, so that a task writes whole buckets (one file each)."""
    df.repartition(n, *keys).write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def join_hint(df: DataFrame, hint: str) -> DataFrame:
    """broadcast / shuffle_hash / merge hint on one side; results are equal."""
    return df.hint(hint)


def runtime_params(spark: SparkSession, sql: str, params: Mapping[str, object]) -> DataFrame:
    """job parameters as named SQL parameters (no string splicing)."""
    return spark.sql(sql, args=dict(params))
