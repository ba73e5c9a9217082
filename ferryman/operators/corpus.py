"""Script-corpus sources, profiling and pricing (family A).

A corpus is a table with one row per script; every function here is a
projection/filter over it (no shuffle), except the folder scan itself.
"""

from __future__ import annotations

import re

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryman.functions.num import py_round
from ferryman.functions.text import line_count_newlines, splitlines_count, token_count
from ferryman.session import materialize

# fixed values: allowed upload extensions per source platform (UI contract)
SOURCE_FILE_EXT = {
    "SAS": ".sas",
    "Oracle": ".sql",
    "Teradata": ".sql",
    "MS SQL Server": ".sql",
    "Apache Hive": ".sql",
    "Azure Synapse Analytics": ".sql",
    "SAP HANA": ".sql",
    "PLSQL": ".sql",
    "Informatica": ".xml",
    "Datastage": ".xml",
    "Snowflake": ".sql",
    "COBOL": ".cbl,.cob",
}

# fixed values: pre-run estimate ratios
TOKENS_PER_LINE = 17.5
LLM_OUT_RATIO = 0.12
OPT_IN_RATIO = 0.04
OPT_OUT_RATIO = 0.60

# fixed values: USD per 1000 tokens, matched in this order as substrings of the model name
RATES = [
    ("gpt-4o", "0.005", "0.015"),
    ("gpt-4", "0.03", "0.06"),
    ("gpt-35", "0.001", "0.002"),
    ("gemini", "0.0015", "0.0015"),
]
DEFAULT_RATE_KEY = "gpt-4o"

# fixed values: output extension by target (unknown target -> .sql)
EXT_BY_TARGET = {"pyspark": ".py", "python": ".py", "snowpark": ".py", "matillion": ".json", "dbt": ".yml"}
DEFAULT_EXT = ".sql"

RATE_TYPE = "decimal(10,4)"


def _norm_path(c: Column) -> Column:
    # the file index spells local paths file:///x, the reader file:/x
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def utf8_ignore(raw: Column) -> Column:
    """``bytes.decode("utf-8", errors="ignore")`` on a binary column, JVM-side.

    ``make_valid_utf8`` turns each invalid sequence into U+FFFD, which is then
    removed. A U+FFFD that was already in the file is valid text and must stay,
    so it is escaped first (U+E000 as the escape character, itself escaped):
    the bytes EF BF BD are always a genuine U+FFFD, so a plain replace on the
    raw bytes finds exactly those.
    """
    esc, rep = "\ue000", "\ufffd"
    s = F.replace(raw.cast("string"), F.lit(esc), F.lit(esc + "\ue001"))
    s = F.replace(s, F.lit(rep), F.lit(esc + "\ue002"))
    s = F.replace(F.make_valid_utf8(s), F.lit(rep), F.lit(""))
    s = F.replace(s, F.lit(esc + "\ue002"), F.lit(rep))
    return F.replace(s, F.lit(esc + "\ue001"), F.lit(esc))


#: ours: files and bytes that a task of the scan reads, about; rows and bytes of a batch between Python and the JVM
FILES_A_TASK, BYTES_A_TASK = 1000, 64 << 20
ROWS_A_BATCH, BYTES_A_BATCH = 10_000, 8 << 20
#: path below the root, the folder above the partition columns among its folders, and these
_LISTED = "root string, path string, length long, folder boolean, base string, names array<string>, vals array<string>"


def corpus_scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A1: one row per file; bytes -> UTF-8 with undecodable bytes dropped.

    Which files count and how ``name=value`` folders become columns is as with Spark's file index,
    which keeps every path in the driver. Here the tasks list the folders, one level
    of the tree after the other, and write what they find; the files of that list are then
    dealt to tasks that read them, also those that Spark's file scans skip (empty ones, those
    beside partition folders). The driver gets counts, the names of the partition columns and the kinds of their values.

    Tasks reach the files through pyarrow. A store that it does not reach is read by Spark's index.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    roots = [(s.getPath().toString(), _store_uri(s.getPath().toUri().toASCIIString()), s.isDirectory(), s.getLen()) for s in found]
    if not all(_reached(uri) for _, uri, _, _ in roots):
        return _scan_by_index(spark, path, glob)
    files, folders = _listed_files(spark, roots)
    if glob:
        name = F.regexp_extract(F.concat("root", F.lit("/"), "path"), "([^/]*)/?$", 1)
        files = files.filter(F.regexp_like(name, F.lit(f"^(?:{jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})$")))
    n = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(n.files, 4 * spark.sparkContext.defaultParallelism), n.files // FILES_A_TASK, n.bytes // BYTES_A_TASK)
    full = F.when(F.col("path") == "", F.col("root")).otherwise(F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"), F.col("path")))
    rows = files.select(full.alias("path"), "vals", "root", F.col("path").alias("below"))
    read = rows.repartition(tasks, "path").mapInArrow(_reader({root: uri for root, uri, _, _ in roots}),
                                                      "path string, length long, vals array<string>, content binary")
    return read.select("path", "length", *[F.get("vals", F.lit(i)).cast(t).alias(c) for i, c, t in folders],
                       utf8_ignore(F.col("content")).alias("text"))


def _store_uri(uri: str) -> str:
    return re.sub("^file:/+", "file:///", uri)


def _reached(uri: str) -> bool:
    try:
        store, root = pa_fs.FileSystem.from_uri(uri)
        return store.get_file_info(root).type != pa_fs.FileType.NotFound
    except (OSError, pa.ArrowException):
        return False


def _lister(uris: dict[str, str]):
    """Task that turns rows (root, path) of folders into those of what lies in them. As the reader's, it travels with all
    that it calls, so that executors need no copy of this package."""
    def hidden(name: str) -> bool:  # names that Spark's file sources pass over
        return ((name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")) \
            and not name.startswith(("_common_metadata", "_metadata"))

    def unescaped(x: str) -> str:
        return re.sub("%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), x)

    def partition(folder: str) -> tuple[str, list[str], list[str | None]]:  # the lowest ``name=value`` folders that follow each other
        parts = folder.split("/")
        end = max((i + 1 for i, x in enumerate(parts) if "=" in x), default=0)
        begin = max((i + 1 for i, x in enumerate(parts[:end]) if "=" not in x), default=0)
        pairs = [x.split("=", 1) for x in parts[begin:end]]
        return "/".join(parts[:begin]) if pairs else folder, [unescaped(k) for k, _ in pairs], \
            [None if v == "__HIVE_DEFAULT_PARTITION__" else unescaped(v) for _, v in pairs]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_()),
                            ("base", pa.string()), ("names", pa.list_(pa.string())), ("vals", pa.list_(pa.string()))])
        for root, folder in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            store, top = pa_fs.FileSystem.from_uri(uris[root])
            base, names, vals = partition(folder)
            inside = [x for x in store.get_file_info(pa_fs.FileSelector(f"{top}/{folder}" if folder else top)) if not hidden(x.base_name)]
            for i in range(0, len(inside), ROWS_A_BATCH):
                some = inside[i:i + ROWS_A_BATCH]
                yield pa.RecordBatch.from_pydict({
                    "root": [root] * len(some), "path": [f"{folder}/{x.base_name}" if folder else x.base_name for x in some],
                    "length": [x.size or 0 for x in some], "folder": [x.type == pa_fs.FileType.Directory for x in some],
                    "base": [base] * len(some), "names": [names] * len(some), "vals": [vals] * len(some)}, schema=schema)
    return task


def _listed_files(spark: SparkSession, roots: list[tuple[str, str, bool, int]]) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """The files that Spark's file index takes from the roots, and place, name and type of the partition columns."""
    lister = _lister({root: uri for root, uri, _, _ in roots})
    files = spark.createDataFrame([(root, "", size, False, "", [], []) for root, _, is_dir, size in roots if not is_dir], _LISTED)
    level, n = spark.createDataFrame([(root, "") for root, _, is_dir, _ in roots if is_dir], "root string, path string"), len(roots)
    while n:
        tasks = max(min(n, 4 * spark.sparkContext.defaultParallelism), n // FILES_A_TASK)
        listed = materialize(level.repartition(tasks, "root", "path").mapInArrow(lister, _LISTED), "corpus_list")
        files = files.unionAll(listed.filter("not folder"))
        level = listed.filter("folder").select("root", "path")
        n = level.count()
    parted = files.filter(F.size("names") > 0)
    base = F.lower(F.concat("root", F.lit("/"), "base"))
    least, most, above, beside = files.agg(*[f(F.when(F.size("names") > 0, F.col("names"))) for f in (F.min, F.max)], F.min(base), F.max(base)).first()
    if least is None:  # no partition folders: only what lies in the roots themselves
        return files.filter(~F.contains("path", F.lit("/"))), []
    if above != beside:
        raise SparkRuntimeException(f"[CONFLICTING_DIRECTORY_STRUCTURES] Conflicting directory structures detected: {above}, {beside}")
    if least != most:
        raise SparkRuntimeException(f"[CONFLICTING_PARTITION_COLUMN_NAMES] Conflicting partition column names detected: {least}, {most}")
    if taken := {"path", "length", "text"} & set(least):
        raise AnalysisException(f"[COLUMN_ALREADY_EXISTS] The column `{min(taken)}` already exists.")
    kinds = parted.agg(*[F.collect_set(_kind(F.get("vals", F.lit(i)))).alias(f"k{i}") for i in range(len(least))],
                       *[F.max(F.length(F.regexp_extract(F.get("vals", F.lit(i)), r"^[+-]?0*(\d+)$", 1))).alias(f"d{i}") for i in range(len(least))]).first()
    typed = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
    return files, [(i, c, _type(set(kinds[f"k{i}"]), kinds[f"d{i}"]) if typed else "string") for i, c in enumerate(least)]


def _kind(v: Column) -> Column:
    """What the value of a partition folder looks like; null is left out."""
    whole = F.regexp_like(v, F.lit(r"^[+-]?\d+$"))
    return (F.when(v.isNull(), F.lit(None))
            .when(whole & v.try_cast("int").isNotNull(), "int")
            .when(whole & v.try_cast("bigint").isNotNull(), "bigint")
            .when(F.regexp_like(v, F.lit(r"^[+-]?0*\d{1,38}$")), "decimal")
            .when(F.regexp_like(v, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity)$")), "double")
            .when(F.regexp_like(v, F.lit(r"^\d{4}-\d\d-\d\d$")) & v.try_cast("date").isNotNull(), "date")
            .when(F.regexp_like(v, F.lit(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$")) & v.try_cast("timestamp").isNotNull(), "timestamp")
            .otherwise("string"))


def _type(kinds: set[str], digits: int) -> str:
    """The narrowest type that holds all kinds, as Spark's partition discovery joins them."""
    for fits in ("int",), ("int", "bigint"), ("date",), ("date", "timestamp"), ("int", "double"):
        if kinds and kinds <= set(fits):
            return fits[-1]
    if "decimal" in kinds and kinds <= {"int", "bigint", "decimal"}:
        return f"decimal({max(digits, 20 if 'bigint' in kinds else 0)},0)"
    return "string"


def _reader(uris: dict[str, str]):
    """Task that reads the files whole."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("vals", pa.list_(pa.string())), ("content", pa.binary())])
        stores = {root: pa_fs.FileSystem.from_uri(uri) for root, uri in uris.items()}
        rows, held = [], 0
        for path, vals, root, below in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            store, top = stores[root]
            with store.open_input_stream(f"{top}/{below}" if below else top, compression=None) as f:
                content = f.read()
            rows.append((path, len(content), vals, content))
            held += len(content)
            if held >= BYTES_A_BATCH or len(rows) >= ROWS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return task


def _scan_by_index(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """The scan by Spark's reader, for stores that pyarrow does not reach: the paths are held in the driver.

    ``binaryFile`` reads each file whole on an executor; partition folders in
    the path become columns. The empty files are the paths of the file index
    that the scan does not return, found by an anti join on paths (which reads no
    content) and added with empty text; their partition folders become columns as well. The
    index's paths are dealt to the tasks inside the JVM: no list of them passes
    through Python or the plan.
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    text = utf8_ignore(F.col("content"))
    files = df.withColumn("text", text).drop("content", "modificationTime")
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    index = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(df._jdf.inputFiles())
    paths = sc._jsc.sc().parallelize(index, sc.defaultParallelism, jvm.scala.reflect.ClassTag.AnyRef())
    listed = DataFrame(spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # the index spells paths as URLs, the reader as they are; partition folders escape values once more
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    listed = listed.select(_norm_path(plain(F.col("value"))).alias("path"))
    folders = [f for f in df.schema.fields if f.name not in ("path", "modificationTime", "length", "content")]
    empty = listed.join(df.select(_norm_path(F.col("path")).alias("path")), "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"),
        *[F.nullif(plain(F.regexp_extract("path", f"/{re.escape(f.name)}=([^/]*)/", 1)), F.lit("")).cast(f.dataType).alias(f.name) for f in folders],
        F.lit("").alias("text"))
    return files.unionByName(empty)


def eligible(df: DataFrame, source: str = "source", target: str = "target",
             filename: str = "filename") -> DataFrame:
    """A2: source differs from target, and SAS sources need a ``.sas`` file."""
    s, t = F.lower(F.col(source)), F.lower(F.col(target))
    return df.filter((s != t) & ((s != "sas") | F.lower(F.col(filename)).endswith(".sas")))


def _ext_map() -> Column:
    return F.create_map(*[x for k, v in SOURCE_FILE_EXT.items() for x in (F.lit(k), F.lit(v))])


def extension(filename: Column) -> Column:
    """Last suffix including the dot, lower-cased; '' when there is none."""
    return F.lower(F.regexp_extract(filename, r"(?<=.)(\.[^./]*)$", 1))


def ext_allowed(df: DataFrame, source: str = "source", filename: str = "filename") -> DataFrame:
    """A3: the file extension is one of the source's allowed extensions.

    The 12-entry map is a literal expression, so no join is needed at all.
    """
    allowed = F.split(F.element_at(_ext_map(), F.col(source)), ",")
    ext = extension(F.col(filename))
    return df.withColumn("ext", ext).withColumn(
        "allowed", F.coalesce(F.array_contains(allowed, ext), F.lit(False)))


def line_counts(text: Column) -> dict[str, Column]:
    """A4: ``count('\\n') + 1`` (1 for empty text) and ``len(splitlines())``."""
    return {"line_count": line_count_newlines(text), "splitlines": splitlines_count(text)}


def rate_columns(model: Column) -> dict[str, Column]:
    """First rate key (in listed order) contained in the lower-cased model name.

    The rate table is a literal array of structs, filtered per row: no join,
    no shuffle; default key when nothing matches.
    """
    rates = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(k).alias("key"),
                               F.lit(a).cast(RATE_TYPE).alias("rin"), F.lit(b).cast(RATE_TYPE).alias("rout"))
                      for i, (k, a, b) in enumerate(RATES)])
    m = F.lower(model)
    hit = F.try_element_at(F.filter(rates, lambda r: F.contains(m, r["key"])), F.lit(1))
    d = [r for r in RATES if r[0] == DEFAULT_RATE_KEY][0]
    return {
        "rate_key": F.coalesce(hit["key"], F.lit(d[0])),
        "rate_in": F.coalesce(hit["rin"], F.lit(d[1]).cast(RATE_TYPE)),
        "rate_out": F.coalesce(hit["rout"], F.lit(d[2]).cast(RATE_TYPE)),
    }


def usd(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """``round((in/1e3)*rate_in + (out/1e3)*rate_out, 6)`` exactly as the
    reference's Python floats give it: the same double operations in the same
    order, then Python's rounding of the binary value (``py_round``)."""
    k = F.lit(1000.0)
    x = (tokens_in.cast("double") / k) * rate_in.cast("double") \
        + (tokens_out.cast("double") / k) * rate_out.cast("double")
    return py_round(x, 6)


def cost_estimate(df: DataFrame, text: str = "text", model: str = "model") -> DataFrame:
    """Pre-run token and cost estimate from the line count (double math + floor,
    as the estimate's integer truncation of positive products)."""
    lines = line_count_newlines(F.col(text))
    llm_in = F.floor(lines * F.lit(TOKENS_PER_LINE)).cast("bigint")
    out = df.withColumn("lines", lines).withColumn("llm_in", llm_in)
    out = out.withColumns({
        "llm_out": F.floor(F.col("llm_in") * F.lit(LLM_OUT_RATIO)).cast("bigint"),
        "opt_in": F.floor(F.col("llm_in") * F.lit(OPT_IN_RATIO)).cast("bigint"),
    }).withColumn("opt_out", F.floor(F.col("opt_in") * F.lit(OPT_OUT_RATIO)).cast("bigint"))
    out = out.withColumns({
        "total_in": F.col("llm_in") + F.col("opt_in"),
        "total_out": F.col("llm_out") + F.col("opt_out"),
    }).withColumn("total_tokens", F.col("total_in") + F.col("total_out"))
    out = out.withColumns(rate_columns(F.col(model)))
    return out.withColumn("cost_usd", usd(F.col("total_in"), F.col("total_out"),
                                          F.col("rate_in"), F.col("rate_out")))


def stem(filename: Column) -> Column:
    """``Path(name).stem``: drop the last suffix (a leading dot is not a suffix)."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def target_ext(target: Column, mapping: Mapping[str, str] = EXT_BY_TARGET, default: str = DEFAULT_EXT) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(target)), F.lit(default))


def output_names(filename: Column, target: Column) -> dict[str, Column]:
    """``Optimized_<stem><ext>`` and ``Before_Optimized_<stem><ext>``."""
    s, e = stem(filename), target_ext(target)
    return {"stem": s, "final_name": F.concat(F.lit("Optimized_"), s, e),
            "before_name": F.concat(F.lit("Before_Optimized_"), s, e)}


#: ours: a null in a CSV sink; no value looks like it, since a backslash of a value is doubled
NULL_MARK = "\\N"


def write_csv_all_quoted(df: DataFrame, path: str) -> None:
    """Every field quoted, nulls as ``NULL_MARK``, quotes doubled, ``\\n`` line ends, header row, and
    a backslash in the data written as two (the escape character escapes
    itself, as Python's csv writer does with ``escapechar='\\\\'``)."""
    bs = F.lit("\\")
    df = df.select(*[F.replace(F.col(f.name), bs, F.lit("\\\\")).alias(f.name)
                     if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("lineSep", "\n").option("nullValue", NULL_MARK).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_csv_all_quoted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads what :func:`write_csv_all_quoted` wrote, undoing the backslash escape."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("nullValue", NULL_MARK).option("emptyValue", "").csv(path))
    return df.select(*[F.replace(F.col(f.name), F.lit("\\\\"), F.lit("\\")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def write_json_lines(df: DataFrame, path: str) -> None:
    """A10: JSON-lines records (one object per line, readable back with a schema)."""
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def profile(df: DataFrame, text: str = "text", keys: Sequence[str] = ("script_id",)) -> DataFrame:
    """A4+A5 together: the per-script profile row."""
    lc = line_counts(F.col(text))
    return df.select(*keys, lc["line_count"].alias("line_count"), lc["splitlines"].alias("splitlines"),
                     token_count(F.col(text)).alias("tokens"))
