"""Family A queries: corpus scan, eligibility, profiling, pricing, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.functions.num import duck_py_round
from ferryman.functions.text import duck_splitlines_count, duck_tokens, token_count
from ferryman.operators import corpus
from ferryman.plans.registry import query
from ferryman.session import scratch_path
from ferryman.sources import fixtures as fx


# A1 -----------------------------------------------------------------------
# the files are written with a line break behind the text
@query("corpus_scan", fx.with_ctes("SELECT script_id, CAST(strlen(text) + 1 AS BIGINT) AS length, text || chr(10) AS text FROM scripts", "scripts"))
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Scan the script corpus laid down as one file per script (the files are
    written once per application from ``documents``, as a deployment would
    already have them)."""
    script_id = F.nullif(F.regexp_extract("path", r"/script_(-?\d*)\.txt$", 1), F.lit("")).cast("bigint")
    return corpus.corpus_scan(spark, fx.script_files(spark, sf)).select(script_id.alias("script_id"), "length", "text")


# A2 ---------------------------------------------------------------------
@query("corpus_eligible", fx.with_ctes("""
SELECT script_id, source, target, filename FROM scripts
WHERE lower(source) <> lower(target) AND (lower(source) <> 'sas' OR lower(filename) LIKE '%.sas')""", "scripts"))
def corpus_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.eligible(fx.scripts(spark, sf)).select("script_id", "source", "target", "filename")


# A3 ---------------------------------------------------------------------
def _duck_ext_case() -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.SOURCE_FILE_EXT.items()) + " END"


@query("ext_allowed", fx.with_ctes(f"""
SELECT script_id, source, filename, ext,
       coalesce(list_contains(string_split({_duck_ext_case()}, ','), ext), false) AS allowed
FROM (SELECT *, lower(regexp_extract(filename, '[^/](\\.[^./]*)$', 1)) AS ext FROM scripts) s""", "scripts"))
def ext_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ext_allowed(fx.scripts(spark, sf)).select("script_id", "source", "filename", "ext", "allowed")


# A4 ---------------------------------------------------------------------
@query("line_counts", f"""
SELECT doc_id AS script_id,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count,
       {duck_splitlines_count('text')} AS splitlines
FROM documents""")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    lc = corpus.line_counts(F.col("text"))
    return d.select(F.col("doc_id").alias("script_id"), lc["line_count"].alias("line_count"),
                    lc["splitlines"].alias("splitlines"))


# A5 ---------------------------------------------------------------------
@query("token_counts", f"SELECT doc_id AS script_id, {duck_tokens('text')} AS tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("script_id"), token_count("text").alias("tokens"))


# A6 / A7 shared SQL -------------------------------------------------------
RATES_SQL = "(VALUES " + ", ".join(
    f"({i}, '{k}', CAST({a} AS DECIMAL(10,4)), CAST({b} AS DECIMAL(10,4)))"
    for i, (k, a, b) in enumerate(corpus.RATES)) + ") r(prio, rkey, rin, rout)"

_D = [r for r in corpus.RATES if r[0] == corpus.DEFAULT_RATE_KEY][0]


def rate_join_sql(src: str, key_cols: str) -> str:
    """First-match rate per row of ``src`` (identified by ``key_cols``) with default."""
    return f"""
SELECT s.*, coalesce(m.rkey, '{_D[0]}') AS rate_key,
       coalesce(m.rin, CAST({_D[1]} AS DECIMAL(10,4))) AS rate_in,
       coalesce(m.rout, CAST({_D[2]} AS DECIMAL(10,4))) AS rate_out
FROM {src} s LEFT JOIN (
  SELECT {key_cols}, rkey, rin, rout FROM (
    SELECT {', '.join('s2.' + k.strip() for k in key_cols.split(','))}, r.rkey, r.rin, r.rout,
           row_number() OVER (PARTITION BY {', '.join('s2.' + k.strip() for k in key_cols.split(','))} ORDER BY r.prio) AS rn
    FROM {src} s2 JOIN {RATES_SQL} ON contains(lower(s2.model), r.rkey)) WHERE rn = 1
) m USING ({key_cols})"""


def usd_sql(tin: str, tout: str, rin: str, rout: str) -> str:
    x = (f"(CAST({tin} AS DOUBLE) / 1000.0) * CAST({rin} AS DOUBLE) + "
         f"(CAST({tout} AS DOUBLE) / 1000.0) * CAST({rout} AS DOUBLE)")
    return duck_py_round(x, 6)


# A6 ---------------------------------------------------------------------
_EST_SQL = """
SELECT script_id, model, lines, llm_in, llm_out, opt_in, opt_out,
       llm_in + opt_in AS total_in, llm_out + opt_out AS total_out,
       llm_in + opt_in + llm_out + opt_out AS total_tokens
FROM (SELECT *, CAST(floor(CAST(opt_in AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS opt_out FROM (
  SELECT *, CAST(floor(CAST(llm_in AS DOUBLE) * CAST(0.12 AS DOUBLE)) AS BIGINT) AS llm_out,
            CAST(floor(CAST(llm_in AS DOUBLE) * CAST(0.04 AS DOUBLE)) AS BIGINT) AS opt_in FROM (
    SELECT script_id, model, lines, CAST(floor(CAST(lines AS DOUBLE) * CAST(17.5 AS DOUBLE)) AS BIGINT) AS llm_in FROM (
      SELECT script_id, model, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines
      FROM scripts))))"""


@query("cost_estimate", fx.with_ctes(f"""
SELECT script_id, model, lines, llm_in, llm_out, opt_in, opt_out, total_in, total_out, total_tokens, rate_key,
       {usd_sql('total_in', 'total_out', 'rate_in', 'rate_out')} AS cost_usd
FROM rated""", "scripts", extra=[("est", _EST_SQL), ("rated", rate_join_sql("est", "script_id"))]))
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    est = corpus.cost_estimate(fx.scripts(spark, sf))
    return est.select("script_id", "model", "lines", "llm_in", "llm_out", "opt_in", "opt_out", "total_in",
                      "total_out", "total_tokens", "rate_key", "cost_usd")


# A7 ---------------------------------------------------------------------
@query("rate_lookup", fx.with_ctes("""
SELECT job_id, id, model, rate_key, rate_in, rate_out FROM rated""", "conv_results",
                                   extra=[("rated", rate_join_sql("conv_results", "job_id, id"))]))
def rate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cr = fx.conv_results(spark, sf).select("job_id", "id", "model")
    return cr.withColumns(corpus.rate_columns(F.col("model")))


# A8 ---------------------------------------------------------------------
@query("basename_and_ext", fx.with_ctes("""
SELECT script_id, stem, concat('Optimized_', stem, ext) AS final_name, concat('Before_Optimized_', stem, ext) AS before_name
FROM (SELECT script_id,
        CASE WHEN strpos(substr(filename, 2), '.') > 0 THEN regexp_replace(filename, '\\.[^.]*$', '') ELSE filename END AS stem,
        CASE lower(target) WHEN 'pyspark' THEN '.py' WHEN 'python' THEN '.py' WHEN 'snowpark' THEN '.py'
             WHEN 'matillion' THEN '.json' WHEN 'dbt' THEN '.yml' ELSE '.sql' END AS ext
      FROM scripts)""", "scripts"))
def basename_and_ext(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scripts(spark, sf)
    names = corpus.output_names(F.col("filename"), F.col("target"))
    return s.select("script_id", *[v.alias(k) for k, v in names.items()])


_CR_SCHEMA = "job_id bigint, id string, ok boolean, code string, input_tokens bigint, output_tokens bigint"


# A9 ---------------------------------------------------------------------
@query("csv_sink", fx.with_ctes(
    "SELECT job_id, id, ok, code, input_tokens, output_tokens FROM conv_results", "conv_results"))
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv_sink")
    corpus.write_csv_all_quoted(fx.conv_results(spark, sf).select(*[c.split()[0] for c in _CR_SCHEMA.split(",")]),
                                path)
    return corpus.read_csv_all_quoted(spark, path, _CR_SCHEMA)


# A10 --------------------------------------------------------------------
@query("json_sink", fx.with_ctes(
    "SELECT job_id, id, ok, code, input_tokens, output_tokens FROM conv_results", "conv_results"))
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json_sink")
    corpus.write_json_lines(fx.conv_results(spark, sf).select(*[c.split()[0] for c in _CR_SCHEMA.split(",")]),
                            path)
    return corpus.read_json_lines(spark, path, _CR_SCHEMA)
