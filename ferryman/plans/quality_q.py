"""Family D queries over ``conv_results`` (and documents / conversations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.functions.text import PY_LINEBREAK, PY_WS, duck_splitlines_count, duck_tokens, duck_trim
from ferryman.operators import quality as q
from ferryman.plans.corpus_q import rate_join_sql, usd_sql
from ferryman.plans.registry import query
from ferryman.session import materialize
from ferryman.sources import fixtures as fx
from ferryman.sources.tables import table

AS_OF = "2024-06-30T12:00:00"
_PY = "(" + ", ".join(f"'{t}'" for t in q.PYTHON_TARGETS) + ")"
_SQLT = "(" + ", ".join(f"'{t}'" for t in q.SQL_TARGETS) + ")"


def cr(spark, sf):
    return fx.conv_results(spark, sf)


def _reason_class(df):
    """The parser's message is its own; the query gives the kind of failure."""
    return df.withColumn("reason", F.when(F.col("reason").startswith("SyntaxError:"), "SyntaxError")
                         .otherwise(F.col("reason")))


# ------------------------------------------------------------------ SQL kit
def d_num(x):
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '(\\d+)', 1), '') AS BIGINT), -1)"


def d_sub(x):
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '_sub(\\d+)$', 1), '') AS BIGINT), -1)"


def d_lstrip(x):
    return f"regexp_replace({x}, '^{PY_WS}+', '')"


def d_section(x):
    return (f"CASE WHEN contains({x}, '###OUTPUT###') AND contains({x}, '###END_OUTPUT###') "
            f"THEN split_part(substring({x}, strpos({x}, '###OUTPUT###') + 12), '###END_OUTPUT###', 1) ELSE {x} END")


_FENCE = "regexp_replace(c2, '^```[a-zA-Z]*', '')"


def clean_ctes(src: str, keys: str, code: str, prefix: str, marker_step: bool = True) -> list[tuple[str, str]]:
    """CTE chain computing the validator's cleaned text as ``cleaned``."""
    c2 = (f"CASE WHEN contains(c1, '###OUTPUT###') AND contains(c1, '###END_OUTPUT###') "
          f"THEN {duck_trim(d_section('c1'))} ELSE c1 END") if marker_step else "c1"
    return [
        (f"{prefix}1", f"SELECT {keys}, {duck_trim(code)} AS c1 FROM {src}"),
        (f"{prefix}2", f"SELECT {keys}, {c2} AS c2 FROM {prefix}1"),
        (f"{prefix}3", f"SELECT {keys}, CASE WHEN starts_with(c2, '```') THEN "
                       f"{duck_trim(_FENCE)} ELSE c2 END AS c3 FROM {prefix}2"),
        (f"{prefix}4", f"SELECT {keys}, CASE WHEN ends_with(c3, '```') THEN left(c3, length(c3) - 3) ELSE c3 END AS c4 "
                       f"FROM {prefix}3"),
        (prefix, f"SELECT {keys}, {duck_trim('c4')} AS cleaned FROM {prefix}4"),
    ]


def d_meaningful(x):
    return (f"(len(list_filter(regexp_split_to_array({x}, '{PY_LINEBREAK}'), lambda l: l <> '' AND NOT "
            f"starts_with({d_lstrip('l')}, '--') AND NOT starts_with({d_lstrip('l')}, '#'))) > 0)")


def d_balanced(x):
    p = f"regexp_replace({x}, '[^()]', '', 'g')"
    return (f"(CASE WHEN {p} = '' THEN true ELSE list_reduce(string_split({p}, ''), lambda acc, ch: "
            f"CASE WHEN acc < 0 THEN acc ELSE acc + CASE WHEN ch = '(' THEN 1 ELSE -1 END END, 0) = 0 END)")


def d_quotes(x):
    return (f"((length({x}) - length(replace({x}, '''', ''))) % 2 = 0 AND "
            f"(length({x}) - length(replace({x}, '\"', ''))) % 2 = 0)")


def d_sql_reason(x, comments=True):
    mid = f"WHEN NOT {d_meaningful(x)} THEN '{q.R_COMMENTS}' " if comments else ""
    return (f"CASE WHEN {x} = '' THEN '{q.R_EMPTY}' {mid}WHEN NOT {d_balanced(x)} THEN '{q.R_PARENS}' "
            f"WHEN NOT {d_quotes(x)} THEN '{q.R_QUOTES}' ELSE '{q.R_SQL_OK}' END")


def jobs_ctes() -> list[tuple[str, str]]:
    """merged code per job, its base code (dedup for Python targets), usage rows."""
    lb = PY_LINEBREAK
    return [
        ("okm", f"""SELECT job_id, string_agg(t, chr(10) || chr(10) ORDER BY n, s, id) AS merged,
                   CAST(count(*) AS BIGINT) AS n_chunks
            FROM (SELECT job_id, id, {duck_trim('code')} AS t, {d_num('id')} AS n, {d_sub('id')} AS s
                  FROM conv_results WHERE ok) GROUP BY job_id"""),
        ("jmeta", "SELECT job_id, min(target) AS target, min(model) AS model FROM conv_results GROUP BY job_id"),
        ("jm", """SELECT j.job_id, j.target, j.model, coalesce(m.merged, '') AS merged,
                  coalesce(m.n_chunks, CAST(0 AS BIGINT)) AS n_chunks FROM jmeta j LEFT JOIN okm m USING (job_id)"""),
        ("jlines", f"""SELECT job_id, unnest(arr) AS l, generate_subscripts(arr, 1) AS i FROM (
            SELECT job_id, CASE WHEN merged = '' THEN CAST([] AS VARCHAR[])
                   ELSE regexp_split_to_array(regexp_replace(merged, '({lb})$', ''), '{lb}') END AS arr
            FROM jm WHERE lower(target) IN {_PY})"""),
        ("jflag", f"""SELECT *, (starts_with(t, 'import') OR starts_with(t, 'from')
                          OR starts_with(t, 'spark = SparkSession.builder')) AS imp,
                  row_number() OVER (PARTITION BY job_id, t ORDER BY i) AS rn
            FROM (SELECT *, {duck_trim('l')} AS t FROM jlines)"""),
        ("jdd", "SELECT job_id, string_agg(l, chr(10) ORDER BY i) AS txt FROM jflag WHERE NOT imp OR rn = 1 GROUP BY job_id"),
        ("jbase", f"""SELECT jm.*, CASE WHEN lower(target) IN {_PY}
                     THEN regexp_replace(coalesce(jdd.txt, ''), '\\n{{3,}}', chr(10) || chr(10), 'g')
                     ELSE {duck_trim('merged')} END AS base_code
            FROM jm LEFT JOIN jdd USING (job_id)"""),
        *clean_ctes("jbase", "job_id", "base_code", "jfin", marker_step=False),
        ("jobs", """SELECT jbase.*, regexp_replace(cleaned, '\\n{3,}', chr(10) || chr(10), 'g') AS final_code
            FROM jbase JOIN jfin USING (job_id)"""),
        ("usage", f"""SELECT job_id, 'llm' AS stage, CAST(sum(input_tokens) AS BIGINT) AS input,
                       CAST(sum(output_tokens) AS BIGINT) AS output, first(model) AS model
                FROM conv_results GROUP BY job_id
            UNION ALL
            SELECT job_id, 'optimize', {duck_tokens('base_code')}, {duck_tokens('base_code')}, model FROM jobs"""),
    ]


def with_cr(body, extra=()):
    return fx.with_ctes(body, "conv_results", extra=list(extra))


# D1 ---------------------------------------------------------------------
def _stub_converter(rec: dict) -> str:
    """Stand-in for a model call: fails on every fifth turn."""
    if int(rec["turn"]) % 5 == 0:
        raise ValueError("stub failure")
    return "-- converted " + rec["text"]


@query("enrich_isolated", f"""
SELECT conv_id AS job_id, turn, concat('blk_', lpad(CAST(turn AS VARCHAR), 3, '0')) AS id,
  turn % 5 <> 0 AS ok,
  CASE WHEN turn % 5 = 0 THEN '{q.LLM_ERROR_PREFIX}stub failure' ELSE {duck_trim("concat('-- converted ', text)")} END AS code,
  CASE WHEN turn % 5 = 0 THEN 0 ELSE {duck_tokens('text')} END AS input_tokens,
  CASE WHEN turn % 5 = 0 THEN 0 ELSE {duck_tokens("concat('-- converted ', text)")} END AS output_tokens,
  CASE WHEN turn % 5 = 0 THEN 0 ELSE {duck_tokens('text')} + {duck_tokens("concat('-- converted ', text)")} END AS total_tokens
FROM conversations WHERE role = 'user'""")
def enrich_isolated(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx.table(spark, sf, "conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("job_id"), "turn", F.format_string("blk_%03d", F.col("turn")).alias("id"), "text")
    return q.enrich_isolated(chunks, _stub_converter, ["job_id", "turn", "id"], code_col="text")


# D2 ---------------------------------------------------------------------
@query("numeric_id_order", with_cr(f"""
SELECT job_id, id, n AS num_key, s AS sub_no,
       CAST(row_number() OVER (PARTITION BY job_id ORDER BY n, s, id) AS INTEGER) AS chunk_rank
FROM (SELECT job_id, id, {d_num('id')} AS n, {d_sub('id')} AS s FROM conv_results)"""))
def numeric_id_order(spark: SparkSession, sf: str) -> DataFrame:
    return q.numeric_id_order(cr(spark, sf).select("job_id", "id"))


# D3 ---------------------------------------------------------------------
@query("result_ledger", with_cr("""
SELECT r.job_id, r.id, r.ok AS success, c.source_code AS input_source_code, """ + ", ".join(
    f"CASE WHEN r.target = '{t}' THEN r.code END AS output_{t}_code" for t in fx.CONV_TARGETS) + """,
       r.input_tokens, r.output_tokens, r.input_tokens + r.output_tokens AS total_tokens
FROM conv_results r JOIN conv_results c ON c.job_id = r.job_id AND c.id = r.id"""))
def result_ledger(spark: SparkSession, sf: str) -> DataFrame:
    c = cr(spark, sf)
    results = c.select("job_id", "id", "ok", "code", "target", "input_tokens", "output_tokens")
    chunks = c.select("job_id", "id", "source_code")
    return q.result_ledger(results, chunks, fx.CONV_TARGETS)


# D4 ---------------------------------------------------------------------
@query("success_split", with_cr("""
SELECT job_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_success,
       CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_failed
FROM conv_results GROUP BY job_id"""))
def success_split(spark: SparkSession, sf: str) -> DataFrame:
    return cr(spark, sf).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if("ok").alias("n_success"),
        F.count_if(~F.col("ok")).alias("n_failed"))


def _jobs_usage(spark, sf):
    c = cr(spark, sf)
    jobs = materialize(q.job_code(c), "job_code")  # one frame a job, which usage, cost and report read
    return c, jobs, q.stage_usage(c, jobs)


# D5 ---------------------------------------------------------------------
@query("usage_rollup", with_cr("""
SELECT job_id, stage, CAST(GROUPING(job_id, stage) AS BIGINT) AS grouping_id,
       CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
       CAST(sum(input + output) AS BIGINT) AS total
FROM usage GROUP BY ROLLUP (job_id, stage)""", jobs_ctes()))
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return q.usage_rollup(_jobs_usage(spark, sf)[2])


# D6 ---------------------------------------------------------------------
@query("output_section", with_cr(f"SELECT job_id, id, {d_section('code')} AS section FROM conv_results"))
def output_section(spark: SparkSession, sf: str) -> DataFrame:
    return cr(spark, sf).select("job_id", "id", q.output_section("code").alias("section"))


# D7 ---------------------------------------------------------------------
def _d_answer(name):
    ext = "regexp_extract(code, '(?s)###" + name + "###(.*?)###END_" + name + "###', 1)"
    return f"nullif({duck_trim(ext)}, '')"


@query("answer_sections", with_cr("SELECT job_id, id, " + ", ".join(
    f"{_d_answer(s)} AS {s.lower()}" for s in q.SECTIONS) +
    f", TRY_CAST(regexp_replace({_d_answer('CONVERTION_PERCENTAGE')}, '\\s*%$', '') AS INTEGER) AS pct"
    " FROM conv_results"))
def answer_sections(spark: SparkSession, sf: str) -> DataFrame:
    c = cr(spark, sf)
    cols = {s.lower(): q.answer_section("code", s) for s in q.SECTIONS}
    return c.select("job_id", "id", *[v.alias(k) for k, v in cols.items()],
                    q.percentage(q.answer_section("code", "CONVERTION_PERCENTAGE")).alias("pct"))


# D8 ---------------------------------------------------------------------
_LINES = f"regexp_split_to_array(regexp_replace(code, '({PY_LINEBREAK})$', ''), '{PY_LINEBREAK}')[2:]"


@query("strip_fences", with_cr(f"""
SELECT job_id, id, cleaned, CASE WHEN starts_with(code, '```') THEN array_to_string(
    CASE WHEN len(lines) > 0 AND {duck_trim('lines[-1]')} = '```' THEN lines[1:len(lines) - 1] ELSE lines END, chr(10)) ELSE code END AS downloaded
FROM fence JOIN (SELECT job_id, id, code, {_LINES} AS lines FROM conv_results) USING (job_id, id)""",
                               clean_ctes("conv_results", "job_id, id", "code", "fence", marker_step=False)))
def strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    return cr(spark, sf).select("job_id", "id", q.strip_fences("code").alias("cleaned"), q.download_code("code").alias("downloaded"))


# D9 ---------------------------------------------------------------------
@query("meaningful_code", with_cr(f"SELECT job_id, id, {d_meaningful('code')} AS meaningful FROM conv_results"))
def meaningful_code(spark: SparkSession, sf: str) -> DataFrame:
    return cr(spark, sf).select("job_id", "id", q.meaningful("code").alias("meaningful"))


# D10 --------------------------------------------------------------------
@query("balanced_parens", """
WITH p AS (SELECT doc_id, regexp_replace(text, '[^()]', '', 'g') AS s FROM documents),
ch AS (SELECT doc_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i
       FROM p WHERE s <> ''),
run AS (SELECT doc_id, i, sum(CASE WHEN c = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM ch),
agg AS (SELECT doc_id, min(depth) >= 0 AND arg_max(depth, i) = 0 AS ok FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.ok, true) AS balanced FROM documents d LEFT JOIN agg a USING (doc_id)""")
def balanced_parens(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", q.balanced_parens("text").alias("balanced"))


# D11 --------------------------------------------------------------------
@query("quote_parity", f"SELECT doc_id, {d_quotes('text')} AS quotes_even FROM documents")
def quote_parity(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", q.quote_parity("text").alias("quotes_even"))


# D12 --------------------------------------------------------------------
@query("sql_verdict", with_cr(f"""
SELECT job_id, id, reason = '{q.R_SQL_OK}' AS validated, reason
FROM (SELECT job_id, id, {d_sql_reason('cleaned')} AS reason FROM vc)""",
                              clean_ctes("conv_results", "job_id, id", "code", "vc")))
def sql_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c = q.with_cleaned(cr(spark, sf).select("job_id", "id", "code"), "code")
    return q.with_sql_verdict(c).select("job_id", "id", "validated", "reason")


# The Python parser has no SQL twin; which Python texts parse follows from the fixture's
# parameters (``fixtures.conv_results_plan``), so the oracles need none.
_PY_GOOD = "(job_id + turn) % 6 <> 4"
_PY_RETRY_GOOD = f"({_PY_GOOD} OR job_id % 3 <> 0)"
_GOOD = f"('{q.R_SQL_OK}', '{q.R_PY_OK}', '{q.R_NO_RULE}')"


def d_py_reason(x, parses, comments=True):
    mid = f"WHEN NOT {d_meaningful(x)} THEN '{q.R_COMMENTS}' " if comments else ""
    return f"CASE WHEN {x} = '' THEN '{q.R_EMPTY}' {mid}WHEN {parses} THEN '{q.R_PY_OK}' ELSE 'SyntaxError' END"


def d_reason(x, parses, comments=True):
    return (f"CASE WHEN lower(target) IN {_PY} THEN {d_py_reason(x, parses, comments)} "
            f"WHEN lower(target) IN {_SQLT} THEN {d_sql_reason(x, comments)} ELSE '{q.R_NO_RULE}' END")


def _verdict_sql(src_filter: str) -> list[tuple[str, str]]:
    return clean_ctes(f"(SELECT * FROM conv_results WHERE {src_filter})", "job_id, id, turn, target, ok", "code", "tv") + [
        ("tverdict", f"SELECT job_id, id, target, ok, {d_reason('cleaned', _PY_GOOD)} AS reason FROM tv"),
        ("tvv", f"SELECT *, reason IN {_GOOD} AS validated FROM tverdict"),
    ]


# D13 --------------------------------------------------------------------
@query("python_verdict", with_cr(f"""
SELECT job_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(*) FILTER (WHERE validated) AS BIGINT) AS n_valid,
       CAST(count(*) FILTER (WHERE reason = '{q.R_EMPTY}') AS BIGINT) AS n_empty,
       CAST(count(*) FILTER (WHERE reason = '{q.R_COMMENTS}') AS BIGINT) AS n_comments,
       CAST(count(*) FILTER (WHERE reason = 'SyntaxError') AS BIGINT) AS n_unparsed
FROM tvv GROUP BY job_id""", _verdict_sql(f"lower(target) IN {_PY}")))
def python_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c = cr(spark, sf).filter(F.lower("target").isin(q.PYTHON_TARGETS)).select("job_id", "id", "code")
    return q.python_rollup(q.with_python_verdict(q.with_cleaned(c, "code")))


def _verdicts(spark, sf, ok_only=False):
    c = cr(spark, sf)
    if ok_only:
        c = c.filter("ok")
    v = q.with_target_verdict(c.select("job_id", "id", "target", "ok", "code"), "code", "target")
    return _reason_class(v.select("job_id", "id", "target", "ok", "validated", "reason"))


# D14 --------------------------------------------------------------------
@query("target_verdict", with_cr("SELECT job_id, id, target, validated, reason FROM tvv", _verdict_sql("true")))
def target_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).drop("ok")


# D15 --------------------------------------------------------------------
@query("apply_verdicts", with_cr(f"""
SELECT l.job_id, l.id, l.ok AS success, coalesce(v.validated, false) AS validated,
       coalesce(v.reason, '{q.R_NOT_VALIDATED}') AS reason,
       CASE WHEN coalesce(v.validated, false) THEN 'passed' ELSE 'validation_failed' END AS validation_status
FROM conv_results l LEFT JOIN tvv v ON v.job_id = l.job_id AND v.id = l.id""",
                                 _verdict_sql("ok")))
def apply_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    ledger = cr(spark, sf).select("job_id", "id", F.col("ok").alias("success"))
    return q.apply_verdicts(ledger, _verdicts(spark, sf, ok_only=True))


# D16 --------------------------------------------------------------------
@query("verdict_counts", with_cr("""
SELECT job_id, CAST(count(*) FILTER (WHERE validated) AS BIGINT) AS n_passed,
       CAST(count(*) FILTER (WHERE NOT validated) AS BIGINT) AS n_failed, bool_and(validated) AS all_passed
FROM tvv GROUP BY job_id""", _verdict_sql("ok")))
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return q.verdict_counts(_verdicts(spark, sf, ok_only=True))


# D17 --------------------------------------------------------------------
_QUEUE_SQL = """SELECT v.job_id, v.id, v.reason, r.code AS generated_code, coalesce(r.source_code, '') AS source_code
FROM tvv v JOIN conv_results r ON r.job_id = v.job_id AND r.id = v.id WHERE NOT v.validated"""


@query("review_queue", with_cr(_QUEUE_SQL, _verdict_sql("ok")))
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = cr(spark, sf)
    return q.review_queue(_verdicts(spark, sf, ok_only=True), c.select("job_id", "id", "code"),
                          c.select("job_id", "id", "source_code"))


def _triage(spark, sf):
    c = cr(spark, sf)
    queue = q.review_queue(_verdicts(spark, sf, ok_only=True), c.select("job_id", "id", "code"),
                           c.select("job_id", "id", "source_code"))
    return _reason_class(q.retry_triage(queue, c.select("job_id", "id", "target", "retry_code")))


def _triage_sql():
    return _verdict_sql("ok") + [("queue", _QUEUE_SQL)] + clean_ctes(
        "(SELECT q.job_id, q.id, r.turn, r.target, r.retry_code FROM queue q JOIN conv_results r USING (job_id, id))",
        "job_id, id, turn, target, retry_code", "retry_code", "rc", marker_step=False) + [
        ("triage", f"SELECT job_id, id, retry_code, {d_reason('cleaned', _PY_RETRY_GOOD, comments=False)} AS reason FROM rc"),
        ("triage2", f"""SELECT job_id, id, retry_code, reason,
                CASE WHEN reason IN {_GOOD} THEN 'fixed' ELSE 'manual' END AS outcome FROM triage""")]


# D18 --------------------------------------------------------------------
@query("retry_triage", with_cr("SELECT job_id, id, outcome, reason FROM triage2", _triage_sql()))
def retry_triage(spark: SparkSession, sf: str) -> DataFrame:
    return _triage(spark, sf).select("job_id", "id", "outcome", "reason")


# D19 --------------------------------------------------------------------
@query("apply_fixes", with_cr(f"""
SELECT c.job_id, c.id, coalesce({duck_trim('t.retry_code')}, c.code) AS code, t.retry_code IS NOT NULL AS was_fixed
FROM (SELECT * FROM conv_results WHERE ok) c
LEFT JOIN (SELECT * FROM triage2 WHERE outcome = 'fixed') t ON t.job_id = c.job_id AND t.id = c.id""",
                              _triage_sql()))
def apply_fixes(spark: SparkSession, sf: str) -> DataFrame:
    chunks = cr(spark, sf).filter("ok").select("job_id", "id", "code")
    return q.apply_fixes(chunks, _triage(spark, sf)).select("job_id", "id", "code", "was_fixed")


# D20 --------------------------------------------------------------------
@query("merge_chunks", with_cr("SELECT job_id, merged, n_chunks FROM okm", jobs_ctes()))
def merge_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return q.merge_chunks(cr(spark, sf).filter("ok"))


# D21 --------------------------------------------------------------------
@query("dedup_imports", with_cr("""
SELECT jm.job_id, coalesce(jdd.txt, '') AS deduped FROM jm LEFT JOIN jdd USING (job_id)
WHERE lower(jm.target) IN """ + _PY, jobs_ctes()))
def dedup_imports(spark: SparkSession, sf: str) -> DataFrame:
    jobs = q.job_code(cr(spark, sf)).filter(F.lower("target").isin(q.PYTHON_TARGETS))
    return jobs.select("job_id", q.dedup_imports("merged").alias("deduped"))


# D22 --------------------------------------------------------------------
@query("collapse_blank", with_cr(
    "SELECT job_id, id, regexp_replace(code, '\\n{3,}', chr(10) || chr(10), 'g') AS code FROM conv_results"))
def collapse_blank(spark: SparkSession, sf: str) -> DataFrame:
    return cr(spark, sf).select("job_id", "id", q.collapse_blank("code").alias("code"))


# D23 --------------------------------------------------------------------
@query("before_after", with_cr(f"""
SELECT job_id, 'Before' AS phase, {duck_splitlines_count('base_code')} AS lines FROM jobs
UNION ALL SELECT job_id, 'After', {duck_splitlines_count('final_code')} FROM jobs""", jobs_ctes()))
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    return q.before_after(_jobs_usage(spark, sf)[1])


_COST_SQL = ("cost", f"""SELECT job_id, model, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens,
        {usd_sql('input_tokens', 'output_tokens', 'rate_in', 'rate_out')} AS cost_usd FROM ucr""")
_UC = [("uc", """SELECT job_id, first(model) AS model, CAST(sum(input) AS BIGINT) AS input_tokens,
                CAST(sum(output) AS BIGINT) AS output_tokens FROM usage GROUP BY job_id"""),
       ("ucr", rate_join_sql("uc", "job_id")), _COST_SQL]


# D24 --------------------------------------------------------------------
@query("actual_cost", with_cr("SELECT * FROM cost", jobs_ctes() + _UC))
def actual_cost(spark: SparkSession, sf: str) -> DataFrame:
    return q.actual_cost(_jobs_usage(spark, sf)[2])


# D25 --------------------------------------------------------------------
_REPORT_SCHEMA = ("summary struct<timestamp string, llm string, model string, chunks bigint, total_cost_usd decimal(18,6), "
                  "input_filename string, input_basename string>, input struct<sas_line_count bigint>, runtime_sec double, "
                  "graph_trace array<string>, files struct<before_src string, optimized_file string>, optimization struct<lines_before bigint, lines_after bigint>, "
                  "llm_usage struct<by_stage map<string, struct<input bigint, output bigint, total bigint>>, "
                  "total_tokens bigint>")


@query("run_report", with_cr(f"""
SELECT j.job_id, '{AS_OF}' AS as_of, j.n_chunks AS chunks, c.cost_usd AS total_cost_usd,
       {duck_splitlines_count('j.base_code')} AS lines_before, {duck_splitlines_count('j.final_code')} AS lines_after,
       split_part(j.model, '-', 1) AS llm, f.filename AS input_filename, f.stem AS input_basename, f.n_lines AS sas_line_count, f.sec AS runtime_sec, f.n_steps,
       'Optimized_' || f.stem || CASE WHEN lower(j.target) IN {_PY} THEN '.py' ELSE '.sql' END AS optimized_file,
       ul.input AS llm_input, uo.input AS optimize_input, c.total_tokens
FROM jobs j JOIN cost c USING (job_id)
JOIN (SELECT conv_id AS job_id, 'conv_' || conv_id || '.v1.sas' AS filename, 'conv_' || conv_id || '.v1' AS stem, min(length(text) - length(replace(text, chr(10), '')) + 1) AS n_lines,
        CAST(count(*) AS DOUBLE) / 2 AS sec, CAST(count(*) AS BIGINT) AS n_steps FROM conversations GROUP BY conv_id) f USING (job_id)
JOIN (SELECT * FROM usage WHERE stage = 'llm') ul USING (job_id)
JOIN (SELECT * FROM usage WHERE stage = 'optimize') uo USING (job_id)""", jobs_ctes() + _UC))
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    c, jobs, usage = _jobs_usage(spark, sf)
    rep = q.run_report(jobs, usage, q.actual_cost(usage), AS_OF, report_facts(spark, sf, jobs))
    r = rep.select("job_id", F.from_json("report_json", _REPORT_SCHEMA).alias("r"))
    return r.select("job_id", F.col("r.summary.timestamp").alias("as_of"), F.col("r.summary.chunks").alias("chunks"),
                    F.col("r.summary.total_cost_usd").alias("total_cost_usd"),
                    F.col("r.summary.llm").alias("llm"), F.col("r.summary.input_filename").alias("input_filename"), F.col("r.summary.input_basename").alias("input_basename"),
                    F.col("r.input.sas_line_count").alias("sas_line_count"), F.col("r.runtime_sec").alias("runtime_sec"),
                    F.size("r.graph_trace").cast("bigint").alias("n_steps"), F.col("r.files.optimized_file").alias("optimized_file"),
                    F.col("r.optimization.lines_before").alias("lines_before"),
                    F.col("r.optimization.lines_after").alias("lines_after"),
                    F.col("r.llm_usage.by_stage")["llm"]["input"].alias("llm_input"),
                    F.col("r.llm_usage.by_stage")["optimize"]["input"].alias("optimize_input"),
                    F.col("r.llm_usage.total_tokens").alias("total_tokens"))


def report_facts(spark: SparkSession, sf: str, jobs: DataFrame) -> DataFrame:
    """Facts of a job from its conversation: file name, source text (the shortest turn stands for it), seconds, one step a turn."""
    conv = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(
        F.min_by("text", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("source_code"),
        (F.count(F.lit(1)).cast("double") / 2).alias("runtime_sec"), F.collect_list("role").alias("graph_trace"))
    return conv.join(jobs.select("job_id", F.split_part("model", F.lit("-"), F.lit(1)).alias("llm")), "job_id").withColumn(
        "input_filename", F.concat(F.lit("conv_"), F.col("job_id").cast("string"), F.lit(".v1.sas")))


# D26 --------------------------------------------------------------------
@query("usage_series", with_cr("""
SELECT job_id, 'LLM In' AS name, input AS value FROM usage WHERE stage = 'llm'
UNION ALL SELECT job_id, 'LLM Out', output FROM usage WHERE stage = 'llm'
UNION ALL SELECT job_id, 'Opt In', input FROM usage WHERE stage = 'optimize'
UNION ALL SELECT job_id, 'Opt Out', output FROM usage WHERE stage = 'optimize'""", jobs_ctes()))
def usage_series(spark: SparkSession, sf: str) -> DataFrame:
    return q.usage_series(_jobs_usage(spark, sf)[2])
