"""Family B queries: cleaning, segmentation and classification of scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.functions.text import PY_LINEBREAK, PY_WS, duck_trim, trim_ws
from ferryman.operators import segment as sg
from ferryman.plans.registry import query
from ferryman.sources import fixtures as fx

# small budgets so that cuts happen on the fixture scripts
B7_BUDGET = 8
B8_MAX = 6
B11_MAX = 3


# ------------------------------------------------------------------ SQL kit
def d_sas_clean(x):
    return f"regexp_replace(regexp_replace({x}, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)^{PY_WS}*\\*.*?;', '', 'g')"


def d_plsql_clean(x):
    return f"regexp_replace(regexp_replace({x}, '(?s)/\\*.*?\\*/', '', 'g'), '--.*', '', 'g')"


def d_rstrip(x):
    return f"regexp_replace({x}, '{PY_WS}+$', '')"


def d_splitlines(x):
    return (f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE "
            f"regexp_split_to_array(regexp_replace({x}, '({PY_LINEBREAK})$', ''), '{PY_LINEBREAK}') END)")


def d_term_sas(x):
    u = f"upper({duck_trim(x)})"
    return f"(ends_with({u}, 'RUN;') OR ends_with({u}, 'QUIT;') OR ends_with({u}, '%MEND;'))"


def d_fold(lines: str, budget: int, flag_lambda_body: str) -> str:
    """list_reduce twin of the greedy cut fold; ``flag_lambda_body`` uses ``i``."""
    return (f"list_reduce(range(len({lines})), lambda acc, i: CASE WHEN i - acc.start + 1 >= {budget} AND "
            f"({flag_lambda_body}) THEN {{'start': i + 1, 'cuts': list_append(acc.cuts, i + 1)}} ELSE acc END, "
            f"{{'start': CAST(0 AS BIGINT), 'cuts': CAST([] AS BIGINT[])}}).cuts")


def d_ends(lines: str, cuts: str) -> str:
    return (f"(CASE WHEN len({lines}) = 0 THEN CAST([] AS BIGINT[]) WHEN len({cuts}) > 0 AND {cuts}[-1] = len({lines}) "
            f"THEN {cuts} ELSE list_append({cuts}, len({lines})) END)")


def pieces_ctes(src: str, keys: str, lines: str, ends: str, name: str) -> list[tuple[str, str]]:
    """Explode (lo, hi] ranges of ``ends`` into rows ``(keys, piece_no, code)``."""
    return [(name, f"""SELECT {keys}, j AS piece_no,
        array_to_string({lines}[CAST(lo + 1 AS BIGINT):CAST(hi AS BIGINT)], chr(10)) AS code, hi - lo AS n_lines
      FROM (SELECT {keys}, {lines}, e_hi AS hi, j, coalesce({ends}[j - 1], 0) AS lo
            FROM (SELECT *, unnest({ends}) AS e_hi, generate_subscripts({ends}, 1) AS j FROM {src}))""")]


def plsql_ctes(src: str, p: str, max_lines: int) -> list[tuple[str, str]]:
    """PL/SQL chunker in DuckDB: lines, clamp recursion for depth (recursive
    CTE, independent of the closed form), blocks, safe split, ids."""
    term = f"regexp_matches(line, '^{PY_WS}*/{PY_WS}*$')"
    return [
        (f"{p}_l", f"""SELECT script_id, unnest(L) AS line, CAST(generate_subscripts(L, 1) - 1 AS INTEGER) AS line_no
            FROM (SELECT script_id, {d_splitlines(d_plsql_clean('text'))} AS L FROM {src})"""),
        (f"{p}_x", f"""SELECT *, (CASE WHEN regexp_matches(line, '(?i)\\bBEGIN\\b') THEN 1 ELSE 0 END)
                  - (CASE WHEN regexp_matches(line, '(?i)\\bEND\\b') THEN 1 ELSE 0 END) AS delta,
                  {term} AS is_term FROM {p}_l"""),
        (f"{p}_r", f"""SELECT script_id, line_no, greatest(0, delta) AS depth FROM {p}_x WHERE line_no = 0
            UNION ALL
            SELECT x.script_id, x.line_no, greatest(0, r.depth + x.delta) FROM {p}_r r
            JOIN {p}_x x ON x.script_id = r.script_id AND x.line_no = r.line_no + 1"""),
        (f"{p}_d", f"""SELECT x.script_id, x.line_no, x.line, x.is_term, r.depth,
                  1 + coalesce(sum(CASE WHEN x.is_term AND r.depth = 0 THEN 1 ELSE 0 END) OVER (
                      PARTITION BY x.script_id ORDER BY x.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS block_no
            FROM {p}_x x JOIN {p}_r r USING (script_id, line_no)"""),
        (f"{p}_b", f"""SELECT script_id, block_no, {d_rstrip("string_agg(line, chr(10) ORDER BY line_no)")} AS code,
                  list(depth ORDER BY line_no) AS D, list(is_term ORDER BY line_no) AS T
            FROM {p}_d GROUP BY script_id, block_no"""),
        (f"{p}_bl", f"SELECT *, {d_splitlines('code')} AS L FROM {p}_b"),
        (f"{p}_bc", f"""SELECT *, CASE WHEN len(L) > {max_lines} THEN {d_fold('L', max_lines,
              "D[i + 1] = 0 AND (T[i + 1] OR ends_with(upper(" + duck_trim('L[i + 1]') + "), ';'))")}
              ELSE NULL END AS cuts FROM {p}_bl"""),
        (f"{p}_be", f"SELECT *, {d_ends('L', 'cuts')} AS E FROM {p}_bc WHERE cuts IS NOT NULL"),
    ] + pieces_ctes(f"{p}_be", "script_id, block_no", "L", "E", f"{p}_bp") + [
        (f"{p}_s", f"""SELECT script_id, block_no, CAST(1 AS BIGINT) AS sub_no, code FROM {p}_bc WHERE cuts IS NULL
            UNION ALL SELECT script_id, block_no, piece_no, {d_rstrip('code')} FROM {p}_bp"""),
        (f"{p}_c", f"""SELECT script_id, code,
                  row_number() OVER (PARTITION BY script_id ORDER BY block_no, sub_no) AS seq FROM {p}_s"""),
        (p, f"SELECT script_id, concat('blk_', lpad(CAST(seq AS VARCHAR), 3, '0')) AS id, code, seq FROM {p}_c"),
    ]


def d_plsql_type(x):
    head = (f"regexp_extract({x}, '(?i)CREATE{PY_WS}+(OR{PY_WS}+REPLACE{PY_WS}+)?\\b"
            f"(PACKAGE{PY_WS}+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE)\\b', 2)")
    return (f"CASE WHEN {head} <> '' THEN replace(upper({head}), ' ', '_') "
            f"WHEN starts_with(upper(regexp_replace({x}, '^{PY_WS}+', '')), 'BEGIN') THEN 'ANONYMOUS_BLOCK' "
            f"ELSE 'UNKNOWN' END")


def d_sas_type(x):
    first = f"upper(split_part({duck_trim(x)}, chr(10), 1))"
    return (f"CASE WHEN starts_with({first}, '%MACRO') THEN 'MACRO' WHEN starts_with({first}, 'PROC ') THEN 'PROC' "
            f"WHEN starts_with({first}, 'DATA ') THEN 'DATA' ELSE 'UNKNOWN' END")


_SAS_BLOCK = sg.SAS_BLOCK_RE


def sas_block_ctes(src: str, p: str) -> list[tuple[str, str]]:
    return [(p, f"""SELECT script_id, CAST(generate_subscripts(B, 1) AS INTEGER) AS block_no, unnest(B) AS code FROM (
        SELECT script_id, CASE WHEN len(m) > 0 THEN m ELSE [c] END AS B FROM (
          SELECT script_id, c, regexp_extract_all(c, '{_SAS_BLOCK}', 1) AS m FROM (
            SELECT script_id, {d_sas_clean('text')} AS c FROM {src})))""")]


def sas_chunk_ctes(src: str, p: str, budget: int) -> list[tuple[str, str]]:
    return sas_block_ctes(src, f"{p}_blk") + [
        (f"{p}_l", f"SELECT script_id, block_no, string_split(code, chr(10)) AS L FROM {p}_blk"),
        (f"{p}_e", f"""SELECT *, {d_ends('L', d_fold('L', budget, d_term_sas('L[i + 1]')))} AS E FROM {p}_l"""),
    ] + pieces_ctes(f"{p}_e", "script_id, block_no", "L", "E", f"{p}_p") + [
        (p, f"""SELECT script_id, concat('blk_', lpad(CAST(seq AS VARCHAR), 3, '0')) AS id, {duck_trim('code')} AS code, seq
            FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY block_no, piece_no) AS seq FROM {p}_p)""")]


def sas(body, extra=(), recursive=False):
    return fx.with_ctes(body, "sas_scripts", extra=list(extra), recursive=recursive)


def plsql(body, extra=(), recursive=False):
    return fx.with_ctes(body, "plsql_scripts", extra=list(extra), recursive=recursive)


def _sas(spark, sf):
    return fx.sas_scripts(spark, sf)


def _pl(spark, sf):
    return fx.plsql_scripts(spark, sf)


# B1 ---------------------------------------------------------------------
@query("strip_sas_comments", sas(f"SELECT script_id, {d_sas_clean('text')} AS cleaned FROM sas_scripts"))
def strip_sas_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _sas(spark, sf).select("script_id", sg.strip_sas_comments("text").alias("cleaned"))


# B2 ---------------------------------------------------------------------
@query("strip_plsql_comments", plsql(f"SELECT script_id, {d_plsql_clean('text')} AS cleaned FROM plsql_scripts"))
def strip_plsql_comments(spark: SparkSession, sf: str) -> DataFrame:
    return _pl(spark, sf).select("script_id", sg.strip_plsql_comments("text").alias("cleaned"))


def _sas_clean_trim(spark, sf):
    return _sas(spark, sf).select("script_id", trim_ws(sg.strip_sas_comments("text")).alias("text"))


_MACRO = sg.MACRO_RE
_MACRO_NOGROUP = "(?is)%macro\\b.*?%mend\\s*;"


# B3 ---------------------------------------------------------------------
@query("macro_extract", sas(f"""
SELECT script_id, CAST(k AS INTEGER) AS macro_no, CAST(start_pos AS INTEGER) AS start_pos,
       CAST(start_pos + length(code) AS INTEGER) AS end_pos, code
FROM (SELECT script_id, k, m[k] AS code,
        coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start_pos
      FROM (SELECT *, generate_subscripts(m, 1) AS k FROM (
        SELECT script_id, regexp_extract_all(c, '{_MACRO}', 1) AS m, string_split_regex(c, '{_MACRO_NOGROUP}') AS p
        FROM (SELECT script_id, {duck_trim(d_sas_clean('text'))} AS c FROM sas_scripts))))"""))
def macro_extract(spark: SparkSession, sf: str) -> DataFrame:
    return sg.macro_extract(_sas_clean_trim(spark, sf))


# B4 ---------------------------------------------------------------------
@query("macro_interleave", sas(f"""
SELECT script_id, CAST(generate_subscripts(K, 1) AS INTEGER) AS piece_no, unnest(K).kind AS kind, unnest(K).text AS code
FROM (SELECT script_id, list_filter(flatten(list_transform(generate_series(1, len(p)), lambda i:
        [{{'kind': 'code', 'text': {duck_trim('p[i]')}}}, {{'kind': 'macro', 'text': m[i]}}])),
        lambda x: x.text IS NOT NULL AND x.text <> '') AS K
      FROM (SELECT script_id, regexp_extract_all(c, '{_MACRO}', 1) AS m, string_split_regex(c, '{_MACRO_NOGROUP}') AS p
            FROM (SELECT script_id, {duck_trim(d_sas_clean('text'))} AS c FROM sas_scripts)))"""))
def macro_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return sg.macro_interleave(_sas_clean_trim(spark, sf))


# B5 ---------------------------------------------------------------------
_KW = sg.SEGMENT_KEYWORDS


@query("keyword_segments", sas(f"""
SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY seg) AS INTEGER) AS seg_no, type, code
FROM (SELECT script_id, seg,
        CASE WHEN seg = 0 THEN 'unknown' ELSE lower(regexp_extract(arg_min(l, i), '{_KW}', 1)) END AS type,
        {duck_trim("string_agg(l, chr(10) ORDER BY i)")} AS code
      FROM (SELECT *, sum(CASE WHEN regexp_matches(l, '{_KW}') THEN 1 ELSE 0 END)
                      OVER (PARTITION BY script_id ORDER BY i) AS seg
            FROM (SELECT script_id, unnest(L) AS l, generate_subscripts(L, 1) AS i
                  FROM (SELECT script_id, {d_splitlines(duck_trim(d_sas_clean('text')))} AS L FROM sas_scripts)))
      GROUP BY script_id, seg)"""))
def keyword_segments(spark: SparkSession, sf: str) -> DataFrame:
    return sg.keyword_segments(_sas_clean_trim(spark, sf))


# B6 ---------------------------------------------------------------------
@query("sas_blocks", sas("SELECT script_id, block_no, code FROM blk", sas_block_ctes("sas_scripts", "blk")))
def sas_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return sg.sas_blocks(_sas(spark, sf))


def _b7_sql_ctes():
    return [("b7l", f"SELECT script_id, string_split({d_sas_clean('text')}, chr(10)) AS L FROM sas_scripts"),
            ("b7e", f"SELECT *, {d_ends('L', d_fold('L', B7_BUDGET, d_term_sas('L[i + 1]')))} AS E FROM b7l")] + \
        pieces_ctes("b7e", "script_id", "L", "E", "b7")


# B7 ---------------------------------------------------------------------
@query("budget_chunks", sas("""
SELECT script_id, CAST(piece_no AS INTEGER) AS chunk_no, code, CAST(n_lines AS INTEGER) AS n_lines FROM b7""",
                            _b7_sql_ctes()))
def budget_chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = _sas(spark, sf).select("script_id", sg.strip_sas_comments("text").alias("clean"))
    return sg.budget_chunks(s, "clean", B7_BUDGET)


# B8 ---------------------------------------------------------------------
@query("overflow_split", sas(f"""
SELECT script_id, id, code FROM b8in WHERE len(L) <= {B8_MAX}
UNION ALL
SELECT r.script_id, concat(r.id, '_sub', CAST(r.k AS VARCHAR)) AS id,
       {duck_trim("array_to_string(o.L[CAST(r.lo + 1 AS BIGINT):CAST(r.hi AS BIGINT)], chr(10))")} AS code
FROM b8rec r JOIN b8ov o ON o.script_id = r.script_id AND o.id = r.id""", _b7_sql_ctes() + [
    ("b8in", f"""SELECT script_id, concat('blk_', lpad(CAST(piece_no AS VARCHAR), 3, '0')) AS id, code,
                 {d_splitlines('code')} AS L FROM b7"""),
    ("b8ov", f"""SELECT script_id, id, L, len(L) AS n, list_transform(L, lambda l: {d_term_sas('l')}) AS T
                 FROM b8in WHERE len(L) > {B8_MAX}"""),
    ("b8rec", f"""SELECT script_id, id, CAST(0 AS BIGINT) AS lo,
            coalesce(list_max(list_filter(range(0, least({B8_MAX}, n)), lambda i: T[i + 1])) + 1, least({B8_MAX}, n)) AS hi,
            1 AS k FROM b8ov
        UNION ALL
        SELECT r.script_id, r.id, r.hi,
            coalesce(list_max(list_filter(range(r.hi, least(r.hi + {B8_MAX}, o.n)), lambda i: o.T[i + 1])) + 1,
                     least(r.hi + {B8_MAX}, o.n)),
            r.k + 1
        FROM b8rec r JOIN b8ov o ON o.script_id = r.script_id AND o.id = r.id WHERE r.hi < o.n"""),
], recursive=True))
def overflow_split(spark: SparkSession, sf: str) -> DataFrame:
    chunks = budget_chunks(spark, sf).select("script_id", sg.chunk_id(F.col("chunk_no")).alias("id"), "code")
    return sg.overflow_split(chunks, "code", "id", B8_MAX)


# B9 ---------------------------------------------------------------------
@query("nesting_depth", plsql("SELECT script_id, line_no, line, depth FROM pl_d",
                              plsql_ctes("plsql_scripts", "pl", 200), recursive=True))
def nesting_depth(spark: SparkSession, sf: str) -> DataFrame:
    return sg.plsql_lines(_pl(spark, sf)).select("script_id", "line_no", "line", "depth")


def _blocks(spark, sf):
    return sg.terminator_blocks(sg.script_lines_arrays(sg.plsql_lines(_pl(spark, sf))))


# B10 --------------------------------------------------------------------
@query("terminator_split", plsql("SELECT script_id, CAST(block_no AS INTEGER) AS block_no, code FROM pl_b",
                                 plsql_ctes("plsql_scripts", "pl", 200), recursive=True))
def terminator_split(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("script_id", "block_no", "code")


# B11 --------------------------------------------------------------------
@query("safe_split", plsql("""
SELECT script_id, CAST(block_no AS INTEGER) AS block_no, CAST(sub_no AS INTEGER) AS sub_no, code FROM pl_s""",
                           plsql_ctes("plsql_scripts", "pl", B11_MAX), recursive=True))
def safe_split(spark: SparkSession, sf: str) -> DataFrame:
    return sg.safe_split(_blocks(spark, sf), B11_MAX)


# B12 --------------------------------------------------------------------
@query("whole_script", f"SELECT doc_id AS script_id, 'blk_001' AS id, {duck_trim('text')} AS code FROM documents")
def whole_script(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "script_id")
    return sg.whole_script(d)


# B13 --------------------------------------------------------------------
@query("chunk_ids", plsql("SELECT script_id, id, code FROM pl", plsql_ctes("plsql_scripts", "pl", 200),
                          recursive=True))
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sg.plsql_chunks(_pl(spark, sf)).select("script_id", "id", "code")


# B14 --------------------------------------------------------------------
@query("sas_chunk_type", sas(f"SELECT script_id, block_no, {d_sas_type('code')} AS type FROM blk",
                             sas_block_ctes("sas_scripts", "blk")))
def sas_chunk_type(spark: SparkSession, sf: str) -> DataFrame:
    return sg.sas_blocks(_sas(spark, sf)).select("script_id", "block_no", sg.sas_chunk_type("code").alias("type"))


# B15 --------------------------------------------------------------------
@query("plsql_object_type", plsql(f"""
SELECT script_id, CAST(block_no AS INTEGER) AS block_no, {d_plsql_type('code')} AS type FROM pl_b""",
                                  plsql_ctes("plsql_scripts", "pl", 200), recursive=True))
def plsql_object_type(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("script_id", "block_no", sg.plsql_object_type("code").alias("type"))


# B16 --------------------------------------------------------------------
_WHOLE_CASE = "CASE lower(source) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in sg.WHOLE_LABELS.items()) + " ELSE 'SQL' END"


_MIXED = ("mixed", """SELECT s.script_id, s.source, CASE WHEN lower(s.source) = 'sas' THEN x.text
        WHEN lower(s.source) IN ('oracle', 'plsql') THEN p.text ELSE s.text END AS text
    FROM scripts s JOIN sas_scripts x USING (script_id) JOIN plsql_scripts p USING (script_id)""")


def sas_path_ctes(src: str, p: str, max_lines: int) -> list[tuple[str, str]]:
    """Chunks ``src`` (script_id, seq, code) in dependency order, with ids, split where too long: ``p``."""
    return [
        (f"{p}_def", f"""SELECT script_id, name, max(seq) AS def_seq FROM (
            SELECT script_id, seq, regexp_extract(code, '(?i)%MACRO\\s+(\\w+)', 1) AS name FROM {src}
            WHERE contains(code, '%MACRO') AND contains(code, '%MEND')) WHERE name <> '' GROUP BY script_id, name"""),
        (f"{p}_edge", f"""SELECT DISTINCT d.script_id, d.def_seq AS src, c.seq AS dst FROM {p}_def d
            JOIN {src} c ON c.script_id = d.script_id AND contains(c.code, '%' || d.name) AND c.seq <> d.def_seq"""),
        (f"{p}_n", f"SELECT script_id, count(*) AS n FROM {src} GROUP BY script_id"),
        (f"{p}_path", f"""SELECT script_id, seq AS node, CAST(0 AS BIGINT) AS d FROM {src}
            UNION SELECT r.script_id, e.dst, r.d + 1 FROM {p}_path r
            JOIN {p}_edge e ON e.script_id = r.script_id AND e.src = r.node JOIN {p}_n n ON n.script_id = r.script_id WHERE r.d < n.n"""),
        (f"{p}_lv", f"SELECT script_id, node, max(d) AS level FROM {p}_path GROUP BY script_id, node"),
        (f"{p}_ord", f"""SELECT c.script_id, c.code, row_number() OVER (PARTITION BY c.script_id ORDER BY
                CASE WHEN l.level < n.n THEN l.level END NULLS LAST, c.seq) AS ord
            FROM {src} c JOIN {p}_lv l ON l.script_id = c.script_id AND l.node = c.seq JOIN {p}_n n ON n.script_id = c.script_id"""),
        (f"{p}_in", f"""SELECT script_id, ord, concat('blk_', lpad(CAST(ord AS VARCHAR), 3, '0')) AS id, {duck_trim('code')} AS code,
            {d_splitlines('code')} AS L FROM (SELECT * REPLACE ({duck_trim('code')} AS code) FROM {p}_ord)"""),
        (f"{p}_ov", f"SELECT *, len(L) AS n, list_transform(L, lambda l: {d_term_sas('l')}) AS T FROM {p}_in WHERE len(L) > {max_lines}"),
        (f"{p}_rec", f"""SELECT script_id, ord, CAST(0 AS BIGINT) AS lo,
                coalesce(list_max(list_filter(range(0, least({max_lines}, n)), lambda i: T[i + 1])) + 1, least({max_lines}, n)) AS hi, 1 AS k FROM {p}_ov
            UNION ALL SELECT r.script_id, r.ord, r.hi,
                coalesce(list_max(list_filter(range(r.hi, least(r.hi + {max_lines}, o.n)), lambda i: o.T[i + 1])) + 1, least(r.hi + {max_lines}, o.n)), r.k + 1
            FROM {p}_rec r JOIN {p}_ov o USING (script_id, ord) WHERE r.hi < o.n"""),
        (p, f"""SELECT script_id, id, code, row_number() OVER (PARTITION BY script_id ORDER BY ord, k) AS seq FROM (
            SELECT script_id, ord, 0 AS k, id, code FROM {p}_in WHERE len(L) <= {max_lines}
            UNION ALL SELECT r.script_id, r.ord, r.k, concat(o.id, '_sub', CAST(r.k AS VARCHAR)),
                {duck_trim("array_to_string(o.L[CAST(r.lo + 1 AS BIGINT):CAST(r.hi AS BIGINT)], chr(10))")} FROM {p}_rec r JOIN {p}_ov o USING (script_id, ord))"""),
    ]


@query("dialect_dispatch", fx.with_ctes(f"""
SELECT script_id, id, {d_sas_type('code')} AS type, code, CAST(seq AS INTEGER) AS seq FROM dpath
UNION ALL SELECT script_id, id, {d_plsql_type('code')}, code, CAST(seq AS INTEGER) FROM dpl
UNION ALL SELECT script_id, 'blk_001', 'UNKNOWN', text, 1 FROM mixed WHERE lower(source) IN ('sas', 'oracle', 'plsql')
  AND script_id NOT IN (SELECT script_id FROM dpath UNION ALL SELECT script_id FROM dpl)
UNION ALL SELECT script_id, 'blk_001', {_WHOLE_CASE}, {duck_trim('text')}, 1 FROM mixed
  WHERE lower(source) NOT IN ('sas', 'oracle', 'plsql')""", "scripts", "sas_scripts", "plsql_scripts",
    extra=[_MIXED, ("s_sas", "SELECT * FROM mixed WHERE lower(source) = 'sas'"),
           ("s_pl", "SELECT * FROM mixed WHERE lower(source) IN ('oracle', 'plsql')")]
    + sas_chunk_ctes("s_sas", "dsas", sg.SAS_BUDGET) + sas_path_ctes("dsas", "dpath", sg.SAS_OVERFLOW) + plsql_ctes("s_pl", "dpl", sg.PLSQL_BUDGET), recursive=True))
def dialect_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    out = sg.dialect_dispatch(mixed_scripts(spark, sf))
    return out.withColumn("seq", F.col("seq").cast("int"))


def mixed_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed corpus: every script has text of its own source."""
    s, source = fx.scripts(spark, sf).select("script_id", "source", "text"), F.lower("source")
    x, p = (f(spark, sf).withColumnRenamed("text", n) for f, n in ((_sas, "sas_text"), (_pl, "pl_text")))
    text = F.when(source == "sas", F.col("sas_text")).when(source.isin(sg.PLSQL_SOURCES), F.col("pl_text")).otherwise(F.col("text"))
    return s.join(x, "script_id").join(p, "script_id").select("script_id", "source", text.alias("text"))


# B17 --------------------------------------------------------------------
@query("empty_fallback", plsql(f"""
SELECT script_id, id, {d_plsql_type('code')} AS type, code FROM pl
UNION ALL
SELECT script_id, 'blk_001', 'UNKNOWN', text FROM plsql_scripts WHERE script_id NOT IN (SELECT script_id FROM pl)""",
                               plsql_ctes("plsql_scripts", "pl", 200), recursive=True))
def empty_fallback(spark: SparkSession, sf: str) -> DataFrame:
    scripts = _pl(spark, sf)
    chunks = sg.plsql_chunks(scripts).withColumn("type", sg.plsql_object_type("code"))
    return sg.empty_fallback(scripts, chunks)


# B18 --------------------------------------------------------------------
@query("chunk_profile", sas(f"""
SELECT s.script_id, CAST(length(s.text) - length(replace(s.text, chr(10), '')) + 1 AS BIGINT) AS line_count,
       CAST(coalesce(c.n, 0) AS BIGINT) AS chunk_count, CAST(coalesce(c.u, 0) AS BIGINT) AS unknown_blocks
FROM sas_scripts s LEFT JOIN (
  SELECT script_id, count(*) AS n, count(*) FILTER (WHERE {d_sas_type('code')} = 'UNKNOWN') AS u FROM blk GROUP BY script_id
) c USING (script_id)""", sas_block_ctes("sas_scripts", "blk")))
def chunk_profile(spark: SparkSession, sf: str) -> DataFrame:
    s = _sas(spark, sf)
    blocks = sg.sas_blocks(s).withColumn("type", sg.sas_chunk_type("code"))
    return sg.chunk_profile(s, blocks)
