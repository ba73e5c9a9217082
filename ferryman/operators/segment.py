"""Cleaning, segmentation and classification of scripts (family B).

One script is one row. Everything that only needs the script's own lines is
done with array expressions inside that row (no shuffle): block regexes,
keyword segments, and the sequential greedy cuts, which are an ``aggregate``
fold that carries only cut positions. Only the PL/SQL nesting depth (a
running sum + running min) uses a window, partitioned by script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryman.functions.text import PY_WS, let, rstrip_ws, splitlines_array, splitlines_count, trim_ws
from ferryman.operators import graph
from ferryman.session import materialize

# fixed values: patterns of the script grammar
SAS_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
SAS_STAR_COMMENT = rf"(?md)^{PY_WS}*\*.*?;"
PLSQL_LINE_COMMENT = r"(?d)--.*"
MACRO_RE = r"(?is)(%macro\b.*?%mend\s*;)"
SEGMENT_KEYWORDS = rf"(?i)^{PY_WS}*(data|proc|%let|call\s+symput|options|%if|%do|%macro)\b"
SAS_BLOCK_RE = (r"(?is)(%macro\b.*?%mend\b[^;]*;"
                r"|\bdata\b.*?\brun\s*;"
                r"|\bproc\b.*?\b(?:run|quit)\s*;)")
SAS_TERMINATORS = ["RUN;", "QUIT;", "%MEND;"]
PLSQL_TERMINATOR = rf"^{PY_WS}*/{PY_WS}*$"
BEGIN_RE = r"(?i)\bBEGIN\b"
END_RE = r"(?i)\bEND\b"
PLSQL_HEADER = (rf"(?i)CREATE{PY_WS}+(OR{PY_WS}+REPLACE{PY_WS}+)?\b"
                rf"(PACKAGE{PY_WS}+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE)\b")
SAS_BUDGET = 100
SAS_OVERFLOW = 400
PLSQL_BUDGET = 200


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ B1, B2
def strip_sas_comments(text) -> Column:
    """``/* ... */`` across lines, then line-start ``* ... ;`` (one line)."""
    return F.regexp_replace(F.regexp_replace(_c(text), SAS_BLOCK_COMMENT, ""), SAS_STAR_COMMENT, "")


def strip_plsql_comments(text) -> Column:
    """``/* ... */`` then ``--`` to end of line (also inside literals, as specified)."""
    return F.regexp_replace(F.regexp_replace(_c(text), SAS_BLOCK_COMMENT, ""), PLSQL_LINE_COMMENT, "")


# ------------------------------------------------------------------ B3, B4
def macro_extract(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """Every ``%macro ... %mend;`` with 0-based start/end character offsets.

    Offsets come from the lengths of the pieces between matches (``split`` on
    the same pattern), accumulated in a fold: no second regex pass.
    """
    t = F.col(text)

    def with_offsets(mp):
        m, p = mp["m"], mp["p"]
        starts = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1),
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts")),
            lambda acc, i: F.struct(
                (acc["pos"] + F.length(F.element_at(p, i + 1)) + F.length(F.element_at(m, i + 1))).alias("pos"),
                F.concat(acc["starts"], F.array(acc["pos"] + F.length(F.element_at(p, i + 1)))).alias("starts")),
        )["starts"]
        return F.when(F.size(m) > 0, F.arrays_zip(m.alias("code"), starts.alias("start")))

    # both arrays are built once per row and bound, not rebuilt per fold step
    out = df.select(key, let(F.struct(F.regexp_extract_all(t, F.lit(MACRO_RE), 1).alias("m"),
                                      F.split(t, MACRO_RE, -1).alias("p")), with_offsets).alias("m"))
    return out.select(key, F.posexplode("m").alias("macro_no", "m")).select(
        key, (F.col("macro_no") + 1).alias("macro_no"), F.col("m.start").alias("start_pos"),
        (F.col("m.start") + F.length("m.code")).alias("end_pos"), F.col("m.code").alias("code"))


def macro_interleave(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """Non-macro pieces (stripped, blanks dropped) alternating with macros, in order."""
    t = F.col(text)

    def interleave(macros):
        return F.flatten(F.transform(F.split(t, MACRO_RE, -1), lambda p, i: F.array(
            F.struct(F.lit("code").alias("kind"), trim_ws(p).alias("text")),
            F.struct(F.lit("macro").alias("kind"), F.try_element_at(macros, i + 1).alias("text")))))

    seq = let(F.regexp_extract_all(t, F.lit(MACRO_RE), 1), interleave)
    kept = F.filter(seq, lambda x: x["text"].isNotNull() & (x["text"] != ""))
    return df.select(key, F.posexplode(kept).alias("piece_no", "p")).select(
        key, (F.col("piece_no") + 1).alias("piece_no"), F.col("p.kind").alias("kind"), F.col("p.text").alias("code"))


# ------------------------------------------------------------------ B5
def keyword_segments(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """New segment at each keyword line; lines before the first are ``unknown``.

    Segment starts are the flagged line positions; slices between them are
    the segments -- no running sum, no shuffle.
    """
    df = df.withColumn("_lines", splitlines_array(F.col(text)))
    lines = F.col("_lines")
    n = F.size(lines)
    flagged = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(lines, i + 1).rlike(SEGMENT_KEYWORDS))
    df = df.withColumn("_starts", F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.when(F.array_contains(flagged, 0), flagged).otherwise(F.concat(F.array(F.lit(0)), flagged))))
    starts = F.col("_starts")
    segs = F.transform(starts, lambda s, j: F.struct(
        F.when((j == 0) & ~F.element_at(lines, 1).rlike(SEGMENT_KEYWORDS), F.lit("unknown"))
        .otherwise(F.lower(F.regexp_extract(F.element_at(lines, s + 1), SEGMENT_KEYWORDS, 1))).alias("type"),
        trim_ws(F.array_join(F.slice(lines, s + 1, F.coalesce(F.try_element_at(starts, j + 2), n + 0) - s), "\n"))
        .alias("code")))
    return df.select(key, F.posexplode(segs).alias("seg_no", "s")).select(
        key, (F.col("seg_no") + 1).alias("seg_no"), "s.type", "s.code")


# ------------------------------------------------------------------ B6
def sas_blocks(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """%MACRO..%MEND;, DATA..RUN;, PROC..RUN;/QUIT; blocks of the comment-free
    script; a script with none is one block (the whole cleaned text)."""
    clean = strip_sas_comments(F.col(text))
    blocks = F.regexp_extract_all(clean, F.lit(SAS_BLOCK_RE), 1)
    arr = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(clean))
    return df.select(key, F.posexplode(arr).alias("block_no", "code")) \
        .withColumn("block_no", F.col("block_no") + 1)


# ------------------------------------------------------------------ folds
def greedy_cuts(n: Column, flag_at, budget: int) -> Column:
    """Sequential greedy cut positions (exclusive ends, ascending).

    Close the current piece after line ``i`` when it holds at least ``budget``
    lines and ``flag_at(i)`` holds. The fold carries (start, cuts) only.
    """
    acc0 = F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("cuts"))
    res = F.aggregate(F.sequence(F.lit(0), n - 1), acc0, lambda acc, i: F.when(
        (i - acc["start"] + 1 >= budget) & flag_at(i),
        F.struct((i + 1).alias("start"), F.concat(acc["cuts"], F.array(i + 1)).alias("cuts"))).otherwise(acc))
    return F.when(n > 0, res["cuts"]).otherwise(F.array().cast("array<int>"))


def pieces_from_cuts(lines: Column, cuts: Column, joiner: str = "\n") -> Column:
    """Slices of ``lines`` between cut positions; the tail after the last cut
    is a piece only when it is non-empty."""
    n = F.size(lines)
    ends = F.when((F.size(cuts) > 0) & (F.element_at(cuts, -1) == n), cuts) \
        .otherwise(F.concat(cuts, F.array(n)))
    ends = F.when(n == 0, F.array().cast("array<int>")).otherwise(ends)
    # ends is bound once; referenced inside the lambda it would be rebuilt per piece
    return let(ends, lambda es: F.transform(es, lambda e, j: F.array_join(
        F.slice(lines, _prev(es, j) + 1, e - _prev(es, j)), joiner)))


def _prev(arr: Column, j: Column) -> Column:
    """arr[j-1] (0-based j) or 0 for the first element."""
    return F.when(j > 0, F.element_at(arr, j)).otherwise(F.lit(0))


def _ends_with_any(line: Column, suffixes) -> Column:
    u = F.upper(trim_ws(line))
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | u.endswith(s)
    return cond


def budget_chunks(df: DataFrame, text: str, budget: int = SAS_BUDGET, key: str = "script_id") -> DataFrame:
    """Greedy chunks closed at the first RUN;/QUIT;/%MEND; line once a
    chunk has ``budget`` lines (``text.split('\\n')`` lines)."""
    df = df.withColumn("_lines", F.split(F.col(text), "\n", -1))  # materialised once, not per fold step
    lines = F.col("_lines")
    cuts = greedy_cuts(F.size(lines), lambda i: _ends_with_any(F.element_at(lines, i + 1), SAS_TERMINATORS), budget)
    out = df.withColumn("_cuts", cuts).select(
        key, F.posexplode(pieces_from_cuts(lines, F.col("_cuts"))).alias("chunk_no", "code"))
    return out.select(key, (F.col("chunk_no") + 1).alias("chunk_no"), "code",
                      F.size(F.split("code", "\n", -1)).alias("n_lines"))


def overflow_cuts(lines: Column, max_lines: int) -> Column:
    """B8 cut positions: each window of ``max_lines`` lines is cut after its
    last terminator line, else hard at the window end (single forward fold)."""
    n = F.size(lines)

    def step(acc, i):
        term = _ends_with_any(F.element_at(lines, i + 1), SAS_TERMINATORS)
        last = F.when(term, i).otherwise(acc["last"])
        win_end = F.least(acc["start"] + max_lines, n) - 1
        cut = F.when(last >= acc["start"], last + 1).otherwise(i + 1)
        at_end = i == win_end
        start2 = F.when(at_end, cut).otherwise(acc["start"])
        cuts2 = F.when(at_end, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"])
        # the tail window ending on the last line is closed in the same step
        tail = (i == n - 1) & (start2 < n)
        cuts3 = F.when(tail, F.concat(cuts2, F.array(n))).otherwise(cuts2)
        start3 = F.when(tail, n).otherwise(start2)
        return F.struct(start3.alias("start"), last.alias("last"), cuts3.alias("cuts"))

    acc0 = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("cuts"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), acc0, step)["cuts"]


def overflow_split(df: DataFrame, code: str = "code", id_col: str = "id", max_lines: int = SAS_OVERFLOW,
                   keys=("script_id",)) -> DataFrame:
    """A chunk over ``max_lines`` lines becomes ``<id>_subJ`` pieces (stripped);
    smaller chunks pass through unchanged. One explode, no union."""
    df = df.withColumn("_lines", splitlines_array(F.col(code)))
    lines = F.col("_lines")
    big = F.size(lines) > max_lines
    df = df.withColumn("_cuts", F.when(big, overflow_cuts(lines, max_lines)))
    subs = F.transform(pieces_from_cuts(lines, F.col("_cuts")), lambda p, j: F.struct(
        F.concat(F.col(id_col), F.lit("_sub"), (j + 1).cast("string")).alias("id"), trim_ws(p).alias("code")))
    items = F.when(big, subs).otherwise(F.array(F.struct(F.col(id_col).alias("id"), F.col(code).alias("code"))))
    return df.select(*keys, F.explode(items).alias("_x")).select(
        *keys, F.col("_x.id").alias(id_col), F.col("_x.code").alias(code))


# ------------------------------------------------------------------ B9-B11
def plsql_lines(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """One row per line of the comment-free script with its nesting depth.

    depth_i = S_i - min(0, min_{j<=i} S_j), S = running sum of
    (+1 BEGIN) (-1 END): the clamp-at-zero recursion in closed form.
    """
    clean = strip_plsql_comments(F.col(text))
    ex = df.select(key, F.posexplode(splitlines_array(clean)).alias("line_no", "line"))
    delta = F.when(F.col("line").rlike(BEGIN_RE), 1).otherwise(0) - F.when(F.col("line").rlike(END_RE), 1).otherwise(0)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ex = ex.withColumn("delta", delta).withColumn("S", F.sum("delta").over(w))
    ex = ex.withColumn("depth", (F.col("S") - F.least(F.lit(0), F.min("S").over(w))).cast("int"))
    return ex.withColumn("is_term", F.col("line").rlike(PLSQL_TERMINATOR)).drop("delta", "S")


def script_lines_arrays(lines: DataFrame, key: str = "script_id") -> DataFrame:
    """Back to one row per script: ordered arrays of (line, depth, is_term).
    Grouped on the window's key, so no second exchange."""
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "depth", "is_term")))
                               .alias("L"))
    return g.select(key, F.transform("L", lambda x: x["line"]).alias("lines"),
                    F.transform("L", lambda x: x["depth"]).alias("depth"),
                    F.transform("L", lambda x: x["is_term"]).alias("is_term"))


def terminator_blocks(arrs: DataFrame, key: str = "script_id") -> DataFrame:
    """A block ends at a ``/`` line while depth is 0; the rest is the last
    block. Block text is right-stripped. Keeps each block's line range."""
    n = F.size("lines")
    ends = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("is_term", i + 1)
                                & (F.element_at("depth", i + 1) == 0)), lambda i: i + 1)
    ends = let(ends, lambda e: F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.when((F.size(e) > 0) & (F.element_at(e, -1) == n), e).otherwise(F.concat(e, F.array(n)))))
    # bound once: used inside the lambda below, it would be rebuilt per block
    blocks = let(ends, lambda es: F.transform(es, lambda e, j: F.struct(_prev(es, j).alias("lo"), e.alias("hi"))))
    out = arrs.select(key, "lines", "depth", "is_term", F.posexplode(blocks).alias("block_no", "b"))
    rng = lambda c: F.slice(c, F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo"))
    return out.select(key, (F.col("block_no") + 1).alias("block_no"),
                      rstrip_ws(F.array_join(rng(F.col("lines")), "\n")).alias("code"),
                      rng(F.col("depth")).alias("depth"), rng(F.col("is_term")).alias("is_term"))


def safe_split(blocks: DataFrame, max_lines: int = PLSQL_BUDGET, keys=("script_id", "block_no")) -> DataFrame:
    """A block over ``max_lines`` lines is cut at depth 0 on a ``/`` line
    or a line ending ``;`` once the piece holds ``max_lines`` lines."""
    blocks = blocks.withColumn("_lines", splitlines_array(F.col("code")))
    lines = F.col("_lines")
    n = F.size(lines)

    def ok(i):
        line = F.element_at(lines, i + 1)
        return (F.element_at("depth", i + 1) == 0) & (
            F.element_at("is_term", i + 1) | F.upper(trim_ws(line)).endswith(";"))

    blocks = blocks.withColumn("_cuts", F.when(n > max_lines, greedy_cuts(n, ok, max_lines)))
    pieces = F.when(n > max_lines, F.transform(pieces_from_cuts(lines, F.col("_cuts")), lambda p: rstrip_ws(p))) \
        .otherwise(F.array(F.col("code")))
    return blocks.select(*keys, F.posexplode(pieces).alias("sub_no", "code")) \
        .withColumn("sub_no", F.col("sub_no") + 1)


def plsql_chunks(df: DataFrame, text: str = "text", key: str = "script_id",
                 max_lines: int = PLSQL_BUDGET) -> DataFrame:
    """Full PL/SQL chunker: B9 -> B10 -> B11 -> ids ``blk_%03d`` (B13) in order."""
    blocks = terminator_blocks(script_lines_arrays(plsql_lines(df, text, key), key), key)
    pieces = safe_split(blocks, max_lines, (key, "block_no"))
    w = Window.partitionBy(key).orderBy("block_no", "sub_no")
    return pieces.withColumn("seq", F.row_number().over(w)) \
        .select(key, chunk_id(F.col("seq")).alias("id"), "code", "seq")


def chunk_id(seq: Column) -> Column:
    """``blk_%03d`` from a 1-based position."""
    return F.format_string("blk_%03d", seq)


def whole_script(df: DataFrame, text: str = "text", key: str = "script_id") -> DataFrame:
    """The whole script as chunk ``blk_001`` (stripped)."""
    return df.select(key, F.lit("blk_001").alias("id"), trim_ws(F.col(text)).alias("code"))


# ------------------------------------------------------------------ B14, B15
def sas_chunk_type(code) -> Column:
    first = F.upper(F.split(trim_ws(_c(code)), "\n", -1)[0])
    return (F.when(first.startswith("%MACRO"), "MACRO").when(first.startswith("PROC "), "PROC")
            .when(first.startswith("DATA "), "DATA").otherwise("UNKNOWN"))


def plsql_object_type(code) -> Column:
    c = _c(code)
    head = F.regexp_extract(c, PLSQL_HEADER, 2)
    return (F.when(head != "", F.replace(F.upper(head), F.lit(" "), F.lit("_")))
            .when(F.upper(F.regexp_replace(c, rf"^{PY_WS}+", "")).startswith("BEGIN"), "ANONYMOUS_BLOCK")
            .otherwise("UNKNOWN"))


# ------------------------------------------------------------------ B16-B18
def sas_chunks(df: DataFrame, text: str = "text", key: str = "script_id", budget: int = SAS_BUDGET,
               max_lines: int = SAS_OVERFLOW) -> DataFrame:
    """SAS path of the dispatcher: blocks (B6) -> budget chunks (B7) -> macro definitions
    before uses (C1 to C3) -> ids in that order -> overflow split (B8). ``seq`` numbers the
    result. Chunks on or behind a macro cycle have no order and come last, as they stand."""
    blocks = sas_blocks(df, text, key).withColumn("_lines", F.split(F.col("code"), "\n", -1))
    lines = F.col("_lines")
    cuts = greedy_cuts(F.size(lines), lambda i: _ends_with_any(F.element_at(lines, i + 1), SAS_TERMINATORS), budget)
    ch = blocks.withColumn("_cuts", cuts).select(
        key, "block_no", F.posexplode(pieces_from_cuts(lines, F.col("_cuts"))).alias("sub", "code"))
    w = Window.partitionBy(key).orderBy("block_no", "sub")
    # chunked once and written: definitions, uses and the result read it
    ch = materialize(ch.select(key, F.row_number().over(w).alias("seq"), "code"), "sas_path_chunks")
    levels = graph.peel_levels(ch.select(key, F.col("seq").alias("node")), graph.macro_edges(ch, graph.macro_defs(ch, key), key), key)
    ordered = ch.join(levels.select(key, F.col("node").alias("seq"), "level"), [key, "seq"])
    w = Window.partitionBy(key).orderBy(F.col("level").asc_nulls_last(), "seq")
    ordered = ordered.withColumn("ord", F.row_number().over(w))
    ids = ordered.select(key, "ord", chunk_id(F.col("ord")).alias("id"), trim_ws(F.col("code")).alias("code"))
    out = overflow_split(ids, max_lines=max_lines, keys=(key, "ord"))
    w = Window.partitionBy(key).orderBy("ord", F.coalesce(F.regexp_extract("id", r"_sub(\d+)$", 1).try_cast("int"), F.lit(0)))
    return out.select(key, "id", "code", F.row_number().over(w).alias("seq"))


# fixed values: chunk labels of the whole-script sources and the PL/SQL source names
WHOLE_LABELS = {"snowflake": "Snowflake", "informatica": "Informatica", "datastage": "Datastage", "cobol": "COBOL"}
PLSQL_SOURCES = ["oracle", "plsql"]


def dialect_dispatch(scripts: DataFrame, key: str = "script_id", source: str = "source",
                     text: str = "text") -> DataFrame:
    """Splitter + type label by source platform (the intended dispatch:
    COBOL and other SQL dialects take the whole-script path)."""
    s = F.lower(F.col(source))
    sas = sas_chunks(scripts.filter(s == "sas"), text, key).withColumn("type", sas_chunk_type("code"))
    pl = plsql_chunks(scripts.filter(s.isin(PLSQL_SOURCES)), text, key).withColumn("type", plsql_object_type("code"))
    whole_src = scripts.filter(~s.isin(["sas", *PLSQL_SOURCES]))
    label = F.lit("SQL")
    for k, v in WHOLE_LABELS.items():
        label = F.when(F.lower(F.col(source)) == k, v).otherwise(label)
    whole = whole_src.select(key, F.lit("blk_001").alias("id"), trim_ws(F.col(text)).alias("code"),
                             F.lit(1).alias("seq"), label.alias("type"))
    cols = [key, "id", "type", "code", "seq"]
    cut = sas.select(*cols).unionByName(pl.select(*cols))
    # a script that gives no chunk still gives one row (B17): one outer join, the chunks are made once
    none = scripts.filter(s.isin(["sas", *PLSQL_SOURCES])).select(F.col(key), F.col(text).alias("_text")).join(cut, key, "left")
    cut = none.select(key, F.coalesce("id", F.lit("blk_001")).alias("id"), F.when(F.col("id").isNull(), "UNKNOWN").otherwise(F.col("type")).alias("type"),
                      F.when(F.col("id").isNull(), F.col("_text")).otherwise(F.col("code")).alias("code"), F.coalesce("seq", F.lit(1)).alias("seq"))
    return cut.unionByName(whole.select(*cols))


def empty_fallback(scripts: DataFrame, chunks: DataFrame, key: str = "script_id", text: str = "text") -> DataFrame:
    """A script without chunks still yields one UNKNOWN row (id ``blk_001``)."""
    has = chunks.select(key)  # anti join: no distinct needed
    missing = scripts.join(has, key, "left_anti").select(
        key, F.lit("blk_001").alias("id"), F.lit("UNKNOWN").alias("type"), F.col(text).alias("code"))
    return chunks.select(key, "id", "type", "code").unionByName(missing)


def chunk_profile(scripts: DataFrame, chunks: DataFrame, key: str = "script_id", text: str = "text") -> DataFrame:
    """Per script chunk count, unknown count and source line count."""
    agg = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"),
                                  F.count_if(F.col("type") == "UNKNOWN").alias("unknown_blocks"))
    lines = scripts.select(key, (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
                           .cast("bigint").alias("line_count"))
    return lines.join(agg, key, "left").fillna(0, ["chunk_count", "unknown_blocks"])


def line_count(text) -> Column:
    return splitlines_count(text)
