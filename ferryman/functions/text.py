"""Column-level text functions (all JVM-side, codegen-friendly).

Each returns a ``Column``; none uses a Python UDF. The character classes
follow Python's ``str.split()`` / ``str.strip()`` / ``str.splitlines()`` so
results equal what the scripts' original Python tooling computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"
# fixed values: Python's whitespace (str.isspace) and line-break (str.splitlines) characters
# Python str.isspace() characters, as a regex class usable by Java and RE2 alike
PY_WS = r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# the same 29 characters as a plain set, for the trim functions
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# Python str.splitlines() boundaries
PY_LINEBREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a Column lambda).

    ``element_at(transform(array(v), body), 1)``: the lambda variable is
    bound once per row, so a check that uses an intermediate text several
    times does not re-run the regexes behind it, even after Catalyst inlines
    the expression into a pushed-down filter, and an array used inside
    another lambda is built once per row, not once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def line_count_newlines(c) -> Column:
    """``text.count("\\n") + 1`` -- 1 also for the empty text (A4)."""
    c = _c(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(NL), F.lit(""))) + 1).cast("bigint")


def splitlines_count(c) -> Column:
    """``len(text.splitlines())``: 0 for '', no extra line after a trailing break."""
    c = _c(c)
    n_breaks = F.regexp_count(c, F.lit(PY_LINEBREAK))
    ends_with_break = c.rlike("(" + PY_LINEBREAK + r")\z")
    return (F.when(F.length(c) == 0, F.lit(0))
            .otherwise(n_breaks + F.when(ends_with_break, 0).otherwise(1))).cast("bigint")


def token_count(c) -> Column:
    """Whitespace token count (``len(text.split())``); empty/blank -> 0."""
    c = _c(c)
    return F.size(F.filter(F.split(c, PY_WS + "+"), lambda x: x != "")).cast("bigint")


def trim_ws(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only blanks.

    ``btrim`` with the whitespace set touches only the two ends of the text;
    a regex ``^ws+|ws+$`` would scan all of it.
    """
    return F.btrim(_c(c), F.lit(PY_WS_CHARS))


def lstrip_ws(c) -> Column:
    return F.ltrim(_c(c), F.lit(PY_WS_CHARS))


def rstrip_ws(c) -> Column:
    return F.rtrim(_c(c), F.lit(PY_WS_CHARS))


def splitlines_array(c) -> Column:
    """Python ``text.splitlines()``: no trailing empty piece, [] for ''."""
    c = _c(c)
    body = F.regexp_replace(c, "(" + PY_LINEBREAK + r")\z", "")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(body, PY_LINEBREAK, -1))


# DuckDB twins used by oracle SQL (RE2 accepts the same classes)
def duck_tokens(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{PY_WS}+'), lambda w: w <> '')) AS BIGINT)"


def duck_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def duck_splitlines_count(x: str) -> str:
    return (f"CAST(CASE WHEN length({x}) = 0 THEN 0 ELSE len(regexp_extract_all({x}, '{PY_LINEBREAK}')) + "
            f"CASE WHEN regexp_matches({x}, '({PY_LINEBREAK})$') THEN 0 ELSE 1 END END AS BIGINT)")
