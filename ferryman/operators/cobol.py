"""COBOL record processing (family H): fixed-width layouts, PIC numerics,
packed decimal (COMP-3), character dates, REDEFINES and OCCURS.

All decoding is JVM-side string/binary arithmetic; no UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    start: int      # 1-based
    length: int
    pic: str = "X"  # "X", "9", "S9" (separate leading sign handled by a sign field)
    scale: int = 0

    @property
    def is_filler(self) -> bool:
        return self.name.upper() == "FILLER"


def fixed_width(df: DataFrame, rec: str, layout: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """H1: one ``substring`` per field; FILLER fields are left out."""
    cols = [F.col(k) for k in keep]
    cols += [F.substring(F.col(rec), f.start, f.length).alias(f.name) for f in layout if not f.is_filler]
    return df.select(*cols)


def code_page_text(raw: Column, code_page: str = "ascii") -> Column:
    """Bytes of a single-byte code page as text, in the JVM: each byte as the
    character of its own number, then exchanged for that of the code page."""
    page = {b: bytes([b]).decode(code_page, errors="replace") for b in range(256)}
    moved = [b for b in range(256) if page[b] != chr(b)]
    text = F.decode(raw, "ISO-8859-1")
    return F.translate(text, "".join(map(chr, moved)), "".join(page[b] for b in moved)) if moved else text


def fixed_length_records(spark: SparkSession, path: str, length: int, max_split: int = 128 << 20) -> DataFrame:
    """H1, binary form: ``rec`` (binary) of each record of ``length`` bytes, without line
    breaks. Files are split at record ends, by ``max_split`` bytes at most, so one
    large file is read by many tasks. The records stay in the JVM."""
    jvm = spark.sparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(max(max_split, length)))
    rdd = spark.sparkContext._jsc.sc().binaryRecords(path, length, conf)
    return DataFrame(spark._jsparkSession.createDataset(rdd, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).withColumnRenamed("value", "rec")


def fixed_width_bytes(df: DataFrame, rec: str, layout: Sequence[Field], code_page: str = "ascii", keep: Sequence[str] = ()) -> DataFrame:
    """H1: fields of binary records; ``pic="P"`` (packed decimal) stays binary for
    :func:`comp3_decode`, all others are text of the code page."""
    cols = [F.col(k) for k in keep]
    for f in layout:
        if not f.is_filler:
            raw = F.substring(F.col(rec), f.start, f.length)
            cols.append((raw if f.pic == "P" else code_page_text(raw, code_page)).alias(f.name))
    return df.select(*cols)


def pic_numeric(digits: Column, int_digits: int, scale: int, sign: Column | None = None) -> Column:
    """H2: PIC 9(n)V9(m) (optionally signed) -> DECIMAL(n+m, m).

    Non-digit content gives null (``try_cast``), the implied decimal point
    is applied by exact decimal multiplication.
    """
    p = int_digits + scale
    raw = F.when(digits.rlike(r"^[0-9]+$"), digits.try_cast(f"decimal({p},0)"))
    val = _implied_point(raw, scale)
    if sign is not None:
        val = F.when(sign == "-", -val).otherwise(val)
    return val.cast(f"decimal({p},{scale})")


def comp3_decode(packed: Column, precision: int, scale: int) -> Column:
    """H3: packed decimal bytes -> DECIMAL(precision, scale).

    Each byte holds two BCD digits; the last nibble is the sign
    (D or B = minus, anything else plus). ``hex`` exposes the nibbles.
    """
    h = F.hex(packed)
    digits = F.regexp_extract(h, r"^([0-9]*)[A-F]$", 1)   # all nibbles but the sign
    sign_nib = F.substring(h, -1, 1)
    raw = F.when(F.length(digits) > 0, digits.try_cast(f"decimal({precision},0)"))
    val = _implied_point(raw, scale)
    val = F.when(sign_nib.isin("D", "B"), -val).otherwise(val)
    return val.cast(f"decimal({precision},{scale})")


def _implied_point(raw: Column, scale: int) -> Column:
    """Exact decimal shift by 10^-scale (no double arithmetic)."""
    if not scale:
        return raw
    return raw * F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale + 1},{scale})")


def cobol_date(txt: Column, fmt: str = "yyyyMMdd") -> Column:
    """H4: character date + picture -> DATE; impossible dates become null."""
    return F.try_to_timestamp(txt, F.lit(fmt)).cast("date")


def strip_zeros(txt: Column) -> Column:
    """H5: drop leading zeros, keeping one digit when all are zero."""
    return F.regexp_replace(txt, r"^0+(?=.)", "")


def redefines(type_col: Column, readings: dict[str, Column]) -> dict[str, Column]:
    """H6: several readings of the same bytes, each valid for one record type."""
    return {name: F.when(type_col == t, expr) for t, (name, expr) in readings.items()}


def occurs(block: Column, times: int, width: int) -> Column:
    """H7: OCCURS n TIMES PIC X(width) -> array of the n slices (posexplode it)."""
    return F.transform(F.sequence(F.lit(0), F.lit(times - 1)),
                       lambda i: F.substring(block, i * width + 1, width))
