"""Exact search for windows of W units (words or bytes) that stand at two places or more.

*Seeds.* Every window has an anchor: the smallest hash among its k-unit grams (winnowing).
Equal windows have equal anchors at the same offset, so only occurrences of the same anchor
gram can hold equal windows. An anchor occurrence stands for a run of window starts.

*Extension, without pairs.* Occurrences of an anchor gram are grouped by the whole text that
their windows cover: where two share it, all their windows repeat. Of each distinct covered
text one occurrence goes on, if its gram has several; its run is cut into pieces, which are
grouped by the text that all windows of the piece have in common (the core) and by the text
they cover (the hull), and so on down to single windows. Work and rows stay in proportion to
the occurrences, also where a passage stands in a third of all documents: classes are
counted with partial sums before the shuffle, and no pair of occurrences is ever made.

Comparisons use two independent 64-bit hashes at least (gram and covered text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, keep
from .textblock import U64, Hasher, Words, blocks, byte_codes, column, covered, mix, starts, window_minima

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

ROW = "rid long, key long, ctx long, pack long"
BACK, WIDTH = 1 << 8, 1 << 16


def word_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, off)
    return words.codes(), words.off


def byte_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_codes()[data], off


def with_row_id(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to carry as one, and a row id from doc_id and text; rows equal in both share it, which is harmless (they repeat each other)."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*(carry or [F.lit(0).alias("_")])).alias("carried"))


def _row_batch(rid, key, ctx, q, back, width) -> pa.RecordBatch:
    pack = (q * WIDTH + back * BACK + width).astype(np.int64)
    arrays = [pa.array(x) for x in (rid, key.view(np.int64), ctx.view(np.int64), pack)]
    return pa.RecordBatch.from_arrays(arrays, names=["rid", "key", "ctx", "pack"])


def anchors(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """One row for each anchor occurrence: gram hash, hash of the text its windows cover, and place."""
    assert window - gram < BACK

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)
        for batch, data, off in blocks(batches):
            codes, off = units(data, off)
            prefix = hasher.prefix(codes)
            at, text = starts(off, window)
            if not len(at):
                continue
            grams = hasher.grams(prefix, gram)
            anchor = window_minima(grams, window - gram + 1)[at]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
            last = np.r_[new[1:], len(at)] - 1
            lo, hi, q, text = at[new], at[last], anchor[new], text[new]
            ctx = mix(hasher.spans(prefix, lo, hi + window) + ((q - lo) * BACK + hi - lo).astype(U64))
            rid = column(batch, "rid").to_numpy()[text]
            yield _row_batch(rid, grams[q], ctx, q - off[text], q - lo, hi - lo)

    return docs.select("rid", "text").mapInArrow(task, ROW)


def split_classes(rows: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows that share gram and covered text with another; one row of each covered text of a gram that has several."""
    classes = keep(rows.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pack")).alias("one")), "classes")
    again = classes.filter("n > 1").select("key", "ctx")
    repeated = rows.join(again, ["key", "ctx"], "left_semi").select("rid", "pack")
    if last:
        return repeated, None, classes
    several = keep(classes.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key"), "several")
    open_rows = classes.join(several, "key", "left_semi").select("one.rid", "one.pack", "key")
    return repeated, open_rows, classes


def pieces(docs: DataFrame, open_rows: DataFrame, units: Units, window: int, size: int) -> DataFrame:
    """The runs of the open rows, cut into pieces of ``size`` window offsets, as rows with core and hull hashes."""
    lists = open_rows.groupBy("rid").agg(F.collect_list(F.struct("pack", "key")).alias("open")).select("rid", F.col("open.pack").alias("packs"), F.col("open.key").alias("keys"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(3)
        for batch, data, off in blocks(batches):
            codes, off = units(data, off)
            prefix = hasher.prefix(codes)
            packs, keys = column(batch, "packs"), column(batch, "keys")
            text = np.repeat(np.arange(batch.num_rows), np.diff(packs.offsets.to_numpy()))
            pack = packs.flatten().to_numpy()
            key = keys.flatten().to_numpy().view(U64)
            q, high = off[text] + pack // WIDTH, pack // BACK % BACK
            low = high - pack % BACK
            count = high // size - low // size + 1
            which = np.repeat(np.arange(len(pack)), count)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + (low // size)[which]
            q, text, key = q[which], text[which], key[which]
            a, b = np.maximum(low[which], piece * size), np.minimum(high[which], piece * size + size - 1)
            core = hasher.spans(prefix, q - piece * size, q - (piece * size + size - 1) + window)
            hull = hasher.spans(prefix, q - b, q - a + window)
            key = mix(key ^ mix(core + piece.astype(U64)))
            ctx = mix(hull + (a * BACK + b).astype(U64), 1)
            rid = column(batch, "rid").to_numpy()[text]
            for i in range(0, len(q), 500_000):
                s = slice(i, i + 500_000)
                yield _row_batch(rid[s], key[s], ctx[s], (q - off[text])[s], b[s], (b - a)[s])

    return docs.select("rid", "text").join(lists, "rid").mapInArrow(task, ROW)


def repeated_windows(docs: DataFrame, found: DataFrame, units: Units, window: int, sizes: tuple[int, ...]) -> DataFrame:
    """(rid, packs): the runs of window starts of each text that repeat, from its anchor rows ``found``.

    ``sizes`` are the piece sizes of the refinement; the last is 1.
    """
    spark = docs.sparkSession
    repeated, open_rows, classes = split_classes(found)
    all_repeated = [keep(repeated, "repeated")]
    for size in sizes:
        cut = keep(pieces(docs, open_rows, units, window, size), "pieces")
        drop(spark, classes)
        repeated, open_rows, classes = split_classes(cut, last=size == 1)
        all_repeated.append(keep(repeated, "repeated"))
        if size == 1:
            drop(spark, cut, classes)
    runs = all_repeated[0]
    for x in all_repeated[1:]:
        runs = runs.unionAll(x)
    out = keep(runs.groupBy("rid").agg(F.collect_list("pack").alias("packs")), "runs")
    drop(spark, *all_repeated)
    return out


def removed_units(batch: pa.RecordBatch, off: np.ndarray, window: int) -> np.ndarray:
    """Which units of a block are covered by a repeating window; ``packs`` may be null."""
    packs = column(batch, "packs")
    count = np.array([len(x) if x is not None else 0 for x in packs.to_pylist()]) if packs.null_count else np.diff(packs.offsets.to_numpy())
    text = np.repeat(np.arange(batch.num_rows), count)
    pack = packs.flatten().to_numpy()
    lo = off[text] + pack // WIDTH - pack // BACK % BACK
    return covered(int(off[-1]), lo, lo + pack % BACK + window)
