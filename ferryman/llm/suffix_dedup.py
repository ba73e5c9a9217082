"""Byte-level dedup by a logarithmic family of sorted suffix indexes.

Documents come in batches. Of each batch, the suffixes that start at sampled places are put
in order by the fingerprint of their first ``prefix`` bytes and written as an index of their
own. It is merge-scanned against every existing level: suffixes whose prefixes agree are the
candidates of long matches. Then indexes of equal size merge into the next level, so that n
batches cost n log n of index writing, and a new batch is held against at most log n levels.

Places are sampled by winnowing, so every match of ``window`` bytes holds a sampled place at
the same offset on both sides, and no match is missed. Candidates are extended in both
directions to exact results in ``repeats``. Every byte covered by a string of ``window`` bytes
that also starts anywhere else (same document included) is removed; matches never cross documents.

Defined cases: a null text is empty; shorter texts stay whole; rows equal in doc_id and text are
two places each; removal is by bytes and may cut a UTF-8 sequence, so the kept part is given
as bytes; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import anchors, byte_units, removed_units, repeated_windows, with_row_id
from .tables import drop, keep
from .textblock import blocks, column

WINDOW = 200
PREFIX = 48
BATCHES = 4


class IndexFamily:
    """Levels of suffix indexes, each twice the size of the one below; keys in order, without repeats."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    @staticmethod
    def _index(keys: DataFrame) -> DataFrame:
        return keep(keys.sortWithinPartitions("key"), "index")

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch (rows with ``key``), scan it against all levels, then merge levels of equal size."""
        own = keep(suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "batch-index")
        found = own.filter("n > 1").select("key")
        index = own.select("key")
        for level in self.levels.values():
            found = found.unionAll(index.join(level.hint("merge"), "key", "left_semi"))
        self.matches.append(keep(found.distinct(), "matches"))
        rank = 0
        while rank in self.levels:
            merged = self._index(index.unionAll(self.levels[rank]).distinct())
            drop(self.spark, index, self.levels.pop(rank))
            index, rank = merged, rank + 1
        self.levels[rank] = index

    def matched(self) -> DataFrame:
        """Keys of suffixes that agree with another suffix of any batch."""
        out = self.matches[0]
        for x in self.matches[1:]:
            out = out.unionAll(x)
        return out.distinct()


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """(rid, packs) for documents that hold repeating strings, through the index family."""
    spark = docs.sparkSession
    suffixes = keep(anchors(docs, byte_units, window, prefix).withColumn("batch", F.pmod("rid", F.lit(batches)).cast("int")), "suffixes", "batch")
    family = IndexFamily(spark)
    for i in range(batches):
        family.add(suffixes.filter(F.col("batch") == i).select("key"))
    matched = keep(family.matched(), "matched-keys")
    found = keep(suffixes.select("rid", "key", "ctx", "pack").join(matched, "key", "left_semi"), "matched-suffixes")
    drop(spark, suffixes, matched, *family.levels.values(), *family.matches)
    runs = repeated_windows(docs, found, byte_units, window, (16, 1))
    drop(spark, found)
    return runs


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row."""
    docs = with_row_id(docs)
    runs = repeats(docs, window, prefix, batches)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(rows):
            gone = removed_units(batch, off, window)
            n_removed, n_spans, sha, parts = [], [], [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                own = gone[a:b]
                kept = data[a:b][~own].tobytes()
                n_removed.append(int(b - a) - len(kept))
                n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                parts.append(kept)
            arrays = [column(batch, "doc_id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return docs.join(runs, "rid", "left").mapInArrow(task, schema)
