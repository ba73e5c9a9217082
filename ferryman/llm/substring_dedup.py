"""Substring dedup over words: seed and extend on winnowed anchors.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. Every word
covered by a window that also starts at another place, in any document, is removed; windows
are judged on the input. Overlapping and adjoining windows form the maximal repeats.

Defined cases: a null text has no words; texts shorter than a window keep all words; rows
equal in doc_id and text are two places each; a null doc_id is carried through; further columns
of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import anchors, removed_units, repeated_windows, with_row_id, word_units
from .tables import drop, keep
from .textblock import Words, blocks, column

WINDOW = 35
SEED_WORDS = 8


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(rid, packs) for documents that hold repeating windows, by seed and extend."""
    spark = docs.sparkSession
    seeds = keep(anchors(docs, word_units, window, seed_words), "seeds")
    # written, so that the join is of two plain tables and Spark can split a hot seed's rows
    shared = keep(seeds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    found = keep(seeds.join(shared, "key", "left_semi"), "shared-seeds")
    drop(spark, seeds, shared)
    runs = repeated_windows(docs, found, word_units, window, (1,))
    drop(spark, found)
    return runs


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row, and the columns to ``carry`` along in the struct ``carried``.

    ``kept_text`` is the unchanged text where nothing is removed, else the kept words
    joined by one space. ``kept_sha256`` is of the kept words joined by one space.
    """
    docs = with_row_id(docs, carry)
    runs = repeats(docs, window, seed_words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            words = Words(data, off)
            gone = removed_units(batch, words.off, window)
            lost = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.off[:-1]) * (words.count > 0)
            sha, texts = [], []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                kept = text.encode()
                if lost[i]:
                    own = np.flatnonzero(~gone[words.off[i] : words.off[i + 1]]) + words.off[i]
                    kept = b" ".join([data[a:b].tobytes() for a, b in zip(words.start[own], words.end[own], strict=True)])
                    text = kept.decode()
                texts.append(text)
                sha.append(hashlib.sha256(b" ".join(kept.split())).hexdigest())
            arrays = [column(batch, "doc_id"), column(batch, "carried"), pa.array(words.count.astype(np.int64)), pa.array(lost), pa.array(sha), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "carried", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = docs.select("doc_id", "carried").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    return docs.join(runs, "rid", "left").mapInArrow(task, schema)
