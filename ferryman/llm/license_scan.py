"""License scan by diagonal voting.

Words are runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The hashes of
all rolling ``GRAM``-word grams are joined to the places of the same grams in the templates; a
hit at word p of a document and word t of a template votes for the diagonal p - t. Votes are
summed by diagonal. A phrase stands at a place if all grams of the phrase vote for that one
diagonal. For the longer templates, diagonals at most ``DRIFT`` words apart are merged (words put in or
left out shift the diagonal), and a span is verified by the share of the template's words
that its hits cover, which is its score.

Hits are checked by a second, independent hash. The template side of the join is a constant
of a few hundred rows and is broadcast; documents are not shuffled, only their hits are.

Defined cases: a null text has no words; no label: empty label strings, score 0, null places;
rows equal in doc_id and text are judged alike; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferryman.sources.tables import literal_table

from .textblock import Hasher, Words, blocks, column, lowered, starts, text_buffer

GRAM = 3
DRIFT = 3
COVER = 0.6

#: fixed values: (label, phrase) that must stand word by word
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: fixed values: (label, sentence of the license or of its notice), found also with some words changed
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without written permission"),
)


def _grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the word place within its text, and the text of every gram."""
    at, text = starts(words.off, k)
    out = []
    for seed in (51, 52):
        h = Hasher(seed)
        out.append(h.grams(h.prefix(words.codes(seed)), k)[at].view(np.int64) if len(at) else np.zeros(0, np.int64))
    return out[0], out[1], at - words.off[:-1][text], text


def template_rows(spark: SparkSession, k: int = GRAM) -> DataFrame:
    """gram, proof, template, label, exact, length, place: a row for each gram of each template."""
    rows = []
    for number, (label, phrase) in enumerate(PHRASES + TEMPLATES):
        data, off = text_buffer(pa.array([phrase], pa.string()))
        words = Words(lowered(data), off, alnum=True)
        gram, proof, at, _ = _grams(words, k)
        rows += [(int(g), int(p), number, label, number < len(PHRASES), int(words.count[0]), int(t)) for g, p, t in zip(gram, proof, at, strict=True)]
    return literal_table(spark, rows, ("gram", "proof", "template", "label", "exact", "length", "place"))


def scan(docs: DataFrame, k: int = GRAM, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row."""
    spark = docs.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            words = Words(lowered(data), off, alnum=True)
            gram, proof, at, text = _grams(words, k)
            rid = column(batch, "rid").to_numpy()
            n = batch.num_rows
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), pa.array(words.count.astype(np.int64)), none, none], names=["rid", "doc_id", "at", "gram", "proof"])
            yield pa.RecordBatch.from_arrays([pa.array(rid[text]), pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int64)), pa.array(gram), pa.array(proof)], names=["rid", "doc_id", "at", "gram", "proof"])

    # a row for each gram (word place in "at"), and one for each document (gram null, number of words in "at")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text").mapInArrow(task, "rid long, doc_id long, at long, gram long, proof long")
    places = template_rows(spark, k).withColumnsRenamed({"gram": "t_gram", "proof": "t_proof"})
    hits = rows.join(F.broadcast(places), (F.col("gram") == F.col("t_gram")) & (F.col("proof") == F.col("t_proof")), "left").filter("gram is null or template is not null")

    # votes by diagonal; the rows of documents pass as groups of their own (template null), with their number
    votes = hits.groupBy("rid", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("length").alias("length"), F.collect_set("place").alias("places"),
        F.max("at").alias("at"), F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"),
    )
    by = Window.partitionBy("rid", "template").orderBy("diagonal")
    jump = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= drift, 0).otherwise(1)
    votes = votes.withColumn("whole", F.col("exact") & (F.size("places") == F.col("length") - (k - 1))).withColumn("jump", jump)
    votes = votes.withColumn("span", F.sum("jump").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy("rid", "template", "span").agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("length").alias("length"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.count_if("whole").alias("whole"), F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"), F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        F.max("at").alias("at"), F.first("doc_id").alias("doc_id"), F.max("copies").alias("copies"), F.min("diagonal").alias("diagonal"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    spans = spans.withColumn("cover", words / F.col("length"))
    found = F.when(~F.col("exact") & (F.col("cover") >= cover), F.col("label"))
    base = F.when(F.col("whole") > 0, F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    is_doc = F.col("template").isNull()
    result = spans.groupBy("rid").agg(
        F.max(F.when(is_doc, F.col("doc_id"))).alias("doc_id"), F.max(F.when(is_doc, F.col("at"))).alias("n_words"), F.max(F.when(is_doc, F.col("copies"))).alias("copies"),
        F.coalesce(F.sum("whole"), F.lit(0)).alias("found_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        joined(F.collect_set(base)).alias("base_labels"), joined(F.array_union(F.collect_set(base), F.collect_set(found))).alias("labels"),
        F.coalesce(F.max(F.when(base.isNotNull(), 1.0).otherwise(F.when(~F.col("exact"), F.col("cover")))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(base.isNotNull() | found.isNotNull(), F.struct("label", F.col("diagonal").alias("word"), "cover"))).alias("spans"),
    )
    # hits of rows equal in doc_id and text are counted as sets or by diagonal, so the copies only repeat the row
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return result.select("doc_id", "n_words", F.col("found_base").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score", "spans", copies.alias("copy")).drop("copy")
