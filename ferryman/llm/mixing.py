"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) get the weights in turn. Their targets share the whole
of all sizes by weight, but none exceeds ``max_epochs`` times its source's size: the excess is
reshared by weight among the others until none is above. A source then takes every document
``floor(target / size)`` times, and words for the rest of its target from its documents in an
order seeded by hash: whole documents, and of the last one a part, so that the words taken
meet the target to the word.

Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the text. Defined cases: a null text has
size 0 and takes 0; a null source is a source; sources without words get target 0 and their
share goes to the others; rows that repeat a doc_id are separate documents; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryman.operators.etl import sequence_key

from .tables import drop, keep

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 4
#: slices of a source in the sampling order; running sums go over slices, then inside the one where the target falls
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one for each source.

    Only three sums of each round reach the driver; a round caps at least one more source.
    """
    ranked = sequence_key(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], name="rank").drop("last")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = keep(ranked.withColumn("weight", F.element_at(turn, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))), "ranked-sources")
    cap = F.col("source_size") * float(max_epochs)
    level, capped = 0.0, -1
    while True:
        over = cap < level * F.col("weight")
        n, cap_sum, free, total = ranked.agg(
            F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum("source_size")
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - cap_sum) / free
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats (whole ones), part (words of a last, partial one) of every row; ``rid`` ties it to its row."""
    spark = docs.sparkSession
    sized = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "source", word_count("text").alias("size"))
    sized = sized.withColumn("turn", F.xxhash64("rid", F.lit(seed))).withColumn("slice", F.pmod("turn", F.lit(SLICES)).cast("int"))
    sized = keep(sized, "sized")
    slices = keep(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long"))
    targets = keep(targets.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "targets")

    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    t, s = targets.alias("t"), slices.withColumn("end", F.sum("slice_size").over(up_to)).alias("s")
    state = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "slice", "source_size", "target", "whole", "rest", (F.col("end") - F.col("slice_size")).alias("begin"), "end")
    d, b = sized.alias("d"), keep(state, "slice-states").alias("b")
    rows = d.join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.slice") == F.col("b.slice")))
    rows = keep(rows.select("rid", "doc_id", "d.source", "size", "turn", "source_size", "target", "whole", "rest", "begin", "end"), "sliced-rows")

    inside = (F.col("begin") < F.col("rest")) & (F.col("rest") < F.col("end"))
    plain = rows.filter(~inside).withColumn("extra", F.when(F.col("end") <= F.col("rest"), F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    split = rows.filter(inside).withColumn("to", F.col("begin") + F.sum("size").over(order))
    split = split.withColumn("extra", F.least("size", F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("to") + F.col("size")))).drop("to")
    out = plain.unionByName(split).select(
        "rid", "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
        (F.col("whole") + F.when((F.col("size") > 0) & (F.col("extra") == F.col("size")), 1).otherwise(0)).alias("repeats"),
        F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0).alias("part"),
    )
    drop(spark, sized, slices, targets, b)
    return out


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each repetition of a document, with its columns.

    Whole repetitions have the unchanged text; a part has the first words, joined by one space.
    Rows equal in doc_id and text stand once, with the repetitions of all of them.
    """
    taken = mix(docs, weights, max_epochs, seed).filter("taken > 0").groupBy("rid").agg(F.sum("repeats").alias("repeats"), F.sum("part").alias("part"))
    # the document travels as one column, so that no name of its own clashes
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.struct("*").alias("doc")).dropDuplicates(["rid"]).join(taken, "rid")
    text = F.col("doc.text")
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.col("part").cast("int")), " ")
    whole = F.when(F.col("repeats") > 0, F.array_repeat(text, F.col("repeats").cast("int"))).otherwise(F.array().cast("array<string>"))
    part = F.when(F.col("part") > 0, F.array(first_words)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc", F.explode(F.concat(whole, part)).alias("taken_text"))
    return rows.select(*[F.col("taken_text").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
