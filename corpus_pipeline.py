"""Corpus pipeline: toxicity filter, near-dedup, substring dedup, mixing, encoding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and reread as the next stage's documents. All but the last return the columns of
documents; a text that a stage changes gets its new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryman.llm import minhash, mixing, sentencepiece, substring_dedup, toxicity
from ferryman.llm.tables import drop, keep, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("score < 0.5").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, and of rows equal in doc_id and text one row; rows without doc_id stay."""
    kept = minhash.near_duplicates(docs).filter("kept and doc_id is not null").select("rid").distinct()
    # the document travels as one column, so that no name of its own clashes
    rows = docs.filter("doc_id is not null").select(minhash.row_id(), F.struct("*").alias("doc"))
    return rows.join(kept, "rid", "left_semi").dropDuplicates(["rid"]).select("doc.*").unionAll(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeating 35-word windows; a document may become empty."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = substring_dedup.remove_repeats(docs, carry=rest)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("carried")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 and exact of each row of the mix."""
    return sentencepiece.encode_and_check(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", drop_near_duplicates),
    ("substring-dedup", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

#: the first stage is a trained network; tests/llm holds run() against a brute-force version of all stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(spark, before)
        before = docs = after
    return docs
