"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest hashes of a document's distinct 5-word shingles (A-Z lower-cased;
with fewer words, the whole sequence as one). Sketches of parts merge into the sketch of the
whole, and estimate resemblance, containment and the number of distinct shingles; below k
shingles the sketch is the whole set and the figures are exact.

Defined cases: a null text is empty; an empty text has an empty sketch; two empty sketches
have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import sets_of
from .textblock import BLOCK_BYTES, U64, text_buffer

K = 128
#: hashes are held with 48 bits
SPACE = 1 << 48


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, in order."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), 4000):
        data, off = text_buffer(pa.array(texts[i : i + 4000], pa.large_string()))
        values, at = sets_of(data, off)
        values = values >> U64(4)
        out.extend(np.unique(values[a : min(a + k, b)]) for a, b in zip(at[:-1], at[1:], strict=True))
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both documents together."""
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * SPACE / float(sketch[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union: the share of the union's k smallest that both hold."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twin = both[1:] == both[:-1]
    union = both[np.r_[True, ~twin]]
    size = min(k, len(union))
    return float((both[1:][twin] <= union[size - 1]).sum()) / size


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimate) of every row, in one pass without a shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([x or "" for x in batch.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, fingerprint string, n_distinct double")


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the first of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, ghost, key, doc_id, text: documents by descending doc_id, in buckets; after each bucket's rows stand, as ghosts, the first of the next one.

    Buckets are ranges of doc_id at quantiles, which are doc_ids of the table themselves, so a bucket's
    limit is its largest doc_id. These limits alone, four a shuffle partition, reach the driver; a row finds its bucket
    among them by binary search. A null doc_id comes last. The last bucket is followed by the first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(lowest)).alias("key"))
    # one constant, however many shares
    share = F.split(F.lit(",".join(str(i / (4 * n)) for i in range(1, 4 * n))), ",").cast("array<double>")
    cuts, largest = keyed.agg(F.percentile_approx("key", share, F.lit(max(100_000, 20 * n))), F.max("key")).first()
    if largest is None:
        return keyed.select(F.lit(0).alias("bucket"), F.lit(0).alias("ghost"), "key", "doc_id", "text")
    heads = np.array(sorted({*cuts, largest}), np.int64)

    @F.pandas_udf("bucket int, follows int")
    def place(key: pd.Series) -> pd.DataFrame:
        """The row's bucket, and the bucket that it follows if it is the first of its own (else -1)."""
        bucket = np.searchsorted(heads, key.to_numpy())
        return pd.DataFrame({"bucket": bucket, "follows": np.where(heads[bucket] == key.to_numpy(), (bucket + 1) % len(heads), -1)}, dtype=np.int32)

    keyed = keyed.withColumn("p", place("key"))
    places = F.array(F.struct(F.col("p.bucket").alias("bucket"), F.lit(0).alias("ghost")), F.struct(F.col("p.follows").alias("bucket"), F.lit(1).alias("ghost")))
    copies = keyed.select("key", "doc_id", "text", F.explode(F.filter(places, lambda p: p["bucket"] >= 0)).alias("at"))
    return copies.select("at.bucket", "at.ghost", "key", "doc_id", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), "text")


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, edited_containment of every row."""

    def flush(rows: list) -> pa.RecordBatch:
        texts = [t for _, t, _ in rows]
        after = [f for _, _, f in rows]
        edits = [edited(t, f) for t, f in zip(texts, after, strict=True)]
        own, changed, following = sketches(texts, k), sketches(edits, k), sketches(after, k)
        columns = {
            "doc_id": pa.array([i for i, _, _ in rows], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            "fingerprint": pa.array([encode(s) for s in own], pa.string()),
            "edited_fingerprint": pa.array([encode(s) for s in changed], pa.string()),
            "near_edited": pa.array([resemblance(a, b, k) for a, b in zip(own, changed, strict=True)], pa.float64()),
            "near_next": pa.array([resemblance(a, b, k) for a, b in zip(own, following, strict=True)], pa.float64()),
            "n_distinct": pa.array([distinct(s, k) for s in own], pa.float64()),
            "edited_containment": pa.array([containment(a, b, k) for a, b in zip(own, changed, strict=True)], pa.float64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, held = None, [], 0
        for batch in batches:
            for bucket, ghost, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if last and last[0] == bucket and not last[1]:
                    rows.append((last[2], last[3], text))
                    held += len(last[3])
                    if held > BLOCK_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                last = (bucket, ghost, doc_id, text)
        if rows:
            yield flush(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, edited_containment double"
    return in_order(docs).mapInArrow(task, schema)
