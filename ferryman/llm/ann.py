"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a unit vector x by floor((a*x + b) / WIDTH) for ``HASHES`` Gaussian
(2-stable) directions a; the tuple is its bucket. A query visits, in each table, the ``PROBES``
buckets that its neighbours most likely fall in: its own and perturbed ones (each hash value less
one, as it is, or plus one), in the order of the summed squared distances from the query's projections to the
boundaries crossed. The candidates of all tables are merged and ranked by the exact cosine of the original vectors.

Rows of vectors and of probes meet in one shuffle by bucket. Buckets of more than ``CHUNK`` vectors are cut
into chunks, which all probes of the bucket visit, so a very common vector fills no single
task. A query that has found fewer than k goes on to all buckets of a table, so it
gets all candidates if there are fewer.

Vectors that are null, zero, of another length than ``dim`` or hold a null or non-finite
component take no part, nor do rows without vec_id. Ties go to the smaller vec_id; rows that
repeat a vec_id and its embedding count once; a vec_id with several embeddings is searched by
and found by each of them, and counts once, with its best score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, keep
from .textblock import U64, column, mix

TABLES, HASHES, WIDTH, PROBES = 12, 4, 1.0, 30
CHUNK = 4096
K = 5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of float) of the rows that take part."""
    ok = F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").filter(ok)


def hashed(vectors: DataFrame, queries_every: int, dim: int, seed: int = 6) -> DataFrame:
    """bucket, first (of the first table), probe (0: a vector, 1: a query's visit), id, vec of every vector and visit."""
    rng = np.random.default_rng(seed)
    direction = rng.standard_normal((dim, TABLES, HASHES))
    offset = rng.random((TABLES, HASHES)) * WIDTH
    moves = np.array(list(product((-1, 0, 1), repeat=HASHES)))
    crossed = np.concatenate([moves == -1, moves == 1], axis=1).astype(float).T

    def bucket(cells: np.ndarray, table: int) -> np.ndarray:
        out = np.full(cells.shape[:-1], table, U64)
        for i in range(HASHES):
            out = mix(out ^ cells[..., i].astype(np.int64).view(U64), i)
        return out.view(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "embedding")
            fits = lists.value_lengths().to_numpy(zero_copy_only=False) == dim
            if not fits.any():
                continue
            lists = lists.filter(pa.array(fits))
            ids = column(batch, "vec_id").filter(pa.array(fits)).to_numpy()
            original = lists.flatten().to_numpy().reshape(-1, dim)
            raw = np.array([row.tobytes() for row in original.astype(np.float32)], object)
            unit = original.astype(np.float64)
            # by the largest component first: tiny vectors would lose their length to underflow
            unit /= np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            asks = np.flatnonzero(ids % queries_every == 0)
            for table in range(TABLES):
                place = (unit @ direction[:, table] + offset[table]) / WIDTH
                cell = np.floor(place)
                parts = [(bucket(cell, table), np.zeros(len(ids), np.int32), np.arange(len(ids)))]
                if len(asks):
                    share = (place - cell)[asks]
                    cost = np.concatenate([share**2, (1 - share) ** 2], axis=1) @ crossed
                    visit = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
                    cells = cell[asks][:, None, :] + moves[visit]
                    parts.append((bucket(cells, table).reshape(-1), np.ones(visit.size, np.int32), np.repeat(asks, visit.shape[1])))
                for where, kind, row in parts:
                    arrays = [pa.array(where), pa.array(np.full(len(row), table == 0)), pa.array(kind), pa.array(ids[row]), pa.array(raw[row], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "first", "probe", "id", "vec"])

    return vectors.mapInArrow(task, "bucket long, first boolean, probe int, id long, vec binary")


def in_chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds chunk: vectors of a large bucket are dealt over chunks, visits go to each of them."""
    large = keep(rows.filter("probe = 0").groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), "large-buckets")
    both = rows.join(large, "bucket", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    own = F.array(F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int"))
    return both.select("bucket", "probe", "id", "vec", F.explode(F.when(F.col("probe") == 0, own).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("chunk"))


def nearest_in_buckets(rows: DataFrame, dim: int, k: int = K) -> DataFrame:
    """query_id, vec_id, score: the k nearest vec_ids of each bucket for each visit."""

    def best(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        length, query_length = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
        score = np.round((queries / query_length[:, None]) @ (vectors / length[:, None]).T, 10)
        # vectors come by vec_id: a tiny step for each place puts the smaller vec_id first among equal scores
        score -= np.arange(len(vec_ids)) * 1e-15
        score[query_ids[:, None] == vec_ids[None, :]] = -9
        own = np.flatnonzero(np.r_[True, vec_ids[1:] != vec_ids[:-1]])
        if len(own) < len(vec_ids):
            # of the vectors of one vec_id the best stays, so that it takes one of the k places
            top = np.repeat(np.maximum.reduceat(score, own, axis=1), np.diff(np.r_[own, len(vec_ids)]), axis=1)
            score[score < top] = -9
        take = min(k, len(vec_ids))
        pick = np.argpartition(-score, take - 1, axis=1)[:, :take]
        who = np.repeat(np.arange(len(query_ids)), take)
        pick = pick.reshape(-1)
        other = score[who, pick] > -9
        who, pick = who[other], pick[other]
        exact = (queries[who] * vectors[pick]).sum(axis=1) / (query_length[who] * length[pick])
        return pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(vec_ids[pick]), pa.array(exact)], names=["query_id", "vec_id", "score"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors = None, np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            where = np.stack([column(batch, "bucket").to_numpy(), column(batch, "chunk").to_numpy()], axis=1)
            kind, row_ids = column(batch, "probe").to_numpy(), column(batch, "id").to_numpy()
            raw = np.frombuffer(b"".join(column(batch, "vec").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
            cut = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(kind)], strict=True):
                if here != tuple(where[a]):
                    here, ids, vectors = tuple(where[a]), np.zeros(0, np.int64), np.zeros((0, dim))
                asks = a + int(np.searchsorted(kind[a:b], 1))
                if asks > a:
                    ids, vectors = np.concatenate([ids, row_ids[a:asks]]), np.concatenate([vectors, raw[a:asks]])
                for i in range(asks, b, 256):
                    if len(ids):
                        yield best(ids, vectors, row_ids[i : min(i + 256, b)], raw[i : min(i + 256, b)])

    ordered = rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "probe", "id", "vec")
    return ordered.select("bucket", "chunk", "probe", "id", "vec").mapInArrow(task, "query_id long, vec_id long, score double")


def best_of_pairs(found: DataFrame) -> DataFrame:
    """query_id, vec_id and their best score."""
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, queries_every: int, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every vector whose vec_id is divisible by ``queries_every``."""
    spark = vectors.sparkSession
    good = usable(vectors)
    dim = good.agg(F.mode(F.size("embedding"), True)).first()[0] or 1
    # rows that repeat a vec_id and its embedding count once
    rows = keep(hashed(good.dropDuplicates(["vec_id", "embedding"]), queries_every, dim), "hashed-vectors")
    found = keep(best_of_pairs(nearest_in_buckets(in_chunks(rows), dim, k)), "candidates")
    queries = rows.filter("probe = 1").select(F.col("id").alias("query_id"), "vec").distinct()
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    short = keep(short.select(F.col("query_id").alias("id"), "vec"), "short-queries")
    if not short.isEmpty():
        first = rows.filter("probe = 0 and first")
        # the cells of one table, whose number doesn't grow with the rows
        cells = first.groupBy().agg(F.collect_set("bucket").alias("buckets")).first().buckets
        everywhere = short.select(F.explode(F.array(*[F.lit(c) for c in cells])).alias("bucket"), F.lit(True).alias("first"), F.lit(1).alias("probe"), "id", "vec")
        more = nearest_in_buckets(in_chunks(keep(first.unionByName(everywhere), "all-buckets")), dim, k)
        found = best_of_pairs(found.unionAll(more))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop(spark, rows, short)
    return out
