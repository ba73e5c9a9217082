"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; with fewer words, the whole sequence as one). Two documents are linked
if 100 * intersection >= 75 * union; components are by smallest doc_id reachable. The nodes are
row ids, hashes of doc_id and text, so a doc_id that stands on different texts is a document for each.

1. Signatures: ``BANDS * ROWS`` minima under universal hash functions a*x + b.
2. Documents with equal sets are one class, held by its smallest row id; only these go on.
3. Banding: classes that agree on all rows of a band share a bucket. At a resemblance of 0.75
   a pair misses all 40 bands with a chance of 2.5e-7.
4. Stars: each class in a bucket is compared with the bucket's smallest. Components of these
   links come first. Then each member outside the component most common in a bucket is compared with one
   member of that one, another in each bucket, for up to ``TURNS`` rounds, so that the components of a large family of
   edited copies grow together. Members of buckets that still hold different components are paired
   by an exact prefix filter on their rarest shingles. So a bucket of thousands of near copies
   costs one comparison each, documents that share a frequent passage only make no pairs, and no
   link between different components is left out.
5. A pair is compared by set sizes, then by signature, then by the full sets.

Defined cases: null or wordless texts have an empty set and are linked with nothing; a null
doc_id is linked with nothing (component null, kept); rows equal in doc_id and text are one node
and are kept or not together; of rows of one component with the smallest doc_id but different texts
the one with the smallest row id is kept; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import drop, keep
from .textblock import U64, Words, blocks, column, lowered, mix, shingles

SHINGLE = 5
BANDS, ROWS = 40, 4
PERCENT = 75
#: a pair is dropped by its signature only if the share of equal minima is this far below the limit (5.8 standard deviations)
SLACK = 0.2
#: rounds of comparing what is left of a bucket with further members of its most common part; what they leave open is decided exactly
TURNS = 3
SET_BITS = U64(52)


def sets_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle hashes of all texts of a block, in order within each text, and where each set starts."""
    grams, text = shingles(Words(lowered(data), off), SHINGLE)
    keys = (text.astype(U64) << SET_BITS) | (grams >> U64(12))
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    text = (keys >> SET_BITS).astype(np.int64)
    return keys & U64((1 << 52) - 1), np.searchsorted(text, np.arange(len(off)))


def row_id():
    """The row id, from doc_id and text."""
    return F.xxhash64("doc_id", "text").alias("rid")


def signatures(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, fp1, fp2 (fingerprint of the set), bands, sig."""
    rng = np.random.default_rng(8)
    mult = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
    plus = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            values, at = sets_of(data, off)
            size = np.diff(at)
            full = np.flatnonzero(size)
            sig = np.zeros((len(size), BANDS * ROWS), np.uint32)
            fp = np.zeros((2, len(size)), U64)
            if len(full):
                begin = at[:-1][full]
                x = values >> U64(20)
                for i in range(BANDS * ROWS):
                    sig[full, i] = np.minimum.reduceat(x * mult[i] + plus[i], begin) >> U64(32)
                for i in (0, 1):
                    fp[i, full] = np.add.reduceat(mix(values, 20 + i), begin)
            wide = sig.astype(U64).reshape(len(size), BANDS, ROWS)
            band = np.zeros((len(size), BANDS), U64)
            for i in range(ROWS):
                band = mix(band ^ wide[:, :, i], 30 + i)
            band = mix(band + np.arange(BANDS, dtype=U64), 40)
            flat = pa.array(band.reshape(-1).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), flat)
            rows = pa.array([s.tobytes() for s in sig], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rid"), column(batch, "doc_id"), pa.array(size.astype(np.int64)), *(pa.array(f.view(np.int64)) for f in fp), bands, rows],
                names=["rid", "doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"],
            )

    return docs.select("rid", "doc_id", "text").mapInArrow(task, "rid long, doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary")


def _promising(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures allow a link."""
    one = sigs.select(F.col("rid").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("rid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            near = (left == right).mean(axis=1) >= PERCENT / 100 - SLACK
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(pa.array(near)), column(batch, "b").filter(pa.array(near))], names=["a", "b"])

    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the limit."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, data, off in blocks(iter([batch]), "ta"):
                va, aa = sets_of(data, off)
                right = [x for x in blocks(iter([left]), "tb")]
                row = 0
                good = np.zeros(left.num_rows, bool)
                for part, data2, off2 in right:
                    vb, ab = sets_of(data2, off2)
                    for i in range(part.num_rows):
                        x, y = va[aa[row] : aa[row + 1]], vb[ab[i] : ab[i + 1]]
                        both = np.concatenate([x, y])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        good[row] = 100 * common >= PERCENT * (len(both) - common)
                        row += 1
                keep_rows = pa.array(good)
                yield pa.RecordBatch.from_arrays([column(left, "a").filter(keep_rows), column(left, "b").filter(keep_rows)], names=["a", "b"])

    one = texts.select(F.col("rid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _sharing_rare(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that can reach the limit, by an exact prefix filter.

    With each set in one order of all shingles, rare ones first, two sets that reach the limit
    share one of their first n - ceil(n * PERCENT / 100) + 1 shingles, and from the first one
    that they share, both have enough left for the intersection that the limit asks for. A passage in thousands of documents
    comes last in the order, so documents that have only that in common make no pair.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            values, at = sets_of(data, off)
            size = np.diff(at)
            rows = [np.repeat(column(batch, c).to_numpy(), size) for c in ("doc_id", "part")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.repeat(size, size)), pa.array(values.view(np.int64))], names=["node", "part", "n", "gram"])

    held = texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "part", "text")
    grams = keep(held.mapInArrow(task, "node long, part long, n long, gram long"), "open-shingles")
    # a shingle that only one part holds is in no link between parts: these come first in the order, then the rest by frequency
    several = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    several = keep(several.select("gram", "df"), "shared-shingles")
    own = Window.partitionBy("node")
    shared = grams.join(several, "gram").withColumn("alone", F.col("n") - F.count("*").over(own)).withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("df", "gram")))
    prefix = keep(shared.filter(F.col("place") <= F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1")).select("gram", "node", "part", "n", "place"), "prefixes")
    # each pair has a member outside the part that holds a shingle most often: rows are never paired within that part
    most = prefix.groupBy("gram", "part").agg(F.count("*").alias("rows")).groupBy("gram").agg(F.max(F.struct("rows", "part")).alias("m"), F.count("*").alias("parts"))
    placed = keep(prefix.join(most.filter("parts > 1").select("gram", F.col("m.part").alias("home")), "gram"), "placed-prefixes")
    one = placed.select("gram", "home", F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("place").alias("ia"))
    two = placed.filter("part <> home").select("gram", F.col("node").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("place").alias("ib"))
    near = (F.col("pa") != F.col("pb")) & ((F.col("pa") == F.col("home")) | (F.col("a") < F.col("b"))) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    # from the first common shingle on, enough must be left in both sets for the limit
    near = near & ((100 + PERCENT) * (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))) >= PERCENT * (F.col("na") + F.col("nb")))
    pairs = keep(one.join(two, "gram").filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "open-pairs")
    drop(nodes.sparkSession, grams, several, prefix, placed)
    return pairs


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """bucket, node, part: the members of the buckets with the component found so far."""
    return members.select("bucket", "node").join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))


def _hub_pairs(labelled: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each member of a bucket outside the part most common there, and one member of that part, another in each bucket and turn."""
    drawn = labelled.groupBy("bucket", "part").agg(F.count("*").alias("rows"), F.min_by("node", F.xxhash64("node", "bucket", F.lit(turn))).alias("hub"))
    home = drawn.groupBy("bucket").agg(F.max(F.struct("rows", "part", "hub")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    far = labelled.join(home.select("bucket", F.col("m.part").alias("home"), F.col("m.hub").alias("hub")), "bucket").filter("part <> home")
    return far.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links between nodes: components of the parts, then of their nodes."""
    ends = [links.join(label.select(F.col("node").alias(c), F.col("component").alias(f"p{c}")), c, "left").select("a", "b", F.coalesce(f"p{c}", c).alias(f"p{c}")) for c in ("a", "b")]
    edges = ends[0].join(ends[1], ["a", "b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    of_part = components(edges).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    # nodes that were in no link so far are parts of their own
    nodes = label.unionAll(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(of_part, nodes["component"] == of_part["part"], "left").select("node", F.coalesce("whole", "component").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    docs = docs.select(row_id(), "doc_id", "text")
    sigs = keep(signatures(docs), "signatures")
    classes = keep(sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("rid").alias("rep"), F.min(F.struct("doc_id", "rid")).alias("first")), "set-classes")
    # one row for each class, also where a whole row stands several times
    held = keep(sigs.join(classes.withColumnRenamed("rep", "rid"), ["fp1", "fp2", "n_shingles", "rid"], "left_semi").dropDuplicates(["rid"]), "class-rows")

    banded = held.select(F.col("rid").alias("node"), F.explode("bands").alias("bucket"))
    buckets = keep(banded.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("most")).filter("head <> most").select("bucket", "head"), "buckets")
    members = keep(banded.join(buckets, "bucket").distinct(), "bucket-members")
    stars = keep(members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    near = keep(_promising(stars, held), "near-stars")

    ids = members.select(F.col("node").alias("rid")).distinct()
    texts = keep(docs.join(ids, "rid", "left_semi").dropDuplicates(["rid"]), "candidate-texts")
    links = keep(_linked(near, texts), "star-links")
    label = keep(components(links), "star-components")

    asked, star_label = stars, label
    for turn in range(TURNS):
        labelled = keep(_labelled(members, label), "labelled")
        pairs = keep(_hub_pairs(labelled, turn).join(asked, ["a", "b"], "left_anti"), "hub-pairs")
        found = keep(_linked(keep(_promising(pairs, held), "near-hubs"), texts), "hub-links")
        done = found.isEmpty()
        if not done:
            label = keep(_joined(label, found), "joined-parts")
        so_far, asked = asked, keep(asked.unionAll(pairs), "asked-pairs")
        drop(spark, so_far, labelled, pairs, found)
        if done:
            break

    labelled = keep(_labelled(members, label), "labelled")
    mixed = keep(labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket"), "mixed-buckets")
    left = keep(labelled.join(mixed, "bucket", "left_semi").select("node", "part").distinct(), "open-nodes")
    rest = _sharing_rare(left, texts.select(F.col("rid").alias("doc_id"), "text")).join(asked, ["a", "b"], "left_anti")
    more = keep(_linked(keep(_promising(rest, held), "near-rest"), texts), "rest-links")
    final = keep(_joined(label, more), "components")

    of_class = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_class = keep(of_class.select("fp1", "fp2", "n_shingles", "first", "component"), "class-components")
    # back from row ids: each component is named by its smallest doc_id
    firsts = keep(of_class.groupBy("component").agg(F.min("first").alias("least")), "component-firsts")
    named = keep(of_class.join(firsts, "component").select("fp1", "fp2", "n_shingles", "least"), "named-classes")
    out = sigs.select("rid", "doc_id", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | F.col("least").isNull()
    out = out.select("rid", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id"), (alone | (F.col("least.rid") == F.col("rid"))).alias("kept"))
    out = keep(out, "near-duplicates")
    drop(spark, sigs, classes, held, buckets, members, near, texts, links, star_label, label, asked, labelled, mixed, left, more, final, of_class, firsts, named)
    return out
