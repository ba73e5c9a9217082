"""Benchmark decontamination: prefix-filtered set join, DataFrame functions only.

Words are runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is ``window`` consecutive
words of an item, or all words of a shorter item. Both sides are sets of shingles of ``shingle`` words
(shorter windows: one shingle of their own length). As a document must hold all shingles of a window, one shingle of the window is a necessary prefix:
the rarest one in the documents (ties: smallest hash), and a window with a shingle that no document holds is dropped. The prefix
shingles are joined to the shingles of the documents; a match gives the place where the window would stand, which must lie inside the
document (positional and length bound). Each candidate is then checked word by word on the document's own words.

The join on shingles broadcasts the items' side only if its counted rows stay under ``BROADCAST_ROWS`` (8 to some 100 bytes each), else
both sides are shuffled and AQE splits a hot shingle. Candidates are gathered by document row, so their number is bounded by its words
times the windows that share a rarest shingle. Rows of documents go by two hashes of doc_id and text.

Defined cases: a null or empty text has no words, so 0 hits and the digest of an empty list; a text of any
length is read whole; rows equal in doc_id and text each give a row, with equal values; an item_id on several rows is one item with
the windows of all its rows; an item without item_id counts in n_hit, not in n_items; an empty benchmark hits nothing, empty
documents give an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryman.functions.text import let

from .tables import keep

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("h1", "h2")


def words_of(text: Column) -> Column:
    """The words of a text; cut at the runs between them, as the split is linear in long texts and match extraction is not."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _shingles(words: Column, size: Column) -> Column:
    """Hashes of all runs of ``size`` words, in order; the caller sees to it that there is one."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda at: F.xxhash64(F.slice(words, at, size)))


def _sized(df: DataFrame) -> DataFrame:
    """A written frame, for broadcasting if its rows are counted and few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (of the window), once each."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    return words.select("item_id", "words", at.alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("words")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """words, offset, gram of each distinct window."""
    size = F.least(F.size("words"), F.lit(shingle))
    return windows.select("words").distinct().select("words", F.posexplode(_shingles(F.col("words"), size)).alias("offset", "gram"))


def document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, h1, h2, n_words, place, gram: a row of place 0 for each document, then one for every shingle of one of the sizes, places from 1."""
    each = docs.select("doc_id", *KEY, words_of(F.col("text")).alias("words"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    each = each.withColumn("n_words", F.size("words").cast("long"))
    # the row of the document holds its own hash as gram, which spreads these rows over a join
    own = F.when(F.col("size") == sizes[0], F.col("h1"))
    some = F.when(F.col("n_words") >= F.col("size"), _shingles(F.col("words"), F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    rows = each.select("doc_id", *KEY, "n_words", F.posexplode(F.concat(F.array(own), some)).alias("place", "gram"))
    return rows if len(sizes) == 1 else rows.filter("gram is not null")


def prefixes(shingles: DataFrame, seen: DataFrame) -> DataFrame:
    """words, gram, offset: for each window whose shingles all occur, its rarest one."""
    counts = shingles.join(seen, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    rarest = counts.groupBy("words").agg(F.min(F.struct("seen", "gram", "offset")).alias("rare"))
    return rarest.filter("rare.seen > 0").select("words", "rare.gram", "rare.offset")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each document row with n_words, n_hit, n_items, item_ids (sorted as strings), spans (start, length, words of the hit windows)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(12), "doc_id", "text").alias("h2"))
    windows = keep(item_windows(items, window), "decontaminate-windows")
    shingles = keep(window_shingles(windows, shingle), "decontaminate-shingles")
    sizes = shingles.select(F.least(F.size("words"), F.lit(shingle)).alias("size")).distinct().collect()  # at most ``shingle`` values
    sizes = sorted(r.size for r in sizes) or [shingle]

    grams = keep(shingles.select(F.col("gram").alias("known")).distinct(), "decontaminate-grams")
    rows = document_shingles(keyed, sizes).join(_sized(grams), F.col("gram") == F.col("known"), "left")
    rows = keep(rows.filter("place = 0 or known is not null").drop("known"), "decontaminate-places")
    places = rows.filter("place > 0")
    prefix = keep(prefixes(shingles, places.groupBy("gram").agg(F.count("*").alias("seen"))), "decontaminate-prefixes")
    at = F.col("place") - 1 - F.col("offset")
    fits = (at >= 0) & (at + F.size("words") <= F.col("n_words"))
    candidates = places.join(_sized(prefix), "gram").filter(fits).select(*KEY, F.struct(at.alias("start"), F.size("words").alias("length"), "words").alias("span"))
    gathered = keep(candidates.groupBy(*KEY).agg(F.collect_set("span").alias("spans")), "decontaminate-candidates")

    # only texts with candidates are read again, and cut into words
    texts = keyed.join(_sized(gathered.select(*KEY)), list(KEY), "left_semi").join(gathered, list(KEY))
    standing = let(words_of(F.col("text")), lambda words: F.filter("spans", lambda s: F.slice(words, s["start"] + 1, s["length"]) == s["words"]))
    checked = texts.select(*KEY, F.array_sort(standing).alias("spans"))
    # spans come by their start: each adds what lies behind the farthest end so far
    end = lambda s: s["start"] + s["length"]
    step = lambda acc, s: F.struct(F.greatest(acc["end"], end(s)).alias("end"), (acc["hit"] + F.greatest(F.lit(0), end(s) - F.greatest(acc["end"], s["start"]))).alias("hit"))
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), step)["hit"].cast("long")
    checked = keep(checked.withColumn("n_hit", hit).dropDuplicates(KEY), "decontaminate-checked").filter("n_hit > 0")

    hits = checked.select(*KEY, F.explode(F.array_distinct(F.transform("spans", lambda s: s["words"]))).alias("words"))
    found = hits.join(_sized(windows), "words").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = checked.join(found, list(KEY), "left")
    out = rows.filter("place = 0").select("doc_id", *KEY, "n_words").join(found, list(KEY), "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array()).alias("spans"))
    return out.withColumn("n_items", F.size("item_ids").cast("long"))
