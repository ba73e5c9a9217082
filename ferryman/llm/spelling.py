"""Spelling variant grouping by finite-state composition.

The vocabulary is composed with a one-edit transducer and with itself again: two words are near if a path spells one on the first
acceptor, one replaced or inserted code point on the transducer, and the other word on the second acceptor. The composition is split over tasks by
its initial state. A pair belongs to a class, the length m of its shorter word, and to one range lo <= c < hi of its common prefix length c. Words
of a class that share their first lo and last m - hi code points start in one state; only their cores, what lies between, are spelled. Two ranges cover a class:
edits in the first half (words meet by their last half), and edits in the second (words meet by their first half). So a pair is found once, in one
partition. A partition of more than ``LIMIT`` words has its range halved, again and again: at a range of one place a group holds at
most the words that differ in one or two given code points, which the alphabet bounds.

In a task a partition's cores become minimised acceptors, one of words of length m and one of length m + 1 (states with equal right
languages are one; a state with a single word left is that word). Pairs are enumerated depth first along the paths that both words share; after
the edit the common right language of two states is computed once for each pair of states.

The vocabulary is extracted, corrupted as told and counted in the JVM; texts are cut by a linear split. Forms point to
words of at least ``RATIO`` times the count, so a chain of forms has at most log(max n / LEAST) / log(RATIO) steps, and
roots follow by doubling pointers in the logarithm of that.

Defined cases: a null or empty text has no words, a null doc_id stands as an empty text in the hash; rows equal in doc_id and text are counted each;
words of any length are whole; ties between forms go to the smallest word in code-point order; no words: an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, keep

LETTERS = 6
LEAST = 5
RATIO = 5
#: words that a partition of the composition holds at most, unless the alphabet bounds it
LIMIT = 50_000
#: of every so many occurrences (by hash) one loses a code point
LOSS = 199
#: pairs that a task hands over at once
BATCH = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("m", "lo", "hi", "prefix", "suffix")


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, loss: int = LOSS) -> DataFrame:
    """word and n of the words of at least ``letters`` code points and ``least`` occurrences."""
    text = F.translate("text", _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.split(text, "[^a-zÀ-ÿ]+")).alias("run"))
    runs = runs.filter(F.length("run") >= letters)
    hashed = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select("run", hashed.alias("h")).select(F.when(F.pmod(F.col("h"), F.lit(loss)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# ---- acceptors: a state is a dict from symbols to states, or, where one word is left, that word's rest

def acceptor(words: list[str], register: dict, depth: int = 0):
    """The minimised acceptor of sorted, distinct words of one length; None if there is none."""
    if not words:
        return None
    if len(words) == 1:
        return words[0][depth:]
    state = {c: acceptor(list(part), register, depth + 1) for c, part in groupby(words, lambda w: w[depth])}
    return register.setdefault(tuple((c, s if isinstance(s, str) else id(s)) for c, s in state.items()), state)


def step(state, symbol: str):
    """Where the symbol leads; None if nowhere."""
    if isinstance(state, str):
        return state[1:] if state[:1] == symbol else None
    return state.get(symbol)


def accepts(state, rest: str) -> bool:
    for i, c in enumerate(rest):
        if isinstance(state, str):
            return state == rest[i:]
        state = state.get(c)
        if state is None:
            return False
    return state == ""


def common(a, b, known: dict) -> tuple[str, ...]:
    """The words that both states accept."""
    if isinstance(a, str):
        return (a,) if (a == b if isinstance(b, str) else accepts(b, a)) else ()
    if isinstance(b, str):
        return (b,) if accepts(a, b) else ()
    key = (id(a), id(b))
    if key not in known:
        known[key] = tuple(c + rest for c in a if c in b for rest in common(a[c], b[c], known))
    return known[key]


def replaced(a, places: int, known: dict) -> Iterator[tuple[str, str]]:
    """Pairs of words of the acceptor that differ in one of the first ``places`` symbols."""
    stack = [(a, "")]
    while stack:
        state, path = stack.pop()
        if not isinstance(state, dict) or len(path) >= places:
            continue
        symbols = list(state)
        for i, x in enumerate(symbols):
            for y in symbols[i + 1 :]:
                for rest in common(state[x], state[y], known):
                    yield path + x + rest, path + y + rest
            stack.append((state[x], path + x))


def inserted(a, b, places: int, known: dict) -> Iterator[tuple[str, str]]:
    """Pairs of a word of a and a word of b that has one more symbol behind fewer than ``places`` common ones."""
    stack = [(a, b, "")]
    while stack:
        short, long, path = stack.pop()
        if short is None or long is None or len(path) >= places:
            continue
        if isinstance(short, str) and isinstance(long, str):
            same = next((i for i, c in enumerate(short) if c != long[i]), len(short))
            if len(path) + same < places and short[same:] == long[same + 1 :]:
                yield path + short, path + long
            continue
        for x in (long[:1] if isinstance(long, str) else long):
            for rest in common(short, step(long, x), known):
                if rest[:1] != x:  # the edit stands behind the whole common prefix, so that a pair comes once
                    yield path + rest, path + x + rest
        for x in (short[:1] if isinstance(short, str) else short):
            stack.append((step(short, x), step(long, x), path + x))


def near_pairs(cores: list[str], length: int, places: int) -> Iterator[tuple[str, str]]:
    """Pairs of sorted distinct cores, the shorter of ``length`` code points, the edit at one of the first ``places``."""
    register, known = {}, {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * length + 2_000))
    a = acceptor([w for w in cores if len(w) == length], register)
    b = acceptor([w for w in cores if len(w) == length + 1], register)
    if a is not None:
        yield from replaced(a, places, known)
        if b is not None:
            yield from inserted(a, b, places, known)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the partitions of one task, whose rows come by key; both directions."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple[str, str, int]] = []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    for (m, lo, hi, prefix, suffix), part in groupby(rows, lambda r: r[:5]):
        counts = {r[5]: r[6] for r in part}
        if len(counts) < 2:
            continue
        for u, v in near_pairs(sorted(counts), m - len(prefix) - len(suffix), hi - lo):
            out.append((prefix + u + suffix, prefix + v + suffix, counts[v]))
            out.append((prefix + v + suffix, prefix + u + suffix, counts[u]))
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def _placed(words: DataFrame) -> DataFrame:
    """Adds prefix, suffix and core of each word for its class and range."""
    behind = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    length = F.length("word")
    return words.select(
        "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("prefix"), F.substring("word", length - behind + 1, behind).alias("suffix"),
        F.substring("word", F.col("lo") + 1, length - behind - F.col("lo")).alias("core"), "word", "n",
    )


def partitions(vocab: DataFrame, letters: int = LETTERS, limit: int = LIMIT) -> DataFrame:
    """m, lo, hi, prefix, suffix, core, n: each word in the partitions of its classes and ranges."""
    classes = vocab.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m")).filter(F.col("m") >= letters)
    half = F.floor(F.col("m") / 2).cast("int")
    ranges = F.inline(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi"))))
    rows = _placed(classes.select("word", "n", "m", ranges))
    done = None
    while True:
        # at most (rows / limit) partitions are large
        large = keep(rows.groupBy(*KEY).agg(F.count("*").alias("size")).filter(F.col("size") > limit).filter("hi - lo > 1").drop("size"), "spelling-large")
        if large.isEmpty():
            drop(vocab.sparkSession, large)
            break
        small = rows.join(large, list(KEY), "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.inline(F.array(F.struct(F.col("lo").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("hi").alias("high"))))
        rows = rows.join(large, list(KEY), "left_semi").select("word", "n", "m", halves).withColumnsRenamed({"low": "lo", "high": "hi"})
        rows = keep(_placed(rows), "spelling-halved")
    return (rows if done is None else done.unionByName(rows)).drop("word")


def near_words(vocab: DataFrame, letters: int = LETTERS, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n: every pair of near words, in both directions."""
    rows = partitions(vocab, letters, limit).select(*KEY, "core", "n")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_tasks, "word string, near string, near_n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: the end of each word's chain of forms, of at most ``steps`` steps."""
    spark = forms.sparkSession
    at = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max(math.ceil(math.log2(max(steps, 1))), 0)):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = keep(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        drop(spark, at)
        at = ahead
    return at


def group_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, ratio: int = RATIO, limit: int = LIMIT, loss: int = LOSS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = keep(vocabulary(docs, letters, least, loss), "spelling-vocabulary")
    pairs = near_words(vocab, letters, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    most = -F.col("best.n")
    found = vocab.join(pairs, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(most >= ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(most >= ratio * F.col("n"), most).alias("form_n"),
    )
    found = keep(found, "spelling-forms")
    top = found.agg(F.max("form_n")).first()[0]
    steps = math.floor(math.log(top / least, ratio) + 1e-9) if top else 0
    ends = roots(found.filter("form is not null").select("word", "form"), steps)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
