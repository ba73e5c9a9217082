"""Every operator against a plain version, on a fixture with the hard cases."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferryman.llm import ann, fingerprints, license_scan, minhash, mixing, queries, sentencepiece, substring_dedup, suffix_dedup, toxicity, url_rules
from ferryman.llm.components import components
from ferryman.llm.textblock import text_buffer

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, size string, score string, part int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "straße", "niño", "über", "a", "house,", "was", "▁x", "Red", "blue.\n", "42"]) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    passage, line = prose(rng, 70), prose(rng, 40)
    base = [prose(rng, rng.choice([3, 20, 90, 200])) for _ in range(30)]
    texts = list(base)
    texts += [base[i] for i in (3, 3, 3, 7, 8)]
    for i in (5, 6, 9, 10, 11, 12):
        w = base[i].split(" ")
        w[len(w) // 2 : len(w) // 2 + 1] = ["changed", "here"]
        texts.append(" ".join(w))
    texts += [prose(rng, 15) + " " + passage + " " + prose(rng, 15) for _ in range(4)]
    texts += [passage, line + "\n" + line + "\n" + line, None, "", " \t\n", "one", "two words", "  lead and trail  ", "x" * 700, "ab " * 400, "ab " * 400]
    texts += [prose(rng, 20_000), "Ünder the MIT License; under the mit license.", "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0"]
    rows = [(i, t, "en", ["a", "b", "é", None, "", "hot"][i % 6] if i % 3 else "hot", len(t or "")) for i, t in enumerate(texts)]
    return rows


ROWS = make_rows()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "s", "x", 9) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, and rows without doc_id."""
    return frame(spark, [*ROWS[:8], ROWS[0], ROWS[1], (None, ROWS[2][1], None, None, None), (None, None, None, None, None), (None, ROWS[20][1], None, "a", 3)])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# ---- 3 and 10

@pytest.mark.parametrize("window,seed", [(35, 8), (6, 3)])
def test_substring_dedup(docs, window, seed):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, window, seed).collect()}
    for (i, text, *_), (n, lost, kept) in zip(ROWS, brute.cut_words([r[1] for r in ROWS], window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, lost, brute.sha(" ".join(kept)))
        assert got[i].kept_text == (" ".join(kept) if lost else text or "")


@pytest.mark.parametrize("window,prefix", [(200, 48), (30, 10)])
def test_suffix_dedup(docs, window, prefix):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, window, prefix).collect()}
    for (i, *_), want in zip(ROWS, brute.cut_bytes([r[1] for r in ROWS], window)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_suffix_family_merges_equal_levels(spark):
    family = suffix_dedup.IndexFamily(spark)
    for i in range(6):
        family.add(spark.createDataFrame([(k,) for k in range(10 * i, 10 * i + 11)], "key long"))
        assert sorted(family.levels) == [b for b in range(3) if (i + 1) >> b & 1]
    assert {r.key for r in family.matched().collect()} == {10, 20, 30, 40, 50}


def test_repeats_of_odd_rows(odd, none):
    texts = [r.text for r in odd.collect()]
    want = sorted((a, b) for a, b, _ in brute.cut_words(texts, 35))
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect()) == want
    want = sorted(x[:3] for x in brute.cut_bytes(texts, 200))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(odd).collect()) == want
    assert substring_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == 0


# ---- 8

def test_near_duplicates(docs):
    want = brute.near_components([(r[0], r[1]) for r in ROWS])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    assert len(set(c for _, c in want.values())) < len(want)


def test_near_duplicates_reach_over_chains(spark):
    """Each document is near the next one only, so that components join links that no bucket's smallest member has."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(12):
        texts.append(" ".join(words))
        at = rng.randrange(5, 390)
        words[at : at + 8] = [f"x{i}_{k}" for k in range(8)]
    want = brute.near_components(list(enumerate(texts)))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_doc_id_on_different_texts(spark):
    """Each text of a doc_id has its own links, and the pipeline drops no text that is no near duplicate."""
    import corpus_pipeline

    words = lambda name: [f"{name}{i}" for i in range(100)]
    one, two, other, last = (" ".join(words(n)) for n in "abcd")
    near = lambda text: text + " more words"
    rows = [(1, near(one)), (2, near(two)), (5, one), (5, two), (5, other), (5, other), (7, last), (7, near(last)), (8, last), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0)).withColumn("rid", F.lit("clash")).repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 5), (5, 5), (7, 7), (7, 7), (8, 7), (9, 9), (9, 9)]
    assert sorted((r.doc_id, r.component_id) for r in got if r.kept and r.doc_id != 7) == [(1, 1), (2, 2), (5, 5), (5, 5), (9, 9), (9, 9)]
    assert sum(r.kept for r in got if r.doc_id == 7) == 1
    left = corpus_pipeline.drop_near_duplicates(spark, df, None).collect()
    assert {(r.doc_id, r.text) for r in left if r.doc_id != 7} == {(1, near(one)), (2, near(two)), (5, other), (9, None), (9, "")}
    assert sum(r.doc_id == 7 for r in left) == 1 and len(left) == 6


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 4

def check_mix(rows, got):
    sizes, taken, target = {}, {}, {}
    for (_, text, _, source, _), r in zip(rows, got):
        n = len(brute.words(text))
        assert r.size == n and 0 <= r.taken <= 3 * n
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    want = brute.targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 1


def test_mixing(docs):
    got = sorted(mixing.mix(docs).collect(), key=lambda r: r.doc_id)
    check_mix(ROWS, got)
    again = sorted(mixing.mix(docs.repartition(5)).collect(), key=lambda r: r.doc_id)
    assert got == again


def test_mixed_documents(docs):
    want = {r.doc_id: (r.taken, r.repeats) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, copies = {}, {}
    text = {r[0]: r[1] for r in ROWS}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text))
        copies[r.doc_id] = copies.get(r.doc_id, 0) + (r.text == text[r.doc_id])
        assert r.key == "k" and r.part == 9
    assert words == {i: t for i, (t, _) in want.items() if t}


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0


# ---- 1

VOCABULARY = sentencepiece.Vocabulary.read()


def test_encoding_is_the_best_segmentation(docs):
    small = [r for r in ROWS if len(r[1] or "") < 3000]
    got = {r.doc_id: list(r.ids) for r in sentencepiece.encode(docs, VOCABULARY).collect()}
    for i, text, *_ in small:
        assert got[i] == brute.encode(text, VOCABULARY), text


def test_decoding_gives_the_texts_back(docs, odd, none):
    for d in (docs, odd, none):
        back = sentencepiece.decode(sentencepiece.encode(d, VOCABULARY), VOCABULARY)
        key = lambda r: (r[0] is None, r[0], r[1])
        assert sorted(back.collect(), key=key) == sorted(((r.doc_id, r.text or "") for r in d.collect()), key=key)
    assert sentencepiece.encode_and_check(docs, VOCABULARY).filter("not exact").isEmpty()


def test_encoding_survives_a_small_cache():
    data, off = text_buffer(pa.array([r[1] for r in ROWS[:30]], pa.string()))
    large, small = sentencepiece.Encoder(VOCABULARY), sentencepiece.Encoder(VOCABULARY, cache_words=10)
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(large.encode(data, off), small.encode(data, off)))


# ---- 2

def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(brute.LOWER)
    fit = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules(spark):
    urls = ["http://a.com/x", "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://x.www.example.com/en/9", "http://example.com", "http://com/", "ftp://b.net/es/1", "b.net/es/1", None, "",
            "http://xexample.com/en/", "http://n.net/fr", "http://n.net/fr/?q=://c.com/", "://com/#", "http://evil.org/spam/7", "http://good.org/ham/8?x=1#f"]
    spam = [(100 + i, f"http://evil.org/spam/{i}.html") for i in range(60)] + [(200 + i, f"http://good.org/ham/{60 + i}") for i in range(60)]
    pages = spark.createDataFrame([*enumerate(urls), *spam, (100, spam[0][1])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    labels = spark.createDataFrame([*((i, 1, int(i < 57)) for i in range(60)), *((60 + i, 1, 0) for i in range(60)), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(urls) + 121
    by = {r.page_id: r for r in got}
    for i, url in [*enumerate(urls), *spam]:
        host, path, rule, verdict = plain_rule(url)
        mined = "block" if "evil.org/spam" in (url or "") else "allow"
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, rule, verdict or mined), url
    assert {r.verdict for r in url_rules.judge(pages, labels.limit(0)).filter("rule is null").collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_pages_are_labelled_by_their_path(spark):
    """Document 2 is clean and 1 is toxic: numbers of host, query and fragment name no document."""
    bad = [(100 + i, f"http://evil.org/spam/{10 + i}?page=2&ref=x") for i in range(40)]
    good = [(200 + i, f"http://good.org/ham/{60 + i}.html?page=1#1") for i in range(40)]
    none = [(300 + i, f"http://h1.org/home?page=1&n={i}") for i in range(40)]
    pages = spark.createDataFrame([*bad, *good, *none], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), *((10 + i, 1, 1) for i in range(40)), *((60 + i, 1, 0) for i in range(40))], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_rules.judge(pages, labels).collect()}
    assert got == {**{i: ("block", 1.0) for i, _ in bad}, **{i: ("allow", None) for i, _ in good + none}}


def test_mined_rules_are_matched_as_sets(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefgh", rng.randrange(1, 6))) for _ in range(80)]
    rules = [(i, sorted(rng.sample("abcdefgh", rng.randrange(1, 4))), rng.random()) for i in range(12)]
    got = url_rules.matches(spark.createDataFrame([(s,) for s in sets], "tokens array<string>").distinct(), spark.createDataFrame(rules, "rule_id long, tokens array<string>, confidence double"))
    want = {tuple(s): max(c for _, t, c in rules if set(t) <= set(s)) for s in sets if any(set(t) <= set(s) for _, t, _ in rules)}
    assert {tuple(r.tokens): r.confidence for r in got.collect()} == want


# ---- 5

def test_fingerprint_order_at_any_partition_count(spark, odd):
    """Rows and their followers do not depend on the number of buckets, nor does the size of the plan."""
    rows = [(i * 7 % 301 - 100, f"text {i} " + "x" * (i % 5)) for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, of = sorted(rows, key=lambda r: (-r[0], r[1])), {}  # 43 doc_ids, each on several texts
    old = spark.conf.get("spark.sql.shuffle.partitions")
    plans = []
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = fingerprints.compare_edited(df)
            of[n] = {(r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()}
            plans.append(len(got._jdf.queryExecution().toString()))
            assert fingerprints.compare_edited(odd).count() == odd.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    plain = {(i, len(t), brute.sha(fingerprints.edited(t, want[(k + 1) % len(want)][1]))) for k, (i, t) in enumerate(want)}
    assert of[1] == of[8] == of[200] == plain
    assert plans[2] - plans[1] < 100  # 8 and 200 partitions


def test_fingerprints_of_edited_texts(docs):
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    order = sorted(ROWS, key=lambda r: -r[0])
    assert len(got) == len(ROWS)
    sets = {}
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 2
        changed = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(changed))
        a, b, c = map(brute.shingle_set, (text, changed, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        for near, true, union in ((r.near_edited, like(a, b), a | b), (r.near_next, like(a, c), a | c)):
            assert abs(near - true) <= (1e-12 if len(union) <= fingerprints.K else 0.2)
        assert abs(r.n_distinct - len(a)) <= (0 if len(a) < fingerprints.K else 0.35 * len(a))
        sets.setdefault(text, set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in sets.values())


def test_fingerprints_merge():
    rng = random.Random(4)
    a, b = prose(rng, 600), prose(rng, 500)
    one, two = fingerprints.sketches([a, b])
    assert (fingerprints.decode(fingerprints.encode(one)) == one).all()
    both = np.sort(np.fromiter({int(x) for t in (a, b) for x in fingerprints.sketches([t], 10**6)[0]}, np.uint64))[: fingerprints.K]
    assert (fingerprints.merge(one, two) == both).all()
    assert fingerprints.containment(one, fingerprints.merge(one, two)) > 0.8


def test_fingerprints_of_odd_rows(odd, none):
    assert fingerprints.compare_edited(odd).count() == odd.count()
    assert fingerprints.compare_edited(none).count() == fingerprints.fingerprint(none).count() == 0
    assert fingerprints.compare_edited(odd.filter("doc_id = 3")).first().n_chars > 0


# ---- 6

def vectors(spark, n, extra=(), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>").withColumn("bucket", F.lit("clash"))


def plain_nearest(rows, every):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            found = sorted((-round(float((v * w).sum() / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in ok.items() if i != q)[:5]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_nearest_recall_and_ties(spark):
    same = [0.5] * 16
    extra = [(1000 + i, same) for i in range(12)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (None, same), (0, same)]
    df = vectors(spark, 400, extra)
    df = df.filter("not (vec_id = 0 and embedding[0] = 0.5)") .unionAll(df.filter("vec_id = 5"))
    want = plain_nearest({(r.vec_id, tuple(r.embedding) if r.embedding else None) for r in df.collect()}, 20)
    got = {}
    for r in ann.search(df, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        true = dict(want[q])
        hits += sum(i in true for _, i, _ in rows)
        assert all(abs(s - true[i]) < 1e-9 for _, i, s in rows if i in true)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for _, i, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]


def test_nearest_finds_all_of_a_few(spark):
    df = vectors(spark, 4)
    assert sorted((r.query_id, r.vec_id) for r in ann.search(df, 2).collect()) == [(q, v) for q in (0, 2) for v in range(4) if v != q]
    assert ann.search(df.limit(0), 2).count() == 0


def test_nearest_takes_all_embeddings_of_a_vec_id(spark):
    """Few vectors, so that every query sees all: 40 embeddings of 7 fill one place only, and 0 is searched by both of its own."""
    axis = lambda i, x=0.0: [1.0 if k == i else x if k == 15 else 0.0 for k in range(16)]
    rows = [(0, axis(0)), (0, axis(1)), (7, axis(5)), *((7, axis(0, 0.001 * i)) for i in range(40)), (1, axis(1, 0.2)), (2, axis(0, 0.3)), (3, axis(0, 0.4)), (4, axis(1, 0.5)), (5, axis(4))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, i + 1, v) for i, v in enumerate([7, 1, 2, 3, 4])]
    assert [round(r.score, 6) for r in got] == [1.0, *(round(1 / math.sqrt(1 + x * x), 6) for x in (0.2, 0.3, 0.4, 0.5))]


def test_nearest_splits_large_buckets(spark, monkeypatch):
    df = vectors(spark, 60, [(100 + i, [1.0] * 16) for i in range(300)])
    rows = ann.hashed(ann.usable(df), 20, 16)
    cut = ann.in_chunks(rows, chunk=50)
    assert cut.filter("probe = 0").groupBy("bucket", "chunk").count().agg(F.max("count")).first()[0] < 100
    got = ann.nearest_in_buckets(cut, 16).filter("query_id = 100").dropDuplicates(["vec_id"]).orderBy(F.desc("score"), "vec_id").limit(5).collect()
    assert [r.vec_id for r in got] == [101, 102, 103, 104, 105]


# ---- 7

def test_gradients_are_right():
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(6)]
    text = toxicity.Text(*text_buffer(pa.array(texts, pa.large_string())))
    model = toxicity.Model(np.sort(text.keys)[:20], np.linspace(-1, 1, 20).astype(np.float32))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    start, of = text.windows()
    start, of = start[::3], of[::3]
    y = np.arange(len(start)) % 2
    g = model.gradients(text, start, of, y)

    def loss():
        z = model.logits(text, start, of).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name, value in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]) * 10), name


def insulted(rng, n, bad):
    w = prose(rng, n).split(" ")
    for _ in range(3 if bad else 0):
        w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum!", "Moron"]) if bad == 1 else "unidiotly")
    return " ".join(w)


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = random.Random(8)
    rows = [(i, insulted(rng, rng.choice([5, 40, 200]), i % 3 == 0)) for i in range(500)]
    rows += [(900, None), (901, ""), (902, " .,! "), (903, prose(rng, 5000) + " you idiot scum moron " + prose(rng, 40)), (None, prose(rng, 20)), (904, prose(rng, 5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([*((i, 1, int(i % 3 == 0)) for i in range(500)), (3, 1, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i in range(500))
    assert sum(by[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert by[903].predicted == 1 and by[904].predicted == 0
    assert by[900].score == by[901].score == by[902].score == 0.0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.score == 0 for r in toxicity.score_documents(df, labels.limit(0)).collect())
    assert toxicity.score_documents(df.limit(0), labels).count() == 0


def test_toxicity_holds_out_on_real_rows(spark):
    d, labels = queries.table(spark, "/root/testdata/sf0.1", "documents"), queries.table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.score_documents(d, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("share")).collect()
    share = {r.toxic: r.share for r in out}
    assert share[1] >= 0.9 and share[0] <= 0.05


# ---- 9

def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))
    places, labels = [], set()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs):
    long = license_scan.TEMPLATES[0][1].split()
    texts = ["Under the MIT License under the mit  license", "under the mit-license", "CC-BY-NC cc by nc", "xunder the mit license", None, "", "a b", " ".join(long[:6] + ["oh", "dear"] + long[6:]), " ".join(long[:5]),
             "Apache License, Version 2.0 " * 40, "under the mit license"]
    df = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("at", F.lit(2))
    got = {r.doc_id: r for r in license_scan.scan(df.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))).collect()}
    assert len(got) == len(texts) + len(ROWS)
    for i, text in [(1000 + i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ROWS]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[1007].labels == "mit" and got[1007].n_base == 0 and got[1008].labels == ""
    assert license_scan.scan(df).count() == len(texts)


def test_license_scan_of_odd_rows(odd, none):
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(none).count() == 0


# ---- all queries, and the pipeline

@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    source = queries.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    source.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, SF, "labels").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "substring-dedup", "mixing", "encoding"]

    labels = queries.table(spark, SF, "labels")
    clean = {r.doc_id for r in toxicity.score_documents(source, labels).filter("predicted = 0").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in source.collect() if r.doc_id in clean)
    part = brute.near_components([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if part[r[0]][1] == r[0]]
    cut = brute.cut_words([t for _, t, _ in rows], 35)
    rows = [(i, " ".join(kept) if lost else t, s) for (i, t, s), (_, lost, kept) in zip(rows, cut)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    text, by_source, decoded = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}, sentencepiece.Decoder(VOCABULARY)
    taken = {}
    for r in got:
        ids = np.array(r.ids, np.int32)
        back = decoded.decode(ids, np.array([0, len(ids)]))[0].decode()
        assert r.exact and brute.sha(back) == r.decoded_sha256
        assert back == text[r.doc_id] or brute.words(text[r.doc_id])[: len(brute.words(back))] == brute.words(back)
        taken[by_source[r.doc_id]] = taken.get(by_source[r.doc_id], 0) + len(brute.words(back))
    for s, n in want.items():
        assert abs(taken.get(s, 0) - n) <= 1
