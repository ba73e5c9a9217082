"""Spelling variants, decontamination and whitening against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ferryman.llm import decontamination, queries, spelling, whitening
from ferryman.plans.check import compare

from . import brute

SF = "/root/testdata/sf0.001"


# ---- 11

def plain_words(rows, letters, least, loss):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % loss == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= letters
    return {w: n for w, n in count.items() if n >= least}


def is_near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain_variants(vocab, ratio=5):
    near = {w: [v for v in vocab if is_near(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * n else None
    out = {}
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocab.get(form[w]))
    return out


def spelled_rows():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 7, 9, 14]))) for _ in range(40)]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([1, 5, 30, 200])
        for _ in range(3):
            at, c = rng.randrange(len(stem) + 1), rng.choice("abcé")
            v = rng.choice([stem[:at] + c + stem[at:], stem[:at] + c + stem[at + 1 :], stem[:at] + stem[at + 1 :]])
            words += [v] * rng.choice([1, 5, 6, 40])
    words += ["aaaaaa"] * 900 + ["aaaaaaa"] * 150 + ["aaaaaaaa"] * 25 + ["aaaaaaab"] * 5 + ["x" * 900] * 6 + ["x" * 901] * 31 + ["Zoölogy"] * 6 + ["short"] * 50 + ["ñandúes"] * 7 + ["ñandues"] * 50 + ["Ñandues"] * 9
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "\n", "1", "_"]).join(words[i * 60 : i * 60 + 60])) for i in range(len(words) // 60 + 1)]
    return rows + [(None, rows[0][1]), (None, None), (3, ""), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("limit,loss", [(50_000, 199), (3, 7)])
def test_spelling_variants(spark, limit, loss):
    rows = spelled_rows()
    vocab = plain_words(rows, 6, 5, loss)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs, limit=limit, loss=loss).collect()}
    want = plain_variants(vocab)
    assert got == want
    assert any(r[1] not in (w, r[0]) for w, r in want.items())  # a chain of forms


def test_spelling_variants_on_real_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocab = plain_words([(r.doc_id, r.text) for r in docs.collect()], 6, 5, 199)
    near = Counter()
    whole = set(vocab)
    for w in whole:
        for at in range(len(w)):  # deletions find each pair through the shorter word or the hole they share
            near[w, at] = 0
    holes = {}
    for w in whole:
        for at in range(len(w)):
            holes.setdefault((at, w[:at] + w[at + 1 :]), set()).add(w)
    want = {w: {v for at in range(len(w)) for v in holes[at, w[:at] + w[at + 1 :]]} - {w} for w in whole}
    for w in whole:
        for at in range(len(w)):
            if (s := w[:at] + w[at + 1 :]) in whole:
                want[w].add(s)
                want[s].add(w)
    got = queries.op11_spelling_variants(spark, SF).collect()
    assert {r.word: (r.n, r.n_near) for r in got} == {w: (vocab[w], len(want[w])) for w in whole}
    for r in got:
        best = min(want[r.word], key=lambda v: (-vocab[v], v), default=None)
        assert r.form == (best if best and vocab[best] >= 5 * r.n else None)


def test_acceptors_are_minimal_and_pairs_come_once():
    words = sorted({a + b for a in ("ab", "ac", "xb", "xc") for b in ("on", "in", "en")})
    register = {}
    start = spelling.acceptor(words, register)
    assert start["a"] is start["x"] and len(register) == 3  # start, first letter, second letter
    pairs = list(spelling.near_pairs(sorted({*words, "aabon", "abon", "abbon", "abonn"}), 4, 5))
    assert len(pairs) == len(set(pairs))
    every = sorted({*words, "aabon", "abon", "abbon", "abonn"})
    assert {tuple(sorted(p)) for p in pairs} == {(u, v) for u in every for v in every if u < v and is_near(u, v) and min(len(u), len(v)) == 4}


def test_spelling_variants_of_no_words(spark):
    schema = "doc_id long, text string"
    assert spelling.group_variants(spark.createDataFrame([], schema)).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "too few"), (2, None)], schema)).count() == 0


# ---- 12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(docs, items, window=10):
    split = lambda t: WORD.findall((t or "").translate(brute.LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(g) for g in windows}:
            for at in range(len(w) - size + 1):
                if (g := tuple(w[at : at + size])) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[g]
        found = sorted(str(i) for i in found if i is not None)
        out.append((-1 if doc is None else doc, len(w), len(hit), len(found), brute.sha(",".join(found)), bool(hit)))
    return sorted(out)


def leaked_rows():
    rng = random.Random(8)
    say = lambda n: [rng.choice(["the", "of", "and", "Straße", "niño", "a", "house", "was", "Red", "blue", "42", "ÜBER"]) for _ in range(n)]
    texts = [say(n) for n in (40, 25, 10, 11, 9, 4, 1, 14)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items += [(20, items[1][1].upper()), (20, "and another text of the very same item id, of some length"), (None, items[2][1]), (21, None), (22, " .. "), (23, items[0][1]), (100, items[3][1])]
    docs = []
    for i in range(60):
        t = texts[rng.randrange(len(texts))]
        a = rng.randrange(len(t))
        b = min(len(t), a + rng.choice([4, 9, 10, 11, 30]))
        docs.append((i, rng.choice([" ", ", ", ".\n"]).join(say(rng.choice([0, 3, 30, 200])) + t[a:b] + say(rng.choice([0, 8])) + t[:10])))
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[0][1]), (103, items[0][1]), (None, items[0][1]), (None, "nothing here"), (104, " ".join(say(60_000)))]
    return docs, items


def hits_of(out):
    rows = out.collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r.item_ids)), r.n_hit > 0) for r in rows)


def test_decontamination(spark, monkeypatch):
    docs, items = leaked_rows()
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, words string, size int, h1 long").repartition(4)
    i = spark.createDataFrame([(*r, "y", 3) for r in items], "item_id long, text string, gram string, seen long")
    want = plain_hits(docs, items)
    assert hits_of(decontamination.scan(d, i)) == want
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert hits_of(decontamination.scan(d, i)) == want
    spans = {r.doc_id: r.spans for r in decontamination.scan(d, i).collect()}
    assert all(len(s.words) == s.length for s in spans[103])


def test_decontamination_of_empty_tables(spark):
    docs, items = leaked_rows()
    d, i = "doc_id long, text string", "item_id long, text string"
    assert decontamination.scan(spark.createDataFrame([], d), spark.createDataFrame(items, i)).count() == 0
    for few in ([], [(1, None), (2, "...")]):
        assert hits_of(decontamination.scan(spark.createDataFrame(docs, d), spark.createDataFrame(few, i))) == plain_hits(docs, few)


def test_decontamination_runs_no_python(spark):
    plan = queries.op12_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = "op12_decontamination"
    assert compare(spark, key, queries.QUERIES[key], queries.ORACLES[key], SF, con)["status"] == "ok"


# ---- 13

def plain_whitening(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    z = apart / n
    v = z.T @ z / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return (apart**2).sum(axis=1), z @ axes / np.sqrt(values), values / np.trace(v)


def check_whitening(rows, keep, components=8):
    """rows of the result, by vec_id, against the plain version; signs are free."""
    dev, white, explained = plain_whitening([v for _, v in keep], components)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(keep) * white.shape[1]
    for c in range(white.shape[1]):
        mine = np.array([got[i, c + 1].whitened for i, _ in keep])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine * sign - white[:, c]).max() < 1e-7
    for k, (i, _) in enumerate(keep):
        r = got[i, 1]
        assert (r.n, r.deviation) == (len(keep), dev[k])
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in rows)
    assert len({r.identity_error for r in rows}) == 1


def test_whitening_on_real_rows(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    keep = [(r.vec_id, r.embedding) for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check_whitening(queries.op13_whitening(spark, SF).collect(), keep)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((60, 5)) * [5, 3, 2, 1, 0.3] + 40).astype(np.float32).tolist()
    vectors[7] = vectors[8]
    vectors[9] = [0.0] * 5
    vectors[10] = [-1e3, 2e3, 1e2, -3.0, 0.0]  # eigh itself loses the small eigenvalues beyond that
    keep = list(enumerate(vectors))
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan")] * 5), (904, [float("inf")] + [0.0] * 4), (905, [1.0] * 4), (906, [3e38] * 5)]
    schema = "vec_id long, embedding array<float>, part string, at int, dim int"
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in keep + odd], schema).repartition(3)
    check_whitening(whitening.whiten(frame).collect(), keep)
    again = spark.createDataFrame([(None, v, "x", 1, 2) for _, v in keep[:20]] + [(1, v, "x", 1, 2) for _, v in keep[:20]], schema)
    assert whitening.whiten(again, components=2).filter("vec_id is null").count() == 40


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)]  # rank one
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)


def test_exact_deviations_leave_longs():
    x = np.array([[2**45, 1], [1, 1]], np.int64)
    n, sums = 2**20, [2**45, 2]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(whitening.centred(x, n, sums)) == [t if t < 2**63 else None for t in want]


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for rank in (1, 3, 12):
        m = rng.standard_normal((12, rank)) * 10.0 ** -np.arange(rank)
        v = m @ m.T
        factor = whitening.pivoted_cholesky(v)
        assert np.abs(factor @ factor.T - v).max() < 1e-12 * np.trace(v)
        values, axes = whitening.one_sided_jacobi(factor)
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
        assert np.abs((axes * values) @ axes.T - v).max() < 1e-12 * np.trace(v)


# ---- rows of the pipeline keep their own columns

def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["score", "score_text", "_", "doc", "carried", "kept", "rid", "size", "taken", "slice", "target", "label", "turn"]
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words + f" {i} " + " ".join(f"x{i}_{k}" for k in range(40)), "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, None, None, None, None, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = {(r.doc_id, tuple(r[n] for n in names)) for r in out.collect()}
        assert got and got <= {(r[0], tuple(r[5:])) for r in rows}, name


def test_toxicity_scores_every_overlapping_window(monkeypatch):
    """The sliding form against a plain forward pass over each window, word by word, also across chunks of words."""
    from ferryman.llm import toxicity
    from ferryman.llm.textblock import text_buffer

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["no", "yes", "Idiot", "niño", "x9"]) + rng.choice("abc") for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 50, 90)]
    text = toxicity.Text(*text_buffer(pa.array(texts, pa.large_string())))
    model = toxicity.Model(np.sort(text.keys)[::2], np.linspace(-1, 1, len(text.keys[::2])).astype(np.float32))
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = model.inputs(text, text.form).astype(np.float64)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def one_way(words, side):
        state, states, h = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for v in words:
            a, u = v @ p[f"x{side}"] + p[f"b{side}"], state @ p[f"h{side}"]
            z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
            states.append(state)
        return states

    want = []
    for begin, count in zip(text.off[:-1], text.count, strict=True):
        logits = []
        for at in range(max(count - toxicity.WINDOW + 1, min(count, 1))):
            words = x[begin + at : begin + min(at + toxicity.WINDOW, count)]
            states = np.concatenate([one_way(words, "f"), one_way(words[::-1], "b")[::-1]], axis=1)
            weight = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
            logits.append((weight / weight.sum()) @ states @ p["out"] + p["out_b"][0])
        want.append(max(logits, default=-np.inf))
    for chunk in (7, 4096):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(model.worst(text), want, atol=1e-4)


def test_toxicity_computes_changing_states_only(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ferryman.llm import toxicity
    from ferryman.llm.textblock import U64, text_buffer

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["w%d" % i for i in range(400)], n)) for n in (900, 5, 32, 0, 33, 2500, 40)]
    text = toxicity.Text(*text_buffer(pa.array(texts, pa.large_string())))
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    done, step = [], toxicity.advance
    monkeypatch.setattr(toxicity, "advance", lambda *a: (done.append(a[0].shape[1]), step(*a)))
    # gates that let go of a state within some words, and gates that hardly do, so that no state settles
    for bias, share in ((-2, 0.8), (-4, 0.8), (6, 1.1)):
        model = toxicity.Model(np.zeros(0, U64), np.zeros(0, np.float32))
        for side in "fb":
            model.p[f"h{side}"] *= 0.5
            model.p[f"b{side}"][: toxicity.HIDDEN] = bias
        start, of = text.windows()
        done.clear()
        got = model.all_logits(text, start, of)
        assert np.abs(got - model.logits(text, start, of)).max() < 1e-4
        assert sum(done) < share * 2 * toxicity.WINDOW * len(text.form), (bias, sum(done) / (2 * toxicity.WINDOW * len(text.form)))


def test_toxicity_worst_window_takes_fewer_steps(monkeypatch):
    """The two passes find the largest of all windows' logits, with less than two thirds of the steps; with gates that never let go, with all of them."""
    import numpy as np
    import pyarrow as pa

    from ferryman.llm import toxicity
    from ferryman.llm.textblock import U64, text_buffer

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["w%d" % i for i in range(400)], n)) for n in (900, 5, 32, 0, 33, 2500, 40)]
    text = toxicity.Text(*text_buffer(pa.array(texts, pa.large_string())))
    start, of = text.windows()
    done, step = [], toxicity.advance
    monkeypatch.setattr(toxicity, "advance", lambda *a: (done.append(a[0].shape[1]), step(*a)))
    for seed in range(3):
        # the last: activations beyond the range of the first pass's exponential
        for bias, share, scale in ((0, 0.66, 1), (-2, 0.66, 1), (6, 1.1, 1), (0, 1.1, 40)):
            model = toxicity.Model(np.zeros(0, U64), np.zeros(0, np.float32), seed)
            for side in "fb":
                model.p[f"x{side}"] *= scale
                model.p[f"b{side}"][: toxicity.HIDDEN] = bias
            want = np.full(len(texts), -np.inf)
            np.maximum.at(want, of, model.logits(text, start, of))
            done.clear()
            assert np.allclose(model.worst(text), want, atol=1e-4), (seed, bias, scale)
            assert sum(done) < share * 2 * toxicity.WINDOW * len(text.form), (seed, bias, scale, sum(done) / (2 * toxicity.WINDOW * len(text.form)))


def test_toxicity_weighs_settled_words_once(monkeypatch):
    """A word at which both directions have settled gets one attention weight for all windows that hold it so; also across chunks, also where states go on changing."""
    import numpy as np
    import pyarrow as pa

    from ferryman.llm import toxicity
    from ferryman.llm.textblock import U64, text_buffer

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, v, *a, **k):
            if v.ndim == 2:
                weights.append(v.size)
            return np.exp(v, *a, **k)

    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["w%d" % i for i in range(400)], n)) for n in (900, 5, 32, 0, 33, 1500, 40)]
    text = toxicity.Text(*text_buffer(pa.array(texts, pa.large_string())))
    start, of = text.windows()
    short = text.count[of] < toxicity.WINDOW
    weights = []
    for chunk, bias, share in ((7, -4, None), (100, -4, None), (700, -4, 0.75), (700, -2, 0.9), (700, 6, None)):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        model = toxicity.Model(np.zeros(0, U64), np.zeros(0, np.float32))
        for side in "fb":
            model.p[f"h{side}"] *= 0.5
            model.p[f"b{side}"][: toxicity.HIDDEN] = bias
        want = model.logits(text, start, of)
        assert np.abs(model.all_logits(text, start, of) - want).max() < 1e-4, (chunk, bias)
        x = model.inputs(text, np.arange(len(text.keys)))
        own = model.logits(text, start[short], of[short], x)
        with monkeypatch.context() as patch:
            patch.setattr(toxicity.Model, "logits", lambda *a: own)
            patch.setattr(toxicity, "np", Counted())
            weights.clear()
            got = model.all_logits(text, start, of, 1e-4, x)
        assert np.abs(got - want).max() < 5e-3, (chunk, bias)
        assert share is None or 0 < sum(weights) < share * toxicity.WINDOW * len(start), (bias, sum(weights) / toxicity.WINDOW / len(start))


def test_encoder_memory_is_bounded():
    """Encoding 6 MB of text takes less than 60 MB beside texts and vocabulary, also of words that are all distinct."""
    import tracemalloc

    import pyarrow as pa

    from ferryman.llm import sentencepiece

    class Frame:
        """Stands in for a DataFrame: gives out the function that a task runs."""

        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):  # noqa: N802
            return task

    task = sentencepiece.encode_and_check(Frame(), sentencepiece.Vocabulary.read())
    rng = random.Random(3)
    frequent = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(frequent) for _ in range(2000)) for _ in range(500)] + [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert batch.nbytes > 6_000_000
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in task(iter([batch])) if all(b.column(4).to_pylist()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == len(texts)
    assert peak < 60_000_000, peak
