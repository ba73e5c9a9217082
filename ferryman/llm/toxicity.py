"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into words (letters and digits, A-Z lower-cased) and scored in all overlapping
windows of ``WINDOW`` words, one from every word on; the text's score is its worst window's.
A word comes in twice: as an embedding of the word (of those known from training) and as the
mean embedding of its character trigrams, so that unknown words are judged by their letters.

Training runs in one task, on a bounded sample of labelled rows: at most ``FIT_TOXIC`` and
``FIT_CLEAN`` documents of at most ``FIT_CHARS`` characters. A labelled document counts through its
most suspicious windows, chosen at first by the log odds of their words (which also start the
word embeddings) and then by the network itself.

Defined cases: a null text is empty; a text without words scores 0; labels that are null or
stand several times: null counts as no label, any toxic one wins; without labels of both kinds
every score is 0; rows that repeat are scored alike; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import U64, Words, blocks, column, lowered, text_buffer

WINDOW = 32
#: training looks at windows this many words apart; scoring looks at all
FIT_STEP = 16
#: windows that slide along the words together; what they need stays in a core's cache
CHUNK = 3584
#: after so many steps of a chunk, states that no longer change are looked for
LEAST_STEPS = 8
#: in the first pass over all windows, a state that a step changes by no more than this has settled; in the second, one that it leaves as it is
SETTLED = 5e-4
#: windows whose first logit comes so near to the best of their text go through the second pass; at least NEAR_ERRORS times the largest error met
NEAR, NEAR_ERRORS = 0.01, 4
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
TRIGRAMS = 4096
MAX_WORDS, MIN_DOCS = 20_000, 5
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 1_200, 2_400, 20_000
EPOCHS, BATCH, RATE = 4, 192, 0.01
#: few labelled rows are gone over more often, for so many steps at least
MIN_STEPS = 200
FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def advance(u: np.ndarray, a: np.ndarray, state: np.ndarray, to: np.ndarray, scratch: np.ndarray) -> None:
    """One step of many states, a column each, into ``to``; u and a: what the state and the word add to the gates (halved) and the candidate (the state's halved).

    Sigmoids are taken from tanh (sigmoid(v) = (1 + tanh(v / 2)) / 2), which is quicker than an exponential and a quotient.
    """
    h = len(state)
    gates, new = scratch[: 2 * h], scratch[2 * h :]
    np.add(u[: 2 * h], a[: 2 * h], out=gates)
    np.tanh(gates, out=gates)
    gates += 1
    np.multiply(gates[h:], u[2 * h :], out=new)
    new += a[2 * h :]
    np.tanh(new, out=new)
    np.subtract(state, new, out=to)
    to *= gates[:h]
    to *= 0.5
    to += new


def aligned(size: int) -> np.ndarray:
    """Memory that begins at a multiple of 64 bytes, where vector instructions are quickest."""
    room = np.empty(size + 16, np.float32)
    return room[-room.ctypes.data // 4 % 16 :][:size]


class Text:
    """Words of a block: for each the number of its distinct form, and the trigrams of each form."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = lowered(data)
        words = Words(data, off, alnum=True)
        self.off, self.count = words.off, words.count
        # distinct words by hash table; only those are sorted
        found = pa.array(words.codes(71)).dictionary_encode()
        distinct, number = found.dictionary.to_numpy(), found.indices.to_numpy()
        order = np.argsort(distinct)
        self.keys, rank = distinct[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.form = rank[number]
        where = np.empty(len(order), np.int64)
        where[self.form] = np.arange(len(self.form))
        begin, end = words.start[where], words.end[where]
        size = end - begin
        self.at = np.cumsum(size) - size
        place = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(self.at, size)
        wide = np.r_[data, 0].astype(np.int64)
        before = np.where(place == np.repeat(begin, size), 1, wide[place - 1])
        after = np.where(place + 1 == np.repeat(end, size), 2, wide[place + 1])
        self.trigram = ((before * 65536 + wide[place] * 256 + after) * 2654435761 >> 8) % TRIGRAMS
        self.size = size

    def trigrams_of(self, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of some distinct words, one word after the other, and where each word's start."""
        size = self.size[forms]
        at = np.cumsum(size) - size
        return self.trigram[np.arange(size.sum()) + np.repeat(self.at[forms] - at, size)], at

    def windows(self, apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Starts of overlapping windows (word numbers of the block), so far apart up to the last one, and the text of each; a shorter text is one window."""
        n = np.where(self.count > WINDOW, -(-(self.count - WINDOW) // apart) + 1, np.minimum(self.count, 1))
        text = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return self.off[text] + np.minimum(step * apart, np.maximum(self.count[text] - WINDOW, 0)), text


class Model:
    """Parameters by name (float32), and the keys of the known words in order (their rows are from 1 on)."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.keys, self.shift = keys, 0.0
        self.p = {"word": (rng.standard_normal((len(keys) + 1, WORD_DIM)) * 0.1).astype(np.float32), "char": (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.1).astype(np.float32)}
        self.p["word"][1:, 0] = odds
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"x{side}": small(d, 3 * h), f"h{side}": small(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": small(2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": small(h), "out": small(2 * h), "out_b": np.zeros(1, np.float32)}

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The embedding row of each word key; 0 for unknown ones."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)

    def inputs(self, text: Text, forms: np.ndarray) -> np.ndarray:
        """The input vector of each of these distinct words."""
        if not len(forms):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        trigram, at = text.trigrams_of(forms)
        chars = np.add.reduceat(self.p["char"][trigram], at, axis=0) / text.size[forms][:, None]
        return np.concatenate([self.p["word"][self.rows(text.keys[forms])], chars], axis=1).astype(np.float32)

    def run(self, x: np.ndarray, steps: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """Hidden states [windows, steps, HIDDEN] of one direction; x: projected inputs of the distinct words, steps: their numbers."""
        n, length = steps.shape
        h, w = HIDDEN, self.p[f"h{side}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((n, length, h), np.float32)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            a = x[steps[:, t]]
            u = state @ w
            gates = sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            if trace is not None:
                trace.append((t, state, z, r, new, u[:, 2 * h :]))
            state = state + mask[:, t : t + 1] * (1 - z) * (new - state)
            out[:, t] = state
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        tanh = np.tanh(states @ self.p["att"] + self.p["att_b"])
        weight = np.exp(np.minimum(tanh @ self.p["att_v"], 30)) * mask
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return pooled @ self.p["out"] + self.p["out_b"][0], pooled, weight, tanh

    def logits(self, text: Text, start: np.ndarray, of: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """A logit for each window; x: the inputs of all distinct words."""
        x = self.inputs(text, np.arange(len(text.keys))) if x is None else x
        fore, aft = x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), 1024):
            steps, mask = window_steps(text, start[i : i + 1024], of[i : i + 1024])
            states = np.concatenate([self.run(fore, steps, mask, "f"), self.run(aft, steps, mask, "b")], axis=2)
            out[i : i + 1024] = self.pool(states, mask)[0]
        return out

    def worst(self, text: Text) -> np.ndarray:
        """The largest logit of each text's windows; minus infinity without words.

        All windows get a logit in which states count as settled within ``SETTLED``. Those that may be the largest
        then get theirs from all steps, as does one window a text wherever it stands; what the two differ by tells how near
        "may be" is, and windows are gone over again until none is left within it.
        """
        start, of = text.windows()
        x = self.inputs(text, np.arange(len(text.keys)))
        logit = self.all_logits(text, start, of, SETTLED, x)
        done = np.zeros(len(start), bool)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        near = NEAR
        again = first + np.diff(np.r_[first, len(of)]) * 5 // 8
        while True:
            exact = self.logits(text, start[again], of[again], x)
            near = max(near, NEAR_ERRORS * float(np.abs(exact - logit[again]).max(initial=0)))
            logit[again], done[again] = exact, True
            out = np.full(len(text.count), -np.inf)
            if len(first):
                out[of[first]] = np.maximum.reduceat(logit, first)
            again = np.flatnonzero(~done & (logit >= out[of] - near))
            if not len(again):
                return out

    def all_logits(self, text: Text, start: np.ndarray, of: np.ndarray, settled: float = 0.0, x: np.ndarray | None = None) -> np.ndarray:
        """A logit for each window of ``text.windows()``: those of whole length slide along the words, texts of less are run on their own."""
        out = np.empty(len(start), np.float32)
        short = text.count[of] < WINDOW
        x = self.inputs(text, np.arange(len(text.keys))) if x is None else x
        out[short] = self.logits(text, start[short], of[short], x)
        h, p = HIDDEN, self.p
        # halved where ``advance`` takes a half
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])
        sides = []
        for k, side in enumerate("fb"):
            own = slice(k * h, (k + 1) * h)
            # one product takes the state on to the next step, to the attention and to the output
            w = np.concatenate([p[f"h{side}"].T / 2, p["att"][own].T, p["out"][None, own]])
            a = (x @ p[f"x{side}"] + p[f"b{side}"]) * half
            sides.append((a.astype(np.float32), np.ascontiguousarray(w, np.float32)))
        room = aligned((14 * h + 6 + WINDOW * (h + 1)) * (CHUNK + 3 * WINDOW))
        whole = np.flatnonzero(~short)
        first_word = start[whole]
        i = 0
        while i < len(whole):
            # windows that start within a chunk of words, some of which may run over the end of a text and are left out
            first = first_word[i]
            j = int(np.searchsorted(first_word, first + CHUNK))
            out[whole[i:j]] = self.sliding(text, sides, first, int(first_word[j - 1] - first) + 1, room, settled)[first_word[i:j] - first]
            i = j
        return out

    def sliding(self, text: Text, sides: list, first: int, n: int, room: np.ndarray, settled: float) -> np.ndarray:
        """Logits of the n windows that start at the words from ``first`` on.

        Forward runs go first; what they add to the attention is kept for each word of the windows, or, of states that have
        settled, once for all windows that hold the word, with what a later step changed. Backward runs then meet them from
        the last word of the windows on. The weight of a word at which both directions have settled is the same for all windows
        that hold it so; it is computed again only where a state changes.
        Every result goes into ``room``, which the chunks share: new memory costs more than the arithmetic.
        """
        h, p = HIDDEN, self.p
        words = n + WINDOW - 1
        # rows that are multiples of 64 bytes
        columns, wide = (words + 16) // 16 * 16, (n + 15) // 16 * 16
        shape = [(4 * h + 1, columns), (h, columns), (h, columns), (3 * h, columns), (3 * h, columns + 2 * WINDOW), (h + 1, columns), (h + 1, columns), (1, columns), (WINDOW, h + 1, wide), (2, wide)]
        parts = np.split(room, np.cumsum([np.prod(s) for s in shape]))
        u, state, after, scratch, x, ahead, shown, weights, seen, (weight, total) = (v.reshape(s) for v, s in zip(parts, shape))
        add, bias = u[3 * h :], np.r_[p["att_b"], 0].astype(np.float32)[:, None]
        weight[:], total[:] = 0, 0
        x[:, :WINDOW], x[:, WINDOW + words :] = 0, 0

        def runs(side: int) -> Iterator[tuple]:
            x[:, WINDOW : WINDOW + words] = sides[side][0].take(text.form[first : first + words], axis=0).T
            return self.steps(x, sides[side][1], side == 1, words, u, state, after, scratch, settled)

        def attend(fore: np.ndarray, aft: np.ndarray, shown: np.ndarray, share: np.ndarray) -> None:
            """Weights of some words, from what both directions add to the attention, and in the last row of ``shown`` their outputs times these."""
            np.add(fore, aft, out=shown)
            np.tanh(shown[:h], out=shown[:h])
            np.matmul(p["att_v"][None, :], shown[:h], out=share)
            np.minimum(share, 30, out=share)
            np.exp(share, out=share)
            shown[h:] *= share

        dense, undo = 0, {}
        for step, (at, changed, before) in enumerate(runs(0)):
            if at == step:
                np.add(add[:, :n], bias, out=seen[step, :, :n])
                dense = step + 1
            elif len(changed):
                undo[step] = changed, before + bias
        np.add(add, bias, out=ahead)
        shared, none = None, (np.zeros(0, np.int64), bias[:, :0])
        for step, (at, changed, _) in enumerate(runs(1)):
            t = WINDOW - 1 - step
            both = at < step and t >= dense
            if not both:
                fore = seen[t, :, :n] if t < dense else ahead[:, t + 1 - dense :][:, :n]
                attend(fore, add[:, WINDOW + at - step :][:, :n], shown[:, :n], weights[:, :n])
                weight[:n] += weights[0, :n]
                total[:n] += shown[h, :n]
            elif shared is None:
                # by word, from the first on at which the forward states have settled
                low, many = dense - 1, words - at - (dense - 1)
                shared = weights[0, :many], shown[h, :many]
                attend(ahead[:, :many], add[:, low + 1 + at :][:, :many], shown[:, :many], weights[:, :many])
            else:
                again = np.concatenate([undone, changed - 1 - at - low])
                again = again[(again >= 0) & (again < many)]
                if len(again):
                    part, share = np.empty((h + 1, len(again)), np.float32), np.empty((1, len(again)), np.float32)
                    attend(ahead.take(again, axis=1), add.take(again + low + 1 + at, axis=1), part, share)
                    shared[0][again], shared[1][again] = share[0], part[h]
            if both:
                weight[:n] += shared[0][t - low :][:n]
                total[:n] += shared[1][t - low :][:n]
            # back to the forward states of the word before
            undone, before = undo.get(t, none)
            if len(undone):
                ahead[:, undone] = before
        return total[:n] / weight[:n] + p["out_b"][0]

    def steps(self, x: np.ndarray, w: np.ndarray, back: bool, words: int, u: np.ndarray, state: np.ndarray, after: np.ndarray, scratch: np.ndarray, settled: float) -> Iterator[tuple]:
        """Runs of ``WINDOW`` steps from each word on, a column each (backward ones: one column further on), whose products with ``w`` come into u.

        Where a state comes out as that of another run which was at the word one step earlier (the network has forgotten the
        first word of the window; but for ``settled`` at most), all that follow from it do as well; once few still
        change, only those are computed, and the columns stay with the words that they have come to.
        Yields, after each step, the step that the columns stand at; and once they stay, the columns changed by this step and, forward, what they added to the attention before.
        """
        h = HIDDEN
        state[:], u[:] = 0, 0
        way, changing, at = -1 if back else 1, None, 0
        for step in range(WINDOW):
            if changing is None:
                at, begin = step, WINDOW - 1 - step if back else WINDOW + step
                advance(u[: 3 * h], x[:, begin : begin + u.shape[1]], state, after, scratch)
                state, after = after, state
                np.matmul(w, state, out=u)
                if step >= LEAST_STEPS:
                    # columns at a word of the chunk, and those which were there a step earlier
                    low, high = (step + 1, words + 1) if back else (0, words - step)
                    change = np.subtract(state[:, low:high], after[:, low + way : high + way], out=scratch[:h, low:high])
                    moved = np.flatnonzero(np.abs(change, out=change).max(axis=0) > settled) + low
                    if len(moved) < words // 4:
                        changing, own, push = moved, state.take(moved, axis=1), u.take(moved, axis=1)
                yield at, None, None
                continue
            if not len(changing):
                yield at, changing, None
                continue
            changing = changing + way
            # one run at most has left the chunk
            inside = slice(int(changing[0] < low), len(changing) - int(changing[-1] >= high))
            changing, own, push = changing[inside], own[:, inside], push[: 3 * h, inside]
            to = np.empty(own.shape, np.float32)
            advance(push, x.take(changing + begin, axis=1), own, to, np.empty(push.shape, np.float32))
            moved = np.abs(to - state.take(changing, axis=1)).max(axis=0) > settled
            changing, own = changing[moved], to.compress(moved, axis=1)
            push = w @ own
            before = None if back else u[3 * h :].take(changing, axis=1)
            state[:, changing] = own
            u[3 * h :, changing] = push[3 * h :]
            yield at, changing, before

    def gradients(self, text: Text, start: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over some windows, by backpropagation through time."""
        h, p = HIDDEN, self.p
        steps, mask = window_steps(text, start, of)
        used, steps = np.unique(steps, return_inverse=True)
        steps = steps.reshape(mask.shape)
        x = self.inputs(text, used)
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(x @ p[f"x{s}"] + p[f"b{s}"], steps, mask, s, traces[s]) for s in "fb"], axis=2)
        logit, pooled, weight, tanh = self.pool(states, mask)
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pool[:, None, :]
        d_weight = np.einsum("nh,nth->nt", d_pool, states)
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("nt,nth->h", d_raw, tanh)
        d_tanh = d_raw[:, :, None] * p["att_v"] * (1 - tanh**2)
        g["att"], g["att_b"] = np.einsum("nta,nth->ah", states, d_tanh), d_tanh.sum(axis=(0, 1))
        d_states = d_states + d_tanh @ p["att"].T
        d_x = np.zeros_like(x)
        order = np.argsort(steps, axis=None, kind="stable")
        first = np.searchsorted(steps.reshape(-1)[order], np.arange(len(x)))
        for k, side in enumerate("fb"):
            own = d_states[:, :, k * h : (k + 1) * h]
            w = p[f"h{side}"]
            d_steps = np.empty((*steps.shape, 3 * h), np.float32)
            g_w = np.zeros_like(w)
            d_state = np.zeros((len(y), h), np.float32)
            for t, before, z, r, new, u in reversed(traces[side]):
                d_state = d_state + own[:, t]
                m = mask[:, t : t + 1]
                d_new = d_state * m * (1 - z) * (1 - new**2)
                d_z = -d_state * m * (new - before) * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_steps[:, t] = d_a
                g_w += before.T @ d_u
                d_state = d_state * (1 - m * (1 - z)) + d_u @ w.T
            d_in = np.add.reduceat(d_steps.reshape(-1, 3 * h)[order], first, axis=0)
            g[f"h{side}"], g[f"x{side}"], g[f"b{side}"] = g_w, x.T @ d_in, d_in.sum(axis=0)
            d_x += d_in @ p[f"x{side}"].T
        g["word"] = np.zeros_like(p["word"])
        g["word"][self.rows(text.keys[used])] = d_x[:, :WORD_DIM]  # known words stand once in "used"
        g["word"][0] = 0
        trigram, share = text.trigrams_of(used)[0], np.repeat(d_x[:, WORD_DIM:] / text.size[used][:, None], text.size[used], axis=0)
        g["char"] = np.stack([np.bincount(trigram, share[:, i], TRIGRAMS) for i in range(CHAR_DIM)], axis=1).astype(np.float32)
        return g


def window_steps(text: Text, start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word forms [windows, WINDOW] and which of them are words of the text."""
    at = start[:, None] + np.arange(WINDOW)
    mask = at < text.off[of + 1][:, None]
    return text.form[np.minimum(at, len(text.form) - 1)], mask.astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on whole labelled texts; the same rows give the same model."""
    text = Text(*text_buffer(pa.array(texts, pa.large_string())))
    y = np.asarray(toxic, np.float32)
    if not len(text.form) or y.min() == y.max():
        model = Model(np.zeros(0, U64), np.zeros(0, np.float32))
        model.shift = -np.inf
        return model
    pair = np.unique(np.repeat(np.arange(len(y)), text.count) * len(text.keys) + text.form)
    in_toxic = np.bincount(pair % len(text.keys), y[pair // len(text.keys)], len(text.keys))
    in_all = np.bincount(pair % len(text.keys), minlength=len(text.keys))
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_all - in_toxic + 0.5) / (len(y) - y.sum() + 1))
    known = np.sort(np.argsort(-in_all, kind="stable")[: min(MAX_WORDS, int((in_all >= MIN_DOCS).sum()))])
    model = Model(text.keys[known], np.clip(odds[known], -3, 3).astype(np.float32) / 2, seed)

    rng = np.random.default_rng(seed)
    start, of = text.windows(FIT_STEP)
    weight = np.zeros(len(text.keys))
    weight[known] = np.clip(odds[known], 0, 3) ** 2
    sums = np.r_[0, np.cumsum(weight[text.form])]
    suspicion = sums[np.minimum(start + WINDOW, text.off[of + 1])] - sums[start]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    epochs = max(epochs, -(-MIN_STEPS // -(-(len(y) + min(2 * len(y), int((y[of] == 0).sum()))) // BATCH)))
    for epoch in range(epochs):
        order = np.lexsort((-suspicion, of))
        worst = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        clean = rng.permutation(np.flatnonzero(y[of] == 0))[: 2 * len(y)]
        pick = rng.permutation(np.concatenate([worst, clean]))
        for i in range(0, len(pick), BATCH):
            part = pick[i : i + BATCH]
            step += 1
            for k, g in model.gradients(text, start[part], of[part], y[of[part]]).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[k] -= RATE * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if epoch in (epochs // 4, epochs // 2):
            suspicion = model.logits(text, start, of).astype(np.float64)
    # the limit of 0.5 goes where the fit rows are told apart best, toxic and clean ones counting alike however many there are
    score = model.worst(text)
    limits = np.unique(score[np.isfinite(score)])
    limits = (limits[1:] + limits[:-1]) / 2 if len(limits) > 1 else limits
    limits = limits[np.linspace(0, len(limits) - 1, min(len(limits), 2000)).astype(int)]
    hits = np.array([(score[y == 1] >= c).mean() + (score[y == 0] < c).mean() for c in limits])
    model.shift = -float(np.median(limits[hits == hits.max()]))
    return model


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN, max_chars: int = FIT_CHARS) -> Model:
    """Train on a bounded sample of the labelled documents that aren't held out, drawn by hash of doc_id."""
    label = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    label = label.filter(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id", F.lit(7)))
    # at most n_toxic + n_clean rows of numbers: a proven bound
    picked = label.filter("toxic = 1").orderBy("turn", "doc_id").limit(n_toxic).unionAll(label.filter("toxic <> 1").orderBy("turn", "doc_id").limit(n_clean))
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars)).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += column(batch, "text").to_pylist()
            toxic += column(batch, "toxic").to_pylist()
        if texts:
            model = train(texts, np.array(toxic))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.keys, model.shift, model.p))], pa.binary())], names=["model"])

    # the bounded sample is trained on in one task; the driver holds the parameters only, never texts or what training needs
    packed = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(task, "model binary").collect()
    if not packed:
        return train([""], np.zeros(1))
    keys, shift, p = pickle.loads(packed[0].model)
    model = Model(keys, np.zeros(len(keys), np.float32))
    model.shift, model.p = shift, p
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc``, each row of the documents as it is, in one struct so that no name of its own clashes, and its ``score``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in blocks(batches):
            worst = model.worst(Text(data, off)) + model.shift
            worst = np.where(np.isfinite(worst), sigmoid(np.clip(worst, -30, 30)), 0.0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(worst, pa.float64())], names=["doc", "score"])

    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(task, rows.select("doc").schema.add("score", "double"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents and ``score``, in place of one of that name."""
    return scored(docs, model).select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "score"], "score")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
