"""Words, n-gram hashes and window minima of a block of texts, as numpy arrays.

A block is a run of rows of an Arrow batch whose texts lie one after another in one
byte buffer. Everything is computed for the whole block at once; a block holds a
bounded number of bytes unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
BLOCK_ROWS = 4_000

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x + U64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes(seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix(np.arange(256, dtype=U64), seed)


class Hasher:
    """Hashes of every run of k consecutive codes, from prefix sums modulo 2**64."""

    def __init__(self, seed: int = 0):
        self.base = (BASE + 2 * seed * 0x51ED2701) % 2**64 | 1
        self.seed = seed
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                up = np.full(size, self.base, U64)
                down = np.full(size, pow(self.base, -1, 2**64), U64)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up), np.cumprod(down)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self._grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of codes[start:end] for each pair; the length is part of it."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64), self.seed)

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k codes from each start on; empty when there are fewer."""
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((prefix[k:] - prefix[:n]) * self.down[:n] + U64(k), self.seed)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text starts (one more for the end); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of at most so many bytes of text or BLOCK_ROWS rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), at + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: letters and digits of ASCII, and every byte of a longer UTF-8 sequence
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes unchanged."""
    return _LOWER[data]


class Words:
    """Where the words of a block start and end, and the words each text has."""

    def __init__(self, data: np.ndarray, off: np.ndarray, alnum: bool = False):
        inside = _ALNUM[data] if alnum else ~_SPACE[data]
        n = len(data)
        first = np.empty(n, bool)
        last = np.empty(n, bool)
        if n:
            first[0] = True
            first[1:] = ~inside[:-1]
            first[off[:-1][off[:-1] < n]] = True
            last[-1] = True
            last[:-1] = ~inside[1:]
            last[off[1:][off[1:] > 0] - 1] = True
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        self.data = data
        #: number of the first word of each text, one more for the end
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)

    def text(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def codes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        h = Hasher(seed)
        return h.spans(h.prefix(byte_codes(seed)[self.data]), self.start, self.end)


def starts(off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of k units that stay within one text, and the text of each."""
    count = np.maximum(np.diff(off) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(len(text)) - np.repeat(before, count) + off[:-1][text], text


def shingles(words: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the text of each; a text with fewer words is one shingle as a whole."""
    h = Hasher(seed + 7)
    prefix = h.prefix(words.codes(seed))
    at, text = starts(words.off, k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        at = np.concatenate([at, words.off[:-1][short]])
        text = np.concatenate([text, short])
        end = at + np.minimum(k, words.count[text])
        order = np.argsort(text, kind="stable")
        at, text, end = at[order], text[order], end[order]
    else:
        end = at + k
    return h.spans(prefix, at, end), text


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """Where the smallest of each w consecutive hashes stands; the leftmost of equal ones.

    The place is carried in the low 32 bits, so that a plain running minimum by doubling
    finds it; equal windows find it at the same offset.
    """
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    v = np.minimum(v[:n], v[w - width : w - width + n])
    return (v & U64(0xFFFFFFFF)).astype(np.int64)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the half-open ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
