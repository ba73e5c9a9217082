"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A vocabulary of pieces with scores is read from a public model file (on the driver; the
parsed table, of a fixed size, travels with the tasks). A text is put behind one space, spaces
mark word starts, and each word is cut into the pieces with the largest sum of scores. Among
equal sums the last piece is the longest. No piece goes over a word start or a line break, so
words are encoded on their own. The distinct marked words of a block are sorted, which lays
out their trie in depth-first order: the forward scores of the prefix that a word shares with
the one before are kept, and only the rest is computed.

A character without a piece goes byte by byte. Nothing is normalized and a literal U+2581
goes by bytes, so decoding gives back every text exactly.

Defined cases: a null or empty text has no pieces and decodes to an empty text; rows stay as
many as they are; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import U64, Hasher, blocks, byte_codes, column, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: distinct words that a task holds encoded at most, before it starts anew
CACHE_WORDS = 1_000_000
#: bytes of text that are encoded at a time: what the hashes of a block's words take is some 60 times as much
ENCODE_BYTES = 250_000


class Vocabulary:
    """Pieces (as texts, with spaces for marks), their scores, and the ids of the 256 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], spelled: list[bytes]):
        self.pieces, self.byte_ids, self.spelled = pieces, byte_ids, spelled
        #: score of a byte: below zero and worse than any piece
        self.byte_score = min([0.0, *(s for _, s in pieces.values())]) - 10.0

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, spelled = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                text = piece.replace(MARK, " ")
                pieces[text] = (i, model.get_score(i))
                spelled.append(text.encode())
        return cls(pieces, byte_ids, spelled)


class Endings:
    """Which pieces end at a character of a word, by one look-up for each character.

    A state stands for the longest ending of what was read that some piece begins with; all
    pieces that end there are endings of it. States and steps are made when first met.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        self.begins = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        self.number = {"": 0}
        self.read = [""]
        #: by state: the next state for each character
        self.steps: list[dict[str, int]] = [{}]
        #: by state: (length, score, id) of the pieces that end there, longest first
        self.found: list[list[tuple[int, float, int]]] = [[]]

    def step(self, state: int, char: str) -> int:
        read = self.read[state] + char
        while read and read not in self.begins:
            read = read[1:]
        to = self.number.setdefault(read, len(self.read))
        if to == len(self.read):
            self.read.append(read)
            self.steps.append({})
            ends = [read[i:] for i in range(len(read)) if read[i:] in self.pieces]
            self.found.append([(len(p), self.pieces[p][1], self.pieces[p][0]) for p in ends])
        self.steps[state][char] = to
        return to


def encode_sorted(words: list[str], vocabulary: Vocabulary, endings: Endings | None = None) -> Iterator[list[int]]:
    """Piece ids of each word; the words come in order, so that shared prefixes stand next to each other.

    ``score[i]``, ``back[i]``, ``piece[i]``, ``state[i]``: best sum for the first i characters, where its
    last piece starts, that piece's id (-1: the character goes by bytes), and the pieces that can end there.
    """
    low, endings = vocabulary.byte_score, endings or Endings(vocabulary)
    steps, matches = endings.steps, endings.found
    score, back, piece, state = [0.0], [0], [-1], [0]
    before = ""
    for word in words:
        n, shared = len(word), 0
        for x, y in zip(before, word, strict=False):
            if x != y:
                break
            shared += 1
        del score[shared + 1 :], back[shared + 1 :], piece[shared + 1 :], state[shared + 1 :]
        at = state[shared]
        for end in range(shared + 1, n + 1):
            char = word[end - 1]
            to = steps[at].get(char)
            at = endings.step(at, char) if to is None else to
            best, size, found = float("-inf"), 1, -1
            for fit, worth, number in matches[at]:
                total = score[end - fit] + worth
                if total > best:
                    best, size, found = total, fit, number
            if found < 0 or fit > 1:  # a character that is a piece itself is never better by bytes
                by_bytes = score[end - 1] + low * len(char.encode())
                if by_bytes > best:
                    best, size, found = by_bytes, 1, -1
            score.append(best)
            back.append(end - size)
            piece.append(found)
            state.append(at)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(vocabulary.byte_ids[b] for b in reversed(word[at - 1].encode()))
            at = back[at]
        ids.reverse()
        before = word
        yield ids


def marked_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with a space before each text that has bytes, the starts of its words (and its end), and the first word of each text (and the end)."""
    full = np.diff(off) > 0
    marked = np.insert(data, off[:-1][full], 0x20)
    off = off + np.r_[0, np.cumsum(full)]
    if not len(marked):
        return marked, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    space, line = marked == 0x20, marked == 0x0A
    first = line.copy()
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    first[off[:-1][full]] = True
    begin = np.flatnonzero(first)
    return marked, np.r_[begin, len(marked)], np.searchsorted(begin, off)


class Encoder:
    """Encodes blocks of texts; holds the pieces of words that it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocabulary, self.cache_words = vocabulary, cache_words
        self.forget()

    def forget(self) -> None:
        self.endings = Endings(self.vocabulary)
        #: keys of the words met, in order, and the number that each has among their ids
        self.known, self.number = np.zeros(0, U64), np.zeros(0, np.int32)
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and where each text's ids start (and the end)."""
        marked, begin, text_at = marked_words(data, off)
        if len(begin) == 1:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        first, second = Hasher(61), Hasher(62)
        codes = byte_codes(61)[marked]
        key = first.spans(first.prefix(codes), begin[:-1], begin[1:]) ^ mix(second.spans(second.prefix(codes), begin[:-1], begin[1:]), 3)
        distinct, where, turn = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.cache_words:
            self.forget()
        unmet = np.ones(len(distinct), bool)
        if len(self.known):
            unmet = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        if unmet.any():
            new = [(marked[begin[w] : begin[w + 1]].tobytes().decode(), i) for i, w in enumerate(where[unmet].tolist())]
            new.sort()
            turns = np.array([i for _, i in new])
            count, ids = np.zeros(len(new), np.int64), array("i")
            for i, found in enumerate(encode_sorted([w for w, _ in new], self.vocabulary, self.endings)):
                count[i] = len(found)
                ids.extend(found)
            number = np.empty(len(new), np.int32)
            number[turns] = np.arange(len(self.known), len(self.known) + len(new))
            at = np.searchsorted(self.known, distinct[unmet])
            self.known, self.number = np.insert(self.known, at, distinct[unmet]), np.insert(self.number, at, number)
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.int32)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(count)])
        number = self.number[np.searchsorted(self.known, distinct)][turn]
        count = self.off[number + 1] - self.off[number]
        end = np.cumsum(count)
        take = np.arange(end[-1]) + np.repeat(self.off[number] - end + count, count)
        return self.ids[take], np.r_[0, end][text_at]


class Decoder:
    """Spells out piece ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = np.frombuffer(b"".join(vocabulary.spelled), np.uint8)
        self.off = np.r_[0, np.cumsum([len(x) for x in vocabulary.spelled])].astype(np.int64)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The text of each run of ids, without the space put before it."""
        if not len(ids):
            return [b""] * (len(off) - 1)
        count = self.off[ids + 1] - self.off[ids]
        end = np.r_[0, np.cumsum(count)]
        out = self.bytes[np.arange(end[-1]) + np.repeat(self.off[ids] - end[:-1], count)].tobytes()
        at = end[off].tolist()
        return [out[a + 1 : b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, ids (array of piece ids) of every row; no shuffle."""
    vocabulary = vocabulary or Vocabulary.read()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch, data, off in blocks(batches, most=ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _lists(*encoder.encode(data, off))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids decode to an empty text."""
    vocabulary = vocabulary or Vocabulary.read()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            lists = column(batch, "ids")
            off = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] if batch.num_rows else np.zeros(1, np.int64)
            texts = decoder.decode(lists.flatten().to_numpy(), off)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(task, "doc_id long, text string")


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256, exact (the decoded text is the text) of every row, in one pass."""
    vocabulary = vocabulary or Vocabulary.read()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch, data, off in blocks(batches, most=ENCODE_BYTES):
            ids, at = encoder.encode(data, off)
            texts = decoder.decode(ids, at)
            whole = data.tobytes()
            exact = [t == whole[a:b] for t, a, b in zip(texts, off[:-1].tolist(), off[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(at)), _lists(ids, at), pa.array(sha, pa.string()), pa.array(exact, pa.bool_())], names=["doc_id", "n_pieces", "ids", "decoded_sha256", "exact"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, exact boolean")
