"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

A text is a space mark, then the text with spaces as marks. No piece of the vocabulary has a mark
behind another character, nor a line end, so the segmentation is that of each marked word. Distinct
words are sorted, which walks their trie depth-first: a word takes over the forward scores and back
pointers of the prefix that it shares with the word before it.

A path's score is the sum of its steps'. With log-likelihoods as scores (a unigram model) a step's is its
piece's. Where the scores are ranks of merges, the best path has to be the one that merging by rank ends at; it
is that one exactly if each two neighbours, taken alone, merge to themselves again. So there a step's
score is 0 if it fits the piece before it, else minus infinity, and one path is left for each prefix.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The vocabulary in the installed package of public tokenizers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that the text itself holds; no UTF-8 text holds a lone surrogate.
_OWN_MARK = "\ud800"
_MARKED = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Vocabulary:
    """Pieces with scores; characters outside them become byte pieces, so nothing is ever lost.

    ``pieces`` are (text, score, id), ``byte_ids`` the ids of the 256 byte pieces. ``merges`` says
    whether scores are merge ranks, 0, -1, -2 and so on, or log-likelihoods."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], merges: bool):
        for piece, _, _ in pieces:
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError("a piece crosses marked words")
        self.merges = merges
        self.scores = {x: (score, i) for x, score, i in pieces}
        self.bytes_of = [b""] * (1 + max(0, *byte_ids, *(i for _, _, i in pieces)))
        for x, _, i in pieces:
            self.bytes_of[i] = x.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        #: The two parts that a piece is merged from; a piece that merging never makes has none.
        self.rank, self.parts = {x: -1.0 for x in self.scores}, {}
        if merges:
            ranked = sorted((x for x in self.scores if len(x) > 1), key=lambda x: -self.scores[x][0])
            self.rank |= {x: -self.scores[x][0] for x in ranked}
            for x in ranked:
                found = next(((x[:i], x[i:]) for i in range(1, len(x)) if self._whole(x[:i]) and self._whole(x[i:]) and self.fits(x[:i], x[i:], self.rank[x])), None)
                if found:
                    self.parts[x] = found
        code = lambda i: np.int32(i).tobytes()
        #: Pieces that a path can hold: bytes of the id, text, which may follow as found out so far, score, length.
        self.usable = [(code(i), x, {}, score, len(x)) for x, (score, i) in self.scores.items() if not merges or self._whole(x)]
        self.pairs, self.found_in = 0, None
        self.byte_codes = [code(i) for i in byte_ids]
        #: The score of a character that has to be written as bytes.
        self.raw_score = 0.0 if merges else min((score for score, _ in self.scores.values()), default=0.0) - 10.0
        #: Words met lately, and those met before them.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_chars = 0

    @classmethod
    def read(cls, model: str = MODEL) -> Vocabulary:
        """The vocabulary of a model file, whose scores are taken for merge ranks if all are whole numbers."""
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces, byte_ids = [], [0] * 256
        for i in range(given.get_piece_size()):
            piece = given.id_to_piece(i)
            if given.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
            elif not (given.is_control(i) or given.is_unknown(i) or given.is_unused(i)):
                pieces.append((piece, given.get_score(i), i))
        return cls(pieces, byte_ids, all(score == int(score) for _, score, _ in pieces))

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.parts

    def fits(self, a: str, b: str, limit: float = float("inf")) -> bool:
        """Whether two neighbouring pieces stay two under merges of a rank below ``limit``: their own
        merges are undone from the last one on, and none may have come after one across the border."""
        rank, parts = self.rank, self.parts
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            x, y = rank[a], rank[b]
            if x > y:
                limit, a = x, parts[a][1]
            elif y >= 0:
                limit, b = y + 0.5, parts[b][0]
            else:
                return True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"found_in": None}

    def _pieces_in(self):
        """The automaton that finds all pieces in a word, by their ends and then the longest first."""
        if self.found_in is None:
            import ahocorasick

            self.found_in = ahocorasick.Automaton()
            for piece in self.usable:
                self.found_in.add_word(piece[1], piece)
            self.found_in.make_automaton()
        return self.found_in.iter if self.usable else lambda word: ()

    def _forget(self) -> None:
        for piece in self.usable:
            piece[2].clear()
        self.pairs = 0

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The pieces of each word, as 32-bit numbers.

        Of the best path to each place in the word: its score, its last piece (None: a character as bytes) and
        where that starts. What a word shares with the one before it is settled already."""
        out, pieces_in, fits, merges, raw_score = {}, self._pieces_in(), self.fits, self.merges, self.raw_score
        scores, last, back = [0.0], [None], [0]
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del scores[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            done, settled = shared, shared
            for end, piece in pieces_in(word):
                end += 1
                if end <= settled:
                    continue
                while done < end - 1:
                    scores.append(scores[done] + raw_score)
                    last.append(None)
                    back.append(done)
                    done += 1
                start = end - piece[4]
                score = scores[start]
                if merges:
                    left = last[start]
                    if left is not None:
                        fit = left[2].get(piece[1])
                        if fit is None:
                            if self.pairs > 300_000:
                                self._forget()
                            self.pairs += 1
                            fit = left[2][piece[1]] = fits(left[1], piece[1])
                        if not fit:
                            continue
                    # One step at most fits, so there is no better one.
                    settled = end
                else:
                    score += piece[3]
                    if score < (scores[end] if end == done else scores[done] + raw_score):
                        continue
                    if end == done:
                        scores[end], last[end], back[end] = score, piece, start
                        continue
                scores.append(score)
                last.append(piece)
                back.append(start)
                done = end
            while done < len(word):
                scores.append(scores[done] + raw_score)
                last.append(None)
                back.append(done)
                done += 1
            codes, at = [], len(word)
            while at:
                piece = last[at]
                codes.append(piece[0] if piece is not None else self._raw(word[at - 1]))
                at = back[at]
            codes.reverse()
            out[word] = b"".join(codes)
            before = word
        return out

    def _raw(self, character: str) -> bytes:
        return b"".join(self.byte_codes[b] for b in (MARK if character == _OWN_MARK else character).encode("utf-8", "surrogatepass"))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _marked(text: str) -> list[str]:
    return _MARKED.findall(MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)) if text else []


def load(spark: SparkSession, model: str = MODEL) -> Broadcast:
    """The vocabulary for the executors: of fixed size, a few MB."""
    return spark.sparkContext.broadcast(Vocabulary.read(model))


def _encoded(texts: pd.Series, words: Vocabulary, chunk_chars: int, cached_words: int, cached_chars: int) -> Iterator[list[np.ndarray | None]]:
    """The ids of the texts, chunk by chunk. What is made here holds no cycles, so the collector rests."""
    waiting, size = [], 0
    for i, text in enumerate(texts):
        waiting.append(None if text is None else _marked(text))
        size += len(text or "")
        if size >= chunk_chars or i == len(texts) - 1:
            if len(words.young) > cached_words or words.young_chars > cached_chars:
                words.old, words.young, words.young_chars = words.young, {}, 0
            young, old, collects = words.young, words.old, gc.isenabled()
            gc.disable()
            try:
                new = set(chain.from_iterable(filter(None, waiting))).difference(young)
                words.young_chars += sum(map(len, new))
                again = new.intersection(old)
                young.update(zip(again, map(old.__getitem__, again)))
                young.update(words.encode_words(new.difference(again)))
                ids = [None if x is None else np.frombuffer(b"".join(map(young.__getitem__, x)), np.int32) for x in waiting]
            finally:
                if collects:
                    gc.enable()
            yield ids
            waiting, size = [], 0


def encode(text: Column, vocabulary: Broadcast, chunk_chars: int = 600_000, cached_words: int = 120_000, cached_chars: int = 4_000_000) -> Column:
    """array<int> of piece ids. Null gives null, empty text an empty array; equal texts equal arrays.

    Texts go through in chunks of about ``chunk_chars`` characters; a worker keeps the words it has met
    until there are ``cached_words`` new ones, or ``cached_chars`` characters in them (of 16 bytes at most, twice), which
    bounds memory and changes no result. Beside these it holds one chunk, or one text that is longer.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for ids in _encoded(batch, vocabulary.value, chunk_chars, cached_words, cached_chars):
                yield pd.Series(ids, dtype=object)

    return run(text)


def encode_and_check(text: Column, vocabulary: Broadcast, chunk_chars: int = 600_000, cached_words: int = 120_000, cached_chars: int = 4_000_000) -> Column:
    """struct<ids, same>: as ``encode``, and whether decoding the ids gives the very text again; done in
    one worker, so that neither ids nor text go back and forth for it. Null text: null ids, same."""

    @F.pandas_udf("ids array<int>, same boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, words = 0, vocabulary.value
            for ids in _encoded(batch, words, chunk_chars, cached_words, cached_chars):
                texts = batch.iloc[at : at + len(ids)]
                at += len(ids)
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": [t is None if x is None else words.decode(x.tolist()) == t for x, t in zip(ids, texts)]})

    return run(text)


def decode(ids: Column, vocabulary: Broadcast) -> Column:
    """The text of an array of piece ids; null gives null. Inverse of ``encode`` for every text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else vocabulary.value.decode(x.tolist()) for x in batch], dtype=object)

    return run(ids)
