"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates all pieces of the vocabulary that end at
each character; dynamic programming carries, for each end, the best score and
the number of pieces of the path that has it. No path is kept.

Ties follow the tokenizer: it goes through starts from left to right and lets a
piece replace another only if its path scores more. So among paths of equal score
to the same end the one whose last piece is longest stays. A character that is
no piece costs the lowest score less 10, comes after all other candidates, and
counts as one piece for each of its UTF-8 bytes if the vocabulary has byte
pieces, else as one.

Text is prepared like the tokenizer does: a space is put before it and spaces
become a visible mark. No piece has the mark after another character, so the best
paths of the stretches of marks and other characters after them make up the
whole text's; their counts are kept in a cache of bounded size. Scores are summed
exactly. A vocabulary that has such a piece is counted without stretches.

Defined results: null and empty texts have 0 pieces; equal texts have equal
counts; repeated rows and other columns are kept; an empty table gives no rows;
time is linear in the text, and memory a few words of the machine a character of
the longest stretch without white space.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")
#: Stretches whose counts a worker keeps, and the longest that it keeps.
CACHED, CACHED_CHARS = 1 << 19, 32


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class CountViterbi(dict):
    """Counts by stretch; a missing one is computed."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        super().__init__()
        self.whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self.byte_pieces, self.singles = byte_pieces, {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def viterbi(self, text: str) -> int:
        """The number of pieces of the best path."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            best = pieces = None
            # The automaton gives the longest piece that ends here first.
            while ahead is not None and ahead[0] < end:
                size, worth = ahead[1]
                path = score[end - size] + worth
                if best is None or path > best:
                    best, pieces = path, count[end - size] + 1
                ahead = next(matches, None)
            if text[end - 1] not in self.singles:
                path = score[end - 1] + self.unknown
                if best is None or path > best:
                    best, pieces = path, count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.byte_pieces else 1)
            score[end], count[end] = best, pieces
        return count[n]

    def __missing__(self, stretch: str) -> int:
        n = self.viterbi(stretch)
        if len(stretch) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[stretch] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return self.viterbi(marked) if self.whole else sum(map(self.__getitem__, _STRETCH.findall(marked)))


@lru_cache(maxsize=2)
def counter(path: str) -> CountViterbi:
    """The counter for a vocabulary file: its pieces and scores, as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return CountViterbi({model.id_to_piece(i): model.get_score(i) for i in plain}, any(map(model.is_byte, ids)))


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of pieces of a text column."""
    path = path or default_model()
    small_batches(SparkSession.active())

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        count = counter(path).count
        return pa.array([count(t) for t in texts.to_pylist()], type=pa.int64())

    return run(text)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The number of pieces and characters of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
