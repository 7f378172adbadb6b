"""Token counts of a unigram tokenizer, without its tokens.

Aho-Corasick finds every vocabulary piece in a word; dynamic programming over the word's
characters carries the best score and the number of pieces.  Ties follow the tokenizer:
a later candidate wins only with a strictly better score, and candidates come by start, so
the longest piece keeps a tie.  A character with no piece of its own takes the unknown score
(lowest score less 10) and counts as its UTF-8 bytes (byte fallback).  Words begin at each
space mark, as in the tokenizer's pre-tokenizer, so each distinct word is counted once per worker.

The public files hold no unigram model; ``load_vocabulary`` takes the pieces of a
SentencePiece file in rank order and gives them the log probabilities of Zipf's law.

Defined cases: a null or empty text has no tokens; repeated rows are counted alike; an
empty table gives no rows; long texts are counted whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_PIECE = "￿￿"

#: Counted words that a worker keeps, and the length of the longest.
CACHE_WORDS, CACHE_CHARS = 500_000, 48

_counters: dict[str, "UnigramCounter"] = {}


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) in id order; the unknown piece, first, has no surface form."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / r for r in range(1, n + 1)))
    pieces = [UNKNOWN_PIECE if model.is_unknown(i) else model.id_to_piece(i) for i in range(n)]
    # control and byte pieces stand before the ranked ones and get the lowest score
    first = next(i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [(p, -math.log(i - first + 1 if i >= first else n) - total) for i, p in enumerate(pieces)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.words: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        n = len(word)
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.matches.iter(word):
            by_end[end].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, found in enumerate(by_end, 1):
            top, pieces, single = -math.inf, 0, False
            for length, score in sorted(found, reverse=True):
                single = single or length == 1
                if (candidate := score + best[end - length]) > top:
                    top, pieces = candidate, count[end - length] + 1
            if not single and (candidate := self.unknown + best[end - 1]) > top:
                top, pieces = candidate, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, pieces
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", SPACE_MARK)
        words = (words[1:] if words[0] == SPACE_MARK else words).split(SPACE_MARK)
        known = self.words
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count_word(SPACE_MARK + w)
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


def counter(path: str) -> UnigramCounter:
    """One counter per worker and vocabulary, kept between tasks."""
    if path not in _counters:
        _counters[path] = UnigramCounter(load_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars and n_tokens of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_text = counter(vocabulary)
        for batch in batches:
            n = [count_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array(n, "int64")], ["doc_id", "n_chars", "n_tokens"]
            )

    thin = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
        F.col(text).alias("text"),
    )
    return thin.mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
