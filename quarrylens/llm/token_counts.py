"""Count-only Viterbi over a unigram vocabulary: piece counts of whole texts without building the pieces."""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
UNKNOWN = "<unk>"
_UNK_PENALTY = 10.0
_ROOM = 1_000_000  # remembered words per worker
_LONG = 64  # longer words are counted but not remembered
_WORD = re.compile("[^ \t-\r\x85\xa0  -     　]+")

COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a sentencepiece file's ordinary pieces after UNKNOWN, with the scores of the file, and whether it
    has a piece for every byte. Control and byte pieces never match text by their names."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(UNKNOWN, 0.0)] + [(model.id_to_piece(i), model.get_score(i)) for i in plain], sum(map(model.is_byte, ids)) == 256


class Counter:
    """Counts a word's best segmentation. Matches are enumerated by an Aho-Corasick automaton; the best score and
    its piece count are carried from end to end.

    Tie rules of the tokenizer: of equal scores at an end, the longest last piece wins (a later start must be
    strictly better); where no one-character piece starts, an unknown character of score (least score - 10) may
    start, considered last. With ``has_bytes`` an unknown character is a piece for each of its UTF-8 bytes, else
    neighbouring unknown characters are one piece.
    """

    def __init__(self, vocab: list[tuple[str, float]], has_bytes: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.has_bytes = has_bytes
        for piece, score in vocab:
            if piece != UNKNOWN:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - _UNK_PENALTY
        self.known: dict[str, tuple[int, int]] = {}

    def segment(self, chunk: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of one chunk."""
        n = len(chunk)
        best, pieces, unknown, ends_unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        seen = [False] * (n + 1)
        single = [False] * (n + 1)
        seen[0] = True
        at = 1

        def close(end: int) -> None:
            start = end - 1
            if not single[end]:
                score = best[start] + self.unknown
                if not seen[end] or score > best[end]:
                    more = len(chunk[start].encode()) if self.has_bytes else not ends_unknown[start]
                    best[end], pieces[end], unknown[end], ends_unknown[end], seen[end] = score, pieces[start] + more, unknown[start] + more, True, True

        for last, (size, score) in self.automaton.iter(chunk):
            end = last + 1
            while at < end:
                close(at)
                at += 1
            start = end - size
            if size == 1:
                single[end] = True
            score += best[start]
            if not seen[end] or score > best[end]:
                best[end], pieces[end], unknown[end], ends_unknown[end], seen[end] = score, pieces[start] + 1, unknown[start], False, True
        while at <= n:
            close(at)
            at += 1
        return pieces[n], unknown[n]

    def word(self, word: str) -> tuple[int, int]:
        """A word's chunks: it gets a leading META unless it has one, and is cut before each META."""
        if META not in word:
            return self.segment(META + word)
        parts = [self.segment(META + x) for x in word.removeprefix(META).split(META)]
        return sum(p for p, _ in parts), sum(u for _, u in parts)

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, pieces, unknown pieces)"""
        words = _WORD.findall(text)
        known = self.known
        if len(known) > _ROOM:
            known.clear()
        pieces = unknown = 0
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.word(w)
                if len(w) <= _LONG:
                    known[w] = found
            pieces += found[0]
            unknown += found[1]
        return len(words), pieces, unknown


@functools.cache
def _counter(model_path: str) -> Counter:
    return Counter(*vocabulary(model_path))


def count_tokens(documents: DataFrame, model_path: str) -> DataFrame:
    """n_words, n_tokens and n_unknown (tokens of unknown characters: their bytes) of every whole text by the pieces and scores
    of ``model_path``, taken as a unigram vocabulary.

    Words are cut at Unicode white space and are segmented one by one, as the tokenizer does. No shuffle; a row's
    memory is its longest word. Null and empty texts count 0; a null doc_id stays; repeated rows count once each;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            rows = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            if rows:
                yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
