"""Byte-level BPE by prefix dynamic programming: the last token of every byte prefix, exact appends and edits, decoding.

In a byte-level BPE every prefix of a piece has exactly one encoding, so its last token says all about it: the token
before stands at the prefix that the last one leaves. Two neighbours are valid if merging their joined bytes gives just
the two of them again, and an encoding is the one whose neighbours are all valid. So one pass over the vocabulary's
matches finds the last token of each prefix, an append goes on where the table ends, and an edit starts at the piece
that it touches.
"""

from __future__ import annotations

import base64
import functools
import re
import string
import struct
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._encode import text_slices

_ROOM = 300_000  # remembered chunks, and pieces, per worker; the last so many again stay as older ones
_LONG = 64  # longer ones are encoded but not remembered
_PAIRS = 2_000_000  # remembered pairs of neighbours per worker
_LOOSE = re.compile(r"\s (?:\s|\Z)")
_SPACE = re.compile(r"(?<=\S) | (?=\S)")


@functools.cache
def _stand_ins() -> tuple[frozenset[str], dict[int, str]]:
    """Characters that the regex module and tiktoken class differently as letters or digits (their Unicode versions
    differ), and for each a character that both class as tiktoken does."""
    import regex
    import tiktoken

    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}

    def theirs(kind: str) -> set[str]:
        found = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        return set(bytes(found.encode_ordinary(chars)).decode())

    letters, digits = theirs(r"\p{L}"), theirs(r"\p{N}")
    odd = (letters ^ set(regex.findall(r"\p{L}", chars))) | (digits ^ set(regex.findall(r"\p{N}", chars)))
    table = {ord(c): "é" if c in letters else "0" if c in digits else "!" for c in odd}
    return frozenset(odd), table


class _Pairs(dict):
    """Whether two tokens may stand side by side, by ``left << 20 | right``; worked out when first asked."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, key: int) -> bool:
        if len(self) >= _PAIRS:
            self.clear()
        found = self[key] = self.vocabulary.may_meet(key >> 20, key & 0xFFFFF)
        return found


class _Chunks(dict):
    """The ids of what follows a space; encoded when first asked."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.older.get(chunk)) is None:
            words = self.vocabulary
            letters = chunk.rstrip(string.punctuation)
            if letters.isascii() and letters.isalpha():  # letters are a match, and marks behind them another
                found = words._piece_ids(" " + letters)
                if len(letters) < len(chunk):
                    found += words._piece_ids(chunk[len(letters) :])
            else:
                found = b"".join(map(words._piece_ids, words.split_pieces(" " + chunk)))
        if len(chunk) <= _LONG:
            self[chunk] = found
        return found

    def rest(self) -> None:
        """Lets the chunks go that were not asked for since the last time that the room was full."""
        if len(self) > _ROOM:
            self.older = dict(self)
            self.clear()


class Vocabulary:
    """Ranks (``.tiktoken`` lines of base64 bytes and rank) and a pattern of letters, digits and white space whose matches
    are encoded one by one."""

    START = 0xFFFFF  # stands before a piece's first token

    def __init__(self, ranks_path: str, pattern: str):
        import ahocorasick
        import regex

        with open(ranks_path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.rank.values()) >= self.START:
            raise ValueError("ranks must be below 2**20 - 1")
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        self.matches = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.bytes[i] = token
            self.matches.add_word(token.decode("latin-1"), (i, len(token)))
        self.matches.make_automaton()
        self.longest = max(map(len, self.bytes))
        self.pairs = _Pairs(self)
        self.pattern = regex.compile(pattern)
        self.splits: dict[int, tuple[int, int] | None | bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    # Neighbours ------------------------------------------------------------------------------------------------------

    def split(self, token: int) -> tuple[int, int] | None | bool:
        """The two tokens that the last merge of ``token`` joins; None for one byte; False if merging its bytes never
        gives it."""
        if token not in self.splits:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                best = min((self.rank.get(a + b, self.START), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == self.START:
                    break
                parts[best[1] : best[1] + 2] = [self.bytes[best[0]]]
            self.splits[token] = None if len(parts) == 1 else tuple(self.rank[p] for p in parts) if len(parts) == 2 else False
        return self.splits[token]

    def may_meet(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two again. Merges go by rank, leftmost first: the tokens beside
        the border grow along the right edge of ``left`` and the left edge of ``right``, and no two that stand there at
        the same time may merge before one of them grows."""
        if self.split(right) is False:
            return False
        if left == self.START:
            return True
        lefts, rights = [left], [right]
        while (s := self.split(lefts[-1])) is not None:
            lefts.append(s[1])
        while (s := self.split(rights[-1])) is not None:
            rights.append(s[0])
        while lefts and rights:
            a, b = lefts.pop(), rights.pop()
            grow_a, grow_b = lefts[-1] if lefts else self.START, rights[-1] if rights else self.START
            joined = self.rank.get(self.bytes[a] + self.bytes[b], self.START)
            if joined < grow_a and joined <= grow_b and joined < self.START:
                return False
            if grow_a <= grow_b:  # the left one grows first
                rights.append(b)
            else:
                lefts.append(a)
        return True

    # Pieces ----------------------------------------------------------------------------------------------------------

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of ``piece``, from one byte on; ``known`` are those of its first prefixes."""
        known = known or []
        last = [*known, *[-1] * (len(piece) - len(known)), self.START]  # place -1, before the piece, is the last one
        pairs = self.pairs
        for end, (token, size) in self.matches.iter(piece.decode("latin-1"), max(0, len(known) + 1 - self.longest)):  # of one end, longest first
            if last[end] < 0 and pairs[last[end - size] << 20 | token]:
                last[end] = token
        return last[:-1]

    def back(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of a piece, from its last one backwards. A piece that is itself a token stays one."""
        if piece in self.rank:
            return [self.rank[piece]]
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[out[-1]])
        return out[::-1]

    def _piece_ids(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            raw = piece.encode()
            ids = self.back(raw, [] if raw in self.rank else self.last_tokens(raw))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= _LONG:
                self.pieces[piece] = found
        return found

    def spans(self, text: str, start: int = 0):
        """Ends of the pattern's matches from ``start`` on; they follow one another without gaps."""
        if not text.isascii():
            odd, table = _stand_ins()
            if not odd.isdisjoint(text):
                text = text.translate(table)
        return (m.end() for m in self.pattern.finditer(text, start))

    def split_pieces(self, text: str) -> list[str]:
        if text.isascii() or _stand_ins()[0].isdisjoint(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for end in self.spans(text):
            out.append(text[at:end])
            at = end
        return out

    # Texts -----------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. A match always starts at a space with another
        character before or behind it, so texts are cut there and the ids of repeated chunks are looked up."""
        out = []
        for text in texts:
            first, *cut = _SPACE.split(text) if _LOOSE.search(text) else text.split(" ")
            ids = [b"".join(map(self._piece_ids, self.split_pieces(first)))]
            ids += map(self.chunks.__getitem__, cut)
            out.append(b"".join(ids))
            self.chunks.rest()
            if len(self.pieces) > _ROOM:
                self.pieces.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    # Prefix tables ---------------------------------------------------------------------------------------------------

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the pieces (characters), and the last token of each byte prefix within its piece."""
        return self.edited("", [], [], 0, 0, text)[1:]

    def edited(self, text: str, ends: list[int], last: list[int], start: int, stop: int, new: str) -> tuple[str, list[int], list[int]]:
        """Text, ends and last tokens after characters ``start`` to ``stop`` became ``new``. Pieces that end two
        characters before ``start`` cannot change (the longest look ahead of a match is two); the first piece after
        them keeps the last tokens of its untouched prefix; from the first old end behind the edit on, all stay."""
        if not 0 <= start <= stop <= len(text):
            raise ValueError("an edit must lie within its text")
        kept = bisect_right(ends, start - 2)
        at = ends[kept - 1] if kept else 0
        whole, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        same = text[at : min(start, ends[kept]) if kept < len(ends) else at]
        byte_at, byte_end = len(text[:at].encode()), len(text.encode())
        untouched = last[byte_at : byte_at + len(same.encode())]
        fresh_ends, fresh, rest = [], [], len(ends)
        for end in self.spans(whole, at):
            piece = whole[at:end].encode()
            usable = untouched[: len(piece)] if piece[: len(untouched)] == same.encode()[: len(piece)] else []
            fresh += self.last_tokens(piece, usable)
            fresh_ends.append(end)
            at, untouched, same = end, [], ""
            if end >= start + len(new) and (i := bisect_left(ends, end - shift)) < len(ends) and ends[i] == end - shift >= stop:
                rest = i + 1
                break
        tail = len(text[ends[rest - 1] :].encode()) if rest < len(ends) else 0
        return whole, [*ends[:kept], *fresh_ends, *[e + shift for e in ends[rest:]]], [*last[:byte_at], *fresh, *(last[byte_end - tail :] if tail else [])]

    def table_ids(self, text: str, ends: list[int], last: list[int]) -> list[int]:
        out, at, byte = [], 0, 0
        for end in ends:
            piece = text[at:end].encode()
            out += self.back(piece, last[byte : byte + len(piece)])
            at, byte = end, byte + len(piece)
        return out


@functools.cache
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    """This worker's vocabulary; kept between tasks."""
    return Vocabulary(ranks_path, pattern)


_IDS = "doc_id long, n_tokens long, ids array<int>"
_TABLE = "doc_id long, text string, ends array<int>, last array<int>"


def _lists(rows: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids as a list column."""
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of every whole text, as tiktoken's ``encode_ordinary`` gives them.

    Null or empty text: no ids. Null, repeated or tied doc_ids: a row each, as they come. Other columns are ignored.
    A text may be of any length: its table needs a few bytes a byte of its longest piece. No shuffle.
    """

    def run(batches):
        words = vocabulary(ranks_path, pattern)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1).to_pylist()):
                ids = words.encode(texts)
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), _lists(ids)], names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _IDS)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the bytes of its ids in ``decoded``; null ids count as none. An id that the
    vocabulary lacks is an error."""

    def run(batches):
        words = vocabulary(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(2)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield pa.record_batch([*part.columns, pa.array(map(words.decode, np.split(ids, ends[:-1])), pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, _IDS + ", decoded binary")


def prefix_tables(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text, ends of its pieces (characters) and the last token of every byte prefix, within its piece."""

    def run(frames):
        words = vocabulary(ranks_path, pattern)
        for pdf in frames:
            found = [words.table(t or "") for t in pdf["text"]]
            yield pdf.assign(text=pdf["text"].fillna(""), ends=[e for e, _ in found], last=[x for _, x in found])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, _TABLE)


def edit(tables: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Tables after edits (doc_id, start, stop, new: characters start to stop become new; both at the text's length to
    append). Only pieces that an edit touches are encoded anew, and of the first of them only what follows its untouched
    prefix. A document with several edits gives a version for each; without any, none; a null ``new`` deletes."""
    changed = tables.select("doc_id", "text", "ends", "last").join(edits.select("doc_id", "start", "stop", "new"), "doc_id")

    def run(frames):
        words = vocabulary(ranks_path, pattern)
        for pdf in frames:
            rows = [(d, *words.edited(t, e.tolist(), x.tolist(), int(a), int(b), n or "")) for d, t, e, x, a, b, n in pdf.itertuples(index=False)]
            yield type(pdf)(rows, columns=["doc_id", "text", "ends", "last"])

    return changed.mapInPandas(run, _TABLE)


def table_tokens(tables: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of prefix tables: from each piece's last token backwards."""

    def run(frames):
        words = vocabulary(ranks_path, pattern)
        for pdf in frames:
            ids = [words.table_ids(t, e.tolist(), x.tolist()) for t, e, x in zip(pdf["text"], pdf["ends"], pdf["last"], strict=True)]
            yield type(pdf)({"doc_id": pdf["doc_id"], "n_tokens": [len(x) for x in ids], "ids": ids})

    return tables.select("doc_id", "text", "ends", "last").mapInPandas(run, _IDS)


def digest(decoded: DataFrame) -> DataFrame:
    """Digests of ids (decimal, joined by a space) and of the decoded bytes."""
    return decoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
