"""Exact token ids from the tokenizers library, with the ids of repeated chunks remembered per worker.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so the ids of a text are the ids of
its chunks in order. Chunks repeat (words), so most of them are looked up instead of encoded again. Chunks of kind ``word`` are told apart and put
together by arrays, many texts at a time: a look-up for each chunk of each text is mostly waiting for memory.
"""

from __future__ import annotations

import os
import re
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ROOM = 500_000  # remembered chunks per worker; of words, whose ids lie in an array, twice as many
_LONG = 64  # longer chunks are encoded but not remembered
_POOL = 8_000_000  # ids kept for remembered words, at most, between slices
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Beyond these letters lowering or composing text could depend on the tokenizer's own tables.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_ENDS = string.punctuation


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the
    others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()


def _letters(run: str) -> str:
    return run.encode().decode("latin-1").translate(_LETTERS)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words:
    """Ids of remembered chunks, one after the other in an array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.place.clear()
        self.pool, self.n = np.empty(1 << 16, "<u4"), 0
        self.ends = np.zeros(1 << 16, np.int64)  # chunk i begins at ends[i] and ends at ends[i + 1]
        self.met = np.zeros(1 << 16, np.int32)  # in how many slices

    def find(self, chunks: list[str]) -> np.ndarray:
        """The places of chunks, -1 for unknown ones."""
        return np.fromiter((-1 if p is None else p for p in map(self.place.get, chunks)), np.int64, len(chunks))

    def add(self, chunks: list[str], ids: list[bytes]) -> None:
        """New chunks, which get these ids."""
        self.add_flat(chunks, np.frombuffer(b"".join(ids), "<u4"), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))

    def add_flat(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """New chunks, whose ids lie one after the other and end there."""
        lo, k = self.ends[self.n], len(chunks)
        while self.n + k >= len(self.ends):
            self.ends, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.met))
        while lo + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[lo : lo + len(ids)] = ids
        self.ends[self.n + 1 : self.n + k + 1] = lo + ends
        self.place.update(zip(chunks, range(self.n, self.n + k), strict=True))
        self.n += k

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at ``places`` in turn, and where each begins (and the last ends) in them."""
        begin = self.ends[places]
        sizes = self.ends[places + 1] - begin
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])], at

    def trim(self, chunks: list[str], places: np.ndarray) -> None:
        """Forgets long ones of the last slice's chunks, and where there are too many, those that few slices had."""
        self.met[places] += 1
        for c in [c for c in chunks if len(c) > _LONG]:
            self.place.pop(c, None)
            self.place.pop(c.rstrip(_ENDS), None)
        if len(self.place) > 2 * _ROOM or self.ends[self.n] > _POOL:
            held = np.fromiter(self.place.values(), np.int64, len(self.place))
            least = 2
            while np.count_nonzero(self.met[held] >= least) > _ROOM:
                least *= 2
            kept = [c for c, often in zip(self.place, self.met[held] >= least, strict=True) if often]
            (flat, at), met = self.ids(held[self.met[held] >= least]), self.met[held[self.met[held] >= least]]
            self._clear()
            self.add_flat(kept, flat, at[1:])
            self.met[: self.n] = met // 2


class ChunkEncoder:
    """``kind``: ``byte`` for byte-level BPE, whose pieces take a leading space: cut before each single space
    that stands between two non-space characters; ``word`` for BPE that drops white space: cut at every
    space and newline. Ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.known: dict[str, bytes] = {}  # of kind byte
        self.words = _Words()  # of kind word
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self._newline = self._ids(["\n"])[0]
        if kind == "byte":  # a character of a vocabulary entry stands for a byte
            sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()}
            self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [_pack(x.ids) for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _joined_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that start with a space and end with none, encoded as one text (which is cut just
        there) and told apart by their bytes."""
        out = []
        for lo in range(0, len(chunks), 500):
            part = chunks[lo : lo + 500]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            out += [x.tobytes() for x in np.split(ids, ends[:-1])]
        return out

    def _model_ids(self, run: str) -> bytes:
        """The ids of one pre-token, which the model takes as it is."""
        if run.isascii():
            letters = _LETTERS[32] + run[1:] if run[0] == " " else run
        else:
            letters = _letters(run)
        return _pack([t.id for t in self.model.tokenize(letters)])

    def _plain(self, prefix: str, chunk: str) -> bytes | None:
        """The ids of letters, ASCII sentence marks after them or none: one pre-token and another."""
        core = chunk.rstrip(_ENDS)
        if not core.isalpha():
            if "\n" in chunk:  # a single newline between others is a pre-token
                first, *rest = chunk.split("\n")
                parts = [self._plain(prefix, first), *[self._plain("", x) for x in rest]]
                return None if None in parts else self._newline.join(parts)
            return None
        if core == chunk:
            return self._model_ids(prefix + chunk)
        marks = chunk[len(core) :]
        if marks not in self.runs:
            self.runs[marks] = self._model_ids(marks)
        return (prefix and self.known.get(core) or self._model_ids(prefix + core)) + self.runs[marks]

    def _learn(self, chunks: set[str]) -> None:
        new = []
        for c in chunks:
            if c not in self.known:
                ids = self._plain(" ", c)
                if ids is None:
                    new.append(c)
                else:
                    self.known[c] = ids
        if len(self.runs) > 10_000:
            self.runs.clear()
        odd = [c for c in new if not c or c[0].isspace() or c[-1].isspace()]
        even = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        self.known.update(zip(odd, self._ids([" " + c for c in odd]), strict=True))
        self.known.update(zip(even, self._joined_ids([" " + c for c in even]), strict=True))

    def _learn_words(self, chunks: list[str]) -> None:
        """Remembers new distinct chunks. Plain letters with sentence marks after them or none are two pre-tokens or one:
        letters and marks are remembered by themselves, so that either is encoded once."""
        words, split, odd = self.words, [], []
        for c in chunks:
            core = c.rstrip(_ENDS)
            if core.isalpha() and core.islower() and (c.isascii() or not _BEYOND_LATIN.search(c)):
                split.append((c, core, c[len(core) :]))
            else:
                odd.append(c)
        words.add(odd, self._ids(odd))
        new = list({core for _, core, _ in split if core not in words.place})
        tokenize, flat, ends = self.model.tokenize, [], []
        for core in new:
            flat += [t.id for t in tokenize(core if core.isascii() else _letters(core))]
            ends.append(len(flat))
        words.add_flat(new, np.array(flat, "<u4"), np.array(ends, np.int64))
        split = [x for x in split if x[2]]
        new = list({marks for _, _, marks in split if marks not in words.place})
        words.add(new, self._ids(new))
        flat, at = words.ids(np.array([words.place[x] for _, *both in split for x in both], np.int64))
        words.add_flat([c for c, _, _ in split], flat, at[2::2])

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """Cutting, telling chunks apart and putting ids together are done for all texts at once; a dictionary is asked
        once for each distinct chunk."""
        cut = pc.split_pattern(pa.array([(t if _BEYOND_LATIN.search(t) else t.lower()).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = self.words.find(chunks)
        new = np.flatnonzero(places < 0)
        if len(new):
            missing = [chunks[i] for i in new]
            self._learn_words(missing)
            places[new] = self.words.find(missing)
        flat, at = self.words.ids(places[coded.indices.to_numpy()])
        bounds = at[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [flat[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        self.words.trim(chunks, places)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if self.kind == "word":
            return self._encode_words(texts) if texts else []
        cut = [t.split(" ") for t in texts]
        recent = set().union(*cut)
        odd = {c for c in recent if not c or c[0].isspace() or c[-1].isspace()}
        if odd:  # not every space stands alone
            cut = [c if odd.isdisjoint(c) else _SPACE.split(t) for c, t in zip(cut, texts, strict=True)]
        heads = [self._plain("", c[0]) or self._ids([c[0]])[0] for c in cut]
        recent = set().union(*(c[1:] for c in cut)) if odd else recent
        self._learn(recent)
        out = [h + b"".join(map(self.known.__getitem__, c[1:])) for h, c in zip(heads, cut, strict=True)]
        if len(self.known) > _ROOM:
            self.known = {c: self.known[c] for c in recent}
        for c in [c for c in recent if len(c) > _LONG]:
            self.known.pop(c, None)
        return out


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """This worker's encoder; kept between tasks."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = ChunkEncoder(path, kind)
    return _encoders[path, kind]


def text_slices(texts: list[str | None], limit: int = 2_000_000):
    """(first row, texts) in slices of about ``limit`` characters; a null counts as empty."""
    lo, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= limit:
            yield lo, part
            lo, part, size = i + 1, [], 0
    if part:
        yield lo, part
