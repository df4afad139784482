import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from quarrylens.llm import packing, token_counts, token_files

TEXTS = [(5, "Hello there, world.\nAgain"), (2, None), (9, ""), (7, "word " * 5000), (None, "no id"), (3, "Ünï 日本 😀 x\n\n y"), (5, "Hello there, world.\nAgain")]


def path(name):
    return str(public_tokenizers.path(name))


def whole(name):
    t = Tokenizer.from_file(path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_each_id_once(make):
    ids = whole("word_bpe_49k.json")
    rows = packing.digest(packing.pack(make(TEXTS), path("word_bpe_49k.json"))).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    for doc_id in {i for i, _ in TEXTS}:
        want = ids(dict(TEXTS)[doc_id]) + [1]
        own = [r for r in rows if r.doc_id == doc_id]
        copies = sum(i == doc_id for i, _ in TEXTS)
        assert sorted((r.start, r.length) for r in own)[::copies] == sorted({(r.start, r.length) for r in own})
        at = 0
        for start, length, check in sorted({(r.start, r.length, r.ids_crc32) for r in own}):
            assert start == at and check == crc(want[at : at + length])
            at += length
        assert at == len(want) and {r.doc_tokens for r in own} == {at}


def test_binary_lengths():
    assert packing.binary_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    assert packing.binary_lengths(1) == [1]


def test_token_files_round_trip(make):
    ids = whole("byte_bpe_50k.json")
    rows = token_files.digest(token_files.round_trip(make(TEXTS), path("byte_bpe_50k.json"))).collect()
    want, at = [], 0
    for doc_id, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        own = ids(text) + [0]
        want.append((doc_id, at, len(own), crc(own)))
        at += len(own)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want


def test_empty_tables(make):
    assert packing.pack(make([]), path("word_bpe_49k.json")).count() == 0
    assert token_files.round_trip(make([]), path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(make([]), path("piece_bpe_32k.model")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    """The file's own pieces and scores, read without the operator's code."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    return [(m.id_to_piece(i), m.get_score(i), m.is_byte(i), m.is_control(i) or m.is_unknown(i)) for i in range(m.get_piece_size())]


@pytest.fixture(scope="module")
def unigram(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(p, s) for p, s, _, special in pieces if not special], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return t


COUNTED = ["", None, "  a  b", "▁a▁▁b ▁", "日本語 emoji😀😀 x😀y", "Ａ ңң Ａ😀Ａ", "a\x1cb c\x85d e f", "𝕏𝕐 \t\r\n z", "international counterrevolutionary " * 40, "x" * 500, "om 1234 (very) [odd], isn't it?"]


def test_counts_equal_the_tokenizer(make, unigram, pieces):
    byte = {f"<0x{k:02X}>" for k in range(256)}
    got = {r.doc_id: r for r in token_counts.count_tokens(make(COUNTED), path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(COUNTED):
        own = unigram.encode(t or "", add_special_tokens=False).tokens
        assert (got[i].n_tokens, got[i].n_unknown) == (len(own), sum(x in byte for x in own)), t
    assert got[5].n_unknown == 9


def test_counts_equal_an_independent_program(pieces):
    """A plain dynamic program over all substrings, by the file's scores."""
    score = {p: s for p, s, is_byte, special in pieces if not is_byte and not special}
    least = min(score.values()) - 10

    def count(chunk):
        best = [(0.0, 0)] + [None] * len(chunk)
        for end in range(1, len(chunk) + 1):
            ways = [(best[a][0] + score[chunk[a:end]], best[a][1] + 1) for a in range(max(0, end - 64), end) if chunk[a:end] in score]
            if chunk[end - 1] not in score:
                ways.append((best[end - 1][0] + least, best[end - 1][1] + len(chunk[end - 1].encode())))
            top = max(w[0] for w in ways)
            best[end] = next(w for w in ways if w[0] == top)  # of ties the longest last piece
        return best[-1][1]

    c = token_counts.Counter(*token_counts.vocabulary(path("piece_bpe_32k.model")))
    for t in COUNTED:
        words = [w for w in (t or "").replace("\x1c", " ").replace("\x85", " ").split() if "▁" not in w]
        for w in words:
            assert c.text(w)[1] == count("▁" + w), w


def test_counts_of_long_texts_repeats_and_null_ids(make):
    rows = token_counts.count_tokens(make([(1, "ab " * 300_000), (None, "x" * 200_000), (2, "a"), (2, "a")]), path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 1), (1, 300_000), (2, 1), (2, 1)]


def test_ties_take_the_longest_last_piece():
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bb", -2.0), ("▁ab", -3.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    c = token_counts.Counter(vocab)
    for text in ("ab", "abb", "bba", "aabbab", "b?b", "??a"):
        assert c.text(text)[1] == len(t.encode(text, add_special_tokens=False).ids), text
