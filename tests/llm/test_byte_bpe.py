"""Byte-level BPE against the tiktoken library: encoding, decoding, prefix tables, appends and edits."""

import base64
import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarrylens.llm import byte_bpe, queries  # noqa: E402

PATTERN = public_tokenizers.PATTERN
PIECES = ["a", "b", "'", "s", " ", "\n", "é", "0", "1", "՘", "\U0003fc3b", "中", "😀", "\t", "the", "ing", "'re", "aaaa", "   ", "\x1c", " ", "ſ"]


def _path(name):
    return str(public_tokenizers.path(name))


def _theirs(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random(rng, most=30):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encode_and_decode(spark, make, name):
    rng, path = random.Random(3), _path(name)
    texts = [None, "", " ", "<|endoftext|>", "x" * 30_000, " " * 5_000, "etaoin" * 2_000, "ab " * 20_000 + "\n \n", *[_random(rng) for _ in range(1500)]]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x100, 0x2000), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    theirs, docs = _theirs(path), make([*enumerate(texts), (None, "no id"), (7, texts[7]), (7, "again")])
    got = byte_bpe.decode(byte_bpe.encode(docs, path, PATTERN), path, PATTERN).collect()
    assert len(got) == len(texts) + 3
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in [*texts, "no id", texts[7], "again"])
    for r in got:
        assert r.ids == theirs.encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(r.ids)
    assert byte_bpe.encode(make([]), path, PATTERN).count() == 0


def test_every_neighbour_pair_is_judged_as_by_merging():
    path = _path("byte_bpe_50k.tiktoken")
    words, theirs, rng = byte_bpe.Vocabulary(path, PATTERN), _theirs(path), random.Random(4)
    tokens = rng.sample(range(50_256), 1500)
    for a, b in zip(tokens, tokens[1:], strict=False):
        joined = words.bytes[a] + words.bytes[b]
        if joined not in words.rank:
            assert words.may_meet(a, b) == (theirs._core_bpe.encode_single_piece(joined) == [a, b])


def test_prefix_table_holds_the_last_token_of_every_prefix():
    path = _path("byte_bpe_50k.tiktoken")
    words, theirs = byte_bpe.Vocabulary(path, PATTERN), _theirs(path)
    for piece in ("unbelievable", " hippopotamuses", "aaaaaaaaaaaaa", "antidisestablishmentarianism"):
        last = words.last_tokens(piece.encode())
        for n in range(1, len(piece) + 1):
            assert last[n - 1] == theirs._core_bpe.encode_single_piece(piece[:n].encode())[-1]
            assert words.last_tokens(piece.encode(), last[:n]) == last  # goes on from any prefix


def test_appends_and_edits_equal_a_new_encoding(spark, make):
    path, rng = _path("byte_bpe_50k.tiktoken"), random.Random(5)
    texts = [_random(rng) for _ in range(400)]
    edits, want, theirs = [], [], _theirs(path)
    for i, t in enumerate(texts):
        a = len(t) if i % 3 == 0 else rng.randint(0, len(t))
        b, new = (a, _random(rng, 5)) if i % 3 == 0 else (rng.randint(a, len(t)), _random(rng, 4))
        edits.append((i, a, b, new))
        want.append((i, theirs.encode_ordinary(t[:a] + new + t[b:])))
    tables = byte_bpe.prefix_tables(make(texts), path, PATTERN)
    changed = byte_bpe.edit(tables, spark.createDataFrame(edits, "doc_id long, start int, stop int, new string"), path, PATTERN)
    got = {r.doc_id: list(r.ids) for r in byte_bpe.table_tokens(changed, path, PATTERN).collect()}
    assert got == dict(want)
    assert {r.doc_id: (r.ends, r["last"]) for r in changed.collect()} == {r.doc_id: (r.ends, r["last"]) for r in byte_bpe.prefix_tables(make([t[:a] + n + t[b:] for t, (_, a, b, n) in zip(texts, edits, strict=True)]), path, PATTERN).collect()}


def test_an_edit_encodes_only_near_it():
    path = _path("byte_bpe_50k.tiktoken")
    words = byte_bpe.Vocabulary(path, PATTERN)
    text = "one two three " * 2000
    ends, last = words.table(text)
    seen, plain = [], words.last_tokens
    words.last_tokens = lambda piece, known=None: seen.append(len(piece) - len(known or [])) or plain(piece, known)
    whole, ends, last = words.edited(text, ends, last, 14_005, 14_006, "xy")
    assert sum(seen) < 30 and words.table_ids(whole, ends, last) == _theirs(path).encode_ordinary(whole)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    theirs = _theirs(_path("byte_bpe_50k.tiktoken"))
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = queries.op12_byte_bpe(spark, sf).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
