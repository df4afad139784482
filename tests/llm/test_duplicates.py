import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quarrylens.llm import near_dup, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(30, 160))) for _ in range(25)]
    passage = " ".join(r.choices(words, k=70))
    out = []
    for i in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.4:
            k = r.randrange(len(t))
            t[k:k] = passage.split(" ")[r.randrange(20) : r.randrange(40, 70)]
        out.append((i * 3, ("\n" if i % 2 else " ").join(t).title() if i % 5 == 0 else " ".join(t)))
    out += [(1000, ""), (1001, None), (1002, "one two"), (1003, "ONE two"), (1004, "a b c d e"), (1005, "same " * 200), (1006, "same " * 210), (1007, " \n\t "), (1008, "x y " * 60)]
    return out


def sets(texts):
    out = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def components(texts):
    s = sets(texts)
    parent = {i: i for i in s}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("block", [near_dup.BLOCK_SHINGLES, 150])
def test_near_duplicates_against_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.digest(near_dup.near_duplicates(make(texts))).collect()}
    assert got == components(texts)


def test_keep_one_leaves_one_of_each_group(make):
    texts = corpus()
    df = make(texts)
    out = near_dup.keep_one(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, _, kept) in components(texts).items() if kept}


def test_near_duplicates_of_odd_tables(make):
    assert near_dup.near_duplicates(make([])).count() == 0
    rows = near_dup.near_duplicates(make([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "z")])).collect()
    assert sorted((r.component_id, r.kept) for r in rows) == [(4, False), (4, True), (4, True), (5, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2600], x[200:]
    ra, rb, ru = near_dup.registers(a), near_dup.registers(b), near_dup.registers(x)
    assert (np.maximum(ra, rb) == ru).all()
    equal, more = np.array([(ra == rb).sum()]), np.array([(rb < ra).sum()])
    slope = lambda j: near_dup._slope(j, len(a), np.array([float(len(b))]), more, near_dup.REGISTERS - equal - more, equal)[0]
    assert slope(0.7) > 0 > slope(0.95)  # the truth is 0.8


def removed(texts):
    first, out = {}, {}
    for i, t in sorted(texts):
        w = WORD.findall(t or "")
        drop = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in first:
                drop[k : k + 20] = [True] * 20
            else:
                first[window] = i
        kept = [x for x, d in zip(w, drop, strict=True) if not d]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("salt", "hot"), [(repeats.SALT_SEGMENTS, repeats.HOT_SHARE), (2, 1)])
def test_repeats_against_brute_force(make, monkeypatch, salt, hot):
    monkeypatch.setattr(repeats, "SALT_SEGMENTS", salt)
    monkeypatch.setattr(repeats, "HOT_SHARE", hot)
    texts = corpus(5)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.digest(repeats.remove_repeats(make(texts))).collect()}
    assert got == removed(texts)
    assert collections.Counter(v[1] > 0 for v in got.values())[True] > 20


def test_repeats_of_odd_tables(make):
    assert repeats.remove_repeats(make([])).count() == 0
    long = " ".join(f"v{k}" for k in range(40))
    rows = repeats.remove_repeats(make([(None, long), (1, long), (2, long), (2, long), (3, "x")])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in rows) == [(-1, 0), (1, 40), (2, 40), (2, 40), (3, 0)]


def test_marks_come_from_the_automaton(make, monkeypatch):
    """Without occurrences from the automaton nothing is removed."""
    import pyarrow as pa

    segment = {"did": 5, "th": 0, "lo": 3, "words": " ".join(f"a{k}" for k in range(22))}
    pattern = {"did": 1, "th": 0, "lo": 0, "words": " ".join(f"a{k}" for k in range(21)), "starts": [1]}
    found = repeats.locate(pa.Table.from_pylist([segment]), pa.Table.from_pylist([pattern], pa.schema([("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int32()))])))
    assert found.to_pylist() == [{"did": 5, "th": 0, "lo": 4, "hi": 24}]
    monkeypatch.setattr(repeats, "_shards", lambda batches: (repeats._FOUND.empty_table().to_batches() for _ in ()))
    twice = " ".join(f"b{k}" for k in range(60))
    assert {r.n_removed for r in repeats.remove_repeats(make([twice, twice])).collect()} == {0}


def test_shards_hold_segments_until_all_patterns_have_passed(monkeypatch):
    """Any size of held rows, and any cut into batches, gives the same occurrences."""
    import pyarrow as pa

    schema = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int32()))])
    rows = []
    for h in range(6):
        text = lambda v: " ".join(f"s{h}-{v}-{k}" for k in range(24))  # noqa: E731, B023
        rows += [dict(h=h, salt=0, kind=0, did=10 + d, th=0, lo=d, words=text(d % 3), starts=None) for d in range(7)]
        rows += [dict(h=h, salt=0, kind=1, did=10 + v, th=0, lo=v, words=text(v), starts=[v, v + 2] if v else None) for v in range(3)]
    table = pa.Table.from_pylist(rows, schema)
    out = []
    for held, size in ((20_000, 1000), (3, 4), (1, 1), (9, 2)):
        monkeypatch.setattr(repeats, "HELD_ROWS", held)
        out.append(sorted(tuple(r.values()) for b in repeats._shards(table.to_batches(size)) for r in b.to_pylist()))
    assert out[0] and all(x == out[0] for x in out)


def test_repeats_of_a_very_long_text(make):
    words = " ".join(f"v{k}" for k in range(150_000))
    rows = {r.doc_id: r.n_removed for r in repeats.remove_repeats(make([words, "head " + words[:600_000], words[-300:]])).collect()}
    assert rows[0] == 0 and rows[1] == len(words[:600_000].split()) - 1 * (not words[600_000 - 1 : 600_001].count(" ")) and rows[2] > 20
