"""The conversation trie against its definition, subtree sums against plain ones, and the query against SQL."""

import hashlib
import random
import re
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import prefix_trie, queries


def _expected(rows, family=20, heads=lambda c: zlib.crc32(str(c).encode()) % 4):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in convs.items()}
    nodes = {}
    for c in own:
        h, base = heads(c), c - (abs(c) % family) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq) == d))
    out = []
    for k, members in nodes.items():
        under = [n for n in nodes if n[: len(k)] == k]
        saved = sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        kids = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in nodes)
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.append((min(members)[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(members), kids(k), sum(not kids(n) for n in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _random(rng, n):
    texts = [None, "", "a", "b c", "\x0bd  e\x1cf", "x " * 30_000]
    return [(rng.choice([None, *range(-45, 60), *[7] * 40]), rng.choice([None, 0, 1, 2, 3, 3, 4]), rng.choice([None, "user"]), rng.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, owner string, depth string, place string, words string"


@pytest.mark.parametrize("n, local", [(0, 5), (1, 5), (120, 4), (120, 1 << 14)])
def test_trie_equals_its_definition(spark, n, local):
    rows = _random(random.Random(n), n)
    got = prefix_trie.trie(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA), local=local)
    assert sorted(tuple(r) for r in got.collect()) == _expected(rows)


def test_long_and_hot_conversations(spark):
    rows = [(c, t, "u", "same" if t < 90 else str(c)) for c in (20, 40, 60, 61) for t in range(100)]
    rows += [(c, 0, "u", "hello there") for c in range(1000, 3000)]  # more ends at one node than one text of ids takes
    got = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), heads=F.lit(0), local=50)
    assert sorted(tuple(r) for r in got.collect()) == _expected(rows, heads=lambda c: 0)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "caterpillar"])
def test_taking_apart_gives_subtree_sums(shape):
    rng, n = random.Random(2), 700
    up = [-1, *[{"random": rng.randrange(i), "chain": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else max(0, i - 2)}[shape] for i in range(1, n)]]
    kids = [[] for _ in up]
    for i, p in enumerate(up[1:], 1):
        kids[p].append(i)
    values = [[rng.randint(-9, 9), 1] for _ in up]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        want[up[i]] = [a + b for a, b in zip(want[up[i]], want[i], strict=True)]
    assert prefix_trie.take_apart([0], kids, up, values) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(queries.op11_prefix_trie(spark, sf), oracle.connect(sf), queries.ORACLES["op11_prefix_trie"]) == []
