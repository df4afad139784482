"""The Merkle manifest against its definition, written plainly; van Emde Boas places; the query against SQL."""

import hashlib
import random
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _climb(nodes, at=None):
    """Root, and the siblings of node ``at`` as (left, right) by level."""
    path = []
    while len(nodes) > 1:
        if at is not None:
            run = at - at % 3
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
            at //= 3
        nodes = [_hash(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], path


def _expected(rows):
    by = {}
    for r in rows:
        gone = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), _leaf(r), _leaf((*r[:4], r[4].replace("\n", ""))) if gone else _leaf(r), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    roots = [_climb([x[1] for x in by[s]])[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [x[1] for x in by[s]]
        root, high = _climb(roots, k)
        for i, (_, leaf, got, doc) in enumerate(by[s]):
            subroot, low = _climb(leaves, i)
            cur = got
            for a, b in [*low, *high]:
                cur = _hash(a, cur, b)
            out.append((doc, leaf, subroot, root, _hash(*[x for p in [*low, *high] for x in p]), cur, cur == root))
    return sorted(out, key=str)


def _rows(rng, n, sources):
    texts = [None, "", "a\nb", "plain", "é\n中\n", "x" * 200_000]
    return [(rng.choice([None, i, i, 2**62 + i, -i, 7]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice(texts)) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, at string, n string, name string"


@pytest.mark.parametrize("n, height, sources", [(0, 7, ["s"]), (1, 7, ["s"]), (2, 7, [None]), (130, 2, ["big"] * 9 + ["b", None, "Z", "é", "", "😀"]), (90, 1, list("abcdefghijklmno")), (200, 7, ["s", "t"])])
def test_manifest_equals_its_definition(spark, n, height, sources):
    rows = _rows(random.Random(n), n, sources)
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)
    got = merkle.digest(merkle.prove(docs, merkle.without_newlines(F.col("doc_id"), F.col("text")), height)).collect()
    assert sorted([tuple(r) for r in got], key=str) == _expected(rows)


@pytest.mark.parametrize("levels", range(1, 8))
def test_places_number_every_node_once_and_halves_stand_together(levels):
    found = [merkle.veb_places(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(found).tolist()) == list(range(merkle.nodes_in(levels)))
    if levels > 1:
        upper = levels // 2
        assert max(x.max() for x in found[:upper]) == merkle.nodes_in(upper) - 1
        size = merkle.nodes_in(levels - upper)
        for s in range(3**upper):  # each lower subtree is one stretch
            own = np.concatenate([found[d][s * 3 ** (d - upper) : (s + 1) * 3 ** (d - upper)] for d in range(upper, levels)])
            assert sorted((own - merkle.nodes_in(upper) - s * size).tolist()) == list(range(size))


def test_a_changed_text_does_not_verify(spark, make):
    docs = make(["one\ntwo", "three", None, ""])
    same = merkle.digest(merkle.prove(docs)).collect()
    assert len(same) == 4 and all(r.verified for r in same)
    other = {r.doc_id: r.verified for r in merkle.digest(merkle.prove(docs, F.when(F.col("doc_id") == 1, "threE").otherwise(F.col("text")))).collect()}
    assert other == {0: True, 1: False, 2: True, 3: True}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(queries.op13_merkle(spark, sf), oracle.connect(sf), queries.ORACLES["op13_merkle"]) == []
