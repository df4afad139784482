import random
import re

import numpy as np
import pytest

from quarrylens.llm import decontaminate


def greedy(a, b, least):
    """String tiling by definition: all longest matches of unmarked words, again and again."""
    ua, ub, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and ua[i + k] and ub[j + k] and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, k)
        if best < least:
            return total
        for i in range(len(a) - best + 1):
            for j in range(len(b) - best + 1):
                if all(ua[i + k] and ub[j + k] and a[i + k] == b[j + k] for k in range(best)):
                    for k in range(best):
                        ua[i + k] = ub[j + k] = False
                    total += best


def test_tiles_against_definition():
    r = random.Random(6)
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randint(0, 30))]
        b = [r.randrange(6) for _ in range(r.randint(0, 45))]
        if a and r.random() < 0.7:
            k = r.randrange(len(a))
            b[10:10] = a[k:] + a[:k]
        found = decontaminate.tiles(np.array(a, np.uint64) + 9, np.array(b, np.uint64) + 9, 3)
        assert sum(n for *_, n in found) == greedy(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards juggle bright green lamps near a quiet harbour"


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(7, ITEM, 1), (8, "too short", 1), (9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")


def docs():
    w = ITEM.split()
    moved = " ".join(w[10:] + ["between"] + w[:10])
    return [f"Start. {ITEM.title()}, end", f"x {moved} y", "too short but clean " * 5, None, "", " ".join(w[:8]) + " and nothing else of it", ITEM.replace(" ", "\n") * 2, "clean " * 4000 + ITEM, " ".join(reversed(w))]


def test_copies_and_moved_passages_are_caught(make, items):
    got = decontaminate.contaminated(make(docs()), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 7), (1, 7), (6, 7), (7, 7)]
    assert all(r.covered >= decontaminate.COVERAGE * r.item_words for r in got)


def test_clean_rows_stay_whole(make, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_ROW", 1)
    df = make(docs())
    out = decontaminate.keep_clean(df, items)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {2, 3, 4, 5, 8}


def test_empty_tables(make, items):
    assert decontaminate.contaminated(make([]), items).count() == 0
    assert decontaminate.contaminated(make(docs()), items.limit(0)).count() == 0
    assert decontaminate.keep_clean(make(docs()), items.limit(0)).count() == len(docs())


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def by_definition(docs, items):
    """Every document and item, tiled word by word."""
    out = []
    for i, t in docs:
        for k, x in items:
            a, b = words_of(x), words_of(t)
            if len(a) < 5:
                continue
            covered = greedy(a, b, 5)
            if covered >= 0.6 * len(a):
                out.append((i, k, covered, len(a)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, make, monkeypatch, seed):
    """Few words, so that seeds recur within items, between items and in most documents; null ids, repeated rows, ties; in the
    second and third run all seeds of three rows or more are hot."""
    if seed:
        monkeypatch.setattr(decontaminate, "SALT_ROWS", 2)
        monkeypatch.setattr(decontaminate, "HOT_SHARE", 1 << 40)
        monkeypatch.setattr(decontaminate, "ITEMS_A_ROW", seed)
    r = random.Random(seed)
    pool = ["one", "Two", "three", "é4"]
    line = lambda n: [r.choice(pool[: r.choice((1, 2, 4))]) for _ in range(n)]
    items = [(r.choice((None, 1, 2, 3)), " ".join(line(r.randint(0, 24)))) for _ in range(12)]
    items += [items[0], (9, None), (9, "two " * 25)]
    docs = []
    for _ in range(25):
        own = line(r.randint(0, 20))
        if r.random() < 0.7:
            w = words_of(r.choice(items)[1])
            k = r.randint(0, len(w))
            own += w[k:] + line(1) + w[:k] + line(2)
        docs.append((r.choice((None, *range(9))), r.choice((" ", ", ", "\n")).join(own)))
    docs += [docs[0], docs[1], (5, None), (5, ""), (6, docs[2][1])]
    table = spark.createDataFrame([(*x, 0, "h") for x in items], "item_id long, text string, did int, seed string")
    got = decontaminate.contaminated(make(docs), table).collect()
    want = by_definition(docs, items)
    assert want and sorted(((x.doc_id, x.item_id, x.covered, x.item_words) for x in got), key=str) == want
    bad = {(i, t) for i, t in docs if by_definition([(i, t)], items)}
    kept = decontaminate.keep_clean(make(docs), table)
    assert kept.columns == make(docs).columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted((x for x in docs if x not in bad), key=str)


def test_very_long_text(make, items):
    """A million words that share seeds with the item everywhere, and the item itself at the end."""
    w = ITEM.split()
    near = (" ".join(w[:6]) + " clean ") * 143_000
    got = decontaminate.contaminated(make([near, near + ITEM, near + " ".join(w[8:] + ["x"] + w[:8])]), items).collect()
    assert sorted((r.doc_id, r.covered, r.n_tiles) for r in got) == [(1, 20, 1), (2, 20, 2)]


def test_the_whole_query_against_brute_force(spark):
    from quarrylens.llm.queries import op7_decontaminate

    sf = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    seeds = lambda t: {tuple(w[k : k + 5]) for w in (words_of(t),) for k in range(len(w) - 4)}
    of_items = [(k, x, seeds(x)) for k, x in items]
    want = []
    for i, t in docs:
        own = seeds(t)
        want += by_definition([(i, t)], [(k, x) for k, x, s in of_items if own & s])
    got = op7_decontaminate(spark, sf).collect()
    assert want and sorted(((x.doc_id, x.item_id, x.covered, x.item_words) for x in got), key=str) == sorted(want, key=str)
