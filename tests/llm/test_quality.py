import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarrylens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    counts = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if counts[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def texts(n=60, seed=2):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(300)] + ["a*", "#b", "😀"]
    out = ["", None, " \n\t\n", "one", "a b c a b c", "x x x x", "same line\nsame line\n\nsame line \n", "w " * 3000, "<>|&%$*#" * 9]
    for _ in range(n):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randint(40, 300))) + ("head of the line\n" * r.choice([0, 0, 3])))
    return out


def test_base_statistics_against_brute_force(make):
    own = texts()
    rows = quality.digest(quality.judge(make(own))).collect()
    got = {r.doc_id: tuple(r)[1:7] for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(own)}
    assert not any(r.kept and r.base_failed for r in rows)


def mcd(x, p, t, prior, floors, support):
    """The least determinant over many random starts, each concentrated until it is settled; rows of the prior take part."""
    n, d = x.shape
    h = support * (n - 1)

    def estimate(w):
        y = x - p
        u = w @ y / (w.sum() + prior)
        s = ((y * w[:, None]).T @ y + prior * t) / (w.sum() + prior) - np.outer(u, u)
        return p + u, s, np.linalg.slogdet(s + np.diag(floors))[1]

    best = None
    rng = np.random.default_rng(1)
    for _ in range(30):
        w = np.zeros(n)
        w[rng.choice(n, max(1, int(h)), replace=False)] = 1.0
        m, s, det = estimate(w)
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s + np.diag(floors)), x - m)
            order = np.argsort(d2)
            w = np.zeros(n)
            w[order[: int(h)]] = 1.0
            if int(h) < n:
                w[order[int(h)]] = h - int(h)
            m, s, new = estimate(w)
            if det - new < 1e-9:
                break
            det = new
        if best is None or new < best[2]:
            best = (m, s, new)
    return best


def test_estimates_against_random_starts(spark):
    """Groups of 5, 60 and 4000 rows at once: the determinants are those of an independent search, and outliers lie far off."""
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    shape = rng.normal(size=(d, d))
    groups, p, t = {}, np.full(d, 3.0), shape.T @ shape + np.eye(d)
    for g, n in (("a", 5), ("b", 60), ("c", 4000)):
        x = rng.normal(size=(n, d)) @ shape + 3
        x[: n // 10] += 60
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, row)) for g, x in groups.items() for row in x], "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    prior = spark.createDataFrame([(g, p.tolist(), t.flatten().tolist(), 1.0) for g in groups], "grp string, p array<double>, t array<double>, p_scale double")
    floors = (1e-3,) * d
    found = {r.grp: r for r in quality.estimates(rows, prior, floors).collect()}
    limit = quality.chi2_quantile(1 - quality.REJECT, d)
    for g, x in groups.items():
        m, s, det = mcd(x, p, t, quality.PRIOR_ROWS, np.array(floors), quality.SUPPORT)
        assert found[g].det <= det + 0.01, g
        inv = np.array(found[g].inv).reshape(d, d)
        assert np.allclose(inv, np.linalg.inv(np.array(found[g]["cov"]).reshape(d, d) + np.diag(floors)), atol=1e-6)
        d2 = np.einsum("ij,jk,ik->i", x - found[g]["mean"], inv, x - found[g]["mean"]) / found[g].scale
        assert (d2[: len(x) // 10] > limit).all() and (d2[len(x) // 10 :] < limit).all(), g


def test_outliers_go_and_columns_stay(make):
    r = random.Random(1)
    words = [f"word{k}" for k in range(900)]
    own = [" ".join(r.choices(words, k=r.randint(80, 200))) for _ in range(700)]
    own += [" ".join(w + "#$%*" * 12 for w in r.choices(words, k=120)) for _ in range(5)] + ["short", None]
    df = make(own)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(700))


def test_empty_and_null_groups(spark, make):
    assert quality.judge(make([])).count() == 0
    df = make([(None, "a " * 60), (1, "b c"), (1, "b c")]).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert quality.judge(df).count() == 3
    long = "x" * 300_000 + " " + " ".join(f"w{k}" for k in range(200_000))
    found = quality.judge(make([long, None, ""])).collect()
    assert max(r.n_words for r in found) == 200_001 and sum(r.kept for r in found) == 1


def test_rare_languages_and_small_tables_are_judged(spark, make):
    """Every passing document has a distance, and a planted outlier goes: in a language with too few rows beside a large
    one, in several rare languages, and in a table smaller than any group."""
    r = random.Random(6)
    words = [f"word{k}" for k in range(900)]
    clean = lambda n: [" ".join(r.choices(words, k=r.randint(80, 200))) for _ in range(n)]
    noisy = lambda: " ".join(w + "#$%*" * 12 for w in r.choices(words, k=120))
    for sizes in ({"de": 30, "en": 300, "es": 1}, {"en": 12}):
        rows = [(lang, t) for lang, n in sizes.items() for t in clean(n)]
        bad = [(lang, noisy()) for lang, n in sizes.items() if n > 1]
        df = spark.createDataFrame([(i, t, lang, f"s{i % 7}") for i, (lang, t) in enumerate(rows + bad)], "doc_id long, text string, lang string, source string")
        found = quality.judge(df).collect()
        assert all(x.distance is not None for x in found)
        assert {x.doc_id for x in found if x.kept} == set(range(len(rows))), sizes


def test_repeated_lines_alone_reject(make):
    """Among texts without repeats, one of three lines in five repeated goes, though the base rule leaves it; one repeat stays."""
    r = random.Random(8)
    words = [f"word{k}" for k in range(900)]
    own = ["\n".join(" ".join(r.choices(words, k=8)) for _ in range(r.randint(12, 22))) for _ in range(120)]
    short = lambda n, times: "\n".join([f"again{k}" for k in range(n)] * times)
    own += [own[0] + "\n" + short(8, 5), own[1] + "\n" + short(1, 2)]
    found = {x.doc_id: x for x in quality.judge(make(own)).collect()}
    assert not any(x.base_failed for x in found.values()) and found[120].n_dup_lines == 32
    assert [i for i, x in found.items() if not x.kept] == [120]


def test_estimates_run_without_whole_stage_code(spark, monkeypatch):
    """The driver compiles no code for the many steps of the estimates; the session's setting is as before after them."""
    key, seen = "spark.sql.codegen.wholeStage", []
    monkeypatch.setattr(quality, "_fit", lambda stats: seen.append(spark.conf.get(key)) or stats, raising=False)
    before = spark.conf.get(key)
    quality.fit(spark.range(1))
    assert seen == ["false"] and spark.conf.get(key) == before
