"""The pipeline over the small tables: each stage's decisions take effect on what its predecessor kept."""

import re

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from quarrylens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, now, SF)
        assert rows.columns == docs.columns, name
        now = spark.createDataFrame(rows.collect(), docs.schema)
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    texts = {r.doc_id: r.text for r in now.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    totals: dict[int, int] = {}
    for p in pieces:
        totals[p.doc_id] = totals.get(p.doc_id, 0) + p.length
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert totals == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_run_writes_and_rereads_each_stage(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("benchmark_decontamination", "packing")])
    got = corpus_pipeline.run(spark, SF)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    clean = corpus_pipeline.benchmark_decontamination(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_documents(spark, make, name):
    df = make([(None, None), (1, ""), (1, ""), (2, "word " * 70), (3, " \n")])
    assert dict(corpus_pipeline.STAGES)[name](spark, df, SF).count() >= 0
    assert dict(corpus_pipeline.STAGES)[name](spark, df.limit(0), SF).count() == 0


def kept_at(texts, percent):
    """The least id of each group of texts linked at 100 * intersection >= percent * union of five-word shingles, and
    the number of links, by brute force."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links, ids = {i: i for i in sets}, 0, sorted(sets)

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = len(sets[i]), len(sets[j])
            if 100 * min(a, b) < percent * max(a, b) or not a:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (a + b - both):
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}, links


def test_near_copies_from_similarity_0_8_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, links = kept_at({r.doc_id: r.text for r in docs.collect()}, 80)
    strict, fewer = kept_at({r.doc_id: r.text for r in docs.collect()}, 85)
    assert links > fewer and len(want) < len(strict)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()} == want
