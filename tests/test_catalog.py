"""Every registered query against the same question in SQL."""

import re

import oracle
import pytest

import __spark_entry__
from quarrylens.functions import lexical
from quarrylens.plans import catalog, catalog_programs, catalog_reviews, catalog_views  # noqa: F401 (they register their queries)

SF = "/root/testdata/sf0.001"


#: Queries that SQL cannot express, and what compares them.
PLAIN = {"lexical_metrics": "test_lexical_metrics_of_documents", "lexical_findings": "test_lexical_findings_of_documents"}


def _documents(con):
    return con.execute("SELECT CAST(doc_id AS VARCHAR), text FROM documents").fetchall()


def _lines(text):
    return text.splitlines()


def test_lexical_metrics_of_documents(spark, con):
    got = {r.file: r for r in catalog.QUERIES["lexical_metrics"](spark, SF).collect()}
    assert len(got) == len(_documents(con))
    for file, text in _documents(con):
        r, code = got[file], lexical.mask_text(text)
        lines, masked = _lines(text), _lines(code)
        depth = deepest = 0
        for line in masked:
            deepest = max(deepest, depth + line.count("{"))
            depth = max(0, depth + line.count("{") - line.count("}"))
        norm = [n for n in (re.sub(r"\s+", "", x) for x in masked) if len(n) >= 4]
        includes = set(re.findall(r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]', text))
        heads = [m for m in re.finditer(lexical.FUNCTION_HEAD, code, re.M)]
        assert (r.physical_lines, r.code_lines, r.blank_lines) == (len(lines), sum(bool(x.strip()) for x in masked), sum(not x.strip() for x in lines))
        assert r.comment_lines == sum(bool(a.strip()) and not b.strip() for a, b in zip(lines, masked, strict=True))
        assert (r.max_brace_depth, r.duplicate_lines, r.normal_lines, r.include_count, r.function_count) == (deepest, len(norm) - len(set(norm)), len(norm), len(includes), len(heads))


def test_lexical_findings_of_documents(spark, con):
    """Prose holds no finding but dangerous calls and assignments in conditions, whose patterns need no declaration."""
    want = set()
    for file, text in _documents(con):
        for k, line in enumerate(_lines(lexical.mask_text(text)), 1):
            want |= {(file, "DG001", k, m.start() + 1) for m in re.finditer(lexical.DANGEROUS_CALL, line)}
            want |= {(file, "DG004", k, m.start() + 1) for m in list(re.finditer(lexical.CONDITION_ASSIGNED, line))[:1]}
            assert not any(re.search(p, line) for p in (lexical.ARRAY_DECLARED, lexical.ALLOCATED, lexical.NULL_DECLARED, lexical.SCALAR_DECLARED, lexical.FILE_OPENED))
    assert {(r.file, r.rule_id, r.line, r.column) for r in catalog.QUERIES["lexical_findings"](spark, SF).collect()} == want


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert oracle.compare(df, con, catalog.ORACLES[name]) == []
    else:
        assert name in PLAIN  # compared with plain Python below


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
