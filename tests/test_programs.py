"""Control flow, graph records, renaming, pairs and digests against plain definitions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import control_flow, lexical, renaming
from quarrylens.operators import digest, facts, pairs, program_graphs, reports


def _flows(spark, *texts):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")
    return {(r.file, r.function): r for r in control_flow.control_flow(lexical.prepare(files)).collect()}


def test_control_flow_of_kinds_and_of_comments(spark):
    text = "int g;\nint f(int a) {\n  // return in a comment\n  if (a) {\n    return a;\n  }\n  for (;;) a++; \n  puts(\"if (x)\");\n}\nvoid empty() { }\nvoid open() {\n  switch (1) {"
    got = _flows(spark, text, None, "", "no function")
    assert set(got) == {("f0", "f"), ("f0", "empty"), ("f0", "open")}
    f = got["f0", "f"]
    start = f.start_line
    prefix = f"f0:f:{start}"
    assert [(n.node_id.removeprefix(prefix), n.kind, n.line - start) for n in f.nodes] == [(":entry", "entry", 0), (":n1", "branch", 2), (":n2", "return", 3), (":n3", "loop", 5), (":n4", "statement", 6), (":exit", "exit", f.end_line - start)]
    assert [(e.source.removeprefix(prefix), e.target.removeprefix(prefix), e.kind) for e in f.edges] == [
        (":entry", ":n1", "next"), (":n1", ":n2", "next"), (":n1", ":n3", "false-approx"), (":n2", ":exit", "return"), (":n3", ":n4", "next"), (":n3", ":exit", "false-approx"), (":n4", ":exit", "next"),
    ]
    assert f.nodes[3].label == "for (;;) a++;"
    assert [(e.source.split(":")[-1], e.target.split(":")[-1], e.kind) for e in got["f0", "empty"].edges] == [("entry", "exit", "next")]
    assert [n.kind for n in got["f0", "open"].nodes] == ["entry", "branch", "exit"]


def test_a_long_function_and_a_long_line(spark):
    got = _flows(spark, "void f() {\n" + "x = 1;\n" * 20_000 + "y" * 500 + "\n}\n")["f0", "f"]
    assert len(got.nodes) == 20_003 and len(got.edges) == 20_002 and len(got.nodes[-2].label) == control_flow.LABEL_CHARS


# Digests -------------------------------------------------------------------------------------------------------------


def _root(leaves, run):
    n = len(leaves)
    while len(leaves) > 1:
        leaves = [hashlib.sha256("".join(leaves[i : i + run]).encode()).hexdigest() for i in range(0, len(leaves), run)]
    return hashlib.sha256(f"{n}:{leaves[0]}".encode()).hexdigest()


def test_ordered_digest_of_any_size_and_partitioning(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "b", "hot", "hot", "hot"]), i, rng.choice("xyz")) for i in range(700)] + [("one", 1, "x")]
    df = spark.createDataFrame(rows, "g string, i long, v string")
    leaf = F.sha2(F.concat(F.col("i").cast("string"), "v"), 256)
    want = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(hashlib.sha256(f"{i}{v}".encode()).hexdigest())
    for parts in (1, 5):
        got = digest.ordered_digest(df.repartition(parts, "v"), ["g"], [F.col("i")], leaf, run=3).collect()
        assert {r.g: (r.rows, r.digest) for r in got} == {g: (len(x), _root(x, 3)) for g, x in want.items()}
    assert digest.ordered_digest(df.limit(0), ["g"], [F.col("i")], leaf).collect() == []


def test_project_fingerprint_sees_order_paths_and_content(spark):
    def of(rows):
        return reports.project_fingerprint(spark.createDataFrame(rows, "p string, file string, hash string"), ["p"]).first().fingerprint

    rows = [("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")]
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of([("p", "a", "2"), ("p", "b", "1"), ("p", "c", "3")]), of(rows[:2]), of([*rows, ("p", "c", "3")])}) == 4


def test_content_fingerprint_is_of_the_multiset(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (2, "x"), (2, "x")], "a int, b string")
    one = lambda x: facts.content_fingerprint(x).collect()
    assert one(df) == one(df.orderBy(F.desc("a")).select("b", "a")) and one(df)[0].rows == 4
    assert one(df) != one(df.distinct()) and one(df) != one(df.fillna(""))


# Graphs --------------------------------------------------------------------------------------------------------------


def _graph(spark, seed):
    rng = random.Random(seed)
    tree = [(g, f"t{i}", i, "IntegerLiteral" if i % 5 == 0 else "Stmt", i, i + 1, str(-i), "int[12][3]", f"V{i}") for g in "pq" for i in range(30)]
    flow = [(g, f"b{i}", i, "block", i) for g in "pq" for i in range(5)]
    edges = {"ast-child": [(g, f"t{i // 2}", f"t{i}") for g in "pq" for i in range(1, 30)], "cfg-successor": [(g, f"b{i}", f"b{i + 1}") for g in "pq" for i in range(4)], "cfg-contains": [(g, f"b{i}", f"t{i * 3}") for g in "pq" for i in range(5)], "def-use": [("p", "t1", "t7")]}
    for x in (tree, flow, *edges.values()):
        rng.shuffle(x)
    nodes = program_graphs.number_nodes(spark.createDataFrame(tree, "graph string, node_id string, ord int, kind string, line int, end_line int, name string, type_name string, symbol string"), spark.createDataFrame(flow, "graph string, node_id string, ord int, kind string, line int"))
    return nodes, program_graphs.join_edges({k: spark.createDataFrame(e, "graph string, source string, target string") for k, e in edges.items()})


def test_graph_identity_does_not_depend_on_order(spark):
    a, b = _graph(spark, 1), _graph(spark, 2)
    of = lambda g: {r.graph: r.digest for r in program_graphs.graph_digests(*g).collect()}
    assert of(a) == of(b) and len(set(of(a).values())) == 2
    assert {(r.graph, r.node_id): r.node for r in a[0].collect()} == {(g, f"{k}{i}"): i + (30 if k == "b" else 0) for g in "pq" for k, n in (("t", 30), ("b", 5)) for i in range(n)}
    changed = of((a[0].withColumn("name", F.when((F.col("graph") == "q") & (F.col("node_id") == "t3"), "else").otherwise(F.col("name"))), a[1]))
    assert changed["p"] == of(a)["p"] and changed["q"] != of(a)["q"]


def test_ablation_numbers_without_gaps_and_turns_edges_round(spark):
    nodes, edges = _graph(spark, 3)
    nodes = nodes.withColumn("node", F.lit(34) - F.col("node"))  # the flow first, so that places move
    kept, links = program_graphs.ablate(nodes, program_graphs.place_edges(nodes, edges), (1, 2))
    assert sorted((r.graph, r.node) for r in kept.collect()) == [(g, i) for g in "pq" for i in range(30)]
    got = sorted(tuple(r) for r in links.where("graph = 'p'").select("from_node", "to_node", "type").collect())
    own = [(29 - i // 2, 29 - i, 0) for i in range(1, 30)] + [(28, 22, 3)]
    assert got == sorted(own + [(b, a, t + 4) for a, b, t in own])
    assert program_graphs.ablate(nodes, program_graphs.place_edges(nodes, edges), (1,))[0].where("layer = 'cfg'").count() == 10


def test_graph_problems_and_dangling_edges(spark):
    nodes, edges = _graph(spark, 4)
    assert program_graphs.problems(nodes, edges).collect() == []
    extra = edges.unionByName(spark.createDataFrame([("p", "t1", "gone", 0)], "graph string, source string, target string, type int"))
    twice = nodes.unionByName(nodes.where("graph = 'q' and node_id = 't2'")).where("graph != 'p' or layer = 'cfg'")
    got = {(r.graph, r.problem, r.item) for r in program_graphs.problems(twice, extra.where("source = 't1' and target = 'gone' or graph = 'q'")).collect()}
    assert got == {("q", "node id twice", "t2"), ("p", "edge without its node", "t1"), ("p", "edge without its node", "gone"), ("p", "no tree", "")}
    with pytest.raises(Exception, match="missing node"):
        program_graphs.place_edges(nodes, extra).collect()
    with pytest.raises(ValueError):
        program_graphs.join_edges({"other": edges})


def test_features_of_numbers_extents_and_bindings(spark):
    import math

    nodes, _ = _graph(spark, 5)
    spans = spark.createDataFrame([("p", 10, 20), ("q", 3, 3)], "graph string, start_line int, end_line int")
    got = {(r.graph, r.node): r for r in program_graphs.node_features(nodes, spans).collect()}
    r = got["p", 15]
    assert (r.in_tree, r.in_flow, r.line_at, r.line_span, r.pointer, r.array, r.literal) == (1, 0, 0.5, 0.1, 0, 1, 1)
    assert math.isclose(r.value, -math.log1p(15) / 10) and math.isclose(r.extent, math.log1p(12) / 10) and math.isclose(r.binding, 16 / 35)
    assert got["q", 29].line_at == 1 and got["q", 31].in_flow == 1 and got["q", 31].extent == 0
    with pytest.raises(Exception, match="without its value"):
        program_graphs.node_features(nodes.withColumn("name", F.lit("x1")), spans).collect()


# Renaming ------------------------------------------------------------------------------------------------------------

WORDS = ["if", "(", ")", "{", "}", ";", "=", "+", "a", "b", "cc", "f", "1", "2.5", '"s"', "'c'", "->", "return", "// x\n", "/* y */"]


def _templates(spark, sources):
    df = spark.createDataFrame(list(enumerate(sources)), "i int, s string")
    return [r.h for r in df.select("i", renaming.template_hash("s").alias("h")).orderBy("i").collect()]


def test_alpha_equivalent_sources_share_a_template_and_others_do_not(spark):
    rng = random.Random(8)
    sources, plain = [], []
    for _ in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 7))]
        names = rng.choice([{}, {"a": "b", "b": "a"}, {"a": "long_name", "cc": "Z9"}])
        sources.append(" ".join(names.get(w, w) if not (k + 1 < len(words) and words[k + 1] == "(") else w for k, w in enumerate(words)))
        tokens = [w for w in (names.get(w, w) if not (k + 1 < len(words) and words[k + 1] == "(") else w for k, w in enumerate(words)) if not w.startswith(("//", "/*"))]
        seen = {}
        plain.append(tuple("#" if w[0] in "12\"'" else seen.setdefault(w, f"v{len(seen)}") if w in ("a", "b", "cc", "f", "long_name", "Z9") and tokens[k + 1 : k + 2] != ["("] else w for k, w in enumerate(tokens)))
    got = _templates(spark, sources)
    for i in range(300):
        for j in range(i):
            assert (got[i] == got[j]) == (plain[i] == plain[j]), (sources[i], sources[j])


def test_templates_of_odd_texts(spark):
    got = _templates(spark, [None, "", "a \\\n b", "\"open", "x " * 100_000, "é ² _a a1"])
    assert got[0] is None and got[2] is None and got[1] == hashlib.sha256(b"").hexdigest()
    assert got[3] == hashlib.sha256(b"<literal> v0").hexdigest() and got[4] == hashlib.sha256(" ".join(["v0"] * 100_000).encode()).hexdigest()
    assert got[5] == hashlib.sha256("é <literal> v0 v1".encode()).hexdigest()


def test_comments_go_and_places_stay(spark):
    text = 'int a; // b\nchar *s = "/* no */"; /* x\n y */ int c;'
    got = spark.createDataFrame([(text,), (None,), ("a\\\nb",)], "t string").select(renaming.without_comments("t").alias("c")).collect()
    assert got[0].c == 'int a;     \nchar *s = "/* no */";     \n      int c;' and got[1].c is None and got[2].c is None


def test_neutral_names_are_injective_and_bounded(spark):
    rows = [
        'void process(void) { int goodData = 1; char *bad; int local_slot_0; use(goodData, bad, "goodData"); }', "void f(void) { int bad; bad(); }", "void f(void) { int bad; x.bad = 1; }", "void f(void) {\n#define A\nint bad; }",
        "void f(void) { int fine; }", None, "void f(void) { int bad = 1; int good = bad; { int bad = good; } }",
    ]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", renaming.neutral_names("c").alias("n")).orderBy("i").collect()
    n = [r.n for r in got]
    assert n[0].names == {"goodData": "local_slot_0_", "bad": "local_slot_1"} and 'use(local_slot_0_, local_slot_1, "goodData")' in n[0].code
    assert [x.problem for x in n[1:4]] == [renaming.OUTSIDE] * 3 and n[1].code is None
    assert n[4].code == rows[4] and n[4].names == {} and n[5].code is None and n[5].problem is None
    assert n[6].code == "void f(void) { int local_slot_0 = 1; int local_slot_1 = local_slot_0; { int local_slot_0 = local_slot_1; } }"


# Pairs ---------------------------------------------------------------------------------------------------------------

CASE = """/* Label Definition File: CWE121_Stack.label.xml
Flow Variant: 01 Baseline */
#include "std_testcase.h"

#ifndef OMITBAD
void CWE121_Stack__x_01_bad()
{
    int badIndex = 10; /* POTENTIAL FLAW: too large */

    use(badIndex);
}
#endif
static void goodG2B()
{
    int goodIndex = 3;
    check(goodIndex);
}
static void goodB2G1(void) { puts("}"); }
void CWE121_Stack__x_01_good()
{
    goodG2B();
}
"""


def test_a_pair_and_its_lines(spark):
    name = "testcases/CWE121_Stack/CWE121_Stack__x_01.c"
    files = spark.createDataFrame([(name, CASE), ("testcases/CWE121_Stack/CWE121_Stack__x_41.c", CASE), ("testcases/CWE78_X/CWE78_X__y_01.c", CASE), ("notes.txt", CASE)], "source_file string, text string")
    found = pairs.candidates(files)
    assert [(r.source_file, r.cwe, r.flow) for r in found.collect()] == [(name, 121, 1)]
    row = pairs.extract_pairs(found).first()
    assert row.reason is None and row.family == "CWE121_Stack"
    bad, good = row.pair
    assert (bad.label, bad.original_function, good.label) == (1, "CWE121_Stack__x_01_bad", 0)
    assert bad.code == '#include "std_testcase.h"\nvoid process(void)\n{\n    int local_slot_0 = 10;\n    use(local_slot_0);\n}\n'
    assert bad.original_line == 6 and bad.line_map == [3, 6, 7, 8, 10, 11] and bad.names == {"badIndex": "local_slot_0"}
    first = min(("goodG2B", "goodB2G1"), key=lambda f: hashlib.sha256(f"42:{name}:{f}".encode()).hexdigest())
    assert good.original_function == first and bad.template_sha256 != good.template_sha256


def test_rejections_of_odd_cases(spark):
    name = "t/CWE121_Stack__x_01.c"
    texts = [None, "", CASE.replace("Baseline", ""), CASE.replace("    use(badIndex);", "    good();"), CASE.replace("void CWE121_Stack__x_01_good", "void CWE121_Stack__x_01_bad() { }\nvoid g"), CASE * 2]
    got = [pairs.extract_pairs(spark.createDataFrame([(name, 121, t)], "source_file string, cwe int, text string")).first() for t in texts]
    assert [g.reason for g in got] == [pairs.REASONS["flow"], pairs.REASONS["flow"], None, pairs.REASONS["answer"], pairs.REASONS["bad"], pairs.REASONS["bad"]]


def test_cases_are_taken_in_turn(spark):
    rng = random.Random(3)
    rows = [(f"f{i}", rng.choice([1, 1, 1, 1, 2, 3]), rng.choice([None, None, "no"])) for i in range(200)]
    got = {r.source_file: r for r in pairs.select_cases(spark.createDataFrame(rows, "source_file string, cwe int, reason string"), 20).collect()}
    by = {}
    for f, c, _ in rows:
        by.setdefault(c, []).append(f)
    for c in by:
        by[c].sort(key=lambda f: hashlib.sha256(f"42:{f}".encode()).hexdigest())
    order = [(by[c][t], t) for t in range(200) for c in sorted(by) if t < len(by[c])]
    reasons, selected = {f: r for f, _, r in rows}, 0
    for place, (f, turn) in enumerate(order):
        want = "unexamined" if selected == 20 else "rejected" if reasons[f] else "selected"
        selected += want == "selected"
        assert (got[f].turn, got[f].place, got[f].status) == (turn, place, want)
    assert len(got) == 200 and selected == 20
    assert {r.status for r in pairs.select_cases(spark.createDataFrame(rows[:3], "source_file string, cwe int, reason string"), 20).collect()} <= {"selected", "rejected"}


def test_families_with_clones_share_a_group(spark):
    texts = {"A": CASE, "B": CASE.replace("Index", "Place"), "C": CASE.replace("10;", "10 + 1;").replace("= 3", "= 3 + 1").replace('puts("}")', 'puts("}") + 2')}
    rows = [(f"t/CWE121_Stack__x_01.c", 121, t.replace("CWE121_Stack.label", f"{k}.label")) for k, t in texts.items()]
    got = pairs.pair_groups(pairs.extract_pairs(spark.createDataFrame(rows, "source_file string, cwe int, text string")))
    assert {r.family: r.group for r in got.collect()} == {"A": "A", "B": "A", "C": "C"}
