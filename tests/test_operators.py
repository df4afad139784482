import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrylens.functions import lexical, text
from quarrylens.operators import dataset, evaluation, facts, graph

ISSUE = "rule_id string, file string, symbol_id string, detector string, evidence string, line int, column int, ord long, suppressed boolean"


def match(spark, before, after):
    m = facts.match_issues(spark.createDataFrame(before, ISSUE), spark.createDataFrame(after, ISSUE))
    return sorted(((r.b, r.a) for r in m.collect()), key=str)


def issue(ord_, line=2, evidence="a[2]", symbol="f", suppressed=False):
    return ("R", "api.h", symbol, "d", evidence, line, 20, ord_, suppressed)


def test_issue_matching(spark):
    assert match(spark, [issue(1)], [issue(7)]) == [(1, 7)]
    assert match(spark, [issue(1)], [issue(7, line=9)]) == [(1, 7)]  # moved
    assert match(spark, [issue(1, symbol="")], [issue(7, 9, symbol="")]) == [(1, None), (None, 7)]
    assert match(spark, [issue(1, evidence="[AST node: x]")], [issue(7, 9, "[AST node: x]")]) == [(1, None), (None, 7)]
    assert match(spark, [issue(1), issue(2, 5)], [issue(7, 8), issue(8, 9)]) == [(1, None), (2, None), (None, 7), (None, 8)]
    assert match(spark, [issue(1), issue(2)], [issue(7), issue(8), issue(9)]) == [(1, 7), (2, 8), (None, 9)]


ABSENT = "b long, has_file boolean, policy_before string, policy_after string, requested boolean, disabled boolean, own_unit string, configured boolean, revision_before string, revision_after string, unit_reason string, contributors long"
CLEAR = dict(has_file=True, policy_before="p", policy_after="p", requested=True, disabled=False, own_unit="success", configured=True, revision_before="r", revision_after="r", unit_reason=None, contributors=1)


@pytest.mark.parametrize(
    ("change", "status"),
    [
        ({}, "not_detected"), ({"has_file": False}, "file_removed"), ({"has_file": False, "policy_after": "q"}, "inventory_scope_changed"), ({"has_file": False, "policy_after": ""}, "inventory_unknown"),
        ({"requested": False, "disabled": True}, "analysis_disabled"), ({"disabled": True, "own_unit": "parse_failed"}, "rule_disabled"), ({"own_unit": "parse_failed", "configured": False}, "parse_failed"), ({"own_unit": "gone"}, "coverage_lost"),
        ({"configured": False, "revision_after": ""}, "configuration_unknown"), ({"revision_after": ""}, "provenance_unknown"), ({"revision_after": "s"}, "analyzer_changed"), ({"unit_reason": "configuration_changed"}, "configuration_changed"), ({"contributors": 0}, "coverage_unknown"),
    ],
)
def test_why_an_issue_is_gone(spark, change, status):
    names = [x.split()[0] for x in ABSENT.split(", ")]
    context = spark.createDataFrame([tuple({"b": 1, **CLEAR, **change}[n] for n in names)], ABSENT)
    m = facts.match_issues(spark.createDataFrame([issue(1)], ISSUE), spark.createDataFrame([], ISSUE))
    assert [r.status for r in facts.change_status(m, context).collect()] == [status]


@pytest.mark.parametrize(("old", "new", "status"), [(False, False, "persistent"), (False, True, "suppressed"), (True, False, "reactivated"), (True, True, "persistent_suppressed"), (None, False, "added"), (None, True, "new_suppressed")])
def test_matched_status(spark, old, new, status):
    before = [] if old is None else [issue(1, suppressed=old)]
    m = facts.match_issues(spark.createDataFrame(before, ISSUE), spark.createDataFrame([issue(7, suppressed=new)], ISSUE))
    assert [r.status for r in facts.change_status(m, spark.createDataFrame([], ABSENT)).collect()] == [status]


def test_first_reason_of_the_units_that_covered(spark):
    units = "unit string, ord int, status string, fingerprint string"
    before = spark.createDataFrame([("a", 0, "success", "x"), ("b", 1, "success", "y"), ("c", 2, "success", "z")], units)
    after = spark.createDataFrame([("a", 0, "success", "x"), ("b", 1, "success", "other"), ("c", 2, "parse_failed", "z")], units)
    covers = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("a", "only")], "unit string, file string")
    got = {r.file: (r.unit_reason, r.contributors) for r in facts.unit_reasons(covers, before, covers, after).collect()}
    assert got == {"h": ("configuration_changed", 3), "only": (None, 1)}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("a", "b")])
    assert graph.unique_edges(e).count() == 3
    assert graph.node_set(e, spark.createDataFrame([("d",)], "node string")).count() == 4
    scc = graph.strong_components(e)
    assert {(r.node, r.component) for r in scc.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {(r.component, r.size) for r in graph.cycles(e, scc).collect()} == {("a", 2), ("c", 1)}
    assert {r.node for r in graph.reachable(e, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b"}
    assert {(r.node, r.root) for r in graph.components(edges(spark, [("x", "m"), ("m", "k"), ("z", "z")])).collect()} == {("x", "k"), ("m", "k"), ("k", "k"), ("z", "z")}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(e)


def test_topological_orders(spark):
    rows = [("g", "a", "b"), ("g", "a", "c"), ("g", "d", "c"), ("loop", "x", "y"), ("loop", "y", "x"), *[("chain", f"{i:05d}", f"{i + 1:05d}") for i in range(3000)]]
    got = graph.topological_orders(spark.createDataFrame(rows, "graph string, source string, target string")).orderBy("graph", "position").collect()
    assert [r.node for r in got if r.graph == "g"] == ["a", "b", "d", "c"]
    assert len([r for r in got if r.graph == "chain"]) == 3001 and not [r for r in got if r.graph == "loop"]


BLOCKS = "function string, block string, kind string, events array<struct<kind:string,symbol:string,node:string>>"


def flow(spark, blocks, links):
    got = graph.reaching_definitions(spark.createDataFrame([("f", *b) for b in blocks], BLOCKS), spark.createDataFrame([("f", *x) for x in links], "function string, source string, target string"))
    return {(r.source, r.target, r.symbol) for r in got.collect()}


def test_data_flow(spark):
    d, u = (lambda n: ("def", "x", n)), (lambda n: ("use", "x", n))
    branch = [("e", "entry", [d("d0")]), ("l", "block", [d("d1")]), ("r", "block", []), ("j", "block", [u("u1")]), ("dead", "block", [d("d9")])]
    assert flow(spark, branch, [("e", "l"), ("e", "r"), ("l", "j"), ("r", "j"), ("dead", "j")]) == {("d0", "u1", "x"), ("d1", "u1", "x")}
    loop = [("e", "entry", [d("d0")]), ("b", "block", [u("u1"), d("d1")])]
    assert flow(spark, loop, [("e", "b"), ("b", "b")]) == {("d0", "u1", "x"), ("d1", "u1", "x")}
    kill = [("e", "entry", [d("d0"), d("d1"), u("u1"), ("undef", "x", "n"), u("u2")])]
    assert flow(spark, kill, [("e", "e")]) == {("d1", "u1", "x")}
    with pytest.raises(PySparkException, match="does not have"):
        flow(spark, kill, [("e", "zz")])


SOURCE = r'''#include <stdio.h>
// strcpy(a, b) in a comment
int work(int n) {
    char name[4];
    int unset;
    int *p = nullptr;
    char *m = malloc(10);
    char *ok = malloc(10);
    FILE *f = fopen("gets(x)", "r");
    strcpy(name, "text"); name[7] = 'x'; name[2] = 0;
    if (n = 3) { n++; }
    if (n == 3 && n != 4) { printf("%d", unset); }
    *p = 1;
    free(ok);
    return 0;
}
'''


def test_lexical_rules(spark):
    df = spark.createDataFrame([("a.cpp", SOURCE), ("clean.cpp", "int main() {\n    int n;\n    n = 3;\n    return n;\n}\n"), ("empty.cpp", "")], "file string, text string")
    got = sorted((r.rule_id, r.line, r.column) for r in lexical.inspect(df).collect())
    assert got == [("DG001", 10, 5), ("DG002", 10, 27), ("DG003", 7, 11), ("DG004", 11, 5), ("DG005", 13, 5), ("DG006", 12, 42), ("DG007", 9, 5)]
    covered = spark.createDataFrame([("a.cpp", "DG001")], "file string, rule_id string")
    assert "DG001" not in {r.rule_id for r in lexical.inspect(df, covered=covered).collect()}
    m = {r.file: r for r in lexical.file_metrics(df).collect()}
    assert (m["a.cpp"].physical_lines, m["a.cpp"].function_count, m["a.cpp"].max_brace_depth, m["a.cpp"].include_count, m["a.cpp"].comment_lines) == (16, 1, 2, 1, 1)
    assert m["empty.cpp"].physical_lines == 0 and m["empty.cpp"].comment_ratio == 0
    assert lexical.project_metrics(lexical.file_metrics(df), 7).first().file_count == 3


def test_masking_keeps_places():
    for t in (SOURCE, 'a "b\\"c" d', "/* open", "'x", '"\\', "// a\nb", "a/*x*/b//c\n'\\''d", 'x"\n"y'):
        out = lexical.mask_text(t)
        assert len(out) == len(t) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(t) if c == "\n"]
    assert lexical.mask_text('a "b" /* c */ d') == "a                d"[: len('a "b" /* c */ d') - 1] + "d"


def test_text_functions(spark):
    row = spark.createDataFrame([("a\r\nb\x0bc\n", "É" * 300)], "a string, e string").select(text.split_lines(F.col("a")).alias("l"), text.short_evidence(F.col("e")).alias("e"), text.ascii_lower(F.lit("AÉz")).alias("w")).first()
    assert row.l == ["a", "b", "c"] and row.e == "É" * 250 + "..." and row.w == "aÉz"


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, 0.9, [3], [3, 4]), (1, 0.1, [5], [1, 5]), (0, 0.8, [], None), (0, 0.2, [], None)], "label int, probability double, truth array<int>, ranked array<int>")
    c = evaluation.confusion(rows).first()
    assert (c.tp, c.tn, c.fp, c.fn, c.f1) == (1, 1, 1, 1, 0.5)
    k = evaluation.top_k(rows).first()
    assert (k.eligible, k.top_1, k.top_3, k.end_to_end_top_3) == (2, 0.5, 1.0, 0.5)
    assert evaluation.top_k(rows.withColumn("ranked", F.lit(None).cast("array<int>"))).first().top_1 is None
    s = evaluation.score_summary(spark.createDataFrame([("m", 0.2), ("m", 0.8), ("n", 0.5)], "model string, f1 double"), ["model"], "f1")
    got = {r.model: r for r in s.collect()}
    assert got["m"].mean == pytest.approx(0.5) and got["m"].std == pytest.approx(0.4242640687) and got["n"].std is None


def test_seeded_split():
    classes = {f"g{i}": {0, 1} for i in range(10)}
    split = evaluation.seeded_split(classes, 0.6, 0.2, 42)
    assert split == evaluation.seeded_split(classes, 0.6, 0.2, 42) and sorted(split.values()).count("train") == 6
    assert evaluation.partition_sizes(3, 0.9, 0.05) == (1, 1)
    with pytest.raises(ValueError, match="both classes"):
        evaluation.seeded_split({f"g{i}": {0} for i in range(5)}, 0.6, 0.2, 1)


def test_canonical_hash_ignores_layout_and_comments(spark):
    from quarrylens.operators import dataset

    texts = ["int f(){return 1;}", "int  f ( ) {\n // c\n return /* x */ 1 ; }", "int f(){return 2;}", "#if 1\nint f(){return 1;}", 'auto s = R"x(a // b)x";', 'auto s=R"x(a // b)x" ;', 'auto s=R"x(a  // b)x";']
    h = [r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", dataset.canonical_hash(F.col("t")).alias("h")).orderBy("i").collect()]
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3 and h[4] == h[5] != h[6]


def test_readers_and_checks(spark, tmp_path):
    import zipfile

    from quarrylens.operators import dataset

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.c", "1")
        z.writestr("b.c", "2")
    assert sorted((r.member, bytes(r.content)) for r in dataset.zip_members(spark, f"file:{tmp_path}/a.zip").collect()) == [("b.c", b"2"), ("x/a.c", b"1")]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../a.c", "1")
    with pytest.raises(PySparkException, match="unsafe"):
        dataset.zip_members(spark, f"file:{tmp_path}/bad.zip").collect()
    lines = spark.createDataFrame([(0, '{"a": 1}'), (1, '{"a": 1, "a": 2}'), (2, '{"a": NaN}'), (3, "[1]"), (4, "{")], "i int, t string")
    assert [r.p is None for r in lines.select("i", dataset.json_problem("t").alias("p")).orderBy("i").collect()] == [True, False, False, False, False]
    data = spark.createDataFrame([(bytearray("é中".encode()),), (bytearray("中文".encode("gb18030")),)], "c binary")
    assert [tuple(r.d) for r in data.select(dataset.decoded("c").alias("d")).collect()] == [("é中", "utf-8"), ("中文", "gb18030")]
    one, two = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(PySparkException, match="one to one"):
        dataset.pair_exactly(one, two, "k", "rows").collect()
    graphs = spark.createDataFrame([("f.c", "a", "int a()"), ("f.c", "a", "int a(int)")], "file string, function string, signature string")
    labels = spark.createDataFrame([("f.c", "a", "int a(int)", 1)], "file string, function string, signature string, label int")
    assert [(r.signature, r.label) for r in dataset.join_labels(graphs, labels).collect()] == [("int a(int)", 1)]


def test_labels_one_to_one(spark):
    schema = "file string, function string, signature string"
    graphs = spark.createDataFrame([("a", "f", "f()"), ("a", "g", None), ("b", "f", "f()")], schema)
    lab = lambda rows: spark.createDataFrame(rows, schema + ", sample_id string, label int")
    good = [("a", "f", None, "1", 0), ("a", "g", None, "2", 1), ("b", "f", "f()", "3", 1)]
    assert {(r.file, r.function, r.sample_id) for r in dataset.labels_one_to_one(graphs, lab(good)).collect()} == {("a", "f", "1"), ("a", "g", "2"), ("b", "f", "3")}
    for rows, message in ((good[:2], "without a label"), ([*good, good[0]], "several labels"), ([*good, ("z", "z", None, "4", 0)], "label without a graph")):
        with pytest.raises(Exception, match=message):
            dataset.labels_one_to_one(graphs, lab(rows)).collect()
    with pytest.raises(Exception, match="label of several graphs"):
        dataset.labels_one_to_one(graphs.unionByName(graphs.limit(1)), lab(good)).collect()


def test_auc_of_many_distinct_scores_equals_its_ranks(spark):
    n = 1_000_000  # distinct scores; every third is positive
    rows = spark.range(n).select((F.col("id") * 7919 % n / n).alias("probability"), (F.col("id") * 7919 % n % 3 == 0).cast("int").alias("label"))
    positives = range(0, n, 3)
    below = sum(x - (x // 3) for x in positives)  # negatives below x
    assert abs(evaluation.roc_auc(rows).first().auc - below / (len(positives) * (n - len(positives)))) < 1e-12
    assert evaluation.roc_auc(rows.where("label = 1").limit(10)).first().auc is None


def test_vocabulary_numbers_in_order(spark):
    words = spark.createDataFrame([(f"w{i % 500:03d}",) for i in range(2000)] + [(None,)], "word string").repartition(6)
    got = {r.word: r["index"] for r in dataset.fit_vocabulary(words, "word").collect()}
    assert got == {None: 1, **{f"w{i:03d}": i + 2 for i in range(500)}}


def test_hash_split_keeps_groups_whole_and_sees_both_classes(spark):
    rows = spark.createDataFrame([(f"g{i % 40}", int(i % 40 < 2)) for i in range(400)], "g string, label int")
    got = {r.group: r.split for r in evaluation.hash_split(rows, "g", 0.6, 0.2, 7).collect()}
    assert len(got) == 40 and sorted(map(list(got.values()).count, ("train", "validation", "test"))) == [8, 8, 24]
    assert "train" in (got["g0"], got["g1"])
    assert got == {r.group: r.split for r in evaluation.hash_split(rows.repartition(5), "g", 0.6, 0.2, 7, batch=3).collect()}
    with pytest.raises(ValueError, match="both classes"):
        evaluation.hash_split(rows.where("label = 0"), "g", 0.6, 0.2, 7, tries=4)


def test_scores_that_some_seeds_lack_are_an_error(spark):
    rows = spark.createDataFrame([("m", 0.2), ("m", 0.8), ("n", None)], "mode string, score double")
    got = {r["mode"]: (r.n, r.mean) for r in evaluation.score_summary(rows, ["mode"], "score").collect()}
    assert got == {"m": (2, 0.5), "n": (0, None)}
    with pytest.raises(Exception, match="some seeds"):
        evaluation.score_summary(rows.withColumn("mode", F.lit("x")), ["mode"], "score").collect()


def _prepared(spark, change=None):
    rows = [(f"s{i}", f"g{i // 2}", i % 2, f"int f{i}() {{ return {i}; }}", None, None) for i in range(20)]
    rows[0] = ("s0", "g0", 0, "int f0() { return 0; }", ["g0", "g9"], ["old"])
    records = spark.createDataFrame(rows, "sample_id string, group_id string, label int, source string, source_groups array<string>, duplicate_ids array<string>")
    place = lambda g: "train" if g in (0, 9, 1, 2, 3, 4) else "validation" if g == 5 else "test"
    splits = spark.createDataFrame([(f"s{i}", place(i // 2)) for i in range(20)], "sample_id string, split string")
    groups = spark.createDataFrame([(f"g{g}", place(g)) for g in range(9)], "group string, split string")
    sizes = {s: sum(place(i // 2) == s for i in range(20)) // 2 for s in ("train", "validation", "test")}
    counts = spark.createDataFrame([(s, n, n) for s, n in sizes.items()], "split string, n0 long, n1 long")
    return records, splits, groups, counts


def test_a_sound_data_set_and_its_faults(spark):
    records, splits, groups, counts = _prepared(spark)
    found = lambda r=records, s=splits, g=groups, c=counts, n=1, f=(0.6, 0.2): {p.problem for p in evaluation.dataset_problems(r, s, g, c, *f, n).collect()}
    assert found() == set()
    assert found(n=3) == {"duplicate count"}
    assert found(f=(0.2, 0.2)) == {"groups of a split"}
    assert found(s=splits.where("sample_id != 's3'")) == {"in no split", "class counts differ"}
    moved = splits.withColumn("split", F.when(F.col("sample_id").isin("s18", "s19"), "test").otherwise(F.col("split")))
    assert found(s=moved) == {"tied groups in several splits", "class counts differ", "groups differ"}
    same = records.withColumn("source", F.when(F.col("sample_id") == "s13", F.lit("int f12() {  return 12; } // x")).otherwise(F.col("source")))
    assert found(r=same) == {"source twice", "labels of a source differ"}
    apart = records.withColumn("source", F.when(F.col("sample_id") == "s16", F.lit("int f0() { return 0; }")).otherwise(F.col("source")))
    assert found(r=apart) == {"source twice", "source in several splits"}
    copies = records.withColumn("duplicate_ids", F.when(F.col("sample_id") == "s4", F.array(F.lit("old"), F.lit("s5"))).otherwise(F.col("duplicate_ids")))
    assert found(r=copies, n=3) == {"copy named twice", "copy is a record"}
    assert found(g=groups.where("group != 'g7'")) == {"groups differ"}
    one = records.withColumn("label", F.when(F.col("sample_id").isin(*[f"s{i}" for i in (*range(10), 18, 19)]), 1).otherwise(F.col("label")))
    assert found(r=one) == {"training lacks a class", "class counts differ"}


def test_project_duplicates_over_files(spark):
    files = spark.createDataFrame([("a", '#include <x.h>\nint a = 1;\nint  a=1;\n}\n'), ("b", '#include "x.h"\nint a = 1; // c\n'), ("c", None)], "file string, text string")
    got = lexical.project_duplicates(files).first()
    assert (got.n, got.duplicated, got.include_count) == (5, 2, 1)
    assert tuple(lexical.project_duplicates(files.limit(0)).first()) == (0, 0, 0)


def test_settings_of_a_scan_are_one_row(spark):
    one = spark.createDataFrame([(1, ["x"])], "a int, b array<string>")
    assert [tuple(r) for r in facts._single(one, "the settings").collect()] == [(1, ["x"])]
    for wrong in (one.limit(0), one.unionByName(one)):
        with pytest.raises(Exception, match="one row a scan"):
            facts._single(wrong, "the settings").collect()


def test_error_cases_in_rank_order(spark):
    rows = spark.createDataFrame([("a", 1, 0.1, 1), ("a", 2, 0.2, 1), ("b", 1, 0.9, 0), ("c", 1, 0.9, 1)], "sample_id string, seed int, probability double, label int")
    got = [(r.sample_id, r.errors, r.fp, r["fn"], r.seeds) for r in evaluation.rank_errors(evaluation.error_cases(rows)).collect()]
    assert got == [("a", 2, 0, 2, "1,2"), ("b", 1, 1, 0, "1")]


def test_rules_read_and_mark_each_line_once(spark, monkeypatch):
    """A long line in a file without declarations is written once, for its call alone; a declared name is marked with its column."""
    words = "word " * 2000
    df = spark.createDataFrame([("prose", f"{words}strcpy(a, b); {words}"), ("code", f"int x;\nint y;\n{words}x {words}y\n"), ("none", None)], "file string, text string")
    written = {(r.file, r.line): [(m.kind, m.name, m.column) for m in r.marks] for r in lexical.marked_lines(df).collect()}
    assert written == {("prose", 1): [("call", "strcpy", 10001)], ("code", 1): [("scalar", "x", 1), ("used", "x", 5)], ("code", 2): [("scalar", "y", 1), ("used", "y", 5)], ("code", 3): [("used", "x", 10001), ("used", "y", 20003)]}
    got = {(r.file, r.rule_id, r.line, r.column, r.evidence[-7:]) for r in lexical.inspect(df).collect()}
    assert got == {("prose", "DG001", 1, 10001, "rd word"), ("code", "DG006", 3, 10001, " word y"), ("code", "DG006", 3, 20003, " word y")}
    reads = []
    monkeypatch.setattr(lexical, "prepare", lambda files, f=lexical.prepare: reads.append(files) or f(files))
    lexical.inspect(df)
    assert len(reads) == 1


def test_scan_times_of_late_years(spark):
    """Years after 9999 have no sign, as in SQL; numbers of 16 digits are times, those that no timestamp holds pass through."""
    cases = {"0": "1970-01-01 00:00:00 UTC", "253402300800000": "10000-01-01 00:00:00 UTC", "777601107000000": "26611-03-14 19:30:00 UTC", "4665606642000000": "149817-03-10 21:00:00 UTC",
             "9223372036854775807": "9223372036854775807", "99999999999999999999": "99999999999999999999", "-9223372036854775808": "-9223372036854775808", "2026-09-13T00:00:00Z": "2026-09-13T00:00:00Z"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.scan_time(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in got} == cases


def test_topological_orders_need_no_group_a_graph(spark):
    """Graphs that go on in the next Arrow batch, and a null name; the plan has no pandas group."""
    rows = [(g if g else None, n, n + 1) for g in range(300) for n in range(g, g + 90)]
    got = graph.topological_orders(spark.createDataFrame(rows, "graph long, source long, target long"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {(r.graph, r.node, r.position) for r in got.collect()} == {(g if g else None, g + k, k) for g in range(300) for k in range(91)}


def plain_components(pairs):
    after = {}
    for s, t in pairs:
        after.setdefault(s, set()).add(t)
        after.setdefault(t, set())

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    far = {n: reach(n) for n in after}
    return {(n, min(m for m in far[n] if n in far[m])) for n in after}


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_strong_components_in_blocks(spark, block):
    """Rings that lie in one block, rings over several, a source with more edges than a block, and edges at random."""
    import random

    rnd = random.Random(5)
    pairs = [(i, i - i % 4 + (i + 1) % 4) for i in range(1000, 1100)] + [(i, i + 1) for i in range(200, 240)] + [(240, 200)] + [(500, n) for n in range(501, 540)] + [(539, 500), (500, 500), (3, 3)]
    pairs += [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)] + [(1003, 230), (77, 78), (77, 78)]
    e = spark.createDataFrame(pairs, "source long, target long")
    got = graph.strong_components(e, block=block)
    assert sorted((r.node, r.component) for r in got.collect()) == sorted(plain_components(pairs))


def test_components_of_neighbours_need_no_rounds(spark, monkeypatch):
    """Graphs whose nodes lie side by side are contracted inside tasks; the rounds see those at the ends of blocks only."""
    rounds = []
    monkeypatch.setattr(graph, "_coloured", lambda rest, most, f=graph._coloured: rounds.append(rest.count()) or f(rest, most))
    e = spark.range(40_000).selectExpr("id AS source", "id - id % 8 + (id + 1) % 8 AS target")
    got = graph.strong_components(e, block=1000)
    assert got.where("component != node - node % 8").count() == 0 and got.count() == 40_000
    assert sum(rounds) < 4_000


def test_matching_deals_issues_by_their_key_once(spark):
    """One exchange and no join: sites, pairs and lonely ones of a key lie together. Keys with a null match nothing."""
    m = facts.match_issues(spark.createDataFrame([issue(1)], ISSUE), spark.createDataFrame([issue(7)], ISSUE))
    plan = m._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    nulls = [("R", None, "f", "d", "a[2]", 2, 20, 1, False), ("R", "api.h", "f", "d", "a[2]", None, 20, 2, False)]
    assert match(spark, nulls, [(*x[:7], x[7] + 10, False) for x in nulls]) == [(1, None), (2, None), (None, 11), (None, 12)]


def test_few_rules_are_no_shuffle_key(spark):
    """All facts of a rule would meet in one task: rule catalogues are broadcast."""
    rules = spark.createDataFrame([("R", "high"), ("A", "low")], "rule_id string, severity string")
    seen = spark.createDataFrame([("f", "R"), ("f", "X"), ("g", "A"), ("f", "R")], "file string, rule_id string")
    got = facts.native_findings(seen, spark.createDataFrame([("f",)], "file string"), rules)
    assert "hashpartitioning(rule_id" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.file, r.rule_id, r.severity, r.confidence) for r in got.collect()) == [("f", "R", "high", 1.0)] * 2


def test_metrics_hold_few_texts_at_a_time(spark):
    """Masks and functions come from one pass over slices of a batch; no step takes all of a batch's texts as a series."""
    df = spark.createDataFrame([(str(i), None if i % 100 == 7 else f"int f{i}() {{ // x\n}}\n") for i in range(300)], "file string, text string")
    prepared = lexical.prepare(df)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    got = {r.file: (r.code, [f.name for f in r.functions]) for r in prepared.collect()}
    assert got == {str(i): ("", []) if i % 100 == 7 else (f"int f{i}() {{     \n}}\n", [f"f{i}"]) for i in range(300)}
