"""Registered queries over reviews: comparisons, references, policies, builds, records, gates and lexical facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import lexical, text
from quarrylens.operators import dataset, evaluation, facts, graph, reports
from quarrylens.operators.digest import digest_sql
from quarrylens.plans import catalog
from quarrylens.plans.catalog import query
from quarrylens.plans.select import select
from quarrylens.sources import inventory, snapshots
from quarrylens.sources.shared import spread, table

# Comparison with the context of absences -------------------------------------------------------------------------

_ABSENCE_SQL = f"""WITH mm AS ({catalog._MATCH}), bb AS ({catalog._BEFORE}),
 ub AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit, s_suppkey AS o, 'f' || CAST(s_suppkey % 7 AS VARCHAR) AS fp FROM supplier),
 ua AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit, CASE WHEN s_suppkey % 23 = 1 THEN 'parse_failed' WHEN s_suppkey % 19 = 5 THEN 'cancelled' ELSE 'success' END AS status,
  CASE WHEN s_suppkey % 13 = 4 THEN 'g' WHEN s_suppkey % 11 = 6 THEN '' ELSE 'f' || CAST(s_suppkey % 7 AS VARCHAR) END AS fp FROM supplier WHERE s_suppkey % 29 <> 2),
 cb AS (SELECT CAST(s_suppkey AS VARCHAR) AS unit, CAST(s_suppkey + 1 AS VARCHAR) AS file FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 <> 0),
 ca AS (SELECT * FROM cb WHERE CAST(unit AS BIGINT) % 31 <> 7),
 rr AS (SELECT cb.file, ub.o, CASE WHEN ua.unit IS NULL THEN 'coverage_lost' WHEN ua.status = 'parse_failed' THEN 'parse_failed' WHEN ua.status <> 'success' THEN 'coverage_lost' WHEN ub.fp = '' OR ua.fp = '' THEN 'provenance_unknown'
  WHEN ub.fp <> ua.fp THEN 'configuration_changed' WHEN ca.unit IS NULL THEN 'coverage_lost' END AS r FROM cb JOIN ub USING (unit) LEFT JOIN ua ON ua.unit = cb.unit LEFT JOIN (SELECT DISTINCT * FROM ca) ca ON ca.unit = cb.unit AND ca.file = cb.file),
 rf AS (SELECT file, arg_min(r, o) FILTER (WHERE r IS NOT NULL) AS r, count(*) AS n FROM rr GROUP BY 1),
 cx AS (SELECT bb.ord AS b, CASE WHEN f.s_suppkey IS NULL THEN 'file_removed' WHEN bb.rule_id = 'A' THEN 'rule_disabled' WHEN o.status = 'parse_failed' THEN 'parse_failed' WHEN o.status <> 'success' THEN 'coverage_lost'
  WHEN rf.r IS NOT NULL THEN rf.r WHEN coalesce(rf.n, 0) = 0 THEN 'coverage_unknown' ELSE 'not_detected' END AS reason
  FROM bb LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 17 <> 3) f ON CAST(f.s_suppkey AS VARCHAR) = bb.file LEFT JOIN ua o ON o.unit = bb.file LEFT JOIN rf ON rf.file = bb.file)
 SELECT mm.b, mm.a, CASE WHEN mm.status = 'not_found' THEN cx.reason ELSE mm.status END AS status FROM mm LEFT JOIN cx ON cx.b = mm.b"""


@query(_ABSENCE_SQL)
def change_statuses(spark, d):
    """Every change between two snapshots, old issues that are gone with the reason. Suppliers are files and units."""
    before = catalog._side(spark, d, "l_orderkey % 9", "l_tax > 0.07", "l_orderkey % 11 <> 3")
    after = catalog._side(spark, d, "CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 9 + 1 ELSE l_orderkey % 9 END", "l_tax > 0.06", "l_orderkey % 13 <> 5")
    k = F.col("s_suppkey")
    s, name, fingerprint = table(spark, d, "supplier"), k.cast("string"), F.concat(F.lit("f"), (k % 7).cast("string"))
    units_before = s.select(name.alias("unit"), k.alias("ord"), F.lit("success").alias("status"), fingerprint.alias("fingerprint"))
    status = F.when(k % 23 == 1, "parse_failed").when(k % 19 == 5, "cancelled").otherwise("success")
    units_after = s.where(k % 29 != 2).select(name.alias("unit"), k.alias("ord"), status.alias("status"), F.when(k % 13 == 4, "g").when(k % 11 == 6, "").otherwise(fingerprint).alias("fingerprint"))
    covers_before = s.select(name.alias("unit"), (k + 1).cast("string").alias("file")).unionByName(s.where(k % 5 != 0).select(name.alias("unit"), name.alias("file")))
    covers_after = covers_before.where(F.col("unit").cast("long") % 31 != 7)
    files_after = s.where(k % 17 != 3).select(name.alias("file"))
    settings = spark.createDataFrame([("scope", True, True, ["A"], "r1")], "policy string, requested boolean, configured boolean, disabled array<string>, revision string")
    return facts.change_statuses(facts.match_issues(before, after), files_after, units_before, covers_before, units_after, covers_after, settings, settings).select("b", "a", "status")


# References and graphs -------------------------------------------------------------------------------------------

_REFS = "(SELECT CAST(l_partkey AS VARCHAR) AS symbol_id, CAST(l_suppkey AS VARCHAR) AS file, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS col, l_returnflag AS kind, l_linestatus AS enclosing_symbol, CAST(l_orderkey AS VARCHAR) AS translation_unit FROM lineitem)"


def _references(spark, d):
    c = lambda n, t, a: F.col(n).cast(t).alias(a)
    return table(spark, d, "lineitem").select(c("l_partkey", "string", "symbol_id"), c("l_suppkey", "string", "file"), c("l_linenumber", "long", "line"), c("l_quantity", "long", "column"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("enclosing_symbol"), c("l_orderkey", "string", "translation_unit"))


def _symbols(spark, d):
    return catalog.symbols(spark, d).withColumn("symbol_id", F.col("symbol_id").cast("string"))


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY file, line, \"column\", kind, enclosing_symbol, translation_unit) AS BIGINT) AS place FROM (SELECT * RENAME (col AS \"column\") FROM {_REFS} WHERE symbol_id = '7')")
def symbol_references(spark, d):
    found = facts.find_references(_references(spark, d), _symbols(spark, d), "7")
    return catalog._ranked(found, [F.col(c) for c in ("file", "line", "column", "kind", "enclosing_symbol", "translation_unit")])


@query(f"SELECT file, line, col AS \"column\", kind FROM {_REFS} WHERE symbol_id = '7' AND kind <> 'R'")
def select_references(spark, d):
    """The same question through ``select``."""
    refs = snapshots.conform(_references(spark, d), "references")
    return select(refs, "references", ["file", "line", "column", "kind"], (F.col("symbol_id") == "7") & (F.col("kind") != "R"), [("file", False), ("line", False)]).frame


@query(f"SELECT r.symbol_id, r.translation_unit, r.line, p.p_brand AS definition_file, CAST(p.p_size AS BIGINT) AS definition_line FROM {_REFS} r LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.symbol_id")
def reference_definitions(spark, d):
    return facts.definitions_of(_references(spark, d), _symbols(spark, d)).select("symbol_id", "translation_unit", "line", "definition_file", "definition_line")


@query("""WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS s, 'p' || CAST(l_partkey AS VARCHAR) AS t FROM lineitem WHERE l_returnflag = 'R'),
 n AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node FROM part UNION SELECT s FROM e UNION SELECT t FROM e)
 SELECT node, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree FROM n LEFT JOIN (SELECT s, count(*) AS n FROM e GROUP BY 1) o ON o.s = node LEFT JOIN (SELECT t, count(*) AS n FROM e GROUP BY 1) i ON i.t = node""")
def project_call_graph(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "call").otherwise("include").alias("kind"), name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"))
    return graph.project_graph(table(spark, d, "part").select(name("p", "p_partkey").alias("node")), edges, "call")


# Policy, units and commands --------------------------------------------------------------------------------------


@query(f"""WITH i AS (SELECT DISTINCT rule_id, file, line, col FROM {catalog._ISSUES}), s AS {catalog._SUPP}, f AS (SELECT s_suppkey AS file, 'h' || CAST(s_suppkey AS VARCHAR) AS hash FROM supplier)
 SELECT s.ord, s.file, f.hash AS source_hash, CASE WHEN f.hash IS NULL THEN 'outside the saved inventory' WHEN i.file IS NULL THEN 'no active issue at this site' WHEN trim(s.reason) = '' THEN 'a reason is needed' ELSE '' END AS problem
 FROM s LEFT JOIN f ON f.file = s.file LEFT JOIN i ON i.rule_id = s.rule_id AND i.file = s.file AND i.line = s.line AND i.col = s.col""")
def suppression_requests(spark, d):
    issues, inv, supp = catalog._policy(spark, d)
    return facts.create_suppressions(supp.drop("source_hash"), issues, inv).select("ord", "file", "source_hash", "problem")


@query("SELECT l_orderkey, l_linenumber, l_tax > 0.05 AS suppressed, CAST(l_tax > 0.05 AS INT) AS part FROM lineitem")
def issues_with_suppressed(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return facts.active_and_suppressed(li.where("NOT l_tax > 0.05").drop("l_tax"), li.where("l_tax > 0.05").drop("l_tax"))


@query("SELECT l_partkey, l_suppkey, arg_min(l_orderkey, (l_linenumber > 3, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY ALL")
def united_batches(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    batches = [li.where(c).drop("l_linenumber") for c in ("l_linenumber <= 3", "l_linenumber > 3")]
    return facts.unite_batches(batches, ["l_partkey", "l_suppkey"])


@query("""WITH c AS (SELECT l_partkey AS unit, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS least FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), w AS (SELECT p_partkey AS unit, p_partkey % 100 + 1 AS named FROM part WHERE p_partkey % 3 = 0),
 k AS (SELECT DISTINCT l_partkey AS unit, l_suppkey AS named FROM lineitem WHERE l_returnflag = 'R'),
 s AS (SELECT p_partkey AS unit, c.least, w.named, CASE WHEN c.n IS NULL THEN 'missing' WHEN w.named IS NOT NULL AND k.unit IS NULL THEN 'rejected' WHEN w.named IS NULL AND c.n > 1 THEN 'ambiguous' ELSE 'selected' END AS status
 FROM part LEFT JOIN c ON c.unit = p_partkey LEFT JOIN w ON w.unit = p_partkey LEFT JOIN k ON k.unit = w.unit AND k.named = w.named)
 SELECT unit, status, CASE WHEN status = 'selected' THEN coalesce(named, least) END AS command_id FROM s""")
def unit_commands(spark, d):
    units = table(spark, d, "part").select(F.col("p_partkey").alias("unit"))
    commands = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("command_id"))
    return facts.choose_commands(units, commands, units.where("unit % 3 = 0").withColumn("command_id", F.col("unit") % 100 + 1))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def best_command_per_file(spark, d):
    return facts.best_per_group(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT doc_id, lang IN ('fr', 'es') OR source IN ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') AS unsafe FROM documents")
def unsafe_commands(spark, d):
    """Languages and sources as compiler arguments."""
    lang = F.when(F.col("lang") == "fr", "@file").when(F.col("lang") == "es", "-fplugin=x").otherwise("-O2")
    source = F.when(F.col("source").startswith("src1"), F.concat(F.lit("-emit-"), "source")).otherwise(F.concat(F.lit("-I"), "source"))
    return table(spark, d, "documents").select("doc_id", facts.unsafe_arguments(F.array(lang, source)).alias("unsafe"))


# Builds ----------------------------------------------------------------------------------------------------------

_RUNS = "(SELECT o_orderkey AS run_id, o_custkey AS scan_id FROM orders ORDER BY 1 DESC LIMIT 50)"


@query(f"SELECT run_id, scan_id, CAST(l_linenumber AS BIGINT) AS ordinal, l_linestatus AS stage, '' AS stdout FROM {_RUNS} JOIN lineitem ON l_orderkey = run_id")
def builds_page(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("scan_id"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("stdout"))
    return snapshots.newest_builds(runs, steps)


@query("SELECT run_id, stage, CAST(row_number() OVER (ORDER BY run_id DESC, ordinal) AS BIGINT) AS place FROM (SELECT l_orderkey AS run_id, l_linestatus AS stage, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal FROM lineitem ORDER BY 1 DESC, 3 LIMIT 40)")
def select_builds(spark, d):
    """The first forty steps in the order of the view: newest run first, its steps as they ran."""
    ordinal = F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), ordinal.alias("ordinal"), F.col("l_linestatus").alias("stage"))
    got = select(steps, "builds", ["run_id", "stage"], None, None, 40).frame
    return got.withColumn("place", F.monotonically_increasing_id() + 1)  # a limit leaves one partition


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN -1 ELSE n_chars END AS total, CASE WHEN doc_id % 4 = 3 THEN -1 WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 9 END AS failed, CASE WHEN doc_id % 4 = 3 THEN -1 ELSE doc_id % 3 END AS skipped FROM documents""")
def ctest_counts(spark, d):
    n, i = F.col("n_chars").cast("string"), F.col("doc_id")
    summary = F.when(i % 4 == 0, F.concat(F.lit("100% tests passed out of "), n)).when(i % 4 == 3, "no summary").otherwise(F.concat(F.lit("50% tests passed, "), (i % 9).cast("string"), F.lit(" tests failed out of "), n))
    marks = F.concat(F.repeat(F.lit(" 1 ***Skipped\n 2 ***Not Run\n"), (i % 3).cast("int")), summary)
    return table(spark, d, "documents").select("doc_id", inventory.test_counts(marks).alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, CAST(length(substr(text, 1, n_chars // 2)) - length(replace(substr(text, 1, n_chars // 2), chr(10), '')) + 1 AS BIGINT) AS line FROM documents")
def lines_at_offsets(spark, d):
    return table(spark, d, "documents").select("doc_id", inventory.line_at(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


# Lexical facts over sources made of the given tables -------------------------------------------------------------

_TAIL = "CASE WHEN p_size % 7 = 0 THEN '' ELSE '}' || chr(10) END"


@query("""SELECT p_partkey AS file, 'fn' || CAST(p_partkey AS VARCHAR) AS name, CAST(1 AS INT) AS start_line, CAST(2 + p_size % 5 + p_size % 3 AS INT) AS end_line, CAST(1 + 2 * (p_size % 5) AS INT) AS complexity, CAST(2 + p_size % 4 AS INT) AS parameters FROM part""")
def function_heads(spark, d):
    """Functions with branches, ternaries and function-pointer parameters; every seventh size never closes."""
    p, size = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), F.col("p_size")
    lines = [F.lit("int fn"), F.col("p_partkey").cast("string"), F.lit("(int a, void (*cb)(int)"), F.repeat(F.lit(", int b"), size % 4), F.lit(") {\n"), F.repeat(F.lit("  if (a && a) a++;\n"), size % 5), F.repeat(F.lit("  x = a ? 1 : 2;\n"), size % 3), F.when(size % 7 == 0, "").otherwise("}\n")]
    prepared = lexical.prepare(p.select(F.col("p_partkey").alias("file"), F.concat(*lines).alias("text")))
    return prepared.select("file", F.explode("functions").alias("f")).select("file", *[f"f.{c}" for c in ("name", "start_line", "end_line", "complexity", "parameters")])


_OK = "  ok();"
_SOURCE = (
    ("strcpy(buf, src);", "p_size % 2 = 0", "DG001", "p_size % 2 = 0"), ("buf[9] = 1;", "p_size % 3 = 0", "DG002", "p_size % 3 = 0"), ("char* q = new char[3];", "p_size % 5 = 0", "DG003", "p_size % 5 = 0 AND p_size % 2 = 1"),
    ("delete q;", "p_size % 5 = 0 AND p_size % 2 = 0", None, "false"), ("if (n = 3) ok();", "p_size % 7 = 0", "DG004", "p_size % 7 = 0"), ("int* z = nullptr;", "p_size % 11 = 0", None, "false"), ("z->go();", "p_size % 11 = 0", "DG005", "p_size % 11 = 0"),
    ("FILE* h = fopen(a, b);", "p_size % 4 = 1", "DG007", "p_size % 4 = 1 AND p_size % 3 <> 2"), ("fclose(h);", "p_size % 3 = 2", None, "false"),
)


@query(" UNION ALL ".join(f"SELECT p_partkey AS file, '{rule}' AS rule_id, CAST({k + 3} AS INT) AS line, '{code}' AS evidence FROM part WHERE {when}" for k, (code, _, rule, when) in enumerate(_SOURCE) if rule))
def rule_findings(spark, d):
    """Pattern rules over a source for each part, whose lines depend on its size."""
    body = [F.lit("void f() {"), F.lit("char buf[8];"), *[F.when(F.expr(when), F.lit(f"  {code}")).otherwise(F.lit(_OK)) for code, when, _, _ in _SOURCE], F.lit("}")]
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    sources = parts.select(F.col("p_partkey").alias("file"), F.concat_ws("\n", *body).alias("text"))
    return lexical.inspect(sources).select("file", "rule_id", F.col("line").cast("int").alias("line"), "evidence")


# Records, gates and reports --------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT text, min(doc_id) AS kept_id, min(n_chars % 2) <> max(n_chars % 2) AS conflict FROM documents GROUP BY 1) SELECT kept_id, doc_id AS duplicate_id, source AS group_id, conflict FROM documents JOIN k USING (text) WHERE doc_id <> kept_id""")
def duplicate_records(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text", (F.col("n_chars") % 2).alias("label"), F.col("source").alias("group_id"))
    return evaluation.duplicates(docs, F.sha2("text", 256))


_SPLIT = "CASE WHEN doc_id % 97 = 5 THEN 'test' WHEN length(source) % 2 = 0 THEN 'train' ELSE 'validation' END"


@query(f"""WITH r AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT doc_id, {_SPLIT} AS split FROM documents WHERE doc_id % 53 <> 7),
 p AS (SELECT * FROM r JOIN s USING (doc_id)), c AS (SELECT split, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1 FROM p GROUP BY 1)
 SELECT 'in no split' AS problem, CAST(doc_id AS VARCHAR) AS item FROM r WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT 'unknown record', CAST(doc_id AS VARCHAR) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM r)
 UNION ALL SELECT 'group in several splits', source FROM p GROUP BY source HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'class counts differ', split FROM c WHERE split = 'train' OR n1 <> n1""")
def manifest_problems(spark, d):
    docs = table(spark, d, "documents")
    records = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("group_id"), F.col("quality").alias("label"))
    split = F.when(F.col("doc_id") % 97 == 5, "test").when(F.length("source") % 2 == 0, "train").otherwise("validation")
    splits = docs.where("doc_id % 53 <> 7").select(F.col("doc_id").alias("sample_id"), split.alias("split"))
    counts = evaluation.class_counts(records.join(splits, "sample_id")).withColumn("n0", F.col("n0") + (F.col("split") == "train").cast("int"))
    return evaluation.manifest_problems(records, splits, counts)


@query(f"""WITH {catalog._SCORED}, c AS (SELECT source, {catalog._COUNTS} FROM s GROUP BY 1), a AS (SELECT source, (tp + tn) / (tp + tn + fp + fn) AS t FROM c), st AS (SELECT source, CASE WHEN length(source) % 2 = 0 THEN t + 1 ELSE t END AS accuracy, t AS true_accuracy FROM a)
 SELECT source, accuracy, true_accuracy FROM st WHERE accuracy <> true_accuracy""")
def stale_metrics(spark, d):
    rows = catalog._scored(spark, d)
    stored = evaluation.confusion(rows, by=["source"]).select("source", (F.col("accuracy") + F.when(F.length("source") % 2 == 0, 1.0).otherwise(0.0)).alias("accuracy"))
    return evaluation.recomputed(stored, rows, ["source"])


@query("""WITH t AS (SELECT doc_id AS sample_id, source, quality AS label, seed, ((doc_id * seed + n_chars % 101) % 101) / 100.0 AS probability FROM documents JOIN labels USING (doc_id), (VALUES (1), (2), (3)) v(seed)),
 c AS (SELECT source, seed, count(*) FILTER (WHERE label = 1 AND probability >= 0.5) AS tp, count(*) FILTER (WHERE label <> 1 AND probability < 0.5) AS tn, count(*) FILTER (WHERE label <> 1 AND probability >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND probability < 0.5) AS fn FROM t GROUP BY ALL),
 b AS (SELECT *, (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2 AS ba FROM c)
 SELECT source, avg(ba) AS mean, count(*) FILTER (WHERE tp + fp > 0 AND tn + fn > 0) AS sound, avg(ba) >= 0.6 AND count(*) FILTER (WHERE tp + fp > 0 AND tn + fn > 0) >= 2 AS passed FROM b GROUP BY 1""")
def model_gate(spark, d):
    return evaluation.gate(evaluation.confusion(catalog._seed_rows(spark, d), by=["source", "seed"]), ["source"])


@query("SELECT user_id, bool_or(event_type = 'purchase') AS fails FROM events GROUP BY 1")
def quality_gates(spark, d):
    return evaluation.quality_gate(table(spark, d, "events"), ["user_id"], text.severity_rank(F.col("event_type"), ("view", "click", "purchase")), 3)


@query(f"WITH {catalog._SCORED} SELECT sample_id, probability, CASE WHEN sample_id % 3 = 0 THEN sample_id ELSE sample_id % 7 + 1 END AS line FROM s WHERE probability >= 0.5")
def scored_findings(spark, d):
    rows = catalog._scored(spark, d).withColumn("start_line", F.col("sample_id")).withColumn("ranked", F.when(F.col("sample_id") % 3 != 0, F.array(F.col("sample_id") % 7 + 1)))
    return evaluation.scored_findings(rows).select("sample_id", "probability", "line")


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_quantity DESC, l_linenumber) AS ranked FROM lineitem GROUP BY 1")
def lines_by_score(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("score"))).alias("s"))
    return scores.select("l_orderkey", F.array_join(F.transform(evaluation.ranked_lines(F.col("s")), lambda x: x.cast("string")), ",").alias("ranked"))


@query("""SELECT doc_id AS sample_id, rule FROM (SELECT doc_id, unnest(['sample_id', 'label_source', 'label', 'lines', 'source_hash', 'defect_lines', 'edges', 'edge_types', 'nodes', 'edge_layers']) AS rule,
 unnest([true, doc_id % 5 <> 0, doc_id % 7 <> 3, doc_id % 11 <> 0, doc_id % 13 <> 0, doc_id % 2 = 1 OR doc_id % 7 = 3, doc_id % 3 <> 2, doc_id % 17 <> 1, true, doc_id % 3 <> 2 AND doc_id % 17 <> 1 AND doc_id % 19 <> 4]) AS ok FROM documents) WHERE NOT ok""")
def unsound_records(spark, d):
    """Records made of documents, each breaking some of the rules."""
    i = F.col("doc_id")
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    rows = table(spark, d, "documents").select(
        i.cast("string").alias("sample_id"), F.lit("g").alias("group_id"), when(i % 5 == 0, F.lit(" Rule "), F.lit("human")).alias("label_source"), when(i % 7 == 3, F.lit(2), (i % 2).cast("int")).alias("label"),
        when(i % 11 == 0, F.lit(3), F.lit(1)).alias("start_line"), F.lit(2).alias("end_line"), F.col("text").alias("source"), when(i % 13 == 0, F.lit("x"), F.sha2("text", 256)).alias("source_sha256"),
        F.array(when(i % 11 == 0, F.lit(3), F.lit(1)).cast("long")).alias("defect_lines"), F.array(F.lit("cfg"), when(i % 19 == 4, F.lit("cfg"), F.lit("ast")), F.lit("ast")).alias("layers"),
        F.array(F.lit(0)).alias("edge_from"), F.array(when(i % 3 == 2, F.lit(9), F.lit(1))).alias("edge_to"), F.array(when(i % 17 == 1, F.lit(7), F.lit(2))).alias("edge_type"),
    )
    # where start lies after the end no line is in range
    rows = rows.withColumn("end_line", F.lit(2)).withColumn("defect_lines", F.when(F.col("start_line") > F.col("end_line"), F.when(F.col("label") == 0, F.array(F.lit(3).cast("long"))).otherwise(F.array().cast("array<bigint>"))).otherwise(F.col("defect_lines")))
    return dataset.violations(rows, "sample_id", evaluation.record_rules()).select(F.col("sample_id").cast("long").alias("sample_id"), "rule")


@query("SELECT l_orderkey, count(*) AS units, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS successful FROM lineitem GROUP BY 1")
def unit_tiles(spark, d):
    return reports.tiles(table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "success").otherwise("parse_failed").alias("status")), ["l_orderkey"])


@query("SELECT l_shipdate::DATE::VARCHAR AS detector, count(*) AS n FROM lineitem GROUP BY 1")
def findings_per_detector(spark, d):
    return reports.detector_counts(table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("detector")))


@query("SELECT p_brand, count(*) AS functions, CAST(max(greatest(p_size - 5, 0)) AS INT) AS most_max_nesting, max(greatest(CAST(p_partkey % 13 AS BIGINT), 0)) AS most_fan_in, CAST(max(p_size) AS INT) AS most_fan_out FROM part GROUP BY 1")
def corpus_counters(spark, d):
    p = table(spark, d, "part").select("p_brand", (F.col("p_size") - 5).alias("max_nesting"), (F.col("p_partkey") % 13).alias("fan_in"), F.col("p_size").alias("fan_out"))
    return reports.corpus_counters(p, ["p_brand"])


@query("SELECT p_brand AS weakness, count(*) AS pairs, count(DISTINCT p_type) AS families, count(DISTINCT p_name) AS templates FROM part GROUP BY 1")
def weakness_families(spark, d):
    return reports.family_counts(table(spark, d, "part").select(F.col("p_brand").alias("weakness"), F.col("p_type").alias("family"), F.col("p_name").alias("template")))


@query("SELECT o_custkey, CAST(sum(o_orderkey % 5) AS BIGINT) AS nodes, CAST(sum(o_orderkey % 3) AS BIGINT) AS edges, bool_and(o_orderstatus = 'F') AS all_complete, bool_or(o_orderpriority = '1-URGENT') AS any_changed FROM orders GROUP BY 1")
def structure_totals(spark, d):
    of = lambda n: F.array_repeat(F.lit(1), (F.col("o_orderkey") % n).cast("int"))
    rows = table(spark, d, "orders").select("o_custkey", of(5).alias("nodes"), of(3).alias("edges"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("dfg_status"), (F.col("o_orderpriority") == "1-URGENT").alias("changed"))
    return reports.structure_sums(rows, ["o_custkey"])


@query("SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS base_ms, avg(value) FILTER (WHERE event_type = 'click') AS other_ms, avg(value) FILTER (WHERE event_type = 'view') / avg(value) FILTER (WHERE event_type = 'click') AS speed_up FROM events GROUP BY 1")
def variant_means(spark, d):
    return reports.mean_times(table(spark, d, "events").select("user_id", F.col("event_type").alias("variant"), F.col("value").alias("ms")), ["user_id"], "view", "click")


_LANGUAGE_FILES = f"SELECT language AS grp, sha256(file || chr(0) || hash || chr(0)) AS leaf, row_number() OVER (PARTITION BY language ORDER BY file) - 1 AS pos FROM {catalog.FILES_SQL}"


@query(f"SELECT grp AS language, rows AS files, digest AS fingerprint FROM ({digest_sql(_LANGUAGE_FILES)})")
def project_fingerprints(spark, d):
    return reports.project_fingerprint(catalog.files(spark, d), ["language"])
