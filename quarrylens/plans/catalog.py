"""The registered queries over the given tables, each with the same question in SQL.

The tables hold no source code, so each operator runs on an analogous view of them (orders as scans, parts as
symbols, line items as per-unit facts, documents as files, ...).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import lexical, text
from quarrylens.operators import dataset, evaluation, facts, graph, reports
from quarrylens.plans.select import select
from quarrylens.sources import inventory, snapshots
from quarrylens.sources.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Logical views ---------------------------------------------------------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files."""
    docs = table(spark, d, "documents")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return docs.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("lang").alias("language"), (newlines + 1).cast("long").alias("lines"),
        F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("mtime"), F.sha2("text", 256).alias("hash"),
    )


FILES_SQL = r"""(SELECT source || '/' || CAST(doc_id AS VARCHAR) AS file, lang AS language,
 CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, CAST(strlen(text) AS BIGINT) AS size,
 doc_id AS mtime, sha256(text) AS hash FROM documents)"""


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` with its place in a total order, so that a comparison that ignores row order sees it. For results that
    a limit has made small."""
    from pyspark.sql import Window as W

    return df.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


@query(f"SELECT file, lines, CAST(row_number() OVER (ORDER BY lines DESC, file) AS BIGINT) AS place FROM {FILES_SQL} WHERE lines >= 10 AND language = 'en' ORDER BY lines DESC, file LIMIT 20")
def select_filter_sort_limit(spark, d):
    got = select(files(spark, d), "files", ["file", "lines"], "lines >= 10 AND language = 'en'", [("lines", True)], 20).frame
    return _ranked(got, [F.desc("lines"), F.asc("file")])


@query(f"SELECT file, lines FROM {FILES_SQL} WHERE language = 'de' OR lines > 10 AND size > 3000")
def select_precedence(spark, d):
    return select(files(spark, d), "files", ["file", "lines"], (F.col("language") == "de") | (F.col("lines") > 10) & (F.col("size") > 3000)).frame


@query(f"SELECT * FROM {FILES_SQL} WHERE lines <> 1 AND (size <= 2000 OR mtime >= 900)")
def select_star(spark, d):
    return select(files(spark, d), "files", None, "lines <> 1 AND (size <= 2000 OR mtime >= 900)").frame


@query(f"SELECT file, CAST(row_number() OVER (ORDER BY lines DESC, size, file) AS BIGINT) AS place FROM (SELECT * FROM {FILES_SQL} ORDER BY lines DESC, size, file LIMIT 100)")
def select_multi_key(spark, d):
    got = select(files(spark, d), "files", ["file", "lines", "size"], None, [("lines", True), ("size", False)], 100).frame
    return _ranked(got, [F.desc("lines"), F.asc("size"), F.asc("file")]).select("file", "place")


@query(f"SELECT count(*) AS scanned, CAST(count(*) FILTER (WHERE lines > 5) AS BIGINT) AS matched FROM {FILES_SQL}")
def select_counts(spark, d):
    got = files(spark, d)
    return got.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("lines") > 5).alias("matched"))


def symbols(spark, d):
    """Parts as symbols."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("line"), (F.col("p_partkey") % 10 == 0).alias("external"))


@query("""SELECT p.p_partkey AS symbol_id, p.p_name AS name, p.p_brand AS file, CAST(p.p_size AS BIGINT) AS line, m.complexity, m.n FROM
 (SELECT l_partkey AS k, CAST(max(l_quantity) AS BIGINT) AS complexity, count(*) AS n FROM lineitem GROUP BY 1) m JOIN part p ON p.p_partkey = m.k""")
def functions_view(spark, d):
    li = table(spark, d, "lineitem")
    metrics = li.groupBy(F.col("l_partkey").alias("symbol_id")).agg(F.max("l_quantity").cast("long").alias("complexity"), F.count(F.lit(1)).alias("n"))
    return snapshots.functions_view(metrics, symbols(spark, d)).select("symbol_id", "name", "file", "line", "complexity", "n")


@query("SELECT DISTINCT l_orderkey AS symbol_id FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)")
def orphan_metrics(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("symbol_id")).distinct()
    return snapshots.orphan_metrics(keys, symbols(spark, d))


@query("SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE starts_with(p_name, 'part 1') OR starts_with(p_name, 'Part#1') AND p_partkey % 10 <> 0")
def symbol_prefix(spark, d):
    s = symbols(spark, d)
    return s.where(F.col("name").startswith("part 1") | F.col("name").startswith("Part#1") & ~F.col("external")).select("symbol_id", "name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(lower(c_mktsegment), 'r#00000001') OR contains(lower(CAST(c_custkey AS VARCHAR)), 'r#00000001') OR contains(lower(c_mktsegment), 'build')")
def any_cell_contains(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.where(text.any_cell_contains(c, "R#00000001") | text.any_cell_contains(c, "build"))


# History and builds ----------------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey AS scan_id, CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS BIGINT) AS files,
 CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS BIGINT) AS issues
 FROM orders o WHERE o.o_orderkey < 5000 ORDER BY 1 DESC LIMIT 200""")
def history_page(spark, d):
    scans = table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), "l_returnflag")
    return snapshots.history_page(scans, {"files": li, "issues": li.where("l_returnflag = 'R'")}, 5000, 200)


@query("SELECT o_custkey AS root, max(o_orderkey) AS scan_id, arg_max(o_orderpriority, o_orderkey) AS scanned_at FROM orders GROUP BY 1")
def latest_per_project(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderpriority").alias("at"))
    return snapshots.latest_per_project(o, "root", "scan_id", "at")


@query("SELECT o_orderkey AS run_id, o_custkey AS scan_id, CAST(l_linenumber AS BIGINT) AS ordinal, l_linestatus AS stage, CAST(round(l_quantity) AS BIGINT) AS duration_ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def builds_view(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("scan_id"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_linestatus").alias("stage"), F.round("l_quantity").cast("long").alias("duration_ms"))
    return snapshots.builds_view(runs, steps)


@query("""SELECT l_orderkey AS scan_id, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS good, CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS bad,
 CASE WHEN count(*) FILTER (WHERE l_returnflag = 'N') = 0 THEN 'failed' WHEN count(*) FILTER (WHERE l_returnflag <> 'N') > 0 THEN 'partial' ELSE 'complete' END AS status FROM lineitem GROUP BY 1""")
def analysis_status(spark, d):
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.when(F.col("l_returnflag") == "N", "success").otherwise("parse_failed").alias("status"))
    return facts.analysis_status(units, ["scan_id"])


# Inventories -----------------------------------------------------------------------------------------------------

_SIDES = """b AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
 a AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)"""
_DIFF = f"""WITH {_SIDES}, f AS (SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type,
 CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS change
 FROM b FULL JOIN a ON a.user_id = b.user_id AND a.event_type = b.event_type)"""


def _diff(spark, d):
    ev, cut = table(spark, d, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    side = lambda c: ev.where(c).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return facts.inventory_diff(side(F.col("ts") < cut), side(F.col("ts") >= cut), ["user_id", "event_type"], "v")


@query(_DIFF + " SELECT * FROM f")
def inventory_diff(spark, d):
    return _diff(spark, d)


@query(_DIFF + " SELECT change, count(*) AS n FROM f GROUP BY 1")
def diff_counters(spark, d):
    return _diff(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS file, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_files(spark, d):
    return facts.uncovered(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "source"), table(spark, d, "labels").select(F.col("doc_id").alias("file")))


@query("""SELECT brand AS brand, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT p_brand AS brand, 1 AS n FROM part UNION ALL SELECT p_brand, -1 FROM part WHERE p_size > 25) GROUP BY 1 HAVING sum(n) <> 0""")
def multiset_surplus(spark, d):
    p = table(spark, d, "part")
    return facts.same_rows(p.select(F.col("p_brand").alias("brand")), p.where("p_size > 25").select(F.col("p_brand").alias("brand")))


@query("SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM " + FILES_SQL + " GROUP BY 1")
def language_counts(spark, d):
    return files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


@query("SELECT s.severity, CAST(count(e.event_type) AS BIGINT) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN (SELECT CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'purchase' THEN 'high' END AS severity, event_type FROM events) e USING (severity) GROUP BY 1")
def severity_counts(spark, d):
    sev = F.when(F.col("event_type") == "view", "low").when(F.col("event_type") == "click", "medium").when(F.col("event_type") == "purchase", "high")
    levels = spark.createDataFrame([(s,) for s in ("low", "medium", "high", "critical")], "severity string")
    counts = table(spark, d, "events").select(sev.alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 0 END >= 2")
def severity_at_least(spark, d):
    e = table(spark, d, "events")
    return e.where(text.severity_rank(F.col("event_type"), ("view", "click", "purchase")) >= 2).select("event_id", "event_type")


# Per-unit facts --------------------------------------------------------------------------------------------------


def _unit_facts(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("symbol_id"), (F.col("l_returnflag") == "R").alias("definition"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("column"), F.col("l_orderkey").alias("tu_ord"))


@query("""SELECT symbol_id, definition, file, line, "column", tu_ord FROM (SELECT l_partkey AS symbol_id, l_returnflag = 'R' AS definition, l_suppkey AS file, l_linenumber AS line,
 CAST(l_quantity AS INT) AS "column", l_orderkey AS tu_ord, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_suppkey, l_linenumber, CAST(l_quantity AS INT), l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def merge_symbols(spark, d):
    return facts.merge_symbols(_unit_facts(spark, d))


@query("""SELECT symbol_id, complexity, tu_ord FROM (SELECT l_partkey AS symbol_id, CAST(l_quantity AS BIGINT) AS complexity, l_orderkey AS tu_ord,
 row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def merge_metrics(spark, d):
    return facts.merge_metrics(table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_quantity").cast("long").alias("complexity"), F.col("l_orderkey").alias("tu_ord")))


@query("""SELECT file, line, "column", rule_id, tu_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY file, line, "column", rule_id, s ORDER BY tu_ord, ord) AS k FROM
 (SELECT l_suppkey AS file, l_linenumber AS line, CAST(l_quantity AS INT) AS "column", l_returnflag AS rule_id, l_orderkey % 7 AS tu_ord, l_orderkey AS ord, l_linestatus AS s FROM lineitem)) WHERE k = 1""")
def merge_issues(spark, d):
    li = table(spark, d, "lineitem")
    tu = (F.col("l_orderkey") % 7).cast("string")
    own = F.when(F.col("l_orderkey") % 2 == 0, F.concat("l_linestatus", F.lit("@tu="), tu)).otherwise(F.col("l_linestatus"))
    issues = li.select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("column"), F.col("l_returnflag").alias("rule_id"), (F.col("l_orderkey") % 7).alias("tu_ord"), F.col("l_orderkey").alias("ord"), own.alias("symbol_id"), tu.alias("tu"))
    return facts.merge_issues(issues).select("file", "line", "column", "rule_id", "tu_ord", "ord")


@query("""SELECT p_partkey AS symbol_id, CAST(coalesce(i.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(o.n, 0) AS BIGINT) AS fan_out FROM part
 LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) i ON i.k = p_partkey LEFT JOIN (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) o ON o.k = p_partkey""")
def fan_in_out(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return facts.fan(symbols(spark, d).select("symbol_id"), calls).select("symbol_id", "fan_in", "fan_out")


@query("SELECT CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem)")
def unique_edge_count(spark, d):
    e = graph.unique_edges(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")))
    return e.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"))


# Policy and comparison -------------------------------------------------------------------------------------------

_ISSUES = "(SELECT l_returnflag AS rule_id, l_suppkey AS file, l_linenumber AS line, CAST(l_quantity AS INT) AS col, l_orderkey AS ord, l_linestatus AS severity FROM lineitem)"
_SUPP = "(SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'X' END AS rule_id, o_custkey % 120 AS file, CAST(o_orderkey % 7 + 1 AS INT) AS line, CAST(o_orderkey % 50 + 1 AS INT) AS col, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'h' || CAST(o_custkey % 120 AS VARCHAR) END AS source_hash, o_orderpriority AS reason FROM orders)"


def _policy(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    issues = li.select(F.col("l_returnflag").alias("rule_id"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("column"), F.col("l_orderkey").alias("ord"), F.col("l_linestatus").alias("severity"))
    inv = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("hash"))
    file = F.col("o_custkey") % 120
    supp = o.select(
        F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, "R").when(F.col("o_orderkey") % 3 == 1, "A").otherwise("X").alias("rule_id"), file.alias("file"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("line"),
        (F.col("o_orderkey") % 50 + 1).cast("int").alias("column"), F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.concat(F.lit("h"), file.cast("string"))).alias("source_hash"), F.col("o_orderpriority").alias("reason"),
    )
    return issues, inv, supp


@query(f"""WITH i AS {_ISSUES}, s AS {_SUPP}, f AS (SELECT s_suppkey AS file, 'h' || CAST(s_suppkey AS VARCHAR) AS hash FROM supplier),
 live AS (SELECT s.rule_id, s.file, s.line, s.col, arg_min(s.reason, s.ord) AS reason FROM s JOIN f ON f.file = s.file AND f.hash = s.source_hash GROUP BY ALL)
 SELECT i.rule_id, i.file, i.line, i.col AS "column", i.ord, CASE WHEN i.rule_id = 'R' THEN 'info' ELSE i.severity END AS severity, coalesce(live.reason, '') AS reason
 FROM i LEFT JOIN live ON live.rule_id = i.rule_id AND live.file = i.file AND live.line = i.line AND live.col = i.col""")
def policy_apply(spark, d):
    issues, inv, supp = _policy(spark, d)
    return facts.apply_policy(issues, inv, supp, spark.createDataFrame([("R", "info")], "rule_id string, severity string")).select("rule_id", "file", "line", "column", "ord", "severity", "reason")


@query(f"""WITH i AS (SELECT DISTINCT rule_id, file, line, col FROM {_ISSUES}), s AS {_SUPP}, f AS (SELECT s_suppkey AS file, 'h' || CAST(s_suppkey AS VARCHAR) AS hash FROM supplier),
 j AS (SELECT s.*, f.hash, i.file IS NOT NULL AS hit, coalesce(i.file IS NOT NULL AND f.hash = s.source_hash, false) AS live FROM s LEFT JOIN f ON f.file = s.file LEFT JOIN i ON i.rule_id = s.rule_id AND i.file = s.file AND i.line = s.line AND i.col = s.col),
 k AS (SELECT *, min(CASE WHEN live THEN ord END) OVER (PARTITION BY rule_id, file, line, col) AS first FROM j)
 SELECT ord, rule_id, file, line, col AS "column", CASE WHEN hash IS NULL THEN 'file is missing or excluded' WHEN hash <> source_hash THEN 'source changed; review the issue again' WHEN rule_id = 'X' THEN 'rule disabled'
 ELSE 'no matching issue; check parse coverage, active configuration or whether the issue was fixed' END AS why FROM k WHERE NOT live OR ord <> first""")
def policy_unused(spark, d):
    issues, inv, supp = _policy(spark, d)
    return facts.unused_suppressions(issues, inv, supp, spark.createDataFrame([("X",)], "rule_id string"))


_SIDE_SQL = """SELECT l_returnflag AS rule_id, CAST(l_suppkey AS VARCHAR) AS file, CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS symbol_id, l_linestatus AS detector,
 CASE WHEN l_linenumber = 6 THEN '[AST node: x]' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS evidence, {line} AS line, l_linenumber AS col, (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, {sup} AS sup FROM lineitem WHERE {where}"""
_BEFORE = _SIDE_SQL.format(line="CAST(l_orderkey % 9 AS INT)", sup="l_tax > 0.07", where="l_orderkey % 11 <> 3")
_AFTER = _SIDE_SQL.format(line="CAST(CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 9 + 1 ELSE l_orderkey % 9 END AS INT)", sup="l_tax > 0.06", where="l_orderkey % 13 <> 5")
_MATCH = f"""WITH b0 AS ({_BEFORE}), a0 AS ({_AFTER}),
 b AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file, symbol_id, detector, evidence, line, col ORDER BY ord) AS k, count(*) OVER (PARTITION BY rule_id, file, symbol_id, detector, evidence) AS n FROM b0),
 a AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file, symbol_id, detector, evidence, line, col ORDER BY ord) AS k, count(*) OVER (PARTITION BY rule_id, file, symbol_id, detector, evidence) AS n FROM a0),
 e AS (SELECT b.ord AS b, a.ord AS a FROM b JOIN a ON a.rule_id = b.rule_id AND a.file = b.file AND a.symbol_id = b.symbol_id AND a.detector = b.detector AND a.evidence = b.evidence AND a.line = b.line AND a.col = b.col AND a.k = b.k),
 m AS (SELECT b.ord AS b, a.ord AS a FROM b JOIN a ON a.rule_id = b.rule_id AND a.file = b.file AND a.symbol_id = b.symbol_id AND a.detector = b.detector AND a.evidence = b.evidence
  WHERE a.n = 1 AND b.n = 1 AND b.symbol_id <> '' AND b.evidence <> '' AND NOT starts_with(b.evidence, '[AST node:') AND b.ord NOT IN (SELECT b FROM e) AND a.ord NOT IN (SELECT a FROM e)),
 p AS (SELECT * FROM e UNION ALL SELECT * FROM m)
 SELECT p.b, p.a, CASE WHEN NOT b.sup AND a.sup THEN 'suppressed' WHEN b.sup AND NOT a.sup THEN 'reactivated' WHEN a.sup THEN 'persistent_suppressed' ELSE 'persistent' END AS status FROM p JOIN b ON b.ord = p.b JOIN a ON a.ord = p.a
 UNION ALL SELECT ord, NULL, 'not_found' FROM b WHERE ord NOT IN (SELECT b FROM p) UNION ALL SELECT NULL, ord, CASE WHEN sup THEN 'new_suppressed' ELSE 'added' END FROM a WHERE ord NOT IN (SELECT a FROM p)"""


def _side(spark, d, line, sup, where):
    li = table(spark, d, "lineitem").where(where)
    return li.select(
        F.col("l_returnflag").alias("rule_id"), F.col("l_suppkey").cast("string").alias("file"), F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_partkey").cast("string")).alias("symbol_id"), F.col("l_linestatus").alias("detector"),
        F.when(F.col("l_linenumber") == 6, "[AST node: x]").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("evidence"), F.expr(line).cast("int").alias("line"), F.col("l_linenumber").alias("column"), ((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("ord"), F.expr(sup).alias("suppressed"),
    )


@query(_MATCH)
def compare_match(spark, d):
    before = _side(spark, d, "l_orderkey % 9", "l_tax > 0.07", "l_orderkey % 11 <> 3")
    after = _side(spark, d, "CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 9 + 1 ELSE l_orderkey % 9 END", "l_tax > 0.06", "l_orderkey % 13 <> 5")
    m = facts.match_issues(before, after)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    status = F.when(both & ~F.col("b_suppressed") & F.col("a_suppressed"), "suppressed").when(both & F.col("b_suppressed") & ~F.col("a_suppressed"), "reactivated").when(both & F.col("a_suppressed"), "persistent_suppressed").when(both, "persistent").when(F.col("b").isNotNull(), "not_found").when(F.col("a_suppressed"), "new_suppressed").otherwise("added")
    return m.select("b", "a", status.alias("status"))


# Graphs ----------------------------------------------------------------------------------------------------------


def _flow(spark, d):
    """The lines of an order as the blocks of a function (lines of one number are one block): each goes on to the next line, and
    a returned one back to the order's first returned line. Later blocks have smaller numbers."""
    from pyspark.sql import Window as W

    node = F.col("l_orderkey") * 10 - F.col("l_linenumber")
    order = W.partitionBy("l_orderkey")
    li = table(spark, d, "lineitem").select(node.alias("source"), F.lead(node).over(order.orderBy("l_linenumber")).alias("next"), F.when(F.col("l_returnflag") == "R", F.max(F.when(F.col("l_returnflag") == "R", node)).over(order)).alias("back"))
    return li.select("source", F.explode(F.array_compact(F.array(F.nullif("next", "source"), "back"))).alias("target"))


_FLOW_SQL = """f AS (SELECT l_orderkey * 10 - l_linenumber AS s, lead(l_orderkey * 10 - l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt,
 CASE WHEN l_returnflag = 'R' THEN max(l_orderkey * 10 - l_linenumber) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) END AS back FROM lineitem),
 e AS (SELECT s, nxt AS t FROM f WHERE nxt <> s UNION SELECT s, back FROM f WHERE back IS NOT NULL)"""
_SCC = f"""WITH RECURSIVE {_FLOW_SQL}, r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t), v AS (SELECT s AS n FROM e UNION SELECT t FROM e),
 c AS (SELECT v.n AS node, least(v.n, coalesce(min(r.t), v.n)) AS component FROM v LEFT JOIN (SELECT r.s, r.t FROM r JOIN r q ON q.s = r.t AND q.t = r.s) r ON r.s = v.n GROUP BY v.n)"""


@query(f"WITH RECURSIVE {_FLOW_SQL}, r AS (SELECT l_orderkey * 10 - l_linenumber AS node FROM lineitem WHERE l_tax = 0 UNION SELECT e.t FROM r JOIN e ON e.s = r.node) SELECT node FROM r")
def graph_reachable(spark, d):
    roots = table(spark, d, "lineitem").where("l_tax = 0").select((F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("node"))
    return graph.reachable(_flow(spark, d), roots).select("node")


@query(_SCC + " SELECT node, component FROM c")
def graph_strong_components(spark, d):
    return graph.strong_components(_flow(spark, d))


@query(_SCC + " SELECT c.component, count(*) AS size FROM c GROUP BY 1 HAVING count(*) > 1 OR max(CAST(EXISTS (SELECT 1 FROM e WHERE e.s = c.node AND e.t = c.node) AS INT)) = 1")
def graph_cycles(spark, d):
    e = _flow(spark, d)
    return graph.cycles(e, graph.strong_components(e))


@query("""WITH RECURSIVE f AS (SELECT l_orderkey * 10 + l_linenumber AS s, lead(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS a,
 lead(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) AS b FROM lineitem), e AS (SELECT s, a AS t FROM f WHERE a <> s UNION SELECT s, b FROM f WHERE b <> s),
 l AS (SELECT s AS node, 0 AS level FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT e.t, l.level + 1 FROM l JOIN e ON e.s = l.node) SELECT node, CAST(max(level) AS INT) AS level FROM l GROUP BY 1""")
def graph_levels(spark, d):
    """A line comes before the order's next one with its return flag, and the next one with its line status."""
    from pyspark.sql import Window as W

    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    after = [F.nullif(F.lead(node).over(W.partitionBy("l_orderkey", c).orderBy("l_linenumber")), node) for c in ("l_returnflag", "l_linestatus")]
    li = table(spark, d, "lineitem").select(node.alias("source"), F.array(*after).alias("after"))
    return graph.topological_levels(li.select("source", F.explode(F.array_compact("after")).alias("target")))


@query("SELECT o_custkey AS graph, o_orderkey AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS position FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def graph_topological_orders(spark, d):
    """A chain of each customer's orders."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("source"))
    chain = o.withColumn("target", F.lead("source").over(W.partitionBy("graph").orderBy("source"))).where("target IS NOT NULL")
    return graph.topological_orders(chain)


@query("""WITH RECURSIVE x AS (SELECT DISTINCT source, text FROM documents), e AS (SELECT DISTINCT a.source AS s, b.source AS t FROM x a JOIN x b USING (text)), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t) SELECT s AS node, min(t) AS root FROM r GROUP BY 1""")
def split_groups(spark, d):
    """Sources that share a text belong together."""
    docs = table(spark, d, "documents").select("text", F.col("source").alias("group_id"))
    return graph.components(evaluation.group_links(docs, F.sha2("text", 256)))


@query("""SELECT function, 'd' || CAST(source AS VARCHAR) AS source, 'u' || CAST(turn AS VARCHAR) AS target, role AS symbol FROM
 (SELECT conv_id AS function, turn, role, max(turn) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM conversations) WHERE source IS NOT NULL""")
def reaching_definitions(spark, d):
    """Each turn uses its role's last definition and defines it anew; turns follow each other."""
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").select(F.col("conv_id").alias("function"), "turn", "role")
    w = W.partitionBy("function").orderBy("turn")
    event = lambda k, n: F.struct(F.lit(k).alias("kind"), F.col("role").alias("symbol"), F.concat(F.lit(n), F.col("turn").cast("string")).alias("node"))
    block = F.col("turn").cast("string")
    blocks = c.select("function", block.alias("block"), F.when(F.row_number().over(w) == 1, "entry").otherwise("block").alias("kind"), F.array(event("use", "u"), event("def", "d")).alias("events"))
    edges = c.select("function", block.alias("source"), F.lead(block).over(w).alias("target")).where("target IS NOT NULL")
    return graph.reaching_definitions(blocks, edges)


# Text ------------------------------------------------------------------------------------------------------------

_LINES = r"SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\s+', '', 'g') AS line FROM documents"


@query(f"SELECT doc_id, count(*) AS n, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS duplicated FROM ({_LINES}) WHERE length(line) >= 4 GROUP BY 1")
def duplicate_lines(spark, d):
    docs = table(spark, d, "documents")
    norm = F.filter(F.transform(F.split("text", "\n"), text.normal_line), lambda x: x.isNotNull())
    return docs.select("doc_id", norm.alias("x")).where(F.size("x") > 0).select("doc_id", F.size("x").cast("long").alias("n"), (F.size("x") - F.size(F.array_distinct("x"))).cast("long").alias("duplicated"))


@query(f"SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(k - 1) AS BIGINT) AS duplicated FROM (SELECT line, count(*) AS k FROM ({_LINES}) WHERE length(line) >= 4 GROUP BY 1)")
def duplicate_lines_total(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("raw")).select(text.normal_line(F.col("raw")).alias("line")).where("line IS NOT NULL")
    return lexical.global_duplicates(rows)


@query("""SELECT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)""")
def link_targets(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query(r"SELECT conv_id, turn, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS cell FROM conversations")
def tsv_cells(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.tsv_cell(F.col("text")).alias("cell"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages""")
def html_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("escaped"))


@query("SELECT o_orderkey AS scan_id, strftime(make_timestamp((o_orderkey * 86400123) * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown FROM orders")
def scan_times(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), text.scan_time((F.col("o_orderkey") * 86400123).cast("string")).alias("shown"))


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || CAST(doc_id AS VARCHAR) || chr(0)) AS command_id FROM documents")
def command_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", inventory.command_id(F.col("source"), F.col("lang"), F.array(F.col("doc_id").cast("string"))).alias("command_id"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN '/moved' || substr(url, 11) ELSE url END AS url FROM (SELECT page_id, replace(url, 'https://m.', 'https://m./') AS url FROM pages)")
def rebased_paths(spark, d):
    p = table(spark, d, "pages").select("page_id", F.replace("url", F.lit("https://m."), F.lit("https://m./")).alias("url"))
    return p.select("page_id", inventory.rebase(F.col("url"), "https://m.", "/moved").alias("url"))


@query("""WITH b AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents),
 s AS (SELECT doc_id, text, list_concat([14695981039346656037::HUGEINT], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS HUGEINT))) AS l FROM b)
 SELECT doc_id, 'fnv1a64-v1:' || format('{:016x}', CAST(list_reduce(l, lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) AS UBIGINT)) AS hash,
 CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM s""")
def fnv_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", inventory.fnv1a64(F.col("text").cast("binary")).alias("hash"), inventory.line_count(F.col("text").cast("binary")).alias("lines"))


@query()
def lexical_metrics(spark, d):
    return lexical.file_metrics(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


@query()
def lexical_findings(spark, d):
    return lexical.inspect(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


# Data sets and evaluation ----------------------------------------------------------------------------------------


def _scored(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("sample_id"), "source", F.col("quality").alias("label"), ((F.col("n_chars") % 101) / 100.0).alias("probability"))


_SCORED = "s AS (SELECT doc_id AS sample_id, source, quality AS label, (n_chars % 101) / 100.0 AS probability FROM documents JOIN labels USING (doc_id))"
_COUNTS = "count(*) FILTER (WHERE label = 1 AND probability >= 0.5) AS tp, count(*) FILTER (WHERE label <> 1 AND probability < 0.5) AS tn, count(*) FILTER (WHERE label <> 1 AND probability >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND probability < 0.5) AS fn"
_RATES = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2 AS balanced_accuracy"


@query(f"WITH {_SCORED}, c AS (SELECT {_COUNTS} FROM s) SELECT *, {_RATES} FROM c")
def confusion(spark, d):
    return evaluation.confusion(_scored(spark, d))


@query(f"WITH {_SCORED}, c AS (SELECT source, {_COUNTS} FROM s GROUP BY 1) SELECT *, {_RATES} FROM c")
def confusion_by_source(spark, d):
    return evaluation.confusion(_scored(spark, d), by=["source"])


@query(f"WITH {_SCORED} SELECT sum(CASE WHEN p.probability > n.probability THEN 1.0 WHEN p.probability = n.probability THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM s p JOIN s n ON p.label = 1 AND n.label <> 1")
def roc_auc(spark, d):
    return evaluation.roc_auc(_scored(spark, d)).select(F.col("auc").cast("double").alias("auc"))


@query("""WITH s AS (SELECT quality AS label, (n_chars % 101) / 100.0 AS probability, [doc_id % 5 + 1, doc_id % 7 + 1] AS truth, [n_chars % 5 + 1, n_chars % 7 + 1, n_chars % 3 + 1] AS ranked FROM documents JOIN labels USING (doc_id))
 SELECT count(*) AS eligible, avg(CAST(list_has_any(truth, ranked[1:1]) AS INT)) AS top_1, avg(CAST(list_has_any(truth, ranked[1:3]) AS INT)) AS top_3, avg(CAST(list_has_any(truth, ranked[1:1]) AND probability >= 0.5 AS INT)) AS end_to_end_top_1, avg(CAST(list_has_any(truth, ranked[1:3]) AND probability >= 0.5 AS INT)) AS end_to_end_top_3 FROM s WHERE label = 1""")
def top_k(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    rows = docs.select(F.col("quality").alias("label"), ((n % 101) / 100.0).alias("probability"), F.array(i % 5 + 1, i % 7 + 1).alias("truth"), F.array(n % 5 + 1, n % 7 + 1, n % 3 + 1).alias("ranked"))
    return evaluation.top_k(rows)


@query("""WITH t AS (SELECT doc_id AS sample_id, source, quality AS label, seed, ((doc_id * seed + n_chars % 101) % 101) / 100.0 AS probability FROM documents JOIN labels USING (doc_id), (VALUES (1), (2), (3)) v(seed)),
 a AS (SELECT source, seed, count(*) FILTER (WHERE (label = 1) = (probability >= 0.5)) / count(*) AS accuracy FROM t GROUP BY ALL)
 SELECT source, count(*) AS n, avg(accuracy) AS mean, stddev_samp(accuracy) AS std, min(accuracy) AS least, max(accuracy) AS most FROM a GROUP BY 1""")
def seed_summary(spark, d):
    t = _seed_rows(spark, d)
    per = t.groupBy("source", "seed").agg((F.count_if((F.col("label") == 1) == (F.col("probability") >= 0.5)) / F.count(F.lit(1))).alias("accuracy"))
    return evaluation.score_summary(per, ["source"], "accuracy")


def _seed_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    seeds = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed")
    t = docs.select(F.col("doc_id").alias("sample_id"), "source", F.col("quality").alias("label"), "n_chars", seeds)
    return t.withColumn("probability", ((F.col("sample_id") * F.col("seed") + F.col("n_chars") % 101) % 101) / 100.0)


@query("""WITH t AS (SELECT doc_id AS sample_id, quality AS label, seed, ((doc_id * seed + n_chars % 101) % 101) / 100.0 AS probability FROM documents JOIN labels USING (doc_id), (VALUES (1), (2), (3)) v(seed))
 SELECT sample_id, count(*) AS errors, count(*) FILTER (WHERE label <> 1) AS fp, count(*) FILTER (WHERE label = 1) AS fn, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM t WHERE (label = 1) <> (probability >= 0.5) GROUP BY 1""")
def error_cases(spark, d):
    return evaluation.error_cases(_seed_rows(spark, d))


@query("SELECT sha256(text) AS key, min(doc_id) AS sample_id, count(*) AS copies, CAST(min(n_chars % 2) AS BIGINT) AS least_label, CAST(max(n_chars % 2) AS BIGINT) AS most_label, count(DISTINCT source) AS groups FROM documents GROUP BY text")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text", (F.col("n_chars") % 2).alias("label"), F.col("source").alias("group_id"))
    return evaluation.exact_dedup(docs, F.sha2("text", 256))


@query(f"WITH {_SCORED} SELECT source AS split, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM s GROUP BY 1")
def class_counts(spark, d):
    return evaluation.class_counts(_scored(spark, d).withColumnRenamed("source", "split"))


@query(f"""WITH {_SCORED}, g AS (SELECT source, max(CAST(label = 0 AS INT)) AS has0, max(CAST(label = 1 AS INT)) AS has1 FROM s GROUP BY 1), z AS (SELECT count(*) AS n FROM g),
 t AS (SELECT g.*, k, row_number() OVER (PARTITION BY k ORDER BY sha256('42:' || k || ':' || source), source) - 1 AS place FROM g, range(128) r(k)),
 m AS (SELECT n, least(n - 2, greatest(1, CAST(floor(n * 0.2) AS BIGINT))) AS v, CAST(floor(n * 0.6) AS BIGINT) AS u FROM z),
 p AS (SELECT t.*, CASE WHEN place < least(greatest(1, u), n - v - 1) THEN 'train' WHEN place < least(greatest(1, u), n - v - 1) + v THEN 'validation' ELSE 'test' END AS split FROM t, m),
 q AS (SELECT k, split, max(has0) AS a, max(has1) AS b FROM p GROUP BY ALL),
 w AS (SELECT k FROM q GROUP BY k HAVING bool_or(split = 'train' AND a = 1 AND b = 1) ORDER BY sum(a + b) DESC, k LIMIT 1)
 SELECT split, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM s JOIN p USING (source) JOIN w USING (k) GROUP BY 1""")
def group_split_counts(spark, d):
    """Rows of each class in each split, whole sources to one split by seeded hashes."""
    s = _scored(spark, d)
    split = evaluation.hash_split(s.select("source", "label"), "source", 0.6, 0.2, 42)
    return evaluation.class_counts(s.join(split.withColumnRenamed("group", "source"), "source"))


@query("SELECT k AS key, count(*) AS n, count(DISTINCT label) AS labels FROM (SELECT CAST(floor(embedding[1] * 20) AS BIGINT) * 1000 + CAST(floor(embedding[2] * 20) AS BIGINT) AS k, label FROM embeddings) GROUP BY 1 HAVING count(DISTINCT label) > 1")
def feature_collisions(spark, d):
    e = table(spark, d, "embeddings")
    key = F.floor(F.col("embedding")[0] * 20).cast("long") * 1000 + F.floor(F.col("embedding")[1] * 20).cast("long")
    return evaluation.collisions(e, key)


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR)), p_partkey) AS INT) AS turn FROM part")
def round_robin(spark, d):
    return evaluation.round_robin(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS best FROM orders GROUP BY 1")
def best_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("best"))


@query("SELECT count(*) FILTER (WHERE p AND n > 0) AS tp, count(*) FILTER (WHERE NOT p AND n > 0) AS fp, count(*) FILTER (WHERE NOT p AND n = 0) AS tn, count(*) FILTER (WHERE p AND n = 0) AS fn FROM (SELECT o_orderstatus = 'F' AS p, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders)")
def rule_corpus(spark, d):
    sites = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("found"))
    cases = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("positive")).join(sites, "o_orderkey", "left")
    return evaluation.corpus_rates(cases.withColumn("found", F.coalesce("found", F.lit(0))))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS lefts, count(*) AS rights FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def unpaired_labels(spark, d):
    return dataset.unpaired(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)")
def paired_labels(spark, d):
    labels, docs = table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "n_chars")
    return dataset.pair_exactly(labels, docs.join(labels.select("doc_id"), "doc_id", "left_semi"), "doc_id", "labels")


@query("""SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'flag']) AS rule, unnest([l_quantity <= 40, l_discount < 0.09, l_returnflag <> 'A']) AS ok FROM lineitem) WHERE NOT ok""")
def record_violations(spark, d):
    li = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_discount", "l_returnflag")
    rules = {"quantity": F.col("l_quantity") <= 40, "discount": F.col("l_discount") < 0.09, "flag": F.col("l_returnflag") != "A"}
    return dataset.violations(li, "k", rules).select("k.*", "rule")


_TURNS = "t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"WITH {_TURNS} SELECT conv_id AS function, string_agg(role, ',' ORDER BY place) AS kinds, coalesce(string_agg(place || '-' || (place + 1), ',' ORDER BY place) FILTER (WHERE place < n - 1), '') AS links FROM t GROUP BY 1")
def graph_records(spark, d):
    """Conversations as graphs: turns are nodes, each leads to the next."""
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations")
    nodes = c.select(F.col("conv_id").alias("function"), F.col("turn").alias("node"), F.col("turn").alias("ord"), F.col("role").alias("kind"))
    edges = nodes.select("function", F.col("node").alias("source"), F.lead("node").over(W.partitionBy("function").orderBy("node")).alias("target"), F.lit(1).alias("type")).where("target IS NOT NULL")
    got = dataset.graph_records(nodes, edges)
    joined = lambda a, f: F.array_join(F.transform(a, f), ",")
    return got.select("function", joined("nodes", lambda x: x["kind"]).alias("kinds"), joined("edges", lambda x: F.concat_ws("-", x["source"].cast("string"), x["target"].cast("string"))).alias("links"))


@query("SELECT l_suppkey AS source, l_partkey AS target, l_linenumber AS type FROM lineitem WHERE l_linenumber IN (1, 2) UNION ALL SELECT l_partkey, l_suppkey, l_linenumber + 4 FROM lineitem WHERE l_linenumber IN (1, 2)")
def reversed_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("type"))
    return dataset.with_reverse(e, [1, 2])


@query("SELECT event_id, greatest(-1.0, least(1.0, sign(value - 50) * ln(1 + abs(value - 50)) / 10)) AS feature FROM events")
def number_features(spark, d):
    return table(spark, d, "events").select("event_id", dataset.number_feature(F.col("value") - 50).alias("feature"))


@query("WITH v AS (SELECT word, row_number() OVER (ORDER BY word) AS index FROM (SELECT DISTINCT p_type AS word FROM part)) SELECT p_partkey, coalesce(index, 0) AS index FROM part LEFT JOIN v ON word = p_type")
def vocabulary_codes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("word"))
    return dataset.encode_words(p, dataset.fit_vocabulary(p, "word"), "word").select("p_partkey", "index")


@query("SELECT event_id, CAST(NULL AS VARCHAR) AS problem FROM events")
def strict_json(spark, d):
    return table(spark, d, "events").select("event_id", dataset.json_problem("props").alias("problem"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def change_counts(spark, d):
    return reports.status_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


# The tokens without raw strings, which documents do not hold: their closing mark names the opening one.
_RAW_STRING = re.compile(r'\|\(\?:u8\|u\|U\|L\)\?R"\(\?<delim>.*?\\k<delim>"')
_PLAIN_TOKENS = _RAW_STRING.sub("", dataset.TOKENS).replace("*+", "*").replace(r"\w", r"[\p{L}\p{M}\p{N}\p{Pc}]")


@query(f"""SELECT doc_id, sha256(CASE WHEN contains(text, '#') OR contains(text, chr(92) || chr(10)) OR contains(text, chr(92) || chr(13) || chr(10)) THEN text
 ELSE array_to_string(list_filter(regexp_extract_all(text, '{_PLAIN_TOKENS.replace("'", "''")}'), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')), ' ') END) AS hash FROM documents""")
def canonical_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", dataset.canonical_hash(F.col("text")).alias("hash"))


@query("SELECT l_orderkey, l_suppkey AS file, CAST(l_linenumber AS BIGINT) AS line, CAST(s_nationkey % 5 + 1 AS BIGINT) AS start_line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND l_linenumber BETWEEN s_nationkey % 5 + 1 AND s_nationkey % 5 + 3")
def findings_in_functions(spark, d):
    findings = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"))
    start = (F.col("s_nationkey") % 5 + 1).cast("long")
    functions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), start.alias("start_line"), (start + 2).alias("end_line"))
    return facts.findings_in_functions(findings, functions).drop("end_line")


@query("SELECT l_suppkey AS file, l_orderkey, l_returnflag AS rule_id, CASE l_returnflag WHEN 'R' THEN 'high' ELSE 'low' END AS severity FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def native_findings(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", F.col("l_returnflag").alias("rule_id"))
    inv = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("file"))
    rules = spark.createDataFrame([("R", "high"), ("A", "low")], "rule_id string, severity string")
    return facts.native_findings(seen, inv, rules).select("file", "l_orderkey", "rule_id", "severity")
