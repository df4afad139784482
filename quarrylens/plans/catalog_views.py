"""Registered queries over all logical views, built from stored relations, and over snapshots that do not hold together."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import dataset, evaluation
from quarrylens.plans.catalog import query
from quarrylens.plans.select import select
from quarrylens.sources import snapshots, views
from quarrylens.sources.shared import table


def _relations(spark, d):
    """Documents as symbols and issues, turns of conversations as edges and references."""
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    i = F.col("doc_id")
    issue = docs.select(F.col("source").alias("rule_id"), F.lit("warning").alias("severity"), F.col("lang").alias("file"), i.alias("line"), (i % 80).alias("col"), F.substring("text", 1, 40).alias("message"), F.lit("").alias("evidence"), F.lit(None).cast("string").alias("suggestion"), i.cast("string").alias("symbol"), F.lit("rule").alias("detector"), F.when(i % 3 == 0, F.lit("known")).alias("suppression_reason"))
    return {
        "symbol": docs.select(i.cast("string").alias("usr"), F.lit("function").alias("kind"), F.concat_ws("::", "lang", i.cast("string")).alias("name"), F.col("source").alias("file"), F.col("n_chars").alias("line"), F.lit(1).alias("col"), (i % 2 == 0).alias("definition"), (i % 5 == 0).alias("external")),
        "graph_edge": turns.select(F.lit("call").alias("kind"), F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("string").alias("target"), F.col("role").alias("file"), F.length("text").alias("line"), F.lit(None).cast("int").alias("col")),
        "symbol_reference": turns.select(F.col("conv_id").cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("enclosing_symbol"), F.lit("read").alias("kind"), F.col("role").alias("file"), F.col("turn").alias("line"), F.length("text").alias("col"), F.lit("u").alias("unit_file")),
        "issue": issue.where("suppression_reason is null"), "suppressed_issue": issue.where("suppression_reason is not null"),
        "rule_diagnostic": docs.select(i.alias("ordinal"), F.concat(F.lit("unused: "), "source").alias("message")),
    }


_ISSUE = "SELECT source AS rule_id, 'warning' AS severity, lang AS file, doc_id AS line, doc_id % 80 AS \"column\", substr(text, 1, 40) AS message, '' AS evidence, '' AS suggestion, CAST(doc_id AS VARCHAR) AS symbol_id, 'rule' AS detector"


@query("SELECT lang || '::' || doc_id AS name, source AS file, n_chars AS line, 1 AS \"column\", 'function' AS kind, CAST(doc_id % 2 = 0 AS BIGINT) AS definition, CAST(doc_id % 5 = 0 AS BIGINT) AS external, CAST(doc_id AS VARCHAR) AS symbol_id FROM documents")
def select_all_symbols(spark, d):
    return select(views.logical_view("symbols", _relations(spark, d)), "symbols").frame


@query("SELECT 'call' AS kind, CAST(conv_id AS VARCHAR) AS source, CAST(turn AS VARCHAR) AS target, role AS file, length(text) AS line, -1 AS \"column\" FROM conversations WHERE length(text) >= 100")
def select_all_edges(spark, d):
    return select(views.logical_view("edges", _relations(spark, d)), "edges", None, "line >= 100 AND kind = 'call'").frame


@query("SELECT CAST(conv_id AS VARCHAR) AS symbol_id, '' AS enclosing_symbol, 'read' AS kind, role AS file, turn AS line, length(text) AS \"column\", 'u' AS translation_unit FROM conversations")
def select_all_references(spark, d):
    return select(views.logical_view("references", _relations(spark, d)), "references").frame


@query(f"{_ISSUE} FROM documents WHERE doc_id % 3 <> 0")
def select_all_issues(spark, d):
    return select(views.logical_view("issues", _relations(spark, d)), "issues").frame


@query(f"{_ISSUE}, 'known' AS reason FROM documents WHERE doc_id % 3 = 0")
def select_all_suppressed_issues(spark, d):
    return select(views.logical_view("suppressed_issues", _relations(spark, d)), "suppressed_issues").frame


@query("SELECT doc_id AS ordinal, 'unused: ' || source AS message FROM documents")
def select_all_rule_diagnostics(spark, d):
    return select(views.logical_view("rule_diagnostics", _relations(spark, d)), "rule_diagnostics").frame


@query("""SELECT 'edges' AS "table", 'key twice' AS problem, '{"kind":"call","source":"' || conv_id || '","target":"' || role || '","file":"f","line":1,"column":1}' AS item FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
 UNION ALL SELECT 'symbols', 'key twice', '{"symbol_id":"' || h || '"}' FROM (SELECT sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1
 UNION ALL SELECT DISTINCT 'functions', 'dangling', '{"symbol_id":"' || h || '"}' FROM (SELECT DISTINCT sha256(text || '!') AS h, doc_id FROM documents WHERE doc_id % 4 = 1)
 UNION ALL SELECT 'functions', 'key twice', '{"symbol_id":"' || h || '"}' FROM (SELECT sha256(text || CASE WHEN doc_id % 4 = 1 THEN '!' ELSE '' END) AS h FROM documents) GROUP BY h HAVING count(*) > 1""")
def snapshot_problems(spark, d):
    """Documents with equal texts are symbols twice, a quarter of the metrics name none; turns of one role are edges twice."""
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    own = F.sha2("text", 256)
    tables = {
        "symbols": docs.select(own.alias("symbol_id")), "functions": docs.select(F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 1, F.lit("!")).otherwise(F.lit(""))), 256).alias("symbol_id")),
        "edges": turns.select(F.lit("call").alias("kind"), F.col("conv_id").cast("string").alias("source"), F.col("role").alias("target"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column")),
    }
    return snapshots.table_problems(tables)


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN CAST(d.doc_id AS VARCHAR) ELSE 'q' || l.quality END AS name, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'label:' || l.toxic END AS place FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metrics_with_symbols(spark, d):
    """Documents as metrics, labels as the symbols that only some of them have."""
    metrics = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("symbol_id"), F.col("n_chars").alias("complexity"))
    symbols = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("symbol_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("name"), F.lit("label").alias("file"), F.col("toxic").alias("line"))
    return views.metrics_with_symbols(metrics, symbols).select("doc_id", "name", "place")


@query("SELECT conv_id AS scan_id, 'unit' AS kind, role AS name, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT doc_id % 100, 'issue', source, count(*) FROM documents GROUP BY ALL")
def scan_counters(spark, d):
    units = table(spark, d, "conversations").select(F.col("conv_id").alias("scan_id"), F.col("role").alias("status"))
    return views.scan_counters(units, table(spark, d, "documents").select((F.col("doc_id") % 100).alias("scan_id"), F.col("source").alias("rule_id")))


@query("SELECT DISTINCT conv_id AS scan_id, unnest([role, CAST(turn // 2 AS VARCHAR)]) AS file FROM conversations")
def united_coverage(spark, d):
    units = table(spark, d, "conversations").select(F.col("conv_id").alias("scan_id"), F.array("role", F.expr("cast(turn div 2 as string)")).alias("covered_files"))
    return views.united_coverage(units)


@query("SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)")
def joined_labels(spark, d):
    """Labelled documents as graphs: every second label gives the signature too."""
    labels = table(spark, d, "labels")
    graphs = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("source").alias("file"), F.col("doc_id").cast("string").alias("function"), F.col("lang").alias("signature"))
    own = labels.join(table(spark, d, "documents"), "doc_id").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("function"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("signature"), F.col("quality").alias("label"))
    return dataset.labels_one_to_one(graphs, own).select("doc_id", "label")


_V = {"schema_version": 3, "node_fields": 5, "node_ids": 7, "explicit_edges": 11, "source_groups": 13, "split_group": 17, "duplicate_ids": 19, "canonical_hash": 23}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM documents WHERE doc_id % {n} = 1" for k, n in _V.items()) + " UNION ALL SELECT doc_id, 'explicit_edges' FROM documents WHERE doc_id % 7 = 1 AND doc_id % 11 <> 1 UNION ALL SELECT doc_id, 'copies_agree' FROM documents WHERE doc_id % 19 <> 1 AND doc_id % 29 = 1")
def graph_violations(spark, d):
    """Program graphs made of documents, each breaking some rules."""
    i = F.col("doc_id")
    bad = lambda k, a, b: F.when(i % _V[k] == 1, a).otherwise(b)
    text = lambda x: F.lit(x)
    node = lambda ident, layer, line: F.struct(text("Stmt").alias("kind"), text(layer).alias("layer"), line.cast("long").alias("line"), F.lit(5).cast("long").alias("end_line"), F.lit(1).cast("long").alias("column"), ident.alias("node_id"))
    two = bad("node_ids", text("a"), text("b"))
    rows = table(spark, d, "documents").select(
        "doc_id", i.cast("string").alias("sample_id"), text("g").alias("group_id"), F.lit("int x;").alias("source"), bad("schema_version", text("2.0"), text("1.0")).alias("schema_version"),
        F.array(node(text("a"), "ast", bad("node_fields", F.lit(9), F.lit(1))), node(two, "ast", F.lit(2))).alias("nodes"),
        F.array(F.struct(text("a").alias("source"), text("b").alias("target"), bad("explicit_edges", text("def-use"), text("ast-child")).alias("kind"))).alias("edges"),
        F.array(F.lit(0)).alias("edge_from"), F.array(F.lit(1)).alias("edge_to"), F.array(F.lit(0)).alias("edge_type"),
        F.array(bad("source_groups", text("other"), text("g")), text("h")).alias("source_groups"), bad("split_group", text(" "), text("g")).alias("split_group"),
        F.when(i % 19 == 1, F.array(i.cast("string"))).when(i % 29 == 1, F.array(text("c"), text("d"))).otherwise(F.array(text("c"))).alias("duplicate_ids"),
        bad("canonical_hash", text("x"), F.sha2(text("int x ;"), 256)).alias("canonical_sha256"),
    )
    return dataset.violations(rows, "doc_id", evaluation.graph_rules())
