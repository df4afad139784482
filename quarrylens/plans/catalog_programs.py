"""Registered queries about programs: control flow, graph records, renaming, pairs, digests. As in ``catalog``, the given
tables stand in for sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import control_flow, lexical, renaming
from quarrylens.operators import facts, pairs, program_graphs
from quarrylens.operators.digest import digest_sql
from quarrylens.plans.catalog import query
from quarrylens.sources.shared import table

# Control flow: a function for each conversation, a statement for each turn -------------------------------------------

_STATEMENT = "CASE WHEN length(text) % 5 = 0 THEN 'return x;' WHEN role = 'user' THEN 'if (x) y();' WHEN length(text) % 5 = 1 THEN 'while (x) x--;' WHEN role = 'system' THEN '{ }' ELSE 'x = 1;' END"
_FLOW = f"""WITH l AS (SELECT conv_id AS file, turn AS k, {_STATEMENT} AS t FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k, t) AS line FROM l),
s AS (SELECT file, line, t, CASE WHEN t LIKE 'return%' THEN 'return' WHEN t LIKE 'if%' THEN 'branch' WHEN t LIKE 'while%' THEN 'loop' ELSE 'statement' END AS kind, row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM p WHERE t <> '{{ }}'),
n AS (SELECT file, i, kind, CAST(line + 1 AS INT) AS line, 'n' || i AS me, lead('n' || i, 1, 'exit') OVER w AS one, lead('n' || i, 2, 'exit') OVER w AS two FROM s WINDOW w AS (PARTITION BY file ORDER BY i))"""


def _flows(spark, d):
    """Control flow of a function for each conversation, whose statements are its turns."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.struct("turn", F.expr(_STATEMENT).alias("t")).alias("x"))
    body = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    sources = turns.groupBy("file").agg(F.concat(F.lit("int f(int x) {\n"), F.array_join(body, "\n"), F.lit("\n}\n")).alias("text"))
    return control_flow.control_flow(lexical.prepare(sources))


@query(f"""{_FLOW} SELECT file, me AS source, CASE WHEN kind = 'return' THEN 'exit' ELSE one END AS target, CASE WHEN kind = 'return' THEN 'return' ELSE 'next' END AS kind FROM n
 UNION ALL SELECT file, me, two, 'false-approx' FROM n WHERE kind IN ('branch', 'loop')
 UNION ALL SELECT f.file, 'entry', CASE WHEN n.file IS NULL THEN 'exit' ELSE 'n1' END, 'next' FROM (SELECT DISTINCT file FROM l) f LEFT JOIN n ON n.file = f.file AND n.i = 1""")
def control_flow_edges(spark, d):
    short = lambda c: F.element_at(F.split(c, ":"), -1)
    return _flows(spark, d).select("file", F.explode("edges").alias("e")).select("file", short(F.col("e.source")).alias("source"), short(F.col("e.target")).alias("target"), "e.kind")


@query(f"{_FLOW} SELECT file, me AS node, kind, line FROM n UNION ALL SELECT file, 'entry', 'entry', 1 FROM (SELECT DISTINCT file FROM l) UNION ALL SELECT file, 'exit', 'exit', CAST(max(line) + 2 AS INT) FROM p GROUP BY file")
def control_flow_nodes(spark, d):
    nodes = _flows(spark, d).select("file", F.explode("nodes").alias("n"))
    return nodes.select("file", F.element_at(F.split("n.node_id", ":"), -1).alias("node"), "n.kind", "n.line")


# Function graphs: a graph for each conversation; its turns are the tree, those of the assistant the flow ------------------

_KIND = "CASE WHEN role = 'system' THEN 'IntegerLiteral' ELSE coalesce(role, '') END"
_NAME = "CASE WHEN role = 'system' THEN CAST(length(text) - 400 AS {text}) ELSE '' END"
_TYPE = "CASE WHEN turn % 3 = 0 THEN 'char [' || turn || ']' WHEN turn % 3 = 1 THEN 'int *' ELSE 'int' END"
_SYMBOL = "CASE WHEN turn % 2 = 0 THEN 'V' || turn ELSE '' END"
_GRAPH_SQL = f"""c AS (SELECT conv_id AS graph, turn, role, {_KIND} AS kind, {_NAME.format(text="VARCHAR")} AS name, {_TYPE} AS type_name, {_SYMBOL} AS symbol FROM conversations),
n AS (SELECT graph, 'ast' AS layer, 'a' || turn AS node_id, 0 AS r, turn, kind, turn AS line, 1 AS col, turn + 1 AS end_line, name, type_name, symbol FROM c
 UNION ALL SELECT graph, 'cfg', 'c' || turn, 1, turn, 'block', turn, 1, turn, '', '', '' FROM c WHERE role = 'assistant'),
nodes AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY r, turn) - 1 AS node, row_number() OVER (PARTITION BY graph, layer ORDER BY turn) AS k FROM n),
e AS (SELECT a.graph, a.node_id AS source, b.node_id AS target, CASE WHEN a.layer = 'ast' THEN 0 ELSE 1 END AS type FROM nodes a JOIN nodes b ON a.graph = b.graph AND a.layer = b.layer AND b.k = a.k + 1
 UNION ALL SELECT graph, node_id, 'a' || turn, 2 FROM nodes WHERE layer = 'cfg'
 UNION ALL SELECT graph, 'a' || turn, 'a' || (SELECT max(turn) FROM c l WHERE l.graph = c.graph), 3 FROM c WHERE role = 'user'),
placed AS (SELECT e.graph, e.type, s.node AS from_node, t.node AS to_node FROM e JOIN nodes s ON s.graph = e.graph AND s.node_id = e.source JOIN nodes t ON t.graph = e.graph AND t.node_id = e.target)"""


def _graphs(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("graph"), "turn", "role", F.expr(_KIND).alias("kind"), F.expr(_NAME.format(text="STRING")).alias("name"), F.expr(_TYPE).alias("type_name"), F.expr(_SYMBOL).alias("symbol")
    )
    tree = c.select("graph", F.expr("'a' || turn").alias("node_id"), F.col("turn").alias("ord"), "kind", F.col("turn").alias("line"), (F.col("turn") + 1).alias("end_line"), "name", "type_name", "symbol")
    flow = c.where("role = 'assistant'").select("graph", F.expr("'c' || turn").alias("node_id"), F.col("turn").alias("ord"), F.lit("block").alias("kind"), F.col("turn").alias("line"))
    nodes = program_graphs.number_nodes(tree, flow)
    ranked = nodes.withColumn("k", F.col("node"))
    following = lambda layer: ranked.where(F.col("layer") == layer).select("graph", F.col("node_id").alias("source"), (F.col("k") + 1).alias("k")).join(ranked.where(F.col("layer") == layer).select("graph", F.col("node_id").alias("target"), "k"), ["graph", "k"]).drop("k")
    last = c.groupBy("graph").agg(F.max("turn").alias("last"))
    edges = program_graphs.join_edges({
        "ast-child": following("ast"), "cfg-successor": following("cfg"), "cfg-contains": flow.select("graph", F.col("node_id").alias("source"), F.expr("'a' || ord").alias("target")),
        "def-use": c.where("role = 'user'").join(last, "graph").select("graph", F.expr("'a' || turn").alias("source"), F.expr("'a' || last").alias("target")),
    })
    return nodes, edges


@query(f"WITH {_GRAPH_SQL} SELECT graph, layer, node_id, node, kind, line FROM nodes")
def program_graph_nodes(spark, d):
    return _graphs(spark, d)[0].select("graph", "layer", "node_id", "node", "kind", "line")


@query(f"WITH {_GRAPH_SQL} SELECT * FROM placed")
def program_graph_edges(spark, d):
    return program_graphs.place_edges(*_graphs(spark, d))


@query(f"""WITH {_GRAPH_SQL}, k AS (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY node) - 1 AS fresh FROM nodes WHERE layer = 'ast'),
 m AS (SELECT p.graph, s.fresh AS a, t.fresh AS b, p.type FROM placed p JOIN k s ON s.graph = p.graph AND s.node = p.from_node JOIN k t ON t.graph = p.graph AND t.node = p.to_node WHERE p.type NOT IN (1, 2))
 SELECT graph, a AS from_node, b AS to_node, type FROM m UNION ALL SELECT graph, b, a, type + 4 FROM m""")
def ablated_graph_edges(spark, d):
    """Without the flow: its edges and nodes go, and the tree's nodes are numbered anew."""
    nodes, edges = _graphs(spark, d)
    return program_graphs.ablate(nodes, program_graphs.place_edges(nodes, edges), (1, 2))[1]


@query(f"""WITH {_GRAPH_SQL}, z AS (SELECT graph, count(*) AS n, max(turn) AS last FROM nodes GROUP BY 1), x AS (SELECT nodes.*, z.n, greatest(1, z.last) AS span FROM nodes JOIN z USING (graph))
 SELECT graph, node, CAST(layer = 'ast' AS DOUBLE) AS in_tree, CAST(layer <> 'ast' AS DOUBLE) AS in_flow, greatest(0.0, least(1.0, line / span)) AS line_at, greatest(0.0, least(1.0, (end_line - line) / span)) AS line_span,
 CAST(contains(type_name, '*') AS DOUBLE) AS pointer, CAST(contains(type_name, '[') AS DOUBLE) AS "array", CAST(kind = 'IntegerLiteral' AS DOUBLE) AS literal,
 CASE WHEN kind = 'IntegerLiteral' THEN sign(CAST(name AS BIGINT)) * ln(1 + abs(CAST(name AS BIGINT))) / 10 ELSE 0 END AS value, CASE WHEN contains(type_name, '[') THEN ln(1 + turn) / 10 ELSE 0 END AS extent,
 CASE WHEN symbol <> '' THEN (turn + 1) / n ELSE 0 END AS binding FROM x""")
def node_features(spark, d):
    nodes, _ = _graphs(spark, d)
    spans = nodes.groupBy("graph").agg(F.lit(0).alias("start_line"), F.max("line").alias("end_line"))
    return program_graphs.node_features(nodes, spans)


def _hash_sql(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


_ELEMENTS = f"""SELECT graph AS grp, leaf, row_number() OVER (PARTITION BY graph ORDER BY leaf) - 1 AS pos FROM (SELECT graph, {_hash_sql("'node'", "layer", "node_id", "kind", "line", "col", "end_line", "name", "type_name", "symbol")} AS leaf FROM nodes
 UNION ALL SELECT graph, {_hash_sql("'edge'", "type", "source", "target")} FROM e)"""


@query(f"SELECT grp AS graph, rows, digest FROM ({digest_sql(f'WITH {_GRAPH_SQL} {_ELEMENTS}')})")
def program_graph_digests(spark, d):
    return program_graphs.graph_digests(*_graphs(spark, d))


@query(f"""SELECT g.doc_id, sha256(g.t) AS source_sha256, sha256(g.f || ':' || g.lang || '::' || g.n_chars || ':' || sha256(g.t)) AS graph_id FROM (SELECT doc_id, source || '/' || doc_id AS f, lang, n_chars, text AS t FROM documents) g""")
def program_graph_ids(spark, d):
    """Identities of documents as functions: path, language as name, no signature."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("lang").alias("function"), F.lit(None).cast("string").alias("signature"), F.col("n_chars").alias("start_line"), F.col("text").alias("source"))
    return program_graphs.graph_ids(docs).select("doc_id", "source_sha256", "graph_id")


_CONTENTS = f"SELECT source AS grp, leaf, row_number() OVER (PARTITION BY source ORDER BY leaf) - 1 AS pos FROM (SELECT source, {_hash_sql('doc_id', 'lang', 'text')} AS leaf FROM documents)"


@query(f"SELECT grp AS source, rows, digest FROM ({digest_sql(_CONTENTS)})")
def content_fingerprints(spark, d):
    """Of each source's documents, in any order."""
    return facts.content_fingerprint(table(spark, d, "documents").select("source", "doc_id", "lang", "text"), ["source"])


# Renaming and pairs ----------------------------------------------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"
_SQL_TOKEN = renaming.TOKEN.replace("\\w", _W).replace("'", "''")
_KEYS = ", ".join(f"'{k}'" for k in sorted(renaming.KEYWORDS))


@query(f"""WITH t AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '{_SQL_TOKEN}'), lambda x: NOT starts_with(x, '//') AND NOT starts_with(x, '/*')) AS ts FROM documents),
 k AS (SELECT doc_id, text, ts, list_transform(ts, lambda x, i: CASE WHEN left(x, 1) IN ('"', chr(39)) OR regexp_matches(x, '^[0-9]') THEN 0 WHEN regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({_KEYS}) AND coalesce(ts[i + 1], '') <> '(' THEN 1 ELSE 2 END) AS ks FROM t),
 n AS (SELECT doc_id, text, ts, ks, list_filter(ts, lambda x, i: ks[i] = 1) AS names FROM k),
 u AS (SELECT doc_id, text, ts, ks, list_filter(names, lambda x, i: list_position(names, x) = i) AS firsts FROM n)
 SELECT doc_id, CASE WHEN NOT contains(text, chr(92) || chr(10)) AND NOT contains(text, chr(92) || chr(13)) THEN sha256(array_to_string(list_transform(ts, lambda x, i: CASE ks[i] WHEN 0 THEN '<literal>' WHEN 1 THEN 'v' || (list_position(firsts, x) - 1) ELSE x END), ' ')) END AS template FROM u""")
def template_hashes(spark, d):
    """Documents as sources."""
    return table(spark, d, "documents").select("doc_id", renaming.template_hash("text").alias("template"))


_DEFECTS = ("flow", "family", "spliced", "open", "bad", "good", "preamble", "conditional", "answer", "include", "directive", "same")
_CASES_SQL = f"""c AS (SELECT conv_id, [{", ".join(map(str, pairs.CLASSES))}][CAST(conv_id % {len(pairs.CLASSES)} AS INT) + 1] AS cwe, conv_id % 20 AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
 x AS (SELECT 'testcases/CWE' || cwe || '_Kind/CWE' || cwe || '_Kind__case' || conv_id || '_01.c' AS source_file, cwe, CASE v {" ".join(f"WHEN {i} THEN '{pairs.REASONS[k]}'" for i, k in enumerate(_DEFECTS))} END AS reason FROM c),
 t AS (SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY sha256('42:' || source_file), source_file) - 1 AS turn FROM x),
 p AS (SELECT *, row_number() OVER (ORDER BY turn, cwe, source_file) - 1 AS place FROM t)"""


def _cases(spark, d):
    """A test program for each conversation: a bad and a good function of its number of turns; every defect for some."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    kind = F.get(F.array(*[F.lit(k) for k in pairs.CLASSES]), (F.col("conv_id") % len(pairs.CLASSES)).cast("int")).cast("string")
    stem = F.concat(F.lit("CWE"), kind, F.lit("_Kind__case"), F.col("conv_id").cast("string"), F.lit("_01"))
    is_ = lambda k: F.col("conv_id") % 20 == _DEFECTS.index(k)
    pick = lambda k, wrong, right: F.when(is_(k), F.lit(wrong)).otherwise(F.lit(right))
    local = pick("directive", "value", "badValue")  # a telling name beside a directive is rejected for that
    text = F.concat(
        F.lit("/* Label Definition File: "), pick("family", "no such", "Kind"), F.lit(".label.xml\n"), pick("flow", "", "Flow Variant: 01 Baseline\n"), F.lit("*/\n"), pick("conditional", "#if 1\n", ""), pick("include", '#include "own.h"\n', '#include "std_testcase.h"\n'),
        pick("spliced", "#define A \\\n 1\n", ""), pick("preamble", "", "#ifndef OMITBAD\n"), F.lit("void "), F.col("stem"), pick("bad", "_none", "_bad"), F.lit("()\n{\n  int "), local, F.lit(" = "), F.col("n"), F.lit(";\n"), pick("answer", '  print("bad");\n', ""), pick("directive", "#define B\n", ""), F.lit("  use("), local, F.lit(");\n}\n"),
        F.lit("static void goodG2B()\n{\n"), pick("good", "  good1();\n", ""), pick("same", "  int badValue = ", "  int goodValue = "), F.col("n"), F.when(is_("same"), F.lit(";\n  use(badValue);\n")).otherwise(F.lit(" + 1;\n  use(goodValue);\n")), pick("open", "  {\n", ""), F.lit("}\nvoid good1() { goodG2B(); }\n"),
    )
    made = c.withColumn("stem", stem).select(F.concat(F.lit("testcases/CWE"), kind, F.lit("_Kind/"), F.col("stem"), F.lit(".c")).alias("source_file"), text.alias("text"))
    return pairs.candidates(made)


@query(f"WITH {_CASES_SQL} SELECT source_file, CAST(cwe AS INT) AS cwe, CASE WHEN reason IS NULL THEN 'Kind' END AS family, reason, CASE WHEN reason IS NULL THEN 2 ELSE 0 END AS functions FROM x")
def extracted_pairs(spark, d):
    got = pairs.extract_pairs(_cases(spark, d))
    return got.select("source_file", "cwe", F.when(F.col("reason").isNull(), F.col("family")).alias("family"), "reason", F.coalesce(F.array_size("pair"), F.lit(0)).alias("functions"))


@query(f"""WITH {_CASES_SQL}, r AS (SELECT *, count(*) FILTER (WHERE reason IS NULL) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sound_before FROM p)
 SELECT source_file, CAST(cwe AS INT) AS cwe, turn, place, reason, CASE WHEN sound_before >= 40 THEN 'unexamined' WHEN reason IS NULL THEN 'selected' ELSE 'rejected' END AS status FROM r""")
def selected_cases(spark, d):
    return pairs.select_cases(pairs.extract_pairs(_cases(spark, d)), 40)
