"""Function graphs as long tables: two node layers and four edge kinds under one numbering, an identity that does not
depend on row order, ablation with renumbering, and node features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.digest import fields_hash, ordered_digest
from quarrylens.operators.order import positions_within

#: The kinds of edges and their numbers; what two of them add for the way back.
EDGE_TYPES = {"ast-child": 0, "cfg-successor": 1, "cfg-contains": 2, "def-use": 3}
REVERSE = 4
#: Kinds of nodes whose name is a number, and the widest number that counts.
LITERALS = ("IntegerLiteral", "CharacterLiteral")
NUMBER, EXTENT, BINDING = r"^-?[0-9]{1,160}$", r"\[([0-9]{1,160})\]", r"^V([0-9]+)$"
NODE_FIELDS = ("kind", "line", "column", "end_line", "name", "type_name", "symbol")


def graph_ids(functions: DataFrame) -> DataFrame:
    """``functions`` (file, function, signature, start_line, source) with source_sha256 and graph_id, a hash of them all."""
    hashed = functions.withColumn("source_sha256", F.sha2("source", 256))
    return hashed.withColumn("graph_id", F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file", "function", "signature", "start_line", "source_sha256")]), 256))


def number_nodes(ast: DataFrame, cfg: DataFrame) -> DataFrame:
    """Both layers (graph, node_id, ord, and any of NODE_FIELDS) as graph, layer, node_id, node (the place in its graph, from
    0: the tree's nodes by ``ord``, then the flow's) and the fields; one a layer lacks is '' or, of lines, the node's line."""

    def layer(df: DataFrame, name: str, rank: int) -> DataFrame:
        other = {"column": F.lit(1), "end_line": F.col("line"), "line": F.lit(-1)}
        fields = [(F.col(c) if c in df.columns else other.get(c, F.lit(""))).alias(c) for c in NODE_FIELDS]
        return df.select("graph", F.lit(name).alias("layer"), F.lit(rank).alias("_rank"), F.col("node_id").cast("string"), F.col("ord").cast("long"), *fields)

    both = layer(ast, "ast", 0).unionByName(layer(cfg, "cfg", 1))
    return positions_within(both, ["graph"], [F.col("_rank"), F.col("ord"), F.col("node_id")], "node").drop("_rank", "ord")


def join_edges(kinds: dict[str, DataFrame]) -> DataFrame:
    """The edges (graph, source, target) of each kind in EDGE_TYPES as one table with their type."""
    unknown = set(kinds) - set(EDGE_TYPES)
    if unknown:
        raise ValueError(f"unknown kinds of edges: {sorted(unknown)}")
    parts = [df.select("graph", F.col("source").cast("string"), F.col("target").cast("string"), F.lit(EDGE_TYPES[k]).alias("type")) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, problem, item: node ids that a graph has twice, edges that name no node of their graph, graphs without a tree
    node. Null graphs are left out: they are no graph."""
    twice = nodes.groupBy("graph", "node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph", F.lit("node id twice").alias("problem"), F.col("node_id").alias("item"))
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    dangling = ends.join(nodes, ["graph", "node_id"], "left_anti").select("graph", F.lit("edge without its node").alias("problem"), F.col("node_id").alias("item"))
    trees = nodes.groupBy("graph").agg(F.count_if(F.col("layer") == "ast").alias("n")).where("n = 0").select("graph", F.lit("no tree").alias("problem"), F.lit("").alias("item"))
    return twice.unionByName(dangling).unionByName(trees).where("graph IS NOT NULL")


def place_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, type, from_node and to_node of ``edges``; one that names a missing node is an error when read (see
    ``problems``, which also finds node ids that would multiply edges)."""
    at = lambda end, out: nodes.select("graph", F.col("node_id").alias(end), F.col("node").alias(out))
    placed = edges.join(at("source", "from_node"), ["graph", "source"], "left").join(at("target", "to_node"), ["graph", "target"], "left")
    sure = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("an edge names a missing node"))).otherwise(F.col(c)).alias(c)
    return placed.select("graph", "type", sure("from_node"), sure("to_node"))


def graph_digests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, rows and digest: equal for graphs with the same nodes (by id, with all fields) and the same edges between
    ids, in whatever order their rows come. The elements' hashes are sorted and hashed as a tree."""
    own = nodes.select("graph", fields_hash(F.lit("node"), F.col("layer"), F.col("node_id"), *[F.col(c) for c in NODE_FIELDS]).alias("leaf"))
    ties = edges.select("graph", fields_hash(F.lit("edge"), F.col("type"), F.col("source"), F.col("target")).alias("leaf"))
    return ordered_digest(own.unionByName(ties), ["graph"], [F.col("leaf")], F.col("leaf"))


def ablate(nodes: DataFrame, placed: DataFrame, excluded: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (with new places in ``node``, the old ones in ``old``) and edges (graph, from_node, to_node, type) without the
    excluded types; each edge also turned round, its type raised by REVERSE. Flow nodes go where both types that reach
    them are excluded; those that stay are numbered anew, without gaps, by their old order."""
    kept = nodes.where(F.col("layer") != "cfg") if {1, 2} <= set(excluded) else nodes
    fresh = positions_within(kept.withColumnRenamed("node", "old"), ["graph"], [F.col("old")], "node")
    own = placed.where(~F.col("type").isin(*excluded)) if excluded else placed
    at = lambda end: fresh.select("graph", F.col("old").alias(end), F.col("node").alias(f"{end}_new"))
    moved = own.join(at("from_node"), ["graph", "from_node"]).join(at("to_node"), ["graph", "to_node"])
    ways = F.array(F.struct(F.col("from_node_new").alias("from_node"), F.col("to_node_new").alias("to_node"), F.col("type").alias("type")), F.struct(F.col("to_node_new").alias("from_node"), F.col("from_node_new").alias("to_node"), (F.col("type") + REVERSE).alias("type")))
    return fresh, moved.select("graph", F.explode(ways).alias("e")).select("graph", "e.*")


def _log(c: Column) -> Column:
    return F.log1p(c) / 10


def node_features(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """graph, node and the numbers of each node: in_tree, in_flow, line_at and line_span (shares of the function's lines,
    within 0 and 1), pointer, array, literal, value (sign and log size of a literal), extent (log of the first ``[N]`` of
    its type) and binding (``V<n>``: n + 1 as a share of the graph's nodes). spans: graph, start_line, end_line.

    A literal whose name is no whole number of up to 160 digits is an error when read. The counts of a graph's nodes are
    joined as a row a graph."""
    sizes = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("_n")).join(spans, "graph")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    span = F.greatest(F.lit(1), F.col("end_line_of") - F.col("start_line_of"))
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / span))
    literal = F.col("kind").isin(*LITERALS)
    number = F.when(literal & ~text("name").rlike(NUMBER), F.raise_error(F.lit("a literal without its value"))).when(literal, F.col("name").cast("double")).otherwise(F.lit(0.0))
    extent, binding = (F.regexp_extract(text(c), p, 1) for c, p in (("type_name", EXTENT), ("symbol", BINDING)))
    rows = nodes.join(sizes.select("graph", "_n", F.col("start_line").alias("start_line_of"), F.col("end_line").alias("end_line_of")), "graph")
    flag = lambda c: c.cast("double")
    return rows.select(
        "graph", "node", flag(F.col("layer") == "ast").alias("in_tree"), flag(F.col("layer") != "ast").alias("in_flow"), share(F.col("line") - F.col("start_line_of")).alias("line_at"),
        share(F.col("end_line") - F.col("line")).alias("line_span"), flag(F.contains(text("type_name"), F.lit("*"))).alias("pointer"), flag(F.contains(text("type_name"), F.lit("["))).alias("array"), flag(literal).alias("literal"),
        (F.signum(number) * _log(F.abs(number))).alias("value"), F.when(extent != "", _log(extent.cast("double"))).otherwise(0.0).alias("extent"), F.when(binding != "", (binding.cast("double") + 1) / F.col("_n")).otherwise(0.0).alias("binding"),
    )
