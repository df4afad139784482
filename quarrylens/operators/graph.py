"""Dependency graphs: reachability, components, strongly connected components, cycles, orders, data flow."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.shared import materialize, spread


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def node_set(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All endpoints, and isolated nodes from ``extra`` (node)."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return (nodes if extra is None else nodes.unionByName(extra.select("node"))).distinct()


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """node and depth (fewest steps) of all that ``roots`` (node) reach, themselves included. Each round expands the
    frontier only and is written."""
    edges = materialize(unique_edges(edges), "edges")
    seen = frontier = materialize(roots.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in range(1, most_rounds):
        step = frontier.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "seen") if depth % 8 == 0 else seen.unionByName(frontier)
    raise RuntimeError("too many rounds")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and root (least node) of each undirected component of ``edges`` (source, target), self-edges included:
    least labels are spread along edges and then along labels themselves, which halves long paths."""
    links = unique_edges(edges)
    links = materialize(links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "links")
    labels = materialize(links.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        heard = links.join(labels, F.col("target") == F.col("node")).groupBy(F.col("source").alias("node")).agg(F.min("root").alias("m"))
        near = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(near.join(jump, "root").select("node", "old", F.least("root", "up").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where("root != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


#: Fixed value: edges that a task contracts at a time.
BLOCK_EDGES = 1 << 19


def strong_components(edges: DataFrame, most_rounds: int = 10_000, block: int = BLOCK_EDGES) -> DataFrame:
    """node and component (its least node).

    Edges are sorted by their sources and contracted in blocks of neighbours, inside tasks (see ``_contracted``). Of a
    weak component of a block that shares no node with another block, nothing is open. What is open is a graph of the
    contracted nodes, each named by its least node, and goes through rounds of forward-backward colouring.
    """
    edges = materialize(edges.select("source", "target"), "edges")
    pieces = materialize(_contracted(edges, block), "pieces")
    shared = pieces.where("border").select("node").distinct()
    open_ = materialize(pieces.join(shared, "node", "left_semi").select("weak").distinct(), "open")
    closed = pieces.join(open_, "weak", "left_anti").select("node", F.col("label").alias("component"))
    names = materialize(pieces.join(open_, "weak", "left_semi").groupBy("node").agg(F.min("label").alias("name")), "names")
    if names.isEmpty():
        return closed
    s, t = (names.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name")) for c in ("source", "target"))
    rest = edges.join(s, "source").join(t, "target").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"))
    found = _coloured(rest, most_rounds).withColumnRenamed("node", "name")
    return closed.unionByName(names.join(found, "name").select("node", "component"))


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """The nodes of each block of ``edges``: node, label (the least node of its strong component within the block), weak
    (that of its weak component) and border, true at a node whose edges may lie in other blocks too.

    Blocks are ranges of sources, so a node in two blocks lies outside the sources of at least one of them. A source
    with more edges than a block is cut, and then at the border of each.
    """
    kinds = dict(edges.dtypes)

    def pieces(source: np.ndarray, target: np.ndarray, cut: bool, types: list) -> pa.RecordBatch:
        values, codes = np.unique(np.concatenate([source, target]), return_inverse=True)
        s, t = codes[: len(source)], codes[len(source) :]
        at = np.arange(len(values))
        border = (at < s[0]) | (at > s[-1]) | (cut & (at == s[-1]))
        columns = [values, values[_strong_labels(len(values), s, t)], values[_weak_labels(len(values), s, t)]]
        return pa.record_batch([*[pa.array(c, types[0]) for c in columns], pa.array(border)], names=["node", "label", "weak", "border"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut, types = None, False, None
        for batch in batches:
            types = batch.schema.types
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            while len(held[0]) > block:
                source, target = held
                whole = int(np.argmax(source == source[-1]))  # its last source may go on
                goes_on = whole == 0 or cut and source[0] == source[whole - 1]
                end = whole or len(source)
                yield pieces(source[:end], target[:end], goes_on, types)
                held, cut = [source[end:], target[end:]], whole == 0
                if not len(held[0]):
                    break
        if held is not None and len(held[0]):
            yield pieces(*held, cut, types)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.repartitionByRange(parts, "source").sortWithinPartitions("source")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds['source']}" for c in ("node", "label", "weak")) + ", border boolean")


def _weak_labels(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The least node of each node's undirected component."""
    label = np.arange(n)
    while True:
        a, b = label[s], label[t]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def _strong_labels(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The least node of each node's strong component: edges that cannot lie on a cycle are trimmed, Tarjan's algorithm
    takes the rest."""
    label = np.arange(n)
    for _ in range(16):
        keep = (np.bincount(t, minlength=n)[s] > 0) & (np.bincount(s, minlength=n)[t] > 0) & (s != t)
        if keep.all():
            break
        s, t = s[keep], t[keep]
    order = np.argsort(s, kind="stable")
    first = np.searchsorted(s[order], np.arange(n + 1)).tolist()
    nexts, place, low, stack, index = t[order].tolist(), [0] * n, [0] * n, [], 0
    for root in np.unique(s).tolist():
        if place[root]:
            continue
        path = [root]
        index += 1
        place[root] = low[root] = index
        at = {root: first[root]}
        stack.append(root)
        while path:
            v = path[-1]
            i = at[v]
            if i < first[v + 1]:
                at[v] = i + 1
                w = nexts[i]
                if not place[w]:
                    index += 1
                    place[w] = low[w] = index
                    at[w] = first[w]
                    stack.append(w)
                    path.append(w)
                elif low[v] > place[w]:
                    low[v] = place[w]
                continue
            path.pop()
            if path and low[path[-1]] > low[v]:
                low[path[-1]] = low[v]
            if low[v] == place[v]:
                k = len(stack) - 1
                while stack[k] != v:
                    k -= 1
                least = min(stack[k:])
                for w in stack[k:]:
                    label[w] = least
                    place[w] = n + 2  # left the stack: no longer lowers others
                del stack[k:]
    return label


def _coloured(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Strong components by rounds over the whole graph.

    Every node takes the least node that reaches it (its colour). Those that reach their colour's own node within
    the colour are that node's component; they leave, and the rest are coloured again.
    """
    edges = materialize(unique_edges(edges), "edges")
    left = materialize(node_set(edges), "left")
    done = None
    for _ in range(most_rounds):
        inner = materialize(edges.join(left, F.col("source") == F.col("node"), "left_semi").join(left, F.col("target") == F.col("node"), "left_semi"), "inner")
        colours = _spread(inner, left.withColumn("colour", F.col("node")))
        same = inner.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("c1")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("c2")), "target").where("c1 = c2")
        back = same.select(F.col("target").alias("source"), F.col("source").alias("target"))
        reach = reachable(back, colours.where("node = colour").select("node")).select("node")
        found = materialize(colours.join(reach, "node", "left_semi").select("node", F.col("colour").alias("component")), "found")
        done = found if done is None else done.unionByName(found)
        left = materialize(left.join(found, "node", "left_anti"), "left")
        if left.isEmpty():
            return done
    raise RuntimeError("too many rounds")


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The least colour that reaches each node."""
    colours = materialize(colours, "colours")
    while True:
        heard = edges.join(colours, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("m"))
        new = materialize(colours.join(heard, "node", "left").select("node", F.least("colour", "m").alias("colour"), (F.col("m") < F.col("colour")).alias("moved")), "colours")
        colours = new.select("node", "colour")
        if new.where("moved").isEmpty():
            return colours


def cycles(edges: DataFrame, components_: DataFrame) -> DataFrame:
    """Components of several nodes, or of one with an edge to itself."""
    # an edge to itself only tells where the component is that node alone, and then the node is its name
    loops = edges.where("source = target").select(F.col("source").alias("component"), F.lit(0).alias("n"), F.lit(True).alias("_loop"))
    rows = components_.select("component", F.lit(1).alias("n"), F.lit(False).alias("_loop")).unionByName(loops)
    return rows.groupBy("component").agg(F.sum("n").alias("size"), F.max("_loop").alias("_loop")).where("size > 1 or size = 1 and _loop").select("component", "size")


def topological_levels(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """node and level (longest path to it) of a graph without cycles, one level per round; a cycle is an error."""
    edges = materialize(unique_edges(edges), "edges")
    left = materialize(node_set(edges), "left")
    done = None
    for level in range(most_rounds):
        live = edges.join(left, F.col("source") == F.col("node"), "left_semi")
        ready = materialize(left.join(live.select(F.col("target").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = materialize(left.join(ready, "node", "left_anti"), "left")
        if left.isEmpty():
            return done
    raise RuntimeError("too many rounds")


def _least_first(links: list[tuple]) -> list:
    """The order that always takes the least ready node; empty where there is a cycle."""
    after, waits = defaultdict(set), defaultdict(int)
    for s, t in links:
        waits[s] += 0
        if t not in after[s]:
            after[s].add(t)
            waits[t] += 1
    ready = [n for n, k in waits.items() if k == 0]
    heapq.heapify(ready)
    order = []
    while ready:
        n = heapq.heappop(ready)
        order.append(n)
        for t in after[n]:
            waits[t] -= 1
            if waits[t] == 0:
                heapq.heappush(ready, t)
    return order if len(order) == len(waits) else []


def topological_orders(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node and position in the order that always takes the least ready node, for many small graphs; graphs
    with a cycle give no rows. A task streams its graphs, sorted, and holds one at a time: use ``topological_levels``
    for one large graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, name, done = [], None, ([], [], [])

        def end() -> None:
            order = _least_first(links)
            for column, new in zip(done, ([name] * len(order), order, range(len(order))), strict=True):
                column.extend(new)
            links.clear()

        kinds = None
        for batch in batches:
            kinds = [*[batch.schema.field(c).type for c in (graph, "source")], pa.int64()]
            for g, s, t in zip(*[batch.column(c).to_pylist() for c in (graph, "source", "target")], strict=True):
                if links and g != name:
                    end()
                name = g
                links.append((s, t))
            if len(done[0]) >= 10_000:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(done, kinds, strict=True)], names=[graph, "node", "position"])
                done = ([], [], [])
        if kinds:
            end()
            yield pa.record_batch([pa.array(x, k) for x, k in zip(done, kinds, strict=True)], names=[graph, "node", "position"])

    kind = dict(edges.dtypes)
    own = spread(edges.select(graph, "source", "target"), graph).sortWithinPartitions(graph)
    return own.mapInArrow(run, f"{graph} {kind[graph]}, node {kind['source']}, position long")


def reaching_definitions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function, source (definition), target (use) and symbol: which definitions reach which uses.

    ``blocks``: function, block, kind, events (array of struct kind, symbol, node; kinds def, use, undef); ``edges``:
    function, source, target between blocks. Blocks that no entry reaches contribute nothing; definitions meet by
    union; a definition replaces, an undef removes. A function is one group: its size is that of a source function.
    """

    def run(key: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        events = {x: [] for x in b["block"]}
        for x, _, kind, symbol, node in sorted(b.loc[b["node"].notna(), ["block", "at", "event", "symbol", "node"]].itertuples(index=False, name=None)):
            events[x].append({"kind": kind, "symbol": symbol, "node": node})
        after, before = defaultdict(set), defaultdict(set)
        for s, t in zip(e["source"], e["target"], strict=True):
            if s not in events or t not in events:
                raise ValueError(f"an edge of {key[0]} names a block that it does not have")
            after[s].add(t)
            before[t].add(s)
        live, todo = set(), list(b.loc[b["kind"] == "entry", "block"])
        while todo:
            x = todo.pop()
            if x not in live:
                live.add(x)
                todo.extend(after[x])
        out: dict = {x: frozenset() for x in live}

        def flow(x, uses=None):
            state = {d for p in before[x] & live for d in out[p]}
            for v in events[x]:
                if v["kind"] == "use":
                    if uses is not None:
                        uses.update((d, v["node"], s) for s, d in state if s == v["symbol"])
                    continue
                state = {(s, d) for s, d in state if s != v["symbol"]}
                if v["kind"] == "def":
                    state.add((v["symbol"], v["node"]))
            return frozenset(state)

        todo = sorted(live)
        while todo:
            x = todo.pop()
            new = flow(x)
            if new != out[x]:
                out[x] = new
                todo.extend(after[x])
        uses: set = set()
        for x in live:
            flow(x, uses)
        rows = sorted(uses)
        return pd.DataFrame({"function": [key[0]] * len(rows), "source": [r[0] for r in rows], "target": [r[1] for r in rows], "symbol": [r[2] for r in rows]}).astype({c: object for c in ("source", "target", "symbol")})

    kind = dict(blocks.dtypes)["function"]
    flat = blocks.select("function", "block", F.col("kind"), F.posexplode_outer("events").alias("at", "e")).select("function", "block", "kind", "at", F.col("e.kind").alias("event"), "e.symbol", "e.node")
    return flat.groupBy("function").cogroup(edges.groupBy("function")).applyInPandas(run, f"function {kind}, source string, target string, symbol string")


def project_graph(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """The call graph (nodes: function symbols) or include graph (nodes: files): a row per node, ends of edges included, with
    its distinct successors and predecessors, 0 where none. An edge with an empty end is an error when it is read."""
    if kind not in ("call", "include"):
        raise ValueError("graph kind must be call or include")
    empty = (F.col("source") == "") | (F.col("target") == "")
    own = unique_edges(edges.where(F.col("kind") == kind).withColumn("source", F.when(empty, F.raise_error(F.lit("empty graph endpoint"))).otherwise(F.col("source"))).select("source", "target"))
    out, back = own.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out_degree")), own.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    every = nodes.select("node").unionByName(out.select("node")).unionByName(back.select("node")).distinct()
    return every.join(out, "node", "left").join(back, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_degree", "in_degree")])
