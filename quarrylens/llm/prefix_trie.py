"""Prefix trie of conversations, and sums over its subtrees by centroid decomposition.

A node is named by its smallest member and its depth, so the path of a conversation, (conv_id, depth) to owner, also gives
every ancestor of a node by one equi-join. Subtree sums take the forest apart: of each component the centroid (its
deepest node with more than half of the component below it) goes, the component's parts are labelled by their new tops,
and what hangs on the centroid, its parts' totals and its own value, is added to the nodes from the centroid to the
component's top. Components of up to LOCAL nodes are taken apart inside a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._shared import materialize
from quarrylens.operators.order import positions_within

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 32  # turns whose prefixes are hashed together
LOCAL = 1 << 14  # nodes of a component that one task takes apart
IDS = 512  # conversation ids joined into one text


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, place (from 0), th (a digest of role and text) and words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    return positions_within(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("th")], "place").select("conv", "place", "th", "words")


def head_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % 4).cast("long")


def rebuilt(turns: DataFrame, family: int = 20, heads: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, len) and their turns (conv, len, place, th, words) after each took the first h turns of its
    family's first one (conv - conv % family) in place of its own first h."""
    h = head_turns(F.col("conv")) if heads is None else heads
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")).join(base, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = materialize(plan.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    own = turns.join(plan, "conv").where("place >= h").select("conv", "len", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "th", "words")
    first = turns.select(F.col("conv").alias("base"), "place", "th", "words")
    head = plan.where("taken > 0").join(first, "base").where("place < taken").select("conv", "len", "place", "th", "words")
    return plan.select("conv", "len"), own.unionByName(head)


def prefix_keys(turns: DataFrame, longest: int) -> DataFrame:
    """conv, place and a key of the turns up to there, equal for equal sequences: chunks are hashed by themselves, and
    the sequence of whole chunks before one in the same way, so a conversation may be of any length."""
    packed = turns.groupBy("conv", F.expr(f"place div {CHUNK}").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "th"))), lambda x: x["th"]).alias("hs"))
    upto = F.transform(F.sequence(F.lit(1), F.size("hs")), lambda i: F.sha2(F.array_join(F.slice("hs", F.lit(1), i), ""), 256))
    within = packed.select("conv", "q", F.posexplode(upto).alias("at", "key")).select("conv", "q", (F.col("q") * CHUNK + F.col("at")).alias("place"), "key")
    if longest <= CHUNK:
        return within.select("conv", "place", "key")
    whole = packed.select("conv", F.col("q").alias("place"), F.sha2(F.array_join("hs", ""), 256).alias("th"))
    before = prefix_keys(whole, -(-longest // CHUNK)).select("conv", (F.col("place") + 1).alias("q"), F.col("key").alias("head"))
    joined = F.when(F.col("head").isNull(), F.col("key")).otherwise(F.sha2(F.concat("head", "key"), 256))
    return within.join(before, ["conv", "q"], "left").select("conv", "place", joined.alias("key"))


def trie_paths(convs: DataFrame, turns: DataFrame) -> DataFrame | None:
    """conv, len, depth (0: the root), owner (the smallest member of the node there), above (the owner one level up),
    n_convs and words (of the node's last text): a node is a row whose conv is its owner. None without conversations."""
    total, least, longest = convs.agg(F.count(F.lit(1)), F.min("conv"), F.max("len")).first()
    if not total:
        return None
    turns = materialize(turns, "turns")
    keyed = materialize(turns.join(prefix_keys(turns, longest), ["conv", "place"]).select("conv", "len", (F.col("place") + 1).alias("depth"), "key", "words"), "prefixes")
    nodes = keyed.groupBy("key").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    below = keyed.select("conv", "len", "depth", "key").join(nodes, "key").drop("key")
    root = convs.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("owner"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    owned = materialize(root.unionByName(below), "owned")
    above = owned.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    return materialize(owned.join(above, ["conv", "depth"], "left"), "paths")


def node_counts(paths: DataFrame) -> DataFrame:
    """owner, depth and how many nodes the subtree holds: a member's own nodes are the end of its path, so each adds those
    of its own at that depth or below."""
    starts = paths.where("conv = owner").groupBy("conv").agg(F.min("depth").alias("start"))
    own = F.when(F.col("start").isNull(), F.lit(0)).otherwise(F.col("len") - F.greatest("start", "depth") + 1)
    return paths.join(starts, "conv", "left").groupBy("owner", "depth").agg(F.sum(own).alias("size"))


def take_apart(tops: list[int], kids: list[list[int]], up: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of a forest by centroid decomposition; ``up`` is the parent, ``kids`` the children of each node, and
    ``tops`` the nodes at which its trees start."""
    sums, gone, todo = [[0] * len(v) for v in values], bytearray(len(up)), list(tops)
    while todo:
        top = todo.pop()
        part = [top]
        for v in part:
            part += [k for k in kids[v] if not gone[k]]
        size, total = {}, {}
        for v in reversed(part):
            below = [k for k in kids[v] if not gone[k]]
            size[v] = 1 + sum(size[k] for k in below)
            total[v] = [sum(x) for x in zip(values[v], *[total[k] for k in below], strict=True)]
        centre = top
        while heavy := [k for k in kids[centre] if not gone[k] and 2 * size[k] > len(part)]:
            centre = heavy[0]
        v = centre
        while True:
            sums[v] = [a + b for a, b in zip(sums[v], total[centre], strict=True)]
            if v == top:
                break
            v = up[v]
        gone[centre] = 1
        todo += [k for k in kids[centre] if not gone[k]]
        if centre != top:
            todo.append(top)
    return sums


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """owner, depth, and for each of ``values`` the sum over the node's subtree as ``sum_<value>``. nodes: owner, depth,
    above (null at the root), size (nodes of its subtree) and the values; paths: conv, depth, owner, above.

    A level writes the few centroids and the table of nodes; there are log2 of nodes / ``local`` of them at most. A
    component may hold all nodes: joins on it can be split, and its totals are partial sums.
    """
    id_, sums = ["owner", "depth"], [f"sum_{v}" for v in values]
    root = nodes.where("depth = 0").select(F.col("owner").alias("top_owner"), F.col("depth").alias("top_depth"))
    steps = paths.select(F.col("conv").alias("owner"), F.col("depth").alias("at"), F.col("owner").alias("a_owner"), F.col("above").alias("a_above"))
    first = root.first()
    state = nodes.select(*id_, "above", "size", *values, *[F.lit(0).cast("long").alias(s) for s in sums], F.lit(first and first[0]).cast("long").alias("top_owner"), F.lit(0).cast("long").alias("top_depth"))
    state = materialize(state, "forest")
    while True:
        top = ["top_owner", "top_depth"]
        large = state.where(f"owner = top_owner and depth = top_depth and size > {local}").select(*top, F.col("size").alias("whole"))
        found = state.select(*top, *id_, "size").join(large, top).where("2 * size > whole").groupBy(*top).agg(F.max(F.struct("depth", "owner", "size")).alias("c"))
        centres = materialize(found.select(*top, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centroids")
        if centres.isEmpty():
            break
        held = state.join(centres, top, "left").withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        held = held.join(steps, ["owner", "at"], "left")
        is_centre = F.coalesce((F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth")), F.lit(False))
        hangs = F.coalesce(F.col("a_above") == F.col("c_owner"), F.lit(False))
        held = materialize(held.withColumns({"is_centre": is_centre, "hangs": hangs}), "labelled")
        parts = held.where("hangs or is_centre").groupBy(*top, "a_owner").agg(*[F.sum(v).alias(v) for v in values])  # totals of the parts, and of the centroid
        totals = parts.groupBy(*top).agg(*[F.sum(v).alias(f"c_{v}") for v in values])
        to_top = centres.join(totals, top).join(steps.withColumnRenamed("owner", "c_owner"), "c_owner").where("at between top_depth and c_depth")
        adds = to_top.select(F.col("a_owner").alias("owner"), F.col("at").alias("depth"), F.col("c_size").alias("less"), *[f"c_{v}" for v in values])
        kept = F.when(~F.col("is_centre"), F.lit(True))
        state = held.join(adds, id_, "left").select(
            *id_, "above", *values, (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *[(F.col(s) + F.coalesce(F.col(f"c_{v}"), F.lit(0))).alias(s) for s, v in zip(sums, values, strict=True)],
            F.when(kept, F.when(F.col("hangs"), F.col("a_owner")).otherwise(F.col("top_owner"))).alias("top_owner"), F.when(kept, F.when(F.col("hangs"), F.col("at")).otherwise(F.col("top_depth"))).alias("top_depth"),
        )
        state = materialize(state, "forest")

    def run(pdf):
        rows = list(pdf.itertuples(index=False))
        at = {(r.owner, r.depth): i for i, r in enumerate(rows)}
        tops, kids, up = [], [[] for _ in rows], [-1] * len(rows)
        for i, r in enumerate(rows):
            if (r.owner, r.depth) == (r.top_owner, r.top_depth):
                tops.append(i)
            else:
                up[i] = at[int(r.above), r.depth - 1]
                kids[up[i]].append(i)
        own = take_apart(tops, kids, up, [[getattr(r, v) for v in values] for r in rows])
        return type(pdf)([(r.owner, r.depth, *(getattr(r, s) + x for s, x in zip(sums, o, strict=True))) for r, o in zip(rows, own, strict=True)], columns=[*id_, *sums])

    schema = ", ".join(f"{c} long" for c in [*id_, *sums])
    bins = max(1, -(-state.count() // local))
    small = state.where("top_owner is not null").withColumn("bin", F.pmod(F.xxhash64("top_owner", "top_depth"), F.lit(bins)))
    done = small.withColumn("above", F.coalesce("above", F.lit(-1))).groupBy("bin").applyInPandas(run, schema)
    return done.unionByName(state.where("top_owner is null").select(*id_, *sums))


def end_hashes(paths: DataFrame) -> DataFrame:
    """owner, depth and the SHA-256 of the comma-joined ids, ascending, of the conversations that end there. Ids are joined
    in runs of IDS; where a node has several runs, one task hashes them one after another and holds one batch."""
    ends = paths.where("depth = len").select("owner", "depth", "conv")
    placed = positions_within(ends, ["owner", "depth"], [F.col("conv")], "place").withColumn("run", F.expr(f"place div {IDS}"))
    runs = materialize(placed.groupBy("owner", "depth", "run").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")), "ends")
    long_ = runs.where("run > 0").select("owner", "depth").distinct()
    short = runs.join(long_, ["owner", "depth"], "left_anti").select("owner", "depth", F.sha2("ids", 256).alias("ends_sha256"))

    def stream(frames):
        now, digest = None, None
        for pdf in frames:
            out = []
            for owner, depth, ids in pdf.itertuples(index=False):
                if (owner, depth) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield type(pdf)(out, columns=["owner", "depth", "ends_sha256"])
        if now:
            import pandas as pd

            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["owner", "depth", "ends_sha256"])

    many = runs.join(long_, ["owner", "depth"], "left_semi").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "run").select("owner", "depth", "ids")
    return short.unionByName(many.mapInPandas(stream, "owner long, depth long, ends_sha256 string"))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(conversations: DataFrame, family: int = 20, heads: Column | None = None, local: int = LOCAL) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens (sums over its subtree), ends_sha256.

    Turns go by ``turn``, null first; rows with equal turns by the digest of role and text, and repeated rows are turns
    of their own. Null role or text counts as empty. A row without conv_id belongs to no conversation and is left out.
    A conversation whose turns are all replaced by none stays, as a member of the root. No conversations: no nodes.
    Texts are read once and never shuffled. Other columns are ignored.
    """
    convs, turns = rebuilt(materialize(ordered_turns(conversations), "ordered"), family, heads)
    paths = trie_paths(convs, turns)
    if paths is None:
        return conversations.sparkSession.createDataFrame([], NODES)
    nodes = paths.where("conv = owner").select("owner", "depth", "above", "n_convs", "words")
    kids = nodes.where("depth > 0").groupBy(F.col("above").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(node_counts(paths), ["owner", "depth"]).join(kids, ["owner", "depth"], "left")
    full = materialize(full.withColumn("leaves", F.col("n_children").isNull().cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    sums = rollup(full.select("owner", "depth", "above", "size", "leaves", "saved"), paths, ["leaves", "saved"], local)
    out = full.join(sums, ["owner", "depth"]).join(end_hashes(paths), ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
