"""A Merkle manifest of the documents of each source, its subtrees stored in van Emde Boas order.

Leaves are numbered within their source and dealt into aligned blocks of 3**HEIGHT; a block is one subtree and one row
of the store. The roots of a source's blocks are the leaves of the next round, until one is left; the sources' roots
form a last tree in the same way. A block keeps its nodes in one array, the upper half of its levels before the lower
subtrees and so on within each, so that a path from a leaf up touches few stretches of it; places are plain arithmetic.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._shared import materialize
from quarrylens.operators.order import positions

FAN = 3
HEIGHT = 7  # levels of edges in a block: at most 3**7 leaves, 105 kB of nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "tree long, block long, n long, height int, nodes binary, root binary"
_PROVED = "doc_id string, source string, leaf string, received_leaf string, subroot string, lefts array<string>, rights array<string>"
_PATH = "tree long, block long, lefts array<string>, rights array<string>"


def nodes_in(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def veb_places(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """The places of nodes ``index`` of level ``depth`` (0: the root) in a full tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return veb_places(upper, depth, index)
    below = FAN ** (depth - upper)
    return nodes_in(upper) + index // below * nodes_in(levels - upper) + veb_places(levels - upper, depth - upper, index % below)


@functools.lru_cache(64)
def _places(height: int, depth: int) -> np.ndarray:
    return veb_places(height + 1, depth, np.arange(FAN**depth))


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build_block(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """The nodes of a block in van Emde Boas order (absent ones are zeros), and its root."""
    cells, level = np.zeros((nodes_in(height + 1), 32), np.uint8), leaves
    for depth in range(height, -1, -1):
        cells[_places(height, depth)[: len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        if depth:
            text = [x.hex() for x in level]
            level = [hashlib.sha256("".join(text[i : i + FAN]).encode()).digest() for i in range(0, len(text), FAN)]
    return cells.tobytes(), level[0]


def block_paths(nodes: bytes, leaves: int, height: int) -> list[tuple[list[str], list[str]]]:
    """For each leaf of a block the siblings left and right of its path, from the bottom level up."""
    out = [([], []) for _ in range(leaves)]
    count = leaves
    for depth in range(height, 0, -1):
        level = [nodes[32 * p : 32 * p + 32].hex() for p in _places(height, depth)[:count].tolist()]
        step = FAN ** (height - depth)
        sides = []
        for i in range(count):
            run = i - i % FAN
            sides.append(("".join(level[run:i]), "".join(level[i + 1 : run + FAN])))
        for i, (lefts, rights) in enumerate(out):
            left, right = sides[i // step]
            lefts.append(left)
            rights.append(right)
        count = -(-count // FAN)
    return out


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields: ``-`` for null, else the UTF-8 length, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _blocks(leaves: DataFrame, most: int, carried: str = "") -> DataFrame:
    """A row per block of ``leaves`` (tree, pos, n: the leaves of the tree, digest), written. ``carried`` names further
    columns as DDL; they come back as arrays in leaf order."""
    names = [c.split()[0] for c in carried.split(", ") if c]
    kinds = "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in carried.split(", ") if c)
    full = FAN**most

    def run(key, pdf):
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        height = most
        while n <= full and height and FAN ** (height - 1) >= n:  # a tree of one block is as high as it must be
            height -= 1
        nodes, root = build_block(list(pdf["digest"]), height)
        return type(pdf)([[*map(int, key), n, height, nodes, root, *[list(pdf[c]) for c in names]]], columns=["tree", "block", "n", "height", "nodes", "root", *names])

    block = F.expr(f"pos div {full}").alias("block")
    return materialize(leaves.select("tree", block, "pos", "n", "digest", *names).groupBy("tree", "block").applyInPandas(run, _BLOCK + kinds), "merkle")


def build_forest(leaves: DataFrame, height: int = HEIGHT, carried: str = "") -> list[DataFrame]:
    """The blocks of every tree, round by round: the first holds the leaves, the last one block a tree."""
    rounds, full = [_blocks(leaves, height, carried)], FAN**height
    while rounds[-1].agg(F.max("block")).first()[0]:
        up = rounds[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(n + {full - 1}) div {full}").alias("n"), F.col("root").alias("digest"))
        rounds.append(_blocks(up, height))
    return rounds


def _leaves_of(block: dict, full: int) -> int:
    return int(min(block["n"] - block["block"] * full, full))


def paths_below(blocks: DataFrame, upper: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The path of every leaf of ``blocks``: its own block's siblings, then those of its block's root, which ``upper``
    (tree, block, lefts, rights) gives. Leaves are the blocks of the round below, and named so."""
    full = FAN**height

    def run(left, right):
        rows = []
        for b, u in zip(left.to_dict("records"), right.to_dict("records"), strict=True):
            for i, (lefts, rights) in enumerate(block_paths(b["nodes"], _leaves_of(b, full), b["height"])):
                rows.append((b["tree"], b["block"] * full + i, [*lefts, *u["lefts"]], [*rights, *u["rights"]]))
        return type(left)(rows, columns=["tree", "block", "lefts", "rights"])

    return blocks.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(run, _PATH)


def _paths(rounds: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The paths of the first round's blocks: from ``tops`` (tree, lefts, rights) down."""
    paths = tops.select("tree", F.lit(0).cast("long").alias("block"), "lefts", "rights")
    for blocks in rounds[:0:-1]:
        paths = paths_below(blocks.select("tree", "block", "n", "height", "nodes"), paths, height)
    return paths


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf (hex) gives with the siblings of its path."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda at, x: F.sha2(F.concat(x["l"], at, x["r"]), 256))


def proof_hash(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def prove(documents: DataFrame, received: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, source, leaf, received_leaf (of the text ``received``; the leaf itself if that is the text, or not given),
    subroot of the source, root of all sources, and the leaf's siblings on its path, ``lefts`` and ``rights`` a level.

    A leaf hashes the FIELDS of a row, each ``-`` if null. Within a source leaves ascend by doc_id, null first; rows with
    equal doc_ids by their leaf, so repeated rows stand side by side and are proved one by one. Sources ascend bytewise,
    null first, which is a source like others. No rows give no rows. Other columns are ignored. Text is read once and
    never shuffled; a source may hold any share of the rows, a task gets a block of at most 3**height leaves at a time.
    """
    fields = [F.col(c) for c in FIELDS]
    docs = documents.select(*fields, (F.col("text") if received is None else received).alias("received"))
    leaf, other = leaf_hash(*fields), leaf_hash(*fields[:-1], F.col("received"))
    hashed = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.unhex(leaf).alias("digest"), F.when(~F.col("received").eqNullSafe(F.col("text")), F.unhex(other)).alias("other"))
    placed = positions(hashed, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("other")], "at")
    sources = materialize(positions(placed.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), [F.col("first")], "tree").withColumnRenamed("source", "name"), "sources")
    leaves = placed.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("tree", (F.col("at") - F.col("first")).alias("pos"), "n", "digest", "doc_id", "other")
    own = build_forest(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), height, "doc_id string, other binary")
    subroots = own[-1].select("tree", F.col("root").alias("digest"))
    top = build_forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sources.count()).cast("long").alias("n"), "digest"), height)
    nothing = F.array().cast("array<string>")
    tops = _paths(top, top[-1].select("tree", nothing.alias("lefts"), nothing.alias("rights")), height)
    tops = paths_below(top[0].select("tree", "block", "n", "height", "nodes"), tops, height).select(F.col("block").alias("tree"), "lefts", "rights")
    named = subroots.join(sources.select("tree", "name"), "tree").select("tree", F.col("name").alias("source"), F.lower(F.hex("digest")).alias("subroot"))
    full, upper = FAN**height, _paths(own, tops, height).join(named, "tree")  # a row a block

    def run(left, right):
        rows = []
        for b, u in zip(left.to_dict("records"), right.to_dict("records"), strict=True):
            at = _places(b["height"], b["height"])
            for i, (lefts, rights) in enumerate(block_paths(b["nodes"], _leaves_of(b, full), b["height"])):
                key, changed = b["doc_id"][i], b["other"][i]
                leaf = b["nodes"][32 * at[i] : 32 * at[i] + 32].hex()
                rows.append((key, u["source"], leaf, leaf if changed is None else changed.hex(), u["subroot"], [*lefts, *u["lefts"]], [*rights, *u["rights"]]))
        return type(left)(rows, columns=["doc_id", "source", "leaf", "received_leaf", "subroot", "lefts", "rights"])

    proved = own[0].groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(run, _PROVED)
    root = top[-1].select(F.lower(F.hex("root"))).first()  # one row, or none
    return proved.withColumns({"doc_id": F.col("doc_id").cast("long"), "root": F.lit(root[0] if root else None).cast("string")})


def digest(proved: DataFrame) -> DataFrame:
    lefts, rights = F.col("lefts"), F.col("rights")
    folded = proved.withColumn("folded_root", fold(F.col("received_leaf"), lefts, rights))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_hash(lefts, rights).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def without_newlines(doc_id: Column, text: Column) -> Column:
    """The text as received where half of the ids, by their checksum, have lost their line ends."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
