"""Near-duplicate documents: SetSketch registers, banding, joint likelihood estimates, exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._graph import connected_components
from quarrylens.llm._shared import materialize
from quarrylens.llm._textkit import grams, mix, row_of, slices, valid

SHINGLE, PERCENT = 5, 85
REGISTERS, BANDS = 128, 32
#: SetSketch parameters: base, rate and the truncation q + 1 of the registers.
SKETCH_BASE, SKETCH_RATE, SKETCH_TOP = 1.02, 20.0, 4095
#: A pair whose likeliest similarity lies this far below a threshold of 0.85 is not verified (five deviations); at other
#: thresholds the margin is as many deviations wide.
MARGIN = 0.16
#: Shingles of one block in the verification of a large group of candidates.
BLOCK_SHINGLES = 600_000

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW = -(1 << 63)


def shingle_sets(column: pa.Array):
    """(normalised text's words as bytes, sorted distinct shingle hashes) of each row, in order."""
    for w in slices(column, lower=True):
        hashes = w.hashes()
        runs, ok, rows = grams(hashes, SHINGLE), valid(w.first, SHINGLE), row_of(w.first)
        lowered = w.data.tobytes()
        starts, ends = w.starts.tolist(), w.ends.tolist()
        for r in range(w.hi - w.lo):
            a, b = int(w.first[r]), int(w.first[r + 1])
            words = b" ".join([lowered[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)])
            if b - a >= SHINGLE:
                found = np.unique(runs[a : b - SHINGLE + 1])
            elif b > a:
                found = grams(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                found = np.zeros(0, np.uint64)
            yield words, found
        del ok, rows


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: for each, the minimum over the set of exponential variates of rate SKETCH_RATE, on an
    exponential scale of base SKETCH_BASE, truncated to 0..SKETCH_TOP. The union's registers are the maxima."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 512):
        np.minimum(least, np.multiply.outer(shingles[lo : lo + 512], _MULTIPLIERS).min(0), out=least)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / SKETCH_RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(SKETCH_BASE)), 0, SKETCH_TOP).astype(np.uint16)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of neighbouring registers."""
    parts = sketch.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(parts.shape[1]):
        key = mix((key ^ parts[:, k]) * np.uint64(0xBF58476D1CE4E5B9))
    return key.view(np.int64)


def _slope(j: float, n_u: float, n_v: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The slope at similarity j of the joint log-likelihood of two sketches given the set sizes and how many
    registers are more, less or equal. It is concave: the likeliest similarity is j or more where this is >= 0."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    scale = (SKETCH_BASE - 1) / SKETCH_BASE
    log_b = np.log(SKETCH_BASE)
    x, y = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    p, q = -np.log1p(-x * scale) / log_b, -np.log1p(-y * scale) / log_b
    dp, dq = -v * scale / log_b / (1 - x * scale), -u * scale / log_b / (1 - y * scale)
    return more * dp / p + less * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-9)


def link(sets: list[np.ndarray], percent: int = PERCENT, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` with 100 * intersection >= percent * union; with ``sides`` (0 or 1)
    only pairs across matter.

    Pairs are dropped by exact bounds (sizes; shingles that no other set here has cannot be shared) and by the
    sketches' likelihood; the rest are verified on the full sets unless already connected.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    every, counts = np.unique(np.concatenate(sets), return_counts=True) if n else (np.zeros(0, np.uint64), np.zeros(0, int))
    alone = np.array([(counts[np.searchsorted(every, s)] == 1).sum() for s in sets], np.float64)
    sketches = np.stack([registers(s) for s in sets]) if n else np.zeros((0, REGISTERS), np.uint16)
    least = percent / 100
    margin = MARGIN * np.sqrt(least * (1 - least) / (0.85 * 0.15))
    parent = list(range(n))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    forest = []
    for i in np.argsort(alone, kind="stable").tolist():
        shared = np.minimum(sizes[i] - alone[i], sizes - alone)
        whole = np.maximum(sizes[i] + alone, sizes + alone[i])
        near = (100 * shared >= percent * whole) & (np.arange(n) > i)
        if sides is not None:
            near &= sides != sides[i]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        own, theirs = sketches[i], sketches[others]
        equal = (theirs == own).sum(1)
        more = (theirs < own).sum(1)
        likely = _slope(least - margin, sizes[i], sizes[others], more, REGISTERS - equal - more, equal) >= 0
        others, equal = others[likely], equal[likely]
        for j in others[np.argsort(-equal, kind="stable")].tolist():
            if root(i) == root(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
                forest.append((i, j))
    return forest


def sketch_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (a digest of the normalised words), n_shingles and bands of every document."""

    def run(batches):
        for batch in batches:
            keys, sizes, bands = [], [], []
            for words, found in shingle_sets(batch.column(1)):
                keys.append(hashlib.md5(words).digest())
                sizes.append(len(found))
                bands.append(bands_of(registers(found)) if len(found) else np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(np.cumsum([0] + [len(b) for b in bands]).astype(np.int32), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            if keys:
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), flat], names=["doc_id", "text_hash", "key", "n_shingles", "bands"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, key binary, n_shingles long, bands array<long>")


def _verify(documents: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between keys: a spanning forest of the true links within each loose group.

    ``wanted``: key, rep (a document that has it), grp, n_shingles. A group of up to two blocks is verified in one
    task. A larger one is dealt into blocks by size class (sets of classes that are not neighbours are too unlike
    in size) and by hash; every two blocks that can hold a link meet in one task, so tasks stay bounded.
    """
    size_class = F.floor(F.log("n_shingles") / float(np.log(100 / percent)))
    rows = wanted.withColumn("c", size_class.cast("int"))
    totals = rows.groupBy("grp").agg(F.sum("n_shingles").alias("total"))
    classes = rows.groupBy("grp", "c").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("nb"))
    rows = rows.join(totals, "grp")
    small = rows.where(F.col("total") <= 2 * BLOCK_SHINGLES).select("key", "rep", F.col("grp").alias("task"), F.lit(None).cast("int").alias("side"))
    big = rows.where(F.col("total") > 2 * BLOCK_SHINGLES)
    for name, shift in (("nb", 0), ("up", -1), ("down", 1)):
        big = big.join(classes.select("grp", (F.col("c") + shift).alias("c"), F.col("nb").alias(name)), ["grp", "c"], "left")
    block = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda c1, b1, c2, b2, side: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), side.alias("side"))
    c, own = F.col("c"), F.col("block")
    zero, one = F.lit(0), F.lit(1)
    pairs = F.concat(
        F.transform(numbers(F.col("nb")), lambda j: meet(c, F.least(own, j), c, F.greatest(own, j), F.when(own == j, F.lit(None).cast("int")).when(own < j, zero).otherwise(one))),
        F.transform(numbers(F.coalesce("up", zero)), lambda j: meet(c, own, c + 1, j, zero)),
        F.transform(numbers(F.coalesce("down", zero)), lambda j: meet(c - 1, j, c, own, one)),
    )
    big = big.withColumn("block", block).select("key", "rep", "grp", F.explode(pairs).alias("p"))
    task = F.md5(F.concat_ws(":", F.hex("grp"), *[F.col(f"p.{x}").cast("string") for x in ("c1", "b1", "c2", "b2")])).cast("binary")
    tasks = small.unionByName(big.select("key", "rep", task.alias("task"), F.col("p.side").alias("side")))
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(tasks, "rep").select("task", "key", "side", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sets, sides, seen = [], [], [], set()
        for key, side, (words, found) in zip(pdf["key"], pdf["side"], shingle_sets(pa.array(pdf["text"], pa.string())), strict=True):
            key = bytes(key)
            if (key, side) not in seen and hashlib.md5(words).digest() == key:
                seen.add((key, side))
                keys.append(key)
                sets.append(found)
                sides.append(-1 if pd.isna(side) else int(side))
        across = np.array(sides)
        forest = link(sets, percent, across if len(across) and across[0] >= 0 else None)
        return pd.DataFrame({"a": [keys[i] for i, _ in forest], "b": [keys[j] for _, j in forest]})

    return met.groupBy("task").applyInPandas(run, "a binary, b binary")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, text_hash (xxhash64 of the text), component_id and kept of every document.

    A document's set is its distinct five-word shingles (ASCII letters lowered; with fewer words, the whole
    sequence); documents are linked at 100 * intersection >= percent * union; component_id is the least doc_id
    reachable; kept where that is the document itself.

    1. One scan gives each text a digest, a SetSketch and its bands; equal texts are one node from here on, so
       groups of exact copies cost a row. 2. Nodes that share a band's registers are candidates; a bucket is
       joined by its least node only, never by all pairs. 3. Loose groups: components of those stars. 4. Within a
       loose group, pairs pass exact bounds, the joint likelihood of their registers, then the full sets
       (``_verify``); a spanning forest of true links comes out. 5. Components of the true links.
    At similarity 0.85 or more a pair misses all bands with probability under 1e-10, at 0.8 under 1e-7.

    Null or wordless text: an empty set, linked with nothing. Null doc_id: takes part; its component is the least
    id in reach, if any. Rows that repeat a doc_id are judged by their own texts, and rows of the least doc_id of
    a component are all kept. Other columns are ignored; an empty table gives no rows.
    """
    sketched = materialize(sketch_documents(documents), "sketches")
    nodes = materialize(sketched.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")), "nodes")
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("key").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "center")
    stars = members.join(buckets, "bucket").where("key != center").select(F.col("key").alias("a"), F.col("center").alias("b"))
    groups = connected_components(stars).select(F.col("node").alias("key"), F.col("root").alias("grp"))
    wanted = materialize(nodes.select("key", "n_shingles", F.coalesce("first_id", F.lit(_LOW)).alias("rep")).join(groups, "key"), "wanted")
    true = connected_components(_verify(documents, wanted, percent)).select(F.col("node").alias("key"), "root")
    rooted = nodes.select("key", "first_id").join(true, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("key", "component_id")
    out = sketched.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).otherwise(F.concat_ws("-", F.lit("none"), F.col("doc_id").cast("string")).cast("binary")).alias("key")).join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "text_hash", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns."""
    kept = near_duplicates(documents, percent).where("kept").select("doc_id", "text_hash").distinct().alias("_k")
    rows = documents.alias("_d")
    is_same = F.col("_d.doc_id").cast("long").eqNullSafe(F.col("_k.doc_id")) & (F.xxhash64(F.col("_d.text").cast("string")) == F.col("_k.text_hash"))
    return rows.join(kept, is_same, "left_semi")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")
