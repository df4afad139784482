"""Benchmark decontamination: documents and benchmark items are joined by shared seeds, and each pair is tiled greedily."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm._shared import materialize
from quarrylens.llm._textkit import grams, row_of, slices, valid

MIN_TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: The filter of seeds that goes to every task has about 64 bits a seed, and no more than this power of two of bits (32 MB).
#: Fuller, it lets more seeds of documents through to the join, which decides.
FILTER_POWER = 28
#: Rows of documents that go to one salt of a hot seed, and the share of all rows (one in so many) from which a seed is hot.
SALT_ROWS, HOT_SHARE = 50_000, 10_000
#: Items that are tiled with one copy of a document's text.
ITEMS_A_ROW = 64
_LOW = -(1 << 63)
_BITMAP_BITS = 32_768  # of one bitmap of Spark's bitmap functions
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _fingerprints(words: np.ndarray, n: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of the n-word windows without marked words, and where they start."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[n:] == marked[:count])
    up = np.cumprod(np.full(len(words), _STEP, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    # windows are compared after both are brought to the power of the last word
    return (sums[at + n] - sums[at]) * up[len(words) - 1 - at], at


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: repeatedly take the longest matches of unmarked words, in
    page order, and mark them, until none has ``least`` words. Gives (item start, text start, length).

    That some match of n unmarked words exists holds for all smaller n too, so the longest length is found by
    bisection over fingerprints; each match is then compared word by word.
    """
    size = max(len(item), len(text))
    pad = lambda x: np.concatenate([x, np.zeros(size - len(x), np.uint64)])
    a, b = pad(item), pad(text)
    free_a, free_b = np.arange(size) < len(item), np.arange(size) < len(text)
    found, top = [], min(len(item), len(text))
    while top >= least:
        lo, hi = least - 1, top
        while lo < hi:
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if np.isin(_fingerprints(a, n, free_a)[0], _fingerprints(b, n, free_b)[0]).any() else (lo, n - 1)
        if lo < least:
            break
        n = lo
        (fa, at_a), (fb, at_b) = _fingerprints(a, n, free_a), _fingerprints(b, n, free_b)
        places = defaultdict(list)
        for f, i in zip(fb.tolist(), at_b.tolist(), strict=True):
            places[f].append(i)
        marked = False
        for f, i in zip(fa.tolist(), at_a.tolist(), strict=True):
            if not free_a[i : i + n].all():
                continue
            for j in places.get(f, ()):
                if free_b[j : j + n].all() and (a[i : i + n] == b[j : j + n]).all():
                    free_a[i : i + n] = free_b[j : j + n] = False
                    found.append((i, j, n))
                    marked = True
                    break
        top = n if marked else n - 1
    return found


def _item_seeds(batches):
    """A row per item and distinct seed: the item's words, and the places of the seed in it."""
    for batch in batches:
        for w in slices(batch.column(2), lower=True, bare=True):
            runs = grams(w.hashes(), MIN_TILE)
            at = np.flatnonzero(valid(w.first, MIN_TILE))
            if not len(at):
                continue
            rows = row_of(w.first)[at]
            order = np.lexsort((runs[at], rows))
            rows, seeds = rows[order], runs[at][order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (seeds[1:] != seeds[:-1])]))
            n, take = np.diff(w.first)[rows[new]], pa.array(rows[new] + w.lo)
            places = np.diff(np.concatenate([new, [len(rows)]]))
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(n.astype(np.int64)), pa.array(seeds[new].view(np.int64)), pa.array(places.astype(np.int64))], names=["iid", "ih", "n", "seed", "places"])


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds, made by Spark's bitmap functions; at most ``FILTER_POWER`` bits reach the driver, whatever the
    benchmark's size."""
    power = min(FILTER_POWER, max(15, (64 * seeds.count()).bit_length()))
    place = F.pmod("seed", F.lit(1 << power)) + 1
    maps = seeds.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((1 << power) // 8, np.uint8)
    step = _BITMAP_BITS // 8
    for bucket, own in maps.collect():
        bits[(bucket - 1) * step : bucket * step] = np.frombuffer(own, np.uint8)
    return bits


def _candidates(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """did, th, iid, ih of the pairs whose shared seeds could cover ``coverage`` of the item: an equi-join of seeds.

    Tiles of c words hold c / MIN_TILE shared places of seeds or more, so a pair shares at least ``least`` places of the item.
    The item's places whose seeds most documents have are left out of the join, half of ``least`` at most (``spare``);
    of the others ``least - spare`` must then be shared. A seed that is still hot is salted.
    """
    spark = docs.sparkSession
    seeds = materialize(items.distinct().mapInArrow(_item_seeds, "iid long, ih long, n long, seed long, places long"), "item-seeds")
    shared = spark.sparkContext.broadcast(_seed_filter(seeds))

    def doc_seeds(batches):
        bits = shared.value
        top = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            for w in slices(batch.column(2), lower=True, bare=True):
                runs = grams(w.hashes(), MIN_TILE)
                place = (runs & top).astype(np.int64)
                at = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) & valid(w.first, MIN_TILE))
                if not len(at):
                    continue
                rows, own = row_of(w.first)[at], runs[at]
                order = np.lexsort((own, rows))
                rows, own = rows[order], own[order]
                new = np.concatenate([[True], (np.diff(rows) != 0) | (own[1:] != own[:-1])])
                take = pa.array(rows[new] + w.lo)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(own[new].view(np.int64))], names=["did", "th", "seed"])

    found = materialize(docs.mapInArrow(doc_seeds, "did long, th long, seed long"), "doc-seeds")
    counts = materialize(found.groupBy("seed").agg(F.count(F.lit(1)).alias("rows")), "seed-counts")
    by_item = Window.partitionBy("iid", "ih")
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(coverage) / MIN_TILE - 1e-9))
    spare = F.floor((least - 1) / 2)
    seeds = (
        seeds.join(counts, "seed", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .withColumn("upto", F.sum("places").over(by_item.orderBy(F.desc("rows"), "seed").rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("upto") > spare) & (F.col("rows") > 0))
    )
    bound = max(SALT_ROWS, found.count() // HOT_SHARE)
    salts = F.ceil(F.col("rows") / SALT_ROWS).cast("int")
    hot = F.broadcast(counts.where(F.col("rows") > bound).select("seed", salts.alias("salts")))  # fewer than HOT_SHARE seeds
    dealt = found.join(hot, "seed", "left").select("did", "th", "seed", F.pmod(F.xxhash64("did", "th"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    spread = F.when(F.col("rows") > bound, salts).otherwise(1)
    seeds = seeds.select("iid", "ih", "seed", "places", (least - spare).alias("needed"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    pairs = dealt.join(seeds, ["seed", "salt"]).groupBy("did", "th", "iid", "ih").agg(F.sum("places").alias("places"), F.max("needed").alias("needed"))
    return materialize(pairs.where("places >= needed").select("did", "th", "iid", "ih"), "candidates")


def _shared_runs(words: np.ndarray, order: np.ndarray, ranked: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The words of a text that lie in seeds shared with the item, in order, with a word of no item between their runs. Tiles lie
    within these runs. ``ranked``: the text's seeds in the order ``order``."""
    own = np.unique(grams(item, MIN_TILE))
    lo, hi = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
    at = np.sort(np.concatenate([order[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
    if not len(at):
        return words[:0]
    inside = np.unique((at[:, None] + np.arange(MIN_TILE)).ravel())
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    other = np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[0]
    return np.insert(words[inside], breaks, other)


def _tile_pairs(coverage: float):
    """The function that tiles each text (did, th, text, items) with its items."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            for w in slices(batch.column(2), lower=True, bare=True):
                hashes, out = w.hashes(), []
                for r in range(w.hi - w.lo):
                    words = hashes[w.first[r] : w.first[r + 1]]
                    runs = grams(words, MIN_TILE)
                    order = np.argsort(runs, kind="stable")
                    ranked, own = runs[order], lists[w.lo + r].values
                    for x in slices(own.field(1), lower=True, bare=True):
                        of_items = x.hashes()
                        for k in range(x.hi - x.lo):
                            item = of_items[x.first[k] : x.first[k + 1]]
                            found = tiles(item, _shared_runs(words, order, ranked, item))
                            covered = sum(n for *_, n in found)
                            if covered >= coverage * len(item):
                                out.append((w.lo + r, own.field(0)[x.lo + k].as_py(), covered, len(item), len(found)))
                if out:
                    rows, *rest = zip(*out, strict=True)
                    take = pa.array(rows)
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, pa.int64()) for c in rest]], names=["did", "th", "iid", "covered", "item_words", "n_tiles"])

    return run


def _key(documents: DataFrame) -> tuple:
    """A row's doc_id (null: least of all) and the hash of its text."""
    return F.coalesce(documents["doc_id"].cast("long"), F.lit(_LOW)), F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit("")))


def _matches(documents: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """did, th (``_key``), iid, covered, item_words, n_tiles of each document row and item that it covers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did, th = _key(documents)
    docs = documents.select(did.alias("did"), th.alias("th"), text.alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(_LOW)).alias("iid"), F.xxhash64(text).alias("ih"), text.alias("text"))
    pairs = _candidates(docs, items, coverage)
    parts = pairs.groupBy("did", "th").agg(F.ceil(F.count(F.lit(1)) / ITEMS_A_ROW).alias("parts"))
    part = F.pmod(F.xxhash64("iid", "ih"), F.col("parts"))
    rows = pairs.join(parts, ["did", "th"]).join(items, ["iid", "ih"]).groupBy("did", "th", part.alias("part")).agg(F.collect_list(F.struct("iid", "text")).alias("items"))
    rows = materialize(rows, "pairs")  # Spark then knows its size, and broadcasts it only below its threshold
    return docs.join(rows, ["did", "th"]).select("did", "th", docs["text"], "items").mapInArrow(_tile_pairs(coverage), "did long, th long, iid long, covered long, item_words long, n_tiles long")


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, covered, item_words, n_tiles of every document and benchmark item such that tiles of at least
    MIN_TILE words cover ``coverage`` of the item's words, in any order.

    Words are runs of letters and digits, ASCII letters lowered. The seeds (MIN_TILE-word runs) of documents and items are
    rows, joined by their hashes; a pair that shares enough of them is tiled. Seeds of documents that no item has are
    left out before the shuffle by a filter of bounded size. A task holds one slice of text and some items at a time.

    Items with fewer than MIN_TILE words (null, empty) match nothing. Null text has no words. A null doc_id or item_id
    stays null; repeated rows are reported once each; other columns are ignored; empty tables give no rows.
    """
    whole = lambda c: F.when(F.col(c) != _LOW, F.col(c))
    return _matches(documents, benchmark, coverage).select(whole("did").alias("doc_id"), whole("iid").alias("item_id"), "covered", "item_words", "n_tiles")


def keep_clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no benchmark item, with all their columns. Rows that share a doc_id are judged by their own texts."""
    found = materialize(_matches(documents, benchmark, coverage).select("did", "th").distinct(), "contaminated")
    did, th = _key(documents)
    return documents.join(found, (did == found["did"]) & (th == found["th"]), "left_anti")
