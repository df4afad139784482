"""Repeated passages: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located by streaming
the texts through them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._shared import materialize
from quarrylens.llm._textkit import grams, mix, row_of, slices, sliding_min, valid

WINDOW, GRAM = 20, 6
#: Segments of one anchor that go to one shard, and rows (segments and patterns) held for one automaton.
SALT_SEGMENTS, HELD_ROWS = 4000, 20_000
#: Anchors that make up more than one in this many of all are told apart by a broadcast list, which has no more entries than this.
HOT_SHARE = 10_000
_LOW = -(1 << 63)
_SPOT = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("ctx", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("words", pa.string())])
_FOUND = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _segments(w, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchor of a window is the first of its GRAM-word runs whose hash is least; a segment is a run of windows with one
    anchor. Gives each segment's anchor word (in the slice), its hash, first word and end. Equal windows have equal
    anchors, so a window recurs only if its anchor does; each window is in one segment."""
    runs = grams(hashes, GRAM)
    width = WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(runs) < width:
        return none, np.zeros(0, np.uint64), none, none
    least = sliding_min(runs, width)
    anchor = np.full(len(least), -1, np.int64)
    for k in reversed(range(width)):
        np.copyto(anchor, np.arange(k, k + len(least)), where=runs[k : k + len(least)] == least)
    starts = np.flatnonzero(valid(w.first, WINDOW))
    if not len(starts):
        return none, np.zeros(0, np.uint64), none, none
    anchor = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return anchor[new], runs[anchor[new]], starts[new], starts[last] + WINDOW


def _find_anchors(batches):
    for batch in batches:
        for w in slices(batch.column(2)):
            at, runs, _, _ = _segments(w, w.hashes())
            rows = row_of(w.first)[at] if len(at) else np.zeros(0, np.int64)
            take = pa.array(rows + w.lo)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array((at - w.first[rows]).astype(np.int32)), pa.array(runs.view(np.int64))], names=["did", "th", "pos", "h"])


def _recurring_segments(batches):
    """The segments of each text whose anchors recur, with how often they do."""
    power = np.cumprod(np.full(2 * WINDOW, 0xD6E8FEB86659FD93, np.uint64))
    for batch in batches:
        lists = batch.column(3)
        for w in slices(batch.column(2)):
            hashes = w.hashes()
            at, runs, lo, hi = _segments(w, hashes)
            if not len(at):
                continue
            part = lists.slice(w.lo, w.hi - w.lo)
            own = part.flatten()
            pos, n = own.field(0).to_numpy(zero_copy_only=False), own.field(1).to_numpy(zero_copy_only=False)
            wanted = pos + w.first[np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))]
            order = np.argsort(wanted)
            near = np.minimum(np.searchsorted(wanted[order], at), len(order) - 1)
            keep = wanted[order][near] == at
            at, runs, lo, hi, n = at[keep], runs[keep], lo[keep], hi[keep], n[order][near][keep]
            ctx = mix((at - lo).astype(np.uint64))
            for k in range(2 * WINDOW - GRAM):
                inside = lo + k < hi
                ctx = ctx + np.where(inside, hashes[np.minimum(lo + k, len(hashes) - 1)] * power[k], np.uint64(0))
            data = w.data.tobytes()
            texts = [data[s:e].decode() for s, e in zip(w.starts[lo].tolist(), w.ends[hi - 1].tolist(), strict=True)]
            rows = row_of(w.first)[at]
            take = pa.array(rows + w.lo)
            for k in range(0, len(texts), 20_000):
                s = slice(k, k + 20_000)
                yield pa.record_batch([pa.array(runs[s].view(np.int64)), pa.array(n[s]), pa.array(mix(ctx[s]).view(np.int64)), batch.column(0).take(take[s]), batch.column(1).take(take[s]), pa.array((lo - w.first[rows])[s].astype(np.int32)), pa.array(texts[s], pa.string())], schema=_SPOT)


def _windows(batches):
    """The windows of segments, by a hash of their words."""
    for batch in batches:
        for w in slices(batch.column(5)):
            at = np.flatnonzero(valid(w.first, WINDOW))
            if not len(at):
                continue
            rows = row_of(w.first)[at]
            h, ctx, did, th, c = (batch.column(k).take(pa.array(rows + w.lo)) for k in (0, 1, 2, 3, 6))
            starts = batch.column(4).take(pa.array(rows + w.lo)).to_numpy() + (at - w.first[rows])
            yield pa.record_batch([h, pa.array(grams(w.hashes(), WINDOW)[at].view(np.int64)), ctx, did, th, pa.array(starts.astype(np.int32)), c], names=["h", "w", "ctx", "did", "th", "start", "c"])


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all rows, and where each row's begin."""
    parts = [(w.hashes(), w.first) for w in slices(column)]
    first, total = [np.zeros(1, np.int64)], 0
    for hashes, own in parts:
        first.append(own[1:] + total)
        total += len(hashes)
    return np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64), np.concatenate(first)


def _text_of(codes: np.ndarray) -> str:
    """A character for each code, surrogates left out."""
    return (codes + np.where(codes >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


def locate(segments: pa.Table, patterns: pa.Table) -> pa.RecordBatch:
    """Every place in ``segments`` (did, th, lo, words) where a pattern occurs later than at its own first place.

    ``patterns``: did, th, lo, words of a segment and ``starts``, the word numbers in its text where confirmed windows begin;
    null: the whole segment is one pattern. Words become single characters, patterns are compiled into an Aho-Corasick
    automaton, and all segments are streamed through it.
    """
    import ahocorasick

    column = lambda t, name: t.column(name).combine_chunks()
    number = lambda t, name: t.column(name).to_numpy()
    words, first = _sequence(column(patterns, "words"))
    vocabulary = np.unique(words)
    if not len(vocabulary) or not segments.num_rows:
        return pa.RecordBatch.from_pylist([], _FOUND)
    line = _text_of(np.searchsorted(vocabulary, words) + 1)
    starts = column(patterns, "starts")
    whole = starts.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(whole, 1, starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = np.repeat(np.arange(patterns.num_rows), sizes)
    place = np.repeat(number(patterns, "lo").astype(np.int64), sizes)
    place[~whole[row]] = starts.flatten().to_numpy(zero_copy_only=False)
    size = np.where(whole[row], (first[1:] - first[:-1])[row], WINDOW)
    begin = first[row] + place - number(patterns, "lo")[row]
    automaton = ahocorasick.Automaton()
    for k, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        automaton.add_word(line[b : b + n], k)
    automaton.make_automaton()

    words, first = _sequence(column(segments, "words"))
    near = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    stream = np.zeros(len(words) + segments.num_rows, np.int64)  # 0: a word of no pattern, and between rows
    at = np.arange(len(words)) + row_of(first)
    stream[at] = np.where(vocabulary[near] == words, near + 1, 0)
    found = np.fromiter((x for pair in automaton.iter(_text_of(stream)) for x in pair), np.int64).reshape(-1, 2)
    ends, which = found[:, 0], found[:, 1]
    heads = first[:-1] + np.arange(segments.num_rows)
    home = np.searchsorted(heads, ends, "right") - 1
    lo = number(segments, "lo")[home] + ends - size[which] + 1 - heads[home]
    did, th = number(segments, "did")[home], number(segments, "th")[home]
    p_did, p_th, p_lo = number(patterns, "did")[row][which], number(patterns, "th")[row][which], place[which]
    later = (did > p_did) | (did == p_did) & ((th > p_th) | (th == p_th) & (lo > p_lo))
    return pa.record_batch([pa.array(did[later]), pa.array(th[later]), pa.array(lo[later].astype(np.int32)), pa.array((lo + size[which])[later].astype(np.int32))], schema=_FOUND)


def _shards(batches):
    """Automata over runs of shards; a shard's rows come together, its segments before its patterns. Segments of the last shard
    are held until all its patterns have passed, in as many automata as they take."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= HELD_ROWS:
            is_pattern = pc.equal(held.column("kind"), 1)
            if pc.any(is_pattern).as_py():
                yield locate(held.filter(pc.invert(is_pattern)), held.filter(is_pattern))
            same = pc.and_(pc.equal(held.column("h"), held.column("h")[-1]), pc.equal(held.column("salt"), held.column("salt")[-1]))
            held = held.filter(pc.and_(same, pc.invert(is_pattern)))
    if held is not None:
        is_pattern = pc.equal(held.column("kind"), 1)
        yield locate(held.filter(pc.invert(is_pattern)), held.filter(is_pattern))


def _kept(w, marks: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a slice of texts: the words that no mark covers, joined by a space, and the number of words and of those removed.
    The kept bytes are picked with one mask over the slice; the byte after a kept word becomes the space."""
    own = marks.flatten()
    row = np.repeat(np.arange(len(marks)), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    change = np.zeros(len(w.starts) + 1, np.int64)
    for side, step in ((0, 1), (1, -1)):
        np.add.at(change, w.first[row] + own.field(side).to_numpy(zero_copy_only=False).astype(np.int64), step)
    keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    rows = row_of(w.first)[keep]
    inner = np.zeros(len(keep), bool)
    inner[:-1] = rows[1:] == rows[:-1]  # another kept word of the text follows
    starts, ends = w.starts[keep], w.ends[keep]
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    mask[ends[inner]] = True
    data[ends[inner]] = 0x20
    sizes = np.zeros(len(w.starts) + 1, np.int64)
    sizes[keep + 1] = ends - starts + inner
    offsets = np.cumsum(sizes)[w.first].astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(marks), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes())])
    n_words = np.diff(w.first)
    return text, n_words, n_words - np.bincount(rows, minlength=len(marks))


def _remove(batches):
    for batch in batches:
        for w in slices(batch.column(2)):
            text, n_words, n_removed = _kept(w, batch.column(3).slice(w.lo, w.hi - w.lo))
            yield pa.record_batch([batch.column(0).slice(w.lo, w.hi - w.lo), text, pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64))], names=["did", "kept", "n_words", "n_removed"])


def _recurring(anchors: DataFrame) -> DataFrame:
    """The anchors whose hash occurs twice or more, with its count. Hashes that make up a great share are looked up in a
    broadcast list of bounded length, the others by a join; so no task of the join holds a hot hash."""
    counts = materialize(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_SHARE > total  # fewer than HOT_SHARE of them, since their counts add up to the total at most
    hot = F.broadcast(counts.where(is_hot).select("h", F.col("n").alias("hot_n")))
    own = F.when(F.col("hot_n").isNull(), F.col("h")).otherwise(F.xxhash64("did", "th", "pos"))
    told = anchors.join(hot, "h", "left").withColumn("own", own).join(counts.where(~is_hot).select(F.col("h").alias("own"), "n"), "own", "left")
    return told.withColumn("n", F.coalesce("hot_n", "n")).where(F.col("n").isNotNull()).select("did", "th", "pos", "n")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space), n_words and n_removed of every document: each word is
    removed that a WINDOW-word window covers whose word sequence also starts earlier (smaller doc_id, or the same
    document, earlier start).

    1. Anchors: content-chosen GRAM-word runs, about one in eight words; windows with one anchor make a segment. Segments
       whose anchor's hash occurs once are gone.
    2. Confirmation: equal segments come to one row with its first place (map-side first, so a passage that very
       many documents share costs a row per task). If all of an anchor's segments are equal, the segment is a recurring passage;
       else its windows are counted, and those that occur twice or more are.
    3. Confirmed passages go to the shards of their anchors (an anchor with many segments has many), where they are compiled
       into Aho-Corasick automata; the segments of all documents are streamed through them (``locate``), and each
       occurrence after the first place marks its words. All marks come from there.
    4. Marked ranges are joined back to the texts.
    Nothing is capped or sampled: a window recurs only if its anchor does.

    Null text: no words. Null doc_id counts as the smallest. Rows equal in doc_id and text are one document and get
    the same result; rows that share a doc_id only are ordered by a hash of the text. Other columns are ignored;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    anchors = _recurring(docs.mapInArrow(_find_anchors, "did long, th long, pos int, h long"))
    places = anchors.groupBy("did", "th").agg(F.collect_set(F.struct("pos", "n")).alias("places"))
    spots = materialize(docs.join(places, ["did", "th"]).mapInArrow(_recurring_segments, "h long, n long, ctx long, did long, th long, lo int, words string"), "segments")
    distinct = spots.groupBy("h", "ctx").agg(F.min(F.struct("did", "th", "lo", "words")).alias("f"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    distinct = materialize(distinct.select("h", "n", "ctx", "f.*", "c"), "distinct")
    mixed = distinct.where("c < n")
    windows = mixed.select("h", "ctx", "did", "th", "lo", "words", "c").mapInArrow(_windows, "h long, w long, ctx long, did long, th long, start int, c long")
    confirmed = windows.groupBy("h", "w").agg(F.min(F.struct("did", "th", "start", "ctx")).alias("f"), F.sum("c").alias("c")).where("c > 1")
    starts = confirmed.groupBy("h", F.col("f.ctx").alias("ctx")).agg(F.collect_list("f.start").alias("starts"))
    columns = ["h", "n", "did", "th", "lo", "words", "starts"]
    patterns = distinct.where("c >= n").withColumn("starts", F.lit(None).cast("array<int>")).select(columns).unionByName(mixed.join(starts, ["h", "ctx"]).select(columns))
    patterns = materialize(patterns, "patterns")  # frees the shuffle files of the confirmation before the segments are dealt
    salts = F.ceil(F.col("n") / SALT_SEGMENTS).cast("int")
    patterns = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("kind", F.lit(1))
    streamed = spots.select("h", "did", "th", "lo", "words", F.lit(None).cast("array<int>").alias("starts"), F.pmod(F.xxhash64("did", "th", "lo"), salts).cast("int").alias("salt"), F.lit(0).alias("kind"))
    shards = streamed.unionByName(patterns.drop("n")).repartition("h", "salt").sortWithinPartitions("h", "salt", "kind")
    located = shards.select("h", "salt", "kind", "did", "th", "lo", "words", "starts").mapInArrow(_shards, "did long, th long, lo int, hi int")
    marks = materialize(located.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")), "marks")
    done = docs.join(marks, ["did", "th"], "left").select("did", "th", "text", "marks").mapInArrow(_remove, "did long, kept string, n_words long, n_removed long")
    return done.select(F.when(F.col("did") != _LOW, F.col("did")).alias("doc_id"), "kept", "n_words", "n_removed")


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
