"""Data-set preparation and model evaluation."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.operators.dataset import canonical_hash
from quarrylens.operators.graph import components
from quarrylens.operators.order import positions, positions_within
from quarrylens.sources.shared import materialize


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(rows: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Counts and scores of (label, probability) rows, overall or for each ``by``."""
    hit, true = F.col("probability") >= threshold, F.col("label") == 1
    counts = [F.count_if(true & hit).alias("tp"), F.count_if(~true & ~hit).alias("tn"), F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn")]
    out = (rows.groupBy(*by) if by else rows).agg(*counts)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    return out.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn)).withColumn("balanced_accuracy", (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2)


def top_k(rows: DataFrame, ks: tuple[int, ...] = (1, 3), threshold: float = 0.5) -> DataFrame:
    """Share of positives with known lines whose first k ranked lines hold one, and that were also predicted. Rows:
    label, probability, truth (array), ranked (array or null). Null where no row has a ranking."""
    eligible = rows.where((F.col("label") == 1) & (F.size("truth") > 0))
    aggs = [F.count(F.lit(1)).alias("eligible")]
    for k in ks:
        hit = F.coalesce(F.arrays_overlap("truth", F.slice("ranked", 1, k)), F.lit(False))
        aggs += [F.count_if(hit).alias(f"h{k}"), F.count_if(hit & (F.col("probability") >= threshold)).alias(f"g{k}")]
    supported = rows.agg(F.max(F.col("ranked").isNotNull()).alias("supported"))
    out = eligible.agg(*aggs).join(F.broadcast(supported))
    share = lambda c: F.when(F.col("supported") & (F.col("eligible") > 0), F.col(c) / F.col("eligible"))
    return out.select("eligible", *[share(f"h{k}").alias(f"top_{k}") for k in ks], *[share(f"g{k}").alias(f"end_to_end_top_{k}") for k in ks])


def roc_auc(rows: DataFrame) -> DataFrame:
    """The area under the ROC curve with half for ties, from ranks instead of pairs: rows are first counted by score, and the
    negatives below each distinct score are running sums over ranges of scores. Null where a class is missing; rows
    without a score have the lowest."""
    scores = rows.groupBy("probability").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.coalesce(F.col("label") != 1, F.lit(True))).alias("q"))
    ranked = positions(scores, [F.col("probability").asc_nulls_first()], "at", {"q_below": F.col("q")})
    pairs = F.sum("p") * F.sum("q")
    return ranked.agg((F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)) / F.nullif(pairs, F.lit(0))).alias("auc"))


def score_summary(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """count, mean, sample deviation (null for one), least and most of a score over seeds; all null where no seed has it. A
    score that some seeds have and others lack is an error when read."""
    mixed = (F.count(score) > 0) & (F.count(score) < F.count(F.lit(1)))
    n = F.when(mixed, F.raise_error(F.lit("a score is null for some seeds and not for others"))).otherwise(F.count(score))
    return rows.groupBy(*by).agg(n.alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"))


def error_cases(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Samples that some seed gets wrong: errors by kind, and the seeds, in no order (see ``rank_errors``)."""
    wrong = (F.col("probability") >= threshold) != (F.col("label") == 1)
    bad = rows.where(wrong)
    out = bad.groupBy("sample_id").agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("label") != 1).alias("fp"), F.count_if(F.col("label") == 1).alias("fn"), F.array_join(F.transform(F.array_sort(F.collect_list("seed")), lambda s: s.cast("string")), ",").alias("seeds"))
    return out


def exact_dedup(rows: DataFrame, key: Column, group: str = "group_id") -> DataFrame:
    """One row per key: the least sample_id, how many it stands for, least and most label (a conflict if they differ),
    and the number of groups it came from."""
    return rows.groupBy(key.alias("key")).agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("least_label"), F.max("label").alias("most_label"), F.count_distinct(group).alias("groups"))


def group_links(rows: DataFrame, key: Column, group: str = "group_id") -> DataFrame:
    """Edges (source, target) that tie groups sharing a key: each to the key's least group."""
    pairs = rows.select(key.alias("k"), F.col(group).alias("g")).distinct()
    least = pairs.groupBy("k").agg(F.min("g").alias("m"))
    return pairs.join(least, "k").select(F.col("g").alias("source"), F.col("m").alias("target")).distinct()


def hash_split(rows: DataFrame, group: str, train: float, validation: float, seed: int, tries: int = 128, batch: int = 16) -> DataFrame:
    """group and split of every group of ``rows`` (group, label 0 or 1), for any number of groups: a try takes groups in the
    order of a seeded hash, the first to training, the next to validation, the rest to testing. Training must see both
    classes; of the tries the first with the most classes over all splits wins. Places come from ranges and prefix sums;
    the driver sees a row a try."""
    flags = [F.max((F.col("label") == k).cast("int")).alias(f"has_{k}") for k in (0, 1)]
    groups = materialize(rows.groupBy(F.col(group).alias("group")).agg(*flags), "groups")
    n_train, n_val = partition_sizes(groups.count(), train, validation)
    shuffled = lambda t: F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), t.cast("string"), F.col("group").cast("string")), 256)
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_val, "validation").otherwise("test").alias("split")
    best = None
    for first in range(0, tries, batch):
        tried = groups.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(min(first + batch, tries) - 1))))
        placed = positions_within(tried.withColumn("h", shuffled(F.col("try"))), ["try"], [F.col("h"), F.col("group")], "place")
        seen = placed.select("*", split).groupBy("try", "split").agg(F.max("has_0").alias("a"), F.max("has_1").alias("b"))
        score, sound = F.sum(F.col("a") + F.col("b")).alias("score"), F.max((F.col("split") == "train") & (F.col("a") == 1) & (F.col("b") == 1)).alias("sound")
        found = max(((r.score, -r["try"]) for r in seen.groupBy("try").agg(score, sound).where("sound").collect()), default=None)
        best = max(filter(None, (best, found)), default=None)
        if best and best[0] == 6:
            break
    if best is None:
        raise ValueError("no split gives training both classes")
    return positions(groups.withColumn("h", shuffled(F.lit(-best[1]))), [F.col("h"), F.col("group")], "place").select("group", split)


def partition_sizes(count: int, train: float, validation: float) -> tuple[int, int]:
    """How many of ``count`` groups go to training and to validation: at least one each, and one for testing."""
    if count < 3:
        raise ValueError("at least three groups are needed")
    n_val = min(count - 2, max(1, int(count * validation)))
    return min(max(1, int(count * train)), count - n_val - 1), n_val


#: The order of the seeded shuffles below is required to be equal to the one that stored splits were made with.
def seeded_split(group_classes: dict[str, set[int]], train: float, validation: float, seed: int, tries: int = 128) -> dict[str, str]:
    """The split of each group by seeded shuffles: training must see both classes; the first try with the most classes
    over all splits wins. For the few groups of a stored split, on the driver; see ``hash_split`` for any number."""
    n_train, n_val = partition_sizes(len(group_classes), train, validation)
    shuffle, best = random.Random(seed), None
    for _ in range(tries):
        order = sorted(group_classes)
        shuffle.shuffle(order)
        split = {g: "train" if i < n_train else "validation" if i < n_train + n_val else "test" for i, g in enumerate(order)}
        seen = {s: set().union(*(group_classes[g] for g in order if split[g] == s)) for s in ("train", "validation", "test")}
        if seen["train"] == {0, 1} and (best is None or sum(map(len, seen.values())) > best[0]):
            best = (sum(map(len, seen.values())), split)
    if best is None:
        raise ValueError("no split gives training both classes")
    return best[1]


def class_counts(rows: DataFrame, split: str = "split") -> DataFrame:
    """Rows of each class in each split, with zeros."""
    return rows.groupBy(split).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def collisions(rows: DataFrame, key: Column) -> DataFrame:
    """Feature keys that rows of different labels share."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).where("labels > 1")


def round_robin(rows: DataFrame, by: str, item: str) -> DataFrame:
    """Items in a hash-shuffled order that takes one of each ``by`` in turn: the turn of each."""
    w = W.partitionBy(by).orderBy(F.sha2(F.col(item).cast("string"), 256), item)
    return rows.withColumn("turn", F.row_number().over(w))


def corpus_rates(sites: DataFrame) -> DataFrame:
    """tp, fp, tn, fn of a labelled rule corpus: cases (positive or not) by whether any distinct site was found."""
    return sites.agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("positive") & (F.col("found") > 0)), ("fp", ~F.col("positive") & (F.col("found") > 0)), ("tn", ~F.col("positive") & (F.col("found") == 0)), ("fn", F.col("positive") & (F.col("found") == 0)))])


def rank_errors(cases: DataFrame) -> DataFrame:
    """Error cases, most errors first, then by id."""
    return cases.orderBy(F.desc("errors"), "sample_id")


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Which record each record is kept under: the least sample_id of its key; a row per record that is not kept, with its
    group and whether the labels of its key conflict. A long table, so that no key's records meet in one row."""
    keyed = rows.withColumn("_key", key)
    kept = keyed.groupBy("_key").agg(F.min("sample_id").alias("kept_id"), (F.min("label") != F.max("label")).alias("conflict"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keyed.join(kept, "_key").where(F.col("sample_id") != F.col("kept_id")).select("kept_id", F.col("sample_id").alias("duplicate_id"), "group_id", "conflict")


def manifest_problems(records: DataFrame, splits: DataFrame, counts: DataFrame) -> DataFrame:
    """What a split manifest gets wrong, as (problem, item): records (sample_id, group_id, label), splits (sample_id, split),
    counts (split, n0, n1) as the manifest states them."""
    said = lambda p, c: (F.lit(p).alias("problem"), F.col(c).cast("string").alias("item"))
    placed = records.join(splits, "sample_id")
    true = class_counts(placed).join(counts.select("split", F.col("n0").alias("s0"), F.col("n1").alias("s1")), "split", "full")
    found = [
        records.join(splits, "sample_id", "left_anti").select(*said("in no split", "sample_id")),
        splits.join(records, "sample_id", "left_anti").select(*said("unknown record", "sample_id")),
        splits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*said("in several splits", "sample_id")),
        placed.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(*said("group in several splits", "group_id")),
        true.where(~(F.col("n0").eqNullSafe(F.col("s0")) & F.col("n1").eqNullSafe(F.col("s1")))).select(*said("class counts differ", "split")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def recomputed(stored: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Stored accuracies that the predictions do not give."""
    return stored.join(confusion(rows, by=by).select(*by, F.col("accuracy").alias("true_accuracy")), by, "left").where(~F.col("accuracy").eqNullSafe(F.col("true_accuracy")))


def gate(scores: DataFrame, by: list[str], least: float = 0.6, seeds: int = 2) -> DataFrame:
    """Whether a model passes: its mean balanced accuracy is ``least`` or more, and at least ``seeds`` of its runs do not
    predict one class only. Rows: by, tp, tn, fp, fn, balanced_accuracy."""
    collapsed = ((F.col("tp") + F.col("fp")) == 0) | ((F.col("tn") + F.col("fn")) == 0)
    out = scores.groupBy(*by).agg(F.avg("balanced_accuracy").alias("mean"), F.count_if(~collapsed).alias("sound"))
    return out.withColumn("passed", (F.col("mean") >= least) & (F.col("sound") >= seeds))


def quality_gate(findings: DataFrame, by: list[str], rank: Column, least: int) -> DataFrame:
    """Whether some finding of each ``by`` has at least the severity rank ``least``."""
    return findings.groupBy(*by).agg(F.bool_or(rank >= least).alias("fails"))


def scored_findings(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions at or above the threshold as findings, on the first ranked line, else where the function starts."""
    return rows.where(F.col("probability") >= threshold).withColumn("line", F.coalesce(F.get("ranked", 0), F.col("start_line")))


def ranked_lines(scores: Column) -> Column:
    """Lines of (line, score) entries by falling score, of equals the least line."""
    order = F.sort_array(F.transform(scores, lambda x: F.struct((-x["score"]).alias("s"), x["line"].alias("line"))))
    return F.transform(order, lambda x: x["line"])


#: Label sources that are no independent truth.
WEAK_LABELS = ("unlabeled", "rule", "clang-ast")


def record_rules() -> dict[str, Column]:
    """What holds for a sound training record (see ``dataset.violations``): each a condition that is true for it."""
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    lines, types, nodes = F.coalesce("defect_lines", F.array().cast("array<bigint>")), F.col("edge_type"), F.col("layers")
    inside = lambda a: F.forall(a, lambda i: (i >= 0) & (i < F.size(nodes)))
    ends = lambda i: F.concat_ws("-", F.get(nodes, F.get("edge_from", i).cast("int")), F.get(nodes, F.get("edge_to", i).cast("int")))
    layered = lambda t, i: ends(i) == F.when(t == 1, "cfg-cfg").when(t == 2, "cfg-ast").otherwise("ast-ast")
    return {
        "sample_id": named("sample_id"), "group_id": named("group_id"), "label_source": named("label_source") & ~F.lower(F.trim("label_source")).isin(*WEAK_LABELS),
        "label": F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "lines": F.coalesce((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")), F.lit(False)),
        "source_hash": F.col("source_sha256").eqNullSafe(F.sha2("source", 256)),
        "defect_lines": F.forall(lines, lambda x: x.between(F.col("start_line"), F.col("end_line"))) & (F.size(F.array_distinct(lines)) == F.size(lines)) & ((F.col("label") != 0) | (F.size(lines) == 0)),
        "edges": (F.size("edge_from") == F.size(types)) & (F.size("edge_to") == F.size(types)) & inside(F.col("edge_from")) & inside(F.col("edge_to")),
        "edge_types": F.forall(types, lambda t: t.between(0, 3)), "nodes": F.array_contains(nodes, "ast") & F.forall(nodes, lambda x: x.isin("ast", "cfg")),
        "edge_layers": F.forall(F.transform(types, layered), lambda x: F.coalesce(x, F.lit(False))),
    }


#: Fixed value: the names of edge types 0 to 3.
EDGE_NAMES = ("ast-child", "cfg-successor", "cfg-contains", "def-use")
_NODE = "array<struct<kind:string,layer:string,line:bigint,end_line:bigint,column:bigint,node_id:string>>"
_EDGE = "array<struct<source:string,target:string,kind:string>>"


def graph_rules() -> dict[str, Column]:
    """What holds for a sound program graph and its provenance beyond ``record_rules``. Columns: schema_version, nodes (kind,
    layer, line, end_line, column, node_id), edges (source, target, kind), edge_from, edge_to, edge_type, sample_id,
    group_id, source, source_groups, split_group, duplicate_ids, canonical_sha256; but for nodes, source and the two ids,
    null means that a record does not have it."""
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    absent = lambda c: F.col(c).isNull()
    nodes, edges, types = F.col("nodes").cast(_NODE), F.col("edges").cast(_EDGE), F.col("edge_type")
    ids = F.filter(F.transform(nodes, lambda n: n["node_id"]), lambda x: x.isNotNull())
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    placed = lambda n: (n["line"] >= 0) & (n["line"] <= n["end_line"])
    end = lambda c, i: F.get(nodes, F.get(F.col(c), i).cast("int"))["node_id"]
    kind = lambda i: F.get(F.array(*[F.lit(x) for x in EDGE_NAMES]), F.get(types, i).cast("int"))
    agree = F.transform(edges, lambda e, i: (e["source"] == end("edge_from", i)) & (e["target"] == end("edge_to", i)) & (e["kind"] == kind(i)))
    groups, copies = F.col("source_groups").cast("array<string>"), F.col("duplicate_ids").cast("array<string>")
    n_copies = F.coalesce(F.size(copies), F.lit(0))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "schema_version": absent("schema_version") | (F.col("schema_version") == "1.0"),
        "node_fields": sure(F.size(nodes) > 0) & F.forall(nodes, lambda n: named(n["kind"]) & sure(n["layer"].isin("ast", "cfg")) & sure(placed(n)) & (n["column"].isNull() | (n["column"] >= 0))),
        "node_ids": F.forall(ids, named) & unique(ids),
        "explicit_edges": absent("edges") | sure((F.size(edges) == F.size(types)) & (F.size(ids) == F.size(nodes)) & F.forall(agree, sure)),
        "source_groups": absent("source_groups") | sure((F.size(groups) > 0) & F.forall(groups, named) & F.array_contains(groups, F.col("group_id"))),
        "split_group": absent("split_group") | named(F.col("split_group")),
        "duplicate_ids": absent("duplicate_ids") | sure(F.forall(copies, named) & unique(copies) & ~F.array_contains(copies, F.col("sample_id"))),
        "copies_agree": F.when(absent("source_groups"), n_copies <= 0).otherwise(F.size(groups) == F.greatest(n_copies, F.lit(0)) + 1),
        "canonical_hash": absent("canonical_sha256") | (F.col("canonical_sha256") == canonical_hash(F.col("source"))),
    }


def dataset_problems(records: DataFrame, splits: DataFrame, groups: DataFrame, counts: DataFrame, train: float, validation: float, duplicates: int) -> DataFrame:
    """What a prepared data set gets wrong against its manifest, as (problem, item): all of ``manifest_problems``, and sources
    that are there twice, in several splits or with several labels (by canonical hash), copies that are records too, are
    named twice or are not as many as the manifest says (``duplicates``), tied groups (source_groups) in several splits or
    not as the manifest's groups say, a training split without both classes, and groups that do not follow the fractions.

    records: sample_id, group_id, label, source, source_groups, duplicate_ids (arrays or null); splits: sample_id, split;
    groups: group (the least of its tied groups), split; counts: split, n0, n1. The driver sees numbers of splits only."""
    said = lambda p, c: (F.lit(p).alias("problem"), F.col(c).cast("string").alias("item"))
    placed = records.withColumn("key", canonical_hash(F.col("source"))).join(splits, "sample_id")
    same = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s"), F.count_distinct("label").alias("l"))
    copies = records.select("sample_id", F.explode("duplicate_ids").alias("copy"))
    tied = records.select(F.col("group_id").alias("source"), F.explode(F.array_union(F.array("group_id"), F.coalesce("source_groups", F.array().cast("array<string>")))).alias("target"))
    roots = components(tied)
    owned = materialize(placed.join(roots, F.col("group_id") == F.col("node")).select("root", "split").distinct(), "owned")
    stated = groups.select(F.col("group").alias("root"), F.col("split").alias("stated"))
    n, n_copies = owned.select("root").distinct().count(), copies.count()
    want = dict(zip(("train", "validation"), partition_sizes(n, train, validation), strict=True)) if n >= 3 else {}
    have = {r.split: r["count"] for r in owned.groupBy("split").count().collect()}  # a row a split
    spark = records.sparkSession
    facts = [("groups of a split", f"{s}: {have.get(s, 0)}, not {k}") for s, k in want.items() if have.get(s, 0) != k] + [("too few groups", str(n))] * (n < 3) + [("duplicate count", f"{n_copies}, not {duplicates}")] * (n_copies != duplicates)
    train_rows = placed.where("split = 'train'").groupBy().agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    found = [
        manifest_problems(records.select("sample_id", "group_id", "label"), splits, counts),
        same.where("n > 1").select(*said("source twice", "key")), same.where("s > 1").select(*said("source in several splits", "key")), same.where("l > 1").select(*said("labels of a source differ", "key")),
        copies.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*said("copy named twice", "copy")),
        copies.join(records.select(F.col("sample_id").alias("copy")), "copy", "left_semi").select(*said("copy is a record", "copy")),
        owned.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*said("tied groups in several splits", "root")),
        owned.join(stated, "root", "full").where(~F.col("split").eqNullSafe(F.col("stated"))).select(*said("groups differ", "root")),
        train_rows.where("a = 0 or b = 0").select(F.lit("training lacks a class").alias("problem"), F.lit("train").alias("item")),
        spark.createDataFrame(facts, "problem string, item string"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
