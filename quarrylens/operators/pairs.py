"""Labelled function pairs from paired test programs: extraction with a reason for each rejection, and a seeded selection
that takes the classes in turn."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.lexical import masked
from quarrylens.functions.renaming import ANSWER, neutral_names, template_hash, without_comments
from quarrylens.functions.text import split_lines
from quarrylens.operators.dataset import canonical_hash
from quarrylens.operators.evaluation import group_links
from quarrylens.operators.graph import components
from quarrylens.operators.order import positions, positions_within
from quarrylens.sources.shared import materialize
from quarrylens.sources.sinks import write_with_manifest

#: The classes and flow variants that are taken, how a candidate's file and its functions look, and why a
#: candidate is rejected (the first that holds, in this order).
CLASSES = (121, 122, 124, 126, 127, 369, 401, 415, 416, 457, 476)
FLOWS = (1, 2, 3, 4, 5, 6, 7, 15, 16, 17, 18)
CANDIDATE = r"(?:^|/)CWE(\d+)_[^/]*_(\d\d)\.c$"
VOID_FUNCTION = r"(?m)^[ \t]*(?:static\s+)?void\s+(?P<name>[A-Za-z_]\w*)\s*\(\s*(?:void)?\s*\)\s*\{"
GOOD = r"^good(?:G2B|B2G)?\d*$"
CONDITIONAL = r"(?m)^\s*#\s*(if|ifdef|ifndef|else|elif|endif)\b"
PREAMBLE = r"(?ms)\A(.*?)^\s*#\s*ifndef\s+OMITBAD\b"
CUSTOM_INCLUDE = r'(?m)^\s*#\s*include\s*"(?!std_testcase(?:_io)?\.h")'
REASONS = {
    "flow": "missing or unsupported local-flow metadata",
    "family": "missing or unsupported label-definition metadata",
    "spliced": "line-spliced source outside initial profile",
    "open": "unbalanced function body",
    "bad": "missing unique self-contained bad function",
    "good": "no self-contained good leaf function",
    "preamble": "unsupported testcase preamble",
    "conditional": "conditional or function-bearing preamble outside profile",
    "answer": "answer-bearing tokens remain in isolated source",
    "include": "custom quoted include outside profile",
    "directive": "preprocessor inside selected function outside profile",
    "same": "identical positive/negative function source",
}

_HEAD, _BRACE = re.compile(VOID_FUNCTION), re.compile(r"[{}]")
_VOIDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "brace", "stop")]]))


def _voids(code: str | None) -> list[tuple]:
    """name, start, open brace and end of each function without parameters; -1 where its braces never close."""
    if code is None:
        return []
    closes, open_at = {}, []
    for b in _BRACE.finditer(code):
        if b[0] == "{":
            open_at.append(b.start())
        elif open_at:
            closes[open_at.pop()] = b.end()
    return [(m["name"], m.start(), m.end() - 1, closes.get(m.end() - 1, -1)) for m in _HEAD.finditer(code)]


@F.pandas_udf(_VOIDS)
def void_functions(code: pd.Series) -> pd.Series:
    return code.map(lambda c: _voids(c if isinstance(c, str) else None))


def _slice(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def _kept_lines(text: Column, first: Column) -> Column:
    """(line, number) of the lines of ``text`` that are not blank, without white space at their ends."""
    bare = F.transform(split_lines(text), lambda x, i: F.struct(F.regexp_replace(x, r"(?U)\s+$", "").alias("text"), (first + i).cast("int").alias("number")))
    return F.filter(bare, lambda x: x["text"] != "")


def candidates(files: DataFrame, classes: tuple[int, ...] = CLASSES, flows: tuple[int, ...] = FLOWS) -> DataFrame:
    """``files`` (source_file, text) that are test programs of the classes and flows, with cwe and flow."""
    number = lambda g: F.regexp_extract("source_file", CANDIDATE, g).try_cast("int")
    found = files.withColumns({"cwe": number(1), "flow": number(2)})
    return found.where(F.col("cwe").isin(*classes) & F.col("flow").isin(*flows))


def _staged(cases: DataFrame, seed: int, flows: tuple[int, ...]) -> DataFrame:
    """``cases`` with their functions and all that is decided before a pair is cut out: ``reason`` (null if none)."""
    flow, family = F.regexp_extract("source_file", r"_(\d\d)\.c$", 1), F.regexp_extract("text", r"Label Definition File:\s*([^\r\n]+)\.label\.xml", 1)
    stem = F.regexp_extract("source_file", r"([^/]+)\.c$", 1)
    clean = cases.select("source_file", "cwe", F.coalesce("text", F.lit("")).alias("text")).withColumns({"family": family, "clean": without_comments("text"), "stem": stem, "flow": flow})
    clean = materialize(clean.withColumn("code", masked(F.coalesce("clean", F.lit("")))).withColumn("fns", void_functions("code")), "pairs")
    calls = lambda f: F.regexp_extract_all(_slice(F.col("code"), f["brace"], f["stop"]), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    names = F.transform("fns", lambda f: f["name"])
    leaves = F.filter("fns", lambda f: (f["stop"] >= 0) & ~F.arrays_overlap(calls(f), names))
    bads = F.filter("fns", lambda f: f["name"] == F.concat("stem", F.lit("_bad")))
    out = clean.withColumn("leaves", leaves).withColumn("bad", F.when(F.size(bads) == 1, F.get(F.filter("leaves", lambda f: f["name"] == F.concat("stem", F.lit("_bad"))), 0)))
    ranked = F.transform(F.filter("leaves", lambda f: f["name"].rlike(GOOD)), lambda f: F.struct(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), "source_file", f["name"]), 256).alias("h"), f["start"].alias("at"), f.alias("f")))
    head = F.substring("clean", F.lit(1), F.array_min(F.transform("fns", lambda f: f["start"])))
    out = out.withColumn("good", F.array_min(ranked)["f"]).withColumn("head", head)
    out = out.withColumn("prefix", F.when(F.col("head").rlike(PREAMBLE), F.regexp_extract("head", PREAMBLE, 1)))
    braced = F.contains(F.substring("code", F.lit(1), F.length("prefix")), F.lit("{"))
    known = F.coalesce(F.col("flow").try_cast("int").isin(*flows) & F.rlike(F.col("text"), F.concat(F.lit(r"Flow Variant:\s*"), "flow", F.lit(r"\b"))), F.lit(False))
    failed = {
        "flow": ~known, "family": ~F.col("family").rlike(r"^[A-Za-z0-9_.-]+$"), "spliced": F.col("clean").isNull(), "open": F.exists("fns", lambda f: f["stop"] < 0), "bad": F.col("bad").isNull(), "good": F.col("good").isNull(),
        "preamble": F.col("prefix").isNull(), "conditional": F.col("prefix").rlike(CONDITIONAL) | braced,
    }
    return out.withColumn("reason", F.coalesce(*[F.when(c, F.lit(REASONS[k])) for k, c in failed.items()]))


def extract_pairs(cases: DataFrame, seed: int = 42, flows: tuple[int, ...] = FLOWS) -> DataFrame:
    """A row per case (source_file, cwe, text) with ``reason`` (why it gives no pair, else null), ``family`` and ``pair``:
    the bad function and, of the good ones that call no function of the file, the first by a seeded hash, each with label,
    original_function, code (preamble and function under a neutral name, without comments and blank lines), names
    (renamed locals), original_line, line_map, function_source, canonical_sha256 and template_sha256.

    Null or empty text is a case without metadata. Repeated cases are judged one by one. A source_file that is no test
    program has no flow. Work stays within a row; nothing is shuffled.
    """
    staged = _staged(cases, seed, flows).withColumn("_row", F.monotonically_increasing_id())
    sound = staged.where("reason is null").select("_row", "text", "clean", "prefix", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("bad").alias("f")), F.struct(F.lit(0).alias("label"), F.col("good").alias("f")))).alias("x"))
    name, start = F.col("x.f.name"), F.col("x.f.start")
    signature = F.concat(F.lit(r"^(?:static\s+)?void\s+"), name, F.lit(r"\s*\(\s*(?:void)?\s*\)"))
    own = F.regexp_replace(_slice(F.col("clean"), start, F.col("x.f.stop")), r"^\s+", "")
    cut = sound.select("_row", "prefix", F.col("x.label").alias("label"), name.alias("original_function"), F.regexp_replace(own, signature, F.lit("void process(void)")).alias("own"), (F.regexp_count(F.substring("text", F.lit(1), start), F.lit("\n")) + 1).alias("original_line"))
    cut = cut.withColumn("n", neutral_names("own"))
    before, body = _kept_lines(F.col("prefix"), F.lit(1)), _kept_lines(F.col("n.code"), F.col("original_line"))
    lines = cut.withColumn("body", body).withColumn("all", F.concat(before, F.col("body")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    made = lines.withColumn("code", F.concat(joined("all"), F.lit("\n"))).withColumn("function_source", joined("body"))
    failed = {"answer": F.col("code").rlike(f"(?iu){ANSWER}"), "include": F.col("code").rlike(CUSTOM_INCLUDE), "directive": F.col("function_source").rlike(r"(?m)^\s*#")}
    made = made.select(
        "_row", F.coalesce("n.problem", *[F.when(c, F.lit(REASONS[k])) for k, c in failed.items()]).alias("problem"),
        F.struct((1 - F.col("label")).alias("at"), "label", "original_function", "code", F.col("n.names").alias("names"), "original_line", F.transform("all", lambda x: x["number"]).alias("line_map"), "function_source", canonical_hash(F.col("function_source")).alias("canonical_sha256"), template_hash("function_source").alias("template_sha256")).alias("p"),
    )
    pairs = made.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("p.at", "problem"))).alias("problems"), F.collect_list("p").alias("pair"))  # two rows each
    first = F.filter(F.transform("problems", lambda x: x["problem"]), lambda x: x.isNotNull())
    ordered = F.transform(F.array(F.lit(1), F.lit(0)), lambda k: F.get(F.filter("pair", lambda p: p["label"] == k), 0))
    same = F.size(F.array_distinct(F.transform("pair", lambda p: p["canonical_sha256"]))) == 1
    pairs = pairs.select("_row", F.coalesce(F.get(first, 0), F.when(same, F.lit(REASONS["same"]))).alias("late"), ordered.alias("pair"))
    return materialize(staged.select("source_file", "cwe", "family", "reason", "_row"), "staged").join(pairs, "_row", "left").select(
        "source_file", "cwe", "family", F.coalesce("reason", "late").alias("reason"), F.when(F.coalesce("reason", "late").isNull(), F.col("pair")).alias("pair")
    )


def taken_in_turn(cases: DataFrame, by: str, item: str, seed: int = 42) -> DataFrame:
    """``cases`` with ``turn`` (its place within its ``by``, by a seeded hash of ``item``) and ``place`` (in the one order that
    takes a case of each ``by`` in turn). Exact at any size of a class: ranges and prefix sums, no window over a class."""
    keyed = cases.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col(item).cast("string")), 256))
    turned = positions_within(keyed, [by], [F.col("_h"), F.col(item)], "turn")
    return positions(turned, [F.col("turn"), F.col(by), F.col(item)], "place").drop("_h")


def select_cases(extracted: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """source_file, cwe, turn, place, reason and status: cases are looked at in turn until ``most`` of them gave a pair;
    ``selected``, ``rejected`` (with its reason) or ``unexamined``."""
    if most < 1:
        raise ValueError("at least one case must be asked for")
    placed = materialize(taken_in_turn(extracted.select("source_file", "cwe", "reason"), "cwe", "source_file", seed), "turns")
    sound = positions(placed.where("reason is null").select("place"), [F.col("place")], "rank")
    last = sound.where(F.col("rank") == most - 1).select("place").first()  # one row at most
    examined = F.lit(True) if last is None else F.col("place") <= last[0]
    status = F.when(~examined, F.lit("unexamined")).when(F.col("reason").isNull(), F.lit("selected")).otherwise(F.lit("rejected"))
    return placed.withColumn("status", status)


def pair_groups(extracted: DataFrame) -> DataFrame:
    """family and group: families tied by a function with the same canonical or template hash get the least family's name,
    so that a split by group keeps clones together."""
    functions = extracted.where("reason is null").select("family", F.explode("pair").alias("p"))
    keys = functions.select(F.col("family").alias("group_id"), F.explode(F.array(F.concat(F.lit("exact:"), "p.canonical_sha256"), F.concat(F.lit("clone:"), "p.template_sha256"))).alias("key"))
    found = components(group_links(keys, F.col("key")))
    return functions.select("family").distinct().join(found.select(F.col("node").alias("family"), F.col("root").alias("_c")), "family", "left").select("family", F.coalesce("_c", "family").alias("group"))


def pair_tables(extracted: DataFrame, selection: DataFrame) -> dict[str, DataFrame]:
    """What a corpus of the selected cases holds: ``functions`` (file, code), ``labels`` (sample_id, file, function, label,
    group_id, family, source_file, cwe) and ``provenance`` (sample_id, source_file, original_function, its line, line_map,
    renamed names and hashes)."""
    chosen = extracted.join(selection.where("status = 'selected'").select("source_file"), "source_file", "left_semi")
    rows = chosen.join(pair_groups(chosen), "family").select("source_file", "cwe", "family", "group", F.explode("pair").alias("p")).select("*", "p.*")
    own = F.sha2(F.concat_ws(":", "source_file", "original_function"), 256)
    rows = rows.withColumn("sample_id", own).withColumn("file", F.concat(F.lit("functions/"), F.substring(own, 1, 24), F.lit(".c")))
    return {
        "functions": rows.select("file", "code"),
        "labels": rows.select("sample_id", "file", F.lit("process").alias("function"), "label", F.concat(F.lit("family-"), F.substring(F.sha2("group", 256), 1, 24)).alias("group_id"), "family", "source_file", "cwe"),
        "provenance": rows.select("sample_id", "source_file", "original_function", "original_line", "line_map", "names", "canonical_sha256", "template_sha256", F.sha2("code", 256).alias("code_sha256")),
    }


def write_pairs(extracted: DataFrame, selection: DataFrame, folder: str, facts: dict | None = None) -> dict:
    """The selected cases as a corpus with its manifest, whose facts count the cases by status; the rejected ones, with
    their reasons, are a table of their own."""
    counts = {r.status: r["count"] for r in selection.groupBy("status").count().collect()}  # three rows at most
    tables = {**pair_tables(extracted, selection), "rejected": selection.where("status = 'rejected'").select("source_file", "cwe", "reason")}
    return write_with_manifest(tables, folder, {"cases": counts, **(facts or {})})
