"""Lexical analysis of C-family sources: masking, functions, metrics and pattern rules as DataFrames.

Two small row functions need offsets into characters (masking, finding functions); everything else is relational:
lines, declarations, uses and releases are rows, and rules are joins of them.
"""

from __future__ import annotations

import bisect
import functools
import operator
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.text import include_targets, normal_line, split_lines
from quarrylens.sources.shared import materialize

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)", re.S)
_VISIBLE = re.compile(r"[^\n]")
#: How a function's head and a branch look.
FUNCTION_HEAD = r"(?:^|\n)\s*(?P<return>[A-Za-z_][\w:<>,\s*&]*?(?:[*&]|\s))(?P<name>[A-Za-z_]\w*(?:::\w+)*)\s*\((?P<params>[^;{}]*)\)\s*(?:const\s*)?(?:noexcept\s*)?\{"
BRANCH = r"\b(?:if|for|while|case|catch)\b|&&|\|\|"
_HEAD, _BRANCH, _BRACE, _NEWLINE = re.compile(FUNCTION_HEAD, re.M), re.compile(BRANCH), re.compile(r"[{}]"), re.compile("\n")

_FUNCTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "complexity", "parameters", "begin", "end")]]))
IDENTIFIER = r"[A-Za-z_]\w*"

#: What the rules look for. Group 1 is the name where there is one, group 2 a size or an index.
DANGEROUS_CALL = r"\b(gets|strcpy|strcat|sprintf)\s*\("
ARRAY_DECLARED = rf"\b(?:char|short|int|long|float|double|bool|unsigned|signed)(?:\s+\w+)*\s+({IDENTIFIER})\s*\[\s*(\d+)\s*\]"
ARRAY_USED = rf"\b({IDENTIFIER})\s*\[\s*(\d+)\s*\]"
ALLOCATED = rf"\b({IDENTIFIER})\s*=\s*(?:new\b|(?:malloc|calloc|realloc)\s*\()"
DELETED = rf"\bdelete\s*(?:\[\s*\])?\s*({IDENTIFIER})\b"
FREED = rf"\bfree\s*\(\s*({IDENTIFIER})\s*\)"
CONDITION_ASSIGNED = r"\b(?:if|while)\s*\([^)]*(?<![=!<>])=(?!=)[^)]*\)"
NULL_DECLARED = rf"\b[A-Za-z_][\w:<>,\s]*\*+\s*({IDENTIFIER})\s*=\s*(?:nullptr|NULL)\s*;"
ARROW_USED = rf"\b({IDENTIFIER})\s*->"
STAR_USED = rf"(?<![\w*])\*\s*({IDENTIFIER})\b"
POINTER_ASSIGNED = rf"(?<![*&.\w])\b({IDENTIFIER})\s*=\s*(?!(?:nullptr|NULL)\b)"
SCALAR_DECLARED = rf"^\s*(?:(?:unsigned|signed|long|short)\s+)*(?:bool|char|wchar_t|short|int|long|float|double|size_t)\s+({IDENTIFIER})\s*;\s*$"
NAME_USED = rf"\b({IDENTIFIER})\b"
NAME_STORED = (rf"\b({IDENTIFIER})\s*=(?!=)", rf">>\s*({IDENTIFIER})\b", rf"&\s*({IDENTIFIER})\b")
FILE_OPENED = rf"\bFILE\s*\*\s*({IDENTIFIER})\s*=\s*fopen\s*\("
FILE_CLOSED = rf"\bfclose\s*\(\s*({IDENTIFIER})\s*\)"


def mask_text(text: str) -> str:
    """Comments and literals as spaces; length and newlines stay."""
    return _HIDDEN.sub(lambda m: _VISIBLE.sub(" ", m[0]), text)


@F.pandas_udf(T.StringType())
def masked(text: pd.Series) -> pd.Series:
    return text.fillna("").map(mask_text)


def _functions(code: str) -> list[dict]:
    """name, start_line, end_line, complexity (1 and the branches), parameters, and where the body begins and ends, of each
    function head; one whose braces never close reaches to the end of the text. Braces, branches and lines are found in
    one pass each and looked up."""
    heads = list(_HEAD.finditer(code)) if "{" in code else []
    if not heads:
        return []
    closes, open_at = {}, []
    for brace in _BRACE.finditer(code):
        if brace[0] == "{":
            open_at.append(brace.start())
        elif open_at:
            closes[open_at.pop()] = brace.start()
    branches, newlines = ([m.start() for m in p.finditer(code)] for p in (_BRANCH, _NEWLINE))
    out = []
    for m in heads:
        begin, close = m.end() - 1, closes.get(m.end() - 1, len(code))
        own = m["params"].strip()
        out.append({
            "name": m["name"], "start_line": bisect.bisect_left(newlines, m.start()) + 1, "end_line": bisect.bisect_left(newlines, close) + 1,
            "complexity": 1 + bisect.bisect_left(branches, close) - bisect.bisect_left(branches, begin), "parameters": 0 if own in ("", "void") else own.count(",") + 1,
            "begin": begin, "end": min(close + 1, len(code)),
        })
    return out


def prepare(files: DataFrame) -> DataFrame:
    """``files`` (file, text) with masked ``code`` and its ``functions``: one pass over few texts at a time, so that a task's
    memory does not depend on how many come in a batch."""
    kind = pa.list_(pa.struct([("name", pa.string()), *[(c, pa.int32()) for c in ("start_line", "end_line", "complexity", "parameters", "begin", "end")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                code = [mask_text(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(code, pa.string()), pa.array([_functions(c) for c in code], kind)], names=[*part.schema.names, "code", "functions"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("code", T.StringType()), T.StructField("functions", _FUNCTIONS)]))


#: What a declaration looks like, and which pattern, groups (name, then size or index) and declaration each kind
#: of mark has. Marks that only count where their name is declared are kept for the names that the file declares.
_DECLARED = {"array": ARRAY_DECLARED, "memory": ALLOCATED, "null": NULL_DECLARED, "scalar": SCALAR_DECLARED, "file": FILE_OPENED}
_MARKS = {
    "call": (DANGEROUS_CALL, (1,), None), "condition": (CONDITION_ASSIGNED, (0,), None), "array": (ARRAY_DECLARED, (1, 2), "array"), "index": (ARRAY_USED, (1, 2), "array"),
    "memory": (ALLOCATED, (1,), "memory"), "delete": (DELETED, (1,), "memory"), "free": (FREED, (1,), "memory"), "null": (NULL_DECLARED, (1,), "null"), "arrow": (ARROW_USED, (1,), "null"), "star": (STAR_USED, (1,), "null"),
    "assigned": (POINTER_ASSIGNED, (1,), "null"), "scalar": (SCALAR_DECLARED, (1,), "scalar"), "used": (NAME_USED, (1,), "scalar"), **{f"stored{i}": (x, (1,), "scalar") for i, x in enumerate(NAME_STORED)},
    "file": (FILE_OPENED, (1,), "file"), "close": (FILE_CLOSED, (1,), "file"),
}
#: Text that every match of a kind holds, one of these; most lines and files are told by it without a pattern.
_NEEDLES = {"call": ("(",), "condition": ("=",), "array": ("[",), "memory": ("new", "alloc"), "null": ("nullptr", "NULL"), "scalar": (";",), "file": ("fopen",)}
_MARK = "struct<kind:string,name:string,value:string,column:int>"


def _may_hold(text: Column, kind: str) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(n)) for n in _NEEDLES[kind]])


def _marks_of(code: Column, kind: str, names: dict[str, Column]) -> Column:
    """The marks of one kind on a line. ``column`` is where the match starts, from 1: the pieces between matches give the
    places, in one walk over them."""
    pattern, groups, of = _MARKS[kind]
    found = [F.regexp_extract_all(code, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    zipped = F.arrays_zip(*[x.alias(n) for x, n in zip((*found, F.split(code, pattern, -1)), ("m", *("name", "value")[: len(groups)], "gap"), strict=True)])
    none = F.array().cast(f"array<{_MARK}>")

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        keep = x["m"].isNotNull() if of is None else x["m"].isNotNull() & F.array_contains(names[of], x["name"])  # the last piece follows no match
        mark = F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), (x["value"] if len(groups) > 1 else F.lit(None).cast("string")).alias("value"), (at + 1).alias("column"))
        return F.struct((at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(keep, F.concat(s["out"], F.array(mark))).otherwise(s["out"]).alias("out"))

    walk = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    wanted = _may_hold(code, kind) & code.rlike(pattern) if of is None else (F.size(names[of]) > 0) & code.rlike(pattern)
    return F.when(wanted, walk).otherwise(none)


def marked_lines(files: DataFrame, kinds: tuple[str, ...] = tuple(_MARKS)) -> DataFrame:
    """A row per line of ``files`` (file, text) that holds a mark: id, file, line (from 1), original, end of its scope (the
    first function that holds it, else the file) and marks (kind, name, value, column). Written, so that the files are read
    and matched once for all rules; names that no declaration of their file needs are no marks."""
    of = {_MARKS[k][2] for k in kinds} - {None}
    held = functools.reduce(operator.or_, [_may_hold(F.col("code"), k) for k in sorted({_MARKS[k][2] or k for k in kinds})])
    df = prepare(files.select("file", "text")).where(held)
    df = df.withColumn("l", split_lines(F.col("text"))).withColumn("c", split_lines(F.col("code"))).withColumns({f"_may_{d}": _may_hold(F.col("code"), d) for d in sorted(of)})

    def declared(d: str) -> Column:
        here = F.filter("c", lambda x: _may_hold(x, d))
        return F.when(F.col(f"_may_{d}"), F.array_distinct(F.flatten(F.transform(here, lambda x: F.regexp_extract_all(x, F.lit(_DECLARED[d]), F.lit(1)))))).otherwise(F.array().cast("array<string>"))

    df = df.select("file", "functions", "l", "c", *[declared(d).alias(f"_{d}") for d in sorted(of)])
    names = {d: F.col(f"_{d}") for d in of}
    pairs = F.arrays_zip(F.col("l").alias("original"), F.col("c").alias("code"))

    def line_of(x: Column, i: Column) -> Column:
        code = F.coalesce(x["code"], F.lit(""))
        return F.struct((i + 1).alias("line"), x["original"].alias("original"), F.concat(*[_marks_of(code, k, names) for k in kinds]).alias("marks"))

    def scoped(x: Column) -> Column:
        holding = F.filter("functions", lambda f: (f["start_line"] <= x["line"]) & (x["line"] <= f["end_line"]))
        return F.struct(x["line"].alias("line"), x["original"].alias("original"), x["marks"].alias("marks"), F.coalesce(F.get(holding, 0)["end_line"], F.size("c")).alias("scope_end"))

    found = F.filter(F.transform(pairs, line_of), lambda x: F.size(x["marks"]) > 0)
    rows = df.select("file", F.explode(F.transform(found, scoped)).alias("x")).select("file", "x.*")
    return materialize(rows.withColumn("id", F.monotonically_increasing_id()), "marked")


def _of(marks: DataFrame, *kinds: str) -> DataFrame:
    return marks.where(F.col("kind").isin(*kinds))


def _finding(rows: DataFrame, rule: str, severity: str, confidence: float = 1.0) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "column", F.lit(confidence).alias("confidence"), "id")


def dangerous_calls(marks: DataFrame) -> DataFrame:
    return _finding(_of(marks, "call"), "DG001", "high")


def literal_bounds(marks: DataFrame) -> DataFrame:
    """Literal indexes at or above the size in the last declaration of the name, not on that declaration's line."""
    declared = _of(marks, "array").groupBy("file", "name").agg(F.max_by(F.struct(F.col("value").alias("size"), "line"), F.struct("line", "column")).alias("d"))
    used = _of(marks, "index").join(declared, ["file", "name"])
    number = lambda c: F.col(c).cast("decimal(38,0)")
    return _finding(used.where((F.col("line") != F.col("d.line")) & (number("value") >= number("d.size"))), "DG002", "critical")


def _unreleased(opened: DataFrame, released: DataFrame) -> DataFrame:
    """Rows of ``opened`` (file, name, line, scope_end) with no release of the name from their line to the scope's end:
    a range anti join, keyed by file and name."""
    o, r = opened.alias("o"), released.select("file", "name", F.col("line").alias("at")).distinct().alias("r")
    return o.join(r, (F.col("o.file") == F.col("r.file")) & (F.col("o.name") == F.col("r.name")) & F.col("r.at").between(F.col("o.line"), F.col("o.scope_end")), "left_anti")


def unreleased_memory(marks: DataFrame) -> DataFrame:
    return _finding(_unreleased(_of(marks, "memory"), _of(marks, "delete", "free")), "DG003", "medium", 0.55)


def condition_assignments(marks: DataFrame) -> DataFrame:
    found = _of(marks, "condition").groupBy("file", "line").agg(F.min("column").alias("column"), F.min("id").alias("id"))
    return _finding(found, "DG004", "medium", 0.8)


def _first_use(declared: DataFrame, uses: DataFrame, kills: DataFrame) -> DataFrame:
    """The first use of each declaration's name after its line and within ``last``, unless a kill stands on an earlier
    or the same line."""
    d = declared.select("file", "name", F.col("line").alias("d_line"), F.col("column").alias("d_column"), "last")
    events = uses.select("file", "name", "line", "column", "id", F.lit(1).alias("kind")).unionByName(kills.select("file", "name", "line", "column", "id", F.lit(0).alias("kind")))
    later = d.join(events, ["file", "name"]).where((F.col("line") > F.col("d_line")) & (F.col("line") <= F.col("last")))
    first = later.groupBy("file", "name", "d_line", "d_column").agg(F.min(F.struct("line", "kind", "column", "id")).alias("f"))
    return first.where("f.kind = 1").select("file", "f.line", "f.column", "f.id")


def null_dereferences(marks: DataFrame) -> DataFrame:
    declared = _of(marks, "null").withColumn("last", F.col("scope_end"))
    return _finding(_first_use(declared, _of(marks, "arrow", "star"), _of(marks, "assigned")), "DG005", "critical", 0.9)


def uninitialised(marks: DataFrame) -> DataFrame:
    declared = _of(marks, "scalar").withColumn("last", F.least("scope_end", F.col("line") + 80))
    return _finding(_first_use(declared, _of(marks, "used"), _of(marks, *[f"stored{i}" for i in range(len(NAME_STORED))])), "DG006", "high", 0.75)


def unclosed_files(marks: DataFrame) -> DataFrame:
    return _finding(_unreleased(_of(marks, "file"), _of(marks, "close")), "DG007", "high", 0.8)


#: rule id and function; rule id and severity; the kinds of marks that a rule looks at
RULES = {"DG001": dangerous_calls, "DG002": literal_bounds, "DG003": unreleased_memory, "DG004": condition_assignments, "DG005": null_dereferences, "DG006": uninitialised, "DG007": unclosed_files}
RULE_SEVERITY = {"DG001": "high", "DG002": "critical", "DG003": "medium", "DG004": "medium", "DG005": "critical", "DG006": "high", "DG007": "high"}
_RULE_MARKS = {"DG001": ("call",), "DG002": ("array", "index"), "DG003": ("memory", "delete", "free"), "DG004": ("condition",), "DG005": ("null", "arrow", "star", "assigned"), "DG006": ("scalar", "used", *[f"stored{i}" for i in range(len(NAME_STORED))]), "DG007": ("file", "close")}


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(sorted(RULE_SEVERITY.items()), "rule_id string, severity string")


def inspect(files: DataFrame, rules: tuple[str, ...] | None = None, covered: DataFrame | None = None) -> DataFrame:
    """Findings of the enabled rules over ``files`` (file, text). ``covered``: (file, rule_id) that a native front end
    has inspected and whose lexical findings are dropped."""
    enabled = rules or tuple(RULES)
    written = marked_lines(files, tuple(k for rule in enabled for k in _RULE_MARKS[rule]))
    marks = written.select("id", "file", "line", "scope_end", F.inline("marks"))
    found = None
    for rule in enabled:
        own = RULES[rule](marks)
        found = own if found is None else found.unionByName(own)
    found = found.join(written.select("id", "file", "line", F.trim("original").alias("evidence")), "id").select("rule_id", "severity", "file", "line", "column", "evidence", "confidence")
    return found if covered is None else found.join(covered, ["file", "rule_id"], "left_anti")


def file_metrics(files: DataFrame) -> DataFrame:
    """Lines by kind, functions, complexity, brace depth, duplicate lines and includes per file; ratios unrounded."""
    df = prepare(files).withColumn("l", split_lines(F.col("text"))).withColumn("c", split_lines(F.col("code")))
    blank = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", "")) == ""
    both = F.zip_with("l", "c", lambda a, b: ~blank(a) & blank(F.coalesce(b, F.lit(""))))
    norm = F.filter(F.transform("c", normal_line), lambda x: x.isNotNull())
    count = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
    depth = F.aggregate(
        "c", F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, x: F.struct(F.greatest(F.lit(0), s["d"] + count(x, "{") - count(x, "}")).alias("d"), F.greatest(s["m"], s["d"] + count(x, "{")).alias("m")), lambda s: s["m"],
    )
    out = df.withColumn("norm", norm).select(
        "file",
        F.size("l").cast("long").alias("physical_lines"),
        F.size(F.filter("c", lambda x: ~blank(x))).cast("long").alias("code_lines"),
        F.size(F.filter(both, lambda x: x)).cast("long").alias("comment_lines"),
        F.size(F.filter("l", blank)).cast("long").alias("blank_lines"),
        F.size("functions").cast("long").alias("function_count"),
        F.aggregate(F.transform("functions", lambda f: f["complexity"]), F.lit(0), lambda s, x: s + x).cast("long").alias("complexity"),
        depth.cast("long").alias("max_brace_depth"),
        (F.size("norm") - F.size(F.array_distinct("norm"))).cast("long").alias("duplicate_lines"),
        F.size("norm").cast("long").alias("normal_lines"),
        F.size(F.array_distinct(include_targets(F.col("text")))).cast("long").alias("include_count"),
    )
    return out.withColumn("comment_ratio", F.col("comment_lines") / F.greatest("physical_lines", F.lit(1))).withColumn("duplicate_line_ratio", F.col("duplicate_lines") / F.greatest("normal_lines", F.lit(1)))


def project_metrics(metrics: DataFrame, findings: int | Column = 0) -> DataFrame:
    """One row over all files; duplicates are counted within files (see ``global_duplicates``)."""
    n = F.lit(findings) if isinstance(findings, int) else findings
    total = {c: F.sum(c).cast("long").alias(c) for c in ("physical_lines", "code_lines", "comment_lines", "blank_lines", "function_count", "complexity")}
    out = metrics.agg(F.count(F.lit(1)).alias("file_count"), *total.values(), F.max("max_brace_depth").alias("max_brace_depth"))
    return out.withColumn("average_function_complexity", F.col("complexity") / F.greatest("function_count", F.lit(1))).withColumn("comment_ratio", F.col("comment_lines") / F.greatest("physical_lines", F.lit(1))).withColumn("warning_density_per_kloc", n * 1000 / F.greatest("code_lines", F.lit(1)))


def global_duplicates(text_lines: DataFrame) -> DataFrame:
    """(n, duplicated) over all normal lines (column line): rows less distinct ones."""
    counts = text_lines.groupBy("line").agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("duplicated"))


def project_duplicates(files: DataFrame) -> DataFrame:
    """n, duplicated and include_count over all of ``files`` (file, text): normal lines of the code, those that are there
    already, and distinct include targets. Lines and targets are counted as rows, whatever the size of a file."""
    coded = files.select("text", masked("text").alias("code"))
    norm = coded.select(F.explode(split_lines(F.col("code"))).alias("l")).select(normal_line(F.col("l")).alias("line")).where("line is not null")
    targets = coded.select(F.explode(include_targets(F.col("text"))).alias("t")).agg(F.count_distinct("t").alias("include_count"))
    return global_duplicates(norm).withColumn("_k", F.lit(0)).join(targets.withColumn("_k", F.lit(0)), "_k").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("duplicated", F.lit(0)).alias("duplicated"), "include_count")
