"""Approximate control-flow graphs from the lines of functions, within a row: arrays, no shuffle and no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import split_lines

#: What makes a line a return, a branch or a loop, in this order; and how much of a line is its label.
STATEMENT_KINDS = (("return", r"(?U)\breturn\b"), ("branch", r"(?U)\b(?:if|switch)\s*\("), ("loop", r"(?U)\b(?:for|while)\s*\("))
LABEL_CHARS = 160
_SPACE = r"(?U)[\s\x1C-\x1F]"


def _bare(line: Column) -> Column:
    """A line without white space, and then without braces and spaces, at its ends."""
    out = F.regexp_replace(line, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.regexp_replace(out, r"^[{} ]+|[{} ]+$", "")


def statements(body: Column, start_line: Column) -> Column:
    """(line, kind, label) of each line of ``body`` that holds more than braces; lines count from ``start_line``."""
    kind = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(k)) for k, p in STATEMENT_KINDS], F.lit("statement"))
    numbered = F.transform(split_lines(body), lambda x, i: F.struct((start_line + i).alias("line"), _bare(x).alias("text")))
    return F.transform(F.filter(numbered, lambda x: x["text"] != ""), lambda x: F.struct(x["line"].alias("line"), kind(x["text"]).alias("kind"), F.substring(x["text"], 1, LABEL_CHARS).alias("label")))


def control_flow(prepared: DataFrame) -> DataFrame:
    """A row per function of ``prepared`` (file, code, functions: see ``lexical.prepare``): file, function, start_line,
    end_line, nodes (node_id, line, kind, label; entry first and exit last) and edges (source, target, kind).

    A statement leads to the next one (``next``), the last to the exit; a return to the exit only (``return``); a branch or
    a loop also to the one after the next (``false-approx``). A function without statements leads from entry to exit.
    Functions are told apart by file, name and start line; two that share them have equal node ids, as they are one text
    line. Null or empty text has no functions.
    """
    f = F.col("f")
    own = prepared.select("file", "code", F.explode("functions").alias("f")).select(
        "file", f["name"].alias("function"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"), F.substring(F.col("code"), f["begin"] + 1, f["end"] - f["begin"]).alias("body")
    )
    own = own.withColumn("s", statements(F.col("body"), F.col("start_line"))).withColumn("prefix", F.concat_ws(":", F.col("file").cast("string"), "function", F.col("start_line").cast("string")))
    named = lambda what: F.concat(F.col("prefix"), F.lit(":"), what)
    entry, leave, n = named(F.lit("entry")), named(F.lit("exit")), F.size("s")
    at = lambda i: F.when(i < n, named(F.concat(F.lit("n"), (i + 1).cast("string")))).otherwise(leave)
    node = lambda i, line, kind, label: F.struct(i.alias("node_id"), line.alias("line"), kind.alias("kind"), label.alias("label"))
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), kind.alias("kind"))
    nodes = F.concat(
        F.array(node(entry, F.col("start_line"), F.lit("entry"), F.lit("entry"))), F.transform("s", lambda x, i: node(at(i), x["line"], x["kind"], x["label"])), F.array(node(leave, F.col("end_line"), F.lit("exit"), F.lit("exit")))
    )

    def out_of(x: Column, i: Column) -> Column:
        on = F.when(x["kind"] == "return", edge(at(i), leave, F.lit("return"))).otherwise(edge(at(i), at(i + 1), F.lit("next")))
        aside = F.when(x["kind"].isin("branch", "loop"), edge(at(i), at(i + 2), F.lit("false-approx")))
        return F.filter(F.array(on, aside), lambda e: e.isNotNull())

    edges = F.concat(F.array(edge(entry, at(F.lit(0)), F.lit("next"))), F.flatten(F.transform("s", out_of)))
    return own.select("file", "function", "start_line", "end_line", nodes.alias("nodes"), edges.alias("edges"))
