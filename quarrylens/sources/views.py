"""The logical views built from the stored relations of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.snapshots import builds_view, conform, functions_view

#: The relation behind each view, and its columns whose names differ there.
RELATIONS = {
    "files": ("file", {"path": "file"}),
    "functions": ("function_metric", {"usr": "symbol_id"}),
    "symbols": ("symbol", {"usr": "symbol_id", "col": "column"}),
    "references": ("symbol_reference", {"col": "column", "unit_file": "translation_unit"}),
    "edges": ("graph_edge", {"col": "column"}),
    "issues": ("issue", {"col": "column", "symbol": "symbol_id"}),
    "suppressed_issues": ("suppressed_issue", {"col": "column", "symbol": "symbol_id", "suppression_reason": "reason"}),
    "rule_diagnostics": ("rule_diagnostic", {}),
    "builds": ("build_step", {"name": "stage"}),
}


def logical_view(view: str, relations: dict[str, DataFrame], scan_id: int | None = None) -> DataFrame:
    """A view's rows from stored ``relations`` (see RELATIONS; ``functions`` also takes ``symbol``, ``builds`` also
    ``build_run``), of one scan where ``scan_id`` is given and they have the column.

    Flags become 0 or 1, a null becomes the unknown of its type (-1 or ''), and an integer beyond 64 bits is an error when
    read, as is a metric without its symbol. A relation that is not there is an error; an empty one gives an empty view.
    """
    if view not in RELATIONS:
        raise ValueError(f"unknown table: {view}")

    def stored(name: str, renames: dict[str, str]) -> DataFrame:
        if name not in relations:
            raise ValueError(f"no relation {name} for {view}")
        df = relations[name]
        if scan_id is not None and "scan_id" in df.columns and view != "builds":
            df = df.where(F.col("scan_id") == scan_id)
        return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})

    name, renames = RELATIONS[view]
    out = stored(name, renames)
    if view == "functions":
        out = functions_view(out, stored("symbol", RELATIONS["symbols"][1]))
    if view == "builds":
        out = builds_view(stored("build_run", {"id": "run_id"}), out)
    return conform(out, view)


def metrics_with_symbols(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    """Metrics for a report, most complex first and then by symbol id: name and place (file:line) of the symbol; a metric
    without one keeps its id as name and an empty place, and never fails."""
    s = symbols.select(F.col("symbol_id").alias("_id"), F.col("name").alias("_name"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("_place"))
    joined = metrics.join(s, F.col("symbol_id") == F.col("_id"), "left")
    named = joined.withColumns({"name": F.coalesce("_name", "symbol_id"), "place": F.when(F.col("_id").isNull(), F.lit("")).otherwise(F.col("_place"))})
    return named.drop("_id", "_name", "_place").orderBy(F.desc("complexity"), "symbol_id")


def united_coverage(units: DataFrame) -> DataFrame:
    """scan_id and file of all that some unit (scan_id, covered_files) covers, each once."""
    return units.select("scan_id", F.explode("covered_files").alias("file")).distinct()


def scan_counters(units: DataFrame, issues: DataFrame) -> DataFrame:
    """scan_id, kind (``unit`` or ``issue``), name (a status or a rule) and n: how often each comes in a scan."""
    of = lambda df, kind, name: df.groupBy("scan_id", F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return of(units, "unit", "status").unionByName(of(issues, "issue", "rule_id"))
