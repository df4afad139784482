"""Reports over snapshots and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import html_text, known
from quarrylens.operators.digest import ordered_digest


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows as JSON text in a total order, for a sink that writes one file per partition."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def nested_report(scans: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One nested row per scan, child rows in arrays sorted by their keys. A scan's children meet in one row: use it
    for reports, which are read as a whole."""
    out = scans
    for name, (child, order) in children.items():
        rest = [c for c in child.columns if c != "scan_id" and c not in order]
        rows = child.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(rows, "scan_id", "left")
    return out


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def metric_rows_html(functions: DataFrame, most: int = 500) -> DataFrame:
    """Table rows of the most complex functions, escaped, unknown values named; a top-k report."""
    cells = [html_text(F.col("name")), html_text(F.col("file")), *[known(F.col(c)) for c in ("line", "complexity", "lines", "parameters", "max_nesting", "fan_in", "fan_out")]]
    top = functions.orderBy(F.desc("complexity"), "symbol_id").limit(most)
    return top.select("symbol_id", "complexity", F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>")).alias("html"))


def export(df: DataFrame, folder: str, order: list[str]) -> None:
    """JSON lines to a new folder; an existing one is an error."""
    json_lines(df, order).write.mode("errorifexists").text(folder)


def tiles(units: DataFrame, by: list[str]) -> DataFrame:
    """Units and those that succeeded."""
    return units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("status") == "success").alias("successful"))


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


def corpus_counters(metrics: DataFrame, by: list[str]) -> DataFrame:
    """The extremes of nesting and fans over a corpus, and its functions; unknown (-1) counts as 0."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("functions"), *[F.max(F.greatest(c, F.lit(0))).alias(f"most_{c}") for c in ("max_nesting", "fan_in", "fan_out")])


def family_counts(pairs: DataFrame) -> DataFrame:
    """For each weakness: pairs, distinct families and distinct clone groups."""
    return pairs.groupBy("weakness").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("family").alias("families"), F.count_distinct("template").alias("templates"))


def structure_sums(functions: DataFrame, by: list[str]) -> DataFrame:
    """Nodes and edges of all layers (arrays nodes, edges), whether all dataflow is complete and whether any is stale."""
    return functions.groupBy(*by).agg(F.sum(F.size("nodes")).alias("nodes"), F.sum(F.size("edges")).alias("edges"), F.bool_and(F.col("dfg_status") == "complete").alias("all_complete"), F.bool_or(F.col("changed")).alias("any_changed"))


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "column", "rule_id")


def mean_times(runs: DataFrame, by: list[str], base: str, other: str) -> DataFrame:
    """Mean durations of two variants and how many times faster the other is."""
    mean = lambda v: F.avg(F.when(F.col("variant") == v, F.col("ms")))
    return runs.groupBy(*by).agg(mean(base).alias("base_ms"), mean(other).alias("other_ms")).withColumn("speed_up", F.col("base_ms") / F.col("other_ms"))


def project_fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """``by``, files, fingerprint: a digest of each project's (file, hash) in path order, at any number of files (see
    ``ordered_digest``). Another order of rows or another partitioning gives the same; another path or content does not."""
    leaf = F.sha2(F.concat(F.col("file"), F.lit("\0"), F.col("hash"), F.lit("\0")), 256)
    return ordered_digest(files, by, [F.col("file")], leaf).withColumnsRenamed({"rows": "files", "digest": "fingerprint"})
