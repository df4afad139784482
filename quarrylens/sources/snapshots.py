"""Versioned snapshots of analysis facts: logical views, a manifest-published store, history."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType() if k == "i" else T.StringType(), False) for n, k in (x.split(":") for x in text.split())])


#: The logical tables, their columns in order, and the columns that give the input order.
VIEWS = {
    "files": _schema("file:s language:s lines:i size:i mtime:i hash:s"),
    "functions": _schema("name:s file:s line:i complexity:i lines:i parameters:i symbol_id:s max_nesting:i fan_in:i fan_out:i"),
    "symbols": _schema("name:s file:s line:i column:i kind:s definition:i external:i symbol_id:s"),
    "references": _schema("symbol_id:s enclosing_symbol:s kind:s file:s line:i column:i translation_unit:s"),
    "edges": _schema("kind:s source:s target:s file:s line:i column:i"),
    "issues": _schema("rule_id:s severity:s file:s line:i column:i message:s evidence:s suggestion:s symbol_id:s detector:s"),
    "suppressed_issues": _schema("rule_id:s severity:s file:s line:i column:i message:s evidence:s suggestion:s symbol_id:s detector:s reason:s"),
    "rule_diagnostics": _schema("ordinal:i message:s"),
    "builds": _schema("run_id:i scan_id:i stage:s status:s exit_code:i duration_ms:i tests_total:i tests_failed:i tests_skipped:i target:s"),
}
INPUT_ORDER = {
    "files": ["file"],
    "functions": ["symbol_id"],
    "symbols": ["symbol_id"],
    "references": ["symbol_id", "file", "line", "column", "kind", "enclosing_symbol", "translation_unit"],
    "edges": ["kind", "source", "target", "file", "line", "column"],
    "issues": ["file", "line", "column", "rule_id", "symbol_id"],
    "suppressed_issues": ["file", "line", "column", "rule_id", "symbol_id"],
    "rule_diagnostics": ["ordinal"],
    "builds": ["-run_id", "ordinal"],
}
#: Columns that order a view's input and are no fields of it; a leading - is descending.
HIDDEN = {"builds": [T.StructField("ordinal", T.LongType(), False)]}
#: What tells a table's rows apart, and which columns must name a row of another table.
KEYS = {
    "files": ["file"],
    "functions": ["symbol_id"],
    "symbols": ["symbol_id"],
    "references": ["symbol_id", "enclosing_symbol", "kind", "file", "line", "column", "translation_unit"],
    "edges": ["kind", "source", "target", "file", "line", "column"],
    "issues": ["rule_id", "file", "line", "column", "symbol_id"],
    "suppressed_issues": ["rule_id", "file", "line", "column", "symbol_id"],
    "rule_diagnostics": ["ordinal"],
}
REFERS = {("functions", "symbol_id"): ("symbols", "symbol_id"), ("references", "symbol_id"): ("symbols", "symbol_id")}
NEEDS_NO_ANALYSIS = ("files", "builds", "rule_diagnostics")


def conform(df: DataFrame, view: str) -> DataFrame:
    """``df`` in a view's columns and types. Unknown is -1 or '': nulls never enter a view."""
    fields = [*VIEWS[view].fields, *[f for f in HIDDEN.get(view, ()) if f.name in df.columns]]
    return df.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.lit(-1 if isinstance(f.dataType, T.LongType) else "").cast(f.dataType)).alias(f.name) for f in fields])


def functions_view(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    """Metrics with their symbols; a metric without a symbol raises an error when the row is read."""
    s = symbols.select(F.col("symbol_id").alias("_id"), "name", "file", "line")
    joined = metrics.join(s, F.col("symbol_id") == F.col("_id"), "left")
    name = F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("metric refers to a missing symbol: "), "symbol_id"))).otherwise(F.col("name"))
    return joined.withColumn("name", name).drop("_id")


def orphan_metrics(metrics: DataFrame, symbols: DataFrame) -> DataFrame:
    return metrics.join(symbols, "symbol_id", "left_anti")


def table_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """table, problem, item: rows of a snapshot's tables that share a key (``key twice``), and values that name no row of the
    table they refer to (``dangling``). Each is a partial aggregation or an anti join, so no key gathers its rows."""
    item = lambda cols: F.to_json(F.struct(*cols))
    found = []
    for name, df in tables.items():
        if keys := KEYS.get(name):
            twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            found.append(twice.select(F.lit(name).alias("table"), F.lit("key twice").alias("problem"), item(keys).alias("item")))
    for (name, column), (other, key) in REFERS.items():
        if name in tables:
            values = tables[name].select(F.col(column).alias(key)).distinct()
            lost = values.join(tables[other], key, "left_anti") if other in tables else values
            found.append(lost.select(F.lit(name).alias("table"), F.lit("dangling").alias("problem"), item([F.col(key).alias(column)]).alias("item")))
    if not found:
        raise ValueError("no table to check")
    return reduce(DataFrame.unionByName, found)


def create_once(spark: SparkSession, uri: str, text: str) -> bool:
    """Create a file with ``text``; False, and nothing changed, if it is there already. Of several that try at once, one
    gets True: a hard link on a local or mounted file system, an exclusive create elsewhere."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        path = unquote(where.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    try:
        out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class SnapshotStore:
    """Snapshots below one folder. A scan's tables go to a folder of their own; an entry in ``manifest``, a file named after
    the scan id and created last, publishes them. Readers see only scans in the manifest, so a write that broke off shows
    nowhere, and of two writers of one id one publishes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        schema = "scan_id long, root string, scanned_at string, status string, revision string, tables array<string>, write_id string, scope string"
        try:
            return self.spark.read.schema(schema).json(f"{self.folder}/manifest").where("scan_id is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def save(
        self, scan_id: int, root: str, scanned_at: str, tables: dict[str, DataFrame], status: str = "complete", revision: str = "", scope: str = "", diagnostics: list[str] | None = None
    ) -> None:
        """Write, check and publish. Nothing is published, and the error names a case, if the inventory was incomplete
        (``diagnostics``), the root is empty, the scan id is below 1 or published already, a table has a key twice or a
        value that names no row (see ``table_problems``). ``scope``: the fingerprint of what the inventory covered."""
        if diagnostics:
            raise ValueError(f"an incomplete inventory is not saved: {diagnostics[0]}")
        if not root:
            raise ValueError("the project root is empty")
        if scan_id <= 0 or self.manifest().where(F.col("scan_id") == scan_id).limit(1).count():
            raise ValueError(f"scan id {scan_id} is not positive or is already saved")
        write_id, staged = uuid.uuid4().hex, {}
        for name, df in tables.items():
            path = f"{self.folder}/{name}/{write_id}"
            conform(df, name).write.mode("errorifexists").parquet(path)
            staged[name] = self.spark.read.parquet(path)
        if any(n in KEYS for n in staged) and (bad := table_problems(staged).first()):
            raise ValueError(f"{bad.table}: {bad.problem}: {bad.item}")
        entry = {"scan_id": scan_id, "root": root, "scanned_at": scanned_at, "status": status, "revision": revision, "tables": sorted(tables), "write_id": write_id, "scope": scope}
        if not create_once(self.spark, f"{self.folder}/manifest/scan-{scan_id:020d}.json", json.dumps(entry) + "\n"):
            raise ValueError(f"scan id {scan_id} was saved by another writer")

    def read(self, scan_id: int, name: str, root: str | None = None) -> DataFrame:
        """One table of a published scan, lazily; an unknown scan, or one of another root where ``root`` is given, is an
        error, a table it lacks is empty."""
        row = self.manifest().where(F.col("scan_id") == scan_id).first()
        if row is None or root not in (None, row.root):
            raise ValueError(f"no saved scan {scan_id}" + (f" of {root}" if root else ""))
        if name not in row.tables:
            return self.spark.createDataFrame([], VIEWS[name])
        frame = self.spark.read.parquet(f"{self.folder}/{name}/{row.write_id}")
        return conform(frame, name)

    def latest(self, root: str) -> int | None:
        return self.manifest().where(F.col("root") == root).agg(F.max("scan_id")).first()[0]

    def projects(self) -> DataFrame:
        return latest_per_project(self.manifest(), "root", "scan_id", "scanned_at")


def latest_per_project(scans: DataFrame, root: str, scan_id: str, at: str) -> DataFrame:
    """The newest scan of each project."""
    return scans.groupBy(root).agg(F.max(scan_id).alias("scan_id"), F.max_by(at, scan_id).alias("scanned_at"))


def history_page(scans: DataFrame, children: dict[str, DataFrame], before: int | None = None, limit: int = 50) -> DataFrame:
    """A page of scans, newest first, with the count of each child table's rows (0 where none); ``before`` is the
    exclusive cursor. The page is cut before the children are counted, so they are joined for its scans only."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    page = (scans if before is None else scans.where(F.col("scan_id") < before)).orderBy(F.desc("scan_id")).limit(limit)
    for name, child in children.items():
        counts = child.join(F.broadcast(page.select("scan_id")), "scan_id", "left_semi").groupBy("scan_id").agg(F.count(F.lit(1)).alias(name))
        page = page.join(counts, "scan_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return page


def newest_builds(runs: DataFrame, steps: DataFrame, logs: bool = False, limit: int = 50) -> DataFrame:
    """The newest runs with a row per step, newest run first and steps in order (``run_id`` descending, ``ordinal``); without
    ``logs`` the captured output is blank. The page is cut before the steps are joined."""
    page = runs.orderBy(F.desc("run_id")).limit(limit)
    shown = steps if logs else steps.withColumns({c: F.lit("") for c in ("stdout", "stderr") if c in steps.columns})
    return F.broadcast(page).join(shown, "run_id")


def save_build(manifest: DataFrame, run: DataFrame, steps: DataFrame, folder: str) -> None:
    """Save a build run and its steps; its scan must be saved for the same root, and the run's id must be new. Steps go
    first, to a folder of their run, and over what a broken attempt left there; the run, without which no reader sees
    them, last. So a save that failed can be repeated."""
    if run.join(manifest, ["scan_id", "root"], "left_anti").limit(1).count():
        raise ValueError("the scan of a build run is not saved for its root")
    try:
        saved = run.sparkSession.read.schema(run.schema).parquet(f"{folder}/build_run")
    except AnalysisException:
        saved = run.limit(0)
    if run.join(saved, "run_id", "left_semi").limit(1).count():
        raise ValueError("a build run of this id is already saved")
    steps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/build_step")
    run.write.mode("append").parquet(f"{folder}/build_run")


def builds_view(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Build runs flattened to a row per step."""
    return runs.join(steps, "run_id")
