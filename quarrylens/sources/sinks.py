"""Sinks that record what they wrote: JSON lines with the SHA-256 of every file in a manifest, never over an older one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.digest import ordered_digest
from quarrylens.sources.snapshots import create_once

ROWS_PER_FILE = 100_000
_FILES = "table string, file string, bytes long, sha256 string"


def written_files(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """table, file (below the folder), bytes and sha256 of a table's files, hashed where Spark reads them."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/{table}")
    return read.select(F.lit(table).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_with_manifest(tables: dict[str, DataFrame], folder: str, facts: dict | None = None, rows_per_file: int = ROWS_PER_FILE) -> dict:
    """Write each table as JSON lines of at most ``rows_per_file`` rows a file below ``folder``, the files' hashes to
    ``manifest/files``, and last ``manifest/summary.json`` with ``facts`` and, for each table, its rows and one digest over
    all its files. The summary is returned. A folder that holds any of them already is an error, and stays as it is.

    An empty table has no rows and no digest. A file is hashed as a whole, hence the bound on its rows."""
    folder, summary = folder.rstrip("/"), {**(facts or {}), "tables": {}}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", "false").json(f"{folder}/{name}")
        files = written_files(spark, folder, name)
        files.write.mode("errorifexists").json(f"{folder}/manifest/{name}")
        whole = ordered_digest(spark.read.schema(_FILES).json(f"{folder}/manifest/{name}").where("bytes > 0"), [], [F.col("file")], F.col("sha256")).first()
        rows = spark.read.schema(df.schema).json(f"{folder}/{name}").count()
        summary["tables"][name] = {"rows": rows, "files": whole.rows if whole else 0, "sha256": whole.digest if whole else None}
    if not create_once(spark, f"{folder}/manifest/summary.json", json.dumps(summary, sort_keys=True, ensure_ascii=False) + "\n"):
        raise ValueError(f"{folder} has a summary already")
    return summary


def manifest_problems(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """table, file, problem: files of the manifest that are ``missing`` or ``changed``, and others that are ``unlisted``."""
    folder = folder.rstrip("/")
    out = None
    for name in tables:
        listed = spark.read.schema(_FILES).json(f"{folder}/manifest/{name}").select("file", F.col("sha256").alias("listed"))
        both = listed.join(written_files(spark, folder, name).select("file", F.col("sha256").alias("found")), "file", "full")
        problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "changed")
        own = both.select(F.lit(name).alias("table"), "file", problem.alias("problem")).where("problem is not null")
        out = own if out is None else out.unionByName(own)
    return out


def read_verified(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table of the folder after its files were held against the manifest; a difference is an error."""
    if bad := manifest_problems(spark, folder, [table]).first():
        raise ValueError(f"{bad.table}/{bad.file} is {bad.problem}")
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/{table}")


def write_graphs(graphs: DataFrame, files: DataFrame, folder: str, facts: dict | None = None) -> dict:
    """Function graphs (with a column file) and the files (column file) that have none, with their manifest."""
    without = files.select("file").distinct().join(graphs.select("file"), "file", "left_anti")
    return write_with_manifest({"graphs": graphs, "files_without_graphs": without}, folder, {"label_status": "unlabeled", **(facts or {})})


def write_dataset(records: DataFrame, splits: DataFrame, folder: str, facts: dict | None = None) -> dict:
    """Labelled records (sample_id, ...) and their splits (sample_id, split), each sample in one split, with a manifest; its
    facts hold the counts of each label in each split. A sample without a split, or in two, is an error before anything is
    written."""
    both = records.select("sample_id", "label", F.lit(1).alias("r"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("split")).unionByName(
        splits.select("sample_id", F.lit(None).cast("int").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("s"), "split")
    )
    placed = both.groupBy("sample_id").agg(F.sum("r").alias("r"), F.sum("s").alias("s"), F.max("label").alias("label"), F.max("split").alias("split"))
    if bad := placed.where("r != 1 or s != 1").first():
        raise ValueError(f"sample {bad.sample_id} is {bad.r} times a record and {bad.s} times in a split")
    counts: dict[str, dict[str, int]] = {}
    for row in placed.groupBy("split", "label").count().collect():  # a row for each split and class
        counts.setdefault(row.split, {})[str(row.label)] = row["count"]
    return write_with_manifest({"dataset": records, "splits": splits}, folder, {"class_counts": counts, **(facts or {})})


def canonical_line(row: Column) -> Column:
    """A struct as one JSON line with its fields by name, nulls kept: equal rows give equal lines."""
    return F.to_json(row, {"ignoreNullFields": "false"})
