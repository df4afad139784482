"""Directory inventories, compile commands and JSON lines as DataFrames."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source file extensions and folders that are never scanned.
EXTENSIONS = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
IGNORED = (".git", ".svn", ".hg", ".vs", ".idea", "node_modules", "build", "out", "dist")

_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def language_of(path: Column) -> Column:
    """C for .c, header for .h*, else C++; extensions in any case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "c", "C").when(ext.startswith("h"), "header").otherwise("C++")


@F.pandas_udf(T.StringType())
def fnv1a64(content: pd.Series) -> pd.Series:
    """FNV-1a of bytes, 64 bits, as text; columns of equal-length contents are folded byte by byte together."""
    values = [b"" if c is None else bytes(c) for c in content]
    order = np.argsort([len(v) for v in values], kind="stable")
    state = np.full(len(values), _OFFSET, np.uint64)
    lengths = np.array([len(values[i]) for i in order], np.int64)
    joined = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(values) else np.zeros(0, np.int64)
    for k in range(int(lengths[-1]) if len(values) else 0):
        live = slice(int(np.searchsorted(lengths, k, "right")), None)
        state[live] = (state[live] ^ joined[starts[live] + k]) * np.uint64(_PRIME)
    out = np.empty(len(values), object)
    out[order] = [f"fnv1a64-v1:{int(s):016x}" for s in state]
    return pd.Series(out)


def line_count(content: Column) -> Column:
    """Physical lines of bytes: newlines, and one more if the last byte is none."""
    text = F.decode(content, "ISO-8859-1")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


EMPTY_HASH = f"fnv1a64-v1:{_OFFSET:016x}"


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of no bytes, which Spark's file reader leaves out, from the folder listing."""
    store, path = pafs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", root))
    listed = store.get_file_info(pafs.FileSelector(path, recursive=True))
    found = [(f.path[len(path.rstrip("/")) + 1 :], f.mtime_ns // 1_000_000) for f in listed if f.type == pafs.FileType.File and f.size == 0]
    return spark.createDataFrame(found, "file string, mtime long")


def scan_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The inventory of a source tree: file (relative path), language, lines, size, mtime (ms), hash. Extensions and
    ignored folders match in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    full = found.select(F.substring_index(F.col("path"), base, -1).alias("file"), line_count(F.col("content")).alias("lines"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), fnv1a64("content").alias("hash"))
    empty = _empty_files(spark, root).select("file", F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("size"), "mtime", F.lit(EMPTY_HASH).alias("hash"))
    inside = F.split("file", "/")
    folders = F.slice(inside, 1, F.size(inside) - 1)
    skip = F.exists(folders, lambda d: F.lower(d).isin([x.lower() for x in ignored]) | F.lower(d).startswith("cmake-build-"))
    kept = full.unionByName(empty).where(F.lower("file").rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~skip)
    return kept.select("file", language_of(F.col("file")).alias("language"), "lines", "size", "mtime", "hash")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """A compile database: directory, file (absolute), command fields, and command_id."""
    raw = spark.read.option("multiLine", True).schema("directory string, file string, command string, arguments array<string>, output string").json(path)
    absolute = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    fields = F.coalesce("arguments", F.array("command"))
    return raw.select("directory", absolute.alias("file"), fields.alias("arguments"), command_id(F.col("directory"), absolute, fields).alias("command_id"))


def command_id(directory: Column, file: Column, arguments: Column) -> Column:
    """SHA-256 over the fields, each ended by NUL."""
    fields = F.concat(F.array(directory, file), arguments)
    return F.sha2(F.array_join(F.transform(fields, lambda x: F.concat(x, F.lit("\0"))), ""), 256)


def rebase(path: Column, old: str, new: str) -> Column:
    """``path`` with the folder ``old`` replaced by ``new``, on whole components only."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(path == old, F.lit(new)).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema: a byte-order mark and blank lines are skipped, a bad line is an error."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


#: The summary of a test runner, and its mark of a skipped test.
TEST_SUMMARY, SKIPPED_MARK = r"(\d+)% tests passed(?:, (\d+) tests failed)? out of (\d+)", r"\*\*\*Skipped"


def test_counts(output: Column, truncated: Column | None = None) -> Column:
    """(total, failed, skipped) from a test runner's first summary; -1 where it has none or the output was cut."""
    has = output.rlike(TEST_SUMMARY) & ~(F.lit(False) if truncated is None else truncated)
    group = lambda g: F.coalesce(F.nullif(F.regexp_extract(output, TEST_SUMMARY, g), F.lit("")), F.lit("0")).cast("long")
    skipped = F.size(F.regexp_extract_all(output, F.lit(SKIPPED_MARK), F.lit(0))).cast("long")
    known = lambda c: F.when(has, c).otherwise(F.lit(-1).cast("long"))
    return F.struct(known(group(3)).alias("total"), known(group(2)).alias("failed"), known(skipped).alias("skipped"))


def scope_fingerprint(ignored: tuple[str, ...]) -> str:
    """The ignore list as text that no other list has: names in order, each after its length."""
    return "".join(f"{len(x.encode())}:{x}" for x in sorted({x.lower() for x in ignored}))


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


#: The file that is looked for, how deep, and folders that are left out.
COMMAND_FILE, COMMAND_DEPTH, NOT_SEARCHED = "compile_commands.json", 3, (".git", ".venv", ".venv-ml", "node_modules")


def command_files(spark: SparkSession, root: str, depth: int = COMMAND_DEPTH) -> DataFrame:
    """path of the compile-command files at most ``depth`` folders below ``root``, by Spark's own (parallel) listing. Files
    without content hold no commands and are left out; a root without any gives no rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", COMMAND_FILE).load(root).select("path")
    inner = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), "^" + re.escape(re.sub(r"^\w+:/+", "/", root.rstrip("/"))) + "/", "")
    parts = F.split(inner, "/")
    return found.where((F.size(parts) <= depth + 1) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in NOT_SEARCHED]))).orderBy("path")
