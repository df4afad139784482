"""Token-id files: flat unsigned integers, 64-bit document offsets, global starts by prefix sums."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm._encode import encoder, text_slices
from quarrylens.llm._shared import new_folder

NO_ID = -(1 << 63)  # stands for a null doc_id in the files

_SHARD = "shard int, path string, width int, n_docs long, n_tokens long"
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order below ``folder``.

    Documents are dealt by ranges of doc_id and sorted within each; a range becomes one shard of three files:
    ``.bin`` ids one after another as little-endian unsigned integers (2 bytes if the vocabulary allows, else 4),
    ``.idx`` the n + 1 document offsets within the shard as little-endian 64-bit integers, ``.doc`` the doc_ids.
    The returned manifest (itself Parquet below ``folder``) has a row per shard and, in ``base``, the ids of all
    shards before it: a prefix sum over shard sizes. Files get a fresh name at each attempt and only those in
    the manifest count, so lost or repeated tasks leave nothing wrong.

    Null text: the end id alone. Null doc_id: first, as NO_ID. Equal doc_ids stand together, ordered by text;
    equal rows are written once each. Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = documents.sparkSession

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, kind)
        width = 2 if max(end_id + 1, enc.tokenizer.get_vocab_size()) <= 1 << 16 else 4
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{root}/ids-{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4").tobytes()
        total, n_docs = 0, 0
        with store.open_output_stream(f"{name}.bin") as out, store.open_output_stream(f"{name}.idx") as idx, store.open_output_stream(f"{name}.doc") as doc:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                for lo, texts in text_slices(batch.column(1).to_pylist()):
                    bodies = [b + end for b in enc.encode(texts)]
                    ids = np.frombuffer(b"".join(bodies), "<u4")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    ends = total + np.cumsum([len(b) // 4 for b in bodies], dtype="<i8")
                    idx.write(ends.tobytes())
                    doc.write(keys[lo : lo + len(texts)].tobytes())
                    total, n_docs = int(ends[-1]), n_docs + len(texts)
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "width": width, "n_docs": n_docs, "n_tokens": total}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            for x in ("bin", "idx", "doc"):
                store.delete_file(f"{name}.{x}")

    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, _SHARD).write.parquet(f"{folder}/shards")
    shards = spark.read.schema(_SHARD).parquet(f"{folder}/shards")
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one row a shard
    shards.withColumn("base", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _array(store, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the file system is local, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, step: int = 256) -> DataFrame:
    """A row per document in the files: doc_id (null for NO_ID), its global start, n_tokens, and ids as
    little-endian unsigned 32-bit integers."""

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, idx, doc = (_array(store, f"{row['path']}.{x}", t) for x, t in (("bin", f"<u{row['width']}"), ("idx", "<i8"), ("doc", "<i8")))
                for lo in range(0, len(doc), step):
                    hi = min(lo + step, len(doc))
                    at = np.asarray(idx[lo : hi + 1])
                    keys = np.asarray(doc[lo:hi])
                    bodies = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.record_batch([pa.array(keys, mask=keys == NO_ID), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(bodies, pa.binary())], names=DOCS.names)

    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "width", "base")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, DOCS)  # a task per shard


def round_trip(documents: DataFrame, tokenizer_path: str, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    folder = new_folder(documents.sparkSession, "tokens")
    write_token_files(documents, folder, tokenizer_path, kind, end_id)
    return read_token_files(documents.sparkSession, folder)


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
