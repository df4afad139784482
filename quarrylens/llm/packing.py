"""Packing by power-of-two decomposition: every sequence is one binary-length piece of one document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm._encode import encoder, text_slices

MAX_TOKENS = 2048
END_ID = 1

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def binary_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of n tokens: as many of ``most`` as fit, then the powers of two of the rest, falling."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(documents: DataFrame, tokenizer_path: str, kind: str = "word", most: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document's ids (its text's ids, then ``end_id``).

    A piece's length is a power of two of at most ``most`` (a power of two), it is a whole sequence (``offset``
    is 0), and ``ids`` are little-endian unsigned 32-bit integers. No sequence holds padding and none crosses
    documents. Sequences of one length form a bucket: the high bits of ``sequence_id`` are the base-2 logarithm
    of the length, then come the task's number and a count within the task, so ids are distinct, a bucket's ids
    are one range, and a task that runs again gives the same ids. Nothing is shuffled.

    A null or empty text is a document of the end id alone; a null doc_id stays null; repeated rows are packed
    once each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, kind)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        used = [0] * most.bit_length()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for i, body in enumerate(enc.encode(texts)):
                    body += end
                    at, total = 0, len(body) // 4
                    for n in binary_lengths(total, most):
                        b = n.bit_length() - 1
                        rows.append((doc_ids[lo + i], at, n, body[4 * at : 4 * (at + n)], total, b << 58 | task << 34 | used[b], 0))
                        used[b] += 1
                        at += n
                for k in range(0, len(rows), 20_000):
                    columns = zip(*rows[k : k + 20_000], strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names=PIECES.names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
