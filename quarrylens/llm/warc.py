"""WARC archives: write captures as concurrent records, read them back, and assemble transactions."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm._shared import new_folder

LEAST_REVISIT_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"  # captures carry no time of their own
_CRLF = b"\r\n"

RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, body binary"
_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORDS.split(", ")])


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Add ``payload`` (the html in UTF-8; null: empty), ``payload_digest`` (hex SHA-1), ``payload_bytes`` and
    ``first_id``: for a payload of at least ``least`` bytes that other rows have too and whose largest page_id is
    another row's, that page_id; else null.

    The groups are counted map-side by digest, and only digests that occur twice or more are joined back, so the
    join is broadcast while Spark measures that side as small and is a shuffle that adaptive execution can split
    otherwise. Rows that repeat the largest page_id are all responses; a null page_id is below every other one.
    """
    sized = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    groups = sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").select("payload_digest", "top")
    is_copy = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return sized.join(groups, "payload_digest", "left").withColumn("first_id", F.when(is_copy, F.col("top"))).drop("top")


def _urn(page_id, digest: str, kind: str) -> str:
    return f"<urn:capture:{'null' if page_id is None else page_id}:{digest}:{kind}>"


def _record(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + _CRLF + body + _CRLF + _CRLF


def _clean(url: str) -> str:
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 256 else " ", url)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, per_file: int = 64 << 20) -> DataFrame:
    """Write three records per page below ``folder``: a request, a response (or a revisit without payload), and a
    metadata record with the page_id, url (a JSON string; none if null) and payload size, the first and last concurrent to
    the second. A target URI has its white space escaped; a null url has none. Each record is a gzip member of its own. Returns the manifest of files (Parquet below ``folder``); a file gets a
    fresh name at each attempt and only files in the manifest count.
    """
    spark = pages.sparkSession

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    path, size, n = f"{root}/captures-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                kind = "response" if first is None else "revisit"
                own, target = _urn(page_id, digest, kind), [] if url is None else [("WARC-Target-URI", _clean(url))]
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                headers = [("WARC-Record-ID", own), *target, ("WARC-Payload-Digest", f"sha1:{b32}")]
                if first is None:
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
                else:
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(first, digest, "response"))]
                headers.append(("Content-Type", "application/http; msgtype=response"))
                fields = f"page-id: {'null' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n".encode()
                if url is not None:
                    fields += f"url: {json.dumps(url)}\r\n".encode()
                linked = ("WARC-Concurrent-To", own)
                for record in (
                    _record("request", [("WARC-Record-ID", _urn(page_id, digest, "request")), *target, linked, ("Content-Type", "application/http; msgtype=request")], f"GET {_clean(url or '/')} HTTP/1.1\r\n\r\n".encode()),
                    _record(kind, headers, body),
                    _record("metadata", [("WARC-Record-ID", _urn(page_id, digest, "metadata")), *target, linked, ("Content-Type", "application/warc-fields")], fields),
                ):
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = member.compress(record) + member.flush()
                    out.write(data)
                    size += len(data)
                n += 1
                if size >= per_file:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})

    marked = mark_revisits(pages, least).select("page_id", "url", "payload", "payload_digest", "first_id")
    marked.mapInArrow(run, "path string, captures long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _stream(file, step: int = 1 << 20):
    """The uncompressed bytes of a file of gzip members, in parts. A file that ends within a member is an error."""
    inflate, within = zlib.decompressobj(31), False
    while data := file.read(step):
        while data:
            within = True
            if part := inflate.decompress(data):
                yield part
            data = inflate.unused_data
            if inflate.eof:
                inflate, within = zlib.decompressobj(31), False
    if within:
        raise EOFError("the archive ends within a gzip member")


def parse(parts):
    """The records of a WARC stream given in parts, as (headers, body). A stream that ends within a record is an error."""
    held = bytearray()
    parts = iter(parts)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held:
                    raise EOFError("the archive ends within the headers of a record")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        if not fill(end + 4 + size + 4):
            raise EOFError(f"the archive ends within record {headers.get('warc-record-id')}")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]


def read_records(spark: SparkSession, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row per record of the archives in the manifest. ``body`` of a response is its payload, of the others
    their whole block. An archive that ends within a record, or holds other than three records for each capture of the
    manifest (as one cut between two records does), is an error."""

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, captures in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as file:
                    for h, body in parse(_stream(file)):
                        n += 1
                        kind = h.get("warc-type")
                        if kind == "response":
                            body = body.partition(b"\r\n\r\n")[2]
                        rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), body))
                        size += len(body)
                        if size >= batch_bytes or len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                            rows, size = [], 0
                if n != 3 * captures:
                    raise EOFError(f"{path} holds {n} records, the manifest says {captures} captures of three")
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "captures")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)  # a task per file


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (a response or revisit record), and the ``request`` and
    ``metadata`` records concurrent to it (null if there is none; of several the one with the least record id).

    Requests and metadata are brought to one row per capture with partial aggregation before the join, so a
    capture that very many records name costs a row per task; the payload is shuffled once.
    """
    block = F.struct("record_id", "target_uri", "body")
    parts = {
        kind: records.where(F.col("record_type") == kind).where(F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture")).agg(F.min(block).alias(kind))
        for kind in ("request", "metadata")
    }
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture"), F.struct("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "body").alias("response")
    )
    # records come from a small manifest, so their estimated size says nothing: never broadcast them
    return main.join(parts["request"].hint("merge"), "capture", "left").join(parts["metadata"].hint("merge"), "capture", "left")


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write archives of all pages below the shared folder, read them back and assemble the captures.

    Null html is an empty payload; a null page_id is written as such, a null url is left out; repeated rows give a capture each;
    other columns are ignored; an empty table gives no captures.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least)
    return assemble(read_records(pages.sparkSession, folder))


def digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from captures as read. A response's size and
    digest come from its payload; a revisit's from its metadata record and its digest header. The url is the metadata's."""
    fields = F.decode(F.col("metadata.body"), "UTF-8")
    number = lambda name: F.regexp_extract(fields, rf"(?m)^{name}: (-?[0-9]+)", 1)
    is_response = F.col("response.record_type") == "response"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    b32 = F.substring(F.col("response.payload_digest"), 6, 32)
    hex_of = F.lower(F.concat(*[F.lpad(F.conv(F.concat(*[F.lpad(F.conv(F.instr(F.lit(alphabet), F.substring(b32, 4 * g + k + 1, 1)) - 1, 10, 2), 5, "0") for k in range(4)]), 2, 16), 5, "0") for g in range(8)]))
    return captures.select(
        F.when(number("page-id") != "", number("page-id").cast("long")).alias("page_id"),
        F.when(is_response, F.octet_length("response.body")).otherwise(number("payload-bytes").try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(is_response, F.sha1("response.body")).otherwise(hex_of).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(~is_response, F.regexp_extract("response.refers_to", r"capture:(-?[0-9]+):", 1).try_cast("long")).alias("refers_to"),
        F.from_json(F.concat(F.lit('{"url":'), F.nullif(F.regexp_extract(fields, r"(?m)^url: (.*)$", 1), F.lit("")), F.lit("}")), "url string")["url"].alias("url"),
    )
