"""WARC archives: one gzip member per record, an index beside them, and reads by coalesced byte ranges.

Writing: records whose payload (of at least ``min_bytes``) equals that of a record with a smaller identifier become
revisits without payload. Each write task streams one archive into the shared folder and returns the index: archive,
offset, length, URL, digest. The index is a Parquet table written with the archives. Reading: the selected index rows
are dealt out by archive and stretch of it, sorted by offset, and ranges that lie next to each other are read at once.
The number of reading tasks follows the bytes that the rows point at, not the rows' own.

Null payloads are empty, null URLs are left out of the record, line ends in URLs are percent-encoded. Rows that repeat
the smallest identifier of equal payloads are all responses; a null identifier is larger than any other. A long payload
is one record, held whole by the task that writes or reads it. An empty table gives no archives. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agromix.llm.common import mapped, materialise, open_input, open_output, scratch, skew_safe_lookup, tasks_for, text_of

__all__ = ["parse_record", "read_warc", "record_bytes", "write_warc"]

INDEX = "archive string, offset long, length long, url string, digest string"
RECORDS = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(one: int | None) -> str:
    return f"<urn:record:{'none' if one is None else one}>"


def _identifier(name: str) -> int | None:
    one = name.strip("<>").rpartition(":")[2]
    return None if one == "none" else int(one)


def record_bytes(one: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(one)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(id, url, type, refers_to, bytes and digest of the full payload, payload or None), checked against its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return _identifier(fields["warc-record-id"]), fields.get("warc-target-uri"), "revisit", _identifier(fields["warc-refers-to"]), size, digest, None
    if len(payload) != size or (found := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return _identifier(fields["warc-record-id"]), fields.get("warc-target-uri"), "response", None, size, found, payload


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        with open_output(folder, "archive", ".warc.gz") as (uri, out):
            at, batch = 0, first
            while batch is not None:
                rows = []
                for one, url, payload, digest, refers_to, revisit in zip(*(c for c in batch.columns), strict=True):
                    digest, url = digest.as_py(), url.as_py()
                    data = gzip.compress(record_bytes(one.as_py(), url, payload.as_py(), digest, refers_to.as_py(), revisit.as_py()), level, mtime=0)
                    out.write(data)
                    rows.append((uri, at, len(data), url, digest))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["archive", "offset", "length", "url", "digest"])
                batch = next(batches, None)

    return run


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, level: int = 4, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns their index, read from its own table."""
    spark = pages.sparkSession
    body = text_of(payload_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    long_enough = rows.filter(F.octet_length("payload") >= min_bytes)
    groups = long_enough.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    found = skew_safe_lookup(rows, materialise(groups), "digest", "n", "id")
    revisit = F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    found = found.select("id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return materialise(mapped(found, _writer(folder or scratch(spark), level), INDEX))


def _reader(gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        archive, source = None, None
        for batch in batches:
            spans = list(zip(batch.column("archive").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            i = 0
            while i < len(spans):
                name, begin, length = spans[i]
                j, end = i + 1, begin + length
                while j < len(spans) and spans[j][0] == name and 0 <= spans[j][1] - end <= gap and spans[j][1] + spans[j][2] - begin <= most:
                    end = spans[j][1] + spans[j][2]
                    j += 1
                if name != archive:
                    if source is not None:
                        source.close()
                    archive, source = name, open_input(name)
                source.seek(begin)
                data = memoryview(source.read(end - begin))
                rows = [parse_record(gzip.decompress(data[at - begin : at - begin + n])) for _, at, n in spans[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                i = j
        if source is not None:
            source.close()

    return run


def read_warc(spark: SparkSession, index: DataFrame, stretch: int = 16 << 20, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records that the rows of ``index`` (or those selected from it) point at, payloads verified."""
    part = F.floor(F.col("offset") / stretch)
    total = index.agg(F.sum("length")).first()[0]
    dealt = index.select("archive", "offset", "length", part.alias("stretch")).repartition(tasks_for(total, stretch), "archive", "stretch").sortWithinPartitions("archive", "offset")
    return mapped(dealt, _reader(gap, most), RECORDS)
