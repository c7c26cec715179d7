"""WARC archives: written with an index, read back by coalesced byte ranges of the records that the index selects.

Records are gzip members of their own, so a byte range holds whole records. The index has each record's file, offset,
length, URL and payload digest. Reads are planned from it alone: a file's selected records are sorted by offset, and
those with little between them share one range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.llm.shared import open_store, scratch, shuffle_partitions, spread_join, written

#: Unwanted bytes that a range may span between two records, and bytes after which a new range begins.
GAP_BYTES, RANGE_BYTES = 65_536, 16_000_000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """An uncompressed response record, or a revisit of `refers_to`, and its payload digest."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:record:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """A record's fields; raises ValueError where a length or digest differs from what the record says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is damaged")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n_bytes or sha1_base32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    urn = lambda x: x.removeprefix("<urn:record:").removesuffix(">") or None if x else None
    return {"record_id": urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": urn(fields.get("WARC-Refers-To")), "payload": None if revisit else payload, "payload_bytes": n_bytes, "payload_digest": digest}


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, payload, refers_to): of equal payloads of `least` bytes or more, all but those with the largest id refer to it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("id").alias("response"), F.count("*").alias("rows")).where("rows > 1")
    repeated = written(repeated, "repeated-payloads")
    joined = spread_join(rows, repeated.drop("rows"), ["key"], F.xxhash64("id", "url"), "left", repeated.select("key", "rows"))
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for every row to .warc.gz files in `folder`; returns the written index.

    Null payloads are empty; a null URL has no target field; a null id is empty and is never referred to. Rows that
    share the largest id of equal payloads are all responses. Payloads of any length are written whole; one is in memory at a time. A file is named by its task's attempt and indexed only if that ended well. Other columns
    are not read; an empty table gives an empty index.
    """
    rows = with_revisits(pages, id_col, url_col, payload_col, least)
    rows = rows.select(F.col("id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        store, path = open_store(name)
        out, offset = None, 0
        for batch in batches:
            found = []
            for record_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, digest = record(record_id or "", url, payload.encode(), refers_to)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out = out or store.open_output_stream(path, compression=None)
                out.write(member)
                found.append((name, offset, len(member), url, digest, "response" if refers_to is None else "revisit", record_id))
                offset += len(member)
            if found:
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "length", "url", "digest", "record_type", "record_id"])
        if out:
            out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """(file, first, last, records) of the byte ranges to read: records is the sorted array of (offset, length)."""
    order = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    apart = F.coalesce((F.col("offset") - end > GAP_BYTES) | (F.floor(F.col("offset") / RANGE_BYTES) > F.floor(end / RANGE_BYTES)), F.lit(True))
    numbered = index.select("file", "offset", "length", apart.cast("int").alias("apart"))
    numbered = numbered.withColumn("range", F.sum("apart").over(order))
    return numbered.groupBy("file", "range").agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")
    ).drop("range")


def read(index: DataFrame, selected: Column | None = None) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of the selected records of the index, all if None.

    A revisit has no payload; its length and digest are those of the response it repeats. Raises if a record is damaged.
    """
    wanted = index if selected is None else index.where(selected)
    names = ["record_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as file:
                    data = file.read_at(row["last"] - row["first"], row["first"])
                found = []
                for x in row["records"]:
                    at = x["offset"] - row["first"]
                    found.append(parse(zlib.decompress(data[at : at + x["length"]], 31)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    spread = ranges(wanted).repartition(shuffle_partitions(index.sparkSession))
    return spread.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """write() to a new folder in the shared one, then read() of all records."""
    return read(write(pages, scratch(pages.sparkSession, "warc"), **columns))
