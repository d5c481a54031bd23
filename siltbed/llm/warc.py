"""9. WARC archives by way of a chunked record table.

Payloads travel as rows of (record, chunk number, bytes), at most `chunk` bytes
each, so neither writer nor reader holds a whole record; both carry digests from
chunk to chunk. Each map task writes one archive (gzip, a member for each record)
in the shared folder, under a name that a repeated task overwrites. Of records
with equal payloads the one with the least id is the response; the others refer
to it. Reading gives the chunk table back, with the digest so far in each row.

Defined cases: null html: an empty payload; null url: no target; null page_id
sorts first and is written as such; rows that repeat id and payload are all
responses, as none has a smaller id; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import base as b

CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNKS = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, is_last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(i: int) -> bytes:
    return b"null" if i == b.NULL_ID else b"%d" % i


def record_table(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int, chunk: int) -> DataFrame:
    """The chunk rows to write, those of a record one after the other.

    Payloads are cut into chunks where they are read. Which records are revisits is told from ids, digests and sizes alone,
    so no whole payload is sorted or sent; a payload that is sent goes by the record's own key, which no group of equal
    pages shares."""
    payload = F.coalesce(F.encode(F.col(f"`{html_col}`"), "utf-8"), F.lit(b""))
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(b.NULL_ID)).alias("id")
    narrow = pages.select(id_, F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size")).where(F.col("size") >= least)
    first = narrow.groupBy("sha", "size").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    revisits = narrow.join(b.written(first.select("sha", "size", "first"), "first-pages"), ["sha", "size"]).where("id <> first")
    revisits = b.written(revisits.select("id", "sha", F.col("first").alias("refers")).distinct(), "revisits")

    rows = pages.select(id_, F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int")
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    parts = parts.select("id", "row", "url", "sha", "size", "chunk_no", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))
    typed = parts.join(revisits, ["id", "sha"], "left").where(F.col("refers").isNull() | (F.col("chunk_no") == 0))
    data = F.when(F.col("refers").isNull(), F.col("data")).otherwise(F.lit(b""))
    return typed.select("id", "row", "url", "sha", "size", "refers", "chunk_no", data.alias("data")).sortWithinPartitions("id", "row", "chunk_no")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a URI as Hadoop writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, chunk: int = 1 << 20, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Writes the archives below folder and returns their paths, one for each task that had rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _file_system(folder)
        task = TaskContext.get()
        name, temporary = f"{at}/{task.partitionId():06d}.warc.gz", f"{at}/_{task.partitionId():06d}-{task.taskAttemptId()}"
        out, records, packer, seen = None, 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(temporary)
                if r["chunk_no"] == 0:
                    packer, seen = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    records += 1
                    http = _HTTP % r["size"] if r["refers"] is None else _HTTP % 0
                    head = [
                        b"WARC/1.1",
                        b"WARC-Type: " + (b"response" if r["refers"] is None else b"revisit"),
                        b"WARC-Record-ID: <urn:page:%b>" % _name(r["id"]),
                        b"WARC-Date: " + date.encode(),
                        b"WARC-Payload-Digest: sha1:" + base32(bytes.fromhex(r["sha"])).encode(),
                        b"X-Payload-Length: %d" % r["size"],
                        b"Content-Type: application/http; msgtype=response",
                        b"Content-Length: %d" % (len(http) + (r["size"] if r["refers"] is None else 0)),
                    ]
                    if r["url"] is not None:
                        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], r["url"].encode()))
                    if r["refers"] is not None:
                        head.append(b"WARC-Refers-To: <urn:page:%b>" % _name(r["refers"]))
                        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    out.write(packer.compress(CRLF.join([*head, b"", http])))
                    done = 0
                out.write(packer.compress(r["data"]))
                seen.update(r["data"])
                done += len(r["data"])
                if r["refers"] is not None or done == r["size"]:
                    if r["refers"] is None and seen.hexdigest() != r["sha"]:
                        raise ValueError(f"chunks of record {r['id']} came out of order")
                    out.write(packer.compress(CRLF + CRLF) + packer.flush())
        if out is not None:
            out.close()
            system.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{task.partitionId():06d}.warc.gz"]), pa.array([records], pa.int64())], ["path", "records"])

    rows = record_table(pages, id_col, url_col, html_col, least, chunk)
    return sorted(r["path"] for r in rows.mapInArrow(write, "path string, records long").collect())


def parse(path: str, chunk: int) -> Iterator[dict]:
    """The chunk rows of one archive."""
    system, at = _file_system(path)
    with system.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if line in (CRLF, b"\n"):
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"{path}: not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (CRLF, b"\n", b""):
                key, _, value = line.partition(b":")
                head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
            left = int(head[b"content-length"])
            while left > 0:  # the HTTP header
                line = f.readline(min(left, 65536))
                left -= len(line)
                if line in (CRLF, b"\n", b""):
                    break
            number = lambda s: b.NULL_ID if s == "null" else int(s)
            record = {
                "record_id": number(head[b"warc-record-id"][10:-1]), "url": head.get(b"warc-target-uri"), "record_type": head[b"warc-type"],
                "refers_to": number(head[b"warc-refers-to"][10:-1]) if b"warc-refers-to" in head else None,
                "payload_bytes": int(head[b"x-payload-length"]), "payload_digest": head[b"warc-payload-digest"].removeprefix("sha1:"),
            }
            seen, n, size = hashlib.sha1(), 0, 0
            while True:
                data = f.read(min(left, chunk))
                if left and not data:
                    raise ValueError(f"{path}: truncated record {record['record_id']}")
                left -= len(data)
                seen.update(data)
                size += len(data)
                if not left and record["record_type"] == "response" and base32(seen.digest()) != record["payload_digest"]:
                    raise ValueError(f"{path}: digest of record {record['record_id']} differs")
                yield record | {"chunk_no": n, "data": data, "bytes_so_far": size, "digest_so_far": base32(seen.digest()), "is_last": not left}
                n += 1
                if not left:
                    break


def read_warc(spark: SparkSession, paths: list[str], chunk: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives; one task for each archive."""
    kinds = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in parse(path, chunk):
                    held += len(row["data"])
                    rows.append(row if with_data else row | {"data": None})
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(read, CHUNKS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = b.shared_dir(spark, "warc")
    paths = write_warc(b.read(spark, sf_dir, "pages"), folder)
    chunks = read_warc(spark, paths, with_data=False).where("is_last")
    return chunks.select(b.unkeyed("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", b.unkeyed("refers_to").alias("refers_to"))
