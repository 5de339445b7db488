"""WARC archives: a writer with identical-payload revisits and a sequential reader.

Every record is a gzip member of its own. The reader takes bytes in blocks, decompresses one member at a time, frames
the record by its Content-Length, and checks the payload digest of every response; it holds one block and one header,
never a whole archive or payload.

Of rows whose payloads are equal, those with the smallest page_id are responses (rows that repeat that page_id too) and
the others revisit it; payloads below `least` bytes are always responses. A null html is an empty payload, a null url
has no target URI, a null page_id counts as larger than any other and has no id header; ids of any characters are encoded byte
by byte, and WARC-Record-ID also has the record's place, so that rows which repeat a page_id stay apart. Archives go to the folder that all executors share,
under names made from run and task, so that a repeated task replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import new_path, prepare, table, written

BLOCK = 1 << 16
#: Bytes after which a task begins another archive.
ARCHIVE = 256 << 20
#: A payload that this share of the rows has gets its decision by broadcast: there are at most 1 / HOT of them.
HOT = 0.001
DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_path(path: str, mode: str):
    """Open a path of the shared folder from an executor."""
    if path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), mode)
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_stream(name) if "r" in mode else where.open_output_stream(name)


def publish(temporary: str, path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        os.replace(*(re.sub("^file:/*", "/", p) for p in (temporary, path)))
        return
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    where.move(fs.FileSystem.from_uri(temporary)[1], name)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encoded(page_id: str) -> str:
    """An id as it stands in a header: bytes that are not plain by their numbers."""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or chr(b) in "-._~" else f"%{b:02X}" for b in page_id.encode())


def decoded(text: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, row: str = "0") -> bytes:
    """One WARC record as one gzip member. `row` tells rows of one page_id apart in WARC-Record-ID; a null id has no header."""
    uri = lambda x: f"<urn:palimpsest:page:{x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:palimpsest:record:{'' if page_id is None else encoded(page_id)}:{row}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {uri(encoded(page_id))}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if revisit:
        head.append(f"WARC-Profile: {SAME_PAYLOAD}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {uri(encoded(refers_to))}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class Members:
    """Decompressed bytes of a stream of gzip members; each member ends where its record ends."""

    def __init__(self, stream):
        self.stream, self.raw, self.unzip, self.ready = stream, b"", None, b""

    def fill(self) -> bool:
        """Get more decompressed bytes of this member; False at its end."""
        while True:
            if self.unzip is not None and self.unzip.eof:
                return False
            self.raw = self.raw or self.stream.read(BLOCK)
            if self.unzip is None:
                if not self.raw:
                    return False
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.raw, 4 * BLOCK)
            if not (got or self.raw or self.unzip.eof):
                raise ValueError("archive ends within a record")
            self.raw = self.unzip.unconsumed_tail or self.unzip.unused_data
            if got:
                self.ready += got
                return True

    def begin(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.unzip, self.ready = None, b""
        return self.fill()

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.fill():
                raise ValueError("record without end of header")
        found, self.ready = self.ready.split(mark, 1)
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.fill():
                raise ValueError("record is shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream) -> Iterator[tuple[str | None, int, str, str, str | None]]:
    """(page_id, payload bytes, payload digest, type, refers to) of every record, digests verified."""
    name = lambda x: None if x is None else decoded(re.fullmatch(r"<urn:palimpsest:page:(.*)>", x)[1])
    members = Members(stream)
    while members.begin():
        head = fields(members.until(b"\r\n\r\n"))
        left = int(head["content-length"])
        http = members.until(b"\r\n\r\n")
        left -= len(http) + 4
        digest, block = hashlib.sha1(), hashlib.sha1(http + b"\r\n\r\n")
        size = 0
        for part in members.take(left):
            digest.update(part)
            block.update(part)
            size += len(part)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.fill() or members.ready:
            raise ValueError("record does not end with its member")
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-block-digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise ValueError(f"block digest of {head['warc-record-id']} does not match")
        if head["warc-type"] == "revisit":
            yield name(head.get("x-page-id")), int(fields(http)["content-length"]), stated, "revisit", name(head.get("x-refers-to-page"))
        else:
            if base64.b32encode(digest.digest()).decode() != stated:
                raise ValueError(f"payload digest of {head['warc-record-id']} does not match")
            yield name(head.get("x-page-id")), size, stated, "response", None


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, first (smallest page_id with this payload) and repeated (whether others have it)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    shared = written(rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    limit = shared.agg(F.coalesce(F.sum("n"), F.lit(0)) * HOT).first()[0]
    hot = shared.where(F.col("n") > limit).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cold = shared.where(F.col("n") <= limit).select(F.col("digest").alias("cold_key"), F.col("first").alias("cold_first"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(cold, F.col("key") == F.col("cold_key"), "left")
    found = F.col("hot_digest").isNotNull() | F.col("cold_key").isNotNull()
    first = F.coalesce("hot_first", "cold_first")
    return rows.select("page_id", "url", "html", first.alias("first"), (found & ~F.col("page_id").eqNullSafe(first)).alias("revisit"))


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of pages(page_id, url, html); a row for each: path, records, bytes."""
    spark = prepare(pages.sparkSession)
    folder = new_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, out, stats = 0, None, []

        def close():
            out.close()
            publish(temporary, path)
            stats.append((path, n, size))

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                    temporary = f"{path}.{task.taskAttemptId()}.tmp"
                    out, n, size = open_path(temporary, "wb"), 0, 0
                payload = html.encode()
                size += out.write(record(page_id, url, payload, base32_sha1(payload), first, revisit, f"{task.partitionId()}.{part}.{n}"))
                n += 1
                if size >= ARCHIVE:
                    close()
                    part, out = part + 1, None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in stats], pa.string()), pa.array([x[1] for x in stats], pa.int64()), pa.array([x[2] for x in stats], pa.int64())], ["path", "records", "bytes"])

    rows = decide(pages, least).select(F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string"), "revisit")
    return written(rows.mapInArrow(save, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of archives(path): page_id string, payload_bytes, payload_digest, record_type, refers_to."""
    spark = archives.sparkSession
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_path(path, "rb") as stream:
                    for x in read_records(stream):
                        rows.append(x)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return archives.select("path").repartition(spread).mapInArrow(load, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op10_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    rows = read(write(pages))
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: Base 32 of a SHA-1 in SQL: hexadecimal digits to bits, five bits to a letter.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
        4 * (instr('0123456789abcdef', substr(hex, i::int, 1)) - 1)::int + 1, 4)), 'string_agg', '') AS bits FROM d),
e AS (SELECT page_id, payload_bytes, hex, list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (16 * substr(bits, i::int + 1, 1)::int + 8 * substr(bits, i::int + 2, 1)::int + 4 * substr(bits, i::int + 3, 1)::int
         + 2 * substr(bits, i::int + 4, 1)::int + substr(bits, i::int + 5, 1)::int) + 1, 1)), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT hex, min(page_id) AS first FROM e GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM e JOIN f USING (hex)
"""
