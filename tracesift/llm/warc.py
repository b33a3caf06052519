"""WARC archives through a table of chunks.

Writing. A payload leaves the JVM as rows (record, chunk number, bytes), a chunk at most `chunk` bytes, so
no Python worker ever holds a whole record; a record's chunks follow each other and are streamed into one
gzip member each. Of records with equal payloads the one with the smallest id is a response, the others
revisit it and carry no payload. Archives are named by task attempt and listed in a table once the task is
committed; what a lost attempt left is not listed.

Reading. Archives are streamed. Each payload comes back as chunk rows that carry the SHA-1 of the payload
up to and including the chunk, so the last row has the digest of the whole; it is checked against the
record's header.

Defined cases: a null html is an empty payload; a null id counts as greater than any; rows that share the
smallest id are all responses; records whose ids are all null are responses; a null url is written as an
empty target; a payload of any length is cut into chunks and never held whole by Python; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, table

#: Bytes of a payload chunk, and of an archive (compressed) before the next begins.
CHUNK, ARCHIVE = 1 << 20, 1 << 30
#: Fixed: archives carry no clock time, so that equal tables give equal records.
DATE = "2000-01-01T00:00:00Z"

_CHUNKS = "record_id long, url string, record_type string, refers_to long, payload_bytes long, chunk_no int, last boolean, prefix_sha1 string, data binary"


def decide(pages: DataFrame, least_bytes: int = 0, stored: str | None = None) -> DataFrame:
    """Adds payload, payload_bytes, sha1 (hex), record_type and refers_to; payloads meet by digest and size only."""
    rows = pages.select(F.col("page_id").alias("record_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    groups = rows.select("record_id", "payload_bytes", "sha1").groupBy("sha1", "payload_bytes").agg(F.min("record_id").alias("first_id"))
    if stored is not None:
        groups.write.parquet(stored)  # so that both sides of the join are plain shuffles, and many equal payloads can be split
        groups = pages.sparkSession.read.schema(groups.schema).parquet(stored)
    rows = rows.join(groups, ["sha1", "payload_bytes"])
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return rows.select("record_id", "url", "payload", "payload_bytes", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def chunk_rows(decided: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of a response's payload, in order; revisits and empty payloads give one empty row."""
    kept = F.when(F.col("record_type") == "response", F.col("payload").cast("binary")).otherwise(F.lit(b""))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(kept) / chunk).cast("int") - 1))
    rows = decided.withColumn("kept", kept).select("*", F.explode(steps).alias("chunk_no"))
    data = F.expr(f"substring(kept, chunk_no * {chunk} + 1, {chunk})")
    return rows.select("record_id", "url", "payload_bytes", "sha1", "record_type", "refers_to", "chunk_no", F.octet_length("kept").alias("kept_bytes"), data.alias("data"))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header(record_id, url, payload_bytes, sha1, record_type, refers_to, kept_bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    uri = url.replace("\r", "%0D").replace("\n", "%0A").replace("\t", "%09")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {uri}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"Content-Length: {len(http) + kept_bytes}", f"X-Record-Number: {'' if record_id is None else record_id}",
    ]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Number: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches, folder: str, archive: int):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    out, packer, name, n, size, written, left = None, None, None, 0, 0, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("record_id", "url", "payload_bytes", "sha1", "record_type", "refers_to", "kept_bytes"))
        numbers, data = batch.column("chunk_no").to_pylist(), batch.column("data")
        for k, row in enumerate(zip(*columns, strict=True)):
            if numbers[k] == 0:
                if out is None:
                    files.create_dir(path, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                packer, left = zlib.compressobj(2, zlib.DEFLATED, 31), row[6]
                size += out.write(packer.compress(_header(*row))) or 0
            piece = data[k].as_buffer()
            left -= piece.size
            done = packer.compress(piece)
            if left == 0:
                done += packer.compress(b"\r\n\r\n") + packer.flush()
                n += 1
            out.write(done)
            size += len(done)
            if left == 0 and size >= archive:
                out.close()
                written.append((name, n))
                out = None
    if out is not None:
        out.close()
        written.append((name, n))
    yield pa.record_batch([pa.array([x[0] for x in written], pa.string()), pa.array([x[1] for x in written], pa.int64())], names=["archive", "records"])


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Writes the archives under `folder` and returns their list (archive, records), itself a stored table there."""
    arrow_batches(spark, 64)
    rows = chunk_rows(decide(pages, least_bytes, f"{folder}/groups"), chunk)
    rows.mapInArrow(partial(_write, folder=f"{folder}/archives", archive=archive), "archive string, records long").write.parquet(f"{folder}/list")
    return spark.read.parquet(f"{folder}/list")


class _Members:
    """Bytes of a .warc.gz, member after member, inflated as they are asked for."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.raw, self.ready, self.unpacker = stream, step, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.ready:
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    return False
            self.ready = self.unpacker.decompress(self.raw, self.step)
            self.raw = self.unpacker.unconsumed_tail if not self.unpacker.eof else b""
        return True

    def read(self, n: int) -> bytes:
        """Up to n bytes; fewer only where the archive ends."""
        out = io.BytesIO()
        while n and self._more():
            part, self.ready = self.ready[:n], self.ready[n:]
            out.write(part)
            n -= len(part)
        return out.getvalue()

    def head(self) -> list[bytes]:
        """Header lines up to an empty one; none where the archive ends."""
        got = b""
        while b"\r\n\r\n" not in got:
            if not self._more():
                if got.strip():
                    raise ValueError("a record is cut off")
                return []
            got, self.ready = got + self.ready, b""
        head, _, self.ready = got.partition(b"\r\n\r\n")
        return head.split(b"\r\n")


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}


def _read(batches, folder: str, chunk: int, with_data: bool):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                members, rows = _Members(stream, min(chunk, 1 << 18)), []
                while head := members.head():
                    record = _fields(head)
                    http = members.head()
                    total = int(_fields(http)["content-length"])
                    kept = int(record["content-length"]) - sum(len(x) + 2 for x in http) - 2
                    number, refers = record["x-record-number"], record.get("x-refers-to-number")
                    digest, left, chunk_no = hashlib.sha1(), kept, 0
                    while True:
                        data = members.read(min(chunk, left))
                        digest.update(data)
                        left -= len(data)
                        if left and not data:
                            raise ValueError("a payload is cut off")
                        prefix = base64.b32encode(digest.digest()).decode()
                        stated = record["warc-payload-digest"].removeprefix("sha1:")
                        if left == 0 and record["warc-type"] == "response" and (prefix != stated or kept != total):
                            raise ValueError("a payload does not have its digest")
                        rows.append((int(number) if number else None, record["warc-target-uri"], record["warc-type"], int(refers) if refers else None, total, chunk_no, left == 0, prefix if kept or record["warc-type"] == "response" else stated, data if with_data else None))
                        chunk_no += 1
                        if with_data or len(rows) >= 1000:
                            yield _batch(rows)
                            rows = []
                        if left == 0:
                            break
                    if members.read(4) != b"\r\n\r\n":
                        raise ValueError("a record does not end where its length says")
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "chunk_no", "last", "prefix_sha1", "data"]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_archives(listed: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives: a row for each payload chunk, in order within its record."""
    tasks = max(1, listed.count())  # stated, so that adaptive execution does not merge the few rows into one task
    return listed.select("archive").repartitionByRange(tasks, "archive").mapInArrow(partial(_read, folder=f"{folder}/archives", chunk=chunk, with_data=with_data), _CHUNKS)


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").base
    listed = write_archives(spark, table(spark, sf_dir, "pages"), folder)
    last = read_archives(listed, folder, with_data=False).filter("last")
    return last.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("prefix_sha1").alias("payload_digest"), "record_type", "refers_to")


#: Base32 of the SHA-1: DuckDB has hex only, so eight digits are cut from each 40 bits by arithmetic.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p),
q AS (SELECT *, list_transform(range(0, 4), lambda k: CAST('0x' || x[10 * k + 1:10 * k + 10] AS UBIGINT)) AS v FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((v[j // 8 + 1] >> CAST(35 - 5 * (j % 8) AS UBIGINT)) & 31 AS BIGINT) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
