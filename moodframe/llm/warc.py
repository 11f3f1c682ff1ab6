"""WARC archives through a chunked record table (operator 7).

A payload is cut where it is scanned and travels as rows of (record, chunk
number, at most CHUNK bytes), never as one value: the writer appends the chunks
of a record to an archive as they come, the reader cuts an archive into the same
rows as it streams through it, each with the digest of the payload so far.
Neither holds more than a chunk of a record.

Of equal payloads from ``least`` bytes on, the record with the largest page_id
is the response and the others revisit it; which those are is an aggregate over
a slim table of ids, sizes and digests, joined to chunk rows by record. Smaller
payloads are written where they are scanned.

Archives lie in a folder that all executors share, opened through pyarrow's
file systems. A task writes archives of its own attempt's name, so that a task
that is repeated meets none of another; the list of archives is itself a written
table, and what isn't in it was never completed. Each record is a gzip member of
its own, as is usual for WARC; compression and decompression are streamed too.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

CHUNK = 16 << 10           # 10,000 such rows, an Arrow batch, are 160 MB
ARCHIVE_BYTES = 256 << 20       # an archive is closed behind the record that passes this
LEVEL = 3                       # of compression
ROWS_OUT = 256                  # chunk rows in one Arrow batch
REVISIT_LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f0a3a4e-8c0b-4f0e-9a52-6c1f3b0d7e11")


def record_id(page: str | None, sha256: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{sha256}')}>"


# ---- deciding and cutting ----------------------------------------------------
def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("n_bytes", F.octet_length("payload").cast("long"))


def revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, sha256, refers_to (page_id of the response) of the records that
    revisit another, once each."""
    slim = _payloads(pages).where(F.col("n_bytes") >= least).select("page_id", F.sha2("payload", 256).alias("sha256"))
    slim = written(slim, "warc-payloads")
    same = slim.groupBy("sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return slim.join(same, "sha256").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha256", "refers_to").distinct()


def chunk_rows(pages: DataFrame, least: int = REVISIT_LEAST, size: int = CHUNK) -> DataFrame:
    """page_id, url, n_bytes, sha1, sha256, refers_to, chunk_no, data: the
    payloads in numbered chunks, a record's next to each other; a revisit has
    one empty chunk, since its record carries no payload."""
    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.monotonically_increasing_id().alias("row"))
        rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / size) - 1, F.lit(0)).cast("int"))))
        return rows.select("page_id", "url", "n_bytes", "sha1", "sha256", "row", "chunk_no", F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))
    rows, to = _payloads(pages), revisits(pages, least).select(F.col("page_id").alias("_p"), F.col("sha256").alias("_s"), "refers_to")
    small = cut(rows.where(F.col("n_bytes") < least)).withColumn("refers_to", F.lit(None).cast("long"))
    large = cut(rows.where(F.col("n_bytes") >= least))
    large = large.join(to, large["page_id"].eqNullSafe(to["_p"]) & (large["sha256"] == to["_s"]), "left").where("refers_to is null or chunk_no = 0")
    large = large.withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b""))).sortWithinPartitions("sha256", "page_id", "row", "chunk_no")
    names = ["page_id", "url", "n_bytes", "sha1", "sha256", "refers_to", "chunk_no", "data"]
    return small.select(*names).unionByName(large.select(*names))


# ---- writing -------------------------------------------------------------------
def _head(row: dict) -> bytes:
    """Everything of a record before its payload."""
    base32 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    revisit = row["refers_to"] is not None
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    page = None if row["page_id"] is None else str(row["page_id"])
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, row["sha256"])), ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32}"),
              ("Content-Length", str(len(http) + (0 if revisit else row["n_bytes"])))]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]")))
    if page is not None:
        fields.append(("X-Page-Id", page))
    if revisit:
        fields += [("WARC-Refers-To", record_id(str(row["refers_to"]), row["sha256"])), ("WARC-Profile", PROFILE)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode()


class _Archives:
    """The archives one task writes, one after another."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.part, self.attempt, self.n, self.out = part, attempt, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def open(self) -> None:
        self.name = f"part-{self.part:05d}-{self.attempt}-{self.n:05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.n, self.records, self.size, self.member = self.n + 1, 0, 0, None

    def begin(self) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.records += 1

    def write(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.out = None
        return self.name, self.records, self.size


def write_archives(cut: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the chunk rows (a record's chunks in order, next to each other)
    as archives into ``folder``; gives archive, n_records, n_bytes of each."""
    def run(batches):
        context = TaskContext.get()
        to = _Archives(folder, context.partitionId(), context.taskAttemptId())
        done = []
        for b in batches:
            for row in b.to_pylist():
                if row["chunk_no"] == 0:
                    if to.out is not None:
                        to.end()
                        if to.size >= archive_bytes:
                            done.append(to.close())
                    if to.out is None:
                        to.open()
                    to.begin()
                    to.write(_head(row))
                to.write(row["data"])
        if to.out is not None:
            to.end()
            done.append(to.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    return written(cut.mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-archives")


# ---- reading ---------------------------------------------------------------------
class Members:
    """The bytes of a stream of gzip members, at most so many at a time."""

    def __init__(self, stream):
        self.stream, self.member, self.raw = stream, None, b""

    def read(self, size: int) -> bytes:
        while True:
            if self.member is None:
                self.raw = self.raw or self.stream.read(size)
                if not self.raw:
                    return b""
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(self.raw, size)
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, None
            else:
                self.raw = self.member.unconsumed_tail
            if out:
                return out
            if self.member is not None and not self.raw:
                self.raw = self.stream.read(size)
                if not self.raw:
                    raise ValueError("an archive that ends within a member")


class _Stream:
    """Reads lines and bounded pieces from a stream."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.have = stream, size, b""

    def _more(self) -> bool:
        new = self.stream.read(self.size)
        self.have += new
        return bool(new)

    def head(self) -> list[str] | None:
        """Lines up to an empty one; None at the end."""
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise ValueError("an archive that ends within a record")
                return None
        lines, self.have = self.have[:end], self.have[end + 4:]
        return lines.decode().split("\r\n")

    def take(self, n: int) -> bytes:
        if not self.have:
            self._more()
        out, self.have = self.have[:n], self.have[n:]
        if not out and n:
            raise ValueError("an archive that ends within a record")
        return out


def records_of(stream, size: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of one archive, from a stream; raises ValueError where
    the archive isn't well-formed or a payload differs from its digest."""
    s = _Stream(stream, size)
    while (lines := s.head()) is not None:
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        http = s.head()
        if http is None or not http[0].startswith("HTTP/"):
            raise ValueError("a record without a response in it")
        left = int(fields["Content-Length"]) - len("\r\n".join(http).encode()) - 4
        declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        row = {"record_id": fields["WARC-Record-ID"], "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
               "record_type": fields["WARC-Type"], "refers_to_record": fields.get("WARC-Refers-To"), "declared": declared}
        sha1, n, number, open_ = hashlib.sha1(), 0, 0, b""
        while True:
            while left and len(open_) < size:
                got = s.take(min(size - len(open_), left))
                open_ += got
                left -= len(got)
            sha1.update(open_)
            n += len(open_)
            yield row | {"chunk_no": number, "data": open_, "bytes_so_far": n, "sha1_so_far": sha1.hexdigest(), "last": not left}
            if not left:
                break
            number, open_ = number + 1, b""
        if row["record_type"] == "response" and sha1.hexdigest() != declared:
            raise ValueError(f"{row['record_id']}: the payload differs from its digest")
        gap = b""
        while len(gap) < 4:
            gap += s.take(4 - len(gap))
        if gap != b"\r\n\r\n":
            raise ValueError("a record without an end")


_ROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("declared", pa.string()),
                  ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())])


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives: record_id, page_id,
    record_type, refers_to_record, declared (digest), chunk_no, data,
    bytes_so_far, sha1_so_far, last. Without ``payload`` only each record's
    last row, with null data. An archive is one task's work."""
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in records_of(Members(stream)):
                        if payload or row["last"]:
                            rows.append(row if payload else row | {"data": None})
                        if len(rows) == (ROWS_OUT if payload else 20 * ROWS_OUT):
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    n = archives.count()
    return archives.select("archive").repartition(max(1, n), "archive").mapInArrow(
        run, "record_id string, page_id long, record_type string, refers_to_record string, declared string, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, last boolean")


def page_records(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per
    record; a revisit takes size and digest from the record it refers to."""
    last = written(table.where("last").select("record_id", "page_id", "record_type", "refers_to_record", "declared", "bytes_so_far", "sha1_so_far"), "warc-records")
    target = last.where("record_type = 'response'").groupBy(F.col("record_id").alias("_r")).agg(F.max("page_id").alias("target"), F.max("bytes_so_far").alias("n"), F.max("sha1_so_far").alias("d"))
    revisits = last.where("record_type = 'revisit'").join(target, F.col("refers_to_record") == F.col("_r"), "left")
    broken = F.raise_error(F.concat(F.lit("a revisit of a record that isn't there: "), "record_id"))
    revisits = revisits.select("page_id", F.when(F.col("d") == F.col("declared"), F.col("n")).otherwise(broken.cast("long")).alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("target").alias("refers_to"))
    plain = last.where("record_type = 'response'").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(revisits)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` and reads the archives back:
    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.

    A null html is an empty payload, a null url is left out, a null page_id
    stays null and is never the response that others revisit. Rows that repeat
    page_id and payload get a record each, of the same type. An empty table
    gives no archive and no row.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    archives = write_archives(chunk_rows(pages, least), folder, archive_bytes)
    return page_records(read_archives(archives, folder, payload=False))
