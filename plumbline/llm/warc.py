"""WARC archives and the chunked record table.

Writing: each task writes its records, one gzip member for each, compressed step
by step from the batch that Spark hands over (no copy of a payload is made, the
digest is a column), into archive files of at most about ``FILE_BYTES`` in the
shared folder, through whatever file system the folder's address names. A file
gets its final name when it is complete, and the table of files, which tasks
return, lists only those of attempts that Spark has committed; what a lost
attempt leaves is never read.

Reading: archives are dealt out file by file. A file is inflated as a stream; a
payload comes as rows (record, chunk number, bytes) of at most ``CHUNK_BYTES``,
each with the running length and the SHA-1 of all up to it, so the last chunk's
is the record's, and a reader never holds a record whole. Revisit records have no
payload; what they refer to is in their header.

Equal payloads: the narrow (page_id, SHA-1) pairs are grouped, and only digests
that occur more than once go back to the rows: by broadcast while there are at
most ``BROADCAST_ROWS``, else by a join of narrow rows and then by row key, which
is even. Payloads of fewer than ``least_bytes`` bytes are always responses.

Defined cases: a null payload is empty; rows that repeat a page_id with an equal
payload are all responses if that id is the largest; a null page_id is smaller
than any other; an empty table gives an empty result; extra columns do not
matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.runtime import materialise, scratch_path

FILE_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
BROADCAST_ROWS = 200_000
_STEP = 1 << 16


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def record_parts(page_id, url: str | None, payload, digest: str, refers_to, revisit: bool) -> Iterator[bytes | memoryview]:
    """A record's bytes: header, payload (any buffer, of which no copy is made) in steps, end."""
    payload = memoryview(payload)
    name = lambda i: f"<urn:page:{i}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Target-URI", None if url is None else "".join(c if c > " " else "%20" for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", name(refers_to) if revisit else None),
        ("X-Payload-Length", len(payload)),
        ("Content-Length", 0 if revisit else len(payload)),
    ]
    yield _header(fields)
    if not revisit:
        for i in range(0, len(payload), _STEP):
            yield payload[i : i + _STEP]
    yield b"\r\n\r\n"


def _open(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def _decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """digest and newest page_id of every payload that occurs more than once."""
    narrow = pages.select("page_id", F.sha1(_payload()).alias("digest"), F.octet_length(_payload()).alias("n"))
    grouped = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.count("*").alias("rows"), F.max("page_id").alias("newest"))
    return materialise(grouped.where("rows > 1").select("digest", "newest"), "repeated-payloads")


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url and html as WARC files; returns (path, records, bytes) of each file."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    repeated = _decisions(pages, least_bytes)
    rows = pages.select("page_id", "url", _payload().alias("payload"), F.sha1(_payload()).alias("digest"))
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        narrow = pages.select("page_id", F.sha1(_payload()).alias("digest"))
        older = narrow.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("newest"))).distinct()
        older = older.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "newest")
        rows = rows.join(older, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "payload", "newest", "digest")

    def write(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, done = None, []

        def close():
            nonlocal out
            out[0].close()
            final = out[1].removesuffix(".part")
            system.move(out[1], final)
            done.append((final.removeprefix(root).lstrip("/"), out[2], out[3]))
            out = None

        for batch in batches:
            payloads = (value.as_buffer() for value in batch.column(2))
            for page_id, url, payload, newest, digest in zip(*(batch.column(k).to_pylist() for k in (0, 1)), payloads, *(batch.column(k).to_pylist() for k in (3, 4))):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz.part"
                    out = [system.open_output_stream(path, compression=None), path, 0, 0]
                squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                revisit = newest is not None and newest != page_id
                for part in record_parts(page_id, url, payload, base32_sha1(bytes.fromhex(digest)), newest, revisit):
                    if piece := squeeze.compress(part):
                        out[0].write(piece)
                        out[3] += len(piece)
                last = squeeze.flush()
                out[0].write(last)
                out[2] += 1
                out[3] += len(last)
                if out[3] >= file_bytes:
                    close()
        if out is not None:
            close()
        names, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    files = materialise(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")
    return files.withColumn("path", F.concat(F.lit(folder + "/"), F.col("path")))


class _Inflated:
    """The bytes of a file of gzip members, as a stream with a small buffer."""

    def __init__(self, stream):
        self.stream, self.buffer, self.member, self.rest = stream, bytearray(), None, b""

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(_STEP)
            if not self.rest and self.member is None:
                return False
            if not self.rest:
                self.buffer += self.member.flush()
                self.member = None
                return True
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(self.rest, _STEP)
        self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        if self.member.eof:
            self.member = None
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def read(self, most: int) -> bytes:
        while not self.buffer:
            if not self._more():
                raise EOFError("the archive ends within a record")
        out = bytes(self.buffer[:most])
        del self.buffer[: len(out)]
        return out


def read_chunks(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """(header, chunk number, bytes, length so far, base-32 SHA-1 so far, whether last) of each chunk.

    A record without a payload has one empty chunk.
    """
    source = _Inflated(stream)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header: dict[str, str] = {}
        while line := source.line():
            k, _, v = line.decode().partition(": ")
            header[k] = v
        left, number, sha, so_far = int(header["Content-Length"]), 0, hashlib.sha1(), 0
        while True:
            chunk = bytearray()
            while left and len(chunk) < chunk_bytes:
                part = source.read(min(left, chunk_bytes - len(chunk)))
                chunk += part
                left -= len(part)
            sha.update(chunk)
            so_far += len(chunk)
            yield header, number, bytes(chunk), so_far, base32_sha1(sha.copy().digest()), not left
            number += 1
            if not left:
                break


def chunk_table(files: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``files`` lists; without ``data`` the bytes stay where they are read."""
    keep_data = data
    spark = files.sparkSession
    types = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_())]

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for h, number, data, so_far, sha, last in read_chunks(stream, chunk_bytes):
                        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), number, data if keep_data else None, so_far, sha, last))
                        size += len(data) * keep_data + 200
                        if size > 4 * CHUNK_BYTES:
                            yield _batch(rows, types)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, types)

    schema = "record_id string, record_type string, refers_to string, declared_digest string, declared_bytes long, chunk long, data binary, bytes_so_far long, sha1_so_far string, last boolean"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks).mapInArrow(read, schema)


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


def _page(name: str):
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(.*)>$', 1) as bigint)")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    A response's length and digest are those of the bytes read, as its last
    chunk carries them; a revisit's are those that its header declares.
    """
    last = chunk_table(write_archives(pages), data=False).where("last")
    response = F.col("record_type") == "response"
    return last.select(
        _page("record_id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
