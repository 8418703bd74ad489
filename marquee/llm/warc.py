"""WARC archives: writing pages, and a sequential reader.

Every record is one gzip member.  The reader inflates member by member in
fixed chunks, frames the record by its content length, and checks that the
member ends where the record does and that block and payload digests agree.
Archives go to a folder that driver and executors share, through
``pyarrow.fs``, so any file system URI works.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpoint_dir, materialize

# --- fixed values of the format --------------------------------------------
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100                # smaller payloads are always stored
ROLL_BYTES = 256 << 20           # a task begins a new archive beyond this size
CHUNK = 1 << 16
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff<>\"]")


def _file_system(uri: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _uri(url: str) -> str:
    """Bytes that a header line cannot hold are percent-encoded."""
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode("ascii")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    number = (record_id or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The gzip member of one page; a revisit has no payload, only the HTTP
    header with its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("ascii") + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as archives under ``folder`` and
    return (path, records), already written.

    Of records with equal payloads of at least ``min_revisit`` bytes the one
    with the smallest page_id is a response and the others revisit it.  Null
    html is an empty payload.  Rows with the same smallest page_id are all
    responses; rows with a null page_id revisit a page that has one and are
    responses otherwise; a null url gives no target header.  A task that runs
    again writes the same names anew; files appear under their final name
    only when complete."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = materialize(rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "warc-first")
    marked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first", F.expr("first is not null and not (page_id <=> first)").alias("revisit"))
    folder = folder.rstrip("/")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        part, made, out, size, count, temp = context.partitionId(), 0, None, 0, 0, ""
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out, made
            out.close()
            name = f"part-{part:06d}-{made:04d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            done.append((f"{folder}/{name}", count))
            out, made = None, made + 1

        for batch in batches:
            for page_id, url, payload, digest, first_id, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    temp = f"{root}/.part-{part:06d}-{made:04d}-{context.taskAttemptId()}"
                    out, size, count = fs.open_output_stream(temp, compression=None), 0, 0
                member = record(page_id, url, payload, digest, first_id, revisit, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            paths, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "records"])

    return materialize(marked.mapInArrow(run, "path string, records long"), "warc-files")


class Inflater:
    """Bytes of a file of gzip members, one member after the other."""

    def __init__(self, source):
        self.source, self.left, self.ended = source, b"", False
        self.member = None
        self.ready = bytearray()

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.left:
            self.left = self.source.read(CHUNK)
        if not self.left:
            return False
        self.member = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        if self.member.eof:
            return False
        if not self.left:
            self.left = self.source.read(CHUNK)
            if not self.left:
                raise ValueError("archive ends within a gzip member")
        out = self.member.decompress(self.left, CHUNK * 16)
        self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        self.ready += out
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark."""
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                raise ValueError("record header has no end")
        return self._take(at + len(mark))

    def exactly(self, n: int) -> Iterator[bytes]:
        """n bytes, in chunks."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("record is shorter than its content length")
            chunk = self._take(min(n, len(self.ready)))
            n -= len(chunk)
            if chunk:
                yield chunk

    def _take(self, n: int) -> bytes:
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def finish(self) -> None:
        """The member ends with the record."""
        while self._more():
            pass
        if bytes(self.ready) != b"\r\n\r\n":
            raise ValueError("gzip member does not end with its record")
        self.ready.clear()


def records(source) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record header, HTTP header, payload) of an open archive, verified.
    Header names are in lower case."""
    stream = Inflater(source)
    while stream.next_member():
        first, *lines = stream.until(b"\r\n\r\n")[:-4].decode("ascii").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        block, digest = [], hashlib.sha256()
        for chunk in stream.exactly(int(head["content-length"])):
            digest.update(chunk)
            block.append(chunk)
        stream.finish()
        if head.get("warc-block-digest", f"sha256:{digest.hexdigest()}") != f"sha256:{digest.hexdigest()}":
            raise ValueError(f"block digest of {head.get('warc-record-id')} does not agree")
        http, _, payload = b"".join(block).partition(b"\r\n\r\n")
        inner = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:])}
        if head["warc-type"] == "response":
            found = hashlib.sha256(payload).hexdigest()
            if head.get("warc-payload-digest", f"sha256:{found}") != f"sha256:{found}" or len(payload) != int(inner["content-length"]):
                raise ValueError(f"payload of {head.get('warc-record-id')} does not agree with its header")
        yield head, inner, payload


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (path): (page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload); the
    payload column is null for revisits, or throughout when not asked for.
    One task reads a few archives from end to end.  A damaged archive raises
    ``ValueError``; no files give no rows."""
    n = max(1, files.count())

    def run(batches) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            cols = list(zip(*rows))
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _file_system(path)
                with fs.open_input_stream(name, compression=None) as source:
                    for head, http, body in records(source):
                        kind = head["warc-type"]
                        rows.append((_page_of(head["warc-record-id"]), head.get("warc-target-uri"), int(http["content-length"]), head["warc-payload-digest"].partition(":")[2], kind,
                                     _page_of(head.get("warc-refers-to")), body if payload and kind == "response" else None))
                        held += len(body) if payload else 0
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield flush()
        if rows:
            yield flush()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.select("path").repartition(n).mapInArrow(run, schema)


def new_folder(spark) -> str:
    """A fresh folder for archives in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
