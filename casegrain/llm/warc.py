"""WARC archives: one gzip member per record, written and read sequentially.

Writing: pages with equal payloads of at least REVISIT_BYTES become one response (the least page_id) and revisits of it;
shorter ones are responses each. Each task streams its records into files of its own, named at random, and reports
them; only the reports of tasks that Spark committed are kept, so a retried task leaves no record twice.

Reading: bytes are inflated as they come, with a new inflater for each member; the record is framed by its Content-Length and
its digests are checked on the way. A worker holds a chunk, and the payload only if it is asked for.

Defined results: a null html is an empty payload; a page without an id is always a response and is read back
without an id; rows that share the least id of a payload are responses each; a url that is null, or longer than MOST_URL, is left out, control
characters in it are escaped; an empty table gives an empty archive; a broken archive gives the records
before the break and a row that says what broke; of extra columns none go into the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.llm.common import shared_dir, written

REVISIT_BYTES = 100
ROLL_BYTES, CHUNK, MOST_HEAD, MOST_URL = 512 << 20, 1 << 20, 1 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
REPORT = "path string, records long, bytes long"
READ = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) of each page.

    Lengths and digests are read first; the payloads that several pages share make a small table of digests and least ids. Pages
    look themselves up there: it is broadcast while its size on disk is under the threshold, else the join is one whose skewed
    partitions Spark divides.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    digest = F.sha2(payload, 256)
    alike = pages.where((F.length(payload) >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest.alias("_digest"))
    first = alike.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = written(first, "repeats")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & (F.col("page_id") != F.col("_first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return rows.select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page: str | None, url: str | None, payload: bytes, digest: str, kind: str, first: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only, which tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{quote(page or '', safe='')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None and len(own := re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)) <= MOST_URL:
        head.append(f"WARC-Target-URI: {own}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{URN}{quote(first or '', safe='')}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes planned pages under ``folder``; returns the files as a table (path, records, bytes)."""
    rows = plan.select(F.col("page_id").cast("string").alias("page"), "url", "payload", "payload_digest", "record_type", F.col("refers_to").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = gzip.compress(record(*values), 6, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            names = [f"{folder}/{p.rpartition('/')[2]}" for p, _, _ in done]
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(run, REPORT), "archives")


class Broken(ValueError):
    """An archive that isn't as it should be."""


class _Record:
    """A record as its bytes come: WARC header, block (HTTP header and payload), the two line ends."""

    def __init__(self, keep: bool):
        self.keep, self.state, self.held = keep, "warc", b""
        self.warc: dict[str, str] = {}
        self.http: dict[str, str] = {}
        self.left = self.size = 0
        self.block, self.hash, self.payload = hashlib.sha256(), hashlib.sha256(), []

    def _head(self, data: bytes) -> tuple[list[str] | None, bytes]:
        self.held += data
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            if len(self.held) > MOST_HEAD:
                raise Broken("a header that does not end")
            return None, b""
        lines, rest = self.held[:end].decode("utf-8", "replace").split("\r\n"), self.held[end + 4 :]
        self.held = b""
        return lines, rest

    def feed(self, data: bytes) -> None:
        while data:
            if self.state == "warc":
                lines, data = self._head(data)
                if lines is None:
                    return
                if not lines[0].startswith("WARC/"):
                    raise Broken("no WARC record")
                self.warc = _fields(lines[1:])
                if not self.warc.get("content-length", "").isdigit():
                    raise Broken("no Content-Length")
                self.left = int(self.warc["content-length"])
                self.state = "http" if self.warc.get("content-type", "").startswith("application/http") else "payload"
                if not self.left:
                    self.state = "end"
            elif self.state == "end":
                self.held += data
                if len(self.held) > 4:
                    raise Broken("bytes after the record")
                return
            else:
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                self.block.update(part)
                if self.state == "http":
                    lines, part = self._head(part)
                    if lines is not None:
                        self.http, self.state = _fields(lines[1:]), "payload"
                if self.state == "payload" and part:
                    self.size += len(part)
                    self.hash.update(part)
                    if self.keep:
                        self.payload.append(part)
                if not self.left:
                    if self.state == "http":
                        raise Broken("an HTTP header that does not end")
                    self.state = "end"

    def result(self) -> dict:
        if self.state != "end" or self.held != b"\r\n\r\n":
            raise Broken("a record cut short")
        kind, digest = self.warc.get("warc-type"), self.warc.get("warc-payload-digest", "").removeprefix("sha256:")
        if self.warc.get("warc-block-digest", "sha256:" + self.block.hexdigest()) != "sha256:" + self.block.hexdigest():
            raise Broken("the block's digest differs")
        if kind != "revisit":
            if digest and digest != self.hash.hexdigest():
                raise Broken("the payload's digest differs")
            digest = self.hash.hexdigest()
        length = self.http.get("content-length", "")
        return {
            "page_id": _page(self.warc.get("warc-record-id")),
            "url": self.warc.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else self.size,
            "payload_digest": digest,
            "refers_to": _page(self.warc.get("warc-refers-to")),
            "payload": b"".join(self.payload) if self.keep and kind != "revisit" else None,
            "error": None,
        }


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(uri: str | None) -> str | None:
    return unquote(uri.strip("<>").removeprefix(URN)) or None if uri else None


def records(chunks: Iterator[bytes], keep: bool = False) -> Iterator[dict]:
    """The records of an archive that comes in chunks; Broken at the first fault."""
    chunks, data = iter(chunks), b""
    while True:
        while not data:
            data = next(chunks, None)
            if data is None:
                return
        inflate, own = zlib.decompressobj(31), _Record(keep)
        while not inflate.eof:
            try:
                part = inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise Broken(f"gzip: {e}") from e
            own.feed(part)
            data = inflate.unconsumed_tail
            if not data and not inflate.eof and len(part) < CHUNK:
                data = next(chunks, None)
                if data is None:
                    raise Broken("a member cut short")
        data = inflate.unused_data
        yield own.result()


def read_archives(spark: SparkSession, files: DataFrame, keep: bool = False) -> DataFrame:
    """The records of the archives in column ``path``; a task reads a file at a time, from its start to its end."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = opened(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for r in records(iter(lambda s=stream: s.read(CHUNK), b""), keep):
                            rows.append(r)
                            size += 200 + len(r["payload"] or b"")
                            if size > 4 * CHUNK:
                                yield batch_of(rows)
                                rows, size = [], 0
                    except Broken as e:
                        rows.append(dict.fromkeys(names) | {"error": f"{uri}: {e}"})
                if rows:
                    yield batch_of(rows)

    paths = files.select("path")
    return paths.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(run, READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(planned(pages), f"{shared_dir(spark)}/warc")
    rows = read_archives(spark, files)
    id_type = pages.schema["page_id"].dataType
    whole = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.col("error")).cast("long"))
    return rows.select(F.col("page_id").cast(id_type), whole.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(id_type))
