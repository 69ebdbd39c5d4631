"""WARC archives by way of a chunk table: a record is as many rows (record, chunk number, bytes) as its payload needs.

Writing: payloads become chunk rows, those of a record after each other; a task streams them into its archives, one
chunk in memory at a time, carrying the digest of the record from chunk to chunk, and holds it against the digest in the
header at the last one. Reading streams an archive back into chunk rows with running length and
digest, so that the last row of a record has both of the whole payload.

Archives are sequences of gzip members, one for each record, as WARC readers expect; the first describes the archive, and
the others hold HTTP responses, whose payloads are the pages. Each is written under a name of its
attempt and moved to its own name when complete, so that tasks can run again. Folders are URIs that pyarrow can open.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

CHUNK = 1 << 20
LEAST_DEDUP = 100
READ = 1 << 18
DATE = "WARC-Date: 1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
CHUNKS = "archive string, record bigint, page_id string, record_type string, refers_to string, chunk int, data binary, last boolean, length_so_far bigint, digest_so_far string"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def planned(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_DEDUP) -> DataFrame:
    """(page_id, url, length, digest, record_type, refers_to) for each row of pages.

    Of rows with equal payloads of at least `least` bytes those with the smallest page_id are responses and the others
    revisit it. A null page_id is never smallest; where all are null, all are responses. A null html is an empty payload.
    """
    slim = pages.select(F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.octet_length(payload(F.col(f"`{html}`"))).cast("long").alias("length"), F.sha2(payload(F.col(f"`{html}`")), 256).alias("digest"))
    first = slim.where(F.col("length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = slim.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "length", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def chunked(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, least: int = LEAST_DEDUP) -> DataFrame:
    """The chunk table: one row for each chunk of a response's payload, one without data for a revisit or an empty payload."""
    plan = planned(pages, page, url, html, least)
    own = plan.where("refers_to IS NOT NULL").select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("own"), "digest", "refers_to").distinct()
    body = payload(F.col(f"`{html}`"))
    rows = pages.select(F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"length": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256), "own": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    # By id and digest: no page has many rows, however many are equal. This is the only shuffle of payloads.
    rows = rows.join(own, ["own", "digest"], "left")
    data = F.when(F.col("refers_to").isNull(), F.col("body"))
    count = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(data), F.lit(0)) / chunk)).cast("int")
    cut = F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk")
    rows = rows.select("page_id", "url", "length", "digest", "refers_to", data.alias("data"), count.alias("chunks"), cut)
    return rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "length", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("refers_to").cast("string").alias("refers_to"), "chunk", "chunks", F.substring("data", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def http_head(length: int) -> bytes:
    """The head of the response that a payload came in."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def header(page_id, url, length, digest, kind, refers_to, again: int = 0) -> bytes:
    """The head of a record with its HTTP head. again: how many records of the same page and payload stand before it, which have ids of their own."""
    clean = lambda x: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in x)
    own = f"{kind}:{page_id}:{digest}" + f":{again}" * bool(again)
    http = http_head(length)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own)}>", DATE]
    lines += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    lines += [f"X-Page-ID: {clean(page_id)}"] if page_id is not None else []
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{refers_to}:{digest}')}>", f"X-Refers-To-Page-ID: {clean(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if kind == 'revisit' else length)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def about(name: str) -> bytes:
    """The first record of an archive, which describes it."""
    body = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{name}')}>", DATE, f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Archive:
    """One archive while it is written."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.path, self.temporary = f"{base}/{name}.warc.gz", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.out, self.records, self.bytes = self.files.open_output_stream(self.temporary, compression=None), 0, 0
        self.put(gzip.compress(about(name), 6, mtime=0))

    def put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> dict:
        self.out.close()
        self.files.move(self.temporary, self.path)
        return {"path": self.path, "n_records": self.records, "n_bytes": self.bytes}


def write(chunks: DataFrame, folder: str, bytes_per_archive: int = 64 << 20) -> DataFrame:
    """Writes the chunk table to archives in folder and returns their manifest (path, n_records, n_bytes).

    The chunks of a record must follow each other, as chunked() gives them. Each task writes archives of its own, a new
    one after bytes_per_archive bytes.
    """
    rows = chunks.select("page_id", "url", "length", "digest", "record_type", "refers_to", "chunk", "chunks", "data")

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        archive = packer = hasher = None
        done, met = [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if r["chunk"] == 0:
                    if archive is not None and archive.bytes >= bytes_per_archive:
                        done.append(archive.close())
                        archive, number = None, number + 1
                    archive = archive or Archive(folder, f"part-{task:05d}-{number:05d}")
                    packer, hasher = zlib.compressobj(6, wbits=31), hashlib.sha256()
                    # Rows of one page and payload are all in this task.
                    own = hash((r["page_id"], r["digest"]))
                    again = met[own] = met.get(own, -1) + 1
                    archive.put(packer.compress(header(*(r[c] for c in ("page_id", "url", "length", "digest", "record_type", "refers_to")), again)))
                data = r["data"] or b""
                hasher.update(data)
                archive.put(packer.compress(data))
                if r["chunk"] == r["chunks"] - 1:
                    if r["record_type"] == "response" and hasher.hexdigest() != r["digest"]:
                        raise ValueError(f"page {r['page_id']}: its chunks don't have its digest")
                    archive.put(packer.compress(b"\r\n\r\n") + packer.flush())
                    archive.records += 1
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class Stream:
    """The bytes of an archive's members, one after the other, a piece at a time."""

    def __init__(self, source):
        self.source, self.held = gzip.GzipFile(fileobj=source), b""

    def more(self) -> bool:
        made = self.source.read(READ)
        self.held += made
        return bool(made)

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise EOFError("the archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def records(source, chunk: int):
    """(headers, chunk number, data, last, length so far, digest so far) for each chunk of each record of an archive."""
    stream = Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        left, number, so_far, hasher, part = int(fields["content-length"]), 0, 0, hashlib.sha256(), b""
        if fields["content-type"].startswith("application/http"):
            left -= len(stream.until(b"\r\n\r\n")) + 4
        while True:
            while left and len(part) < chunk:
                piece = stream.take(min(left, chunk - len(part)))
                part, left = part + piece, left - len(piece)
            hasher.update(part)
            so_far += len(part)
            yield fields, number, part, left == 0, so_far, hasher.hexdigest()
            number, part = number + 1, b""
            if not left:
                break
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError("a record isn't closed")


def read(manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives of a manifest, with running length and digest; the last row of a record has the whole payload's."""
    tasks = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def run(batches):
        from pyarrow import fs

        schema = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("last", pa.bool_()), ("length_so_far", pa.int64()), ("digest_so_far", pa.string())])
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as source:
                    held, size, record = [], 0, -1
                    for f, number, data, last, so_far, digest in records(source, chunk):
                        if f["warc-type"] == "warcinfo":
                            continue
                        record += number == 0
                        kind, claimed = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:")
                        if last and kind == "response" and (digest != claimed or so_far != int(f["x-payload-length"])):
                            raise ValueError(f"{path}: a payload has changed")
                        if kind == "revisit":
                            so_far, digest = int(f["x-payload-length"]), claimed
                        held.append((path, record, f.get("x-page-id"), kind, f.get("x-refers-to-page-id"), number, data, last, so_far, digest))
                        size += len(data)
                        if size >= 4 * CHUNK or len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return tasks.mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """Writes pages to archives in the shared folder: their manifest, and the folder."""
    folder = scratch(pages.sparkSession, "warc")
    return write(chunked(pages, chunk=chunk), folder), folder


def op9_archives(pages: DataFrame) -> DataFrame:
    manifest, folder = archived(pages.select("page_id", "url", "html"))
    kind = pages.schema["page_id"].dataType
    back = read(manifest, folder).where("last")
    return back.select(F.col("page_id").cast(kind).alias("page_id"), F.col("length_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
