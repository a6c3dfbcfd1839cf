"""WARC archives with a two-level capture index.

Records are gzip members of archive files, one file for each task. The index has a line for each record under its reversed-host
key; lines are sorted, compressed in blocks, and a sparse directory has each block's first key and place. A lookup searches
the directory, reads one block's bytes, searches its lines and reads the records' bytes. Many keys are looked up at once: they
go to the index files whose key ranges they fall into, are searched there in the files' directory rows and then in the blocks.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, joined, small_parts, stored, tidied

BLOCK_LINES = 256
#: Bytes of archives that one task reads back.
STRETCH_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"  # pages have no capture time


def host_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL; whatever is not of the form scheme://host is its own key."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?(.*)$"
    host = F.lower(F.regexp_extract(url, parts, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(url, parts, 2), F.lit(")"), F.regexp_extract(url, parts, 3))
    return F.when(host == "", url).otherwise(key)


def file_system(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _warc(kind: str, headers: list[str], content: str, block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *headers, f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit of refers_to's payload. Both state the digest and size of the full payload.

    A record's id is that of its page, so it is as unique as the page_id is.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + _uri(url), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is None:
        return _warc("response", head, "application/http;msgtype=response", http + payload)
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_uri(refers_url or '')}", f"WARC-Refers-To-Date: {DATE}"]
    return _warc("revisit", head, "application/http;msgtype=response", http)


def info_record(name: str) -> bytes:
    """What an archive begins with."""
    fields = "software: leadframe\r\nformat: WARC File Format 1.1\r\n".encode()
    return _warc("warcinfo", [f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}"], "application/warc-fields", fields)


@dataclass
class Parsed:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        text = self.headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    @property
    def refers_to(self) -> int | None:
        text = self.headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().strip().lower(): v.decode().strip() for k, v in (x.split(b":", 1) for x in lines if b":" in x)}


def parse(data: bytes) -> Parsed:
    """One record. A length or digest that does not hold is an error."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record")
    headers = _fields(lines[1:])
    block, end = rest[: int(headers["content-length"])], rest[int(headers["content-length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    if "sha1:" + base32_sha1(block) != headers["warc-block-digest"]:
        raise ValueError("a block's digest does not hold")
    http, payload = block.split(b"\r\n\r\n", 1)
    out = Parsed(headers, _fields(http.split(b"\r\n")[1:]), payload)
    if headers["warc-type"] == "response" and (len(payload) != int(out.http["content-length"]) or "sha1:" + base32_sha1(payload) != headers["warc-payload-digest"]):
        raise ValueError("a payload's digest does not hold")
    return out


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0) -> DataFrame:
    """Writes every row of pages to archives under root; returns the stored index lines: key, page_id, path, at, size.

    Of pages with equal payloads of least_bytes or more, the one with the greatest page_id is a response and the others
    refer to it; all else are responses. Null html counts as empty and null URLs as ''; null page_ids and rows that repeat the greatest page_id are responses.
    Ids and digests alone are shuffled to find the payloads that repeat. Those payloads are broadcast if they are few; if not,
    html is dealt by digest, but for digests that many pages have. A task that runs again writes another file, and only the
    files of the tasks that the index was committed from are in it.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    repeated = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    repeated = stored(repeated, "repeated")
    if repeated.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10:  # some 100 bytes and a URL each
        found = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        found = joined(rows, repeated, ["digest"], pages.count(), "left")
    revisit = F.col("page_id") != F.col("first")
    ready = found.select("page_id", "url", host_key(F.col("url")).alias("key"), "html", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, 0, f"{root}/archive-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in small_parts(batches, "html"):
                if out is None and batch.num_rows:
                    system, where = file_system(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                    at = out.write(gzip_member(info_record(path.rpartition("/")[2])))
                lines = []
                for page_id, url, html, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                    member = gzip_member(record(page_id, url, html.encode(), refers_to, refers_url))
                    out.write(member)
                    lines.append((path, at, len(member)))
                    at += len(member)
                columns = list(zip(*lines, strict=True)) if lines else [()] * 3
                yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "page_id": batch.column("page_id"), "path": pa.array(columns[0], pa.string()), "at": pa.array(columns[1], pa.int64()), "size": pa.array(columns[2], pa.int64())})
        finally:
            if out is not None:
                out.close()

    return stored(ready.mapInArrow(tidied(write), "key string, page_id long, path string, at long, size long"), "captures")


def write_index(lines: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts the lines by key and page_id, writes them in compressed blocks, returns the stored directory: first, last, path, at, size, lines."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, out, waiting = f"{root}/index-{uuid.uuid4().hex}.cdx.gz", 0, None, []

        def block(rows: list[tuple]) -> tuple:
            nonlocal at, out
            if out is None:
                system, where = file_system(path)
                system.create_dir(where.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(where, compression=None)
            data = gzip_member("\n".join(json.dumps(r) for r in rows).encode())
            out.write(data)
            at += len(data)
            return rows[0][0], rows[-1][0], path, at - len(data), len(data), len(rows)

        def batch_of(blocks: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*blocks, strict=True)) if blocks else [()] * 6
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("first", "last", "path", "at", "size", "lines"), columns, kinds, strict=True)})

        try:
            for batch in batches:
                waiting += list(zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "path", "at", "size")), strict=True))
                whole = len(waiting) // block_lines * block_lines
                yield batch_of([block(waiting[i : i + block_lines]) for i in range(0, whole, block_lines)])
                waiting = waiting[whole:]
            if waiting:
                yield batch_of([block(waiting)])
        finally:
            if out is not None:
                out.close()

    ranged = lines.repartitionByRange("key", "page_id", "at").sortWithinPartitions("key", "page_id", "at")
    return stored(ranged.mapInArrow(tidied(write), "first string, last string, path string, at long, size long, lines long"), "directory")


def read_block(path: str, at: int, size: int) -> list[list]:
    """The lines of one block: key, page_id, path, at, size."""
    system, where = file_system(path)
    with system.open_input_file(where) as f:
        f.seek(at)
        return [json.loads(x) for x in zlib.decompress(f.read(size), 31).decode().split("\n")]


def read_record(path: str, at: int, size: int) -> Parsed:
    system, where = file_system(path)
    with system.open_input_file(where) as f:
        f.seek(at)
        return parse(zlib.decompress(f.read(size), 31))


def lookup(directory: DataFrame, key: str) -> list[Parsed]:
    """The records under one key: blocks that may have it, a binary search in each, and a range read for each hit."""
    out = []
    for block in directory.where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first").collect():  # the captures of one URL
        lines = read_block(block["path"], block["at"], block["size"])
        keys = [x[0] for x in lines]
        out += [read_record(*x[2:]) for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
    return out


def lookup_all(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record whose key is in keys (key, no nulls, repeats allowed).

    The driver has the first and last key of each index file, a row for each task that wrote one. Keys are dealt to the
    files that may have them; a task searches its file's directory rows for each of its keys, reads the blocks that may have
    it and searches their lines. Records are then read in stretches of the archives, in the archives' order.
    """
    spark = directory.sparkSession
    files = directory.groupBy("path").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first", "last").collect()
    firsts, lasts, paths = [r["first"] for r in files], [r["last"] for r in files], [r["path"] for r in files]
    empty = pa.table({"path": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, paths[i]) for k in batch.column("key").to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.string()), "file": pa.array([r[1] for r in rows], pa.string())})

    def search(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        if not wanted.num_rows or not blocks.num_rows:
            return empty
        blocks = blocks.sort_by("at")
        first, last, path, at, size = (blocks.column(c).to_pylist() for c in ("first", "last", "path", "at", "size"))
        found: list[list] = []
        held, lines, names = -1, [], []
        for key in sorted(set(wanted.column("key").to_pylist())):
            for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                if i != held:
                    held, lines = i, read_block(path[i], at[i], size[i])
                    names = [x[0] for x in lines]
                found += lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
        return pa.table({"path": pa.array([r[2] for r in found], pa.string()), "at": pa.array([r[3] for r in found], pa.int64()), "size": pa.array([r[4] for r in found], pa.int64())})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    system, where = file_system(path)
                    opened, f = path, system.open_input_file(where)
                f.seek(at)
                r = parse(zlib.decompress(f.read(size), 31))
                kind = r.headers["warc-type"]
                rows.append((r.page_id, int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:"), kind, r.refers_to))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), columns, kinds, strict=True)})

    dealt = keys.select("key").distinct().mapInArrow(tidied(deal), "key string, file string")
    blocks = directory.select(F.col("path").alias("file"), "first", "last", "path", "at", "size")
    found = stored(dealt.groupBy("file").cogroup(blocks.groupBy("file")).applyInArrow(search, "path string, at long, size long"), "found")
    tasks = max(spark.sparkContext.defaultParallelism, (found.agg(F.sum("size")).first()[0] or 0) // STRETCH_BYTES)
    stretch = F.floor(F.col("at") / STRETCH_BYTES)  # not whole archives: one may be large
    return found.repartition(tasks, "path", stretch).sortWithinPartitions("path", "at").mapInArrow(tidied(records), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives every row of pages, indexes the archives and looks up the keys of all pages; an empty table gives an empty result."""
    root = fresh_path(pages.sparkSession, "warc")
    directory = write_index(write_archives(pages, root, least_bytes), root)
    return lookup_all(directory, pages.select(host_key(F.col("url")).alias("key")))
