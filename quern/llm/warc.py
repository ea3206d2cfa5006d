"""WARC archives with a two-level capture index.

Writing: every task writes one .warc.gz, a gzip member a record, under a name of its
own, so that a task that runs again never touches what another wrote; the index holds
only what the job's committed output names.  A payload that an earlier page has in
full is a revisit record.

Index: captures sorted by reversed-host URL key (then page) go into compressed blocks of
`lines` lines; each index file has a directory of its blocks' first keys, and a top
table has each file's first key.  Reading: a key is binary-searched in the top table, in
the directory, then in its one block, and the record is read by range.  What is held
at once is the top table (a row an index file), one directory, one block and one record.

Files lie in a folder that driver and executors share; any file system that pyarrow
opens will do.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C

LEAST = 100
LINES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("key", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
INDEX_SQL = "key binary, file string, at long, size long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?(.*)", re.DOTALL)


def surt(url: str | None) -> str:
    """The URL with its host's labels reversed: com,example,www)/path?query; scheme, port 80 or 443, fragment and a leading www drop out."""
    if not url:
        return ""
    _, host, path = _URL.match(url.strip()).groups()
    if host is None:
        return path.lower().split("#")[0]
    host = host.rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    labels = host.rstrip(".").split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    port = f":{port}" if port and port not in ("80", "443") else ""
    return f"{','.join(reversed(labels))}{port}){path.split('#')[0] or '/'}"


def capture_key(url: str | None, page_id: int | None) -> bytes:
    """Sorts by URL key, then page (null first)."""
    n = 0 if page_id is None else page_id + (1 << 63) + 1
    return surt(url).encode("utf-8", "replace").replace(b"\0", b"%00") + b"\0" + n.to_bytes(9, "big")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {json.dumps(url) if url and re.search(r'[\x00-\x20]|^\"', url) else url or ''}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP header block, payload) of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(head["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return head, http, payload


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE, level: int = 6) -> DataFrame:
    """Write a record for each row of pages to archives in `folder`; gives (key, file, at, size) of each."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    meta = C.materialize(pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")), "payloads")
    big = meta.where(f"n >= {least} and page_id is not null").select("digest", "page_id")
    first = big.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top")).where("top > refers_to").select("digest", "refers_to")
    again = big.join(first, "digest").where("page_id > refers_to").distinct()
    rows = pages.withColumn("digest", F.sha2("html", 256)).join(again, ["page_id", "digest"], "left")

    def task(batches):
        fs, base = _fs(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at, last = None, 0, None
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for page, digest, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "digest", "url", "html", "refers_to")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url, html, digest, refers, date)) + z.flush()
                out.write(raw)
                for c, v in zip(cols, (capture_key(url, page), name, at, len(raw)), strict=True):
                    c.append(v)
                at += len(raw)
            if last is not None:
                yield last
            last = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, INDEX, strict=True)], schema=INDEX)
        if out is not None:
            out.close()  # before the last rows go out: what follows them may not run
        if last is not None:
            yield last

    return C.materialize(rows.mapInArrow(task, INDEX_SQL), "captures")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> list[tuple[bytes, str, str]]:
    """Write index files and their directories; the top table (first key, index file, directory file), in order of key."""
    top = pa.schema([("first", pa.binary()), ("index", pa.string()), ("directory", pa.string())])

    def task(batches):
        fs, base = _fs(folder)
        name = uuid.uuid4().hex
        out, at, held, directory = None, 0, [], []

        def flush():
            nonlocal at, held
            raw = zlib.compress(b"".join(held_line for _, held_line in held), 6)
            out.write(raw)
            directory.append((held[0][0].hex(), at, len(raw)))
            at, held = at + len(raw), []

        for b in batches:
            for key, file, where, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.cdx", compression=None)
                held.append((key, f"{key.hex()} {file} {where} {size}\n".encode()))
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([bytes.fromhex(directory[0][0])], pa.binary()), pa.array([f"{name}.cdx"]), pa.array([f"{name}.dir"])], schema=top)

    n = C.partitions(captures.sparkSession)
    dealt = captures.repartitionByRange(n, "key").sortWithinPartitions("key", "file", "at")
    return sorted(map(tuple, C.materialize(dealt.mapInArrow(task, "first binary, index string, directory string"), "directory").collect()))


class Reader:
    """Looks captures up and reads their records."""

    def __init__(self, folder: str, top: list[tuple[bytes, str, str]], handles: int = 32):
        self.fs, self.base = _fs(folder)
        self.first, self.top, self.most = [bytes(t[0]) for t in top], top, handles
        self.open: OrderedDict = OrderedDict()
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def range(self, file: str, at: int, size: int) -> bytes:
        if file not in self.open:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[file] = self.fs.open_input_file(f"{self.base}/{file}")
        self.open.move_to_end(file)
        return self.open[file].read_at(size, at)

    def _directory(self, i: int) -> tuple[list[bytes], list]:
        if self.directory[0] != i:
            with self.fs.open_input_file(f"{self.base}/{self.top[i][2]}") as f:
                rows = json.loads(f.read())
            self.directory = i, [bytes.fromhex(r[0]) for r in rows], rows
        return self.directory[1:]

    def _block(self, i: int, j: int, row: list) -> tuple[list[bytes], list]:
        if self.block[0] != (i, j):
            rows = [x.split(b" ") for x in zlib.decompress(self.range(self.top[i][1], row[1], row[2])).splitlines()]
            self.block = (i, j), [bytes.fromhex(r[0].decode()) for r in rows], rows
        return self.block[1:]

    def lookup(self, key: bytes):
        """(file, at, size) of every capture with the key."""
        i = max(0, bisect.bisect_left(self.first, key) - 1)  # equal keys may begin in the file or block before
        while i < len(self.top) and self.first[i] <= key:
            firsts, rows = self._directory(i)
            j = max(0, bisect.bisect_left(firsts, key) - 1)
            while j < len(rows) and firsts[j] <= key:
                keys, lines = self._block(i, j, rows[j])
                k = bisect.bisect_left(keys, key)
                while k < len(keys) and keys[k] == key:
                    yield lines[k][1].decode(), int(lines[k][2]), int(lines[k][3])
                    k += 1
                j += 1
            i += 1

    def read(self, file: str, at: int, size: int) -> tuple[dict[str, str], bytes, bytes]:
        return parse(zlib.decompress(self.range(file, at, size), 31))


def _page(name: str) -> int | None:
    x = name.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


def read(captures: DataFrame, folder: str, top: list[tuple[bytes, str, str]]) -> DataFrame:
    """The records of the captures (page_id, url) wanted, found through the index, payloads checked against their digests."""
    shared = captures.sparkSession.sparkContext.broadcast(top)
    one = pa.schema([("key", pa.binary())])

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.binary())], schema=one)

    def task(batches):
        r = Reader(folder, shared.value)
        for b in batches:
            cols: list[list] = [[] for _ in ARROW]
            for key in b.column(0).to_pylist():
                for where in r.lookup(key):
                    head, http, payload = r.read(*where)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{where}: the payload isn't what its record says")
                    refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                    url = head["WARC-Target-URI"]
                    for c, v in zip(cols, (_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, json.loads(url) if url.startswith('"') else url), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

    wanted = captures.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "key binary").distinct()
    return wanted.repartitionByRange(C.partitions(captures.sparkSession), "key").sortWithinPartitions("key").mapInArrow(task, RESULT)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive every row of pages, index the captures, and read all of them back.

    A row gives a record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url.  A null html is empty, a null url has an empty key, a row with a null page_id is
    always a response.  Rows that repeat a page_id and payload are alike: all responses,
    or all revisits of the same page.  An empty table gives no rows.
    """
    folder = C.shared_path(pages.sparkSession, "warc")
    fs, base = _fs(C.shared_dir(pages.sparkSession))
    fs.create_dir(f"{base}/{folder.rpartition('/')[2]}")
    top = build_index(write(pages, folder, least), folder)
    return read(pages, folder, top)
