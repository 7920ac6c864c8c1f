"""WARC archives with a two-level capture index.

Pages are sorted by reversed-host URL key; each range of keys becomes one
archive, a gzip member a record, and one index file beside it: compressed
blocks of sorted index lines, and at its end the block directory, which holds
each block's first key. A root file lists the ranges in the same way, in blocks
of ROOT_LINES. A look-up searches by bisection the root, then the range's
directory, then one block, and reads that record's bytes alone; a scan goes
block by block. Blocks end at a number of lines or of bytes in the archive.

Files are opened by pyarrow.fs from the URI of the folder, so that a folder in
any store that it knows will do. A task that is run again writes new files, and
the table of ranges names only those of the run that counts.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, scratch_path, written

#: Payloads of at least this many bytes are written once.
MIN_REVISIT = 1000
BLOCK_LINES, BLOCK_BYTES, ROOT_LINES = 200, 4 << 20, 1000
#: Rows of pages made into records, and bytes of records handed on, at once.
ROWS, HANDED_BYTES = 50, 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RANGES = "first_key string, archive string, index string, at bigint, length bigint, blocks bigint"
_PARSED = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, refers_key string"


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels from the last to the first, then the rest; white space as %20."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?#]*", "")), r"\s", "%20")


def _name(page_id, key: str, digest: str, number: int) -> str:
    """A record's id: the page, and what tells it from others with that page_id; number: of rows equal in all of it."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{hashlib.sha1(key.encode()).hexdigest()[:16]}:{digest[:16]}:{number}>"


def _record(kind: str, name: str, url, date: str, digest: str, block: bytes, refers: tuple | None = None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if digest:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers[0], refers[1], digest, 0)}", "X-Refers-To-Key: " + refers[1]]
    head += [f"Content-Type: {'application/warc-fields' if kind == 'warcinfo' else 'application/http; msgtype=response'}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    tool = zlib.compressobj(3, zlib.DEFLATED, 31)
    return tool.compress(raw) + tool.flush()


class Writer:
    """Writes the rows of a task, sorted by key, as one archive and its index."""

    def __init__(self, folder: str, date: str, block_lines: int):
        self.folder, self.date, self.block_lines = folder, date, block_lines

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        archive, index = f"{name}.warc.gz", f"{name}.cdx"
        out = found = None
        at = end = begun = number = 0
        lines, directory, note, before = [], [], None, None

        def close_block():
            nonlocal end, lines, begun
            begun = at
            if lines:
                block = zlib.compress("\n".join(lines).encode(), 6)
                found.write(block)
                directory.append([lines[0].split(" ", 1)[0], end, len(block)])
                end += len(block)
                lines = []

        for r in (r for batch in batches for first in range(0, batch.num_rows, ROWS) for r in batch.slice(first, ROWS).to_pylist()):
            if r["row"] == 0:  # the pages of this key, id and digest come next
                note = r
                continue
            same = note is not None and all(note[k] == r[k] for k in ("key", "page_id", "digest"))
            if out is None:
                out, found = store.open_output_stream(f"{root}/{archive}", compression=None), store.open_output_stream(f"{root}/{index}", compression=None)
                info = _member(_record("warcinfo", f"<urn:uuid:{uuid.UUID(name)}>", None, self.date, "", b"format: WARC File Format 1.1\r\n"))
                out.write(info)
                at = begun = len(info)
            now = r["key"], r["page_id"], r["digest"]
            number = number + 1 if now == before else 0
            before, own = now, _name(r["page_id"], r["key"], r["digest"], number)
            payload = (r["html"] or "").encode()
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            if not same:
                raw = _record("response", own, r["url"], self.date, r["digest"], http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
            else:
                raw = _record("revisit", own, r["url"], self.date, r["digest"], http + b"\r\n", (note["refers_to"], note["refers_key"]))
            member = _member(raw)
            out.write(member)
            lines.append(f"{r['key']} {'' if r['page_id'] is None else r['page_id']} {at} {len(member)}")
            at += len(member)
            if len(lines) == self.block_lines or at - begun >= BLOCK_BYTES:
                close_block()
        if out is None:
            return
        close_block()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        found.write(tail)
        out.close()
        found.close()
        yield pa.RecordBatch.from_pylist([{"first_key": directory[0][0], "archive": archive, "index": index, "at": end, "length": len(tail), "blocks": len(directory)}])


def _read(store, path: str, at: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(at)
        return f.read(length)


def parse(member: bytes) -> dict:
    """The fields of one record; its payload too, if it has one."""
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    page = lambda name: int(x) if (x := fields.get(name, "<urn:x-page:>")[12:-1].split(":")[0]) else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    out = {"page_id": page("WARC-Record-ID"), "record_type": fields["WARC-Type"], "payload_digest": digest, "refers_to": page("WARC-Refers-To"), "refers_key": fields.get("X-Refers-To-Key"), "payload_bytes": None, "url": fields.get("WARC-Target-URI")}
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {out['page_id']}: the payload is not what was written")
        out |= {"payload_bytes": len(payload), "payload": payload}
    return out


class BlockReader:
    """Reads all records of the blocks in (archive, index, at, length) rows: a block's records lie side by side."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_key", pa.string())])
        for batch in batches:
            for b in batch.to_pylist():
                lines = [x.rsplit(" ", 2) for x in zlib.decompress(_read(store, f"{root}/{b['index']}", b["at"], b["length"])).decode().split("\n")]
                first, last = int(lines[0][1]), int(lines[-1][1]) + int(lines[-1][2])
                raw = _read(store, f"{root}/{b['archive']}", first, last - first)
                rows = []
                for _, at, n in lines:
                    r = parse(raw[int(at) - first : int(at) - first + int(n)])
                    rows.append({k: r[k] for k in schema.names})  # not the payload
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        K.tidy()


def _directories(folder: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                directory = json.loads(zlib.decompress(_read(store, f"{root}/{r['index']}", r["at"], r["length"])))
                yield pa.RecordBatch.from_pylist([{"archive": r["archive"], "index": r["index"], "at": at, "length": n} for _, at, n in directory])

    return blocks


class Lookup:
    """Finds the captures of (key, page_id) rows by bisection: root, range, block, line, then the record's own bytes.

    top: (first key, start, length) of the root's blocks.
    """

    def __init__(self, folder: str, root: str, top: list[tuple], payloads: bool):
        self.folder, self.root, self.top, self.payloads = folder, root, top, payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        tops = [t[0] for t in self.top]

        @lru_cache(16)
        def ranges(t: int) -> list:
            _, at, length = self.top[t]
            return json.loads(zlib.decompress(_read(store, f"{root}/{self.root}", at, length)))

        @lru_cache(64)
        def directory(t: int, k: int) -> list:
            _, _, index, at, length = ranges(t)[k]
            return json.loads(zlib.decompress(_read(store, f"{root}/{index}", at, length)))

        @lru_cache(64)
        def block(t: int, k: int, b: int) -> list:
            _, at, length = directory(t, k)[b]
            return [(x[0], x[1], int(x[2]), int(x[3])) for x in (line.split(" ") for line in zlib.decompress(_read(store, f"{root}/{ranges(t)[k][2]}", at, length)).decode().split("\n"))]

        def from_(heads: list[str], key: str) -> Iterator[int]:
            """A key may go on over several: begin in the one before the first that starts with it."""
            for k in range(max(0, bisect.bisect_left(heads, key) - 1), len(heads)):
                if heads[k] > key:
                    return
                yield k

        def captures(key: str):
            for t in from_(tops, key):
                for k in from_([r[0] for r in ranges(t)], key):
                    for b in from_([d[0] for d in directory(t, k)], key):
                        lines = block(t, k, b)
                        for i in range(bisect.bisect_left(lines, (key,)), len(lines)):
                            if lines[i][0] != key:
                                break
                            yield ranges(t)[k][1], lines[i]

        for batch in batches:
            rows, held = [], 0
            for q in batch.to_pylist():
                for archive, (_, page, at, n) in captures(q["key"]):
                    if q["page_id"] is None or page == str(q["page_id"]):
                        r = parse(_read(store, f"{root}/{archive}", at, n))
                        rows.append({"key": q["key"]} | {k: r[k] for k in schema.names[1:-1]} | {"payload": r.get("payload") if self.payloads else None})
                        held += len(rows[-1]["payload"] or b"") + 200
                        if held > HANDED_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        K.tidy()


class Archive:
    """Archives and index in one folder, and the table of their ranges."""

    def __init__(self, folder: str, ranges: DataFrame):
        self.folder, self.ranges = folder, ranges

    def scan(self) -> DataFrame:
        """One row a record, read block by block and checked against its digest."""
        spark = self.ranges.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        blocks = self.ranges.mapInArrow(_directories(self.folder), "archive string, index string, at bigint, length bigint")
        return blocks.repartition(tasks).mapInArrow(BlockReader(self.folder), _PARSED)

    def write_root(self) -> tuple[str, list[tuple]]:
        """Write the root: all ranges by first key, in blocks; its file and (first key, start, length) of each block."""
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        name, top, at, held = f"{uuid.uuid4().hex}.root", [], 0, []
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:

            def close_block():
                nonlocal at, held
                if held:
                    block = zlib.compress(json.dumps(held).encode(), 6)
                    out.write(block)
                    top.append((held[0][0], at, len(block)))
                    at, held = at + len(block), []

            for r in self.ranges.select("first_key", "archive", "index", "at", "length").orderBy("first_key", "archive").toLocalIterator():
                held.append(list(r))
                if len(held) == ROOT_LINES:
                    close_block()
            close_block()
        return name, top

    def lookup(self, keys: DataFrame, payloads: bool = True) -> DataFrame:
        """The captures of (key, page_id) rows, with or without their payloads; a null page_id stands for all captures of the key."""
        tool = Lookup(self.folder, *self.write_root(), payloads)
        return keys.select("key", "page_id").mapInArrow(tool, "key string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, payload binary")


def archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = DATE, block_lines: int = BLOCK_LINES) -> Archive:
    """Write a record for each row of pages (page_id, url, html).

    Null html counts as empty and a null url as the empty key. Of rows with
    equal payloads of at least min_revisit bytes, those with the largest
    page_id are responses and the others revisit it; a row without page_id is a
    response. Extra columns aren't looked at.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html")).withColumn("key", url_key(F.col("url")))
    # Which rows revisit another is found from ids alone. That and the pages meet in the sort by key, so that payloads are shuffled once.
    again = own.where((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull()).select("key", "page_id", "digest")
    first = again.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("digest").alias("of"), "first")
    again = again.join(first, F.col("digest") == F.col("of")).where(F.col("page_id") < F.col("first.page_id"))
    nothing = F.lit(None).cast("string")
    notes = again.select("key", "page_id", "digest", F.lit(0).alias("row"), nothing.alias("url"), nothing.alias("html"), F.col("first.page_id").alias("refers_to"), F.col("first.key").alias("refers_key"))
    rows = own.select("key", "page_id", "digest", F.lit(1).alias("row"), "url", "html", F.lit(None).cast("bigint").alias("refers_to"), nothing.alias("refers_key"))
    spark = pages.sparkSession
    bounded(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "digest"]
    rows = notes.union(rows).repartitionByRange(tasks, *order).sortWithinPartitions(*order, "row")
    return Archive(folder, written(rows.mapInArrow(Writer(folder, date, block_lines), _RANGES), "warc-ranges"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record, and read back block by block.

    Null html counts as empty, null urls have the empty key; pages of any size
    are written whole; repeated rows and ids have a record each, and of repeated
    rows with the largest page_id all are responses; an empty table gives no
    row; columns beside page_id, url and html aren't looked at.
    """
    made = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    records = written(made.scan(), "warc-records")
    targets = records.where(F.col("refers_to").isNotNull()).groupBy(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id")).agg(F.count("*").alias("n"))
    sizes = made.lookup(targets, payloads=False).where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("target")).agg(F.max("payload_bytes").alias("full"))
    out = records.join(sizes, F.col("refers_to") == F.col("target"), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
}
