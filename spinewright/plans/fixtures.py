"""Sound files made of the rows of documents, and what reading and moving them must give.

Each document is a file: its bytes are put together in SQL that Spark and DuckDB
share, by the published formats, and written by tasks to the shared folder. The
text is what stands where sound would be; a third of the files have little
there, so that some are equal.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..executor import apply
from ..operators.running import cut, remembered, shared_folder
from ..sources.files import list_claimed, list_files, met, read_library
from .organise import plan, with_destination


def _bytes(b: bytes) -> str:
    return f"unhex('{b.hex()}')"


def _u32(n: str) -> str:
    return f"unhex(lpad(hex(CAST({n} AS BIGINT)), 8, '0'))"


def _little(n: str) -> str:
    digits = f"lpad(hex(CAST({n} AS BIGINT)), 8, '0')"
    return "unhex(" + " || ".join(f"substr({digits}, {k}, 2)" for k in (7, 5, 3, 1)) + ")"


def _frame(name: bytes, body: str) -> str:
    """A frame of ID3, version 2.3."""
    return f"{_bytes(name)} || {_u32(f'octet_length({body})')} || unhex('0000') || {body}"


def _if(text: str, made: str) -> str:
    return f"CASE WHEN {text} = '' THEN unhex('') ELSE {made} END"


def _text_frame(name: bytes, text: str) -> str:
    return _if(text, _frame(name, f"unhex('03') || BYTES({text})"))


def _comment(name: str, text: str) -> str:
    own = f"BYTES('{name}=' || {text})"
    return _if(text, f"{_little(f'octet_length({own})')} || {own}")


def _atom(name: bytes, body: str) -> str:
    return f"{_u32(f'8 + octet_length({body})')} || {_bytes(name)} || {body}"


def _data(kind: int, body: str) -> str:
    return _atom(b"data", f"{_bytes(struct.pack('>II', kind, 0))} || {body}")


def _fixed_atom(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


_SAFE = "(((n >> 21) & 127) * 16777216 + ((n >> 14) & 127) * 65536 + ((n >> 7) & 127) * 256 + (n & 127))"
#: Five frames of 128,000 bits a second.
_MP3 = _bytes((bytes.fromhex("fffb9000") + bytes(413)) * 5)
#: Of ID3: author, book, title, track, series and the picture.
_ID3 = " || ".join(
    [*(_text_frame(k, v) for k, v in ((b"TPE1", "author"), (b"TALB", "book"), (b"TIT2", "title"), (b"TRCK", "track"))), _if("series", _frame(b"TXXX", f"{_bytes(b'\3SERIES\0')} || BYTES(series)")), _frame(b"APIC", f"{_bytes(b'\0image/jpeg\0\3\0')} || cover")]
)
_COMMENTS = " || ".join(_comment(k, v) for k, v in (("ARTIST", "author"), ("ALBUM", "book"), ("TITLE", "title"), ("TRACK", "track"), ("SERIES", "series")))
_COUNT = "3 + CASE WHEN track = '' THEN 0 ELSE 1 END + CASE WHEN series = '' THEN 0 ELSE 1 END"
#: 44,100 Hz, two channels, 16 bits, 88,200 samples.
_STREAM = _bytes(b"\0\0\0\x22" + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big") + bytes(16))
_IMAGE = f"{_bytes(struct.pack('>II', 3, 10) + b'image/jpeg' + bytes(20))} || {_u32('octet_length(cover)')} || cover"
_ENTRY = _fixed_atom(b"mp4a", bytes(16), struct.pack(">HH", 2, 16), bytes(4), struct.pack(">HH", 44100, 0), _fixed_atom(b"esds", bytes(4), b"\x03\x19\0\0\0\x04\x11\x40\x15\0\0\0", struct.pack(">II", 0, 64000)))
_TRAK = _fixed_atom(
    b"trak", _fixed_atom(b"mdia", _fixed_atom(b"mdhd", bytes(12), struct.pack(">II", 1000, 5500), bytes(4)), _fixed_atom(b"hdlr", bytes(8), b"soun", bytes(12)), _fixed_atom(b"minf", _fixed_atom(b"stbl", _fixed_atom(b"stsd", bytes(8), _ENTRY))))
)
_LIST = " || ".join(
    [
        _atom(b"\xa9alb", _data(1, "BYTES(book)")), _atom(b"aART", _data(1, "BYTES(author)")), _atom(b"\xa9nam", _data(1, "BYTES(title)")), _if("track", _atom(b"trkn", _data(0, f"{_u32('CAST(track AS BIGINT)')} || unhex('00090000')"))),
        _if("series", _atom(b"----", f"{_bytes(_fixed_atom(b'mean', bytes(4), b'com.x') + _fixed_atom(b'name', bytes(4), b'SERIES'))} || {_data(1, 'BYTES(series)')}")), _atom(b"covr", _data(13, "cover")),
    ]
)
_MOOV = f"{_u32(f'n + {len(_TRAK) + 36}')} || {_bytes(b'moov' + _TRAK)} || {_u32('n + 28')} || {_bytes(b'udta')} || {_u32('n + 20')} || {_bytes(b'meta' + bytes(4))} || {_u32('n + 8')} || {_bytes(b'ilst')} || own"


def _block(kind: int, body: str) -> str:
    return f"unhex('{kind:02x}' || substr(lpad(hex(CAST(octet_length({body}) AS BIGINT)), 8, '0'), 3)) || {body}"


#: Documents as files; BYTES stands for the function that gives a text's bytes in UTF-8.
FILES = f"""
WITH made AS (
  SELECT doc_id, CAST(doc_id % 4 AS INT) AS kind, 'Author ' || CAST(doc_id % 23 AS STRING) AS author, 'Bücher ' || CAST(doc_id % 7 AS STRING) AS book, 'Teil ' || CAST(doc_id % 5 AS STRING) AS title,
    CASE WHEN doc_id % 8 < 2 THEN '' ELSE CAST(1 + doc_id % 3 AS STRING) END AS track, CASE WHEN doc_id % 6 < 3 THEN 'Saga' ELSE '' END AS series, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') ELSE coalesce(text, '') END AS body,
    coalesce(lang, 'und') || '/' || CAST(doc_id % 97 AS STRING) AS folder, CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.m4a' ELSE '.wav' END AS name
  FROM documents WHERE doc_id IS NOT NULL),
parts AS (SELECT *, BYTES(body) AS sound, BYTES('cover of ' || book) AS cover FROM made),
tagged AS (SELECT *, CASE WHEN kind IN (0, 3) THEN {_ID3} WHEN kind = 1 THEN {_COMMENTS} ELSE {_LIST} END AS tag FROM parts),
headed AS (SELECT *, CASE WHEN kind IN (0, 3) THEN {_bytes(b"ID3" + bytes([3, 0, 0]))} || {_u32(_SAFE)} || tag ELSE tag END AS own FROM (SELECT *, octet_length(tag) AS n FROM tagged)),
chunks AS (SELECT *, {_bytes(b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data")} || {_little("octet_length(sound)")} || sound || CASE WHEN octet_length(sound) % 2 = 1 THEN unhex('00') ELSE unhex('') END || {_bytes(b"id3 ")} || {_little("octet_length(own)")} || own AS riff,
  {_IMAGE} AS image, {_little("1")} || BYTES('x') || {_little(_COUNT)} || own AS comments FROM headed),
files AS (SELECT *, CASE kind WHEN 0 THEN own || {_MP3} || sound WHEN 1 THEN {_bytes(b"fLaC")} || {_STREAM} || {_block(6, "image")} || {_block(0x84, "comments")} || sound
    WHEN 2 THEN {_bytes(_fixed_atom(b"ftyp", b"M4A "))} || {_atom(b"mdat", "sound")} || {_MOOV} ELSE {_bytes(b"RIFF")} || {_little("4 + octet_length(riff)")} || {_bytes(b"WAVE")} || riff END AS content FROM chunks)
"""
SPARK, DUCKDB = FILES.replace("BYTES(", "binary("), FILES.replace("BYTES(", "encode(")


class Writer:
    """Writes (path, content) rows below a folder; a task that is run again writes the same."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = f"{root}/{path}"
                if (parent := os.path.dirname(at)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


def write_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder, below the shared one, that the documents' files were written to."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = spark.sql(SPARK.replace("FROM documents", "FROM {documents}") + "SELECT folder || '/' || name AS path, content FROM files", documents=documents)
    root = re.sub("^file:/+", "/", f"{shared_folder(spark)}/spinewright-files/{uuid.uuid4().hex}")
    files.mapInArrow(Writer(root + "/in"), "n bigint").agg(F.sum("n")).collect()
    remembered(spark, root)
    return root


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_library(spark, write_files(spark, sf_dir) + "/in", int(spark.conf.get("spark.sql.shuffle.partitions")))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the files are and how large; none is opened."""
    return _library(spark, sf_dir).select("folder", "name", "ext", "size")


def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the files' tags, of four formats."""
    return _library(spark, sf_dir).select("folder", "name", "author", "book", "title", "track", "series", "error")


def source_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams' properties."""
    return _library(spark, sf_dir).select("folder", "name", "codec", "bitrate", F.round("duration", 9).alias("duration"), "sample_rate", "channels")


def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of the head of every file."""
    return _library(spark, sf_dir).select("folder", "name", "fp")


def source_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' pictures."""
    return _library(spark, sf_dir).select("folder", "name", F.decode("cover", "utf-8").alias("cover"))


def destination_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the folders that files of odd numbers want to go to, if the files are their own library: only what a file of its size would replace is hashed."""
    root = write_files(spark, sf_dir) + "/in"
    files = list_files(spark, root)
    odd = files.where(F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).cast("bigint") % 2 == 1)
    wanted = odd.select(F.col("path").alias("dest_file"), F.when(F.col("size") % 3 > 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"))
    return met(list_claimed(spark, root, wanted), wanted).select(F.substr("dest", F.lit(len(root) + 2)).alias("path"), "disk_fp")


def carried_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file and cover is after a live run over them, by its size and digest."""
    root = write_files(spark, sf_dir)
    source, dest, dupes = (f"{root}/{k}" for k in ("in", "out", "dupes"))
    files = read_library(spark, source, int(spark.conf.get("spark.sql.shuffle.partitions"))).drop("fp", "cover")
    # Tags are read once, for what is there and for the plan.
    placed = cut(with_destination(files, dest).select("path", "size", "error", "dest_file", "no_meta"))
    apply(plan(placed, list_claimed(spark, dest, placed), dest), source, dest, dupes, dry_run=False)
    left = read_library(spark, root, int(spark.conf.get("spark.sql.shuffle.partitions")), None)
    return left.select(F.concat_ws("/", "folder", "name").alias("path"), "fp")


QUERIES = {f.__name__: f for f in (source_files, source_tags, source_properties, source_fingerprints, source_covers, destination_probe, carried_out)}

_EXT = "CASE kind WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' WHEN 2 THEN 'm4a' ELSE 'wav' END"
_FP = "octet_length(content) || ':' || md5(content[1:1048576])"
#: Where each file goes: the first of a name claims it, its equals are kept out, others get the next number.
_MOVED = f"""
, placed AS (SELECT *, folder || '/' || name AS path, {_FP} AS fp, 'out/' || author || '/' || CASE WHEN series = '' THEN '' ELSE series || '/' END || book AS dir, CASE WHEN track = '' THEN '' ELSE '0' || track || ' - ' END || title AS stem, {_EXT} AS ext FROM files),
first AS (SELECT *, row_number() OVER d AS turn, first(fp) OVER d AS held FROM placed WINDOW d AS (PARTITION BY dir, stem, ext ORDER BY path)),
turned AS (SELECT *, sum(CASE WHEN turn > 1 AND fp <> held THEN 1 ELSE 0 END) OVER (PARTITION BY dir, stem, ext ORDER BY path) AS renames FROM first)
SELECT CASE WHEN turn > 1 AND fp = held THEN 'dupes/' || path WHEN turn = 1 THEN dir || '/' || stem || '.' || ext ELSE dir || '/' || stem || '.' || CAST(renames + 1 AS VARCHAR) || '.' || ext END AS path, fp FROM turned
UNION ALL SELECT dir || '/cover.jpg' AS path, octet_length(any_value(cover)) || ':' || md5(any_value(cover)) AS fp FROM turned GROUP BY dir"""
ORACLE_SQL = {
    "source_files": DUCKDB + f"SELECT folder, name, {_EXT} AS ext, octet_length(content) AS size FROM files",
    "source_tags": DUCKDB + "SELECT folder, name, author, book, title, track, series, CAST(NULL AS VARCHAR) AS error FROM files",
    "source_properties": DUCKDB
    + """SELECT folder, name, CASE kind WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' WHEN 2 THEN 'aac' ELSE '' END AS codec, CASE kind WHEN 0 THEN 128000 WHEN 1 THEN octet_length(sound) * 4 WHEN 2 THEN 64000 ELSE 256000 END AS bitrate,
  round(CASE kind WHEN 0 THEN 8 * (2085 + octet_length(sound)) / 128000 WHEN 1 THEN 2.0 WHEN 2 THEN 5.5 ELSE octet_length(sound) / 32000 END, 9) AS duration, CAST(CASE kind WHEN 3 THEN 8000 ELSE 44100 END AS INTEGER) AS sample_rate, CAST(2 AS INTEGER) AS channels FROM files""",
    "source_fingerprints": DUCKDB + f"SELECT folder, name, {_FP} AS fp FROM files",
    "source_covers": DUCKDB + "SELECT folder, name, 'cover of ' || book AS cover FROM files",
    "destination_probe": DUCKDB
    + f"SELECT folder || '/' || name AS path, CASE WHEN doc_id % 2 = 1 AND octet_length(content) % 3 > 0 THEN {_FP} ELSE octet_length(content) || ':' END AS disk_fp FROM files WHERE folder IN (SELECT folder FROM files WHERE doc_id % 2 = 1)",
    "carried_out": DUCKDB + _MOVED,
}
