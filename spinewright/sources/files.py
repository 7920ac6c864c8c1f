"""The files of a library as a DataFrame.

Spark's own binary source hides names that begin with an underscore or a dot,
which libraries have, and reads whole files. Here folders are listed by tasks,
level by level, so that the driver never holds paths; and what is inside a file
is a column that a worker reads only for rows and columns that are asked for:
a plan that selects paths and sizes opens no file. Paths are of the local file
system or URIs of any that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import EXTENSIONS, FINGERPRINT_BYTES
from ..functions.paths import lower_keys, resolve
from ..functions.text import extension
from ..operators.claims import family
from ..operators.running import cut
from . import tags

_PARSED = "tags map<string,string>, bitrate bigint, duration double, codec string, sample_rate int, channels int, error string"
_ARROW = pa.struct([("tags", pa.map_(pa.string(), pa.string())), ("bitrate", pa.int64()), ("duration", pa.float64()), ("codec", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("error", pa.string())])
_HASHED = pa.struct([("fp", pa.string()), ("error", pa.string())])
#: Rows of a batch that a listing task gives.
BATCH = 2000


def opened(path: str):
    """A file of the local file system, or of the one that a URI names, for reading."""
    if "://" not in path:
        return open(path, "rb")
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of what is in a folder; links to folders are left out, and so is all of a folder that can't be read."""
    try:
        if "://" not in folder:
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir():
                        if not e.is_symlink():
                            yield e.path, 0, True
                    else:
                        yield e.path, os.path.getsize(e.path) if os.path.exists(e.path) else 0, False
            return
        store, at = fs.FileSystem.from_uri(folder)
        head = folder[: len(folder) - len(at)] if folder.endswith(at) else folder[: folder.index("://") + 3]
        for e in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            yield head + e.path, e.size or 0, e.type == fs.FileType.Directory
    except OSError:
        return


class Lister:
    """(path, size, is_folder) of what is in each of some folders: the folders, and the files with one of these extensions in any case, or all."""

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_folder", pa.bool_())])

    def __init__(self, extensions: tuple[str, ...] | None):
        self.extensions = extensions

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        arrow = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)], schema=self.schema)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in entries(folder):
                    if row[2] or self.extensions is None or os.path.splitext(row[0])[1].lstrip(".").lower() in self.extensions:
                        rows.append(row)
                        if len(rows) == BATCH:
                            yield arrow()
                            rows = []
        if rows:
            yield arrow()


def _normal(root: str) -> str:
    return root.rstrip("/") if "://" in root else os.path.normpath(os.path.abspath(root))


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """(path, size) of the files under root, none of them opened; a folder that isn't there has none.

    Each level of folders is one job, whose tasks share the folders of the level
    among them, so that one deep or wide branch doesn't hold up a task.
    """
    level = spark.createDataFrame([(_normal(root),)], "folder string")
    out = None
    while True:
        found = cut(level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(Lister(extensions), "path string, size bigint, is_folder boolean"))
        files = found.where("NOT is_folder").select("path", "size")
        out = files if out is None else out.union(files)
        level = found.where("is_folder").select(F.col("path").alias("folder"))
        if level.isEmpty():
            return out


def fingerprint(path: str) -> str:
    """Size and digest of the head."""
    with opened(path) as f:
        head = f.read(FINGERPRINT_BYTES)
        return f"{f.seek(0, os.SEEK_END)}:{hashlib.md5(head).hexdigest()}"


def _parse(paths: pa.Array) -> pa.Array:
    out = []
    for path in paths.to_pylist():
        row = {"tags": [], "error": None} | tags.info()
        try:
            with opened(path) as f:
                own, found, _ = tags.read(f)
            row |= {"tags": list(own.items())} | found
        except OSError as e:
            row["error"] = str(e)
        out.append(row)
    return pa.array(out, _ARROW)


def _pictures(paths: pa.Array) -> pa.Array:
    out = []
    for path in paths.to_pylist():
        try:
            with opened(path) as f:
                out.append(tags.read(f)[2])
        except OSError:
            out.append(None)
    return pa.array(out, pa.binary())


def _hashed(path: Column, hasher: Callable[[str], str] = fingerprint) -> Column:
    """The fingerprint of a path, or why it has none; nothing is opened for a null."""

    def hashed(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            try:
                out.append({"fp": hasher(p) if p is not None else None, "error": None})
            except OSError as e:
                out.append({"fp": None, "error": str(e)})
        return pa.array(out, _HASHED)

    return F.arrow_udf(hashed, "fp string, error string")(path)


def read_library(spark: SparkSession, root: str, partitions: int = 8, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """The audio files under root: where and how large they are, and, read only if asked for, tags and their fields, stream properties, error, cover and fp.

    error says why a file couldn't be opened; a file without readable tags is no
    error and has none. fp opens every file of the rows left; fingerprinted
    opens those alone that may be equal to another.
    """
    root = _normal(root)
    files = list_files(spark, root, extensions).repartition(partitions)
    inner = F.substr("path", F.lit(len(root) + 2 - root.endswith("/")))
    name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    files = files.select("path", F.regexp_extract(inner, r"(?s)^(.*)/[^/]*$", 1).alias("folder"), name.alias("name"), "size").withColumn("ext", extension(F.col("name")))
    files = files.withColumn("parsed", F.arrow_udf(_parse, _PARSED)("path"))
    own = [F.col(f"parsed.{c}").alias(c) for c in ("tags", "bitrate", "duration", "codec", "sample_rate", "channels", "error")]
    files = files.select("path", "folder", "name", "ext", "size", *own).withColumn("tags", lower_keys(F.col("tags")))
    return files.withColumns(resolve(F.col("tags"))).withColumns({"cover": F.arrow_udf(_pictures, "binary")("path"), "fp": _hashed(F.col("path"))["fp"]})


def list_claimed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(dest, size) of what is in the folders under root that files (dest_file) go to; no other folder is listed."""
    root = _normal(root)
    folder = F.regexp_extract("dest_file", r"(?s)^(.*)/[^/]*$", 1)
    folders = files.select(folder.alias("folder")).distinct().where(((F.col("folder") == root) | F.startswith("folder", F.lit(root.rstrip("/") + "/"))) & ~F.col("folder").rlike(r"(^|/)\.\.(/|$)"))
    found = folders.mapInArrow(Lister(None), "path string, size bigint, is_folder boolean")
    return found.where("NOT is_folder").select(F.col("path").alias("dest"), "size")


def met(there: DataFrame, files: DataFrame, hasher: Callable[[str], str] = fingerprint) -> DataFrame:
    """(dest, disk_fp) of what is there (dest, size). Only what lies where one of files (dest_file, size) of its own size wants to be is opened; the rest can't be equal to any of them, and has its size alone as fingerprint."""
    wanted = files.select(F.col("dest_file").alias("dest"), "size", F.lit(True).alias("wanted")).distinct()
    rows = there.join(wanted, ["dest", "size"], "left").withColumn("hashed", _hashed(F.when(F.col("wanted"), F.col("dest")), hasher))
    return rows.select("dest", F.coalesce("hashed.fp", F.concat(F.col("size").cast("string"), F.lit(":"))).alias("disk_fp"))


def read_listing(spark: SparkSession, root: str, files: DataFrame | None = None, partitions: int = 8, hasher: Callable[[str], str] = fingerprint) -> DataFrame:
    """(dest, disk_fp) of what is under a library already; a folder that isn't there has no files.

    With files (dest_file, size), only the folders that they go to are listed,
    and only files that one of them may be equal to are opened.
    """
    if files is not None:
        return met(list_claimed(spark, root, files), files, hasher)
    rows = list_files(spark, root, None).repartition(partitions)
    return rows.select(F.col("path").alias("dest"), F.coalesce(_hashed(F.col("path"), hasher)["fp"], F.concat(F.col("size").cast("string"), F.lit(":"))).alias("disk_fp"))


def fingerprinted(files: DataFrame, there: DataFrame, hasher: Callable[[str], str] = fingerprint) -> DataFrame:
    """files (path, dest_file, size, error, ...) with fp, given what is there (dest, size).

    Only files with a rival are opened: one of the same size that wants a name
    of the same family, or one of the same size that is at the destination. Of
    all others the size alone is the fingerprint, which no rival has. A file
    that can't be opened gets an error.
    """
    own = files.drop("fp").withColumn("family", family(F.col("dest_file")))
    rivals = own.groupBy("family", "size").count().where("count > 1").select("family", "size", F.lit(True).alias("rival"))
    at = there.select(F.col("dest").alias("dest_file"), "size", F.lit(True).alias("met")).distinct()
    own = own.join(rivals, ["family", "size"], "left").join(at, ["dest_file", "size"], "left")
    contested = F.coalesce("rival", "met", F.lit(False)) & F.col("error").isNull()
    own = own.withColumn("hashed", _hashed(F.when(contested, F.col("path")), hasher))
    return own.select(*(c for c in files.columns if c not in ("fp", "error")), F.coalesce("hashed.fp", F.concat(F.col("size").cast("string"), F.lit(":"))).alias("fp"), F.coalesce("error", "hashed.error").alias("error"))
