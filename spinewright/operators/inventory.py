"""Editions: what is known of the files of one book in one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import infer_from_filename, infer_from_path
from ..functions.text import normalise_author, normalise_book, or_empty
from .running import cut

#: An edition is known by its folder and the keys of its files' own tags.
EDITION = ("edition_dir", "tag_author_key", "tag_book_key")
#: What book-level deduplication looks at.
KEYED = (*EDITION, "path", "folder", "name", "ext", "size", "author", "book", "year", "bitrate", "duration")
#: Durations are added up as whole microseconds, so that a sum doesn't depend on its order.
MICRO = 1_000_000


def micros(seconds: Column) -> Column:
    return F.round(seconds * MICRO).cast("bigint")


def with_edition(files: DataFrame) -> DataFrame:
    """files (path, folder, name, ext, size, author, book, year, bitrate, duration) and the key of their edition; a file right under the source is an edition of its own."""
    directory = F.when(F.col("folder") == "", F.col("path")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return files.withColumns({"edition_dir": directory, "tag_author_key": normalise_author(F.col("author")), "tag_book_key": normalise_book(F.col("book"))})


def editions(keyed: DataFrame) -> DataFrame:
    """One row for each edition of what with_edition gives.

    Totals are summed per extension first and then per edition, both with
    partial sums. Of extensions m4b wins, then the most frequent, then that of
    the first path. A blank author or book comes from the first file's path or
    name. Editions without any author and book don't compete: only the last of
    them, in the order of first paths by folder and then by edition, stays.
    """
    first = F.struct("author", "book", "year", "folder", "name")
    per_ext = keyed.groupBy(*EDITION, "ext").agg(
        F.count("*").alias("n"), F.sum("bitrate").alias("bitrate"), F.sum(micros(F.col("duration"))).alias("micros"), F.sum("size").alias("size"), F.min("path").alias("first_path"), F.min_by(first, "path").alias("first")
    )
    own = per_ext.groupBy(*EDITION).agg(
        F.sum("n").alias("file_count"), F.sum("bitrate").alias("bitrate"), F.sum("micros").alias("micros"), F.sum("size").alias("total_size"), F.min("first_path").alias("first_path"), F.min_by("first", "first_path").alias("first"),
        F.bool_or(F.col("ext") == "m4b").alias("m4b"), F.min_by("ext", F.struct(-F.col("n"), F.col("first_path"))).alias("frequent"),
    )
    by_path, by_name = infer_from_path(F.col("first.folder")), infer_from_filename(F.col("first.name"))
    out = own.select(
        *EDITION, or_empty(F.col("first.author"), by_path[0], by_name[0]).alias("author"), or_empty(F.col("first.book"), by_path[1], by_name[1]).alias("book"), F.col("first.year").alias("year"), F.when(F.col("m4b"), "m4b").otherwise(F.col("frequent")).alias("format"),
        (F.col("micros") / MICRO).alias("total_duration"), F.floor(F.col("bitrate") / F.col("file_count")).cast("bigint").alias("avg_bitrate"), "file_count", "total_size", "first_path", F.col("first.folder").alias("folder"), F.col("first.name").alias("first_name"),
    )
    out = out.withColumns({"group_author": normalise_author(F.col("author")), "group_book": normalise_book(F.col("book"))})
    # Names are folded once; what follows looks at the keys twice.
    out = cut(out)
    blank = (F.col("group_author") == "") & (F.col("group_book") == "")
    # One row, which is nulls if no edition is blank.
    began = F.min("first_path").over(Window.partitionBy("edition_dir"))
    last = out.withColumn("began", began).where(blank).agg(F.max_by("first_path", F.struct("began", "first_path")).alias("last"))
    return out.join(F.broadcast(last), F.lit(True)).where(~blank | (F.col("first_path") == F.col("last"))).drop("last")


def recalculated(known: DataFrame, keyed: DataFrame, removed: DataFrame) -> DataFrame:
    """Editions with the totals of the files that aren't removed (by path); the format stays what it was."""
    left = keyed.join(removed.select("path").distinct(), "path", "left_anti")
    totals = left.groupBy(*EDITION).agg(F.count("*").alias("n"), F.sum("bitrate").alias("b"), F.sum(micros(F.col("duration"))).alias("m"), F.sum("size").alias("s"))
    out = known.join(totals, list(EDITION))
    new = {"file_count": F.col("n"), "avg_bitrate": F.floor(F.col("b") / F.col("n")).cast("bigint"), "total_duration": F.col("m") / MICRO, "total_size": F.col("s")}
    return out.withColumns(new).select(*known.columns)
