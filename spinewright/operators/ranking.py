"""Editions of one book: which is kept, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import FORMAT_SCORE, PLACEHOLDERS
from ..functions.text import all_digits, normalise_author, normalise_authors
from .inventory import EDITION

GROUP = ("group_author", "group_book")


def scored(known: DataFrame) -> DataFrame:
    """Editions with what they are ranked by."""
    formats = F.create_map(*(F.lit(x) for kv in FORMAT_SCORE.items() for x in kv))
    out = known.withColumn("segments", F.filter(F.when(F.col("folder") == "", F.array("first_name")).otherwise(F.split("folder", "/")), lambda s: (s != "") & (s != ".")))
    out = out.withColumns({"segment_keys": normalise_authors(F.col("segments")), "own_author": normalise_author(F.col("author"))})
    return out.withColumns(
        {
            "format_score": F.coalesce(F.try_element_at(formats, F.col("format")), F.lit(0)),
            "year_score": F.when(all_digits(F.col("year")), F.col("year").try_cast("int")).otherwise(0),
            "root_loose": (F.col("folder") == "").cast("int"),
            "placeholder_hits": F.size(F.filter("segments", lambda s: F.lower(s).isin(*PLACEHOLDERS))),
            "author_mismatch": (~((F.col("own_author") != "") & F.array_contains("segment_keys", F.col("own_author")))).cast("int"),
            "depth": F.size("segments"),
        }
    ).drop("segment_keys", "own_author")


def ranked(known: DataFrame) -> DataFrame:
    """Editions of books with two or more, with their rank and the number of editions; rank 1 is kept.

    One order: format, year, bitrate and length from the highest; then files
    not loose at the root, fewest placeholder folders, a folder named after the
    author, the deepest folder, and the first folder by name.
    """
    book = Window.partitionBy(*GROUP)
    desc, asc = ("format_score", "year_score", "avg_bitrate", "total_duration"), ("root_loose", "placeholder_hits", "author_mismatch")
    order = [*(F.desc(c) for c in desc), *asc, F.desc("depth"), F.asc("edition_dir"), F.asc("first_path")]
    several = scored(known).withColumn("editions", F.count("*").over(book)).where(F.col("editions") > 1)
    return several.withColumn("rank", F.row_number().over(book.orderBy(*order)))


def reasons(rank: DataFrame) -> DataFrame:
    """One row a book: display, the folder that is kept, how many lose, and why, loser by loser."""
    best = Window.partitionBy(*GROUP).orderBy("rank")
    kept = F.first(F.struct("format", "format_score", "year", "year_score", "avg_bitrate", "edition_dir", "author", "book")).over(best)
    kbps = lambda c: F.floor(c / 1000).cast("bigint")
    k = F.col("k")
    newer = k["year_score"] > F.col("year_score")
    why = F.array(
        F.when(k["format_score"] > F.col("format_score"), F.concat(F.upper(k["format"]), F.lit(" preferred over "), F.upper("format"))),
        F.when(newer & (k["year"] != "") & (F.col("year") != ""), F.concat(F.lit("newer recording ("), k["year"], F.lit(" vs "), F.col("year"), F.lit(")"))).when(newer & (k["year"] != ""), F.concat(F.lit("has year metadata ("), k["year"], F.lit(")"))),
        F.when((k["avg_bitrate"] > F.col("avg_bitrate")) & (kbps(k["avg_bitrate"]) != kbps(F.col("avg_bitrate"))), F.concat(F.lit("higher bitrate ("), kbps(k["avg_bitrate"]).cast("string"), F.lit("kbps vs "), kbps(F.col("avg_bitrate")).cast("string"), F.lit("kbps)"))),
    )
    losers = rank.withColumn("k", kept).where(F.col("rank") > 1).withColumn("why", F.array_compact(why))
    out = losers.groupBy(*GROUP).agg(F.first("k").alias("k"), F.count("*").alias("losers"), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "why"))), lambda x: x["why"])), "; ").alias("reason"))
    title = F.when(k["book"] != "", F.concat(F.lit('"'), k["book"], F.lit('"'))).otherwise("(unknown book)")
    display = F.when(k["author"] != "", F.concat(title, F.lit(" by "), k["author"])).otherwise(title)
    return out.select(*GROUP, display.alias("display"), k["edition_dir"].alias("kept_dir"), "losers", F.when(F.col("reason") == "", "higher overall score").otherwise(F.col("reason")).alias("reason"))


def cross_quarantine(rank: DataFrame, keyed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The files (path) of editions that lose, without those that were removed within their edition."""
    out = keyed.join(rank.where(F.col("rank") > 1).select(*EDITION), list(EDITION), "left_semi").select("path")
    return out if removed is None else out.join(removed.select("path"), "path", "left_anti")
