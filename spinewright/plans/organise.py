"""The whole plan: one outcome and one destination for each file, without side effects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FIELDS, build_destination
from ..operators.claims import claims
from ..operators.intra import clusters, intra_duplicates
from ..operators.inventory import KEYED, editions, recalculated, with_edition
from ..operators.ranking import cross_quarantine, ranked, reasons
from ..operators.running import cut, release
from ..sources.files import fingerprinted, met

OUTCOMES = ("move", "in_place", "existing_duplicate", "duplicate", "intra", "cross", "failed")


@dataclass(frozen=True)
class BookDedup:
    """What book-level deduplication found."""

    keyed: DataFrame
    editions: DataFrame
    intra: DataFrame
    rank: DataFrame
    cross: DataFrame
    kept: list[str] = field(default_factory=list)

    @property
    def decisions(self) -> DataFrame:
        return reasons(self.rank)

    def release(self) -> None:
        """Delete what is kept, once no plan needs it any more."""
        release(self.kept)


def book_dedup(files: DataFrame) -> BookDedup:
    """Copies within editions first, then competing editions on what is left.

    Each step is used several times below it, and so written: without that, tags
    would be resolved and folded anew for every use, and plans would grow.
    """
    kept: list[str] = []
    keyed = cut(with_edition(files).select(*KEYED), kept)
    known = cut(editions(keyed), kept)
    intra = cut(intra_duplicates(clusters(keyed, known)), kept)
    rank = cut(ranked(recalculated(known, keyed, intra)), kept)
    return BookDedup(keyed, known, intra, rank, cut(cross_quarantine(rank, keyed, intra), kept), kept)


def with_destination(files: DataFrame, root: str) -> DataFrame:
    """files (path, folder, name and the fields of tags) with dest_dir, dest_file and no_meta."""
    return files.withColumns(build_destination({f: F.col(f) for f in FIELDS}, F.col("folder"), F.col("name"), F.lit(root)))


def plan(files: DataFrame, listing: DataFrame, root: str, dedup: BookDedup | None = None) -> DataFrame:
    """(path, dest_file, no_meta, outcome, final, error) of each file; final: where it ends up if it moves to the library.

    Files kept out within or between editions never claim a destination, and
    neither do files that are in place already, or that fail: those with an
    error, where files have that column. All others go on. Files that have
    dest_file and no_meta already keep them.

    listing: (dest, disk_fp) of what is there. Where it has (dest, size)
    instead, fingerprints are taken only of files that may be equal to another.
    """
    lazy = "disk_fp" not in listing.columns
    placed = files if "dest_file" in files.columns else with_destination(files, root)
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    left = placed.select("path", "dest_file", "no_meta", "size" if lazy else "fp", error.alias("error"))
    there = F.when(F.col("path") == F.col("dest_file"), "in_place")
    if dedup:
        # A path that both name counts as the first.
        paths = dedup.intra.select("path", F.lit(0).alias("by")).union(dedup.cross.select("path", F.lit(1))).groupBy("path").agg(F.min("by").alias("by"))
        left = left.join(paths, "path", "left")
        there = F.when(F.col("by") == 0, "intra").when(F.col("by") == 1, "cross").otherwise(there)
    left = cut(left.withColumn("outcome", there).drop("by"))
    parts = [left.where(F.col("outcome").isNotNull())]
    left = left.where(F.col("outcome").isNull()).drop("outcome")
    if lazy:
        listing = cut(listing)
        left = cut(fingerprinted(left, listing))
        listing = met(listing, left)
    parts.append(left.where(F.col("error").isNotNull()).withColumn("outcome", F.lit("failed")))
    done = claims(left.where(F.col("error").isNull()), listing, ("no_meta",))
    outcome = F.when(F.col("action") == "proceed", "move").when(F.col("action") == "skip", "existing_duplicate").otherwise("duplicate")
    out = done.select("path", "dest_file", "no_meta", outcome.alias("outcome"), F.when(F.col("action") == "proceed", F.col("final")).alias("final"), F.lit(None).cast("string").alias("error"))
    for part in parts:
        out = out.unionByName(part.drop("fp", "size"), allowMissingColumns=True)
    return out


def counts(groups: int = 0) -> dict:
    """The aggregates of a plan that a run reports, by name; groups: books of which one edition of several stays."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return {
        "files": F.count("*"), "moved": is_("move"), "skipped": is_("in_place", "existing_duplicate"), "dupe": is_("duplicate", "existing_duplicate"), "conflict": F.count_if((F.col("outcome") == "move") & (F.col("final") != F.col("dest_file"))),
        "intra_dedup": is_("intra"), "book_dedup": is_("cross"), "book_dedup_groups": F.max(F.lit(groups).cast("bigint")), "failed": is_("failed"), "no_meta": F.count_if((F.col("outcome") == "move") & F.col("no_meta")),
    }


def counters(planned: DataFrame, dedup: BookDedup | None = None) -> DataFrame:
    """One row of counts, as a run reports them."""
    out = planned.agg(*(c.alias(k) for k, c in counts().items()))
    if dedup is None:
        return out.na.fill(0)
    # Both sides are one row.
    groups = dedup.rank.where("rank = 1").agg(F.count("*").alias("groups"))
    return out.crossJoin(F.broadcast(groups)).withColumn("book_dedup_groups", F.col("groups")).drop("groups")
