"""``python -m spinewright.cli``: organise a library; a dry run unless told to move."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession

from . import report
from .executor import Journal, apply
from .operators.running import counted, cut, release
from .plans.organise import book_dedup, counts, plan, with_destination
from .sources.files import list_claimed, read_library


@dataclass(frozen=True)
class Config:
    source: str = "/audiobooks_unsorted"
    dest: str = "/audiobooks"
    dupes: str = "./audiobook_dupes"
    log: str = "./organise.log"
    dry_run: bool = True
    covers: bool = True
    book_dedup: bool = False
    show_quality: bool = False
    workers: int = 0
    journal: str = ""


def parse(argv: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(prog="spinewright", description="Organise a library of audio books.")
    p.add_argument("--move", dest="dry_run", action="store_false", help="move files (else a dry run)")
    p.add_argument("--dry-run", dest="dry_run", action="store_true", help=argparse.SUPPRESS)
    p.set_defaults(dry_run=True)
    for name in ("source", "dest", "dupes", "log"):
        p.add_argument(f"--{name}", default=getattr(Config, name))
    p.add_argument("--no-cover", dest="covers", action="store_false", help="leave covers in their files")
    p.add_argument("--book-dedup", action="store_true", help="keep one edition of each book")
    p.add_argument("--show-quality", action="store_true", help="log stream properties")
    p.add_argument("--workers", type=int, default=0, help="partitions to read by (0: as many as cores, 16 at most)")
    p.add_argument("--journal", default="", help="a folder; a live run that was stopped goes on from what is in it")
    return Config(**vars(p.parse_args(argv)))


def organise(spark: SparkSession, config: Config, log=print):
    """Plan and carry out one run; what was done and the counts, or None if there was nothing to do."""
    for line in report.header(config):
        log(line)
    if not os.path.isdir(config.source):
        log(f"ERROR: source not found: {config.source}")
        sys.exit(1)
    dest, source = os.path.normpath(os.path.abspath(config.dest)), os.path.abspath(config.source)
    if config.journal and not config.dry_run and Journal(config.journal).exists():
        log("Going on with the run that was stopped")
        return apply(None, source, dest, config.dupes, False, config.covers, log, config.journal), None
    kept: list[str] = []
    files = cut(read_library(spark, config.source, config.workers or min(os.cpu_count() or 4, 16)).drop("fp", "cover"), kept)
    total = files.count()
    log(f"Found {total} audio file(s)")
    if not total:
        release(kept)
        return None
    dedup = book_dedup(files) if config.book_dedup else None
    if dedup:
        for heading, lines, order in (
            (report.intra_heading(dedup.intra), report.intra_lines(dedup.intra, dedup.editions), ("edition_dir", "kept")),
            (report.decision_heading(dedup.rank), report.decision_lines(dedup.rank, dedup.decisions), ("group_author", "group_book")),
        ):
            log(heading)
            for r in lines.orderBy(*order).toLocalIterator():
                log(r.line)
    placed = cut(with_destination(files, dest), kept)
    groups = dedup.rank.where("rank = 1").count() if dedup else 0
    planned, found = counted(plan(placed, list_claimed(spark, dest, placed), dest, dedup), counts(groups), kept)
    for r in report.file_lines(placed, config.show_quality).orderBy("path").toLocalIterator():
        log(r.line)
    done = apply(planned, source, dest, config.dupes, config.dry_run, config.covers, log, config.journal or None)
    for line in report.summary(done, found, config):
        log(line)
    release(kept)
    if dedup:
        dedup.release()
    return done, Row(**found)


def main(argv: list[str] | None = None) -> None:
    config = parse(argv)
    log = report.Log(config.log)
    try:
        spark = SparkSession.builder.getOrCreate()
        sc = spark.sparkContext
        if sc.master.startswith("local") and not sc.getConf().contains("spark.sql.shuffle.partitions"):
            spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))  # one machine has no use for 200
        organise(spark, config, log)
    except KeyboardInterrupt:
        log("Interrupted.")
    finally:
        log.close()


if __name__ == "__main__":
    main()
