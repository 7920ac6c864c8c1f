"""Plain-text reports of a run."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import edition_summary, format_quality
from .operators.inventory import EDITION
from .operators.ranking import GROUP


#: What a line is about, and how a terminal shows it: errors, what asks for attention, what is kept or moved, copies, files, what is passed over, headings.
STYLES = (
    (r"FAILED|ERROR", "31"), (r"\s*(WARNING|CONFLICT|Run with --move|Review duplicates)", "33"), (r"\s*(KEEP|MOVED)|/", "32"), (r"\s*QUARANTINE", "35"), (r"\s*FILE", "36"), (r"\s*EXISTING|\[DRY RUN\]", "2"),
    (r"DRY RUN complete|Complete|[A-Z-]+ DEDUP: |Found ", "1"),
)


class Log:
    """Lines to the terminal, in colours if it is one, and to a file without them, which each run begins anew."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.file = open(path, "w", encoding="utf-8")
        self.colours = sys.stdout.isatty()

    def styled(self, line: str) -> str:
        """Each line of the text in its style."""
        styles = (next((style for pattern, style in STYLES if re.match(pattern, part)), None) for part in line.split("\n"))
        return "\n".join(f"\x1b[{style}m{part}\x1b[0m" if style else part for part, style in zip(line.split("\n"), styles))

    def __call__(self, line: str = "") -> None:
        shown = self.styled(line) if self.colours else line
        try:
            print(shown, flush=True)
        except UnicodeEncodeError:
            code = sys.stdout.encoding or "ascii"
            print(shown.encode(code, "replace").decode(code), flush=True)
        self.file.write(line + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()


def header(config) -> Iterator[str]:
    for name in ("source", "dest", "dupes", "log"):
        yield f"  {name.capitalize():12}: {getattr(config, name)}"
    yield f"  {'Covers':12}: {'yes' if config.covers else 'no'}"
    yield f"  {'Mode':12}: " + ("DRY RUN, nothing is moved (add --move)" if config.dry_run else "LIVE, files are moved")


def file_lines(files: DataFrame, quality: bool) -> DataFrame:
    """(path, line): what is known of each file and where it goes."""
    pair = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"  {label:9}: "), F.col(c)))
    lines = [F.concat(F.lit("  FILE     : "), "path"), *(pair(c.capitalize(), c) for c in ("author", "book", "series", "title", "track", "year", "narrator", "subtitle", "genre"))]
    if quality:
        lines.append(F.concat(F.lit("  Quality  : "), format_quality(*(F.col(c) for c in ("codec", "bitrate", "sample_rate", "channels", "duration")))))
    lines += [F.when(F.col("no_meta"), "  WARNING  : no embedded tags, inferred from path or name"), F.concat(F.lit("  --> "), "dest_file")]
    return files.select("path", F.concat_ws("\n", *lines).alias("line"))


def decision_lines(rank: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group, line): for each book what is kept, what isn't, and why."""
    summary = edition_summary(*(F.col(c) for c in ("format", "year", "avg_bitrate", "total_duration", "file_count")))
    line = F.concat(F.when(F.col("rank") == 1, "    KEEP:       ").otherwise("    QUARANTINE: "), "edition_dir", F.lit(" ("), summary, F.lit(")"))
    lines = rank.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    out = lines.join(decisions, list(GROUP))
    return out.select(*GROUP, F.concat_ws("\n", F.concat(F.lit("  "), "display"), F.array_join("lines", "\n"), F.concat(F.lit("    Reason: "), "reason")).alias("line"))


def intra_lines(intra: DataFrame, known: DataFrame) -> DataFrame:
    """(edition_dir, kept, line): for each cluster of copies within an edition what is kept, what isn't, and why."""
    base = lambda c: F.regexp_extract(c, "(?s)([^/]*)$", 1)
    title = F.when(F.col("book") != "", F.concat(F.lit('"'), F.col("book"), F.lit('"'))).otherwise("(unknown book)")
    display = F.when(F.col("author") != "", F.concat(title, F.lit(" by "), F.col("author"))).otherwise(title)
    found = intra.groupBy(*EDITION, "ext", "cluster_start", "kept").agg(F.array_sort(F.collect_list("path")).alias("lost"), F.first("reason").alias("reason")).join(known.select(*EDITION, display.alias("display")), list(EDITION))
    lost = F.transform("lost", lambda p: F.concat(F.lit("    QUARANTINE: "), base(p)))
    return found.select("edition_dir", "kept", F.concat_ws("\n", F.concat(F.lit("  "), "display", F.lit(" ["), base(F.col("edition_dir")), F.lit("]")), F.concat(F.lit("    KEEP:       "), base(F.col("kept"))), F.array_join(lost, "\n"), F.concat(F.lit("    Reason: "), "reason")).alias("line"))


def intra_heading(intra: DataFrame) -> str:
    """How many copies within editions there are, and in how many clusters."""
    files, groups = intra.agg(F.count("*"), F.count_distinct(*EDITION, "ext", "cluster_start")).first()
    return f"INTRA-EDITION DEDUP: {files} duplicate file(s) in {groups} edition(s)"


def decision_heading(rank: DataFrame) -> str:
    """How many books have several editions."""
    return f"BOOK-LEVEL DEDUP: {rank.where('rank = 1').count()} book(s) with multiple editions"


def summary(done, counts, config) -> Iterator[str]:
    """counts: what the plan says, by name; done: what was carried out."""
    dry = config.dry_run
    yield "DRY RUN complete" if dry else "Complete"
    would = lambda told, did: f"({told})" if dry else did
    rows = [
        ("Would move" if dry else "Moved", done.moved, "files"), ("Skipped", counts["skipped"], would("already in place", "")), ("Covers", done.covers, "extracted") if not dry else None,
        ("Duplicates", counts["dupe"], would(f"would quarantine to {config.dupes}", "quarantined")), ("Conflicts", counts["conflict"], would("would rename with suffix", "renamed")), ("Failed", done.failed, ""),
        ("Intra dedup", counts["intra_dedup"], "duplicate files " + would("would quarantine", "quarantined")) if counts["intra_dedup"] else None,
        ("Book dedup", f"{counts['book_dedup_groups']} groups resolved, {counts['book_dedup']}", "files " + would("would quarantine", "quarantined")) if counts["book_dedup_groups"] else None,
    ]
    for label, n, note in filter(None, rows):
        yield f"  {label:14}: {n} {note}".rstrip()
    if done.no_meta:
        yield f"  WARNING: {done.no_meta} files had no tags, inferred from path or name"
    if dry:
        yield "  Run with --move to apply."
    elif counts["dupe"] or counts["intra_dedup"] or counts["book_dedup"]:
        yield f"  Review duplicates in {config.dupes}"
