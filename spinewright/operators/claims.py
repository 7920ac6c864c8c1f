"""Destinations: who may go where, in the order of paths.

The rule goes file by file, but it can be answered name by name. Who claims a
name is known from its first file, from what is there already, and from the file
that a rename brought there, which only the name without its number can do; so
names are settled by how many numbers they end in. The conflicts of a name take
numbers in their order, and pass those that are there already or that a file of
its own had claimed before; how many were passed is a matter of numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import cut, running

#: A number that renames give; longer ones are never reached.
_NUMBER = r"\.(?:[2-9]|[1-9]\d{1,14})"
#: The threshold of a number that is there already.
_ALWAYS = 1 << 62


def _split(dest):
    """(folder and stem, extension with its dot) of a destination."""
    name = F.substring_index(dest, "/", -1)
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    return F.substr(dest, F.lit(1), F.length(dest) - F.length(ext)), ext


def family(dest: Column) -> Column:
    """What the names have in common that a rename can lead to from each other: all but the numbers behind the stem."""
    base, suffix = _split(dest)
    return F.concat(F.regexp_replace(base, r"(\.\d+)+$", ""), suffix)


def _free(base: str, ext: str, taken, numbers: dict) -> str:
    """The first free name; names are never freed, so that the search goes on where the last one for this base ended."""
    n = numbers.get((base, ext), 2)
    while f"{base}.{n}{ext}" in taken:
        n += 1
    numbers[base, ext] = n + 1
    return f"{base}.{n}{ext}"


def fold(rows: list[tuple]) -> list[tuple]:
    """The rule itself, file by file, over the (path, dest_file, fp, base, suffix) of one family in the order of their paths; rows without a path are what is there already.

    For lists that fit in memory; claims gives the same for any number of files.
    """
    disk = {dest: fp for path, dest, fp, _, _ in rows if path is None}
    claimed: dict[str, str] = {}
    numbers: dict[tuple, int] = {}
    taken, out = set(disk), []
    for path, dest, fp, base, suffix in rows:
        if path is None:
            continue
        final = dest
        if dest in claimed or dest in disk:
            if fp == (claimed[dest] if dest in claimed else disk[dest]):
                out.append((path, dest, "quarantine" if dest in claimed else "skip", dest))
                continue
            final = _free(base, suffix, taken, numbers)
        claimed[final] = fp
        taken.add(final)
        out.append((path, dest, "proceed", final))
    return out


class Passed:
    """(name, at, shift) of (name, number, threshold) rows sorted by name and number.

    With k numbers passed so far, a number is passed as well if k is below its
    threshold; from conflict at on, the numbers given are then shift higher. Only
    k is kept in mind.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for batch in batches:
            out = []
            for name, number, threshold in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    now, k = name, 0
                if k < threshold:
                    out.append((name, number - 1 - k, k + 1))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), *(pa.array([r[c] for r in out], pa.int64()) for c in (1, 2))], names=["name", "at", "shift"])


def _named(dest: Column) -> dict[str, Column]:
    """What a name is made of: base and suffix; how many numbers it ends in; the name without the last of them, and that number."""
    base, suffix = _split(dest)
    # Few names end in a digit; the others aren't searched.
    digit = F.right(base, F.lit(1)).between("0", "9")
    numbers = F.when(digit, F.regexp_extract(base, rf"(?s)((?:{_NUMBER})*)$", 1)).otherwise("")
    last = F.when(digit, F.regexp_extract(base, rf"(?s){_NUMBER}$", 0)).otherwise("")
    return {
        "base": base, "suffix": suffix, "depth": F.length(numbers) - F.length(F.replace(numbers, F.lit("."))), "number": F.when(last != "", F.substr(last, F.lit(2)).cast("bigint")),
        "parent": F.when(last != "", F.concat(F.substr(base, F.lit(1), F.length(base) - F.length(last)), suffix)),
    }


def _renamed(conflicts: DataFrame, numbered: DataFrame | None, also: tuple[str, ...] = ()) -> DataFrame:
    """The conflicts (path, dest_file, fp, base, suffix and also) with the name that each gets.

    numbered: the names (parent, number, first, there) that their numbers may
    meet; None if there are none.
    """
    events = conflicts.select(F.col("dest_file").alias("name"), F.col("path").alias("at"), F.lit(1).cast("bigint").alias("one"), "path", "fp", "base", "suffix", *also)
    if numbered is None:
        out = running(events, "name", ["at"], "one").withColumn("n", F.col("running") + 1)
    else:
        met = numbered.join(conflicts.select(F.col("dest_file").alias("parent")).distinct(), "parent", "left_semi")
        own = met.where(F.col("first").isNotNull() & ~F.col("there")).select(F.col("parent").alias("name"), F.col("first").alias("at"), F.lit(0).cast("bigint").alias("one"), "number")
        placed = running(events.unionByName(own, allowMissingColumns=True), "name", ["at"], "one")
        gaps = placed.where(F.col("number").isNotNull()).select("name", "number", (F.col("number") - 1 - F.col("running")).alias("threshold"))
        gaps = gaps.union(met.where("there").select("parent", "number", F.lit(_ALWAYS).cast("bigint")))
        passed = gaps.repartition("name").sortWithinPartitions("name", "number").mapInArrow(Passed(), "name string, at bigint, shift bigint")
        turns = placed.where(F.col("number").isNull()).select("name", F.col("running").alias("turn"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("shift"), "path", "fp", "base", "suffix", *also)
        turns = turns.unionByName(passed.select("name", F.col("at").alias("turn"), F.lit(0).alias("kind"), "shift"), allowMissingColumns=True)
        out = running(turns, "name", ["turn", "kind"], "shift", largest=True).where("kind = 1").withColumn("n", F.col("turn") + 1 + F.col("running"))
    return out.select("path", F.col("name").alias("dest_file"), "fp", F.concat("base", F.lit("."), F.col("n").cast("string"), "suffix").alias("final"), *also)


def claims(files: DataFrame, listing: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, dest_file, action, final and also) of files (path, dest_file, fp and also), given listing (dest, disk_fp) of what is there.

    The first file to come claims its destination. A later one with the same
    fingerprint is quarantined, another is renamed by the first free number
    from 2. A file whose equal is at its destination already is skipped. A null
    fingerprint is equal to none.

    Nothing is gathered for a name or a family: names are settled by partial
    aggregates, files joined to them, conflicts numbered by running totals over
    ranges. Of the names that a number may meet, their numbers pass one task in
    order, and only if the name has conflicts.
    """
    rows = cut(files.select("path", "dest_file", "fp", *also).withColumns(_named(F.col("dest_file"))))
    disk = cut(listing.groupBy(F.col("dest").alias("dest_file")).agg(F.max("disk_fp").alias("disk_fp")).withColumns(_named(F.col("dest_file"))).withColumn("there", F.lit(True)))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    numbered = max(deepest, disk.agg(F.max("depth")).first()[0] or 0)
    firsts = rows.groupBy("dest_file", "depth", "parent", "number").agg(F.min("path").alias("first"), F.min_by("fp", "path").alias("first_fp"))
    made, parts = None, []
    for depth in range(deepest + 1):
        names = firsts.where(F.col("depth") == depth).select("dest_file", "first", "first_fp").join(disk.select("dest_file", "disk_fp", "there"), "dest_file", "left")
        if made is None:
            names = names.withColumns({"brought": F.lit(None).cast("string"), "brought_fp": F.lit(None).cast("string")})
        else:
            names = names.join(made.select(F.col("final").alias("dest_file"), F.col("path").alias("brought"), F.col("fp").alias("brought_fp")), "dest_file", "left")
        holder = F.when(F.col("there"), "disk").when(F.col("brought") < F.col("first"), "brought").otherwise("first")
        held = F.when(F.col("there"), F.col("disk_fp")).when(F.col("brought") < F.col("first"), F.col("brought_fp")).otherwise(F.col("first_fp"))
        names = names.select("dest_file", "first", holder.alias("holder"), held.alias("held"))
        same = F.coalesce(F.col("fp") == F.col("held"), F.lit(False))
        action = F.when((F.col("holder") == "first") & (F.col("path") == F.col("first")), "proceed").when(~same, "rename").when(F.col("holder") == "disk", "skip").otherwise("quarantine")
        # Conflicts are looked at several times below, the joins are made once.
        acted = cut(rows.where(F.col("depth") == depth).join(names, "dest_file").select("path", "dest_file", "fp", "base", "suffix", *also, action.alias("action")))
        parts.append(acted.where(F.col("action") != "rename").select("path", "dest_file", "action", F.col("dest_file").alias("final"), *also))
        met = None
        if depth < numbered:
            met = firsts.where(F.col("depth") == depth + 1).select("dest_file", "parent", "number", "first").join(disk.where(F.col("depth") == depth + 1).select("dest_file", F.col("parent").alias("p"), F.col("number").alias("n"), "there"), "dest_file", "full")
            met = met.select(F.coalesce("parent", "p").alias("parent"), F.coalesce("number", "n").alias("number"), "first", F.coalesce("there", F.lit(False)).alias("there"))
        made = _renamed(acted.where(F.col("action") == "rename"), met, also)
        parts.append(made.select("path", "dest_file", F.lit("proceed").alias("action"), "final", *also))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
