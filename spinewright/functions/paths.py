"""From tags, paths and names to where a file belongs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import TAG_CHAINS, UNKNOWN_AUTHOR, UNKNOWN_BOOK
from .text import all_digits, extension, holds_text, leading_digits, let, number, or_empty, sanitise, stem, strip, strip_track_prefix, two_digits

FIELDS = tuple(TAG_CHAINS)


def first_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    """The first tag of the chain that holds more than white space; keys of the map are in lower case."""
    held = F.filter(F.array(*(tags[k] for k in keys)), holds_text)
    return F.coalesce(strip(F.get(held, F.lit(0))), F.lit(""))


def lower_keys(tags: Column) -> Column:
    """The map with keys in lower case; of keys that become equal, the last holds."""
    lowered = F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        kept = let(keys, lambda ks: F.filter(entries, lambda e, i: ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), e["key"])))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(kept)

    return F.map_from_entries(let(lowered, last))


def resolve(tags: Column) -> dict[str, Column]:
    """The fields of a file from its tags; what isn't there is the empty string."""
    out = {name: first_tag(tags, keys) for name, keys in TAG_CHAINS.items()}
    out |= {name: leading_digits(out[name]) for name in ("track", "disc", "series_index")}
    out["year"] = F.substring(out["year"], 1, 4)
    out["series"] = F.when(out["series"] == out["book"], "").otherwise(out["series"])
    return out


def _partition(x: Column) -> tuple[Column, Column, Column]:
    """Where the first `` - `` stands, and what is before and behind it."""
    at = F.instr(x, " - ")
    return at, F.substr(x, F.lit(1), at - 1), F.substr(x, at + 3)


def infer_from_path(folder: Column) -> tuple[Column, Column]:
    """(author, book) from a folder relative to the source: two levels, or one with `` - ``, or one that is the book."""
    parts = F.split(folder, "/")
    at, left, right = _partition(folder)
    two, one = F.size(parts) >= 2, F.coalesce(folder, F.lit("")) != ""
    author = F.when(two, F.get(parts, F.lit(0))).when(one & (at > 0), left).otherwise("")
    book = F.when(two, F.get(parts, F.lit(1))).when(one & (at > 0), right).when(one, folder).otherwise("")
    return author, book


def infer_from_filename(name: Column) -> tuple[Column, Column]:
    """(author, book) from a file name with `` - ``; digits in front are a number, not an author."""
    def parts(bare: Column) -> Column:
        at, left, right = _partition(bare)
        return F.when(at > 0, F.struct(strip(left).alias("left"), strip(right).alias("right"))).otherwise(F.struct(F.lit("").alias("left"), F.lit("").alias("right")))

    found = let(stem(name), parts)
    return let(found["left"], lambda left: F.when(all_digits(left), "").otherwise(left)), found["right"]


def build_destination(meta: dict[str, Column], folder: Column, name: Column, root: Column) -> dict[str, Column]:
    """dest_dir, dest_file and no_meta (whether author or book came from elsewhere than the tags)."""
    by_path, by_name = infer_from_path(folder), infer_from_filename(name)
    author = sanitise(or_empty(meta["author"], by_path[0], by_name[0], F.lit(UNKNOWN_AUTHOR)))
    book = sanitise(or_empty(meta["book"], by_path[1], by_name[1], F.lit(UNKNOWN_BOOK)))
    series, index = F.nullif(sanitise(meta["series"]), F.lit("")), leading_digits(meta["series_index"])
    last = F.when((meta["series"] != "") & (index != ""), F.concat(two_digits(index), F.lit(" - "), book)).otherwise(book)
    dest_dir = F.concat_ws("/", root, F.nullif(author, F.lit("")), series, F.nullif(last, F.lit("")))
    ext, disc, track = extension(name), leading_digits(meta["disc"]), leading_digits(meta["track"])
    later = ~number(disc).isin("", "0", "1")
    prefix = F.when(later, F.concat(F.lit("D"), two_digits(disc), F.lit("-T"), two_digits(or_empty(track, F.lit("0"))))).when(track != "", two_digits(track))
    title = F.when(meta["title"] != "", sanitise(meta["title"])).otherwise(sanitise(strip_track_prefix(stem(name))))
    file = F.when(ext == "m4b", F.concat(book, F.lit(".m4b"))).otherwise(F.concat(F.concat_ws(" - ", prefix, title), F.lit("."), ext))
    return {"dest_dir": dest_dir, "dest_file": F.concat_ws("/", dest_dir, file), "no_meta": (meta["author"] == "") | (meta["book"] == "")}
