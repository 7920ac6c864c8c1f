"""String functions over Columns; everything stays in the JVM but what is folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..fixed import COMPONENT_LENGTH, COPY_SUFFIX, PATH_CHARACTERS, TRACK_PREFIX
from . import folding

#: White space of Unicode, with the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
#: Visible characters of ASCII that a path may hold, in words between single blanks; no dot in front.
_WORD = "[" + "".join(f"\\x{c:02x}" for c in range(33, 127) if chr(c) not in PATH_CHARACTERS) + "]++"
_SAFE = rf"\A(?!\.){_WORD}(?: {_WORD})*+\z"


def pattern(p: str, flags: str = "U") -> str:
    r"""A pattern whose \s, \d and \b follow Unicode."""
    return f"(?{flags})" + p.replace(r"\s", SPACE)


def let(x: Column, f) -> Column:
    """f of x, with x worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    # Most texts begin and end with a visible character of ASCII, which is cheaper to see than what replaces costs.
    bare = F.left(x, F.lit(1)).between("!", "~") & F.right(x, F.lit(1)).between("!", "~")
    return F.when(bare, x).otherwise(F.regexp_replace(x, f"(?U)^{SPACE}+|{SPACE}+$", ""))


def holds_text(x: Column) -> Column:
    """Whether there is more than white space."""
    return x.rlike(r"(?U)[^\s\x1c-\x1f]")


def collapse(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, f"(?U){SPACE}+", " "))


def or_empty(*xs: Column) -> Column:
    """The first that isn't null or empty, else the empty string."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def all_digits(x: Column) -> Column:
    return x.rlike(r"(?U)^\d+\z")


def leading_digits(x: Column) -> Column:
    """The digits that a text begins with, after white space, as a string with its zeros."""
    return F.coalesce(F.regexp_extract(x, pattern(r"^\s*(\d+)"), 1), F.lit(""))


def number(digits: Column) -> Column:
    """A string of digits without the zeros in front."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def two_digits(digits: Column) -> Column:
    """A string of digits as a number of two digits at least; it grows past them."""
    return let(number(digits), lambda n: F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def sanitise(x: Column) -> Column:
    """A text made safe as one component of a path."""
    kept = {k: v for k, v in PATH_CHARACTERS.items() if v}
    gone = "".join(k for k, v in PATH_CHARACTERS.items() if not v)
    s = collapse(F.translate(x, "".join(kept) + gone, "".join(kept.values())))
    # Words of ASCII between single blanks are most texts, and stay as they are.
    safe = x.rlike(_SAFE) & (F.length(x) <= COMPONENT_LENGTH)
    return F.when(safe, x).otherwise(F.substring(F.regexp_replace(s, r"^\.", ""), 1, COMPONENT_LENGTH))


def strip_track_prefix(x: Column) -> Column:
    return F.regexp_replace(x, pattern(TRACK_PREFIX), "")


def extension(name: Column, dot: bool = False) -> Column:
    """The last suffix of a file name in lower case; dots in front of a name begin none."""
    e = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    return e if dot else F.lower(F.ltrim(e, F.lit(".")))


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(name, dot=True)))


def has_copy_suffix(name: Column) -> Column:
    """Whether a number stands before the extension, as in ``book.2.m4b``."""
    return name.rlike("(?U)" + COPY_SUFFIX)


def strip_accents(x: Column) -> Column:
    return F.pandas_udf(folding.strip_series, StringType())(x)


def normalise_author(name: Column) -> Column:
    """The grouping key of an author, see folding.author_key; folding is the one step that Spark has no function for."""
    return F.coalesce(F.pandas_udf(folding.author_keys, StringType())(name), F.lit(""))


def normalise_book(name: Column) -> Column:
    """The grouping key of a title, see folding.book_key."""
    return F.coalesce(F.pandas_udf(folding.book_keys, StringType())(name), F.lit(""))


def normalise_authors(names: Column) -> Column:
    """The grouping key of each text of an array."""
    return F.pandas_udf(folding.author_key_arrays, ArrayType(StringType()))(names)


def format_duration(seconds: Column) -> Column:
    def text(t: Column) -> Column:
        h, m, s = (t - t % 3600) / 3600, (t % 3600 - t % 60) / 60, t % 60
        h, m = h.cast("bigint"), m.cast("bigint")
        return F.when(t >= 3600, F.format_string("%dh%02dm%02ds", h, m, s)).when(t >= 60, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))

    return F.when(seconds > 0, let(F.floor(seconds).cast("bigint"), text)).otherwise("0s")


def _kilo(x: Column) -> Column:
    """x // 1000 as text."""
    return F.floor(x / 1000).cast("string")


def format_quality(codec: Column, bitrate: Column, sample_rate: Column, channels: Column, duration: Column) -> Column:
    khz = F.regexp_replace(F.round(sample_rate / 1000, 3).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
    parts = F.concat_ws(
        " ", F.when(codec != "", F.upper(codec)), F.when(bitrate != 0, F.concat(_kilo(bitrate), F.lit("kbps"))), F.when(sample_rate != 0, F.concat(khz, F.lit("kHz"))), F.when(channels >= 2, "stereo").when(channels != 0, "mono")
    )
    return F.concat_ws(", ", F.nullif(parts, F.lit("")), format_duration(duration))


def edition_summary(fmt: Column, year: Column, avg_bitrate: Column, duration: Column, file_count: Column) -> Column:
    files = F.concat(file_count.cast("string"), F.when(file_count == 1, " file").otherwise(" files"))
    return F.concat_ws(", ", F.when(fmt != "", F.upper(fmt)).otherwise("?"), F.nullif(year, F.lit("")), F.when(avg_bitrate != 0, F.concat(_kilo(avg_bitrate), F.lit("kbps"))), format_duration(duration), files)
