"""New files of a library as a stream of destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import build_destination, resolve


def destinations(files: DataFrame, root: str) -> DataFrame:
    """files (path, folder, name, tags), at rest or as a stream, with their fields and destinations; no state is kept."""
    known = files.withColumns(resolve(F.col("tags")))
    fields = {c: F.col(c) for c in resolve(F.col("tags"))}
    return known.withColumns(build_destination(fields, F.col("folder"), F.col("name"), F.lit(root)))
