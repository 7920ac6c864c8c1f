"""Quality rules: an ordered decision list, learned from labelled documents.

Counts of every whole text are made by numpy over Arrow batches. The list is
learned on the driver by sequential covering over a bounded sample of labelled
rows: a rule is grown condition by condition for the most information gained,
pruned on rows that it wasn't grown on, and kept if it is precise enough; what
it covers is taken away and the next rule begins. The list becomes one Spark
conditional expression over the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Ratios that the rules look at besides n_words: numerator over denominator.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "distinct_share": ("n_distinct_words", "n_words"),
}
FEATURES = ("n_words", *RATIOS)


def _within(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def _distinct(code: np.ndarray, below: int, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each document."""
    both, _ = K.combine((doc, n), (code, below))
    return np.bincount(pa.array(both).unique().to_numpy() // max(1, below), minlength=n)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each document; lines and words are the same if their bytes are."""
    n = len(offsets) - 1
    starts, ends, bounds = K.segments(K.NOT_SPACE[data], offsets)
    # All bytes that go on with a character are in words.
    out = {"n_words": np.diff(bounds), "word_chars": K.sum_by(bounds, ends - starts) - _within((data & 0xC0) == 0x80, offsets), "n_symbols": _within(_SYMBOL[data], offsets)}
    line_starts, line_ends, line_bounds = K.segments(data != 10, offsets)
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_doc = K.owner(line_bounds)[wordy]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    lines, known = K.codes(data, line_starts[wordy], line_ends[wordy])
    out["n_dup_lines"] = out["n_lines"] - _distinct(lines, len(known), line_doc, n)
    (words, known), doc = K.codes(data, starts, ends), K.owner(bounds)
    hit = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        own = np.flatnonzero(doc[2:] == doc[:-2])
        threes, below = K.shingles(words, len(known), 3)
        again = own[K.often(K.ranks(K.combine((threes[own], below), (doc[own], n))[0])[0])]
        for k in range(3):
            hit[again + k] = True
    out["n_repeat_words"] = K.sum_by(bounds, hit[: len(words)])
    out["n_upper"] = _within((data >= 65) & (data <= 90), offsets)
    out["n_digits"] = _within((data >= 48) & (data <= 57), offsets)
    out["n_distinct_words"] = _distinct(words, len(known), doc, n)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(0))
        for d, e in K.runs(offsets):
            c = text_counts(data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d])
            rest = batch.slice(d, e - d)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k].astype(np.int64)) for k in COUNTS), *rest.columns], names=[*COUNTS, *rest.schema.names])
        K.tidy()


def _counted_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _counted(batches):
        yield batch.select([n for n in batch.schema.names if n != "own_text"])


def with_counts(docs: DataFrame, text_col: str, keep: list[str], keep_text: bool = False) -> DataFrame:
    """The COUNTS of each document's text, the columns in keep as own_..., and if asked the text as own_text; null texts count as empty."""
    bounded(docs.sparkSession)
    chosen = docs.select(F.col(text_col).alias("own_text"), *(F.col(c).alias(f"own_{c}") for c in keep))
    kinds = [(c, k) for c, k in chosen.dtypes if keep_text or c != "own_text"]
    schema = ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"`{c}` {k}" for c, k in kinds)])
    return chosen.mapInArrow(_counted if keep_text else _counted_alone, schema)


def feature(name: str) -> Column:
    """A feature over the COUNTS; a ratio with nothing below the line is 0."""
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return F.col(name).cast("double")


@dataclass
class Rule:
    """Reject if all conditions (feature, is it an upper bound, threshold) hold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for name, below, at in self.conditions:
            out &= x[name] <= at if below else x[name] >= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, below, at in self.conditions:
            out = out & (feature(name) <= at if below else feature(name) >= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'<=' if below else '>='} {at:.6g}" for name, below, at in self.conditions)


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information that a narrower rule gains over one with p0 and n0, times what it still covers."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    best, found = 0.0, None
    p0, n0 = int(bad.sum()), int((~bad).sum())
    for name in FEATURES:
        v = x[name]
        order = np.argsort(v, kind="stable")
        s, p = v[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(s[1:] > s[:-1])  # between different values
        if not len(cuts):
            continue
        below_p, below_n = p[cuts], cuts + 1 - p[cuts]
        for below, a, b in ((True, below_p, below_n), (False, p0 - below_p, n0 - below_n)):
            g = _gain(a, b, p0, n0)
            k = int(np.argmax(g))
            if g[k] > best + 1e-9:
                best, found = float(g[k]), (name, below, float((s[cuts[k]] + s[cuts[k] + 1]) / 2))
    return best, found


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, min_precision: float = 0.9, min_covered: int = 8, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering of the bad rows. fold: true for rows to grow on, false for rows to prune on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while True:
        grow, prune = left & fold, left & ~fold
        if (bad & grow).sum() < min_covered:
            return rules
        rule, inside = Rule(), grow.copy()
        while len(rule.conditions) < max_conditions and (~bad & inside).any():
            at = np.flatnonzero(inside)
            _, condition = _best_condition({k: v[at] for k, v in x.items()}, bad[at])
            if condition is None:
                break
            rule.conditions.append(condition)
            inside = grow & rule.covers(x, len(bad))
        best, worth = None, -2.0
        for k in range(1, len(rule.conditions) + 1):
            shorter = Rule(rule.conditions[:k])
            c = prune & shorter.covers(x, len(bad))
            p, n = int((bad & c).sum()), int((~bad & c).sum())
            if p + n and (w := (p - n) / (p + n)) > worth:
                best, worth = shorter, w
        if best is None:
            return rules
        c = left & best.covers(x, len(bad))
        p, n = int((bad & c).sum()), int((~bad & c).sum())
        if p < min_covered or p < min_precision * (p + n) or (worth + 1) / 2 < min_precision:
            return rules
        rules.append(best)
        left &= ~c


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> list[Rule]:
    """Rules that reject what labels call 0.

    At most max_rows labelled documents are learned from, those whose ids have
    the smallest hashes. Null labels and ids are left out; if an id has several
    labels, the worst one holds; without labelled rows there are no rules.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    own = own.orderBy(*order).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(own), "_id")  # at most max_rows ids, so that no text is shuffled
    rows = with_counts(rows, "_text", ["_id", "_label"]).select(F.col("own__id").alias("_id"), F.col("own__label").alias("_label"), *(feature(n).alias(n) for n in FEATURES))
    rows = rows.orderBy(*order, *FEATURES).limit(max_rows).toPandas()
    if rows.empty:
        return []
    x = {n: rows[n].to_numpy(float) for n in FEATURES}
    return learn_rules(x, rows["_label"].to_numpy() <= 0, np.arange(len(rows)) % 3 != 2, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, as one conditional expression; null if none does."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the COUNTS, base_failed, the rule that rejects and kept of each document.

    Null and empty texts have no words and fail the base; repeated rows keep a
    row each, and extra columns aren't looked at.
    """
    out = with_counts(docs, text_col, [id_col]).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select(F.col(f"own_{id_col}").alias(id_col), *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that neither fail the base nor fit a rule."""
    out = with_counts(docs, text_col, [c for c in docs.columns if c != text_col], keep_text=True)
    out = out.where(~base_failed() & verdict(rules).isNull())
    return out.select(*(F.col("own_text" if c == text_col else f"own_{c}").alias(c) for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by rules that the labels teach.

    Null and empty texts have no words and fail the base; texts of any length
    are counted whole; repeated rows keep a row each; of several labels of an
    id the worst holds; empty tables give no rules and no rows; columns beside
    doc_id, text and the labels aren't looked at.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
