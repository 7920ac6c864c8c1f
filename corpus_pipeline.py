"""From raw documents to packed sequences, one operator after another.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.llm import decontaminate, neardup, packing, quality, suffixdedup
from spinewright.llm.shared import scratch_path, stage
from spinewright.llm.tokens import public_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or fit a rule learned from the labels go.

    Null and empty texts fail the base; repeated rows stay or go each.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, by five-word shingles and a similarity of 0.8.

    Null texts and texts without words are near nothing and stay; of repeated
    rows one stays; texts of any length count whole.
    """
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 0) -> DataFrame:
    """Passages that occur again are cut out; a document with nothing else goes.

    That is what 400 bytes cover that also start elsewhere and, if words isn't
    0, what so many words in a row cover that another document has too.
    Null and empty texts have nothing to cut and stay; repeated rows and texts
    of any length are cut whole. n_chars follows the text where it was cut.
    """
    n_removed = "n_removed" + "_" * max(map(len, docs.columns))  # a name that no column has
    cut = suffixdedup.remove_repeats(docs, removed_col=n_removed, words=words).where((F.col(n_removed) == 0) | (F.length("text") > 0))
    n_chars = F.when(F.col(n_removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay, repeated rows stay or go each."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, none across documents; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Learned rules, tokenization and components of links aren't for SQL. tests/llm/test_pipeline.py holds run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what else a stage wrote is removed after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        with stage(spark) as keep:
            path = scratch_path(spark, name)
            keep(path)
            found = function(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
