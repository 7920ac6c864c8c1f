"""Running totals over keys of any size, and cutting a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

_cut: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local session without one, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spinewright-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The same rows from a table in the shared folder, which is gone when the application ends, or when kept, to which its path is added, is released."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spinewright-plans/{uuid.uuid4().hex}"
    _cut[path] = spark
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remembered(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder when the application ends."""
    _cut[path] = spark


def release(paths: list[str]) -> None:
    """Delete tables that cut wrote."""
    for path in paths:
        spark = _cut.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


@atexit.register
def _release_all() -> None:
    try:
        release(list(_cut))
    except Exception:  # the session has gone; the folder is the cluster's to clear
        return


def counted(df: DataFrame, counts: dict, kept: list[str] | None = None) -> tuple[DataFrame, dict]:
    """cut(df) and the values of the aggregates in counts, by name, which are taken while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(k) for k, c in counts.items())), kept)
    return out, seen.get


class Running:
    """Adds each row's running total within its partition, and the partition, to rows sorted by their first column; the second is added up."""

    def __init__(self, largest: bool):
        self.accumulate = np.maximum.accumulate if largest else np.cumsum
        self.join = np.maximum if largest else np.add

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, last, total = context.partitionId() if context else 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, value = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            heads = np.append(0, 1 + np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)))
            out = np.empty(n, np.int64)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), n]):
                out[a:b] = self.accumulate(value[a:b])
            if key[0].as_py() == last:
                end = int(heads[1]) if len(heads) > 1 else n
                out[:end] = self.join(out[:end], total)
            last, total = key[n - 1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, "running", "part"])


def running(df: DataFrame, key: str, order: list[str], value: str, largest: bool = False) -> DataFrame:
    """df with a column running: the sum (or the largest) of value, which isn't negative, over the rows of the same key up to this one in the order given.

    Rows are dealt by ranges of key and order, so that a key of any size is
    spread over many tasks. Each adds up its own range; where a range goes on
    with the key of the one before, the totals of the ranges before are added.
    Of these the driver sees one row for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [key, value, *(c for c in df.columns if c not in (key, value))]
    dealt = df.select(*columns).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    schema = StructType([*dealt.schema.fields]).add("running", LongType()).add("part", IntegerType())
    local = cut(dealt.mapInArrow(Running(largest), schema))
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, "running")).alias("end")).collect()
    before, held, rows = None, 0, []
    for r in sorted(ends, key=lambda r: r["part"]):
        last, total = r["end"][0], r["end"][1]
        if r["first"] == before:
            rows.append((r["part"], before, held))
            if last == before:
                total = max(total, held) if largest else total + held
        before, held = last, total
    if not rows:
        return local.drop("part")
    carried = spark.createDataFrame(rows, "part int, carried_key string, carried bigint")
    more = F.when(F.col(key) == F.col("carried_key"), F.col("carried")).otherwise(0)
    total = F.greatest("running", more) if largest else F.col("running") + more
    return local.join(F.broadcast(carried), "part", "left").withColumn("running", F.coalesce(total, "running")).select(*df.columns, "running")
