"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spinewright-"))
    return sc.getCheckpointDir().rstrip("/")


#: Bytes of an Arrow batch that goes to a worker and rows of a batch from Parquet, unless the session has limits of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512
_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": (None, str(BATCH_BYTES)), "spark.sql.parquet.columnarReaderBatchSize": ("4096", str(BATCH_ROWS))}


def bounded(spark: SparkSession) -> None:
    """Let batches of texts be small, for the session.

    Spark's own limits, 64 MB and 4,096 rows, count several times in an
    executor: in the JVM, whose heap large arrays drive up, and in each worker.
    """
    for name, (default, own) in _LIMITS.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, own)


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/spinewright/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder, by Hadoop's file system or, if the session has ended, by pyarrow's."""
    if path not in _made:
        return
    _made.remove(path)
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        try:
            store, root = fs.FileSystem.from_uri(path)
            if store.get_file_info(root).type != fs.FileType.NotFound:
                store.delete_dir(root)
        except (OSError, pa.ArrowInvalid, ValueError):  # a store that only Spark knows
            return


@contextlib.contextmanager
def stage(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """What is made inside is removed at the end, but for the paths that the given function is told to keep."""
    before, kept = set(_made), set()
    yield kept.add
    for path in [p for p in _made if p not in before and p not in kept]:
        remove(spark, path)


def written(df: DataFrame, name: str, short: bool = False) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    short: the rows are short and need no work but a sum or a join, so that an
    eighth of the tasks writes them, in fewer and larger files.

    This cuts the lineage: what follows sees one and the same result, even if
    an executor is lost and df would not give its rows in the same way again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)) if short else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
