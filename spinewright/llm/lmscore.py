"""LM scoring by cross-entropy difference.

Two n-gram models of bytes are counted over all documents: one of the target
documents, one of the whole corpus as the background. They are matched: one
vocabulary (the bytes), one order, one smoothing, and the background's counts
are scaled to the target's size, so that neither is smoothed more. A document's
score is the mean over its tokens of the target's loss less the background's;
the lower, the more it is like the target.

Counting and scoring go by blocks of documents whose texts are kept in the
shared folder. A block sends its distinct n-grams, dealt by context into as
many buckets as there are shuffle partitions. The rows of a bucket are read one
after another: first its grams are added up over the corpus and get their loss
differences, then these go to the blocks that asked. A task holds the distinct
grams of one bucket and a few rows; the models are never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, scratch_path, written
from .textstore import StoreReader, StoreWriter
from .tokens import squeeze, unsqueeze

ORDER = 5
#: Weight of the lower order, in tokens of the target.
STRENGTH = 5.0
#: Bytes of text in a block, and for each bucket of contexts, of which a task holds the distinct grams.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_BLOCK = "block bigint, place string, ids array<bigint>, sizes array<bigint>"
_COUNTED = "block bigint, bucket int, grams binary, background binary, target binary, singles array<bigint>"


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The last order bytes up to each place as one number; zeros stand before a document's first byte."""
    n = len(data)
    key = data.astype(np.uint64)
    into = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        back = np.zeros(n, np.uint64)
        back[k:] = data[: n - k]
        back[into < k] = 0
        key |= back << np.uint64(8 * k)
    return key


class BlockWriter:
    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store = TaskContext.get(), None
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            store = store or StoreWriter(self.folder)
            data, offsets = K.column_bytes(batch.column(1))
            data = np.ascontiguousarray(data)
            for d, e in K.runs(offsets, BLOCK_BYTES):
                place = store.add(memoryview(data[offsets[d] : offsets[e]]))
                yield pa.RecordBatch.from_pylist([{"block": number, "place": place, "ids": batch.column(0).slice(d, e - d).to_pylist(), "sizes": np.diff(offsets[d : e + 1]).tolist()}], schema=pa.schema([("block", pa.int64()), ("place", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))
                number += 1
        if store:
            store.close()
        K.tidy()


def _split(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as packed steps."""
    step = np.diff(x, prepend=np.uint64(0))
    return squeeze(np.stack([step & np.uint64(0xFFFFFFFF), step >> np.uint64(32)]).ravel())


def _join(b: bytes) -> np.ndarray:
    low, high = unsqueeze(b).astype(np.uint64).reshape(2, -1)
    return np.cumsum(low | (high << np.uint64(32)), dtype=np.uint64)


def _counts(key: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, which, n = np.unique(key, return_inverse=True, return_counts=True)
    return u, n, np.bincount(which[inside], minlength=len(u))


class Counter:
    """Counts the grams of the blocks in (block, place, sizes, hits) rows; hits: the numbers of the target documents."""

    def __init__(self, order: int, buckets: int, folder: str):
        self.order, self.buckets, self.folder = order, buckets, folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = StoreReader(self.folder)
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("background", pa.binary()), ("target", pa.binary()), ("singles", pa.list_(pa.int64()))])
        for batch in batches:
            for r in batch.to_pylist():
                data, offsets = np.frombuffer(store.get(r["place"]), np.uint8), np.append(0, np.cumsum(r["sizes"], dtype=np.int64))
                target = np.zeros(len(r["sizes"]), bool)
                target[r["hits"] or []] = True
                parts = []
                for d, e in K.runs(offsets):
                    off = offsets[d : e + 1] - offsets[d]
                    parts.append(_counts(byte_grams(data[offsets[d] : offsets[e]], off, self.order), np.repeat(target[d:e], np.diff(off))))
                u, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                both = [np.bincount(which, weights=np.concatenate([p[k] for p in parts]), minlength=len(u)).astype(np.int64) for k in (1, 2)]
                singles = np.concatenate([np.bincount((u & np.uint64(255)).astype(np.int64), weights=x, minlength=256) for x in both])
                bucket = (((K.mix(u >> np.uint64(8)) >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
                rows = [{"block": r["block"], "bucket": -1, "singles": singles.astype(np.int64).tolist()}]
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    own = order[edge[b] : edge[b + 1]]
                    rows.append({"block": r["block"], "bucket": b, "grams": _split(u[own]), "background": squeeze(both[0][own]), "target": squeeze(both[1][own])})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        store.close()
        K.tidy()


def gram_losses(gram: np.ndarray, background: np.ndarray, target: np.ndarray, singles: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """The target's loss less the background's of each distinct gram; all grams of a context must be there.

    singles: the counts of each byte in the background and in the target, as two rows.
    """
    total = singles.sum(axis=1)
    scale = total[1] / total[0] if total[0] else 0.0
    single = (singles + 1.0) / (total[:, None] + 256.0)
    last, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
    _, which = np.unique(context, return_inverse=True)
    logs = []
    for n, p, s in ((target, single[1], 1.0), (background, single[0], scale)):
        n = n * s
        logs.append(np.log((n + strength * p[last]) / (np.bincount(which, weights=n)[which] + strength)))
    return (logs[1] - logs[0]).astype(np.float32)


#: Grams that wait for being added up, and grams in a row of what is solved.
WAITING, SOLVED_ROW = 1 << 20, 1 << 20


class Sums:
    """(bucket, grams, losses) of (bucket, grams, background, target) rows sorted by bucket: all distinct grams of each, in order."""

    def __init__(self, singles: np.ndarray, strength: float):
        self.singles, self.strength = singles, strength

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, n = None, [], 0

        def added(parts: list) -> list:
            u, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [u, *(np.bincount(which, weights=np.concatenate([p[k] for p in parts]), minlength=len(u)) for k in (1, 2))]

        def solved() -> Iterator[pa.RecordBatch]:
            u, background, target = added(waiting)
            losses = gram_losses(u, background, target, self.singles, self.strength)
            for a in range(0, len(u), SOLVED_ROW):
                part = slice(a, a + SOLVED_ROW)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_split(u[part])], pa.binary()), pa.array([losses[part].tobytes()], pa.binary())], names=["bucket", "grams", "losses"])

        for batch in batches:
            for bucket, *packed in zip(*(batch.column(k) for k in range(4))):
                if bucket.as_py() != now:
                    if waiting:
                        yield from solved()
                    now, waiting, n = bucket.as_py(), [], 0
                waiting.append([_join(packed[0].as_buffer()), *(unsqueeze(p.as_buffer()).astype(np.float64) for p in packed[1:])])
                n += len(waiting[-1][0])
                if n > WAITING + 2 * len(waiting[0][0]):
                    waiting, n = [added(waiting)], 0
        if waiting:
            yield from solved()
        K.tidy()


class Answers:
    """(home, packed, losses) for the (bucket, block, grams, losses) rows with a block; those without one, first in each bucket, say what its grams lose."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, losses = None, [], []
        for batch in batches:
            for bucket, block, packed, loss in zip(*(batch.column(k) for k in range(4))):
                if bucket.as_py() != now:
                    now, known, losses = bucket.as_py(), [], []
                grams = _join(packed.as_buffer())
                if not block.is_valid:
                    known.append(grams)
                    losses.append(np.frombuffer(loss.as_buffer(), np.float32))
                    continue
                if len(known) > 1:
                    known, losses = np.concatenate(known), np.concatenate(losses)
                    order = np.argsort(known)
                    known, losses = [known[order]], [losses[order]]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([packed.as_py()], pa.binary()), pa.array([losses[0][np.searchsorted(known[0], grams)].tobytes()], pa.binary())], names=["home", "packed", "losses"])
        K.tidy()


def _scorer(order: int, folder: str):
    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        store = StoreReader(folder)
        row = {k: block.column(k)[0] for k in block.column_names}
        data = np.frombuffer(store.get(row["place"].as_py()), np.uint8)
        store.close()
        offsets = np.append(0, np.cumsum(row["sizes"].values.to_numpy()))
        grams = np.concatenate([np.zeros(0, np.uint64), *(_join(b) for b in found.column("packed").to_pylist())])
        losses = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(b, np.float32) for b in found.column("losses").to_pylist())])
        by = np.argsort(grams)
        grams, losses = grams[by], losses[by].astype(np.float64)
        sums = [np.zeros(0)]
        for d, e in K.runs(offsets):
            off = offsets[d : e + 1] - offsets[d]
            key = byte_grams(data[offsets[d] : offsets[e]], off, order)
            u, which = np.unique(key, return_inverse=True)
            c = np.append(0.0, np.cumsum(losses[np.searchsorted(grams, u)][which] if len(u) else []))
            sums.append(np.diff(c[off]))
        n = np.diff(offsets)
        total = np.concatenate(sums)
        return pa.table({"id": row["ids"].values, "n_tokens": pa.array(n, pa.int64()), "score": pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), pa.float64())})

    return score


def score_documents(docs: DataFrame, target_ids: DataFrame, order: int = ORDER, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of each row of docs; target_ids: the ids, in a column of that name, of the target documents.

    Tokens are the bytes of the text in UTF-8. Null and empty texts have no
    tokens and score 0; with no target, or an empty one, the target model is
    even over the vocabulary. Repeated rows are counted and scored each,
    repeated and null target ids count once and never, extra columns aren't
    looked at.
    """
    spark = docs.sparkSession
    bounded(spark)
    folder, parts = scratch_path(spark, "texts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(BlockWriter(folder), _BLOCK), "lm-blocks")
    # As many buckets as it takes for the distinct grams of one to fit in a task.
    buckets = max(parts, (blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0) // BUCKET_BYTES)
    wanted = target_ids.select(F.col(id_col).cast("bigint").alias("wanted")).where(F.col("wanted").isNotNull()).distinct()
    hits = blocks.select(F.col("block").alias("home"), F.posexplode("ids").alias("k", "id")).join(wanted, F.col("id") == F.col("wanted"))
    hits = hits.groupBy("home").agg(F.collect_list("k").alias("hits"))
    tasks = max(parts, spark.sparkContext.defaultParallelism)
    rows = blocks.join(hits, F.col("block") == F.col("home"), "left").select("block", "place", "sizes", "hits").repartition(tasks)  # few and short rows with much work each: not to be coalesced
    counted = written(rows.mapInArrow(Counter(order, buckets, folder), _COUNTED), "lm-counts")
    singles = np.zeros(512)
    for r in counted.where(F.col("bucket") < 0).select(F.posexplode("singles").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        singles[r.k] = r.n
    grams = counted.where(F.col("bucket") >= 0)
    solved = grams.select("bucket", "grams", "background", "target").repartition(parts, "bucket").sortWithinPartitions("bucket")
    solved = written(solved.mapInArrow(Sums(singles.reshape(2, 256), strength), "bucket int, grams binary, losses binary"), "lm-losses")
    both = solved.select("bucket", F.lit(None).cast("bigint").alias("block"), "grams", "losses").union(grams.select("bucket", "block", "grams", F.lit(None).cast("binary")))
    solved = both.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first()).mapInArrow(Answers(), "home bigint, packed binary, losses binary")
    out = blocks.groupBy("block").cogroup(solved.groupBy("home")).applyInArrow(_scorer(order, folder), "id bigint, n_tokens bigint, score double")
    return out.withColumnRenamed("id", id_col)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; target: labelled documents of good quality that aren't toxic.

    Null and empty texts score 0; texts of any length are counted and scored
    whole; repeated rows count each; empty tables give no rows, or an even
    target; columns beside doc_id, text and the labels aren't looked at. The
    score compares a document with a target: documents that occur twice get
    the same score, and nothing marks them as such.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    target = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)
