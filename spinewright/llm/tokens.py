"""Token counts: pieces counted once per distinct pre-token.

A piece model whose pieces hold the word-start mark only at their front can
never merge across a boundary between a non-blank and a blank. Between two such
boundaries lies a pre-token, and the pieces of a text are those of its
pre-tokens one after another. So the corpus is counted in three steps, and no
list of ids is made:

1. each block of documents yields its distinct pre-tokens, dealt by their hash
   into as many buckets as there are shuffle partitions, and a packed table of
   how often each of its documents holds each of them;
2. the rows of a bucket are read one after another, each distinct pre-token of
   the whole corpus is counted once (once more only if a bucket holds more than
   KEEP_PRETOKENS), and the counts go back to the blocks that asked;
3. they are joined to the blocks' tables and summed per document.

Keys and counts travel packed, a row for each block and bucket, so that what is
shuffled is a fraction of the text. Pre-tokens are the same if their bytes are;
a digest only says which bucket they go to.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, written

#: Bytes of text in a block at most, unless one document alone is longer.
BLOCK_BYTES = 16 << 20
#: Pre-tokens of a bucket whose counts are kept, and bytes of them looked up at once.
KEEP_PRETOKENS, AT_ONCE = 1_000_000, 16 << 20
BLANK = "▁"
_BLOCK = "block bigint, keys array<struct<bucket:int,packed:binary>>, ids array<bigint>, bytes array<bigint>, docs binary, places binary, times binary"
_models: dict = {}


def public_tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(data: np.ndarray, offsets: np.ndarray, from_start: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and bounds of the pre-tokens, as textkernel.segments gives segments.

    A pre-token is a run of blanks with the run of other bytes after it. The
    blank that it begins with is left out, since the library puts one in front
    of whatever it is given; a text's first pre-token lacks it already.
    from_start: whether the first text is there from its beginning.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    blank = data == 0x20
    head = np.zeros(n, bool)
    head[1:] = blank[1:] & ~blank[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    head[first] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], n)
    bounds = np.searchsorted(starts, offsets)
    inner = blank[starts]
    inner[np.searchsorted(starts, first if from_start else first[1:])] = False
    return starts + inner, ends, bounds


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack(keys: pa.Array) -> bytes:
    import zstandard

    lengths = pc.binary_length(keys).to_numpy().astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.uint32(len(lengths)).tobytes(), lengths.tobytes(), *K.strings(keys)]))


def _unpack(b: bytes) -> pa.Array:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    off = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", n, 4), out=off[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(raw[4 + 4 * n :])])


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first and last byte, first and last document) of runs; a long document comes in several, cut where a pre-token begins."""
    for d, e in K.runs(offsets):
        a, b = int(offsets[d]), int(offsets[e])
        while b - a > 2 * K.RUN_BYTES:
            near = data[a + K.RUN_BYTES : a + 2 * K.RUN_BYTES]
            heads = np.flatnonzero((near[1:] == 0x20) & (near[:-1] != 0x20))
            if not len(heads):
                break
            at = a + K.RUN_BYTES + int(heads[0]) + 1
            yield a, at, d, e
            a = at
        yield a, b, d, e


def _block(data: np.ndarray, offsets: np.ndarray, buckets: int) -> dict:
    """The distinct pre-tokens of some documents by bucket, and who holds which how often."""
    found, docs, words = [], [], []
    for a, b, d, e in _parts(data, offsets):
        off = np.clip(offsets[d : e + 1], a, b) - a
        starts, ends, bounds = pretokens(data[a:b], off, a == offsets[d])
        code, distinct = K.codes(data[a:b], starts, ends)
        found.append(code)
        docs.append(K.owner(bounds) + d)
        words.append(distinct)
    # What is the same in several runs gets one code, and what only gaps hold none.
    coded = pa.concat_arrays([*words, pa.array([], pa.large_binary())]).dictionary_encode()
    turn, first = coded.indices.to_numpy(), np.cumsum([0, *map(len, words)])
    code = np.concatenate([*(turn[x + k] for x, k in zip(found, first)), np.zeros(0, np.int64)]).astype(np.int64)
    held = np.unique(code)
    keys = coded.dictionary.take(pa.array(held))
    # The buckets are ranges of the digest, so that the order by digest is one by bucket.
    digest = K.digests(keys) if len(keys) else np.zeros(0, np.uint64)
    order = np.argsort(digest, kind="stable")
    keys, digest = keys.take(pa.array(order)), digest[order]
    seat = np.zeros(len(coded.dictionary), np.int64)
    seat[held[order]] = np.arange(len(held))
    pair, times = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.uint64) << np.uint64(32) | seat[code].astype(np.uint64), return_counts=True)
    doc, places = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bucket = ((digest >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
    held_by = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.append(0, np.cumsum(held_by))[:-1][held_by > 0]
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]  # of each document, the first place and then the steps between places
    return {
        "keys": [{"bucket": b, "packed": _pack(keys.slice(edge[b], edge[b + 1] - edge[b]))} for b in np.flatnonzero(np.diff(edge)).tolist()],
        "docs": squeeze(held_by), "places": squeeze(steps), "times": squeeze(times),
    }


class Blocks:
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))
        schema = pa.schema([("block", pa.int64()), ("keys", keys), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("docs", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, off = K.column_bytes(text)
            sizes = np.diff(off)
            for d, e in K.runs(off, BLOCK_BYTES):
                part = text.slice(d, e - d)
                data, offsets = K.column_bytes(part)
                if b"\xe2\x96\x81" in data.tobytes():  # the mark itself counts as a blank
                    data, offsets = K.column_bytes(pc.replace_substring(part, BLANK, " "))
                data = np.ascontiguousarray(data)
                row = {"block": number, "ids": ids.slice(d, e - d).to_pylist(), "bytes": sizes[d:e].tolist()} | _block(data, offsets, self.buckets)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
            K.tidy()


class PieceCounter:
    """Counts the pieces of pre-tokens in (block, bucket, packed) rows sorted by bucket, each distinct one once."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get(self.path)
        if model is None:
            import sentencepiece

            model = _models[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
        known: dict[bytes, int] = {}
        now = None
        for batch in batches:
            held, size = [], 0
            for k, (bucket, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                if bucket != now and not held:
                    known, now = {}, bucket
                held.append(_unpack(packed.as_buffer()))
                size += held[-1].nbytes
                last = k + 1 == batch.num_rows
                if size > AT_ONCE or last or batch.column(1)[k + 1].as_py() != bucket:
                    first = k + 1 - len(held)
                    pieces = self.count(model, held, known)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), batch.column(1).slice(first, len(held)), pa.array(pieces, pa.binary())], names=["home", "bucket", "pieces"])
                    held, size = [], 0
        K.tidy()

    @staticmethod
    def count(model, held: list[pa.Array], known: dict[bytes, int]) -> list[bytes]:
        coded = pa.concat_arrays(held).dictionary_encode()
        words = K.strings(coded.dictionary)
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEEP_PRETOKENS:
            known.clear()
            new = words
        # The library gives no piece for an empty string, but a blank alone is one.
        known.update((w, len(model.encode(w.decode())) if w else 1) for w in new)
        pieces = np.fromiter((known[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        ends = np.cumsum([len(x) for x in held])
        return [squeeze(pieces[b - len(x) : b]) for x, b in zip(held, ends.tolist())]


def separable(path: str) -> bool:
    """Whether no piece holds the mark behind another character, which pre-tokens rely on; and the mark alone is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size()))
    return not any(BLANK in p for p in pieces) and model.piece_to_id(BLANK) != model.unk_id() and model.encode("a b", out_type=str)[0].startswith(BLANK)


def _summed(_key, block: pa.Table, counts: pa.Table) -> pa.Table:
    row = {k: block.column(k)[0] for k in block.column_names}
    pieces = [unsqueeze(b) for _, b in sorted(zip(counts.column("bucket").to_pylist(), counts.column("pieces").to_pylist()))]
    docs, steps, times = (unsqueeze(row[k].as_py()) for k in ("docs", "places", "times"))
    bounds = np.append(0, np.cumsum(docs))
    n = np.zeros(len(docs), np.int64)
    if len(steps):
        # Places of a document: the running sum of its steps.
        c = np.cumsum(steps)
        first = bounds[:-1][docs > 0]
        places = c - np.repeat(c[first] - steps[first], docs[docs > 0])
        n = K.sum_by(bounds, np.concatenate(pieces)[places] * times)
    return pa.table({"id": row["ids"].values, "n_bytes": row["bytes"].values, "n_tokens": pa.array(n, pa.int64())})


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of docs.

    Null and empty texts have no bytes and no tokens; repeated and null ids
    keep a row each; columns beside the two are not looked at.
    """
    if not separable(model_path):
        raise ValueError(f"{os.path.basename(model_path)}: its pieces cross pre-tokens")
    spark = docs.sparkSession
    bounded(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(Blocks(buckets), _BLOCK), "token-blocks")
    keys = blocks.select("block", F.explode("keys").alias("k")).select("block", "k.bucket", "k.packed")
    counts = keys.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(PieceCounter(model_path), "home bigint, bucket int, pieces binary")
    rows = blocks.drop("keys").groupBy("block").cogroup(counts.groupBy("home"))
    return rows.applyInArrow(_summed, "id bigint, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document.

    Null and empty texts have none; texts of any length are counted whole;
    repeated rows keep a row each; an empty table gives no row; columns beside
    doc_id and text aren't looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizer("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
