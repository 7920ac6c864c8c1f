"""Packing: every document is cut into pieces of power-of-two length.

A document of n tokens becomes n // size pieces of the full size and one piece
for each set bit of the rest, longest first. Pieces of one length form a
bucket, each piece is a sequence of its own, and so no sequence crosses
documents and none needs padding.

The ids are those of a byte-level BPE. A worker finds the pre-tokens of a run
of documents with numpy, has each distinct one encoded once, and puts the ids
together by an index, so that encoding is paid for per distinct pre-token.
Pre-tokens are the same if their bytes are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded
from .tokens import public_tokenizer

SIZE = 1024
#: Distinct pre-tokens whose ids a worker keeps from run to run.
KEEP_PRETOKENS = 100_000
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    r"""The class of each code point: \p{L}, \p{N}, \s, or none of these."""
    global _classes
    if _classes is None:
        import regex

        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        text = "".join(map(chr, points))
        at = np.array(points)
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[at[m.start() : m.end()]] = kind
        _classes = table
    return _classes


#: What may follow an apostrophe as a contraction: fixed values of the pattern, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    r"""Where the pre-tokens of byte-level BPE begin, by code point.

    The same as matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|
    ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` in each document; first: where the
    documents that aren't empty begin.
    """
    n = len(points)
    kind = char_classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, kind[1:] != kind[:-1]
    start = edge | begins[:-1]
    space = kind == _SPACE
    # A blank that a word follows at once belongs to the word; any other white space there stands alone.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # Contractions: an apostrophe that begins a pre-token and is followed by one of the endings.
    mark = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == _LETTER) & ~begins[1:n]) if n > 1 else last
    if len(mark):
        limit = np.searchsorted(np.append(first, n), mark, "right")
        limit = np.append(first, n)[limit]
        open_ = np.ones(len(mark), bool)
        for ending in CONTRACTIONS:
            fits = open_ & (mark + len(ending) < limit)
            for k, c in enumerate(ending):
                fits[fits] = points[mark[fits] + 1 + k] == ord(c)
            open_ &= ~fits
            hit = mark[fits]
            start[hit + 1] = False
            after = hit + 1 + len(ending)
            after = after[after < n]
            start[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """ids of texts under a byte-level BPE; made once in each worker.

    json_path is the tokenizer's file, whose vocabulary and special strings
    hold; a text with a special string inside is given to the library whole.
    """

    def __init__(self, json_path: str):
        self.path, self.ready = json_path, False

    def __getstate__(self):
        return {"path": self.path, "ready": False}

    def _load(self) -> None:
        import tiktoken

        spec = json.load(open(self.path, encoding="utf-8"))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.library = None  # read when a special string turns up
        # The printable stand-ins for bytes, by the rule of byte-level BPE.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        names = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in names}
        self.bpe = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocab, special_tokens={})
        self._forget()
        self.ready = True

    def _forget(self) -> None:
        self.known, self.at, self.size, self.flat, self.used = {}, np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _seats(self, words: list[bytes]) -> np.ndarray:
        """The place of each of these distinct pre-tokens in at and size; unknown ones are encoded."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEEP_PRETOKENS and self.known:
            self._forget()
            new = words
        if new:
            got = [self.bpe.encode_ordinary(w.decode()) for w in new]
            size = np.fromiter(map(len, got), np.int64, len(got))
            first, total = len(self.known), int(size.sum())
            last = first + len(new)
            if last > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros(last, np.int64)]) for x in (self.at, self.size))
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + total, np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.at[first:last], self.size[first:last] = self.used + np.cumsum(size) - size, size
            self.used += total
            self.known.update(zip(new, range(first, last)))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one document after another, and their n + 1 offsets."""
        if not self.ready:
            self._load()
        n = len(offsets) - 1
        raw = data.tobytes()
        text = raw.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(place, offsets[:-1][np.diff(offsets) > 0])
        if len(points):
            starts = place[pretoken_starts(points, first)]
            ends = np.append(starts[1:], len(data))
            bounds = np.searchsorted(starts, offsets)
            which, distinct = K.codes(data, starts, ends)
            seat = self._seats(K.strings(distinct))[which]  # pre-tokens touch, so that no gaps are among them but empty ones
            from_, size = self.at[seat], self.size[seat]
            flat = _take_runs(self.flat, from_, size)
            at = np.append(0, np.cumsum(size))[bounds]
        else:
            flat, at = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if any(s in raw for s in self.special):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            parts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            for d in range(n):
                own = raw[offsets[d] : offsets[d + 1]]
                if any(s in own for s in self.special):
                    parts[d] = np.array(self.library.encode(own.decode(), add_special_tokens=False).ids, np.uint32)
            flat, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return flat, at


def _take_runs(flat: np.ndarray, from_: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs that begin at from_ and have these sizes, one after another."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.arange(total) + np.repeat(from_ - before, size)]


def cut(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece; size is a power of two."""
    bits = size.bit_length() - 1
    full = lengths >> bits
    count = full.copy()
    for k in range(bits):
        count += (lengths >> k) & 1
    doc = np.repeat(np.arange(len(lengths)), count)
    length = np.full(int(count.sum()), size, np.int64)
    place = np.cumsum(count) - count + full
    for k in range(bits - 1, -1, -1):
        has = np.flatnonzero((lengths >> k) & 1)
        length[place[has]] = 1 << k
        place[has] += 1
    start = np.cumsum(length) - length
    start -= np.repeat(np.append(0, np.cumsum(lengths))[:-1], count)
    return doc, start, length


class Packer:
    def __init__(self, json_path: str, size: int, end_id: int, keep_ids: bool):
        self.encoder, self.size, self.end_id, self.keep_ids = Encoder(json_path), size, end_id, keep_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A sequence's number holds the task and a count in it: unique, and the same again if the task is run again.
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for d, e in K.runs(offsets):
                flat, at = self.encoder.encode(data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d])
                lengths = np.diff(at) + 1
                flat = np.insert(flat, at[1:], self.end_id).astype("<u4")
                doc, start, length = cut(lengths, self.size)
                ends = np.cumsum(length)
                view = memoryview(flat).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), length.tolist())), np.int64, len(ends))
                columns = {
                    "doc_id": batch.column(0).slice(d, e - d).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc),
                    "doc_tokens": pa.array(lengths[doc]), "sequence_id": pa.array(number + np.arange(len(doc))), "offset": pa.array(np.zeros(len(doc), np.int64)), "bucket": pa.array(length.astype(np.int32)),
                }
                number += len(doc)
                if self.keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            K.tidy()


def pack(docs: DataFrame, json_path: str, size: int = SIZE, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: document, start, length, crc32 of its ids, tokens of the document, sequence, offset in it, bucket and (if kept) ids.

    Null and empty texts hold the end id alone and give one piece of length 1;
    repeated ids and texts are packed once for each row; other columns of docs
    are not looked at.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    bounded(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int" + ", ids array<int>" * keep_ids
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(Packer(json_path, size, end_id, keep_ids), schema)
    return out.withColumnRenamed("doc_id", id_col)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences, each length in a folder of its own, for readers that batch equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed at 1,024 tokens, without the ids themselves.

    Null and empty texts give one piece of length 1, the end id; texts of any
    length are packed whole; repeated rows are packed each; an empty table
    gives no row; columns beside doc_id and text aren't looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizer("byte_bpe_50k.json"), keep_ids=False)
