"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Two equal strings of the least length hold the same anchors: in each window,
the 64-byte gram with the smallest hash. Only the suffixes that begin at
anchors are compared, and only with those of the same gram:

1. each document gives its anchors, and a digest of the bytes around each;
2. grams that occur once drop out; anchors whose surroundings are the same, by
   128 bits of BLAKE2b, are one suffix with a count;
3. the suffixes of a gram are sorted, and so are their reversed left sides, by
   a mergesort whose comparisons find the common extension by binary search
   over prefix polynomial hashes; neighbours are then verified byte by byte,
   and sorted again by their bytes if a collision has put one out of order;
4. from the common extensions on both sides follows which windows around each
   anchor occur again, and the documents put their spans together.

No string is compared with all others, and no group need go to one task: a
group of more than max_group suffixes is split by what its windows have in
common. Windows with a to b bytes before the anchor all hold the a bytes before
it and the length - b bytes from it on. Halves of the range hold more, so that
fewer suffixes share them: those that share nothing drop out, and small groups
are sorted as any other. Of suffixes whose windows of the range are all the same
one goes on for all, so that a long passage in very many places goes on once.

Passages of so many words that stand in several texts, which may be shorter, are
found beside these where they are asked for. Equal ones hold the same anchor too,
the gram of words with the smallest hash. Of the passages whose anchors stand in
several texts, and no others, the digests are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, scratch_path, written
from .textstore import StoreReader, StoreWriter

LENGTH, GRAM = 400, 64
#: Words of an anchor of a passage, and bits of a word's place in a run of texts.
WORD_GRAM, _WORD_BITS = 8, 31
#: Suffixes sorted together in one group at most, and in one batch of groups.
MAX_GROUP, BATCH = 4_000, 8_000
#: Bits of a place in a slice of a text, and bytes of a slice: windows that lie in no slice alone are in the next one whole.
_AT_BITS, SLICE = 28, 1 << 19
_SCANNED = "uid bigint, doc_id bigint, n_bytes bigint, sha256 string, place string, anchors array<struct<gram:bigint,around:binary,pos:int>>"


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, in linear time."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _slice_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, and their gram hashes."""
    prefix = K.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    h = K.segment_hash(prefix, at, at + GRAM)
    # The smallest hash, and the first of equal ones: hash above, place below.
    below = np.uint64((1 << _AT_BITS) - 1)
    low = window_minima((h & ~below) | at.astype(np.uint64), length - GRAM + 1)
    inside = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    p = np.unique(low[inside] & below).astype(np.int64)
    return p, h[p].view(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Document, place, gram hash and digest of the surroundings of every anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    if len(offsets) == 2 and len(data) > SLICE + length:
        found = []
        for a in range(0, len(data) - length + 1, SLICE):
            part = data[a : a + SLICE + length - 1]
            p, gram = _slice_anchors(part, np.array([0, len(part)]), length)
            found.append((p + a, gram))
        p, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
        gram = np.concatenate([x for _, x in found])[first]
    else:
        p, gram = _slice_anchors(data, offsets, length)
    doc = np.searchsorted(offsets, p, "right") - 1
    left = np.minimum(length - GRAM, p - offsets[doc])
    right = np.minimum(length, offsets[doc + 1] - p)
    view = memoryview(data)
    around = [blake2b(view[x - a : x + b], digest_size=16, salt=a.to_bytes(8, "little")).digest() for x, a, b in zip(p.tolist(), left.tolist(), right.tolist())]
    return doc, p - offsets[doc], gram, around


def word_anchors(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor of passages of so many words: document, gram hash, and the first and last passage, by its first word, that it is the anchor of."""
    starts, ends, bounds = K.segments(K.NOT_SPACE[data], offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < words:
        return none, none, none, none
    gram = min(words, WORD_GRAM)
    h = K.gram_hash(K.segment_digests(data, starts, ends), gram)
    # The smallest hash, and the first of equal ones, so that an anchor's passages stand in a row.
    below = np.uint64((1 << _WORD_BITS) - 1)
    low = window_minima((h & ~below) | np.arange(len(h), dtype=np.uint64), words - gram + 1)
    doc = K.owner(bounds)
    at = np.flatnonzero(doc[: len(low)] == doc[words - 1 :])
    p = (low[at] & below).astype(np.int64)
    edge = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (doc[at[1:]] != doc[at[:-1]]))) if len(at) else none
    first, last = at[edge], at[np.append(edge[1:], len(at)) - 1] if len(at) else none
    doc = doc[first]
    return doc, h[p[edge]].view(np.int64), first - bounds[doc], last - bounds[doc]


class Scanner:
    def __init__(self, length: int, folder: str, words: int = 0):
        self.length, self.folder, self.words = length, folder, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store = TaskContext.get(), None
        uid = (context.partitionId() if context else 0) << 36
        for batch in batches:
            store = store or StoreWriter(self.folder)
            data, offsets = K.column_bytes(batch.column(1))
            data = np.ascontiguousarray(data)
            for d, e in K.runs(offsets, SLICE):
                off, part = offsets[d : e + 1] - offsets[d], data[offsets[d] : offsets[e]]
                doc, pos, gram, around = anchors(part, off, self.length)
                bounds = np.searchsorted(doc, np.arange(e - d + 1)).astype(np.int32)
                view = memoryview(part)
                texts = [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                found = pa.StructArray.from_arrays([pa.array(gram), pa.array(around, pa.binary()), pa.array(pos.astype(np.int32))], names=["gram", "around", "pos"])
                rest = [batch.column(k).slice(d, e - d) for k in range(2, batch.num_columns)]
                names = batch.schema.names[2:]
                if self.words:
                    doc, gram, first, last = word_anchors(part, off, self.words)
                    anchored = pa.StructArray.from_arrays([pa.array(gram), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["gram", "first", "last"])
                    rest.insert(0, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(e - d + 1)).astype(np.int32)), anchored))
                    names = ["passages", *names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(e - d)), batch.column(0).slice(d, e - d), pa.array(np.diff(off)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([store.add(t) if batch.column(1)[d + k].is_valid else None for k, t in enumerate(texts)], pa.string()), pa.ListArray.from_arrays(pa.array(bounds), found), *rest],
                    names=["uid", "doc_id", "n_bytes", "sha256", "place", "anchors", *names],
                )
                uid += e - d
            K.tidy()
        if store:
            store.close()


class Fetched:
    """The bytes before (reversed) and from anchors on in (..., place, pos) rows, which are sorted by place; a thousand rows at a time."""

    def __init__(self, length: int, folder: str):
        self.length, self.folder = length, folder

    def sides(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
        store, last, text = StoreReader(self.folder), None, b""
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                left, right = [], []
                for place, pos in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("place", "pos"))):
                    if place != last:
                        last, text = place, store.get(place)
                    left.append(text[max(0, pos - self.length + GRAM) : pos][::-1])
                    right.append(text[pos : pos + self.length])
                yield batch, left, right
        store.close()
        K.tidy()


class Surroundings(Fetched):
    """(key, gram, around, range, left, right) of (key, gram, around, range, place, pos) rows."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left, right in self.sides(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["key", "gram", "around", "range", "left", "right"])


class Halves(Fetched):
    """Splits the range of (key, gram, around, range, place, pos) rows: a row for each half that a window of the suffix lies in.

    A range [a, b] of bytes before the anchor is one number, a * 2**32 + b; the
    new key is the digest of what its windows have in common, and all of all
    that they hold.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left, right in self.sides(batches):
            row, keys, wholes, ranges = [], [], [], []
            for k, (key, both, l, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), left, right)):
                a, b = both >> 32, both & 0xFFFFFFFF
                mid = (a + b) >> 1
                for x, y in ((a, mid), (mid + 1, b)):
                    if x <= y and len(l) >= x and len(r) >= self.length - y:
                        row.append(k)
                        salt = (x << 32 | y).to_bytes(8, "little")
                        keys.append(blake2b(key + l[:x] + b"|" + r[: self.length - y], digest_size=16, salt=salt).digest())
                        before, behind = l[:y], r[: self.length - x]
                        wholes.append(blake2b(len(before).to_bytes(8, "little") + before + behind, digest_size=16, salt=salt).digest())
                        ranges.append(x << 32 | y)
            at = pa.array(row, pa.int64())
            gram, around, place, pos = (batch.column(k).take(at) for k in (1, 2, 4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(wholes, pa.binary()), gram, around, pa.array(ranges, pa.int64()), place, pos], names=["key", "all", "gram", "around", "range", "place", "pos"])


class Suffixes:
    """Byte strings of at most width bytes, and their order within groups."""

    def __init__(self, strings: pa.Array, group: np.ndarray, width: int):
        self.n, self.width, self.group = len(strings), max(1, width), group
        bufs = strings.buffers()
        off = np.frombuffer(bufs[1], np.int32)[strings.offset : strings.offset + self.n + 1].astype(np.int64)
        self.size = np.diff(off)
        flat = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] else np.zeros(0, np.uint8)
        self.at = off[:-1] - off[0]
        self.bytes = np.append(flat, np.uint8(0))
        self.prefix = K.prefix_hash(flat)
        self.inverse = K.powers(len(flat) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common extension of each pair, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        x, y = self.at[a], self.at[b]
        turn_x, turn_y = self.inverse[x], self.inverse[y]
        base_x, base_y = self.prefix[x], self.prefix[y]
        for _ in range(self.width.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[x + mid] - base_x) * turn_x == (self.prefix[y + mid] - base_y) * turn_y
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def before(self, a: np.ndarray, b: np.ndarray, tie: bool) -> np.ndarray:
        """Whether a's suffix stands before b's; tie: the answer for equal ones."""
        n = self.common(a, b)
        end_a, end_b = n >= self.size[a], n >= self.size[b]
        less = self.bytes[np.minimum(self.at[a] + n, len(self.bytes) - 1)] < self.bytes[np.minimum(self.at[b] + n, len(self.bytes) - 1)]
        less = np.where(end_a & end_b, tie, np.where(end_a, True, np.where(end_b, False, less)))
        return np.where(self.group[a] != self.group[b], self.group[a] < self.group[b], less)

    def order(self) -> np.ndarray:
        """Mergesort: of two sorted runs, each element's seat is its own plus its rank in the other run."""
        order, run = np.arange(self.n), 1
        at = np.arange(self.n)
        while run < self.n:
            block = at // run
            first = (block ^ 1) * run  # where the other run begins
            lo = np.minimum(first, self.n)
            hi = np.minimum(first + run, self.n)
            start, left = lo.copy(), block & 1 == 0
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) >> 1
                mine, other = order[open_], order[mid]
                # An element of the left run goes before its equals in the right one.
                ahead = np.where(left[open_], self.before(other, mine, False), self.before(other, mine, True))
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            seat = np.where(left, at, first + (at - block * run)) + (lo - start)
            merged = np.empty_like(order)
            merged[seat] = order
            order, run = merged, run * 2
        return order

    def extensions(self, order: np.ndarray) -> np.ndarray:
        """Of each suffix in the order, the bytes in common with the one before it, compared byte by byte; 0 across groups."""
        out = np.zeros(self.n, np.int64)
        step = np.arange(self.width)
        for s in range(1, self.n, 4096):
            a, b = order[s : s + 4096], order[s - 1 : s - 1 + min(4096, self.n - s)]
            size = np.minimum(self.size[a], self.size[b])
            x = self.bytes[np.minimum(self.at[a][:, None] + step, len(self.bytes) - 1)]
            y = self.bytes[np.minimum(self.at[b][:, None] + step, len(self.bytes) - 1)]
            differ = (x != y) | (step >= size[:, None])
            n = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
            out[s : s + len(a)] = np.where(self.group[a] == self.group[b], n, 0)
        return out

    def checked(self) -> tuple[np.ndarray, np.ndarray]:
        """The order and its extensions; by the bytes themselves if hashes that collide have spoilt it."""
        order = self.order()
        common = self.extensions(order)
        a, b, n = order[:-1], order[1:], common[1:]
        last = len(self.bytes) - 1
        fits = (n >= self.size[a]) | ((n < self.size[b]) & (self.bytes[np.minimum(self.at[a] + n, last)] < self.bytes[np.minimum(self.at[b] + n, last)]))
        if not (fits | (self.group[a] != self.group[b])).all():
            text = self.bytes.tobytes()
            order = np.array(sorted(range(self.n), key=lambda k: (self.group[k], text[self.at[k] : self.at[k] + self.size[k]])))
            common = self.extensions(order)
        return order, common


def windows_again(group: np.ndarray, first: np.ndarray, last: np.ndarray, left: pa.Array, right: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and most bytes, of the range from first to last, that windows found again have before each suffix's anchor; most below least: none.

    All these windows hold the anchor, so that together they cover the bytes
    from the most before it on to the last of the window with the least.
    """
    n, deep = len(group), length - GRAM
    l, r = Suffixes(left, group, deep), Suffixes(right, group, length)
    lo, hi = np.full(n, length), np.full(n, -1)
    by_left, common_left = l.checked()
    by_right, common_right = r.checked()
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    first, last = np.maximum(first, length - r.size), np.minimum(last, l.size)
    for o in range(max(0, int(first.min(initial=length))), int(last.max(initial=-1)) + 1):
        class_right[by_right] = np.cumsum(common_right < length - o)
        class_left[by_left] = np.cumsum(common_left < o)
        hit = np.flatnonzero((first <= o) & (o <= last))
        again = hit[K.often(K.ranks(class_right[hit] * (n + 1) + class_left[hit])[0])]
        lo[again] = np.minimum(lo[again], o)
        hi[again] = np.maximum(hi[again], o)
    return lo, hi


class Solver:
    """Solves groups of one key; a task's rows are sorted by key."""

    def __init__(self, length: int, batch: int):
        self.length, self.batch = length, batch

    def _solve(self, t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        one = lambda name: t.column(name).chunk(0)
        key = one("key")
        group = np.cumsum(np.append(True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)))
        ranges = one("range").to_numpy()
        lo, hi = windows_again(group, ranges >> 32, ranges & 0xFFFFFFFF, one("left"), one("right"), self.length)
        keep = pa.array(np.flatnonzero(hi >= lo))
        return pa.RecordBatch.from_arrays([one("gram").take(keep), one("around").take(keep), pa.array(lo.astype(np.int32)).take(keep), pa.array(hi.astype(np.int32)).take(keep)], names=["gram", "around", "least", "most"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < self.batch:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").chunk(0)
            edge = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(edge):  # all groups but the last, which may go on
                done = 0
                for stop in (*edge[np.searchsorted(edge, np.arange(self.batch, int(edge[-1]), self.batch))].tolist(), int(edge[-1])):
                    if stop > done:
                        yield self._solve(t.slice(done, stop - done))
                        done = stop
                held = t.slice(done).combine_chunks().to_batches()
        if held:
            yield self._solve(pa.Table.from_batches(held))
        K.tidy()


class Passages:
    """(digest, uid, at) of the passages named in (uid, place, ranges) rows, which begin at a word from first to last of a range."""

    def __init__(self, words: int, folder: str):
        self.words, self.folder = words, folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = StoreReader(self.folder)
        for batch in batches:
            found, uids, at = [], [], []
            for uid, place, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                split = store.get(place).split()
                ends = np.cumsum([len(x) + 1 for x in split]).tolist()
                view = memoryview(b" ".join(split))
                for x in ranges:
                    found += [blake2b(view[ends[k - 1] if k else 0 : ends[k + self.words - 1] - 1], digest_size=16).digest() for k in range(x["first"], x["last"] + 1)]
                    uids += [uid] * (x["last"] + 1 - x["first"])
                    at += range(x["first"], x["last"] + 1)
                    if len(found) > 20_000:
                        yield self._rows(found, uids, at)
                        found, uids, at = [], [], []
            yield self._rows(found, uids, at)
        store.close()
        K.tidy()

    @staticmethod
    def _rows(found: list, uids: list, at: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(uids, pa.int64()), pa.array(at, pa.int32())], names=["digest", "uid", "at"])


def _shared_passages(scanned: DataFrame, words: int, folder: str) -> DataFrame:
    """(uid, at) of the passages of so many words that other rows have too; at: the first word's place."""
    anchored = scanned.select("uid", F.explode("passages").alias("k")).select("uid", "k.gram", "k.first", "k.last")
    several = lambda rows, key: rows.groupBy(key).agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b").select(key)
    ranges = anchored.join(several(anchored, "gram"), "gram").groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    rows = scanned.select("uid", "place").join(ranges, "uid").select("uid", "place", "ranges")
    found = written(rows.mapInArrow(Passages(words, folder), "digest binary, uid bigint, at int"), "passages")
    return found.join(several(found, "digest"), "digest").select("uid", "at")


_FOUND = "gram bigint, around binary, least int, most int"


def _again(rows: DataFrame, length: int, folder: str, tasks: int, max_group: int) -> DataFrame:
    """(gram, around, least, most) of the suffixes in rows (gram, around, place, pos) that share windows with others; a suffix may have several rows."""
    level = rows.select(F.unhex(F.hex("gram")).alias("key"), "gram", "around", F.lit(length - GRAM).cast("bigint").alias("range"), "place", "pos")
    found = None
    while True:
        # Counts are written, so that the join deals a key with very many rows anew.
        counts = written(level.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1), "counts", short=True)
        large = not counts.where(F.col("kinds") > max_group).isEmpty()
        level = level.join(counts, "key")
        if large:
            level = written(level, "shared")
        few = level.where(F.col("kinds") <= max_group).drop("kinds").repartitionByRange(tasks, "place", "pos").sortWithinPartitions("place", "pos")
        around = "key binary, gram bigint, around binary, range bigint, left binary, right binary"
        part = few.mapInArrow(Surroundings(length, folder), around).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(Solver(length, BATCH), _FOUND)
        found = part if found is None else found.union(part)
        if not large:
            return found
        many = level.where(F.col("kinds") > max_group).drop("kinds").repartitionByRange(tasks, "place", "pos").sortWithinPartitions("place", "pos")
        halves = written(many.mapInArrow(Halves(length, folder), "key binary, all binary, gram bigint, around binary, range bigint, place string, pos int"), "halves")
        # Suffixes with all windows of the range the same have them again, and one goes on for the others.
        one = written(halves.groupBy("key", "all").agg(F.count("*").alias("same"), F.min(F.struct("place", "pos", "gram", "around", "range")).alias("one")), "alike", short=True)
        alike = one.where(F.col("same") > 1).select("key", "all")
        found = found.union(halves.join(alike, ["key", "all"]).select("gram", "around", F.shiftright("range", 32).cast("int").alias("least"), F.col("range").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("most")))
        level = one.select("key", "one.gram", "one.around", "one.range", "one.place", "one.pos")


def _spans(docs: DataFrame, length: int, folder: str, keep: tuple[str, ...], id_col: str, text_col: str, max_group: int, words: int = 0) -> DataFrame:
    """(uid, doc_id, n_bytes, sha256, place, spans) of each row, and the columns in keep; spans: what occurs again, not yet merged.

    A span without least and most is a passage of so many words, and its pos the place of its first word.
    """
    bounded(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col), *(F.col(c).alias(f"own_{c}") for c in keep))
    kinds = dict(own.dtypes)
    more = ", passages array<struct<gram:bigint,first:int,last:int>>" if words else ""
    scanned = written(own.mapInArrow(Scanner(length, folder, words), _SCANNED + more + "".join(f", `own_{c}` {kinds[f'own_{c}']}" for c in keep)), "scanned")
    at = scanned.select("uid", "place", F.explode("anchors").alias("k")).select("uid", "place", "k.gram", "k.around", "k.pos")
    suffixes = at.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos", "place")).alias("one"))
    suffixes = written(suffixes.select("gram", "around", "n", "one.place", "one.pos"), "suffixes")
    # A suffix that occurs twice or more with all that is around it: its windows are clipped by the document below.
    copies = suffixes.where(F.col("n") > 1).select("gram", "around", F.lit(0).alias("least"), F.lit(length - GRAM).alias("most"))
    found = copies.union(_again(suffixes.drop("n"), length, folder, tasks, max_group))
    spans = at.select("uid", "gram", "around", "pos").join(found, ["gram", "around"]).select("uid", "pos", "least", "most")
    if words:
        none = F.lit(None).cast("int")
        spans = spans.union(_shared_passages(scanned, words, folder).select("uid", "at", none, none))
    parts = spans.groupBy("uid").agg(F.collect_list(F.struct("pos", "least", "most")).alias("spans"))
    return scanned.drop("anchors", "passages").join(parts, "uid", "left")


class Cutter:
    """Turns found windows into merged spans and what is left of the text."""

    def __init__(self, length: int, folder: str, texts: bool, words: int = 0):
        self.length, self.folder, self.texts, self.words = length, folder, texts, words

    def _merge(self, spans: list, n: int, text: bytes | None) -> list[list[int]]:
        passages = [s["pos"] for s in spans if s["least"] is None]
        found = [(s["pos"] - min(s["most"], s["pos"]), s["pos"] + self.length - max(s["least"], self.length - (n - s["pos"]))) for s in spans if s["least"] is not None]
        found = [(a, b) for a, b in found if b - a >= self.length]
        if passages:
            starts, ends, _ = K.segments(K.NOT_SPACE[np.frombuffer(text, np.uint8)], np.array([0, n]))
            found += zip(starts[passages].tolist(), ends[np.array(passages) + self.words - 1].tolist())
        out: list[list[int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = StoreReader(self.folder)
        for whole in batches:
            for batch in self._slices(whole):
                removed, count, digests, texts = [], [], [], []
                for n, sha, place, spans in zip(*(batch.column(k).to_pylist() for k in ("n_bytes", "sha256", "place", "spans"))):
                    text = store.get(place) if place is not None and (self.texts or spans) else None
                    spans = self._merge(spans or [], n, text)
                    removed.append(sum(b - a for a, b in spans))
                    count.append(len(spans))
                    if self.texts:
                        texts.append(text if text is None else cut_text(text, spans))
                    elif spans:
                        edges = [0, *(x for s in spans for x in s), n]
                        sha = hashlib.sha256(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest()
                    digests.append(sha)
                rest = batch.columns[5:]
                last = [pa.array(texts, pa.string())] if self.texts else [pa.array(digests)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), *last, *rest], names=["doc_id", "n_bytes", "n_removed", "n_spans", "text" if self.texts else "kept_sha256", *batch.schema.names[5:]])
        store.close()
        K.tidy()

    @staticmethod
    def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows whose texts are a few megabytes together."""
        total, a = np.cumsum(batch.column("n_bytes").to_numpy() + 100), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + K.RUN_BYTES)))
            yield batch.slice(a, b - a)
            a = b


def cut_text(text: bytes, spans: list[list[int]]) -> str:
    """The text without the spans; a character that a span's edge cuts through stays."""
    kept, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode()


_COLUMNS = ("doc_id", "n_bytes", "sha256", "place", "spans")


def find_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    Removed is each byte of a text, as UTF-8, that a string of length bytes
    covers which also starts at another place of the texts, the same text
    included; spans are maximal runs of removed bytes. Null texts count as
    empty; repeated rows are texts of their own, so they cover each other;
    columns beside the two aren't looked at.
    """
    folder = scratch_path(docs.sparkSession, "texts")
    rows = _spans(docs, length, folder, (), id_col, text_col, max_group).select(*_COLUMNS)
    return rows.mapInArrow(Cutter(length, folder, False), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("doc_id", id_col)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed", words: int = 0) -> DataFrame:
    """The rows of docs, all columns, with repeated spans cut out of their texts, beside removed_col, the bytes of the spans.

    words: what so many words in a row cover goes too if another row has the
    same ones in a row, whatever white space is between them (0: no such rule).
    A null text stays null; removed_col mustn't be a column of docs.
    """
    folder = scratch_path(docs.sparkSession, "texts")
    keep = tuple(c for c in docs.columns if c != text_col)
    rows = _spans(docs, length, folder, keep, id_col, text_col, MAX_GROUP, words).select(*_COLUMNS, *(f"own_{c}" for c in keep))
    kinds = dict(rows.dtypes)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, text string" + "".join(f", `own_{c}` {kinds[f'own_{c}']}" for c in keep)
    out = rows.mapInArrow(Cutter(length, folder, True, words), schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"own_{c}").alias(c) for c in docs.columns), F.col("n_removed").alias(removed_col))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that also start elsewhere.

    n_bytes is the text's length before. Null and empty texts have no bytes;
    texts of any length are taken whole; repeated rows and ids keep a row each
    and cover each other; an empty table gives no row; columns beside doc_id
    and text aren't looked at.
    """
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
