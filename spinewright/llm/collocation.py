"""Phrases whose words stand together more often than chance would have it.

The texts of a task's shard are laid on a line of positions, a word on each and
an empty position between two pieces, for each language by itself. A word's
bitmap has a bit for each position with the word; only bytes with a bit are
kept, with their place. A phrase's bitmap, of the positions where it ends, is
shifted by one and ANDed with the bitmaps of words; what has a bit left is a
phrase of one word more, and its popcount says how often the shard has it. Empty
positions have no word, so no phrase leaves its piece. Phrases of a range of
first words are extended to their full length before the next range begins.

Popcounts are summed over the shards, three times: of words, of pairs of words
that are frequent, and of longer phrases whose pairs all are. What isn't frequent
everywhere can't be part of a frequent phrase, so nothing is lost. Words are
known by their bytes, and then by numbers given to the frequent ones.

A shard's words or phrases go packed to buckets, about one for each BUCKET_BYTES
of text, so that a bucket's rows fit in a task whatever the input: it adds them
up and then tells each shard which of its own are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, written
from .tokens import unsqueeze

#: Bytes of text in a shard, unless one text is longer, and for each bucket of words or phrases that are added up.
SHARD_BYTES, BUCKET_BYTES = 16 << 20, 24 << 20
#: Bytes of bitmaps that are extended at once.
AT_ONCE = 1 << 17
#: Phrases that a shard holds back before it sends them, so that messages stay few however many buckets there are.
HELD_BACK = 1 << 19
#: Words or phrases, at least, that wait to be added to those a bucket has.
WAITING = 1 << 17
LEAST, LONGEST, TOP = 100, 5, 2000
#: Between pieces: ``[.,;:!?\x0A-\x0D]``; between words also ``[\x20\x09]``.
_PIECE = K.byte_set((0x0A, 0x0D))
_PIECE[list(b".,;:!?")] = True
_WORD = ~(_PIECE | K.byte_set((0x20, 0x20), (0x09, 0x09)))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts; a long text comes in several, cut between pieces."""
    for d, e in K.runs(offsets):
        a, b = int(offsets[d]), int(offsets[e])
        while b - a > 2 * K.RUN_BYTES:
            ends = np.flatnonzero(_PIECE[data[a + K.RUN_BYTES : a + 2 * K.RUN_BYTES]])
            if not len(ends):
                break
            at = a + K.RUN_BYTES + int(ends[0])
            yield data[a:at], np.clip(offsets[d : e + 1], a, at) - a
            a = at
        yield data[a:b], np.clip(offsets[d : e + 1], a, b) - a


def positions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words on a line of positions, as numbers from 1 with 0 between pieces; the words; how often each occurs."""
    found, words = [], []
    for raw, off in _parts(data, offsets):
        raw = np.ascontiguousarray(K.LOWER[raw])
        starts, ends, bounds = K.segments(_WORD[raw], off)
        if not len(starts):
            continue
        code, distinct = K.codes(raw, starts, ends)
        borders = np.append(0, np.cumsum(_PIECE[raw]))
        fresh = np.ones(len(starts), bool)
        fresh[1:] = borders[starts[1:]] != borders[ends[:-1]]
        fresh[bounds[:-1][np.diff(bounds) > 0]] = True
        line = np.full(len(starts) + int(fresh.sum()), -1, np.int64)
        line[np.arange(len(starts)) + np.cumsum(fresh)] = code
        found.append(line)
        words.append(distinct)
    coded = pa.concat_arrays([*words, pa.array([], pa.large_binary())]).dictionary_encode()
    turn, first = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *map(len, words)])
    line = np.concatenate([*(np.where(x < 0, -1, turn[x + k]) for x, k in zip(found, first)), np.zeros(0, np.int64)]).astype(np.int64)
    times = np.bincount(line[line >= 0], minlength=len(coded.dictionary))
    held = np.flatnonzero(times)  # what only gaps hold is no word
    seat = np.zeros(len(times) + 1, np.int64)
    seat[held] = np.arange(1, len(held) + 1)
    return seat[line], coded.dictionary.take(pa.array(held)), times[held]


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of integers below 2**32 as compressed byte planes."""
    flat = np.concatenate(columns).astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def _pack_words(words: pa.Array, times: np.ndarray) -> bytes:
    raw = b"".join(K.strings(words))
    head = _squeezed(pc.binary_length(words).to_numpy(), times)
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_words(packed: bytes) -> tuple[pa.Array, np.ndarray]:
    n = 4 + int.from_bytes(packed[:4], "little")
    length, times = unsqueeze(packed[4:n]).reshape(2, -1)
    raw = zstandard.ZstdDecompressor().decompress(packed[n:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(raw)]), times


class Shards:
    """(shard, lang, n, line, words) of (lang, text) rows; words are packed by bucket, and numbered in that order on the line."""

    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("line", pa.binary()), ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())])))])

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                for row in self.rows(pa.Table.from_batches(waiting), number):
                    number += 1
                    yield row
                waiting, size = [], 0
        if waiting:
            yield from self.rows(pa.Table.from_batches(waiting), number)

    def rows(self, table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        langs = table.column(0).combine_chunks().dictionary_encode()
        texts = table.column(1).cast(pa.large_string()).combine_chunks()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            line, words, times = positions(*K.column_bytes(texts.take(pa.array(np.flatnonzero(langs.indices.to_numpy() == k)))))
            digest = K.digests(words) if len(words) else np.zeros(0, np.uint64)
            order = np.argsort(digest, kind="stable")
            seat = np.zeros(len(words) + 1, np.int64)
            seat[order + 1] = np.arange(1, len(words) + 1)
            words, times = words.take(pa.array(order)), times[order]
            edge = np.searchsorted(((digest[order] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32), np.arange(self.buckets + 1).astype(np.uint64))
            packed = [{"bucket": b, "packed": _pack_words(words.slice(edge[b], edge[b + 1] - edge[b]), times[edge[b] : edge[b + 1]])} for b in np.flatnonzero(np.diff(edge)).tolist()]
            row = {"shard": number + k, "lang": lang, "n": int(times.sum()), "line": _squeezed(seat[line]), "words": packed}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in self.schema], schema=self.schema)
        K.tidy()


class Gathered:
    """Calls solved for each bucket of rows sorted by bucket, which come first in their rows, with the rows' other values."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and rows:
                    yield from self.solved(now, rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield from self.solved(now, rows)
        K.tidy()


class Words(Gathered):
    """Of (bucket, shard, lang, packed) rows: (home, bucket, packed, words) with the numbers of the shard's words, 0 for those that aren't frequent, and with the frequent words where there is no home."""

    schema = pa.schema([("home", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary()), ("words", pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])))])

    def __init__(self, buckets: int, least: int):
        self.buckets, self.least = buckets, least

    def solved(self, bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        # A word is known by its language and itself, between which a blank is safe, as no word has one.
        keyed = lambda lang, packed: pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.large_binary()), _unpack_words(packed)[0], pa.scalar(b" ", pa.large_binary()))
        found = Added(pa.array([], pa.large_binary()))
        for _, lang, packed in rows:
            found.add(keyed(lang, packed), _unpack_words(packed)[1])
        found.settle()
        keys, total = found.keys, found.times
        often = np.flatnonzero(total >= self.least)
        often = often[np.argsort(-total[often], kind="stable")]
        ids = np.arange(len(often)) * self.buckets + bucket + 1
        if len(ids) and ids[-1] >= 1 << 32:
            raise ValueError("more than 2**32 frequent words")
        known = keys.take(pa.array(often))
        for home, lang, packed in rows:
            at = pc.index_in(keyed(lang, packed), known).fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_pylist([{"home": home, "bucket": bucket, "packed": _squeezed(np.append(ids, 0)[at])}], schema=self.schema)
        named = [(w.rpartition(b" "), i, n) for w, i, n in zip(K.strings(known), ids.tolist(), total[often].tolist())]
        yield pa.RecordBatch.from_pylist([{"bucket": bucket, "words": [{"id": i, "lang": lang.decode(), "word": w.decode(), "n": n} for (lang, _, w), i, n in named]}], schema=self.schema)


class Bitmaps:
    """Compressed position bitmaps of the numbers above 0 on a line.

    A bitmap is a set of bytes: whose it is, which byte, and its eight bits.
    """

    def __init__(self, line: np.ndarray):
        at = np.flatnonzero(line)
        owner, byte, bit = line[at], at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
        order = np.lexsort((byte, owner))
        owner, byte, bit = owner[order], byte[order], bit[order]
        head = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(byte, prepend=-1) != 0))
        self.owner, self.byte, self.bits = owner[head], byte[head], np.bitwise_or.reduceat(bit, head) if len(head) else bit
        by = np.argsort(self.byte, kind="stable")
        self.word, self.word_bits = self.owner[by], self.bits[by]
        self.first = np.searchsorted(self.byte[by], np.arange(len(line) // 8 + 3))

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Ranges of the bytes of bitmaps that hold whole bitmaps, AT_ONCE bytes of them or one bitmap."""
        n, a = len(self.owner), 0
        while a < n:
            b = min(n, a + AT_ONCE)
            if b < n:
                cut = int(np.searchsorted(self.owner, self.owner[b]))
                b = cut if cut > a else int(np.searchsorted(self.owner, self.owner[b], "right"))
            yield a, b
            a = b

    def extend(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, next word, byte and bits of what is left of shifted bitmaps after AND with each word's."""
        out = []
        for a in range(0, len(phrase), AT_ONCE):
            p, c, x = phrase[a : a + AT_ONCE], byte[a : a + AT_ONCE], bits[a : a + AT_ONCE]
            up, over = x << np.uint8(1), x >> np.uint8(7)
            here, there = np.flatnonzero(up), np.flatnonzero(over)
            p, c, x = np.concatenate([p[here], p[there]]), np.concatenate([c[here], c[there] + 1]), np.concatenate([up[here], over[there]])
            count = self.first[c + 1] - self.first[c]
            which = np.repeat(np.arange(len(p)), count)
            word = np.arange(len(which)) + np.repeat(self.first[c] - (np.cumsum(count) - count), count)
            both = x[which] & self.word_bits[word]
            left = np.flatnonzero(both)
            which = which[left]
            out.append((p[which], self.word[word[left]], c[which], both[left]))
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (phrase, phrase, byte, bits)


def _grown(words: np.ndarray, phrase: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the phrases of one word more, whose each byte is, and their popcounts."""
    below = int(word.max(initial=0)) + 1
    key, which = np.unique(phrase * below + word, return_inverse=True)
    longer = np.concatenate([words[key // below], (key % below)[:, None]], axis=1)
    return longer, which, np.bincount(which, weights=np.bitwise_count(bits), minlength=len(key)).astype(np.int64)


def pairs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbours on a line and how often each occurs."""
    maps, words, times = Bitmaps(line), [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for a, b in maps.ranges():
        phrase, word, _, bits = maps.extend(maps.owner[a:b], maps.byte[a:b], maps.bits[a:b])
        below = int(line.max()) + 1
        key, which = np.unique(phrase * below + word, return_inverse=True)
        words.append(np.stack([key // below, key % below], axis=1))
        times.append(np.bincount(which, weights=np.bitwise_count(bits), minlength=len(key)).astype(np.int64))
    return np.concatenate(words), np.concatenate(times)


def longer_phrases(line: np.ndarray, frequent: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 3 words and more, and how often each occurs, all of whose pairs are frequent (as first << 32 | second, in order)."""
    maps = Bitmaps(line)
    for a, b in maps.ranges():
        own, phrase = np.unique(maps.owner[a:b], return_inverse=True)
        words, byte, bits = own[:, None], maps.byte[a:b], maps.bits[a:b]
        for n in range(2, longest + 1):
            phrase, word, byte, bits = maps.extend(phrase, byte, bits)
            code = words[phrase, -1] << 32 | word
            at = np.minimum(np.searchsorted(frequent, code), max(len(frequent) - 1, 0))
            fits = np.flatnonzero(frequent[at] == code) if len(frequent) else np.zeros(0, np.int64)
            if not len(fits):
                break
            words, which, times = _grown(words, phrase[fits], word[fits], bits[fits])
            phrase, byte, bits = which, byte[fits], bits[fits]
            if n > 2:
                yield words, times


def _dealt(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of phrases by bucket and then by words, and the n + 1 bounds of the buckets in it.

    They come in the order of their words. The last word tells only roughly
    which bucket, so that phrases that differ by it alone are often neighbours
    and pack well.
    """
    h = np.zeros(len(words), np.uint64)
    for k, column in enumerate(words.T):
        h = K.mix(h * np.uint64(K.BASE) + (column >> 12 if k else column).astype(np.uint64))
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    if buckets <= 1 << 16:  # sorted by digits
        bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(words: np.ndarray, times: np.ndarray, edge: np.ndarray | None = None) -> list[bytes]:
    """Phrases and their counts, between each two edges in order: of each word the step from the one above, where all before it are the same. The first byte is the number of words."""
    edge = np.array([0, len(words)]) if edge is None else edge
    same, out = np.ones(len(words), bool), np.empty((words.shape[1] + 2, len(words)), "<u4")
    same[edge[edge < len(words)]] = False
    for k, column in enumerate(words.T):
        step = np.diff(column, prepend=0)
        out[k] = np.where(same, step, column)
        same &= step == 0
    out[-2], out[-1] = times & 0xFFFFFFFF, times >> 32
    head, compressor = bytes([words.shape[1]]), zstandard.ZstdCompressor(level=3)
    planes = (np.ascontiguousarray(out[:, a:b]).view(np.uint8).reshape(-1, 4).T for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()))
    return [head + compressor.compress(x.tobytes()) for x in planes]


def _unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, raw = b[0], unsqueeze(b[1:])
    raw = raw.reshape(width + 2, -1)
    words = np.empty((raw.shape[1], width), np.int64)
    head = np.zeros(raw.shape[1], bool)
    head[:1] = True
    for k in range(width):
        first = np.flatnonzero(head)
        total = np.cumsum(raw[k])
        base = total[first] - raw[k][first]
        words[:, k] = total - np.repeat(base, np.diff(np.append(first, len(head))))
        head[1:] |= words[1:, k] != words[:-1, k]
    return words, raw[width] | raw[width + 1] << 32


def _messages(words: np.ndarray, times: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    order, edge = _dealt(words, buckets)
    held = np.flatnonzero(np.diff(edge))
    return held.tolist(), _packed(words[order], times[order], np.append(edge[held], len(words)))


def _numbered(shard: pa.Table, answers: pa.Table) -> np.ndarray:
    """The shard's line by the words' numbers, 0 for those that aren't frequent."""
    found = sorted(zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist()))
    return np.concatenate([np.zeros(1, np.int64), *(unsqueeze(b) for _, b in found)])[unsqueeze(shard.column("line")[0].as_py())]


def _paired(buckets: int):
    """The shard's pairs by bucket."""

    def pair(_key, shard: pa.Table, answers: pa.Table) -> pa.Table:
        held, packed = _messages(*pairs(_numbered(shard, answers)), buckets)
        return pa.table({"bucket": pa.array(held, pa.int32()), "shard": pa.array([shard.column("shard")[0].as_py()] * len(held), pa.int64()), "packed": pa.array(packed, pa.binary())})

    return pair


def _extended(buckets: int, longest: int):
    """The shard's phrases of 3 words and more by bucket."""

    def extend(_key, shard: pa.Table, answers: pa.Table) -> pa.Table:
        line = _numbered(shard, answers.filter(pc.invert(answers.column("pairs"))))
        words, _ = pairs(line)
        order, edge = _dealt(words, buckets)
        bits = answers.filter(answers.column("pairs"))
        frequent = [np.zeros(0, np.int64)]
        for k, b in zip(bits.column("bucket").to_pylist(), bits.column("packed").to_pylist()):
            own = words[order[edge[k] : edge[k + 1]]][np.unpackbits(np.frombuffer(b, np.uint8), count=edge[k + 1] - edge[k]).astype(bool)]
            frequent.append(own[:, 0] << 32 | own[:, 1])
        out_bucket, out, back = [], [], {}

        def send() -> None:
            # Of phrases of one length, those of later ranges are behind the others in order.
            for parts in back.values():
                held, packed = _messages(*(np.concatenate(x) for x in zip(*parts)), buckets)
                out_bucket.extend(held)
                out.extend(packed)
            back.clear()

        size = 0
        for w, times in longer_phrases(line, np.sort(np.concatenate(frequent)), longest):
            back.setdefault(w.shape[1], []).append((w, times))
            size += len(w)
            if size >= HELD_BACK:
                send()
                size = 0
        send()
        return pa.table({"bucket": pa.array(out_bucket, pa.int32()), "packed": pa.array(out, pa.binary())})

    return extend


class Added:
    """Distinct keys and their counts in all, as they come in.

    What comes waits until it is as much as is there, so that each count is
    added to ever larger sums a few times, however many lists come.
    """

    def __init__(self, none: pa.Array):
        self.keys, self.times, self.waiting, self.size = none, np.zeros(0, np.int64), [], 0

    def add(self, keys: pa.Array, times: np.ndarray) -> None:
        self.waiting.append((keys, times))
        self.size += len(keys)
        if self.size >= max(WAITING, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            coded = pa.concat_arrays([self.keys, *(k for k, _ in self.waiting)]).dictionary_encode()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, coded.indices.to_numpy(), np.concatenate([self.times, *(t for _, t in self.waiting)]))
            self.keys, self.times, self.waiting, self.size = coded.dictionary, total, [], 0


def _as_keys(words: np.ndarray, width: int) -> pa.Array:
    """Phrases as strings of width 32-bit numbers."""
    flat = np.zeros((len(words), width), "<u4")
    flat[:, : words.shape[1]] = words
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(words), [None, pa.py_buffer(flat)])


class Sums(Gathered):
    """Of (bucket, packed) rows: (ids, a) of the phrases of up to width words that occur least times."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def total(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """The frequent phrases of a bucket, from rows whose last value packs some."""
        found = Added(_as_keys(np.zeros((0, self.width)), self.width))
        for row in rows:
            words, times = _unpacked(row[-1])
            found.add(_as_keys(words, self.width), times)
        found.settle()
        often = np.flatnonzero(found.times >= self.least)
        words = np.frombuffer(b"".join(found.keys.take(pa.array(often)).to_pylist()), "<u4").reshape(-1, self.width).astype(np.int64)
        order = np.lexsort(words.T[::-1])
        return words[order], found.times[often][order]

    def solved(self, bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        words, times = self.total(rows)
        size = (words > 0).sum(axis=1)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(words[words > 0], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(times, pa.int64())], names=["ids", "a"])


class Pairs(Sums):
    """Of (bucket, shard, packed) rows: (home, bucket, packed) that say which of the shard's pairs are frequent; without a home, the frequent pairs."""

    def __init__(self, least: int):
        super().__init__(2, least)

    def solved(self, bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        words, times = self.total(rows)
        known = words[:, 0] << 32 | words[:, 1]
        out = [(None, _packed(words, times)[0])]
        for home, packed in rows:
            own, _ = _unpacked(packed)
            code = own[:, 0] << 32 | own[:, 1]
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            out.append((home, np.packbits(known[at] == code if len(known) else np.zeros(len(code), bool)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["home", "bucket", "packed"])


class Phrases:
    """(ids, a) of the pairs in (bucket, packed) rows."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(1):
                words, times = _unpacked(packed.as_py())
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(words) + 1, 2), pa.int32()), pa.array(words.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(times, pa.int64())], names=["ids", "a"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases that occur least times in a language, as (ids, a); the words, as (id, lang, word, n); all occurrences, as (lang, n)."""
    if not 2 <= longest:
        raise ValueError("phrases have two words at least")
    spark = docs.sparkSession
    bounded(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    buckets = max(width, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    packed = "array<struct<bucket:int,packed:binary>>"
    shards = written(rows.mapInArrow(Shards(buckets), f"shard bigint, lang string, n bigint, line binary, words {packed}"), "phrase-shards")
    langs = written(shards.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    dealt = lambda df: df.repartition(width, "bucket").sortWithinPartitions("bucket")
    held = shards.select("shard", "lang", F.explode("words").alias("w")).select("w.bucket", "shard", "lang", "w.packed")
    found = written(dealt(held).mapInArrow(Words(buckets, least), "home bigint, bucket int, packed binary, words array<struct<id:bigint,lang:string,word:string,n:bigint>>"), "phrase-words")
    words = found.where("home IS NULL").select(F.explode("words").alias("w")).select("w.id", "w.lang", "w.word", "w.n")
    numbers, lines = found.where("home IS NOT NULL").select("home", "bucket", "packed"), shards.select("shard", "line").groupBy("shard")
    both = lines.cogroup(numbers.groupBy("home")).applyInArrow(_paired(buckets), "bucket int, shard bigint, packed binary")
    two = written(dealt(both).mapInArrow(Pairs(least), "home bigint, bucket int, packed binary"), "phrase-pairs")
    phrases = two.where("home IS NULL").select("bucket", "packed").mapInArrow(Phrases(), "ids array<bigint>, a bigint")
    if longest > 2:
        answers = numbers.withColumn("pairs", F.lit(False)).union(two.where("home IS NOT NULL").withColumn("pairs", F.lit(True)))
        more = lines.cogroup(answers.groupBy("home")).applyInArrow(_extended(buckets, longest), "bucket int, packed binary")
        phrases = phrases.union(dealt(more).mapInArrow(Sums(longest, least), "ids array<bigint>, a bigint"))
    return written(phrases, "phrases"), words, langs


def _cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to longest words that occur least times and that no longer one accounts for.

    A cut of a phrase in two parts has score floor(1000 * a * n / (l * r)), a, l
    and r being the occurrences of the phrase and its parts and n those of all
    words of the language; the lowest cut counts, the first of several. A phrase
    whose words lie inside a longer one of as many occurrences is left out.

    Null languages are und; null and empty texts have no words; texts of any
    length are taken whole; repeated rows count each; other columns are not
    looked at; an empty table gives no row.
    """
    phrases, words, langs = frequent_phrases(docs, least, longest, lang_col, text_col)
    size = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    inside = phrases.where(size > 2).select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    named = kept.select("ids", "a", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id").groupBy("ids", "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    named = named.select("ids", "a", "lang", F.array_join(F.col("w.word"), " ").alias("phrase")).join(langs, "lang")
    part = phrases.union(words.select(F.array("id"), "n"))
    cuts = named.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(part.toDF("head", "l"), "head").join(part.toDF("tail", "r"), "tail")
    least_cut = F.min(F.struct(_cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language by score, occurrences and phrase, with their rank.

    The first of each of several groups of a language are found before they are
    ranked, so that no task has all phrases of a language.
    """
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    groups = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = Window.partitionBy("lang", "group").orderBy(*order)
    first = found.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("group")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of documents.

    Null languages are und; null and empty texts have no words; texts of any
    length are taken whole; repeated rows count each; columns beside lang and
    text aren't looked at; an empty table gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ranked(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents WHERE text IS NOT NULL)),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT * FROM f WHERE m >= 2),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.m > c.m AND d.a >= c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, n.n, c.k, l.a AS l, r.a AS r, (1000 * c.a * n.n) // (l.a * r.a) AS score
  FROM cuts c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
""",
}
