"""Benchmark decontamination by suffix arrays of the training text.

Each run of documents is a shard: its words become codes, and a suffix array
over the codes is sorted by prefix doubling that goes on only where suffixes
are still tied. Every suffix of the benchmark is looked for in every shard by
binary search; an interval that still matches after a window is a verbatim
occurrence. How far matches go on is found by halving, over the ranks of ever
longer stretches of the words that were hit and of the items that hit them; the
longest match of a document begins at a suffix whose nearest test suffix, in the
order of all of these, has most in common with it.
Shards are never gathered: the benchmark goes to the documents, in chunks of
bounded size that tasks read from the shared folder one after another. A
shard's array is built once and serves all chunks. Digests order the words;
whether two words are the same is decided by their bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, scratch_path
from .textstore import StoreReader, StoreWriter

WINDOW = 10
#: Bytes of benchmark text in a chunk, bytes of documents that a chunk is read for if there are several, words of a shard,
#: and pairs of places followed at once.
CHUNK_BYTES, RUN_BYTES, SHARD_WORDS, AT_ONCE = 4 << 20, 4 << 20, 1 << 18, 1 << 20


class Words:
    """The words of some texts, A-Z lower-cased: digests, numbers and what they stand for, and each text's bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = K.LOWER[data]
        starts, ends, self.bounds = K.segments(K.ALNUM[low], offsets)
        self.code, self.distinct = K.codes(low, starts, ends)
        self.digest = K.digests(self.distinct)[self.code] if len(starts) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.code)

    def within(self, distinct: pa.Array) -> np.ndarray:
        """Each word's number among these distinct ones, -1 if it isn't among them."""
        if not len(self) or not len(distinct):
            return np.full(len(self), -1, np.int64)
        return pc.fill_null(pc.index_in(self.distinct, value_set=distinct), -1).to_numpy().astype(np.int64)[self.code]


def codes(words: np.ndarray) -> np.ndarray:
    """32-bit codes that order the words; 0 stands for the end of the shard."""
    return np.maximum(words >> np.uint64(32), np.uint64(1))


def suffix_array(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the first two codes of each in that order."""
    n = len(code)
    pair = code << np.uint64(32)
    pair[:-1] |= code[1:]
    order = np.argsort(pair)
    head = pair[order]
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    rank = np.zeros(n + 1, np.int64)  # the slot at which a suffix's group begins, from 1; 0: past the end
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = slot + 1
    step = 2
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots) or step >= n:
            return order, head
        own = order[slots]
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + step, n)].astype(np.uint64)
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[slots] = own
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        rank[own] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
        step *= 2


class Tests:
    """The words of some test items and the windows of them that are looked for."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        self.ids, self.window = ids, window
        own = Words(*K.column_bytes(pa.array(texts, pa.large_string())))
        self.words, self.code, self.distinct, self.bounds = own.digest, own.code, own.distinct, own.bounds
        item, size = K.owner(self.bounds), np.diff(self.bounds)
        left = self.bounds[1:][item] - np.arange(len(own))
        depth = np.minimum(window, size[item])
        at = np.flatnonzero((left >= depth) & (depth > 0))
        # Windows of equal words are looked for once.
        d = depth[at]
        same = d
        for k in range(window):
            same = K.ranks(K.combine((same, len(same) + window + 1), (np.where(d > k, own.code[np.minimum(at + k, len(own) - 1)] + 1, 0) if len(own) else at, len(own.distinct) + 1))[0])[0]
        _, first, self.same = np.unique(same, return_index=True, return_inverse=True)
        self.at, self.depth = at[first], d[first]
        order = np.argsort(self.same, kind="stable")
        self.places, self.items = at[order], item[at][order]
        self.items_from = np.searchsorted(self.same[order], np.arange(len(first) + 1))
        self.left, self.item = left, item


def _narrow(code: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of intervals whose suffixes agree on k codes, the parts whose next code is the wanted one."""

    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = order[np.minimum(mid, len(order) - 1)] + k
            value = np.where(at < len(code), code[np.minimum(at, len(code) - 1)], 0)
            go = open_ & ((value <= want) if right else (value < want))
            a = np.where(go, mid + 1, a)
            b = np.where(open_ & ~go, mid, b)
        return a

    return bound(False), bound(True)


class Shards:
    """Suffix arrays of a run's words, each of SHARD_WORDS at most and a window more, so that none is lost between them."""

    def __init__(self, words: Words, window: int):
        self.words, self.window, self.parts = words, window, []
        code = codes(words.digest)
        for a in range(0, len(code), SHARD_WORDS):
            part = code[a : a + SHARD_WORDS + window - 1]
            self.parts.append((a, part, *suffix_array(part)))
        self.end = np.repeat(words.bounds[1:], np.diff(words.bounds))

    def occurrences(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place) pairs of every verbatim occurrence of the windows within a document; and the words' numbers in the tests."""
        same = self.words.within(tests.distinct)
        found = [np.zeros((2, 0), np.int64)]
        if len(tests.at):
            found += [self._search(*part, tests, same) for part in self.parts]
        window, place = np.concatenate(found, axis=1)
        if len(self.parts) > 1:
            window, place = np.unique(np.stack([window, place]), axis=1)
        return window, place, same

    def _search(self, a: int, code: np.ndarray, order: np.ndarray, head: np.ndarray, tests: Tests, same: np.ndarray) -> np.ndarray:
        want = codes(tests.words)
        first = want[tests.at] << np.uint64(32)
        second = np.where(tests.depth > 1, want[np.minimum(tests.at + 1, len(want) - 1)], 0)
        lo = np.searchsorted(head, first | second, "left")
        hi = np.searchsorted(head, first | np.where(tests.depth > 1, second, np.uint64(0xFFFFFFFF)), "right")
        live = np.flatnonzero(hi > lo)
        lo, hi = lo[live], hi[live]
        for k in range(2, tests.window):
            deep = np.flatnonzero(tests.depth[live] > k)
            if not len(deep):
                break
            lo[deep], hi[deep] = _narrow(code, order, lo[deep], hi[deep], k, want[tests.at[live[deep]] + k])
            alive = hi > lo
            live, lo, hi = live[alive], lo[alive], hi[alive]
        size = hi - lo
        window = np.repeat(live, size)
        place = order[np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)] + a
        fits = place + tests.depth[window] <= self.end[place]
        window, place = window[fits], place[fits]
        for k in range(tests.window):  # codes only order; the words must be equal
            deep = tests.depth[window] > k
            fits = ~deep
            fits[deep] = same[place[deep] + k] == tests.code[tests.at[window[deep]] + k]
            window, place = window[fits], place[fits]
        return np.stack([window, place])


class Common:
    """How far two places of a row of numbers go on alike.

    Each level ranks the stretches of twice the length of the one below, until
    no two are the same; the last one is the order of the suffixes.
    """

    def __init__(self, code: np.ndarray):
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
        self.levels, step = [], 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if not len(rank) or int(rank.max()) + 1 == len(rank):
                return
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The numbers that follow alike from each i and j: by halving, from the longest stretch down."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x, y = self.levels[k], i + n, j + n
            within = np.flatnonzero((x < len(level)) & (y < len(level)))
            n[within[level[x[within]] == level[y[within]]]] += 1 << k
        return n


class Hits:
    """The words of some documents that windows hit, and the test items with these windows, on one row that nothing crosses.

    same: the document words' numbers in the tests. A match of a window or more
    lies in hit words, all of it.
    """

    def __init__(self, same: np.ndarray, bounds: np.ndarray, tests: Tests, window: np.ndarray, place: np.ndarray):
        self.same, self.bounds, self.tests = same, bounds, tests
        self.window, self.place = window, place
        mark = np.zeros(len(same) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + tests.depth[window], -1)
        self.doc_at, doc_row, n = self._laid(np.cumsum(mark[:-1]) > 0, bounds, 0)
        item = np.zeros(len(tests.bounds) - 1, bool)
        used = np.unique(window)
        size = tests.items_from[used + 1] - tests.items_from[used]
        item[tests.items[np.arange(int(size.sum())) + np.repeat(tests.items_from[used] - (np.cumsum(size) - size), size)]] = True
        self.test_at, test_row, n = self._laid(item[tests.item], tests.bounds, n)
        code = np.arange(n) + len(tests.distinct)  # what is between has a number of its own
        code[self.doc_at[doc_row]], code[self.test_at[test_row]] = same[doc_row], tests.code[test_row]
        self.doc_row, self.test_row, self.common = doc_row, test_row, Common(code)

    @staticmethod
    def _laid(inside: np.ndarray, bounds: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Each word's place on the row, -1 for those left out; the words on it; the row's end. A gap is behind each run of words."""
        starts, ends, _ = K.segments(inside, bounds)
        size = ends - starts
        at = np.full(len(inside), -1, np.int64)
        words = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
        at[words] = first + np.arange(len(words)) + np.repeat(np.arange(len(size)), size)
        return at, words, first + len(words) + len(size)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, length, place and item of the longest match of each document with hits; of equal ones the first place.

        In the order of all suffixes, the test suffix that a document's suffix
        has most in common with is the one before or after it.
        """
        tests, levels = self.tests, self.common.levels
        long = self.test_row[np.diff(tests.bounds)[tests.item[self.test_row]] >= tests.window]
        depth = tests.depth[self.window]
        short = depth < tests.window
        found = [(self.place[short], depth[short], tests.items[tests.items_from[self.window[short]]])]
        if len(long):
            rank = levels[-1]
            word = np.full(len(rank), -1, np.int64)
            word[rank[self.test_at[long]]] = long
            slot = rank[self.doc_at[self.doc_row]]
            filled = np.where(word >= 0, np.arange(len(word)), -1)
            before = np.maximum.accumulate(filled)[slot]
            filled = np.where(word >= 0, np.arange(len(word)), len(word))
            after = np.minimum.accumulate(filled[::-1])[::-1][slot]
            for near, there in ((before, before >= 0), (after, after < len(word))):
                p, t = self.doc_row[there], word[near[there]]
                n = self.common.extension(self.doc_at[p], self.test_at[t])
                fits = n >= tests.window
                found.append((p[fits], n[fits], tests.item[t[fits]]))
        p, n, item = (np.concatenate([x[k] for x in found]) for k in range(3))
        order = np.lexsort((item, p, -n))
        doc, first = np.unique(np.searchsorted(self.bounds, p[order], "right") - 1, return_index=True)
        order = order[first]
        return doc, n[order], p[order], item[order]

    def longest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Test word, document word and length of each match that can't begin earlier, as long as it goes on; about AT_ONCE at a time.

        Only pairs with different words before them are made: a window's places
        are sorted by the word before, and of those a test word takes all but
        the ones with its own.
        """
        tests, doc = self.tests, K.owner(self.bounds)
        before = np.where(self.place > 0, self.same[np.maximum(self.place, 1) - 1], -1)
        before[before < 0] = -1
        before[(self.place == 0) | (doc[np.maximum(self.place, 1) - 1] != doc[self.place])] = -2
        key = self.window * (len(tests.distinct) + 3) + before + 2
        order = np.argsort(key, kind="stable")
        key, place = key[order], self.place[order]
        used = np.unique(self.window)
        size = tests.items_from[used + 1] - tests.items_from[used]
        t = tests.places[np.arange(int(size.sum())) + np.repeat(tests.items_from[used] - (np.cumsum(size) - size), size)]
        w = np.repeat(used, size)
        inner = (t > 0) & (tests.item[np.maximum(t, 1) - 1] == tests.item[t])
        wide = len(tests.distinct) + 3
        own = np.where(inner, w * wide + tests.code[np.maximum(t, 1) - 1] + 2, -1)
        a, b = np.searchsorted(key, w * wide), np.searchsorted(key, (w + 1) * wide)
        x, y = np.where(inner, np.searchsorted(key, own, "left"), b), np.where(inner, np.searchsorted(key, own, "right"), b)
        t, lo, hi = np.concatenate([t, t]), np.concatenate([a, y]), np.concatenate([x, b])
        t, lo, n = t[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        at = np.append(0, np.cumsum(n))
        for d, e in K.runs(at, AT_ONCE):
            tt, p = np.repeat(t[d:e], n[d:e]), place[np.arange(int(at[e] - at[d])) + np.repeat(lo[d:e] - (at[d:e] - at[d]), n[d:e])]
            yield tt, p, self.common.extension(self.doc_at[p], self.test_at[tt])


class Benchmark:
    """Chunks of test items in the shared folder; the last one read is kept."""

    def __init__(self, folder: str, places: list[str], window: int):
        self.folder, self.places, self.window, self.last = folder, places, window, (None, None)

    def __getstate__(self):
        return self.__dict__ | {"last": (None, None)}

    def chunks(self) -> Iterator[Tests]:
        for place in self.places:
            if self.last[0] != place:
                store = StoreReader(self.folder)
                self.last = place, Tests(*json.loads(store.get(place)), self.window)
                store.close()
            yield self.last[1]

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, Words, Shards]]:
        """(first and last document, words, shards) of a column's texts, a run at a time."""
        data, offsets = K.column_bytes(column)
        for d, e in K.runs(offsets, RUN_BYTES if len(self.places) > 1 else 0):
            words = Words(data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d])
            yield d, e, words, Shards(words, self.window)


class Matches:
    """Rows of the longest matches in each document."""

    def __init__(self, tests: Benchmark):
        self.tests = tests

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, e, words, shards in self.tests.runs(batch.column(1)):
                bounds = words.bounds
                for tests in self.tests.chunks():
                    window, place, same = shards.occurrences(tests)
                    for t, p, n in Hits(same, bounds, tests, window, place).longest() if len(window) else ():
                        doc = np.searchsorted(bounds, p, "right") - 1
                        item = tests.item[t]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(d, e - d).take(pa.array(doc, pa.int64())), pa.array(tests.ids, pa.string()).take(pa.array(item, pa.int64())), *(pa.array(x, pa.int64()) for x in (p - bounds[doc], t - tests.bounds[item], n))],
                            names=["id", "test_id", "word", "test_word", "length"],
                        )
        K.tidy()


_FOUND = "n_words bigint, n_hit bigint, hits binary, items array<string>, items_sha256 string, longest bigint, longest_at bigint, longest_item string"


class Search:
    """What the benchmark finds in (id, text) rows."""

    def __init__(self, tests: Benchmark):
        self.tests = tests

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, e, words, shards in self.tests.runs(batch.column(1)):
                bounds = words.bounds
                mark = np.zeros(len(words) + 1, np.int64)
                found: dict[int, set] = {}
                best = [(0, None, None)] * (e - d)  # length, place and item of the longest match; the first of equal ones
                for tests in self.tests.chunks():
                    window, place, same = shards.occurrences(tests)
                    if not len(window):
                        continue
                    np.add.at(mark, place, 1)
                    np.add.at(mark, place + tests.depth[window], -1)
                    doc = np.searchsorted(bounds, place, "right") - 1
                    for k, g in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                        found.setdefault(k, set()).update(tests.ids[i] for i in tests.items[tests.items_from[g] : tests.items_from[g + 1]].tolist())
                    for k, n, p, item in zip(*(x.tolist() for x in Hits(same, bounds, tests, window, place).best())):
                        at = p - int(bounds[k])
                        if n > best[k][0] or n == best[k][0] and at < best[k][1]:
                            best[k] = n, at, tests.ids[item]
                hit = np.cumsum(mark[:-1]) > 0
                items = [sorted(i for i in found.get(k, ()) if i is not None) for k in range(e - d)]
                starts, ends, at = K.segments(hit, bounds)
                doc_of = K.owner(at)
                spans = np.stack([starts - bounds[doc_of], ends - bounds[doc_of]], axis=1)
                columns = {
                    "id": batch.column(0).slice(d, e - d), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_hit": pa.array(K.sum_by(bounds, hit), pa.int64()),
                    "hits": pa.array([spans[at[k] : at[k + 1]].tobytes() or None for k in range(e - d)], pa.binary()), "items": pa.array(items, pa.list_(pa.string())),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    **{name: pa.array([x[k] for x in best], kind) for k, (name, kind) in enumerate((("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())))},
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            K.tidy()


class Dropper:
    """Lets through the rows whose text, in the first column, the benchmark doesn't hit."""

    def __init__(self, tests: Benchmark):
        self.tests = tests

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for d, _, words, shards in self.tests.runs(batch.column(0)):
                for tests in self.tests.chunks():
                    _, place, _ = shards.occurrences(tests)
                    clean[d + np.searchsorted(words.bounds, place, "right") - 1] = False
            yield batch.filter(pa.array(clean))
            K.tidy()


def benchmark(tests: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Benchmark:
    """The test items, written to the shared folder in chunks, of which the driver holds one at a time."""
    spark = tests.sparkSession
    bounded(spark)
    folder = scratch_path(spark, "tests")
    store, places, ids, texts, size = StoreWriter(folder), [], [], [], 0
    for r in tests.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if size >= chunk_bytes:
            places.append(store.add(json.dumps([ids, texts]).encode()))
            ids, texts, size = [], [], 0
    if ids:
        places.append(store.add(json.dumps([ids, texts]).encode()))
    store.close()
    return Benchmark(folder, places, window)


def find_contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", test_id_col: str = "item_id", test_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, hits, items, items_sha256, longest, longest_at, longest_item) of each row of docs.

    hits: runs of hit words as pairs of 64-bit word numbers; items: the ids, as
    sorted strings, of the test items with windows in the document; longest:
    the words of its longest verbatim match of a window or more, where that
    begins, and the item. Null and empty texts have no words, and a test item
    without words no window; items without an id hit but aren't listed;
    repeated ids of items count once and repeated documents keep a row each;
    texts of any length are searched whole; other columns aren't looked at.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = out.mapInArrow(Search(benchmark(tests, window, test_id_col, test_text_col, chunk_bytes)), f"id {dict(out.dtypes)['id']}, {_FOUND}")
    return found.withColumnRenamed("id", id_col)


def find_matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", test_id_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """(id, test_id, word, test_word, length) of each longest verbatim match of a window or more: where it begins in both, and its words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, test_id string, word bigint, test_word bigint, length bigint"
    return rows.mapInArrow(Matches(benchmark(tests, window, test_id_col, test_text_col)), schema).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, text_col: str = "text", test_id_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of a test item.

    Null and empty texts stay, as do rows when there are no tests; repeated
    rows stay or go each.
    """
    columns = [text_col, *(c for c in docs.columns if c != text_col)]
    out = docs.select(*columns)
    schema = ", ".join(f"`{c}` {k}" for c, k in out.dtypes)
    return out.mapInArrow(Dropper(benchmark(tests, window, test_id_col, test_text_col)), schema).select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, in windows of ten words.

    longest and longest_at: the words of the longest verbatim match and the
    first word where one begins, from 0; 0 and -1 if there is none.
    Null and empty texts have no words; texts of any length are searched whole;
    repeated rows keep a row each; an empty benchmark hits nothing and empty
    documents give no row; columns beside ids and texts aren't looked at.
    """
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest", F.coalesce("longest_at", F.lit(-1)).alias("longest_at"))


ORACLE = {
    "op5_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS br, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT br, item_id, i AS j, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT br, item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, br, j, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
matches AS (SELECT r, count(*) + min(n) - 1 AS words, min(i) - 1 AS begins FROM (SELECT *, i - row_number() OVER (PARTITION BY r, br, i - j ORDER BY i) AS run FROM hit) GROUP BY r, br, i - j, run),
best AS (SELECT r, max(words) AS longest, min(begins) FILTER (words = most) AS longest_at FROM (SELECT *, max(words) OVER (PARTITION BY r) AS most FROM matches) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""
}
