"""MinHash near-dedup by an LSH forest.

Documents with one and the same set of shingles become one node. Each tree of
the forest sorts the nodes by its own sequence of min-hashes; the candidates of
a node are its neighbour in that order and the first node of the run with the
longest common prefix around it, so that the depth follows how crowded the
region is, and each node has two candidates a tree however large its group.
Candidates are confirmed on the full sets. The first trees join most of every
group; the others then look only at nodes that aren't joined yet.

The forest leaves links out, so an exact join settles the rest. Shingles have
one order, the rare ones first. Two linked sets share one of the first
shingles of both, and their first shared one stands so early that enough are
left behind it. All nodes of different components that meet so are candidates.

Shingles of one document are told apart by their bytes, and a link counts only
if the words themselves confirm it. Sets are taken as the same by a 128-bit
BLAKE2b digest of their shingles' hashes, which rest on 64-bit digests of words.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .components import connected_components
from .shared import bounded, scratch_path, written
from .textstore import StoreReader, StoreWriter

TREES, FIRST_TREES, DEPTH, MIN_DEPTH = 16, 2, 6, 3
#: Bits of a set's parities, and of the table that counts shingles, and the slices that it is added up in.
PARITIES, COUNTED_BITS, SLICES = 2048, 22, 64
#: Rows of the exact join looked at together, those of a shingle compared row by row, and pairs compared at once.
MEET, SMALL, AT_ONCE = 500_000, 32, 2_000_000
_rng = np.random.default_rng(0xF0E57)
_FLIP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SIGNED = "uid bigint, doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, parities binary, place string"


def _low_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words' codes, what they stand for, and each document's bounds; A-Z lower-cased."""
    low = K.LOWER[data]
    starts, ends, bounds = K.segments(K.NOT_SPACE[low], offsets)
    return *K.codes(low, starts, ends), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct n-word shingles of each document, sorted, and their bounds; a document of fewer words has them as one.

    Shingles are distinct if their words' bytes are; the hashes say which are
    the same in other documents.
    """
    code, distinct, bounds = _low_words(data, offsets)
    words, size = K.digests(distinct)[code] if len(code) else np.zeros(0, np.uint64), np.diff(bounds)
    grams, sets = K.gram_hash(words, n), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            sets.append(_distinct(grams[a : b - n + 1], code[a:b], n))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = K.mix(one * np.uint64(K.BASE) + words[k])
            sets.append(K.mix(one + np.uint64(b - a)))
        else:
            sets.append(words[:0])
    return np.concatenate([words[:0], *sets]), np.append(0, np.cumsum([len(x) for x in sets], dtype=np.int64))


def _distinct(grams: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the distinct shingles of one document, sorted; code: its words."""
    order = np.argsort(grams, kind="stable")
    h = grams[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    again = np.flatnonzero(~new)
    # Where hashes say that a shingle comes again, its words must agree.
    if len(again) and any((code[order[again] + k] != code[order[again - 1] + k]).any() for k in range(n)):
        h = grams[np.unique(K.shingles(code, int(code.max()) + 1, n)[0], return_index=True)[1]]
        return np.sort(h)
    return h[new]


def linked(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """Whether two texts are linked, by their words themselves."""
    code, distinct, bounds = _low_words(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
    k = bounds[1]
    if k < n or len(code) - k < n:
        return k == len(code) - k and k > 0 and bool((code[:k] == code[k:]).all())
    same = K.shingles(code, len(distinct), n)[0]
    x, y = np.unique(same[: k - n + 1]), np.unique(same[k:])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each set that isn't empty, TREES * DEPTH min-hashes."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(full), TREES * DEPTH), np.uint32)
    if len(full):
        x, at = (sets >> np.uint64(32)).astype(np.uint32), bounds[full]
        for k in range(TREES * DEPTH):
            out[:, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _ODD[k], at)
    return out


def parities(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each set that isn't empty, whether an odd number of its shingles has each of PARITIES hashes, packed.

    Two sets have at least as many different shingles as parities.
    """
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    ends, out = np.append(0, np.cumsum(size[full])), np.zeros((len(full), PARITIES // 8), np.uint8)
    for d in range(0, len(full), 512):
        e = min(d + 512, len(full))
        at = np.repeat(np.arange(e - d), size[full[d:e]]) * PARITIES + (sets[ends[d] : ends[e]] % np.uint64(PARITIES)).astype(np.int64)
        out[d:e] = np.packbits((np.bincount(at, minlength=(e - d) * PARITIES) & 1).astype(np.uint8).reshape(-1, PARITIES), axis=1)
    return out


class Signer:
    def __init__(self, n: int, folder: str, all_texts: bool):
        self.n, self.folder, self.all_texts = n, folder, all_texts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store = TaskContext.get(), None
        uid = (context.partitionId() if context else 0) << 36
        for batch in batches:
            store = store or StoreWriter(self.folder)
            data, offsets = K.column_bytes(batch.column(1))
            data = np.ascontiguousarray(data)
            for d, e in K.runs(offsets):
                off = offsets[d : e + 1] - offsets[d]
                part = data[offsets[d] : offsets[e]]
                sets, bounds = shingle_sets(part, off, self.n)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                mark = np.zeros((e - d, 2), np.int64)
                for k in full.tolist():
                    mark[k] = np.frombuffer(blake2b(sets[bounds[k] : bounds[k + 1]].tobytes(), digest_size=16).digest(), np.int64)
                signs = signatures(sets, bounds).astype(">u4")
                signed, odd, places, view = [None] * (e - d), [None] * (e - d), [None] * (e - d), memoryview(part)
                for k, row, bits in zip(full.tolist(), signs, parities(sets, bounds)):
                    signed[k], odd[k] = row.tobytes(), bits.tobytes()
                    places[k] = store.add(view[off[k] : off[k + 1]])
                if self.all_texts:
                    for k in np.flatnonzero(size == 0).tolist():
                        places[k] = store.add(view[off[k] : off[k + 1]]) if batch.column(1)[d + k].is_valid else None
                rest = [batch.column(k).slice(d, e - d) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(e - d)), batch.column(0).slice(d, e - d), pa.array(size), *map(pa.array, np.ascontiguousarray(mark.T)), pa.array(signed, pa.binary()), pa.array(odd, pa.binary()), pa.array(places, pa.string()), *rest],
                    names=["uid", "doc_id", "n_shingles", "set_a", "set_b", "signature", "parities", "place", *batch.schema.names[2:]],
                )
                uid += e - d
            K.tidy()
        if store:
            store.close()


def _prefixes(column: pa.Array) -> np.ndarray:
    """A binary column of one width as a table of min-hashes."""
    raw, n = column.buffers()[2], len(column)
    return np.frombuffer(raw, ">u4", n * DEPTH, 4 * DEPTH * column.offset).reshape(n, DEPTH) if n else np.zeros((0, DEPTH), ">u4")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one task's rows (tree, prefix, node, component), sorted; and its first and last row, as edges.

    Of the batches before, only the last row and the first one of the run at
    each depth are kept.
    """
    depths = range(MIN_DEPTH, DEPTH + 1)
    names = ["a", "b", "tree", "prefix", "last", "task"]
    task = TaskContext.get().partitionId()

    def edge(tree, prefix, node, component, last):
        return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([component]), pa.array([tree], pa.int32()), pa.array([prefix.tobytes()], pa.binary()), pa.array([last], pa.int32()), pa.array([task], pa.int32())], names=names)

    held = None  # the first row of the run at each depth, and the last row
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree, node, component = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("tree", "node", "component"))
        prefix = _prefixes(batch.column(batch.schema.get_field_index("prefix")))
        if held is None:
            yield edge(tree[0], prefix[0], node[0], component[0], 0)
        else:
            tree, prefix, node, component = (np.concatenate(x) for x in zip(held, (tree, prefix, node, component)))
        k = len(tree) - n  # rows from before
        at = np.arange(len(tree))
        common = np.zeros(len(tree), np.int64)
        common[1:] = np.logical_and.accumulate((prefix[1:] == prefix[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
        new = at[max(k, 1) :]
        found = [np.stack([new, new - 1])[:, common[new] >= MIN_DEPTH]]
        firsts = []
        deepest = np.arange(len(tree))[k:]  # the first row of the deepest run that a row is in behind another
        for j, depth in enumerate(depths):
            begins = np.where((common < depth) & (at >= k), at, -1)
            if k:
                begins[k - 1] = j  # a run that goes on from the batch before
            else:
                begins[0] = 0
            first = np.maximum.accumulate(begins[max(k - 1, 0) :])[-n:]
            deepest = np.where(first < at[k:], first, deepest)
            firsts.append(first[-1])
        found.append(np.stack([at[k:], deepest])[:, deepest < at[k:]])
        i, j = np.unique(np.concatenate(found, axis=1), axis=1)
        keep = component[i] != component[j]
        a, b = node[i[keep]], node[j[keep]]
        m = len(a)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array(np.full(m, task, np.int32))], names=names)
        kept = [*firsts, len(tree) - 1]
        held = tree[kept], prefix[kept], node[kept], component[kept]
    if held is not None:
        yield edge(*(x[-1] for x in held), 1)


def _candidates(nodes: DataFrame, trees: range, tasks: int) -> DataFrame:
    """(a, b) pairs of candidates from nodes (node, signature, component)."""
    spark = nodes.sparkSession
    width = 4 * DEPTH
    rows = nodes.select(F.explode(F.array(*map(F.lit, trees))).alias("tree"), "signature", "node", "component")
    rows = rows.select("tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("prefix"), "node", "component")
    rows = rows.repartitionByRange(tasks, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = written(rows.mapInArrow(_neighbours, "a bigint, b bigint, tree int, prefix binary, last int, task int"), "candidates")
    # Two rows a task: where a run goes on from one task to the next, its neighbours there meet.
    edges = sorted(found.where(F.col("last").isNotNull()).collect(), key=lambda r: (r.task, r.last))
    over = []
    for x, y in zip(edges[1::2], edges[2::2]):
        if x.tree == y.tree and x.prefix[: 4 * MIN_DEPTH] == y.prefix[: 4 * MIN_DEPTH] and x.b != y.b:
            over.append((x.a, y.a))
    pairs = found.where(F.col("last").isNull()).select("a", "b")
    return pairs.union(spark.createDataFrame(over, "a bigint, b bigint")) if over else pairs


def _read_sets(store: StoreReader, places: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, sets, bounds) of some texts at a time."""
    texts, first, held = [], 0, 0
    for k, place in enumerate(places):
        texts.append(store.get(place))
        held += len(texts[-1])
        if held > 1 << 22 or k == len(places) - 1:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            yield first, k + 1, *shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, n)
            texts, first, held = [], k + 1, 0


class Counter:
    """How many of the texts at (place) have shingles of each bucket, by slices of the buckets."""

    def __init__(self, n: int, folder: str):
        self.n, self.folder = n, folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts = StoreReader(self.folder), np.zeros(1 << COUNTED_BITS, np.int64)
        for batch in batches:
            for *_, sets, _ in _read_sets(store, batch.column(0).to_pylist(), self.n):
                counts += np.bincount((sets >> np.uint64(64 - COUNTED_BITS)).astype(np.int64), minlength=len(counts))
        store.close()
        tool = zstandard.ZstdCompressor(level=1)
        data = [tool.compress(x.tobytes()) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(data, pa.binary())], names=["slice", "counts"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logarithms of the sums of each slice, in a byte a bucket; rows are sorted by slice."""
    tool, of, counts = zstandard.ZstdDecompressor(), None, np.zeros(0, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8).tobytes()], pa.binary())], names=["slice", "ranks"])
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns)):
            if k != of:
                if of is not None:
                    yield row()
                of, counts = k, np.zeros((1 << COUNTED_BITS) // SLICES, np.int64)
            counts += np.frombuffer(tool.decompress(data), np.int64)
    if of is not None:
        yield row()


def _ranks(nodes: DataFrame, words: int, folder: str, tasks: int) -> np.ndarray:
    """The place of each bucket of shingles in the order of the exact join, by logarithms of the counts over all nodes; any order gives the same links.

    The driver gets one byte a bucket, 4 MB whatever the number of documents.
    """
    counts = nodes.select("place").mapInArrow(Counter(words, folder), "slice int, counts binary")
    ranks = counts.repartition(min(tasks, SLICES), "slice").sortWithinPartitions("slice").mapInArrow(_ranked, "slice int, ranks binary")
    out = np.zeros((SLICES, (1 << COUNTED_BITS) // SLICES), np.uint8)
    for row in ranks.collect():
        out[row.slice] = np.frombuffer(bytes(row.ranks), np.uint8)
    return out.reshape(-1)


class Prefixer:
    """(shingle, node, component, size, at) of the first shingles of each node (node, component, place): as many as can be the first that it shares with a linked one."""

    def __init__(self, n: int, percent: int, folder: str, ranks: np.ndarray):
        self.n, self.percent, self.folder, self.ranks = n, percent, folder, ranks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = StoreReader(self.folder)
        for batch in batches:
            node, component = (batch.column(k).to_numpy() for k in range(2))
            for first, last, sets, bounds in _read_sets(store, batch.column(2).to_pylist(), self.n):
                doc, size = K.owner(bounds), np.diff(bounds)
                rank = self.ranks[(sets >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)]
                order = np.argsort(doc.astype(np.int64) << 8 | rank, kind="stable")
                at = np.arange(len(sets)) - bounds[doc]
                own = np.flatnonzero(at <= size[doc] + (-self.percent * size[doc] // 100))
                d = doc[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets[order[own]].view(np.int64)), pa.array(node[first:last][d]), pa.array(component[first:last][d]), pa.array(size[d].astype(np.int32)), pa.array(at[own].astype(np.int32))],
                    names=["shingle", "node", "component", "size", "at"],
                )
        store.close()


class Meeting:
    """Candidates (a, b) among rows of Prefixer sorted by shingle.

    If a shingle is the first that two sets share, no more are shared than
    either has from there on; linked sets share percent * (x + y) / (100 + percent).
    """

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, MEET
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= limit:
                table = [np.concatenate(c) for c in zip(*held)]
                done = np.flatnonzero(table[0] != table[0][-1])
                cut = done[-1] + 1 if len(done) else 0
                yield from self.meet(*(c[:cut] for c in table))
                held, rows = [[c[cut:] for c in table]], rows - cut
                limit = max(MEET, 2 * rows)
        if rows:
            yield from self.meet(*(np.concatenate(c) for c in zip(*held)))

    def near(self, i, j, component, size, left):
        return (component[i] != component[j]) & ((100 + self.percent) * np.minimum(left[i], left[j]) >= self.percent * (size[i] + size[j]))

    def meet(self, shingle, node, component, size, at) -> Iterator[pa.RecordBatch]:
        if not len(shingle):
            return
        size, left = size.astype(np.int64), size.astype(np.int64) - at
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        ends = np.append(starts[1:], len(shingle))
        several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        small = several & (ends - starts <= SMALL)
        alive = np.flatnonzero(np.repeat(small, ends - starts))
        start = np.repeat(starts, ends - starts)
        k, found = 1, []
        while len(alive := alive[alive - k >= start[alive]]):
            own = alive[self.near(alive, alive - k, component, size, left)]
            found.append(np.stack([node[own], node[own - k]]))
            k += 1
        yield from self.pairs(found)
        for s, e in zip(starts[several & ~small].tolist(), ends[several & ~small].tolist()):
            # All but those of the largest component meet all.
            names, of, n = np.unique(component[s:e], return_inverse=True, return_counts=True)
            other, j = s + np.flatnonzero(of != n.argmax()), np.arange(s, e)
            step = max(1, AT_ONCE // (e - s))
            for d in range(0, len(other), step):
                i = other[d : d + step, None]
                x, y = np.nonzero(self.near(i, j[None, :], component, size, left))
                yield from self.pairs([np.stack([node[i[x, 0]], node[j[y]]])])

    @staticmethod
    def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(x.shape[1] for x in found):
            both = np.concatenate(found, axis=1)
            a, b = both.max(axis=0), both.min(axis=0)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


class Differing:
    """Drops the pairs (a, b, size and parities of both) with more different parities than linked sets have different shingles."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(size), PARITIES // 64) for k in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array((100 + self.percent) * differ <= (100 - self.percent) * size)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2)], names=["a", "b"])


def _unmet(nodes: DataFrame, joined: DataFrame, words: int, percent: int, folder: str, tasks: int) -> DataFrame:
    """(a, b) pairs of nodes of different components, with all that are linked among them."""
    rows = joined.select("node", "component", "place").mapInArrow(Prefixer(words, percent, folder, _ranks(nodes, words, folder, tasks)), "shingle bigint, node bigint, component bigint, size int, at int")
    rows = rows.repartition(tasks, "shingle").sortWithinPartitions("shingle")
    pairs = rows.mapInArrow(Meeting(percent), "a bigint, b bigint").distinct()
    own = nodes.select("node", "n_shingles", "parities")
    pairs = pairs.join(own.toDF("a", "size_a", "parities_a"), "a").join(own.toDF("b", "size_b", "parities_b"), "b")
    return pairs.select("a", "b", "size_a", "size_b", "parities_a", "parities_b").mapInArrow(Differing(percent), "a bigint, b bigint")


class Confirmer:
    def __init__(self, n: int, percent: int, folder: str):
        self.n, self.percent, self.folder = n, percent, folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, sets = StoreReader(self.folder), OrderedDict()

        def get(place: str) -> np.ndarray:
            found = sets.get(place)
            if found is None:
                raw = np.frombuffer(store.get(place), np.uint8)
                found = sets[place] = shingle_sets(raw, np.array([0, len(raw)]), self.n)[0]
                if len(sets) > 256:
                    sets.popitem(last=False)
            else:
                sets.move_to_end(place)
            return found

        for batch in batches:
            links = []
            for a, b, pa_, pb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, y = get(pa_), get(pb)
                if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                # The hashes find the link, the words decide.
                if 100 * common >= self.percent * (len(x) + len(y) - common) and linked(store.get(pa_), store.get(pb), self.n, self.percent):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])
        store.close()
        K.tidy()


class Restorer:
    """Puts the texts back in place of where they are, a few megabytes at a time."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = StoreReader(self.folder)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, first, held = [], 0, 0
            for k, place in enumerate(batch.column(at).to_pylist()):
                texts.append(None if place is None else store.get(place))
                held += len(texts[-1] or b"")
                if held > K.RUN_BYTES or k + 1 == batch.num_rows:
                    yield batch.slice(first, len(texts)).set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))
                    texts, first, held = [], k + 1, 0
        store.close()
        K.tidy()


def _groups(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, keep: tuple[str, ...], folder: str, all_texts: bool) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, group, place) and the columns in keep of each row."""
    bounded(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col), *(F.col(c).alias(f"own_{c}") for c in keep))
    kinds = dict(own.dtypes)
    signed = written(own.mapInArrow(Signer(words, folder, all_texts), _SIGNED + "".join(f", `own_{c}` {kinds[f'own_{c}']}" for c in keep)), "signed")
    nodes = signed.where(F.col("n_shingles") > 0).groupBy("set_a", "set_b").agg(F.min("uid").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("lead"), F.min_by(F.struct("n_shingles", "signature", "parities", "place"), "uid").alias("own"))
    nodes = written(nodes.select("set_a", "set_b", "node", "lead", "own.n_shingles", "own.signature", "own.parities", "own.place"), "nodes")
    places = nodes.select("node", "place")
    links, joined = None, nodes.select("node", "signature", F.col("node").alias("component"))
    for trees in (range(FIRST_TREES), range(FIRST_TREES, TREES), None):
        if trees:
            pairs = _candidates(joined, trees, tasks).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        else:
            pairs = _unmet(nodes, joined, words, percent, folder, tasks)
        pairs = pairs.join(places.toDF("a", "place_a"), "a").join(places.toDF("b", "place_b"), "b").select("a", "b", "place_a", "place_b")
        new = written(pairs.repartitionByRange(tasks, "b", "a").sortWithinPartitions("b", "a").mapInArrow(Confirmer(words, percent, folder), "a bigint, b bigint"), "confirmed")
        if trees is None and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        parts = written(connected_components(links).toDF("of", "component"), "components", short=True)
        joined = nodes.join(parts, F.col("node") == F.col("of"), "left").select("set_a", "set_b", "node", "lead", "signature", "place", F.coalesce("component", "node").alias("component"))
    # The row with the smallest id leads, wherever it stands in the files.
    leads = written(joined.groupBy("component").agg(F.min("lead").alias("lead")), "leads", short=True)
    known = joined.select("set_a", "set_b", "component").join(leads, "component").select("set_a", "set_b", "lead")
    rows = signed.drop("signature", "parities").join(known, ["set_a", "set_b"], "left")
    wordy = F.col("n_shingles") > 0
    return rows.select("uid", "doc_id", "n_shingles", F.when(wordy, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(wordy, F.col("lead.uid")).otherwise(F.col("uid")).alias("group"), "place", *(f"own_{c}" for c in keep))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, leader) of each row of docs.

    Rows are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    word shingles, A-Z lower-cased; a text of fewer words has its words as one
    shingle, and a null text or one without words is linked with nothing.
    component_id is the smallest id that a row is linked with over any number
    of links, itself included (null ids count only where there are no others),
    and leader is true for exactly one row of each component, one with that
    id, repeated rows and ids or not. Extra columns aren't looked at.
    """
    folder = scratch_path(docs.sparkSession, "texts")
    found = _groups(docs, words, percent, id_col, text_col, (), folder, False)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", (F.col("uid") == F.col("group")).alias("leader"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that lead their component (see near_duplicates)."""
    folder = scratch_path(docs.sparkSession, "texts")
    keep = tuple(c for c in docs.columns if c != text_col)
    found = _groups(docs, words, percent, id_col, text_col, keep, folder, True).where(F.col("uid") == F.col("group"))
    found = found.select(*(F.col("place").alias("text") if c == text_col else F.col(f"own_{c}") for c in docs.columns))
    schema = ", ".join(f"`{c}` {k}" for c, k in found.dtypes)
    return found.mapInArrow(Restorer(folder), schema).toDF(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by four-word shingles.

    Null texts and texts without words are linked with nothing; texts of any
    length count whole; repeated rows and ids keep a row each (kept is then
    true for each of the smallest id); an empty table gives no row; columns
    beside doc_id and text aren't looked at.
    """
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
