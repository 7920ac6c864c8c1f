"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of them overlap.

A is a byte-level BPE over a blank and the text, B a piece model over the text,
which puts the blank there itself. A transducer reads the tokens of both sides:
its state is the side that leads and the bytes by which it does (the dangling
suffix of that side's last token). The next token comes from the side that lags;
where it goes from a state is remembered by state and token, so that bytes are
compared once for each such move. A group closes when no bytes dangle. Each
token but a group's first overlaps with the last one of the leading side, and
these are the links.

Both sides have a boundary before a blank that follows a character other than
white space. What lies between two such places is a unit: it is aligned once for
each block of texts that holds it, and a text's groups are those of its units.

1. Each block of texts yields its documents' numbers and digests, how often each
   document holds each of its units, and its links, added up and dealt by B's id.
2. The rows of a bucket are added up to the corpus-wide counts, and the best
   count of each B id is found; then the counts go back to the blocks that asked.
3. They are added up per unit and per document.

Only packed rows of a block and a bucket are shuffled. A bucket's distinct pairs
are held in a task: at most A's vocabulary for each of its B ids, whatever the
input.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bounded, written
from .tokens import BLANK, public_tokenizer, separable, squeeze, unsqueeze

#: Bytes of text in a block, unless one text is longer, and units whose groups are written at once.
BLOCK_BYTES, AT_ONCE = 8 << 20, 1 << 16
#: Moves of the transducer that a worker keeps from block to block.
KEEP_MOVES = 1_000_000
#: Fixed: the pre-tokens of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLOCK = "block bigint, links array<struct<bucket:int,packed:binary>>, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha array<string>, docs binary, places binary, times binary, unit_links binary, link_seats binary"
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("links", pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))), *((k, pa.list_(pa.int64())) for k in ("ids", "n_a", "n_b", "n_groups")), ("sha", pa.list_(pa.string()))]
    + [(k, pa.binary()) for k in ("docs", "places", "times", "unit_links", "link_seats")]
)


def byte_level_tokens(json_path: str) -> dict[bytes, int]:
    """The entries of a byte-level BPE's vocabulary as bytes, without its special tokens."""
    spec = json.load(open(json_path, encoding="utf-8"))
    # The printable stand-ins for bytes, by the rule of byte-level BPE.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}


def piece_bytes(model, piece: int) -> bytes:
    """The bytes that a piece stands for."""
    text = model.id_to_piece(piece)
    return bytes([int(text[3:5], 16)]) if model.is_byte(piece) else text.replace(BLANK, " ").encode()


class Transducer:
    """Aligns lists of tokens over the same bytes, many pairs of lists in step.

    a_bytes, b_bytes: a token's bytes by its id, on each side.
    """

    def __init__(self, a_bytes, b_bytes):
        self.bytes = (a_bytes, b_bytes)
        self._forget()

    def _forget(self) -> None:
        #: State 0: nothing dangles, and A is read. Otherwise the side to be read and the other's dangling bytes.
        self.states, self.numbers = [(0, b"")], {(0, b""): 0}
        self.side = np.zeros(1, np.int8)
        self.keys, self.to = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _move(self, state: int, token: int) -> int:
        side, dangling = self.states[state]
        t = self.bytes[side][token]
        if dangling.startswith(t):
            to = (side, dangling[len(t) :])
        elif t.startswith(dangling):
            to = (1 - side, t[len(dangling) :])
        else:
            return -1
        if not to[1]:
            return 0
        if to not in self.numbers:
            self.numbers[to] = len(self.states)
            self.states.append(to)
        return self.numbers[to]

    def moves(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states that tokens lead to; what wasn't met before is worked out and kept."""
        key = state << 24 | token
        at = np.searchsorted(self.keys, key)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            to = np.fromiter((self._move(k >> 24, k & 0xFFFFFF) for k in new.tolist()), np.int64, len(new))
            place = np.searchsorted(self.keys, new)
            self.keys, self.to = np.insert(self.keys, place, new), np.insert(self.to, place, to)
            self.side = np.concatenate([self.side, np.fromiter((s for s, _ in self.states[len(self.side) :]), np.int8)])
            at = np.searchsorted(self.keys, key)
        return self.to[at]

    def align(self, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each pair of lists, whether their bytes are the same; of each token, its group in the lists and the id it is linked with, or -1.

        a, b: the ids of all lists; their n + 1 bounds. Returns good, A's groups
        and links, B's groups and links. Of two tokens that are linked, the later
        one names the other.
        """
        if len(self.keys) > KEEP_MOVES:
            self._forget()
        n = len(a_bounds) - 1
        good, group = np.zeros(n, bool), np.zeros(n, np.int64)
        groups, links = (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)), (np.full(len(a), -1, np.int64), np.full(len(b), -1, np.int64))
        now, i, j, state = np.arange(n), a_bounds[:-1].copy(), b_bounds[:-1].copy(), np.zeros(n, np.int64)
        while len(now):
            side = self.side[state]
            more = np.where(side, j < b_bounds[now + 1], i < a_bounds[now + 1])
            if not more.all():
                good[now[~more & (state == 0) & (j == b_bounds[now + 1])]] = True
                now, i, j, state, side = now[more], i[more], j[more], state[more], side[more]
            for k, (own, other, at, before) in enumerate(((a, b, i, j), (b, a, j, i))):
                turn = np.flatnonzero(side == k)
                place = at[turn]
                groups[k][place] = group[now[turn]]
                open_ = state[turn] > 0
                links[k][place[open_]] = other[before[turn[open_]] - 1]
                state[turn] = self.moves(state[turn], own[place])
                at[turn] += 1
            if (state < 0).any():
                fits = state >= 0
                now, i, j, state = now[fits], i[fits], j[fits], state[fits]
            group[now] += state == 0
        return good, groups[0], links[0], groups[1], links[1]


class GroupWriter:
    """Groups as ``a1,a2|b1;a3|b2,b3;``, ids in decimal."""

    def __init__(self, a_size: int, b_size: int):
        self.a_size, self.b_size = a_size, b_size
        self.parts = pa.array([f"{i}{mark}" for n, marks in ((a_size, ",|"), (b_size, ",;")) for mark in marks for i in range(n)], pa.string())

    def write(self, lists: int, a: np.ndarray, a_list: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_list: np.ndarray, b_group: np.ndarray) -> pa.Array:
        """The text of each of the lists, from each token's id, list and group in it; every group has tokens of both sides."""
        per_list = np.zeros(lists, np.int64)
        np.maximum.at(per_list, a_list, a_group + 1)
        base = np.cumsum(per_list) - per_list
        a_of, b_of, total = base[a_list] + a_group, base[b_list] + b_group, int(per_list.sum())
        n_a, n_b = np.bincount(a_of, minlength=total), np.bincount(b_of, minlength=total)
        a_first, b_first, start = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, np.cumsum(n_a + n_b) - n_a - n_b
        a_in, b_in = np.arange(len(a)) - a_first[a_of], np.arange(len(b)) - b_first[b_of]
        part = np.empty(len(a) + len(b), np.int64)
        part[start[a_of] + a_in] = a + self.a_size * (a_in + 1 == n_a[a_of])
        part[start[b_of] + n_a[b_of] + b_in] = 2 * self.a_size + b + self.b_size * (b_in + 1 == n_b[b_of])
        size = np.bincount(a_list, minlength=lists) + np.bincount(b_list, minlength=lists)
        at = np.append(0, np.cumsum(size))
        out = [pa.array([], pa.large_string())]
        for d, e in K.runs(at, 1 << 24):  # lists of strings have 32-bit places
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at[d : e + 1] - at[d], pa.int32()), self.parts.take(pa.array(part[at[d] : at[e]]))), "").cast(pa.large_string()))
        return pa.concat_arrays(out)


def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin: at a blank behind a character that is neither white space nor a control, and where texts do (first)."""
    head = np.zeros(len(data), bool)
    if len(data) > 1:
        before = data[:-1]
        wide = np.zeros(len(data) - 1, bool)  # the last byte of white space beyond ASCII; a few other characters count too, which does no harm
        tail = (before >= 0x80) & ((before <= 0x8A) | np.isin(before, np.array([0x9F, 0xA0, 0xA8, 0xA9, 0xAF], np.uint8)))
        wide[1:] = tail[1:] & (before[:-1] == 0xC2)
        wide[2:] |= tail[2:] & (before[:-2] >= 0xE1) & (before[:-2] <= 0xE3)
        head[1:] = (data[1:] == 0x20) & (before > 0x20) & (before != 0x7F) & ~wide
    head[first] = True
    return np.flatnonzero(head)


class Aligner:
    """The two tokenizers and the transducer between them; made once in each worker."""

    def __init__(self, json_path: str, model_path: str):
        self.paths, self.ready = (json_path, model_path), False

    def __getstate__(self):
        return {"paths": self.paths, "ready": False}

    def _load(self) -> None:
        import sentencepiece
        import tiktoken

        vocab = byte_level_tokens(self.paths[0])
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
        self.blank = self.model.piece_to_id(BLANK)
        pieces = self.model.get_piece_size()
        self.transducer = Transducer({i: w for w, i in vocab.items()}, [piece_bytes(self.model, i) for i in range(pieces)])
        self.writer = GroupWriter(max(vocab.values()) + 1, pieces)
        self.ready = True

    def units(self, words: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct units, each with its blank in front: whether the bytes agree; numbers of tokens and groups; the groups' texts; of their links the unit, A's and B's id.

        A unit whose bytes don't agree has no tokens.
        """
        if not self.ready:
            self._load()
        texts = [w.decode() for w in words]
        # The library puts the blank there itself, but gives nothing for an empty string.
        piece_ids = self.model.encode([t[1:] for t in texts], num_threads=1)
        ids = [[self.bpe.encode_ordinary(t) for t in texts], [b if len(t) > 1 else [self.blank] for t, b in zip(texts, piece_ids)]]
        flat, bounds = [], []
        for side in ids:
            size = np.fromiter(map(len, side), np.int64, len(side))
            bounds.append(np.append(0, np.cumsum(size)))
            flat.append(np.fromiter(chain.from_iterable(side), np.int64, int(size.sum())))
        good, a_group, a_link, b_group, b_link = self.transducer.align(flat[0], bounds[0], flat[1], bounds[1])
        of = [np.repeat(np.arange(len(words)), np.diff(x)) for x in bounds]
        fits = [good[x] for x in of]
        (a, b), (a_of, b_of) = ([x[k] for x, k in zip(y, fits)] for y in (flat, of))
        a_group, a_link, b_group, b_link = a_group[fits[0]], a_link[fits[0]], b_group[fits[1]], b_link[fits[1]]
        n_groups = np.zeros(len(words), np.int64)
        np.maximum.at(n_groups, a_of, a_group + 1)
        numbers = {"n_a": np.bincount(a_of, minlength=len(words)), "n_b": np.bincount(b_of, minlength=len(words)), "n_groups": n_groups}
        text = self.writer.write(len(words), a, a_of, a_group, b, b_of, b_group)
        x, y = a_link >= 0, b_link >= 0
        link_of, link_a, link_b = np.concatenate([a_of[x], b_of[y]]), np.concatenate([a[x], b_link[y]]), np.concatenate([a_link[x], b[y]])
        order = np.argsort(link_of, kind="stable")
        return good, numbers, text, link_of[order], link_a[order], link_b[order]


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(document, code, distinct) of the units of runs of texts."""
    for d, e in K.runs(offsets):
        a, b = offsets[d], offsets[e]
        if a == b:
            continue
        off = offsets[d : e + 1] - a
        starts = unit_starts(data[a:b], off[:-1][np.diff(off) > 0])
        code, distinct = K.codes(data[a:b], starts, np.append(starts[1:], b - a))
        yield K.owner(np.searchsorted(starts, off)) + d, code, distinct


def _block(data: np.ndarray, offsets: np.ndarray, aligner: Aligner, buckets: int) -> dict:
    """All that is known of a block of texts, each of them with its blank in front."""
    n = len(offsets) - 1
    found = list(_parts(data, offsets))
    coded = pa.concat_arrays([*(x[2] for x in found), pa.array([], pa.large_binary())]).dictionary_encode()
    seat, first = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(x[2]) for x in found)])
    doc = np.concatenate([*(x[0] for x in found), np.zeros(0, np.int64)]).astype(np.int64)
    unit = np.concatenate([*(seat[x[1] + k] for x, k in zip(found, first)), np.zeros(0, np.int64)]).astype(np.int64)
    held = np.flatnonzero(np.bincount(unit, minlength=len(coded.dictionary)))  # what only gaps hold is no unit
    words = K.strings(coded.dictionary.take(pa.array(held)))
    unit = np.searchsorted(held, unit)
    good, numbers, text, link_of, a, b = aligner.units(words)
    # A text of which a unit doesn't fit has no tokens at all.
    bad = np.bincount(doc[~good[unit]], minlength=n) > 0
    doc, unit = doc[~bad[doc]], unit[~bad[doc]]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    sha = []
    for d, e in K.runs(bounds, AT_ONCE):
        for k in range(bounds[d], max(bounds[e], bounds[d] + 1), AT_ONCE):  # one long text's units come in several steps
            part = text.take(pa.array(unit[k : min(k + AT_ONCE, bounds[e])]))
            raw, off = K.column_bytes(part)
            if e - d == 1:
                digest = hashlib.sha256() if k == bounds[d] else digest
                digest.update(raw[: len(raw) - (k + AT_ONCE >= bounds[e])])
                if k + AT_ONCE >= bounds[e]:
                    sha.append(digest.hexdigest() if bounds[e] > bounds[d] else "")
            else:
                at = off[bounds[d : e + 1] - bounds[d]].tolist()
                sha += [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]
    pair, times = np.unique(doc << 32 | unit, return_counts=True)
    held_by, used = np.bincount(pair >> 32, minlength=n), np.unique(unit)
    # Links of units that only texts without tokens have are of no account.
    here = np.zeros(len(words), bool)
    here[used] = True
    a, b, link_of = a[here[link_of]], b[here[link_of]], link_of[here[link_of]]
    size = np.bincount(link_of, minlength=len(words))[used]
    place = np.searchsorted(used, pair & 0xFFFFFFFF)
    total = np.zeros(len(used), np.int64)
    np.add.at(total, place, times)
    link, which = np.unique(b % buckets << 48 | b << 24 | a, return_inverse=True)
    count = np.zeros(len(link), np.int64)
    np.add.at(count, which, np.repeat(total, size))
    numbers = {k: K.sum_by(bounds, x[unit]).tolist() for k, x in numbers.items()}
    edge = np.searchsorted(link >> 48, np.arange(buckets + 1))
    packed = lambda x, y: squeeze(np.concatenate([link[x:y] >> 24 & 0xFFFFFF, link[x:y] & 0xFFFFFF, count[x:y] & 0xFFFFFFFF, count[x:y] >> 32]))
    steps = np.diff(place, prepend=0)
    head = np.append(0, np.cumsum(held_by))[:-1][held_by > 0]
    steps[head] = place[head]
    return numbers | {
        "links": [{"bucket": k, "packed": packed(edge[k], edge[k + 1])} for k in np.flatnonzero(np.diff(edge)).tolist()],
        "sha": sha, "docs": squeeze(held_by), "places": squeeze(steps), "times": squeeze(times), "unit_links": squeeze(size), "link_seats": squeeze(which),
    }


class Blocks:
    def __init__(self, json_path: str, model_path: str, buckets: int):
        self.aligner, self.buckets = Aligner(json_path, model_path), buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                size += batch.nbytes
            if waiting and (batch is None or size >= BLOCK_BYTES):
                table = pa.Table.from_batches(waiting)
                waiting, size = [], 0
                ids, texts = table.column(0), table.column(1).cast(pa.large_string()).combine_chunks()
                data, offsets = K.column_bytes(texts)
                for d, e in K.runs(offsets, BLOCK_BYTES):
                    off = offsets[d : e + 1] - offsets[d]
                    some = np.diff(off) > 0
                    raw = np.insert(data[offsets[d] : offsets[e]], off[:-1][some], 0x20)
                    row = {"block": number, "ids": ids.slice(d, e - d).to_pylist()} | _block(raw, off + np.append(0, np.cumsum(some)), self.aligner, self.buckets)
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _SCHEMA], schema=_SCHEMA)
                K.tidy()


def _rows(packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, as numbers in order of B's and then A's id, and their counts."""
    b, a, low, high = unsqueeze(packed.as_buffer()).reshape(4, -1)
    return b << 24 | a, low | high << 32


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, which = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, which, np.concatenate(counts))
    return u, total


class Totals:
    """(bucket, packed) of (bucket, packed) rows sorted by bucket: each pair with its count in all of them."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, counts, waiting = None, [], [], 0

        def row() -> pa.RecordBatch:
            u, n = _added(pairs, counts)
            packed = squeeze(np.concatenate([u >> 24, u & 0xFFFFFF, n & 0xFFFFFFFF, n >> 32]))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if pairs:
                        yield row()
                    now, pairs, counts, waiting = bucket, [], [], 0
                u, n = _rows(packed)
                pairs.append(u)
                counts.append(n)
                waiting += len(u)
                if waiting > 1_000_000 + 2 * len(pairs[0]):
                    u, n = _added(pairs, counts)
                    pairs, counts, waiting = [u], [n], len(u)
        if pairs:
            yield row()
        K.tidy()


class Answers:
    """(home, bucket, counts, best) for the (bucket, block, packed) rows with a block; the one without, first in each bucket, has the totals."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for bucket, block, packed in zip(batch.column(0), batch.column(1), batch.column(2)):
                u, n = _rows(packed)
                if not block.is_valid:
                    known, counts = u, n
                    first = np.flatnonzero(np.diff(u >> 24, prepend=-1))
                    best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(u))))
                    continue
                at = np.searchsorted(known, u)
                c = counts[at]
                columns = [pa.array([block.as_py()]), pa.array([bucket.as_py()], pa.int32()), pa.array([squeeze(np.concatenate([c & 0xFFFFFFFF, c >> 32]))], pa.binary()), pa.array([tool.compress(np.packbits(best[at]).tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["home", "bucket", "counts", "best"])
        K.tidy()


def _summed(_key, block: pa.Table, answers: pa.Table) -> pa.Table:
    row = {k: block.column(k)[0] for k in block.column_names}
    docs, steps, times, size, seats = (unsqueeze(row[k].as_py()) for k in ("docs", "places", "times", "unit_links", "link_seats"))
    counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, packed, bits in sorted(zip(*(answers.column(k).to_pylist() for k in ("bucket", "counts", "best")))):
        low, high = unsqueeze(packed).reshape(2, -1)
        counts.append(low | high << 32)
        best.append(np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8))[: len(low)].astype(np.int64))
    bounds, of_unit = np.append(0, np.cumsum(docs)), np.append(0, np.cumsum(size))
    sums = {}
    c = np.cumsum(steps)
    head = bounds[:-1][docs > 0]
    place = c - np.repeat(c[head] - steps[head], docs[docs > 0])
    for name, value in (("count_sum", np.concatenate(counts)), ("n_best", np.concatenate(best))):
        sums[name] = pa.array(K.sum_by(bounds, K.sum_by(of_unit, value[seats])[place] * times), pa.int64())
    n_a, n_b, n_groups = (row[k].values.to_numpy(zero_copy_only=False) for k in ("n_a", "n_b", "n_groups"))
    numbers = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}
    return pa.table({"id": row["ids"].values, **{k: pa.array(v, pa.int64()) for k, v in numbers.items()}, "n_best": sums["n_best"], "count_sum": sums["count_sum"], "groups_sha256": row["sha"].values})


def align_tokens(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of two tokenizers align in each row of docs.

    id; n_a and n_b, tokens of each side; n_groups; n_links, pairs of tokens
    that share a byte; n_best, links whose pair of ids occurs as often in the
    corpus as any with that id of B; count_sum, how often the links' pairs occur,
    added up; groups_sha256 of the groups as written_groups has them.

    Null and empty texts, and those whose bytes one side doesn't give back (with
    the mark for a blank inside, for instance), have no tokens: zeros and ''.
    Texts of any length are aligned whole; repeated and null ids keep a row each
    and their links count each; columns beside the two are not looked at.
    """
    if not separable(model_path):
        raise ValueError("pieces that cross words can't be aligned by units")
    spark = docs.sparkSession
    bounded(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(Blocks(json_path, model_path, buckets), _BLOCK), "align-blocks")
    links = blocks.select("block", F.explode("links").alias("k")).select("k.bucket", "block", "k.packed")
    totals = links.select("bucket", "packed").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(Totals(), "bucket int, packed binary")
    both = links.union(written(totals, "align-totals").select("bucket", F.lit(None).cast("bigint"), "packed"))
    answers = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first()).mapInArrow(Answers(), "home bigint, bucket int, counts binary, best binary")
    rows = blocks.drop("links").groupBy("block").cogroup(answers.groupBy("home"))
    return rows.applyInArrow(_summed, "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").withColumnRenamed("id", id_col)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level BPE and a piece model over every document.

    Null and empty texts, and texts that the piece model doesn't give back, have
    zeros and no digest; texts of any length are aligned whole; repeated rows
    keep a row each; an empty table gives no row; columns beside doc_id and text
    aren't looked at.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
