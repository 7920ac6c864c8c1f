"""Vectorised text kernels over Arrow string buffers.

Every kernel here looks at a run of documents as one byte array plus offsets,
so the cost per byte is a handful of passes and no Python string is made for a
word. Segments (words, lines, pre-tokens) are told apart by their bytes: codes
gives equal segments of a run, and no others, one number. What must be known in
other runs by a number alone is a 64-bit XXH3 digest, one for each distinct
segment. The polynomial prefix hash is for strings of one short length that are
compared byte by byte later on. All constants are fixed, so that any worker
gives any segment the same digest.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))

#: Documents are worked on in runs of about this many bytes, which bounds the
#: arrays of eight bytes a byte; one longer document makes a run of its own.
RUN_BYTES = 1 << 19

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, RUN_BYTES + 4096)
        for name, base in (("_pow", BASE), ("_inv", BASE_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche: a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array and n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not n or offsets is None or not offsets.size:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, wide)[col.offset : col.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def runs(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes each, or of one document."""
    limit = limit or RUN_BYTES
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + limit, "right")) - 1)
        yield d, min(e, n)
        d = min(e, n)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 that is true within the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: ``[^\x20\x09-\x0D]``: UTF-8 keeps these bytes for these characters alone.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text.
ALNUM = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a document: starts, ends and, of n + 1, each document's first."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each segment, the same for equal ones alone, and the distinct ones that the numbers stand for.

    Segments and the gaps between them go as they lie into a dictionary that
    compares bytes; they must be in order and may touch, not overlap. What only
    gaps hold is among the distinct ones too.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    off = np.empty(2 * n, np.int64)
    off[::2], off[1::2] = starts, ends
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), coded.dictionary


def strings(x: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls; several times as fast as to_pylist."""
    if not len(x):
        return []
    _, offsets, data = x.buffers()
    off = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    raw, off = (data.slice(off[0], off[-1] - off[0]).to_pybytes() if data is not None else b""), (off - off[0]).tolist()
    return [raw[a:b] for a, b in zip(off, off[1:])]


def digests(distinct: pa.Array) -> np.ndarray:
    """A 64-bit digest of each string."""
    return np.fromiter(map(xxh3_64_intdigest, strings(distinct)), np.uint64, len(distinct))


def segment_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The digest of each segment's bytes, wherever it stands."""
    code, distinct = codes(data, starts, ends)
    return digests(distinct)[code] if len(code) else np.zeros(0, np.uint64)


def ranks(x: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each value, the same for equal ones alone, and how many there are."""
    coded = pa.array(x).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def combine(*parts: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """One number for each row of numbers, the same for equal rows alone, and what it is below; parts: numbers, and what they are below."""
    out, size = parts[0]
    for x, below in parts[1:]:
        if size * below >= 1 << 63:
            out, size = ranks(out)
        out, size = out * below + x, size * below
    return out, size


def shingles(code: np.ndarray, below: int, n: int) -> tuple[np.ndarray, int]:
    """A number for each n consecutive codes, as combine gives it; the last n - 1 places have none."""
    m = max(0, len(code) - n + 1)
    return combine(*((code[k : k + m], below) for k in range(n)))


def often(rank: np.ndarray) -> np.ndarray:
    """Whether each rank occurs twice or more."""
    return np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)


def tidy() -> None:
    """Give memory that isn't used back to the machine: workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        return


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 values of a polynomial modulo 2**64; those of a segment follow by segment_hash.

    Long strings that collide are easy to construct, so that equal values must
    be followed by a look at the bytes.
    """
    h = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        h[1:] = BYTE_CODE[data]
        h[1:] *= powers(len(data))[0]
        np.cumsum(h[1:], out=h[1:])
    return h


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each segment's bytes and length, wherever it stands."""
    h = prefix[ends] - prefix[starts]
    h *= powers(len(prefix))[1][starts]
    h += (ends - starts).astype(np.uint64) * _M3
    return mix(h)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive digests; the last n - 1 places have none."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(BASE)
        h += words[k : k + m]
        h = mix(h)
    return h


def owner(bounds: np.ndarray) -> np.ndarray:
    """The document of each segment, from the bounds that segments gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sum_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values per document; bounds as segments gives them."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]
