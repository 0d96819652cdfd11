"""Vectorised text primitives over Arrow buffers.

All functions work on whole texts held as one byte array with document offsets (CSR layout), a
slice of documents at a time so that memory stays bounded by ``target`` bytes (or by one document,
if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xD6E8FEB86659FD93)
K3 = np.uint64(0xA0761D6478BD642F)
S32 = np.uint64(32)
S29 = np.uint64(29)
#: MASK[n] keeps the n lowest bytes of a little-endian 64-bit load.
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Run) -> Run:
    """Gives the memory that a task has freed back to the system at its end: workers live on, and what they hold of
    earlier tasks would add to what later ones need."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return inner


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of the ordered pair (a, b)."""
    x = a * K1
    x ^= x >> S29
    x += b
    x *= K2
    x ^= x >> S32
    x *= K3
    x ^= x >> S29
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null: empty)."""
    arr = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string()) if arr.nbytes < 2**31 else arr
    return pc.fill_null(arr, "") if arr.null_count else arr


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets counted from the array's first value."""
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def slices(arr: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, padded bytes, offsets) for runs of documents of about ``target`` bytes.
    Eight zero bytes follow the texts, so that 8-byte loads stay inside the array."""
    if not len(arr):
        return
    data, off = buffers(arr)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, side="right")) - 1)
        part = np.zeros(off[hi] - off[lo] + 8, np.uint8)
        part[:-8] = data[off[lo] : off[hi]]
        yield lo, hi, part, off[lo : hi + 1] - off[lo]
        lo = hi


def loads(data: np.ndarray) -> np.ndarray:
    """The unaligned little-endian 8-byte word that starts at each byte (a view)."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def is_space(data: np.ndarray) -> np.ndarray:
    """ASCII white space: 0x20 and 0x09-0x0D."""
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross documents: (starts, lengths, runs before each document)."""
    n = int(off[-1])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    a = inside[:n]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, a[:-1]
        after[-1], after[:-1] = False, a[1:]
    starts = np.flatnonzero(a & (~before | edge[:n]))
    ends = np.flatnonzero(a & (~after | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, off)


#: Bytes of a span up to which its 8-byte words are mixed one after the other.
SHORT = 64


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each span's bytes. A span above ``SHORT`` bytes has its 8-byte words mixed
    with their places and summed, so that the time is linear whatever the longest span."""
    words = loads(data)
    h = mix(lens.astype(np.uint64), np.full(len(lens), K3))
    at = np.flatnonzero(lens <= SHORT)
    pos, left = starts[at], lens[at]
    while len(at):
        v = words[pos] & MASK[np.minimum(left, 8)]
        h[at] = mix(h[at], v)
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    for i in np.flatnonzero(lens > SHORT).tolist():
        start, n = int(starts[i]), int(lens[i])
        total = np.zeros(1, np.uint64)
        for a in range(0, n, 1 << 20):
            pos = np.arange(a, min(n, a + (1 << 20)), 8)
            v = words[start + pos] & MASK[np.minimum(n - pos, 8)]
            total += mix(v, pos.astype(np.uint64)).sum(dtype=np.uint64)
        h[i : i + 1] = mix(h[i : i + 1], total)
    return h


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[s:s+n] of every span, one after the other."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    idx = np.ones(total, np.int64)
    keep = lens > 0
    s, n, e = starts[keep], lens[keep], ends[keep]
    idx[0] = s[0]
    idx[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return values[np.cumsum(idx)]


def _classes() -> np.ndarray:
    c = np.full(256, 4, np.uint8)
    c[0x21:0x7F] = 3
    c[[0x20, 0x09, 0x0A, 0x0D]] = 0
    c[0x41:0x5B] = c[0x61:0x7B] = 1
    c[0x30:0x3A] = 2
    c[0x27] = 4
    return c


#: Bytes: 0 blank, 1 ASCII letter, 2 digit, 3 other visible ASCII, 4 anything else.
_CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def cut_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts, lengths, words before each document, which words are plain).

    Chunks between blanks that hold only ASCII without apostrophes or "<|" and the letters of Latin-1 are
    plain: they are cut further, into runs of letters, single digits and runs of other characters, in lower
    case. Any other chunk is one word as it stands.
    """
    n = int(off[-1])
    low, kind = LOWER[data], _CLASS[data[:n]]
    lead = np.flatnonzero(data[: max(n - 1, 0)] == 0xC3)  # letters of Latin-1 but the signs of multiplication and division
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    upper = lead[data[lead + 1] < 0x9F] + 1
    low[upper] += 32
    kind[np.flatnonzero((data[: max(n - 1, 0)] == 0x3C) & (data[1:n] == 0x7C))] = 4  # special tokens begin so
    starts, lens, _ = spans(kind > 0, off)
    hard = np.concatenate([[0], np.cumsum(kind == 4)])
    odd = hard[starts + lens] > hard[starts]
    at = gather(np.arange(n), starts[odd], lens[odd])
    kind[at] = 4
    low[at] = data[at]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | edge[1:n]
    begin = np.flatnonzero(first)
    stop = np.append(kind[1:] != kind[:-1], True) | (kind == 2) | edge[1:]
    end = np.flatnonzero(stop & (kind > 0)) + 1
    return low, begin, end - begin, np.searchsorted(begin, off), kind[begin] != 4
