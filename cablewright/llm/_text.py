"""Vectorised byte-level text work shared by the operators that run in Arrow batches.

Everything here takes and returns NumPy arrays, holds at most one slice of a
batch at a time (`slices`), and never imports Spark.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19



def _libc():
    """The C library, told to map large arrays one by one, so that their memory goes back when they do; None where that can't be."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows up to 32 MB
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def tidy() -> None:
    """Gives memory that isn't used back to the system: a worker stays after its task, beside other tasks."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def tidied(run):
    """A function over batches that tidies up after the last one."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return inner


def tidied_group(run):
    """A function over the table of a group, or two, that tidies up after each."""

    def inner(*tables):
        try:
            return run(*tables)
        finally:
            tidy()

    # Spark tells the kinds of such functions by their parameters.
    if run.__code__.co_argcount == 1:
        return lambda table: inner(table)
    return lambda left, right: inner(left, right)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, dtype=bool)
_SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM_WORD = np.zeros(256, dtype=bool)
_ALNUM_WORD[0x30:0x3A] = _ALNUM_WORD[0x61:0x7B] = _ALNUM_WORD[0x80:] = True
_ALNUM_WORD[0x41:0x5B] = True  # letters are lower-cased before they are classed
#: Word classes: runs without ASCII white space, and runs of digits, letters and non-ASCII characters.
CLASSES = {"space": _SPACE_WORD, "alnum": _ALNUM_WORD}

_MULT = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers["p"]) < n:
        size = 1 << max(n - 1, 1 << 16).bit_length()
        for name, base in (("p", _MULT), ("i", pow(_MULT, -1, 1 << 64))):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    text = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of up to `most` bytes, one row at least."""
    k, n = 0, len(at) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield k, end
        k = end


def words(text: np.ndarray, at: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and the first word of each row (with the total at the end)."""
    inside = CLASSES[kind][text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1]
    edges = edges[edges < len(text)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, at)


def ends(text: np.ndarray, at: np.ndarray, kind: str = "space") -> np.ndarray:
    """Where each word ends."""
    inside = CLASSES[kind][text]
    out = inside.copy()
    out[:-1] &= ~inside[1:]
    edges = at[1:] - 1
    edges = edges[(edges >= 0) & (np.diff(at) > 0)]
    out[edges] = inside[edges]
    return np.flatnonzero(out) + 1


def word_hashes(text: np.ndarray, at: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the first word of each row."""
    starts, first = words(text, at, kind)
    if not len(starts):
        return np.zeros(0, U64), first
    p, inverse = _power(len(text))
    table = np.where(CLASSES[kind], _BYTE[_LOWER], U64(0))
    h = np.add.reduceat(table[text] * p[: len(text)], starts)
    return mix(h * inverse[starts]), first


_SHINGLE = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and the first one of each row of the table.

    A row with fewer words, but not none, has one shingle: its whole sequence.
    """
    n = np.diff(first)
    total = len(h)
    out = np.zeros(total, U64)
    for j in range(k):
        out[: max(0, total - j)] += h[j:] * U64(_SHINGLE[j % 5] + 2 * (j // 5))
    out = mix(out)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    take = np.arange(begin[-1]) - begin[row] + first[:-1][row] if len(row) else np.zeros(0, np.int64)
    got = out[take]
    for r in np.flatnonzero((n > 0) & (n < k)):
        x = U64(int(n[r]))
        with np.errstate(over="ignore"):
            for j, w in enumerate(h[first[r] : first[r + 1]]):
                x = x + w * U64(_SHINGLE[j % 5] + 2 * (j // 5) + 4)
        got[begin[r]] = mix(np.array([x], U64))[0]
    return got, begin


def distinct_by_row(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, and the first one of each row."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(h)
    if n > 1:  # by row again: a radix sort, if the rows' numbers have 16 bits
        order = order[np.argsort(row[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(n + 1))
