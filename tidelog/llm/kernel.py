"""Vectorised text kernels over Arrow string buffers: word spans, word hashes, record
exchange. Texts stay UTF-8 bytes; no Python string is made per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled alone, whole).
CHUNK = 512 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives freed memory back, as workers outlive tasks and share an executor's limit."""

    def freed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library than glibc

    return freed


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def byte_table(fold: bool) -> np.ndarray:
    """A random 64-bit value per byte; with fold, A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
    if fold:
        table[65:91] = table[97:123]
    return table


def separators(words: str) -> np.ndarray:
    """True per byte that is no word byte. words: "alnum" (0-9, letters, all beyond ASCII) or "space" (not white space)."""
    sep = np.zeros(256, bool)
    if words == "space":
        sep[[9, 10, 11, 12, 13, 32]] = True
    else:
        sep[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            sep[a:b] = False
    return sep


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; those of a longer span than a chunk are not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    pair = []
    for base in (_MULT, inverse):
        p = np.full(max(n, 2 * CHUNK), base, np.uint64)
        p[0] = 1
        pair.append(np.multiply.accumulate(p))
    if n <= 2 * CHUNK:
        _powers = (pair[0], pair[1])
    return pair[0], pair[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the texts' bounds (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of whole texts of about CHUNK bytes."""
    buf, bounds = text_buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        yield i, buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def word_spans(buf: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and per text the index of its first word (n + 1)."""
    inside = ~sep[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and do not overlap."""
    return span_hashes(buf, starts, ends, table)[0]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, beginnings: tuple[int, ...] = ()) -> list[np.ndarray]:
    """A 64-bit hash of each span, and per length in beginnings those of the first bytes of the spans that are longer.

    Spans are taken in blocks of bytes, from one cumulative polynomial over a block, so memory
    beyond the result does not grow with the text."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(len(beginnings) + 1)]
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _grown(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[buf[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[0].append(mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)))
        for k, length in enumerate(beginnings, 1):
            x = a[b - a > length]
            out[k].append(mix((total[x + length] - total[x]) * inverse[x] + np.uint64(length)))
        i = j
    return [np.concatenate(x) for x in out]


def scatter(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """One dict per part that has records: p, n and each column's bytes."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    columns = {k: v[order] for k, v in columns.items()}
    for p in np.flatnonzero(edges[1:] > edges[:-1]):
        a, b = edges[p], edges[p + 1]
        yield {"p": int(p), "n": int(b - a)} | {k: v[a:b].tobytes() for k, v in columns.items()}


def gather(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The records of a column of blobs."""
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and length, one after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(int(lengths.sum()))
