"""Arrow batches of texts as flat numpy arrays, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: What operators keep in a Python worker between tasks; none of it changes a result.
CACHES: list[dict] = []


def lighten(but: dict | None = None) -> None:
    """Make room in a worker that Spark hands from one operator to the next: the others' caches go (all ``but`` one's own),
    and freed memory goes back to the system.  A task calls it first."""
    for cache in CACHES:
        if cache is not but:
            cache.clear()
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string column; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    return offsets, (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose texts hold about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)[:n]


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts data[bounds[i]:bounds[i+1]].

    Returns (start, end, hash, first): byte span and 64-bit hash of each word,
    and first[i] = index of text i's first word (first[-1] = all words).
    """
    if lower:
        data = _LOWER[data]
    is_word = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(start, bounds)
    if len(start) == 0:
        return start, end, np.zeros(0, U), first
    span = np.repeat(start, end - start)
    where = np.flatnonzero(is_word)
    rel = where - span
    values = BYTE[data[where]] * powers(BASE, int(rel.max()) + 1)[rel]
    at = np.zeros(len(start), np.int64)
    np.cumsum((end - start)[:-1], out=at[1:])
    return start, end, mix(np.add.reduceat(values, at) + (end - start).astype(U)), first


def with_texts(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """batch with its ``text`` replaced, and ``n_chars`` where it has one."""
    kinds = {f.name: f.type for f in batch.schema}
    new = {"text": pa.array(texts, kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kinds["n_chars"])
    return pa.RecordBatch.from_arrays([new.get(f.name, batch.column(k)) for k, f in enumerate(batch.schema)], schema=batch.schema)
