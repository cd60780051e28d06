"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Every function works on a *chunk*: one contiguous byte array and the offsets of
the texts in it. Chunks are about ``CHUNK`` bytes, so the temporaries stay small
however large an Arrow batch is; a longer text is a chunk of its own and is
still processed whole.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "token": 0xD6E8FEB86659FD93}

#: White space that separates tokens: tab, line feed, form feed, carriage return, space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
#: White space and ASCII punctuation, for tokens that ignore punctuation.
NONWORD = np.array([c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 for c in range(256)])

_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least n of each."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK // (2 if kind == "token" else 1) + 2)
        base = _BASES[kind]
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            steps = np.full(size, b, U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[kind] = have = (made[0], made[1])
    return have


def give_back() -> None:
    """Give memory that this process doesn't use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives memory back.

    Workers are kept from task to task and stage to stage, with what their allocators hold.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls read as empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    return col.cast(pa.large_string())


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets relative to those bytes) of a large_string array."""
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def tokens(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, tokens before each text) of the maximal runs without separators."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def token_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One 64-bit hash a token, equal for equal bytes wherever they are."""
    n = len(data)
    power, inverse = powers("byte", n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[data] * power[:n], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s])


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of codes[i : i + width] for every i; the last width - 1 positions are left out."""
    n = len(codes)
    if n < width:
        return np.zeros(0, U64)
    power, inverse = powers("token", n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(codes * power[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * inverse[: n - width + 1])


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text number of each token, from the token bounds of the texts."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    step, have = 1, x
    while 2 * step <= width:
        have = np.minimum(have[: len(have) - step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[:n], have[rest : rest + n]) if rest else have[:n]


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Arrow binary array over the bytes of data; offsets count bytes."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
