"""Numpy kernels for tasks: words, rolling hashes and local minima over Arrow text batches.

All hashes are polynomials modulo 2**64 over random per-symbol values, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 21
WORDS = np.ones(256, bool)
WORDS[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95))


BYTE_VALUES = seeded(256, 7)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + 1)
        have = np.full(size, base, U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def prefix(values: np.ndarray) -> np.ndarray:
    """H[i]: hash of the first i values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def span(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever it stands."""
    return mix((h[end] - h[start]) * powers(INVERSE, len(h))[start])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` values."""
    n = len(h) - size
    if n <= 0:
        return np.zeros(0, U)
    return mix((h[size:] - h[:-size]) * powers(INVERSE, n)[:n])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of column text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffer_of(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts + 1]]  # a row ends within a word and the next begins with one
    starts[both] = True
    ends[both] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span(prefix(BYTE_VALUES[data]), s, e)


def sliding_min(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` keys."""
    out, have = keys, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share their local minimum.

    Each window of `size` values names the leftmost of its `gram`-long pieces with the least
    hash; equal windows name the same place. first: the n + 1 value offsets of the rows.
    Returns for each run its first window start, its number of windows and the named place.
    """
    none = np.zeros(0, np.int64)
    n = int(first[-1])
    if n < size:
        return none, none, none
    keys = ((windows(h, gram) >> U(31)) << U(31)) | np.arange(n - gram + 1, dtype=U)
    place = (sliding_min(keys, size - gram + 1) & U((1 << 31) - 1)).astype(np.int64)
    del keys
    valid = np.zeros(len(place) + 1, np.int32)
    lo, hi = first[:-1], first[1:] - size + 1
    ok = hi > lo
    np.add.at(valid, lo[ok], 1)
    np.add.at(valid, hi[ok], -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    new[lo[ok]] = True
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    return starts, stop - starts, place[starts]


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row in which value `at` stands."""
    return np.searchsorted(first, at, "right") - 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def combine(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    return np.unique(keys, return_counts=True)


def tallies(pieces: Iterator[np.ndarray], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of many pieces with their counts, combined within bounded memory."""
    keys, counts, held = [], [], 0
    for piece in pieces:
        k, c = combine(piece)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > most:
            k, c = _merged(keys, counts)
            if len(k) > most // 2:
                yield k, c
                keys, counts, held = [], [], 0
            else:
                keys, counts, held = [k], [c], len(k)
    if held:
        yield _merged(keys, counts)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_keys, -1 where it isn't there."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)
