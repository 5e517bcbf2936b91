"""Hashes of words and byte strings over Arrow buffers, by whole-array numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte, with A-Z as a-z; one for each byte as it is; an odd base and its inverse mod 2^64.
LOWER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER[65:91] = LOWER[97:123]
RAW = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are worked on at once.
CHUNK = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) mod 2^64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """Odd random factors of the first n places of a word."""
    global _factors
    if len(_factors) < n:
        _factors = mix(mix(np.arange(1, max(1024, 2 * n) + 1, dtype=np.uint64) * np.uint64(BASE))) | np.uint64(1)
    return _factors


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray):
    """Ranges of rows of about CHUNK bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every lower-cased word of the rows; data starts at offsets[0]."""
    n, offsets = len(data), offsets - offsets[0]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~SPACES[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[cut] |= solid[cut]
    ends[cut - 1] |= solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # A sum of random numbers of bytes by random odd factors of places: not a polynomial, which long words could fool.
    length = end - start
    total = np.cumsum(length)
    place = np.arange(total[-1]) - np.repeat(total - length, length)
    terms = LOWER[data[np.repeat(start, length) + place]] * factors(int(length.max()))[place]
    return mix(np.add.reduceat(terms, total - length) + length.astype(np.uint64)), np.searchsorted(offsets, start, "right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every distinct shingle, by row and hash. Rows with fewer words have one of all their words."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    if len(words) >= width:
        full = np.flatnonzero(rows[width - 1 :] == rows[: len(rows) - width + 1])
        total = np.zeros(len(full), np.uint64)
        for k in range(width):
            total += words[full + k] * factors[k]
        owner = rows[full]
    else:
        total, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.searchsorted(rows, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            on = counts[few] > k
            short[on] += words[first[on] + k] * factors[k]
        total, owner = np.concatenate([total, short + counts[few].astype(np.uint64) * np.uint64(BASE)]), np.concatenate([owner, few])
    total = mix(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[keep], owner[keep]
