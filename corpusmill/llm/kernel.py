"""Vectorised text kernels over whole Arrow batches.

All texts of a batch are laid end to end as one array of code points; folding,
word bounds and polynomial hashes are then a few numpy passes over that array,
whatever the lengths of the single texts. Arithmetic is modulo 2**64 (uint64
wraps around); bases are odd, so their powers have inverses.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE_CHAR = U(0x9E3779B97F4A7C15)
BASE_WORD = U(0xD6E8FEB86659FD93)
BASE_WORD_2 = U(0xC2B2AE3D27D4EB4F)
BASE_WINDOW = U(0xA0761D6478BD642F)
BASE_WINDOW_2 = U(0xE7037ED1A0B428DB)


def inverse(base: np.uint64) -> np.uint64:
    """Inverse of an odd number modulo 2**64."""
    return U(pow(int(base), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between batches."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base, U)
        steps[0] = U(1)
        have = _powers[int(base)] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Per code point 0 for what is skipped, else the folded code point.

    Letters and digits are kept, in lower case; everything else is skipped.
    The few letters whose lower case is longer stand for themselves.
    """
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Per code point a random-looking 64-bit symbol of its folded form."""
    return mix(fold_table().astype(U) + U(1))


def slices(texts: pa.Array, chars: int = 1 << 18) -> list[pa.Array]:
    """The texts in runs of about ``chars`` bytes, so that work fits the caches."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    if not len(size):
        return []
    cuts = np.flatnonzero(np.diff(size // chars)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:])]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, n+1 offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    data = b"" if texts.buffers()[2] is None else memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)
    points = np.frombuffer(bytes(data).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) != len(raw):
        count = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=count[1:])
        offsets = count[offsets]
    return points, offsets


def word_bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of kept characters, not crossing texts."""
    n = len(folded)
    kept = np.zeros(n + 2, bool)
    kept[1:-1] = folded != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(kept[1:-1] & (~kept[:-2] | edge[:-1]))
    ends = np.flatnonzero(kept[1:-1] & (~kept[2:] | edge[1:])) + 1
    return starts, ends


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each span symbols[start:end], by one prefix sum."""
    n = len(symbols)
    sums = np.zeros(n + 1, U)
    np.cumsum(symbols * powers(base, n), out=sums[1:])
    back = powers(inverse(base), n + 1)
    return (sums[ends] - sums[starts]) * back[starts]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of each text, n+1 word offsets of the texts)."""
    points, offsets = code_points(texts)
    starts, ends = word_bounds(np.take(fold_table(), points), offsets)
    hashed = span_hashes(np.take(symbol_table(), points), starts, ends, BASE_CHAR)
    hashed = mix(hashed ^ (ends - starts).astype(U))
    return hashed, np.searchsorted(starts, offsets)


def rolling(symbols: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every window of ``width`` symbols (those that fit the array)."""
    count = max(0, len(symbols) - width + 1)
    at = np.arange(count)
    return mix(span_hashes(symbols, at, at + width, base)) if count else np.zeros(0, U)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; overlapping and touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return starts[first], reach[last]
