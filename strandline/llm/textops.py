"""Word rules shared by the operators, as Spark columns and as numpy over Arrow buffers.

Nulls count as empty text everywhere.  Case folding touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Folds case and turns every byte that is no letter, digit or non-ASCII byte into a blank.
ALNUM_FOLD = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

_FOLD_LUT = np.frombuffer(FOLD, np.uint8)
_SPACED_LUT = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def folded(text: Column) -> Column:
    """Text with A-Z in lower case; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes for the Arrow functions; null becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of one odd constant, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


class Words(NamedTuple):
    """Words of a run of texts: text number, byte span within the run, hash of the folded word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray


def chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first text, end, offsets, bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def words_of(offsets: np.ndarray, data: np.ndarray) -> Words:
    """White-space separated words, case folded, with 64-bit hashes, for a run of texts."""
    n, empty = len(data), np.zeros(0, np.int64)
    inside = _SPACED_LUT[data]
    if not inside.any():
        return Words(empty, empty, empty, empty.astype(np.uint64), data)
    low = _FOLD_LUT[data]
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.concatenate((inside[1:], [False]))
    last = offsets[1:] - 1
    after[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    place = np.arange(start[0], n) - np.repeat(start, np.diff(np.append(start, n)))
    length = end - start
    scale = powers(int(max(length.max(), 1)))
    value = _BYTE_KEYS[low[start[0] :]]
    value[~inside[start[0] :]] = 0
    np.minimum(place, len(scale) - 1, out=place)
    value *= scale[place]
    hashed = mix(np.add.reduceat(value, start - start[0]) + length.astype(np.uint64))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, hashed, low)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k + 1)[1:]):
        total += hashes[j : j + n] * p
    return mix(total + np.uint64(k))
