"""Words of many texts at once, as arrays of hashes.

A batch's texts lie end to end in one buffer. A word's hash is a polynomial in a table value of each of
its bytes, taken as a difference of running sums, so no word is ever cut out as a string.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text, and rows, that are worked on at once; a longer text is worked on alone. Working arrays
#: take some forty times the bytes.
SLICE_BYTES, SLICE_ROWS = (1 << 20) - 1, 4_000
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20))
#: A value for each byte, the same for A-Z and a-z, and which bytes part words.
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_PARTS = np.zeros(256, bool)
_PARTS[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 2**bits of each."""
    tables = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def word_hashes(data: np.ndarray, row_ends: np.ndarray, parting: np.ndarray = _PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in ASCII lower case, and where each text's words end.

    ``data`` holds the bytes of the texts, the last of each before ``row_ends``. Words are runs of bytes
    that do not part words, by default space and 9 to 13, and end with their text.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(row_ends), np.int64)
    inside = ~parting[data]
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[row_ends] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    there, back = _powers(max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * there[: len(data)], out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, row_ends)


def slices(
    batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS, parting: np.ndarray = _PARTS
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, word hashes and word ends of a batch's texts, a slice at a time."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        upto = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1), n)
        hashes, ends = word_hashes(data[offsets[row] : offsets[upto]], offsets[row + 1 : upto + 1] - offsets[row], parting)
        yield row, upto - row, hashes, ends
        row = upto
