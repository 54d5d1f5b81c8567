"""Byte-level helpers shared by the text operators.

Everything here works on a *block*: the UTF-8 bytes of several whole texts laid
end to end in one ``uint8`` array, with ``starts`` (length n + 1) marking where
each text begins.  Blocks are bounded by bytes, never by cutting a text, so a
worker's memory is bounded by the block size or its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 19
_MIX_1, _MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLDEN = U64(0x9E3779B97F4A7C15)
_LENGTH_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither letters nor digits nor part of a longer UTF-8 character.
PUNCTUATED = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Lower-cases A-Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_1
    x ^= x >> U64(27)
    x *= _MIX_2
    x ^= x >> U64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(1 << 32)) * _GOLDEN)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of a string or binary column without a copy per row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[starts[0] : starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each; a longer text is a range of its own."""
    n, a = len(starts) - 1, 0
    while a < n:
        b = int(np.searchsorted(starts, starts[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, text number) of every word; a word is a run of bytes that are not separators."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    solid = ~separators[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[starts] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | breaks[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | breaks[1:n]
    first = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - first
    return first, length, np.searchsorted(starts, first, side="right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word's bytes, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = mix(eights[first] & _LENGTH_MASKS[np.minimum(length, 8)] ^ (length.astype(np.uint64) * _GOLDEN))
    at, k = np.flatnonzero(length > 8), 8
    while len(at):
        h[at] = mix(h[at] * _GOLDEN ^ (eights[first[at] + k] & _LENGTH_MASKS[np.minimum(length[at] - k, 8)]))
        k += 8
        at = at[length[at] > k]
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of any byte range from prefix sums."""

    def __init__(self, seed: int):
        numbers = random_words(seed, 257)
        self.codes, base = numbers[:256], int(numbers[256]) & ~7 | 5
        self.base, self.inverse_base = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, by in (("up", self.base), ("down", self.inverse_base)):
                steps = np.full(n, by, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums whose differences hash byte ranges; see ``ranges``."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[begin:end], equal for equal bytes wherever they stand."""
        return mix((prefix[end] - prefix[begin]) * self.down[begin] ^ (end - begin).astype(np.uint64) * _GOLDEN)
