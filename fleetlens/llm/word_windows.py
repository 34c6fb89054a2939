"""Words of many texts at once, as numpy arrays over their bytes, hashes of word windows, and bounded bit filters.

Nothing here loops over words in Python. A word's hash is a polynomial of its
bytes modulo 2**64, mixed; a window's hash is a polynomial of its words' hashes,
mixed, so it does not depend on where the window stands. Two families with other
bases give 128 bits where windows are told apart by hash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers of the two hash families, for bytes and for words; any odd numbers do.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Text bytes that are hashed at a time.
AT_ONCE = 1 << 18
#: log2 of the bits of a filter: 2**28 bits are 32 MB, whatever the input.
FILTER_BITS = 28


_kept_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; one array a base is kept, as long as the longest asked for."""
    kept = _kept_powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(1 << 12, 1 << max(n - 1, 1).bit_length()), base, dtype=np.uint64)
        kept[0] = 1
        _kept_powers[base] = np.multiply.accumulate(kept, out=kept)
    return kept[:n]


@lru_cache(maxsize=None)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(characters, dtype=np.uint8)] = True
    return out


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """The words of some rows: byte ranges, and the first word of each row (with the total at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> "Words":
        """Words are the longest runs of bytes that are not in the table ``apart``; none goes over the end of a row."""
        word = ~apart[data]
        full = offsets[1:] > offsets[:-1]
        head, tail = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        head[offsets[:-1][full]] = True
        tail[offsets[1:][full] - 1] = True
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | head[1:]
        stops[:-1] &= ~word[1:] | tail[:-1]
        starts = np.flatnonzero(begins)
        return cls(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        base = BYTE_BASES[family]
        out = np.empty(len(self), dtype=np.uint64)
        lo = 0
        while lo < len(self):
            begin = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, begin + AT_ONCE, side="right")))
            part = self.data[begin:self.ends[hi - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(inverse(base), len(part)), out=sums[1:])
            a, b = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin
            raw = (sums[b] - sums[a]) * powers(base, len(part) + 1)[a]
            out[lo:hi] = mixed(raw + (b - a).astype(np.uint64) * np.uint64(BYTE_BASES[1 - family]))
            lo = hi
        return out

    def whole(self, hashes: np.ndarray, family: int = 0) -> np.ndarray:
        """A hash of each row's whole sequence of words."""
        sums = _sums(hashes, family)
        a, b = self.first[:-1], self.first[1:]
        return mixed((sums[b] - sums[a]) * powers(WORD_BASES[family], len(hashes) + 1)[a] + (b - a).astype(np.uint64))

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, each followed by one space: (bytes, offset of each word with the total at the end)."""
        lengths = self.ends - self.starts
        at = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        out = gathered(self.data, self.starts, lengths + 1) if len(self) and self.ends[-1] < len(self.data) else gathered(
            np.append(self.data, np.uint8(32)), self.starts, lengths + 1)
        out[at[1:] - 1] = 32
        return out, at


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte ranges, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - before, lengths)]


def _sums(hashes: np.ndarray, family: int) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(inverse(WORD_BASES[family]), len(hashes)), out=sums[1:])
    return sums


def window_hashes(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """The hash of the ``size`` words from each word on; shorter than the input by ``size - 1``."""
    n = max(len(hashes) - size + 1, 0)
    sums = _sums(hashes, family)
    return mixed((sums[size:size + n] - sums[:n]) * powers(WORD_BASES[family], n) + np.uint64(size))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """One list a row, from flat values and their number a row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Bits:
    """Which keys may be in a set: two bits a key, at its highest and its lowest ``FILTER_BITS`` bits.

    A filter holds every key of its set, and others by chance; its size does not
    depend on the set. Where it is used, a key more costs work and changes no result.
    """

    def __init__(self, data: np.ndarray | None = None, log2: int = FILTER_BITS):
        self.log2 = log2
        self.data = np.zeros(1 << (log2 - 3), dtype=np.uint8) if data is None else data

    @classmethod
    def of(cls, keys: DataFrame, column: str = "key", log2: int = FILTER_BITS) -> "Bits":
        """From a table with a 64-bit key; executors make pages of 4 KB, so the driver gets at most the filter's size."""
        places = F.array(F.shiftrightunsigned(F.col(column), 64 - log2), F.col(column).bitwiseAND(F.lit((1 << log2) - 1)))
        place = F.col("place") + 1
        pages = keys.select(F.explode(places).alias("place")).select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit"))
        pages = pages.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        out = cls(log2=log2)
        for row in pages.collect():
            at = (row["page"] - 1) * 4096
            out.data[at:at + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
        return out

    @classmethod
    def _unpacked(cls, packed: bytes, log2: int) -> "Bits":
        return cls(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), log2)

    def __reduce__(self):
        # sent to the workers packed: mostly zeros as long as the set is small against the filter
        return Bits._unpacked, (zlib.compress(self.data.tobytes(), 1), self.log2)

    def __or__(self, other: "Bits") -> "Bits":
        return Bits(self.data | other.data, self.log2)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self._bit(keys >> np.uint64(64 - self.log2))
        some = np.flatnonzero(out)
        out[some] = self._bit(keys[some] & np.uint64((1 << self.log2) - 1))
        return out

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
