"""Elias-Fano sequences in numpy: monotone integers as low bits side by side and high bits in unary, on memory that may be a mapped file.

The queries work on whole arrays: value by position (select on ones), position range of a high part (select on zeros), successor search of values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_WORD = np.dtype("<u8")
#: Bits that one unaligned read of a word surely holds.
WIDEST = 56


def _low_bits(universe: int, n: int) -> int:
    return min(WIDEST, max(0, (universe // max(n, 1)).bit_length() - 1))


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, side by side, lowest first; 8 spare bytes let any place be read as a word."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    out, step = [], 8 * (1 << 15)  # whole bytes at every block's end
    for at in range(0, len(values), step):
        block = values[at : at + step].astype(np.uint64)
        bits = (block[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def _bits_at(data: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """width bits from each place on."""
    if not width:
        return np.zeros(len(place), np.int64)
    words = np.ndarray(shape=(len(data) - 7,), dtype=_WORD, buffer=data, strides=(1,))
    return ((words[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _byte_table() -> np.ndarray:
    """Place of the k-th one of each byte, by 8 * byte + k; 0 where there is none."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(places)] = places
    return table.ravel()


_IN_BYTE = _byte_table()
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th one (from 0) of each word: running counts of its bytes in one product, then a table for the byte."""
    rank = rank.astype(np.uint64)
    ones = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    ones = (ones & np.uint64(0x3333333333333333)) + ((ones >> np.uint64(2)) & np.uint64(0x3333333333333333))
    ones = ((ones + (ones >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    byte = (((((rank * _EACH) | _TOP) - ones) & _TOP) >> np.uint64(7)) * _EACH >> np.uint64(56) << np.uint64(3)
    rank -= (ones << np.uint64(8)) >> byte & np.uint64(0xFF)
    return (byte + _IN_BYTE[((word >> byte & np.uint64(0xFF)) << np.uint64(3)) + rank].astype(np.uint64)).astype(np.int64)


@dataclass
class EliasFano:
    """n monotone values below universe. ones and zeros count the set and unset bits before each word of high."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Of ascending values from 0 to universe - 1; they may repeat."""
        n, width = len(values), _low_bits(universe, len(values))
        values = values.astype(np.uint64)
        bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(_WORD)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), high, ones, 64 * np.arange(len(high)) - ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        (n, width), low, high, ones, zeros = parts
        return cls(int(n), int(width), low, high, ones, zeros)

    def _select(self, counts: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        at = np.searchsorted(counts, rank, side="right") - 1
        word = self.high[at]
        return 64 * at + _select_in_word(~word if flip else word, rank - counts[at])

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at positions from 0 to n - 1."""
        upper = self._select(self.ones, at, False) - at
        return (upper << self.width) | _bits_at(self.low, at * self.width, self.width)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first position of each value, or -1: zeros bound the bucket of its high part, whose low parts are searched by halves."""
        found = np.full(len(values), -1, np.int64)
        upper = values >> self.width
        todo = np.flatnonzero((values >= 0) & (upper < self._last_zeros())) if self.n else np.zeros(0, np.int64)
        if not len(todo):
            return found
        upper, want = upper[todo], values[todo] & ((1 << self.width) - 1)
        high = self._select(self.zeros, upper, True) - upper
        low = np.zeros(len(todo), np.int64)
        later = upper > 0
        low[later] = self._select(self.zeros, upper[later] - 1, True) + 1 - upper[later]
        some = low < high
        todo, low, high, want = todo[some], low[some], high[some], want[some]
        last = high
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            less = _bits_at(self.low, middle * self.width, self.width) < want[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high = high.copy() if high is last else high
            high[open_] = np.where(less, high[open_], middle)
        inside = np.flatnonzero(low < last)
        hit = inside[_bits_at(self.low, low[inside] * self.width, self.width) == want[inside]]
        found[todo[hit]] = low[hit]
        return found

    def _last_zeros(self) -> int:
        return int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))


ALIGN = 8


def write(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file: their number, kinds and sizes, then their bytes. It appears under its name when it is whole, so a repeated task does no harm."""
    import os
    import uuid

    kinds = {"|u1": 1, "<u2": 2, "<i8": 3, "<u8": 4}
    header = [len(arrays)]
    for a in arrays:
        header += [kinds[a.dtype.str], len(a)]
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(np.array(header, np.int64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % ALIGN))
    os.replace(draft, path)


def read(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped: only the pages that are used are read."""
    data = np.memmap(path, np.uint8, "r")
    n = int(data[:8].view(np.int64)[0])
    header = data[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in header.tolist():
        dtype = np.dtype({1: "u1", 2: "<u2", 3: "<i8", 4: "<u8"}[kind])
        out.append(np.asarray(data[at : at + size * dtype.itemsize]).view(dtype))
        at += size * dtype.itemsize + -size * dtype.itemsize % ALIGN
    return out
