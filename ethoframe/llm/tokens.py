"""Words of Arrow batches as numpy arrays, for the operators whose tasks run Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text of one slice of a batch; a longer single text is a slice of its own.
SLICE_BYTES = 1_000_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with bounded text."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, vocabulary, starts): the words between ASCII white space; text i has codes[starts[i]:starts[i + 1]]."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    starts = np.concatenate([[0], np.cumsum(full)])[bounds].astype(np.int64)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), starts


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse modulo 2**64; kept, as every slice needs them."""
    if len(_POWERS[0]) < n:
        inverse = pow(BASE | 1, -1, 1 << 64)
        for i, base in enumerate((BASE | 1, inverse)):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def spans_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[first:last], each a polynomial taken from one running sum over all values."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(MIX[0]))


def hashed(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): 64-bit hashes of the words between ASCII white space, A-Z as a-z if lower is set; text i has hashes[starts[i]:starts[i + 1]]."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True  # a word ends with its text
    edge[:-1] |= ~inside
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    tail &= edge[1:]
    first, last = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return spans_hash(raw.astype(np.uint64) + np.uint64(1), first, last), np.searchsorted(first, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each position on; positions near the end, without so many, are left out."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(BASE | 1)
        out += h[i : i + n]
    return mix(out)


def doc_of(starts: np.ndarray) -> np.ndarray:
    """The text to which each word belongs."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
