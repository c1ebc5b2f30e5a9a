"""Array kernels over Arrow string columns: whole batches of texts at a time, never a Python loop per character.

All of them work on the UTF-8 bytes that Arrow holds. ``slices`` cuts a batch into runs of whole
texts, so that working memory follows ``SLICE_BYTES`` (or the longest text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed64(x: np.ndarray, salt: int) -> np.ndarray:
    return mix64(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 offsets of the texts in them. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
#: The same class of characters for SQL: letters and digits of ASCII, and whatever lies beyond Latin punctuation.
WORD_RE = r"[0-9A-Za-z\x{00C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def word_bytes(data: np.ndarray) -> np.ndarray:
    """True for the bytes of words: ASCII letters and digits and all other characters but U+0080-00BF, U+2000-206F and U+3000-303F."""
    word = _WORD[data]
    if len(data) > 2:
        lead = np.flatnonzero(data[:-1] == 0xC2)
        word[lead] = word[lead + 1] = False
        for first, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
            at = np.flatnonzero(data[:-2] == first)
            if len(at):
                at = at[(data[at + 1] >= low) & (data[at + 1] <= high) & ((data[at + 1] != 0x81) | (data[at + 2] < 0xB0))]
                word[at] = word[at + 1] = word[at + 2] = False
    elif len(data) == 2 and data[0] == 0xC2:
        word[:] = False
    return word


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = word_bytes(data)
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.concatenate(([False], word[:-1]))
    begin = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return begin, end, np.searchsorted(offs, begin, "right") - 1


_BLOCK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to at least n."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = (_powers(size), _powers(size, pow(_BASE, -1, 1 << 64)))
    return _POWERS[size]


def hash_ranges(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range; ranges don't overlap and come in order, none is empty."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, base + _BLOCK, "right")))
        part = data[base : int(end[j - 1])]
        power, inverse = _grid(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[part] * power[: len(part)], out=total[1:])
        s, e = begin[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n hashes in a row; of those that reach into another text the caller takes care."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    weights = _powers(n, 0xD6E8FEB86659FD93)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : i + len(out)] * weights[i]
    return mix64(out)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
