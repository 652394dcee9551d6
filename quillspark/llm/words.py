"""Words, their 64-bit hashes and hashed shingles: the numpy kernels the corpus operators share.

A word is `[^\\x20\\x09-\\x0D]+`; on UTF-8 bytes that is exactly what bytes.split() gives.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
#: A-Z to a-z on UTF-8 bytes, all else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """word bytes -> 64-bit hash; starts anew when it holds `limit` words, so its memory is bounded."""

    def __init__(self, limit: int = 250_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of n words, in order; none if there are fewer words."""
    size = len(h) - n + 1
    if size < 1:
        return h[:0]
    acc = np.zeros(size, np.uint64)
    for j in range(n):
        acc = mix(acc + _MULT[j % len(_MULT)] + h[j : j + size])
    return acc


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted; with fewer words the whole sequence as one, without words none."""
    if 0 < len(h) < n:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, n))


#: Random 64-bit numbers by place in a word (the first 64) and byte; a word's hash is their sum. Later places are mixed in place.
_PLACES = 64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.frombuffer(LOWER, np.uint8)


def _place_table() -> np.ndarray:
    return mix(mix(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0x51ED270B)) + np.uint64(1))


_TABLE = _place_table()


def word_hashes(data: np.ndarray, borders: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, code points) of each word in UTF-8 `data`; no word reaches over a border (a place in `data`, in order)."""
    dark = ~_BLANK[data]
    begin = dark.copy()
    begin[1:] &= ~dark[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    begin[inner] = dark[inner]
    at = np.flatnonzero(dark)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts = np.flatnonzero(begin[at])
    sizes = np.diff(firsts, append=len(at))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(firsts.astype(np.int32), sizes)
    letters = data[at]
    points = sizes if letters.max() < 128 else np.add.reduceat((letters & 0xC0) != 0x80, firsts, dtype=np.int64)
    if lower:
        letters = _LOW[letters]
    far = np.flatnonzero(place >= _PLACES) if sizes.max() > _PLACES else None
    late = place[far] if far is not None else None
    if far is not None:
        place[far] = 0
    values = _TABLE[(place << 8) | letters]
    if far is not None:
        values[far] = mix(mix(late.astype(np.uint64) << np.uint64(8) | letters[far]) + np.uint64(0x51ED270B))
    return mix(np.add.reduceat(values, firsts)), at[firsts], points


def hashed_texts(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch, in runs of at most `most` bytes of text (or one row), with the hashes of each text's words (A-Z lower-cased), in order."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        if not len(column):
            yield batch, []
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            end = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1), batch.num_rows)
            borders = offsets[start : end + 1] - offsets[start]
            hashes, first, _ = word_hashes(data[offsets[start] : offsets[end]], borders)
            yield batch.slice(start, end - start), np.split(hashes, np.searchsorted(first, borders[1:-1]))
            start = end
    release()


def release() -> None:
    """Give memory that is no longer used back to the system, as idle workers live on beside other operators' workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def byte_rows(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch, in runs of at most `most` bytes of text (or one row), with its texts as UTF-8 bytes (null: None)."""
    for batch in batches:
        start, column = 0, batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            part = batch.slice(start, end - start)
            yield part, column.slice(start, end - start).to_pylist()
            start = end
    release()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Numpy parts as one Arrow list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
