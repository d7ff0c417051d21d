"""Texts in Arrow batches as byte, word and hash arrays.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return; UTF-8 never uses these bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def sliced(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``limit`` text bytes.

    Bounds the memory of a task by its longest text rather than by a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins, with the end last; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of the texts of a slice, in order."""

    data: np.ndarray  # bytes of the texts
    offsets: np.ndarray  # of each text in data, with the end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # number of the first word of each text, with the end
    ids: np.ndarray  # number of each word among the different words of the slice
    unique: pa.Array  # the different words, as binary

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word."""
        table = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.unique.to_numpy(zero_copy_only=False)], np.uint64)
        return table[self.ids] if len(table) else np.empty(0, np.uint64)


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as an Arrow array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def dictionary(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each piece among the different ones, and these."""
    encoded = pieces.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    before = np.empty(len(solid) + 1, bool)  # a word may begin here: blank or text edge before
    before[0], before[1:] = True, ~solid
    before[offsets] = True
    starts = np.flatnonzero(solid & before[:-1])
    # a word ends where the next byte is blank or belongs to the next text
    after = np.empty(len(solid) + 1, bool)
    after[-1], after[:-1] = True, ~solid
    after[offsets] = True
    ends = np.flatnonzero(solid & after[1:]) + 1
    ids, unique = dictionary(binary_array(data[solid], ends - starts))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), ids, unique)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finish 64-bit sums so that all their bits depend on all inputs."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int, multiplier: np.uint64 = _MULTIPLIER) -> np.ndarray:
    """Hash of each run of ``size`` values; runs across texts are for the caller to leave out."""
    n = max(len(hashes) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total *= multiplier
        total += hashes[j : j + n]
    return mixed(total)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows of ``window_hashes`` lie inside one text."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words from here to the text's end
    return left[: max(n - size + 1, 0)] >= size


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def per_slice(
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` on bounded slices, for ``mapInArrow``."""

    def run(batches):
        for piece in sliced(batches, column, limit):
            if (out := function(piece)) is not None:
                yield out

    return run


def filtered(docs, function: Callable):
    """``docs`` through a function that only leaves out rows; column names may hold any signs."""
    plain = docs.toDF(*(name if name == "text" else f"c{i}" for i, name in enumerate(docs.columns)))
    return plain.mapInArrow(function, plain.schema).toDF(*docs.columns)


_HELD: dict = {}


def held(key, make: Callable):
    """A value that a worker keeps between batches, until another key asks for its own.

    Workers go on to later stages, and should not carry the models of earlier ones there.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def crc_mod(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor``, as a column."""
    from pyspark.sql import functions as F

    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % divisor
