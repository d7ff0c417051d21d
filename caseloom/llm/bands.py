"""Quality rules by compression bands.

Repetitive text compresses far better than prose, random or encoded text hardly at
all. A text is kept when the zstandard ratio (bytes before by bytes after) of the
whole text lies inside limits for its length, and when not too many of its
fixed-size chunks lie outside the limits for a chunk. Length-specific limits are
needed because short texts always compress badly and long ones always better.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from caseloom.llm import arrow

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Least and greatest ratio by length: a text belongs to the last band it reaches.

    ``whole`` holds (bytes at least, least ratio, greatest ratio). A chunk shorter
    than ``chunk_bytes`` (the rest of a text) is judged as a whole text of its length.
    Least ratios from 128 bytes lie between those measured for base64 in words or lines
    and for prose; below 128 bytes the two overlap.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 3.0),
        (128, 1.04, 2.5),
        (160, 1.085, 2.5),
        (200, 1.135, 2.5),
        (256, 1.23, 2.5),
        (384, 1.3, 2.5),
        (512, 1.35, 2.8),
        (1024, 1.5, 2.8),
        (2048, 1.5, 3.2),
        (8192, 1.7, 3.6),
        (32768, 1.8, 4.2),
        (131072, 1.8, 5.5),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.4, 3.4)
    bad_chunk_share: float = 0.2
    level: int = 3

    def of(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.array(self.whole)
        row = np.searchsorted(table[:, 0], lengths, "right") - 1
        return table[row, 1], table[row, 2]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of each text."""
    w = arrow.words(texts)
    n = len(w.offsets) - 1
    space = arrow._SPACE[w.data]
    out = {
        "n_words": np.diff(w.bounds),
        "word_chars": arrow.counts_between(~space & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": arrow.counts_between(_SYMBOL[w.data], w.offsets),
    }
    # lines: cut at line feeds and text edges
    feed = w.data == 10
    edges = np.union1d(np.flatnonzero(feed) + 1, w.offsets)
    begin, end = edges[:-1], edges[1:]
    solid = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    has_word = solid[end] > solid[begin]
    fed = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(feed, out=fed[1:])
    line, unique = arrow.dictionary(arrow.binary_array(w.data[~feed], (end - begin) - (fed[end] - fed[begin])))
    doc = np.searchsorted(w.offsets, begin, "right") - 1
    lines = doc[has_word] * np.int64(len(unique)) + line[has_word]
    different = np.unique(lines) // max(len(unique), 1)
    out["n_dup_lines"] = np.bincount(doc[has_word], minlength=n) - np.bincount(different, minlength=n)
    # words in windows found again in the same text
    hashes = arrow.window_hashes(w.hashes(), WINDOW)
    starts = np.flatnonzero(arrow.window_starts(w.bounds, WINDOW))
    word_doc = w.doc
    keys = arrow.mixed(hashes[starts] + word_doc[starts].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, starts[again], 1)
    np.add.at(cover, starts[again] + WINDOW, -1)
    out["n_repeat_words"] = arrow.counts_between(np.cumsum(cover)[:-1] > 0, w.bounds)
    return out


def _sizes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, level: int) -> np.ndarray:
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    view = memoryview(np.ascontiguousarray(data))
    return np.array([len(compressor.compress(view[a:b])) for a, b in zip(begin.tolist(), end.tolist())], np.int64)


def band_verdicts(texts: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    """Ratios of whole texts, share of bad chunks, and whether both are inside the limits."""
    data, offsets = arrow.text_bytes(texts)
    lengths = np.diff(offsets)
    ratio = lengths / np.maximum(_sizes(data, offsets[:-1], offsets[1:], bands.level), 1)
    least, most = bands.of(lengths)
    n_chunks = -(-lengths // bands.chunk_bytes)
    doc = np.repeat(np.arange(len(lengths)), n_chunks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    begin = offsets[:-1][doc] + number * bands.chunk_bytes
    end = np.minimum(begin + bands.chunk_bytes, offsets[1:][doc])
    one = n_chunks[doc] == 1  # the text itself: known already
    sizes = np.zeros(len(doc), np.int64)
    sizes[~one] = _sizes(data, begin[~one], end[~one], bands.level)
    chunk_ratio = np.where(one, ratio[doc], (end - begin) / np.maximum(sizes, 1))
    full = end - begin == bands.chunk_bytes
    low, high = bands.of(end - begin)
    bad = (chunk_ratio < np.where(full, bands.chunk[0], low)) | (chunk_ratio > np.where(full, bands.chunk[1], high))
    share = np.bincount(doc[bad], minlength=len(lengths)) / np.maximum(n_chunks, 1)
    return {
        "ratio": ratio,
        "bad_chunk_share": share,
        "in_band": (ratio >= least) & (ratio <= most) & (share <= bands.bad_chunk_share),
    }


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Base counts, compression ratios and the verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, ratio, bad_chunk_share, kept. One pass without any exchange.

    A null or empty text has zero counts and fails the base rule. Repeated rows come
    back as often as given; a null doc_id stays null; other columns are ignored.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = base_counts(batch.column("text"))
        verdict = band_verdicts(batch.column("text"), bands)
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        columns = {
            "doc_id": batch.column("doc_id"),
            **{name: pa.array(values.astype(np.int64)) for name, values in counts.items()},
            "base_failed": pa.array(failed),
            "ratio": pa.array(verdict["ratio"].astype(float)),
            "bad_chunk_share": pa.array(verdict["bad_chunk_share"].astype(float)),
            "kept": pa.array(verdict["in_band"] & ~failed),
        }
        return pa.RecordBatch.from_pydict(columns)

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"
    )
    return docs.select("doc_id", "text").mapInArrow(arrow.per_slice(rows), schema)
