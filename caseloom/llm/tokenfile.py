"""Token ids as directly addressable codes in binary files.

Every id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id,
level 1 the next chunk of those ids that need one, and so on. A bitmap per level says
which ids continue, and a rank directory counts its set bits before every 512th
one. So the i-th id is found from one chunk, one bitmap block and one directory entry
per level, without decoding its neighbours; ids below 256 take 9 bits.

Layout of a file, little-endian::

    magic "CLDAC1\\0\\0" | per level: chunks, bitmap (whole 64-byte blocks), ranks (uint64)
    | document ids (int64), null flags (uint8), document starts (int64, one more)
    | footer: documents, ids, levels, then offset and number of chunks of each level,
      offset of the documents (all int64) | length of the footer (int64) | magic

Files are named by the tables that list them, so what a lost or repeated task has
left is never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.llm.units import UnitCache, unit_array
from caseloom.session import new_folder, stored

MAGIC = b"CLDAC1\0\0"
BLOCK = 512  # bits of a bitmap between two entries of its rank directory
FILE_TOKENS = 4 << 20
READ_TASKS = 20_000


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The content of a file; ``starts`` has the first id of each document and the end."""
    parts, at, levels = [MAGIC], len(MAGIC), []

    def put(array: np.ndarray) -> None:
        nonlocal at
        parts.append(array.tobytes())
        at += array.nbytes

    rest = ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        levels.append((at, len(rest)))
        put((rest & 0xFF).astype(np.uint8))
        blocks = -(-len(rest) // BLOCK)
        bitmap = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        put(bitmap)
        counts = np.bitwise_count(bitmap.reshape(blocks, -1)).sum(axis=1, dtype=np.uint64)
        put(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8"))
        rest = rest[more] >> 8
    documents = at
    put(np.array([d or 0 for d in doc_ids], "<i8"))
    put(np.array([d is None for d in doc_ids], np.uint8))
    put(starts.astype("<i8"))
    footer = [len(doc_ids), len(ids), len(levels), *(x for level in levels for x in level), documents]
    end = struct.pack(f"<{len(footer)}q", *footer)
    return b"".join([*parts, end, struct.pack("<q", len(end)), MAGIC])


class TokenFile:
    """Random access to a file through ``read(offset, length)``."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        (length,), tail = struct.unpack("<q", self._bytes(size - 16, 8)), self._bytes(size - 8, 8)
        if tail != MAGIC:
            raise ValueError("not a token file")
        footer = struct.unpack(f"<{length // 8}q", self._bytes(size - 16 - length, length))
        self.documents, self.tokens, count = footer[:3]
        self.levels = [footer[3 + 2 * i : 5 + 2 * i] for i in range(count)]
        self.at = footer[-1]

    def _bytes(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def _bitmap(self, level: int) -> tuple[int, int]:
        at, n = self.levels[level]
        blocks = -(-n // BLOCK)
        return at + n, at + n + blocks * BLOCK // 8

    def _rank(self, level: int, i: int) -> int:
        """Set bits before the i-th."""
        bitmap, ranks = self._bitmap(level)
        block = i // BLOCK
        if block * BLOCK >= self.levels[level][1]:
            block -= 1
        before = struct.unpack("<Q", self._bytes(ranks + 8 * block, 8))[0]
        bits = np.unpackbits(
            np.frombuffer(self._bytes(bitmap + block * BLOCK // 8, BLOCK // 8), np.uint8), bitorder="little"
        )
        return before + int(bits[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (at, _) in enumerate(self.levels):
            value |= self._bytes(at + i, 1)[0] << 8 * level
            if not self._bytes(self._bitmap(level)[0] + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` up to ``end``: one run of chunks per level."""
        out = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        for level, (at, _) in enumerate(self.levels):
            if end <= begin:
                break
            chunk = np.frombuffer(self._bytes(at + begin, end - begin), np.uint8)
            out[where] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            low = begin // 8
            packed = self._bytes(self._bitmap(level)[0] + low, -(-end // 8) - low)
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
            more = bits[begin - 8 * low : end - 8 * low].astype(bool)
            where = where[more]
            begin = self._rank(level, begin)
            end = begin + len(where)
        return out

    def index(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids, and where each document starts, with the end."""
        n = self.documents
        ids = np.frombuffer(self._bytes(self.at, 8 * n), "<i8").tolist()
        null = self._bytes(self.at + 8 * n, n)
        starts = np.frombuffer(self._bytes(self.at + 9 * n, 8 * (n + 1)), "<i8")
        return [None if null[i] else d for i, d in enumerate(ids)], starts


# The printable stand-ins that byte-level vocabularies use for bytes.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_IN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
# units that the splitting pattern leaves whole: letters, or signs other than the apostrophe
_WHOLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[!-&(-/:-@\[-`{-~]+").fullmatch


def _stood_in(unit: str) -> str:
    if unit.isascii():  # only the blank has a stand-in then
        return unit.replace(" ", _STAND_IN[32])
    return unit.encode().decode("latin-1").translate(_STAND_IN)


class Tokeniser:
    """Ids of a slice of texts with a byte-level vocabulary of the tokenizers library.

    A text may be cut before white space that follows a visible character, and between a
    letter and a sign: no match of the vocabulary's splitting pattern reaches over such a
    place. Units that are one match go straight to the library's merge model.

    The library takes added tokens (such as an end-of-text marker) out of a text first: each
    is a unit of its own, and so is a whole text with one that also takes its surroundings.
    With ``literal`` special ones are plain text.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (literal and t.special)]
        self.added = {t.content for t in added}
        longest = sorted((c.encode() for c in self.added), key=len, reverse=True)
        self.find = re.compile(b"|".join(map(re.escape, longest))) if added else None
        self.apart = not self.tokenizer.normalizer and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.cache = UnitCache(self._encode)
        # marked tokens and settings would apply to whole units, too
        self.direct = not self.tokenizer.normalizer and self.tokenizer.model.dropout is None

    def _encode(self, units: list[str]) -> list[list[int]]:
        merge = self.tokenizer.model.tokenize
        whole = [bool(_WHOLE(u)) and u not in self.added for u in units] if self.direct else [False] * len(units)
        rest = [u for u, w in zip(units, whole) if not w]
        other = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [
            [t.id for t in merge(_stood_in(u))] if w else next(other).ids
            for u, w in zip(units, whole)
        ]

    def _found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Added tokens, leftmost and longest first: begin, end and number of the text."""
        raw, at = data.tobytes() if self.find else b"", 0
        while self.find and (match := self.find.search(raw, at)):
            begin = match.start()
            text = int(np.searchsorted(offsets, begin, "right")) - 1
            match = self.find.match(raw, begin, int(offsets[text + 1]))  # not into the next text
            at = match.end() if match else begin + 1
            if match:
                yield begin, at, text

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = arrow.text_bytes(texts)
        cuts = np.zeros(len(data), bool)
        # visible: printable ASCII, or the end of a two-byte letter (none of those is white
        # space from lead byte C3 on); after other characters the text is simply not cut
        visible = (data > 0x20) & (data < 0x7F)
        visible[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cuts[1:] = arrow._SPACE[data[1:]] & visible[:-1]
        capital, small = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        letter = capital | small
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        sign = (data > 0x20) & (data < 0x7F) & ~capital & ~small & ~((data >= 48) & (data <= 57))
        cuts[1:] |= sign[1:] & letter[:-1]
        for begin, end, text in self._found(data, offsets):
            if self.apart:
                cuts[begin + 1 : end] = False
                cuts[begin] = True
                cuts[end : end + 1] = True
            else:
                cuts[offsets[text] + 1 : offsets[text + 1]] = False
        units, first = unit_array(data, offsets, cuts)
        ids, lengths = self.cache(units)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[first]


def tokeniser(path: str, literal: bool = True) -> Tokeniser:
    return arrow.held(("tokens", path, literal), lambda: Tokeniser(path, literal))


def write_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order.

    One exchange by ranges of doc_id; each task writes files of about ``file_tokens``
    ids. Returns the stored list of files: part, number, path, documents, tokens.

    Ids are those of the library as it loads the vocabulary: special tokens in a text keep
    their id. A null text is empty (its end id alone). Null doc_ids come first; rows with one
    doc_id are ordered by a hash of their text, so that even a doc_id with a third of
    all rows is spread over files; equal rows are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]

    def write(batches):
        system, base = fs.FileSystem.from_uri(folder)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []

        def flush():
            nonlocal number
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            path = f"{base}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(pack(np.concatenate(ids), doc_ids, starts))
            row = [part], [number], [path], [len(doc_ids)], [int(starts[-1])]
            number += 1
            ids.clear(), doc_ids.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "number", "path", "documents", "tokens"],
            )

        encode = tokeniser(vocabulary, literal=False)
        for batch in arrow.sliced(batches):
            inner, bounds = encode(batch.column("text"))
            n = np.diff(bounds)
            last = bounds[1:] + np.arange(len(n))
            full = np.full(len(inner) + len(n), end_id, np.uint32)
            body = np.ones(len(full), bool)
            body[last] = False
            full[body] = inner
            ids.append(full)
            sizes.append(n + 1)
            doc_ids.extend(batch.column("doc_id").to_pylist())
            if sum(map(len, ids)) >= file_tokens:
                yield flush()
        if doc_ids:
            yield flush()

    schema = "part int, number int, path string, documents bigint, tokens bigint"
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select("doc_id", "text").mapInArrow(write, schema), "token-files")


def read_tokens(files: DataFrame, folder: str, arrays: bool = False) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, ids_crc32, with ``arrays`` also ids.

    ``start`` counts the ids of all documents before; the running sum has one row per file.
    """
    placed = files.withColumn(
        "start", F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )

    def read(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(path) as file:
                    tokens = TokenFile(file)
                    doc_ids, starts = tokens.index()
                    ids = tokens.range(0, tokens.tokens)
                raw = memoryview(ids.astype("<u4")).cast("B")
                edges = starts.tolist()
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(starts[:-1] + first),
                    pa.array(np.diff(starts)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])], pa.int64()),
                ]
                if arrays:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * arrays]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * arrays
    tasks = max(1, min(files.count(), READ_TASKS))  # a row is a whole file: small rows, much work
    return placed.select("path", "start").repartition(tasks, "path").mapInArrow(read, schema)


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write all texts as token files in the shared folder and read their index back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, end_id, folder), folder)
