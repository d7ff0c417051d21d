"""Offset-preserving encoding with a SentencePiece model, and decoding.

Text is normalised by longest-prefix matches in the model's compiled character map,
noting for each normalised byte the source byte it stems from. The normalised text
is cut at word marks that no piece crosses, each different unit is segmented once by
the sentencepiece library (with the model's own normaliser switched off, since the
text is normalised already), and every piece is projected through the noted
positions to its span of bytes in the original text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from caseloom.llm import arrow
from caseloom.llm.arrow import counts_between
from caseloom.llm.units import UnitCache, unit_array

MARK = "▁".encode()
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
SLICE_BYTES = 1 << 20


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest mapped prefix of ``data[at:]`` and the bytes it takes."""
        if not self.units:
            return None
        found = None
        node = self._below(0, self.units[0])
        for length, byte in enumerate(data[at:], 1):
            node ^= byte
            if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                break
            unit = self.units[node]
            node = self._below(node, unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, length
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]

    @staticmethod
    def _below(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


def _width(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Normaliser:
    """The rules of a model's normaliser specification."""

    def __init__(self, model: sentencepiece_model_pb2.ModelProto):
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = MARK if spec.escape_whitespaces else b" "
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.kept = [p.piece.encode() for p in model.pieces if p.type == USER_DEFINED]
        self.kept.sort(key=len, reverse=True)
        #: only blanks change, one by one: whole slices can be normalised at once
        self.plain = not self.map.units and not self.squeeze and self.prefix and not self.suffix and not self.kept

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        for piece in self.kept:
            if data.startswith(piece, at):
                return piece, len(piece)
        if found := self.map.longest(data, at):
            return found
        width = _width(data[at])
        return data[at : at + width], width

    def __call__(self, data: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes and the source position of each, with the end last."""
        out, source, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (step := self._next(data, at))[0] == b" ":
                at += step[1]
        if at == len(data):
            return b"", [at]

        def put(piece: bytes) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        if self.prefix and not self.suffix:
            put(self.mark)
        blank = self.squeeze
        while at < len(data):
            piece, width = self._next(data, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                for part in (piece[i : i + 1] for i in range(len(piece))):
                    put(self.mark if part == b" " else part)
                blank = piece.endswith(b" ")
            at += width
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while out.endswith(self.mark):
                at = source[len(out) - len(self.mark)]
                del out[-len(self.mark) :], source[-len(self.mark) :]
        if self.prefix and self.suffix:
            put(self.mark)
        return bytes(out), [*source, at]


class Encoder:
    """Ids and source spans of a slice of texts."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.full = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = Normaliser(model)
        # a unit may end before a mark when no piece holds a mark after another character;
        # unknown neighbours are joined by models without byte pieces, so those see whole texts
        pieces = [p.piece for p in model.pieces if p.type in (NORMAL, USER_DEFINED)]
        mark = self.normalise.mark.decode()
        self.by_unit = (
            model.trainer_spec.byte_fallback
            and model.trainer_spec.model_type == 2
            and not self.normalise.suffix
            and not any(mark in p.lstrip(mark) for p in pieces)
        )
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.cache = UnitCache(self._segment, 64 << 20)
        self.begin, self.end = self.full.bos_id(), self.full.eos_id()
        #: normalised bytes of each piece; byte pieces are set apart
        self.size = np.array([len(p.piece.encode()) for p in model.pieces], np.int64)
        self.byte = np.full(len(model.pieces), -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[i], self.size[i] = int(p.piece[1:-1], 16), 0

    def _segment(self, units: list[str]) -> list[list[int]]:
        return self.segmenter.encode(units, num_threads=1)

    def _normalised(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Normalised bytes, their source positions in the slice, text offsets, source offsets, source ends."""
        data, offsets = arrow.text_bytes(texts)
        if self.normalise.plain:
            # every blank becomes a mark; a text that is not empty gets one mark in front
            wide = len(self.normalise.mark)
            copies = np.where(data == 32, np.int8(wide), np.int8(1))
            first = offsets[:-1][np.diff(offsets) > 0]
            copies[first] += wide
            source = np.repeat(np.arange(len(data), dtype=np.int32), copies)
            out = data[source]
            ends = np.cumsum(copies, dtype=np.int32)
            lead = ends[first] - copies[first]
            blanks = np.flatnonzero(data == 32)
            for j, byte in enumerate(self.normalise.mark):
                out[ends[blanks] - wide + j] = byte
                out[lead + j] = byte
            return out, source, np.concatenate([[0], ends])[offsets].astype(np.int64), offsets, offsets[1:]
        parts, sources, lengths, ends = [], [], [], []
        raw = data.tobytes()
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            out, source = self.normalise(raw[a:b])
            parts.append(out)
            sources.append(np.array(source[:-1], np.int32) + np.int32(a))
            lengths.append(len(out))
            ends.append(source[-1] + a)
        edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        out = np.frombuffer(b"".join(parts), np.uint8)
        source = np.concatenate(sources) if sources else np.empty(0, np.int32)
        return out, source, edges, offsets, np.array(ends, np.int64)

    def __call__(self, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, ...]:
        """Ids without begin and end, first id of each text, and byte span of each piece in its text."""
        out, source, edges, offsets, stops = self._normalised(texts)
        cuts = np.zeros(len(out), bool)
        mark = np.frombuffer(self.normalise.mark, np.uint8)
        if self.by_unit and len(out) >= 2 * len(mark):
            hit = np.ones(len(out) - len(mark) + 1, bool)
            for j, byte in enumerate(mark):
                hit &= out[j : j + len(hit)] == byte
            cuts[: len(hit)] = hit
            cuts[len(mark) :] &= ~np.concatenate([hit, np.zeros(len(mark) - 1, bool)])[: len(out) - len(mark)]
        units, first = unit_array(out, edges, cuts)
        ids, lengths = self.cache(units)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
        if not spans:
            return ids, bounds
        size = self.size[ids]
        unknown = ids == self.full.unk_id()
        if unknown.any():  # only the library knows their sizes; only whole texts have them
            for i in np.flatnonzero(counts_between(unknown, bounds)).tolist():
                proto = self.segmenter.encode(out[edges[i] : edges[i + 1]].tobytes().decode(), return_type="proto")
                size[bounds[i] : bounds[i + 1]] = [p.end - p.begin for p in proto.pieces]
        return ids, bounds, *self._spans(ids, bounds, size, source, edges, offsets, stops)

    def _spans(self, ids, bounds, size, source, edges, offsets, stops):
        value = self.byte[ids]
        # the last byte piece of a character stands for it, those before are empty
        lead = np.flatnonzero((value >= 0) & ((value < 0x80) | (value >= 0xC0)))
        width = np.select([value[lead] < 0x80, value[lead] < 0xE0, value[lead] < 0xF0], [1, 2, 3], 4)
        size[lead + width - 1] = width
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        total = np.concatenate([[0], np.cumsum(size)])
        position = edges[:-1][doc] - total[bounds[:-1]][doc]
        begin, end = total[:-1] + position, total[1:] + position
        past = np.append(source, 0)
        stop = stops[doc]
        start = np.where(begin >= edges[1:][doc], stop, past[np.minimum(begin, len(source))])
        finish = np.where(end >= edges[1:][doc], stop, past[np.minimum(end, len(source))])
        return (start - offsets[:-1][doc]).astype(np.int32), (finish - offsets[:-1][doc]).astype(np.int32)


def encoder(path: str) -> Encoder:
    return arrow.held(("pieces", path), lambda: Encoder(path))


#: What ``encode`` can return besides doc_id, n_tokens and the two digests.
EXTRA = {
    "covered_bytes": "bigint", "ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string"
}


def encode(docs: DataFrame, model: str, extra: Sequence[str] = tuple(EXTRA)) -> DataFrame:
    """Ids, source spans and decoded text of every document.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 and what ``extra`` names: covered_bytes (source bytes
    inside the spans), ids, begins and ends (byte spans in the source; the begin and end
    ids have empty spans), decoded. Spans are only worked out where they are asked for.
    ``model`` is the path of a model file, which every worker has. One pass without any
    exchange; whole texts, about a megabyte of them at a time.

    A null text is encoded as an empty one: begin and end id only. Repeated rows come
    back as often as given, a null doc_id stays null, other columns are ignored.
    """

    spans = bool({"covered_bytes", "begins", "ends"} & {*extra})

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(model)
        ids, bounds, *places = e(batch.column("text"), spans)
        n = np.diff(bounds)
        # put begin and end ids around each text
        at = bounds[:-1] + 2 * np.arange(len(n))
        full = np.empty(len(ids) + 2 * len(n), np.int32)
        inner = np.ones(len(full), bool)
        inner[at] = inner[at + n + 1] = False
        full[inner], full[at], full[at + n + 1] = ids, e.begin, e.end
        edges = np.append(at, len(full))
        raw = memoryview(full.astype("<u4")).cast("B")
        digests, decoded = [], []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            text = e.full.decode(full[a:b].tolist())
            digests.append((hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            if "decoded" in extra:
                decoded.append(text)
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(np.diff(edges)),
            "ids_sha256": pa.array([d[0] for d in digests], pa.string()),
            "decoded_sha256": pa.array([d[1] for d in digests], pa.string()),
        }
        lists = pa.array(edges.astype(np.int32))

        def around(values: np.ndarray, last: np.ndarray | int) -> pa.Array:
            whole = np.zeros(len(full), np.int32)
            whole[inner], whole[at + n + 1] = values, last
            return pa.ListArray.from_arrays(lists, pa.array(whole))

        if spans:
            begins, ends = places
            length = np.where(n > 0, np.append(ends, 0)[bounds[1:] - 1], 0)
        make = {
            "covered_bytes": lambda: pa.array(np.diff(np.concatenate([[0], np.cumsum(ends.astype(np.int64) - begins)])[bounds])),
            "ids": lambda: pa.ListArray.from_arrays(lists, pa.array(full)),
            "begins": lambda: around(begins, length),
            "ends": lambda: around(ends, length),
            "decoded": lambda: pa.array(decoded, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns | {name: make[name]() for name in extra})

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", {name} {EXTRA[name]}" for name in extra)
    return docs.select("doc_id", "text").mapInArrow(arrow.per_slice(rows, limit=SLICE_BYTES), schema)
