"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with up to k edits. Cut into k + 1 pieces, at least one of
them then occurs unchanged. One automaton finds all pieces of all items in a text; the
stretch around every hit is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.session import stored

ERROR_RATE = 0.07  # edits per character of an item
LEAST_CHARS = 20  # shorter items stand in texts by chance
BLOCK_CHARS = 4 << 20  # items are searched in blocks, which bounds each broadcast


_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Lower-case letters and digits, one blank between words."""
    return _OTHER.sub(" ", text.lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their places."""
    n = len(item)
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> list[int]:
    """Least distance of the pattern to a stretch of the text that ends at each place."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, distance, out = full, 0, m, []
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = up << 1 & full  # a match may begin anywhere: no cost comes in from the left
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        out.append(distance)
    return out


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        # blanks at both ends: a match begins and ends with a word, or pays for it
        self.items = [(i, f" {t} ", budget(len(t), rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                found.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best match of every item: item id, distance, begin (approximate) and end in the text."""
        if not len(self.automaton):
            return []
        text = f" {text} "
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            start = end - length + 1
            for number, at in where:
                _, item, edits = self.items[number]
                a, b = max(start - at - edits, 0), start - at + len(item) + edits
                held = stretches.setdefault(number, [])
                if held and held[-1][0] <= a <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], b)
                else:
                    held.append([a, b])
        out = []
        for number, held in stretches.items():
            item_id, item, edits = self.items[number]
            held.sort()
            joined = [held[0]]
            for a, b in held[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            best = None
            for a, b in joined:
                distances = myers(item, text[a:b])
                least = min(distances)
                if least <= edits and (best is None or least < best[0]):
                    end = a + distances.index(least) + 1  # without the blanks at the ends:
                    best = least, max(end - len(item), 0), min(max(end - 2, 0), len(text) - 2)
            if best is not None:
                out.append((item_id, *best))
        return out


def _blocks(items: DataFrame, chars: int, least: int) -> tuple[DataFrame, int]:
    """The items, normalised and stored, dealt by hash to blocks of about ``chars`` characters."""

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normalised(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(texts, pa.string())], ["item_id", "text"])

    known = items.select("item_id", "text").where("text IS NOT NULL")
    known = known.mapInArrow(arrow.per_slice(plain), known.schema).where(F.length("text") >= least).distinct()
    known = stored(known, "items")
    blocks = -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // chars)
    return known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))), blocks


def _matchers(items: DataFrame, rate: float, chars: int, least: int) -> Iterator[Callable[[], Matcher]]:
    """What gives a task the matcher of each block in turn; the driver reads one block at a time."""
    table, blocks = _blocks(items, chars, least)
    for block in range(blocks):
        rows = table.where(F.col("block") == block).orderBy("item_id", "text").collect()
        sent = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])
        key = "matcher", uuid.uuid4().hex
        yield lambda sent=sent, key=key: arrow.held(key, lambda: Matcher(sent.value, rate))


def matches(
    docs: DataFrame,
    items: DataFrame,
    rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, distance, begin, end.

    A text holds an item when a stretch of its words is within ``rate`` edits per
    character, both in lower case with single blanks; a stretch that begins or ends
    inside a word pays an edit for each such end. The best stretch is given (ties: the
    first), as character places in that form. Items of fewer than ``least_chars``
    characters in that form are not looked for. The items are a stated query set,
    broadcast in blocks of about ``block_chars`` characters; documents are read once for
    each block. Whole texts of any length.

    Null or empty texts and items match nothing. Repeated items count once; repeated
    documents come back as often as given; null ids stay null. Empty tables give an
    empty result. Other columns are ignored.
    """
    names = ["doc_id", "item_id", "distance", "begin", "end"]
    schema = "doc_id bigint, item_id bigint, distance int, begin bigint, end bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for matcher in _matchers(items, rate, block_chars, least_chars):

        def rows(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch | None:
            match, out = matcher(), []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    out.extend((doc_id, *m) for m in match(normalised(text)))
            if not out:
                return None
            types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        found = found.union(docs.select("doc_id", "text").mapInArrow(arrow.per_slice(rows), schema))
    return found


def clean(
    docs: DataFrame,
    items: DataFrame,
    rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no item; as for ``matches``.

    Null and empty texts stay. The blocks of items are searched one after the other.
    """
    for matcher in _matchers(items, rate, block_chars, least_chars):

        def rows(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            match = matcher()
            texts = batch.column("text").to_pylist()
            return batch.filter(pa.array([not (t and match(normalised(t))) for t in texts], pa.bool_()))

        docs = arrow.filtered(docs, arrow.per_slice(rows))
    return docs
