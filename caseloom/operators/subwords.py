"""Byte-pair style sub-words: learning merges from word counts, encoding and decoding.

Merges are learned on the distinct words. A round counts adjacent symbols by one
aggregate, cuts the words between symbols that are rarely neighbours, and merges the
different pieces one pair at a time while the best pair is more frequent than any that
was cut, so the result is that of merging one pair at a time, in far fewer passes.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.columns import as_column
from caseloom.operators.sequences import END_ID, FIRST_ID, PAD_ID, UNKNOWN_ID
from caseloom.session import stored

#: Ends every word; a text that holds it has it replaced.
END = "␟"
REPLACED = "�"
#: Pairs looked at in a round.
CANDIDATES = 256
#: Frequent pairs, and different pieces of words, that the driver holds in a round.
FREQUENT_PAIRS = 16_384
PIECES = 100_000
#: Merges up to which words are rewritten by expressions; beyond it they are encoded.
FEW_MERGES = 32
#: Distinct words a task keeps encoded.
KEPT_WORDS = 100_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 4 << 20


def clean(text: Column | str) -> Column:
    """The words of a text with one blank between, and no end mark of its own."""
    plain = F.replace(as_column(text), F.lit(END), F.lit(REPLACED))
    # every run of white space but a single blank
    return F.trim(F.regexp_replace(plain, r"[\t\n\x0b\f\r]\s*| \s+", " "))


def word_counts(df: DataFrame, text: Column | str) -> DataFrame:
    """Columns word and n; words are what white space separates."""
    words = df.select(F.explode(F.split(clean(text), " ")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _symbols(word: Column) -> Column:
    """A word as symbols, each with a blank on both sides: its characters and the end mark."""
    return F.concat(F.lit(" "), F.regexp_replace(word, "(?s)(.)", "$1 "), F.lit(f"{END} "))


def _pairs(table: DataFrame) -> DataFrame:
    """How often each two symbols stand next to each other: left, right, n."""
    parts = table.select("n", F.split(F.trim("symbols"), " ").alias("s")).where(F.size("s") > 1)
    later = F.size("s") - 1
    both = F.zip_with(F.slice("s", F.lit(1), later), F.slice("s", F.lit(2), later), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return parts.select("n", F.explode(both).alias("p")).groupBy("p").agg(F.sum("n").alias("n")).select("p.*", "n")


def _literal(text: str) -> str:
    return re.sub(r"([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])", r"\\\1", text)


def _merged(symbols: Column, left: str, right: str) -> Column:
    """All places where the two symbols meet, from left to right, made one symbol."""
    joined = (left + right).replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(symbols, f"(?<= ){_literal(left)} {_literal(right)}(?= )", joined)


def _round(table: DataFrame, least: int) -> list[tuple[str, str, int]]:
    """The merges of a round, in order.

    A merge is taken along when its symbols are in no earlier merge of the round (so its
    count stays) and it is more frequent than any pair that these can newly form (a new
    pair is at most as frequent as the pair of symbols it hides).
    """
    pairs = stored(_pairs(table), "pairs")
    top = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(CANDIDATES)
    before = pairs.groupBy("right").agg(F.max("n").alias("before")).withColumnRenamed("right", "symbol")
    after = pairs.groupBy("left").agg(F.max("n").alias("after")).withColumnRenamed("left", "symbol")
    top = top.join(before, F.col("left") == before.symbol, "left").drop("symbol")
    top = top.join(after, F.col("right") == after.symbol, "left").drop("symbol")
    rows = top.orderBy(F.desc("n"), "left", "right").collect()
    taken, used, bound = [], set(), 0
    for r in rows:
        alone = r.left == r.right  # hides itself: nothing may be taken along
        if taken and (alone or {r.left, r.right} & used or r.n <= bound):
            break
        taken.append((r.left, r.right, r.n))
        used |= {r.left, r.right}
        bound = max(bound, min(r.n, max(r.before or 0, r.after or 0)))
        if alone:
            break
    return taken


def _pieces(table: DataFrame, frequent: set[tuple[str, str]]) -> DataFrame:
    """Symbols and n, added up, of the parts of all rows in which all neighbours are frequent pairs."""
    sent = table.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sent.value
        for batch in batches:
            out, counts = [], []
            for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                parts, begin = symbols.split(" "), 0
                for i in range(1, len(parts) + 1):
                    if i == len(parts) or (parts[i - 1], parts[i]) not in pairs:
                        if i - begin > 1:
                            out.append(" ".join(parts[begin:i]))
                            counts.append(n)
                        begin = i
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["symbols", "n"])

    found = table.select(F.trim("symbols").alias("symbols"), F.col("n").cast("bigint")).mapInArrow(cut, "symbols string, n bigint")
    return found.groupBy("symbols").agg(F.sum("n").alias("n"))


def _one_at_a_time(pieces: list[tuple[list[str], int]], most: int, floor: int) -> list[tuple[str, str, int]]:
    """Merges of the pieces, the most frequent pair first, while it occurs ``floor`` times."""
    count: Counter[tuple[str, str]] = Counter()
    where = defaultdict(set)
    for i, (symbols, n) in enumerate(pieces):
        for pair in zip(symbols, symbols[1:]):
            count[pair] += n
            where[pair].add(i)
    heap = [(-n, *pair) for pair, n in count.items() if n >= floor]
    heapify(heap)
    taken = []
    while heap and len(taken) < most:
        n, left, right = heappop(heap)
        if count[left, right] != -n:
            continue  # has changed and lies in the heap again
        taken.append((left, right, -n))
        changed = set()
        for i in where.pop((left, right)):
            symbols, n = pieces[i]
            new = _joined(symbols, left, right)
            if len(new) == len(symbols):
                continue
            for pair in zip(symbols, symbols[1:]):
                count[pair] -= n
                changed.add(pair)
            for pair in zip(new, new[1:]):
                count[pair] += n
                where[pair].add(i)
                changed.add(pair)
            pieces[i] = new, n
        for pair in changed:
            if count[pair] >= floor:
                heappush(heap, (-count[pair], *pair))
    return taken


def _joined(symbols: list[str], left: str, right: str) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        if symbols[i] == left and i + 1 < len(symbols) and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _long_round(table: DataFrame, most: int, least: int) -> tuple[list[tuple[str, str, int]], bool]:
    """The merges of a round, in order, found on the different pieces of words, and whether more can follow.

    Words are cut between two symbols that are neighbours less than ``floor`` times. A pair
    never becomes more frequent than the neighbours inside it, so all merges of at least
    ``floor`` are inside the pieces. The floor rises until the driver can hold the pieces;
    none are returned when even the most frequent pairs have too many.
    """
    pairs = stored(_pairs(table), "pairs")
    rows = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(FREQUENT_PAIRS + 1).collect()
    floor, size = least, len(rows)
    while rows:
        if size < len(rows) or size > FREQUENT_PAIRS:  # pairs as frequent as the first left out are left out, too
            floor = rows[min(size, FREQUENT_PAIRS)].n + 1
            rows = [r for r in rows[:size] if r.n >= floor]
            if not rows:
                break
        pieces = stored(_pieces(table, {(r.left, r.right) for r in rows}), "pieces")
        found = pieces.limit(PIECES + 1).collect()
        if len(found) <= PIECES:
            return _one_at_a_time([(r.symbols.split(" "), r.n) for r in found], most, floor), floor > least
        table, size = pieces, len(rows) // 2
    return [], floor > least


def _rewritten(known: DataFrame, found: list[tuple[str, str, int]], letters: Sequence[str]) -> DataFrame:
    """n and the symbols of the words after all merges so far."""
    joined = dict.fromkeys(left + right for left, right, _ in found)
    symbols = (*letters, *(j for j in joined if j not in set(letters)))
    sent = known.sparkSession.sparkContext.broadcast(Subwords(tuple((left, right) for left, right, _ in found), symbols))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder(sent.value), pa.array(sent.value.symbols, pa.string())
        for batch in batches:
            ids, sizes = encoder.many(batch.column("word").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), names.take(pa.array(ids - FIRST_ID)))
            texts = pc.binary_join_element_wise("", pc.binary_join(lists, " "), "", " ")
            yield pa.RecordBatch.from_arrays([batch.column("n"), texts], ["n", "symbols"])

    return stored(known.select("word", "n").mapInArrow(rows, "n bigint, symbols string"), "words")


def learn_merges(counts: DataFrame, merges: int, least: int = 2) -> DataFrame:
    """The merges of sub-words, most frequent pair first: rank (from 0), left, right, n.

    ``counts`` has word and n. Symbols begin as characters and the end mark; every merge
    joins the pair that is most frequent then (ties: least left, then right symbol), as
    long as it occurs ``least`` times. Rows without a word or n, and empty words, are left
    out; rows of one word are added up. An empty table gives no merges. Of the words, a
    row per distinct word is kept and rewritten; the driver holds the merges and a bounded
    number of different pieces of words.
    """
    spark = counts.sparkSession
    known = counts.where("word IS NOT NULL AND word != '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    known = stored(known.select(F.translate("word", f" {END}", REPLACED * 2).alias("word"), F.col("n").cast("bigint")), "known")
    table = stored(known.select("n", _symbols(F.col("word")).alias("symbols")), "words")
    found: list[tuple[str, str, int]] = []
    letters: list[str] = []
    more = True
    while more and len(found) < merges:
        taken, more = _long_round(table, merges - len(found), least)
        taken = taken or (_round(table, least)[: merges - len(found)] if more else [])
        found += taken
        if not taken or not more or len(found) == merges:
            break
        if len(taken) > FEW_MERGES:
            letters = letters or sorted({r.c for r in known.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()} - {""} | {END})
            table = _rewritten(known, found, letters)
            continue
        symbols = F.col("symbols")
        for left, right, _ in taken:
            symbols = _merged(symbols, left, right)
        table = stored(table.select("n", symbols.alias("symbols")), "words")
    rows = [(rank, *merge) for rank, merge in enumerate(found)]
    return spark.createDataFrame(rows, "rank int, left string, right string, n bigint")


@dataclass(frozen=True)
class Subwords:
    """Merges in order, and symbols in order of their ids, which begin at FIRST_ID."""

    merges: tuple[tuple[str, str], ...]
    symbols: tuple[str, ...]


def subwords(counts: DataFrame, merges: DataFrame) -> Subwords:
    """The vocabulary: the characters of the words by code point, then the merges.

    It is as large as the merges and the characters in use, which Unicode bounds.
    """
    letters = counts.where("word IS NOT NULL").select(F.explode(F.split(F.translate("word", f" {END}", REPLACED * 2), "")).alias("c"))
    used = {r.c for r in letters.distinct().collect()} - {""}
    rows = merges.orderBy("rank").collect()
    joined = dict.fromkeys(r.left + r.right for r in rows)
    return Subwords(tuple((r.left, r.right) for r in rows), (*sorted(used | {END}), *(j for j in joined if j not in used)))


class Encoder:
    """Ids of words, by merges in order of rank."""

    def __init__(self, vocabulary: Subwords):
        self.rank = {pair: i for i, pair in enumerate(dict.fromkeys(vocabulary.merges))}
        self.ids = {symbol: i for i, symbol in enumerate(vocabulary.symbols, FIRST_ID)}
        self.known: dict[str, list[int]] = {}
        # the same as arrays: symbols by number, characters and pairs in order
        names = dict.fromkeys([*vocabulary.symbols, *(s for a, b in self.rank for s in (a, b, a + b))])
        number = {symbol: i for i, symbol in enumerate(names)}
        letters = sorted((ord(s), i) for s, i in number.items() if len(s) == 1)
        self._letters, self._letter_symbol = np.array(letters, np.int64).reshape(-1, 2).T.copy()
        self._count = len(number)
        pairs = sorted((number[a] * len(number) + number[b], rank, number[a + b]) for (a, b), rank in self.rank.items())
        self._pairs, self._pair_rank, self._pair_symbol = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
        self._symbol_id = np.array([*(self.ids.get(s, UNKNOWN_ID) for s in number), UNKNOWN_ID], np.int32)

    def split(self, word: str) -> list[str]:
        parts = [*word, END]
        rank = self.rank
        while True:
            least = len(rank)
            for p in zip(parts, parts[1:]):
                if (own := rank.get(p, least)) < least:
                    pair, least = p, own
            if least == len(rank):
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def __call__(self, word: str) -> list[int]:
        if (ids := self.known.get(word)) is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            ids = self.known[word] = [self.ids.get(s, UNKNOWN_ID) for s in self.split(word)]
        return ids

    def many(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and how many each has; an empty word has none.

        Each round merges the least pair of every word, so there are as many rounds as
        merges in a word, however many merges there are.
        """
        ended = [word + END if word else "" for word in words]
        code = np.frombuffer("".join(ended).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(ended)), np.array([len(w) for w in ended], np.int64))
        symbol, found = _looked_up(self._letters, code)
        symbol = np.where(found, self._letter_symbol[symbol], -1) if len(self._letters) else np.full(len(code), -1)
        while len(symbol) > 1 and len(self._pairs):
            left, right = symbol[:-1], symbol[1:]
            at, hit = _looked_up(self._pairs, left * self._count + right)
            where = np.flatnonzero(hit & (left >= 0) & (right >= 0) & (word[:-1] == word[1:]))
            if not len(where):
                break
            at, of = at[where], word[where]
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.minimum.reduceat(self._pair_rank[at], heads)
            use = self._pair_rank[at] == np.repeat(least, np.diff(np.append(heads, len(of))))
            where, at = where[use], at[use]
            # a symbol that has just been joined is in no other pair: only equal symbols overlap
            place = np.arange(len(where))
            head = np.concatenate([[True], where[1:] != where[:-1] + 1])
            use = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
            where, at = where[use], at[use]
            symbol[where] = self._pair_symbol[at]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            symbol, word = symbol[keep], word[keep]
        return self._symbol_id[symbol], np.bincount(word, minlength=len(ended))


def _looked_up(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return place, table[place] == values


def _sliced(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about SLICE_BYTES of text, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range behind the other."""
    return np.repeat(start - _starts(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _text_ids(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, and how many each has; different words are encoded once."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    ids, size = encoder.many(coded.dictionary.to_pylist())
    word = coded.indices.to_numpy(zero_copy_only=False)
    sizes = size[word]
    bounds = _starts(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    return ids[_ranges(_starts(size)[word], sizes)], np.diff(_starts(sizes)[bounds])


def encode_subwords(
    df: DataFrame,
    text: str,
    vocabulary: Subwords,
    keep: Sequence[str],
    max_len: int | None = None,
    end_id: int | None = END_ID,
    pad: bool = False,
) -> DataFrame:
    """The kept columns with ``ids``, ``n_subwords`` before any cut, and ``truncated``.

    Every different word is encoded once in a task. With ``max_len`` ids are cut to it, the
    end id inside, and with ``pad`` filled up to it. Characters that the vocabulary has
    not seen get the unknown id. A null or empty text has no sub-words. One pass, no
    exchange; the vocabulary is broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    table = df.select(*(F.col(f"`{c}`") for c in keep), clean(F.col(f"`{text}`")).alias("__text"))
    table = table.toDF(*(f"k{i}" for i in range(len(keep))), "text")
    plain = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(table.schema.fields[:-1])]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        room = None if max_len is None else max_len - (end_id is not None)
        for batch in _sliced(batches, "text"):
            found, sizes = _text_ids(batch.column("text"), encoder)
            kept = sizes if room is None else np.minimum(sizes, room) if room >= 0 else np.maximum(sizes + room, 0)
            full = kept + (end_id is not None)
            full = np.maximum(full, max_len) if pad and max_len is not None else full
            begin, start = _starts(full), _starts(sizes)
            ids = np.full(int(full.sum()), PAD_ID, np.int32)
            ids[_ranges(begin[:-1], kept)] = found[_ranges(start[:-1], kept)]
            if end_id is not None:
                ids[begin[:-1] + kept] = end_id
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids)), pa.array(sizes, pa.int64()),
                pa.array(np.zeros(len(sizes), bool) if room is None else sizes > room),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(keep))), "ids", "n_subwords", "truncated"])

    schema = ", ".join([*plain, "ids array<int>", "n_subwords bigint", "truncated boolean"])
    return table.mapInArrow(rows, schema).toDF(*keep, "ids", "n_subwords", "truncated")


def decode_subwords(df: DataFrame, ids: str, vocabulary: Subwords, name: str = "text") -> DataFrame:
    """Add the text of a column of ids: up to the first end id, without padding; unknown ids become one sign.

    One pass, no exchange; the vocabulary is broadcast, and ids index an array of its symbols.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f"k{i}" for i in range(len(df.columns))]
    table = df.toDF(*names).withColumn("ids", F.col(names[df.columns.index(ids)]).cast("array<int>"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = pa.array([*(s.replace(END, " ") for s in sent.value.symbols), REPLACED], pa.large_string())
        for batch in batches:
            lists = batch.column("ids")
            values = pc.fill_null(lists.flatten(), PAD_ID).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(values == END_ID)
            passed = np.concatenate([[0], ends])[_starts(sizes)[:-1]]  # end ids of earlier rows
            use = (values != PAD_ID) & (ends == np.repeat(passed, sizes))
            place = values.astype(np.int64) - FIRST_ID
            place = np.where((place >= 0) & (place < len(symbols) - 1), place, len(symbols) - 1)[use]
            taken = symbols.take(pa.array(place))
            offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
            edges = offsets[np.concatenate([[0], np.cumsum(use)])[_starts(sizes)]]
            texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(edges), taken.buffers()[2])
            texts = pc.if_else(lists.is_valid(), pc.utf8_trim(texts, " "), None).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*names, "text"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)]
    found = table.mapInArrow(rows, T.StructType([*fields, T.StructField("text", T.StringType())]))
    given = [F.col(n).alias(c) for n, c in zip(names, df.columns)]
    return found.select(*given, F.col("text").alias("__text")).withColumn(name, F.col("__text")).drop("__text")
