"""Removal of repeated word passages with prefix-partitioned suffix trees.

Every place where at least ``min_words`` words follow is a suffix. Suffixes are split by
prefixes of variable length into groups that fit in memory; the sorted suffixes of a
group and the depths they share with their neighbours are its subtree, whose internal
nodes of ``min_words`` words or deeper are the repeats. The first leaf of such a node
stays, all others are removed. Only equality over ``min_words`` words is built: a longer
repeat is a run of such suffixes, so no greater depth is needed.

Words are hashed. A suffix is spelled in four symbols of a quarter of ``min_words`` words
and 16 bits each, which give its place in the tree. As a difference inside a quarter shows
in one symbol only, the leaves of a node must also agree in two hashes of all ``min_words``
words, of 64 bits each and over words hashed with different seeds.

Most places start no repeat, so a first round finds out which can: every window of
``min_words`` words has a least half-window (by hash), equal windows have equal ones,
and a window whose least half-window occurs once in the corpus is unique. Only the other
suffixes are dealt to subtrees. Both rounds first settle what repeats inside a group of
documents, so a passage arrives at a subtree at most once from each of these groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import arrow

GROUP_BYTES = 4 << 20  # text of a group of documents
BUCKET_BYTES = 12 << 20  # packed records of a bucket
SUBTREE = 1 << 20  # suffixes of a subtree; longer prefixes are taken until it fits
_ANCHOR = np.dtype([("hash", "<u8"), ("at", "<u4")])
_SUFFIX = np.dtype([("place", "<u8"), ("first", "<u8"), ("second", "<u8"), ("at", "<u4")])
_SPELLED = ("place", "first", "second")  # equal suffixes agree in all of them
_SEED = 0x5F3759DF  # of the words under the second hash of a suffix
_OWNER = np.dtype([("doc_id", "<i8"), ("records", "<u4")])
_NULL = np.iinfo(np.int64).min  # null ids sort first


class Group:
    """Words of a group of documents, one after the other in document order."""

    def __init__(self, table: pa.Table, min_words: int):
        table = table.combine_chunks()
        ids = pc.fill_null(table.column("doc_id"), _NULL)
        order = pc.sort_indices(
            pa.table({"id": ids, "tie": table.column("tie")}), sort_keys=[("id", "ascending"), ("tie", "ascending")]
        )
        self.rows = table.take(order)
        self.ids = ids.take(order).to_numpy()
        tie = self.rows.column("tie").to_numpy()
        same = (self.ids[1:] == self.ids[:-1]) & (tie[1:] == tie[:-1])
        #: number of the document that each row is, equal rows being one
        self.document = np.cumsum(np.concatenate([[True], ~same])) - 1
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        texts = self.rows.column("text").combine_chunks().take(pa.array(first))
        self.words = arrow.words(texts)
        self.ids = self.ids[first]
        self.size = min_words
        self.hashes = self.words.hashes()
        self.inside = arrow.window_starts(self.words.bounds, min_words)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each half-window, and where the first least one of each window starts."""
        half = self.size // 2
        hashes = arrow.window_hashes(self.hashes, half)
        n = len(self.inside)
        least, where = hashes[:n].copy(), np.arange(n)
        for j in range(1, self.size - half + 1):
            other = hashes[j : j + n]
            lower = other < least
            least[lower] = other[lower]
            where[lower] = np.flatnonzero(lower) + j
        return hashes, where

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix at each window start: its four symbols, and two hashes of the whole."""
        cuts = np.linspace(0, self.size, 5).astype(int)
        n = len(self.inside)
        place = np.zeros(n, np.uint64)
        for a, b in zip(cuts, cuts[1:]):
            hashes = arrow.window_hashes(self.hashes, int(b - a), np.uint64(0xC2B2AE3D27D4EB4F))
            place = place << np.uint64(16) | hashes[a : a + n] >> np.uint64(48)
        first = arrow.window_hashes(self.hashes, self.size)[:n]
        second = arrow.window_hashes(self.words.hashes(_SEED), self.size, np.uint64(0xD6E8FEB86659FD93))[:n]
        return place, first, second


def _alike(spelled: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Which suffixes, in this order, are spelled like the one before."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for values in spelled:
        values = values[order]
        same &= values[1:] == values[:-1]
    return same


def _packed(records: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield i, records[order[edges[i] : edges[i + 1]]]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _positions(group: int, at: np.ndarray) -> tuple[int, bytes]:
    return group, np.sort(at).astype("<u4").tobytes()


_BACK = (["part", "places"], [pa.int64(), pa.binary()])


def _returned(part: np.ndarray, at: np.ndarray) -> pa.Table:
    """Places by the group of documents they belong to."""
    order = np.argsort(part, kind="stable")
    part, at = part[order], at[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    ends = [*heads[1:], len(part)] if len(part) else []
    return _table([_positions(int(part[a]), at[a:b]) for a, b in zip(heads, ends)], *_BACK)


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _anchor_records(min_words: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        group = Group(table, min_words)
        hashes, where = group.anchors()
        at = np.unique(where[group.inside])
        # one for each hash: further ones in this group are known to repeat
        _, once = np.unique(hashes[at], return_index=True)
        records = np.empty(len(once), _ANCHOR)
        records["hash"], records["at"] = hashes[at[once]], at[once]
        part = table.column("part")[0].as_py()
        rows = [(b, part, r.tobytes()) for b, r in _packed(records, records["hash"] % np.uint64(buckets), buckets)]
        return _table(rows, ["bucket", "part", "records"], [pa.int32(), pa.int64(), pa.binary()])

    return run


def _repeated_anchors(table: pa.Table) -> pa.Table:
    blobs = table.column("records").to_pylist()
    records = np.frombuffer(b"".join(blobs), _ANCHOR)
    part = np.repeat(table.column("part").to_numpy(), [len(b) // _ANCHOR.itemsize for b in blobs])
    again = _repeated(records["hash"])
    return _returned(part[again], records["at"][again])


def _places(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("places").to_pylist()), "<u4").astype(np.int64)


def _suffix_records(min_words: int, buckets: int):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        group = Group(table, min_words)
        hashes, where = group.anchors()
        windows = np.flatnonzero(group.inside)
        anchors = np.unique(where[windows])
        can = np.zeros(len(hashes), bool)
        can[anchors[_repeated(hashes[anchors])]] = True
        can[_places(back)] = True
        windows = windows[can[where[windows]]]
        spelled = tuple(values[windows] for values in group.symbols())
        # what repeats within the group is settled here, the first leaf goes on
        order = np.lexsort((windows, *reversed(spelled)))
        later = np.zeros(len(windows), bool)
        later[order[1:]] = _alike(spelled, order)
        part = table.column("part")[0].as_py()
        keep = ~later
        records = np.empty(int(keep.sum()), _SUFFIX)
        for name, values in zip(_SPELLED, spelled):
            records[name] = values[keep]
        records["at"] = windows[keep]
        rows = []
        if later.any():
            rows.append((part % buckets, part, b"", b"", _positions(part, windows[later])[1]))
        # hashes are spread evenly: so are their leading bits, the prefixes
        prefix = (records["place"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        for bucket, some in _packed(records, prefix.astype(np.int64), buckets):
            owner = np.searchsorted(group.words.bounds, some["at"], "right") - 1
            whose, counts = np.unique(owner, return_counts=True)
            owners = np.empty(len(whose), _OWNER)
            owners["doc_id"], owners["records"] = group.ids[whose], counts
            rows.append((bucket, part, owners.tobytes(), some.tobytes(), b""))
        return _table(
            rows,
            ["bucket", "part", "owners", "records", "local"],
            [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()],
        )

    return run


def subtree_groups(high: np.ndarray, low: np.ndarray, most: int = SUBTREE) -> Iterator[np.ndarray]:
    """Split suffixes by prefixes, as short as possible, into groups of at most ``most``.

    Equal suffixes cannot be split and may make a larger group.
    """
    waiting = [(np.arange(len(high)), 0)]
    while waiting:
        rows, bits = waiting.pop()
        if len(rows) <= most or bits == 128:
            yield rows
            continue
        part = high[rows] if bits < 64 else low[rows]
        digit = part << np.uint64(bits % 64) >> np.uint64(60)  # four bits more
        waiting.extend((rows[digit == d], bits + 4) for d in np.unique(digit))


def deep_nodes(spelled: tuple[np.ndarray, ...], *rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of the subtree, and which share the whole depth with the one before.

    Leaves of a node are in the order of ``rank``, most significant first.
    """
    order = np.lexsort((*reversed(rank), *reversed(spelled)))
    deep = np.zeros(len(order), bool)
    deep[1:] = _alike(spelled, order)
    return order, deep


def _repeats(table: pa.Table) -> pa.Table:
    blobs, owners = table.column("records").to_pylist(), table.column("owners").to_pylist()
    records = np.frombuffer(b"".join(blobs), _SUFFIX)
    owner = np.frombuffer(b"".join(owners), _OWNER)
    ids = np.repeat(owner["doc_id"], owner["records"])
    groups = table.column("part").to_numpy()
    part = np.repeat(groups, [len(b) // _SUFFIX.itemsize for b in blobs])
    spelled, at = [np.ascontiguousarray(records[f]) for f in _SPELLED], records["at"]
    found = []
    for rows in subtree_groups(*spelled[:2]):
        order, deep = deep_nodes(tuple(values[rows] for values in spelled), ids[rows], part[rows], at[rows])
        found.append(rows[order[deep]])
    found = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
    local = [np.frombuffer(b, "<u4") for b in table.column("local").to_pylist()]
    return _returned(
        np.concatenate([part[found], np.repeat(groups, [len(x) for x in local])]),
        np.concatenate([at[found], *local]),
    )


def _joined(words: arrow.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words, each followed by a blank, and where each text's begin, with the end."""
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep]
    after = np.cumsum(sizes + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    letter = np.ones(len(out), bool)
    letter[after - 1] = False
    source = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[letter] = words.data[source]
    number = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return out, np.concatenate([[0], after])[number]


def _results(min_words: int, carried: list[str], texts: bool):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        group = Group(table, min_words)
        w = group.words
        begin = np.unique(_places(back))
        cover = np.zeros(len(w.starts) + 1, np.int64)
        cover[begin] += 1
        np.add.at(cover, begin + min_words, -1)
        gone = np.cumsum(cover)[:-1] > 0
        joined, edges = _joined(w, ~gone)
        raw = memoryview(joined)
        kept = [raw[a : max(b - 1, a)] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        out = {
            "n_words": np.diff(w.bounds),
            "n_removed": arrow.counts_between(gone, w.bounds),
        }
        document = pa.array(group.document)
        columns = {name: group.rows.column(name) for name in ["doc_id", *carried]}
        columns |= {name: pa.array(values.astype(np.int64)).take(document) for name, values in out.items()}
        columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept]).take(document)
        if texts:
            columns["text"] = group.rows.column("text")
            columns["kept"] = pa.array([k.tobytes().decode() for k in kept], pa.string()).take(document)
            columns["ranges"] = pa.array(_ranges(gone, w.bounds), pa.list_(pa.list_(pa.int64()))).take(document)
        return pa.table(columns)

    return run


def _ranges(gone: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """Removed word ranges of each text."""
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        change = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]).astype(np.int8)))
        out.append(change.reshape(-1, 2).tolist())
    return out


def remove_repeats(docs: DataFrame, min_words: int = 20, texts: bool = True) -> DataFrame:
    """Documents without the passages of ``min_words`` words or more that start earlier.

    Earlier means in a document with smaller doc_id, or before it in the same document.
    Judged on the input, not on what is left. Returns doc_id, n_words, n_removed,
    kept_sha256 (kept words joined by one blank), and with ``texts`` also text, kept,
    ranges (removed word ranges, begin and end) and row (a struct of all other columns).

    The texts are exchanged once, into groups of documents by a hash; both rounds and the
    result read this one exchange. Nothing is stored, so lost work is done again by Spark.

    A null or empty text has no words. A null doc_id comes before all others. Rows that
    share a doc_id are ordered by a hash of their content; rows equal in all used columns
    are one document and all get its result. Without ``texts`` other columns are ignored.
    """
    if min_words < 8:
        raise ValueError("min_words must be 8 or more")
    amount = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(16, amount // GROUP_BYTES)
    buckets = max(8, amount // BUCKET_BYTES)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if texts else []
    used = docs.select("doc_id", "text", *[F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")] * bool(others))
    tie = F.xxhash64(F.coalesce("text", F.lit("")), *["row"] * bool(others))
    dealt = used.withColumn("tie", tie).withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)))
    by_part = dealt.groupBy("part")

    anchors = by_part.applyInArrow(_anchor_records(min_words, buckets), "bucket int, part bigint, records binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated_anchors, "part bigint, places binary")
    suffixes = by_part.cogroup(repeated.groupBy("part")).applyInArrow(
        _suffix_records(min_words, buckets), "bucket int, part bigint, owners binary, records binary, local binary"
    )
    repeats = suffixes.groupBy("bucket").applyInArrow(_repeats, "part bigint, places binary")
    schema = T.StructType([used.schema["doc_id"]])
    if others:
        schema.add(used.schema["row"])
    schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    if texts:
        ranges = T.ArrayType(T.ArrayType(T.LongType()))
        schema.add("text", T.StringType()).add("kept", T.StringType()).add("ranges", ranges)
    results = _results(min_words, ["row"] * bool(others), texts)
    return by_part.cogroup(repeats.groupBy("part")).applyInArrow(results, schema)
