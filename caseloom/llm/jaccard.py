"""Exact Jaccard join of word n-gram sets, as classes, links and components.

Equal sets are one class. Two sets that are similar enough share one of their first
tokens in any common order, so each set is dealt to the tiles of these tokens. Within a
tile sets are sorted by size, which bands them: only sets close enough in size meet.
Hashed bitmaps of the sets bound the overlap of such a pair from above by bit counts;
what remains is decided by intersecting the sorted arrays.

The order puts tokens of many sets last, so that a passage shared by a third of all
texts makes no large tiles. Tiles that stay large hold near copies of each other: there
neighbours by size are linked first, and only sets that are still in different
components are compared further. No link between different components is lost. The
number of links of each set is counted afterwards, in components that large tiles may have
left incomplete by comparing all their sets in blocks; these pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.llm.components import components
from caseloom.session import stored

_ENTRY = np.dtype([("token", "<u8"), ("set", "<u8"), ("size", "<u4")])
CHUNK_TOKENS = 4 << 20  # tokens counted at a time
LOCAL_COUNT = 4  # least count in a chunk that is passed on
BROADCAST_TOKENS = 4 << 20  # 32 MB of common tokens, and of set numbers, at most
BUCKET_BYTES = 16 << 20  # of tile entries in a group
SMALL_TILE = 64
BLOCK_SETS = 1024  # of a large tile in a block
COUNT_SETS = 1024  # of a component in a block, when its links are counted
COUNT_BODY = 1 << 20  # tokens of these sets, 8 MB
COUNT_BLOCKS = 8  # of a smaller component, so that its pairs are spread over tasks
COUNT_LEAST = 32  # sets of a block, where that leaves fewer blocks
COUNT_TOKENS = 2048  # tokens multiplied at a time
KNOWN_TILES = 64  # of a set's large tiles that tell where a pair was met before
COMMON = 64  # tokens of more sets than this are put last


@dataclass
class Sets:
    """Sorted distinct shingle hashes of each text of a slice."""

    values: np.ndarray
    bounds: np.ndarray
    digest: np.ndarray  # of each text's set; 0 where empty

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingle_sets(texts: pa.Array, size: int = 5) -> Sets:
    w = arrow.words(texts, lower=True)
    h = w.hashes()
    starts = np.flatnonzero(arrow.window_starts(w.bounds, size))
    values, doc = arrow.window_hashes(h, size)[starts], w.doc[starts]
    count = np.diff(w.bounds)
    short = [(doc, values)]
    for n in range(1, size):  # the whole sequence is the only shingle
        which = np.flatnonzero(count == n)
        total = np.full(len(which), n, np.uint64)
        for j in range(n):
            total = total * arrow._MULTIPLIER + h[w.bounds[which] + j]
        short.append((which, arrow.mixed(total)))
    doc, values = np.concatenate([d for d, _ in short]), np.concatenate([v for _, v in short])
    order = np.argsort(doc, kind="stable")  # nearly sorted
    doc, values = doc[order], values[order]
    edges = np.searchsorted(doc, np.arange(len(count) + 1)).tolist()
    for a, b in zip(edges, edges[1:]):
        values[a:b].sort()
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[first], values[first]
    bounds = np.searchsorted(doc, np.arange(len(count) + 1))
    raw = memoryview(values).cast("B") if len(values) else b""
    digest = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) if b > a else 0 for a, b in zip(bounds, bounds[1:])]
    return Sets(values, bounds, np.array(digest, np.uint64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _read(docs: DataFrame, size: int) -> DataFrame:
    """One pass over all texts: each document's set number and size, and counts of repeated tokens.

    Token counts of chunks are passed on from LOCAL_COUNT, so a token's sum may lack
    up to three per chunk; the sums only decide the order of tokens.
    """

    def run(batches):
        kept, held = [], 0

        def counts():
            tokens, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= LOCAL_COUNT
            null = pa.nulls(int(often.sum()), pa.int64())
            kept.clear()
            return pa.RecordBatch.from_arrays(
                [null, null, null.cast(pa.int32()), _signed(tokens[often]), pa.array(n[often])], names
            )

        for batch in arrow.sliced(batches):
            sets = shingle_sets(batch.column("text"), size)
            null = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _signed(sets.digest), pa.array(sets.sizes.astype(np.int32)), null, null], names
            )
            # copies within a slice are one set
            _, one = np.unique(sets.digest, return_index=True)
            mine = np.zeros(len(sets.sizes), bool)
            mine[one] = True
            kept.append(sets.values[np.repeat(mine, sets.sizes)])
            held += len(kept[-1])
            if held >= CHUNK_TOKENS:
                yield counts()
                held = 0
        if kept:
            yield counts()

    names = ["doc_id", "set", "size", "token", "n"]
    schema = "doc_id bigint, set bigint, size int, token bigint, n bigint"
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "sets")


def _common_tokens(read: DataFrame) -> np.ndarray:
    """Tokens of more than COMMON sets, as a sorted array of bounded size.

    Should they be too many to broadcast, only the more frequent ones are used: the
    order of tokens changes the cost of the join, never its result.
    """
    sums = read.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    sums = stored(sums, "common")
    least = COMMON
    while sums.where(F.col("n") > least).count() > BROADCAST_TOKENS:
        least *= 2
    found = sums.where(F.col("n") > least).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _contains(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _late_last(sets: Sets, of: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Values of each set with the marked ones behind the others, both in order."""
    if not late.any():
        return sets.values
    before = np.concatenate([[0], np.cumsum(late)])
    passed = before[:-1] - before[sets.bounds[:-1]][of]  # marked ones before this one in its set
    early = sets.sizes - np.diff(before[sets.bounds])
    place = np.arange(len(of))
    place = np.where(late, sets.bounds[of] + early[of] + passed, place - passed)
    out = np.empty_like(sets.values)
    out[place] = sets.values
    return out


def _dealt(docs: DataFrame, size: int, percent: int, common, buckets: int) -> DataFrame:
    """Tile entries: the first tokens of every set, packed by bucket."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingle_sets(batch.column("text"), size)
        _, one = np.unique(sets.digest, return_index=True)
        mine = np.zeros(len(sets.sizes), bool)
        mine[one] = True
        mine &= sets.sizes > 0
        of = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
        tokens = _late_last(sets, of, _contains(common.value, sets.values))
        place = np.arange(len(of)) - sets.bounds[of]
        first = sets.sizes - (percent * sets.sizes + 99) // 100 + 1
        use = (place < first[of]) & mine[of]
        of, tokens = of[use], tokens[use]
        if not len(of):
            return None
        entries = np.empty(len(of), _ENTRY)
        entries["token"], entries["set"], entries["size"] = tokens, sets.digest[of], sets.sizes[of]
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries = entries[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(edges))
        lengths = np.diff(edges)[there] * _ENTRY.itemsize
        blobs = arrow.binary_array(entries.view(np.uint8), lengths).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), blobs], ["bucket", "entries"])

    return docs.select("text").mapInArrow(arrow.per_slice(rows), "bucket int, entries binary")


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a <= b can be similar enough."""
    return 100 * a.astype(np.int64) >= percent * b.astype(np.int64)


def _tiles(dealt: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of all tiles of a bucket, and the members of its large tiles.

    Pairs of small tiles are complete; those of large tiles link neighbours by size.
    """

    def run(group: pa.Table) -> pa.Table:
        raw = b"".join(group.column("entries").to_pylist())
        entries = np.frombuffer(raw, _ENTRY)
        entries = entries[np.lexsort((entries["set"], entries["size"], entries["token"]))]
        same = np.ones(len(entries), bool)
        same[1:] = entries[1:] != entries[:-1]
        entries = entries[same]
        token, size, name = entries["token"], entries["size"], entries["set"]
        head = np.ones(len(entries), bool)
        head[1:] = token[1:] != token[:-1]
        tile = np.cumsum(head) - 1
        members = np.bincount(tile)
        large = (members > SMALL_TILE)[tile]
        left, right = [], []
        here = np.flatnonzero((members > 1)[tile])
        for step in range(1, SMALL_TILE):
            if step == 3:
                here = here[~large[here]]
            here = here[here + step < len(entries)]
            here = here[tile[here] == tile[here + step]]
            here = here[_close(size[here], size[here + step], percent)]
            if not len(here):
                break
            left.append(here)
            right.append(here + step)
        left = np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64)
        right = np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)
        pairs = np.empty(len(left), [("a", "<u8"), ("m", "<u4"), ("b", "<u8"), ("n", "<u4")])
        pairs["a"], pairs["m"], pairs["b"], pairs["n"] = name[left], size[left], name[right], size[right]
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        keep = np.ones(len(pairs), bool)
        keep[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[keep]
        extra = np.flatnonzero(large)
        null = pa.nulls(len(pairs), pa.int64())
        return pa.Table.from_arrays(
            [
                pa.concat_arrays([null, _signed(token[extra])]),
                pa.concat_arrays([_signed(pairs["a"]), _signed(name[extra])]),
                pa.concat_arrays([pa.array(pairs["m"].astype(np.int32)), pa.array(size[extra].astype(np.int32))]),
                pa.concat_arrays([_signed(pairs["b"]), pa.nulls(len(extra), pa.int64())]),
                pa.concat_arrays([pa.array(pairs["n"].astype(np.int32)), pa.nulls(len(extra), pa.int32())]),
            ],
            ["tile", "a", "m", "b", "n"],
        )

    schema = "tile bigint, a bigint, m int, b bigint, n int"
    return stored(dealt.groupBy("bucket").applyInArrow(run, schema), "tiles")


def signature_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, at least twice its size, 64 to 32,768."""
    return np.left_shift(64, np.clip(np.ceil(np.log2(np.maximum(sizes, 1) * 2 / 64)), 0, 9).astype(np.int64))


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each value, by its low bits; as bytes."""
    flags = np.zeros(bits, bool)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def overlap_bound(x: np.ndarray, m: int, y: np.ndarray, n: int) -> int:
    """At most so many common values of sets of m and n values with these bitmaps."""
    while len(x) > len(y):  # bits are low bits of the hash: halves fold onto each other
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    only_x, only_y = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(m - only_x, n - only_y)


def _sets_of(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("set"), F.col("m").alias("size")).union(pairs.select("b", "n"))
    return both.distinct()


def _bodies(docs: DataFrame, wanted: DataFrame, size: int, body: Callable[[np.ndarray], bytes]) -> DataFrame:
    """The body of every wanted set, once: set, size, body.

    The wanted numbers, while small enough to broadcast, keep other sets from leaving
    their task; the join decides in any case.
    """
    spark = docs.sparkSession
    names = wanted.select(F.col("set").alias("wanted_set"), F.col("size").alias("wanted_size"))
    sent = None
    if names.count() <= BROADCAST_TOKENS:
        numbers = names.select("wanted_set").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        sent = spark.sparkContext.broadcast(np.sort(numbers))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingle_sets(batch.column("text"), size)
        use = sets.sizes > 0
        if sent is not None:
            use &= _contains(sent.value, sets.digest)
        _, one = np.unique(sets.digest, return_index=True)
        which = [i for i in one.tolist() if use[i]]
        if not which:
            return None
        parts = [body(sets.values[sets.bounds[i] : sets.bounds[i + 1]]) for i in which]
        return pa.RecordBatch.from_arrays(
            [_signed(sets.digest[which]), pa.array(sets.sizes[which].astype(np.int32)), pa.array(parts, pa.binary())],
            ["set", "size", "body"],
        )

    found = docs.select("text").mapInArrow(arrow.per_slice(rows), "set bigint, size int, body binary")
    match = (F.col("set") == F.col("wanted_set")) & (F.col("size") == F.col("wanted_size"))
    kept = found.join(names, match, "left_semi") if sent is None else found
    return stored(kept.groupBy("set", "size").agg(F.first("body").alias("body")), "bodies")


def _with(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Attach the bodies of both sets to each pair."""
    for name, count, to in (("a", "m", "x"), ("b", "n", "y")):
        side = bodies.select(F.col("set").alias(name), F.col("size").alias(count), F.col("body").alias(to))
        pairs = pairs.join(side, [name, count])
    return pairs.select("a", "m", "b", "n", "x", "y")


def _needed(m: int, n: int, percent: int) -> int:
    """Least overlap with 100 * overlap >= percent * union."""
    return -(-percent * (m + n) // (100 + percent))


def _checked(pairs: DataFrame, accept: Callable[[int, int, bytes, bytes], bool]) -> DataFrame:
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("m", "n", "x", "y")]
            keep = [accept(*row) for row in zip(*columns)]
            yield batch.select(["a", "m", "b", "n"]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.mapInArrow(run, "a bigint, m int, b bigint, n int"), "checked")


def _packed(values: np.ndarray) -> bytes:
    return bitmap(values, int(signature_bits(np.array([len(values)]))[0])).tobytes()


def _likely(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps leave room for the needed overlap: a, m, b, n."""

    def accept(m, n, x, y):
        bound = overlap_bound(np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8), n)
        return bound >= _needed(m, n, percent)

    return _checked(_with(pairs, bitmaps), accept)


def _verified(docs: DataFrame, likely: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that are similar enough, by intersecting their arrays: a, m, b, n."""

    def accept(m, n, x, y):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        return int(_contains(y, x).sum()) >= _needed(m, n, percent)

    items = _bodies(docs, stored(_sets_of(likely), "wanted"), size, np.ndarray.tobytes)
    return _checked(_with(likely, items), accept)


def _node(set_name: str, size_name: str):
    return F.struct(F.col(size_name).alias("size"), F.col(set_name).alias("set"))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(_node("a", "m").alias("a"), _node("b", "n").alias("b"))


def similar_sets(
    docs: DataFrame, size: int = 5, percent: int = 80, counts: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Classes of the documents, links between classes, components of linked classes, link counts.

    Returns documents (doc_id, set, size), links (a, m, b, n: sets and their sizes),
    labels (node, label: structs of size and set) and degrees (set, size, n_links). In
    tiles of more than SMALL_TILE different sets, links inside a component are not all
    listed; components and degrees are complete. Without ``counts`` there are no degrees.
    """
    spark = docs.sparkSession
    read = _read(docs, size)
    members = read.where("token IS NULL").select("doc_id", "set", "size")
    common = spark.sparkContext.broadcast(_common_tokens(read))
    amount = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, amount * 6 // 10 // BUCKET_BYTES)
    tiles = _tiles(_dealt(docs, size, percent, common, buckets), percent)
    pairs = stored(tiles.where("tile IS NULL").select("a", "m", "b", "n").distinct(), "pairs")
    large = tiles.where("tile IS NOT NULL").select("tile", F.col("a").alias("set"), F.col("m").alias("size"))
    wanted = _sets_of(pairs).union(large.select("set", "size")).distinct()
    bitmaps = _bodies(docs, stored(wanted, "wanted"), size, _packed)
    links = _verified(docs, _likely(pairs, bitmaps, percent), size, percent)
    labels = stored(components(_edges(links)), "labels")
    if not large.isEmpty():
        further = _across(large, labels, bitmaps, percent)
        if not further.isEmpty():
            links = stored(links.union(_verified(docs, further, size, percent)), "links")
            labels = stored(components(_edges(links)), "labels")
    degrees = _degrees(docs, links, labels, large, size, percent) if counts else None
    return members, links, labels, degrees


def _folded(bits: list[bytes], to: int) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words, folded to ``to`` bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while rows.shape[1] > to:
        rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
    return np.ascontiguousarray(rows).view(np.uint64)


def _met(percent: int):
    """Compares the sets of one block of a large tile with those of another, or its own."""

    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("set", "size", "part_set", "part_size", "block", "bits", "tiles")}
        first, second, tile = (group.column(c)[0].as_py() for c in ("first", "second", "tile"))
        size = np.array(columns["size"], np.int64)
        name = np.array(columns["set"], np.int64)
        block = np.array(columns["block"], np.int64)
        part = np.array(list(zip(columns["part_set"], columns["part_size"])), np.int64).reshape(-1, 2)
        width = np.array([len(b) for b in columns["bits"]])
        lists = [set(t) for t in columns["tiles"]]
        out = []
        for w in np.unique(width):
            for v in (w, 2 * w):  # sizes close enough differ by one width at most
                x = np.flatnonzero((width == w))
                y = np.flatnonzero((width == v))
                if not len(y):
                    continue
                here, there = (_folded([columns["bits"][i] for i in rows], int(w)) for rows in (x, y))
                for i, bits in zip(x.tolist(), here):
                    met = y[(y > i) | (w != v)]
                    met = met[(first == second) | (block[met] != block[i])]
                    met = met[100 * np.minimum(size[met], size[i]) >= percent * np.maximum(size[met], size[i])]
                    met = met[(part[met] != part[i]).any(axis=1)]
                    if not len(met):
                        continue
                    other = there[np.searchsorted(y, met)]
                    alone = np.bitwise_count(bits & ~other).sum(axis=1, dtype=np.int64)
                    others = np.bitwise_count(other & ~bits).sum(axis=1, dtype=np.int64)
                    bound = np.minimum(size[i] - alone, size[met] - others)
                    for j in met[bound >= -(-percent * (size[i] + size[met]) // (100 + percent))].tolist():
                        # a pair leaves its tasks once: in the first tile it shares, where that is known
                        both = lists[i] & lists[j]
                        if tile not in both or tile == min(both):
                            out.append((name[i], size[i], name[j], size[j]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "m", "b", "n"])

    return run


def _across(large: DataFrame, labels: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of large tiles whose sets are in different components.

    A tile's sets are dealt to blocks by hash, and a task compares two blocks by their
    bitmaps, so however large a tile is, no task holds more than two blocks of it and
    only likely pairs become rows.
    """
    node = _node("set", "size")
    placed = large.join(labels.withColumnRenamed("node", "own"), node == F.col("own"), "left")
    placed = stored(placed.select("tile", "set", "size", F.coalesce("label", node).alias("part")), "placed")
    tiles = placed.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high")
    ).where(F.col("low") != F.col("high"))
    tiles = tiles.select("tile", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("blocks"))
    open_rows = placed.join(tiles, "tile")
    lists = open_rows.groupBy("set", "size").agg(F.slice(F.sort_array(F.collect_list("tile")), 1, KNOWN_TILES).alias("tiles"))
    rows = open_rows.join(lists, ["set", "size"]).join(bitmaps.withColumnRenamed("body", "bits"), ["set", "size"])
    block = F.pmod(F.xxhash64("set", "size"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = rows.select(
        "tile", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block",
        "set", "size", F.col("part.set").alias("part_set"), F.col("part.size").alias("part_size"), "bits", "tiles",
    )
    met = keyed.groupBy("tile", "first", "second").applyInArrow(_met(percent), "a bigint, m int, b bigint, n int")
    return stored(met.distinct(), "pairs")


def _counted(percent: int):
    """Links between the sets of one block of a component and those of another, or its own."""

    def run(group: pa.Table) -> pa.Table:
        first, second = (group.column(c)[0].as_py() for c in ("first", "second"))
        block = group.column("block").to_numpy()
        size = group.column("size").to_numpy().astype(np.int64)
        tokens = np.frombuffer(b"".join(group.column("body").to_pylist()), "<u8")
        _, token, often = np.unique(tokens, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(size)), size)
        # tokens of one set alone are in no overlap; the others get consecutive numbers
        number = np.cumsum(often > 1) - 1
        use = (often > 1)[token]
        of, token = of[use], number[token[use]]
        order = np.argsort(token, kind="stable")
        of, token = of[order], token[order]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        place = np.zeros(len(size), np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
        for base in range(0, int(token[-1]) + 1 if len(token) else 0, COUNT_TOKENS):
            a, b = np.searchsorted(token, (base, base + COUNT_TOKENS))
            has = np.zeros((len(size), COUNT_TOKENS), np.float32)
            has[of[a:b], token[a:b] - base] = 1
            both += has[left] @ has[right].T
        least = -(-percent * (size[left][:, None] + size[right][None, :]) // (100 + percent))
        linked = both >= least
        counts = np.zeros(len(size), np.int64)
        if first == second:
            np.fill_diagonal(linked, False)
            counts[left] = linked.sum(axis=1)
        else:
            counts[left], counts[right] = linked.sum(axis=1), linked.sum(axis=0)
        return pa.Table.from_arrays([group.column("set"), group.column("size"), pa.array(counts)], ["set", "size", "n"])

    return run


def _degrees(docs: DataFrame, links: DataFrame, labels: DataFrame, large: DataFrame, size: int, percent: int) -> DataFrame:
    """Number of links of every linked set: set, size, n_links.

    A component none of whose sets share a large tile has all its links listed. The sets
    of any other are dealt to blocks by hash, and a task counts the links of two blocks
    from the whole sets; what leaves it is a row for each set.
    """
    degree = links.select(F.col("a").alias("set"), F.col("m").alias("size")).union(links.select("b", "n"))
    listed = degree.groupBy("set", "size").agg(F.count(F.lit(1)).alias("n_links"))
    if large.isEmpty():
        return listed
    named = labels.select(F.col("node.set").alias("set"), F.col("node.size").alias("size"), F.col("label").alias("part"))
    shared = large.join(named, ["set", "size"]).groupBy("tile", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = shared.where("n > 1").select("part").distinct()
    within = named.join(parts, "part")
    blocks = F.greatest(
        F.ceil(F.col("n") / COUNT_SETS), F.ceil(F.col("tokens") / COUNT_BODY), F.least(F.lit(COUNT_BLOCKS), F.ceil(F.col("n") / COUNT_LEAST))
    ).cast("int")
    sizes = within.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).select("part", blocks.alias("blocks"))
    within = stored(within.join(sizes, "part"), "within")
    if within.isEmpty():
        return listed
    block = F.pmod(F.xxhash64("set", "size"), F.col("blocks")).cast("int")
    bodies = _bodies(docs, within.select("set", "size"), size, np.ndarray.tobytes)
    rows = within.join(bodies, ["set", "size"]).withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = rows.select(
        "part", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block",
        "set", "size", "body",
    )
    counts = keyed.groupBy("part", "first", "second").applyInArrow(_counted(percent), "set bigint, size int, n bigint")
    counts = counts.groupBy("set", "size").agg(F.sum("n").alias("n_links"))
    return listed.join(within, ["set", "size"], "left_anti").union(counts)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, counts: bool = True) -> DataFrame:
    """Set size and component of every document: doc_id, n_shingles, component_id, n_links.

    component_id is the least doc_id reachable over links of Jaccard ``percent`` or more;
    n_links counts the links of the document's class to other classes; ``counts=False``
    leaves it out, and the comparisons that only it needs.

    A null text, or one without words, has the empty set and is linked with nothing: its
    component is itself. A text with fewer than ``size`` words is one shingle. Repeated
    rows and copies come back as often as given; a null doc_id is no component's name
    unless all members lack one. Other columns are ignored.
    """
    members, _, labels, degree = similar_sets(docs, size, percent, counts)
    classes = members.where("size > 0").groupBy("set", "size").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "own"), _node("set", "size") == F.col("own"), "left")
    named = named.withColumn("label", F.coalesce("label", _node("set", "size")))
    lowest = named.groupBy("label").agg(F.min("least").alias("component"))
    resolved = named.join(lowest, "label")
    if counts:
        resolved = resolved.join(degree, ["set", "size"], "left")
    links = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if counts else []
    resolved = resolved.select("set", "size", "component", *(["n_links"] if counts else []))
    return members.join(resolved, ["set", "size"], "left").select(
        "doc_id",
        F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        *links,
    )
