"""Spelling variants: words one edit apart, found by walking tries level by level.

Two words one edit apart agree before the edit or behind it in at least half of the
shorter one. So there are two tries, of the words and of the reversed words, and an edit
is only looked for from the middle of a word on. Only nodes where words part are kept:
an edge carries all characters up to the next such node or to the end of a word, and its
row tells which word ends there.

A state is (word, position, node, edits). The states without an edit are the nodes on a
word's own path. One join with the edges makes the edit (another character, or one more),
and every further join follows one edge exactly, until no state is left; a state at the
end of both words is a pair. A pair is found from its shorter word, or from the first one
in order, and holds for both. All tables are distributed; the number of joins is that of
the forks behind an edit, not of the characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrow
from caseloom.session import stored

NODE_SCHEMA = "id bigint, way int, depth int, node bigint, next int"
SLICE_BYTES = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _word_nodes(words: list[str], ids: np.ndarray, way: int) -> dict[str, np.ndarray]:
    """Nodes from just before the middle to the end of each word: hash of the prefix and next code point."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(points)) - np.repeat(edges[:-1], sizes)
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    np.cumprod(np.full(len(powers) - 1, _FACTOR), out=powers[1:])
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(arrow.mixed(points.astype(np.uint64) + np.uint64(1)) * powers[place], out=sums[1:])
    first = np.maximum(sizes // 2 - 1, 0)
    count = sizes - first + 1
    word = np.repeat(np.arange(len(words)), count)
    depth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]
    at = edges[word] + depth
    prefix = sums[at] - sums[edges[word]]
    node = arrow.mixed(prefix + arrow.mixed((2 * depth + way + 1).astype(np.uint64)))
    ends = depth == sizes[word]
    following = np.where(ends, -1, np.append(points, 0)[at].astype(np.int64))
    return {
        "id": ids[word],
        "way": np.full(len(word), way, np.int32),
        "depth": depth.astype(np.int32),
        "node": node.view(np.int64),
        "next": following.astype(np.int32),
    }


def trie_nodes(words: DataFrame) -> DataFrame:
    """Nodes of both tries (way 0: words, 1: reversed) on each word's path, from the middle on."""

    def nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        ways = [_word_nodes([t[::-1] for t in texts] if way else texts, ids, way) for way in (0, 1)]
        return pa.RecordBatch.from_pydict({name: np.concatenate([w[name] for w in ways]) for name in ways[0]})

    return words.select("id", "word").mapInArrow(arrow.per_slice(nodes, "word", SLICE_BYTES), NODE_SCHEMA)


def _paths(words: DataFrame) -> DataFrame:
    """For each word and way its text, size and the kept nodes on its path, by depth."""
    nodes = stored(trie_nodes(words), "nodes")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("next") % 64)
    forks = nodes.groupBy("node").agg(
        F.min("next").alias("low"), F.max("next").alias("high"), F.bit_or(F.when(F.col("next") >= 0, bit)).alias("onward")
    )
    forks = forks.where("low < high").select("node", "onward")
    # the end of a word stays, too: states and edges stop there
    inner = nodes.where("next >= 0").join(forks, "node")
    ends = nodes.where("next < 0").join(forks, "node", "left")
    kept = inner.union(ends)
    paths = kept.groupBy("id", "way").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "onward"))).alias("path"))
    text = F.when(F.col("way") == 1, F.reverse("word")).otherwise(F.col("word"))
    return paths.join(words, "id").select("id", "n", text.alias("text"), F.length("word").alias("size"), "path")


def _edges(paths: DataFrame) -> DataFrame:
    """Edges of the tries: node, first character, rest of the label, child and the word that ends there.

    ``onward`` has a bit for the characters that edges of the child begin with.
    """
    steps = F.size("path") - 1
    from_to = F.zip_with(
        F.slice("path", F.lit(1), steps),
        F.slice("path", F.lit(2), steps),
        lambda a, b: F.struct(a["depth"].alias("depth"), a["node"].alias("node"), b["depth"].alias("to"), b["node"].alias("child"), b["onward"].alias("onward")),
    )
    steps = paths.where(F.size("path") > 1).select("id", "n", "text", "size", F.explode(from_to).alias("e")).select("id", "n", "text", "size", "e.*")
    word = F.when(F.col("to") == F.col("size"), F.struct("id", "n", "text"))
    labelled = steps.select(
        "node",
        F.substring("text", F.col("depth") + 1, F.lit(1)).alias("first"),
        F.substring("text", F.col("depth") + 2, F.col("to") - F.col("depth") - 1).alias("rest"),
        "child",
        "onward",
        word.alias("ends"),
    )
    return labelled.groupBy("node", "first", "rest", "child").agg(F.max("ends").alias("ends"), F.first("onward").alias("onward"))


STATE = ["id", "n", "text", "size", "pos", "node"]


def _arrived(joined: DataFrame) -> DataFrame:
    """New states (other null) and pairs (other set) out of matches of edges."""
    met = (F.col("pos") == F.col("size")) & F.col("ends").isNotNull()
    # the hash of a prefix stands for it; the pair itself is compared
    pair = met & (F.levenshtein("text", F.col("ends.text"), 1) == 1)
    # a state in which no edge can go on is not made
    following = F.ascii(F.substring("text", F.col("pos") + 1, F.lit(1))) % 64
    live = joined.where(pair | ((F.col("pos") < F.col("size")) & (F.bit_get("onward", following) == 1)))
    other = F.when(F.col("pos") == F.col("size"), F.struct(F.col("ends.id").alias("id"), F.col("ends.n").alias("n")))
    return live.select(*STATE, other.alias("other"))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart: id, n, other_id, other_n, each pair once in either direction.

    ``words`` has id, word and n, ids in the order of words, words not repeated.
    """
    paths = stored(_paths(words), "paths")
    edges = stored(_edges(paths), "edges")
    own = paths.select("id", "n", "text", "size", F.explode("path").alias("p")).where(F.col("p.depth") >= F.floor(F.col("size") / 2))
    states = own.select("id", "n", "text", "size", F.col("p.depth").alias("pos"), "p.node")
    here = F.substring("text", F.col("pos") + 1, F.lit(1))
    forks = states.join(edges, "node").where(F.col("first") != here)
    long = F.length("rest")
    # another character, taken from the lesser of both, or one more
    replaced = (here < F.col("first")) & (F.col("rest") == F.substring("text", F.col("pos") + 2, long))
    added = F.col("rest") == F.substring("text", F.col("pos") + 1, long)
    moves = F.array(
        F.when(replaced & (F.col("pos") < F.col("size")), F.col("pos") + 1 + long), F.when(added, F.col("pos") + long)
    )
    edited = forks.withColumn("to", F.explode(moves)).where("`to` <= size")
    level = stored(_arrived(edited.withColumns({"pos": F.col("to"), "node": F.col("child")})), "level")
    levels = [level]
    while not (open_states := level.where("other IS NULL")).isEmpty():
        ahead = open_states.select("id", "n", "text", "size", "pos", "node", here.alias("first"))
        matched = ahead.join(edges, ["node", "first"])
        matched = matched.where(F.col("rest") == F.substring("text", F.col("pos") + 2, F.length("rest")))
        matched = matched.withColumns({"pos": F.col("pos") + 1 + F.length("rest"), "node": F.col("child")})
        level = stored(_arrived(matched), "level")
        levels.append(level)
    pairs = None
    for level in levels:
        found = level.where("other IS NOT NULL").select("id", "n", F.col("other.id").alias("other_id"), F.col("other.n").alias("other_n"))
        pairs = found if pairs is None else pairs.union(found)
    pairs = pairs.distinct()
    return pairs.union(pairs.select(F.col("other_id"), F.col("other_n"), F.col("id"), F.col("n")))


def _roots(forms: DataFrame) -> DataFrame:
    """Last id on the way from each id along its forms: columns id and root, by doubled steps."""
    current = stored(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("id").alias("root"), F.col("root").alias("further"))
        longer = current.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = stored(longer, "roots")
        if longer.where("moved").isEmpty():
            return longer.select("id", "root")
        current = longer.select("id", "root")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Each word with its more frequent form, the end of its chain of forms, and its near words.

    ``words`` has word and n (occurrences). Two words are near when exactly one code point
    is inserted, deleted or replaced between them. A word's form is its near word of
    largest n (ties: least in code-point order), if that n is at least ``ratio`` times its
    own. Returns word, form, root, n, n_near and form_n; root is the word itself where
    there is no form, and the other two are null then.

    Rows without a word or n are left out; rows of the same word are added up; the empty
    word is a word. Words may be of any length. An empty table gives an empty one; other
    columns are ignored. With a ratio of at most 1, forms could go round in circles, so it has to be
    above 1.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    known = words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    # ids in code-point order, so ties between words are ties between ids
    placed = known.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    table = stored(placed, "words")
    pairs = near_pairs(table)
    best = F.max(F.struct(F.col("other_n").alias("n"), (-F.col("other_id")).alias("down")))
    near = pairs.groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    chosen = F.col("best.n") >= ratio * F.col("n")
    near = near.select(
        "id", "n_near", F.when(chosen, -F.col("best.down")).alias("form_id"), F.when(chosen, F.col("best.n")).alias("form_n")
    )
    near = stored(near, "near")
    roots = _roots(near.where("form_id IS NOT NULL"))
    ends = near.where("form_id IS NOT NULL").join(roots, "id").select("id", "form_id", "form_n", "root")
    names = table.select(F.col("id"), "word")
    ends = ends.join(names.toDF("form_id", "form"), "form_id").join(names.toDF("root", "root_word"), "root")
    counted = table.join(near.select("id", "n_near"), "id", "left").join(ends.select("id", "form", "form_n", "root_word"), "id", "left")
    return counted.select(
        "word",
        "form",
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        "form_n",
    )
