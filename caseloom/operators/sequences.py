"""Text columns to fixed-length id sequences and back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.columns import words
from caseloom.operators.scan import global_index

# Ids of the special tokens; ordinary tokens follow.
PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2
FIRST_ID = 3

# Most frequent tokens joined by broadcast, if short; all others are joined by shuffle.
# So a broadcast holds at most 64 MB of words.
HEAD_TOKENS = 1_000_000
HEAD_WORD_BYTES = 64

# A place is the number of a field above this many bits of a position.
FIELD_BITS = 40


def token_rows(
    df: DataFrame, keep: Sequence[str], texts: Mapping[str, Column | str], limit: int | None = None
) -> DataFrame:
    """One row per word: the kept columns, ``field``, ``pos`` (from 0) and ``token``.

    A row without any word stays as one row with null token. ``limit`` keeps only the
    first words of each text, before any of them becomes a row.
    """

    def first(text: Column | str) -> Column:
        return words(text) if limit is None else F.slice(words(text), 1, limit)

    if len(texts) == 1:
        ((name, text),) = texts.items()
        return df.select(*keep, F.lit(name).alias("field"), F.posexplode_outer(first(text)).alias("pos", "token"))

    def numbered(name: str, text: Column | str) -> Column:
        return F.transform(
            first(text), lambda w, i: F.struct(F.lit(name).alias("field"), i.alias("pos"), w.alias("token"))
        )

    parts = [numbered(name, text) for name, text in texts.items()]
    return df.select(*keep, F.explode_outer(F.concat(*parts)).alias("w")).select(*keep, "w.*")


def token_counts(df: DataFrame, keep: Sequence[str], text: Column | str) -> DataFrame:
    """Occurrences of every word per row of ``df``."""
    rows = token_rows(df, keep, {"text": text}).where(F.col("token").isNotNull())
    return rows.groupBy(*keep, "token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text: Column | str, max_size: int | None = None) -> DataFrame:
    """Words with counts and ids, most frequent first, then by spelling.

    The result is stored in the checkpoint folder: it is read more than once and
    its ids must not change in between.
    """
    counts = token_counts(df, [], text)
    ranked = global_index(counts, [F.col("n").desc(), F.col("token").asc()], "rank")
    if max_size is not None:
        ranked = ranked.where(F.col("rank") <= max_size)
    return ranked.select("token", "n", (F.col("rank") + (FIRST_ID - 1)).alias("token_id"))


def _look_up(
    rows: DataFrame, vocab: DataFrame, key: str, value: str, head: int
) -> tuple[DataFrame, DataFrame | None]:
    """Left join of word rows with the vocabulary that no frequent word can skew, in two parts.

    The ``head`` most frequent words of up to HEAD_WORD_BYTES bytes are a bounded
    broadcast; their rows stay where they are. Only rows without a partner there, the
    second part, are shuffled, and their words are rare, or longer than words are.
    """
    short = (F.col("token_id") < FIRST_ID + head) & (F.octet_length("token") <= HEAD_WORD_BYTES)
    first = F.broadcast(vocab.where(short).select(key, value))
    rest = vocab.where(~short).select(key, value)
    if rest.isEmpty():
        return rows.join(first, key, "left"), None
    found = rows.join(first, key, "left").where(F.col(key).isNull() | F.col(value).isNotNull())
    rare = rows.where(F.col(key).isNotNull()).join(first, key, "left_anti").join(rest, key, "left")
    return found, rare


def _runs(rows: DataFrame, keep: Sequence[str], value: T.StructField, join: str | None = None) -> DataFrame:
    """One row per run: ``keep``, ``__place`` of the first word, and the values, joined by ``join`` if given.

    A run are rows one after another with equal keys and places that rise by one; a row
    without place stays alone. A run goes on to a grouping instead of its words, which a
    grouping would sort one by one and spill. How rows lie decides how long runs are, never
    the result of the grouping.
    """
    keys = [f"k{i}" for i in range(len(keep))]
    table = rows.select(*keep, "__place", value.name)
    kept = [T.StructField(k, f.dataType) for k, f in zip(keys, table.schema.fields)]
    made = value if join is not None else T.StructField(value.name, T.ArrayType(value.dataType))
    schema = T.StructType([*kept, T.StructField("__place", T.LongType()), made])

    # both functions travel whole: the tasks need no installed caseloom for them
    def same(key: pa.Array) -> np.ndarray:
        above, here = key.slice(0, len(key) - 1), key.slice(1)
        try:
            equal = pc.fill_null(pc.equal(above, here), False)
        except pa.ArrowNotImplementedError:  # nested keys are not compared: every row is a run
            return np.zeros(len(above), bool)
        return pc.or_(equal, pc.and_(above.is_null(), here.is_null())).to_numpy(zero_copy_only=False)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *columns, place, values = batch.columns
            places = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
            follows = (places[1:] == places[:-1] + 1) & (places[:-1] >= 0)
            for key in columns:
                follows = follows & same(key)
            starts = np.flatnonzero(np.append(True, ~follows))
            found = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), values)
            if join is not None:
                found = pc.binary_join(found, join)
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in (*columns, place)), found], schema.names)

    return table.toDF(*keys, "__place", value.name).mapInArrow(runs, schema).toDF(*keep, "__place", value.name)


def encode(rows: DataFrame, vocab: DataFrame, head: int = HEAD_TOKENS) -> DataFrame:
    """Add ``token_id`` to word rows; a word outside the vocabulary gets the unknown id."""
    found, rare = _look_up(rows, vocab, "token", "token_id", head)
    looked = found if rare is None else found.unionByName(rare)
    known = F.coalesce(F.col("token_id"), F.lit(UNKNOWN_ID).cast("bigint"))
    return looked.withColumn("token_id", F.when(F.col("token").isNotNull(), known))


def id_arrays(encoded: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Collect the ids of each text back into one array per field, in word order."""
    # fields lie far apart on one scale of places, so that a run stays inside its field
    which = F.coalesce(*[F.when(F.col("field") == f, i) for i, f in enumerate(fields)])
    place = F.shiftleft(which.cast("bigint"), FIELD_BITS) + F.col("pos")
    words = encoded.select(
        *keep,
        F.when(F.col("token_id").isNotNull(), place).alias("__place"),
        F.col("token_id").cast("int").alias("__ids"),
    )
    runs = _runs(words, keep, T.StructField("__ids", T.IntegerType()))

    def collected(i: int) -> Column:
        inside = F.shiftright("__place", FIELD_BITS) == i
        return F.sort_array(F.collect_list(F.when(inside, F.struct("__place", "__ids"))))

    def ids(runs: str) -> Column:
        # null as soon as a run starts before the end of an earlier one: rows of equal keys
        end = F.aggregate(
            runs,
            F.lit(0).cast("bigint"),
            lambda end, r: F.when(r["__place"] >= end, r["__place"] + F.size(r["__ids"])),
        )

        # position and id share one number: cheaper to sort than pairs
        def packed(r: Column) -> Column:
            at = lambda i: F.shiftleft((r["__place"] + i).bitwiseAND(F.lit((1 << 31) - 1)), 32)
            return F.transform(r["__ids"], lambda x, i: at(i).bitwiseOR(x.cast("bigint")))

        in_order = F.sort_array(F.flatten(F.transform(runs, packed)))
        mixed = F.transform(in_order, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
        return F.when(end.isNotNull(), F.flatten(F.transform(runs, lambda r: r["__ids"]))).otherwise(mixed)

    grouped = runs.groupBy(*keep).agg(*[collected(i).alias(f) for i, f in enumerate(fields)])
    return grouped.select(*keep, *[ids(f).alias(f) for f in fields])


def fixed_length(
    ids: Column | str, max_len: int, pad_id: int = PAD_ID, end_id: int | None = END_ID
) -> tuple[Column, Column]:
    """Ids cut on the right and padded to ``max_len``, and the attention mask.

    With an end id the text keeps one place less and the end id closes it.
    """
    ids = F.col(ids) if isinstance(ids, str) else ids
    room = max_len if end_id is None else max_len - 1
    kept = F.slice(ids, 1, room) if room else F.array().cast("array<int>")
    if end_id is not None:
        kept = F.concat(kept, F.array(F.lit(end_id)))
    padding = F.lit(max_len) - F.size(kept)
    return (
        F.concat(kept, F.array_repeat(F.lit(pad_id), padding)),
        F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), padding)),
    )


def examples(
    df: DataFrame,
    vocab: DataFrame,
    keep: Sequence[str],
    prompt: Column | str,
    target: Column | str,
    max_len: int = 512,
    class_label: str = "cancer_risk",
) -> DataFrame:
    """Model input per row: ``input_ids``, ``attention_mask``, ``labels``, ``class_labels``.

    ``keep`` must identify a row.
    """
    columns = [*keep, class_label]
    rows = token_rows(df, columns, {"prompt": prompt, "target": target}, limit=max(max_len - 1, 0))
    arrays = id_arrays(encode(rows, vocab), columns, ["prompt", "target"])
    input_ids, mask = fixed_length("prompt", max_len)
    labels, _ = fixed_length("target", max_len)
    return arrays.select(
        *keep,
        input_ids.alias("input_ids"),
        mask.alias("attention_mask"),
        labels.alias("labels"),
        F.col(class_label).cast("int").alias("class_labels"),
    )


def decode(
    df: DataFrame, vocab: DataFrame, keep: Sequence[str], ids: str, name: str = "text", head: int = HEAD_TOKENS
) -> DataFrame:
    """Ids back to text with single spaces; special ids are skipped. ``keep`` identifies a row."""
    # rows of equal keys share one text, whose words at equal positions go by spelling
    lists = df.groupBy(*keep).agg(F.collect_list(ids).alias("__lists"))
    lists = lists.select(*keep, (F.size("__lists") > 1).alias("__mixed"), F.explode_outer("__lists").alias("__ids"))
    rows = lists.select(*keep, "__mixed", F.posexplode_outer("__ids").alias("pos", "token_id"))
    # every second place, so that no two mixed words form a run
    place = F.when(F.col("__mixed"), F.col("pos").cast("bigint") * 2).otherwise(F.col("pos"))
    # a skipped id stays as a row without id, so that a text of special ids only is kept
    rows = rows.select(
        *keep,
        place.alias("__place"),
        F.when(F.col("token_id") >= FIRST_ID, F.col("token_id").cast("bigint")).alias("token_id"),
    )
    found, rare = _look_up(rows, vocab, "token_id", "token", head)
    # words of the head are short, and so are the batches of runs
    placed = F.when(F.col("token").isNotNull(), F.col("__place"))
    runs = _runs(found.withColumn("__place", placed), keep, T.StructField("token", T.StringType()), join=" ")
    if rare is not None:
        runs = runs.unionByName(rare.select(*keep, "__place", "token"))
    words = F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("__place", "token"))))
    return runs.groupBy(*keep).agg(F.array_join(F.transform(words, lambda r: r["token"]), " ").alias(name))
