"""Prediction/reference pairs: alignment, filters and text scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.columns import has_text, strip
from caseloom.operators.sequences import token_rows

# METEOR weights.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def align_pairs(predictions: DataFrame, references: DataFrame, key: str = "row_id") -> DataFrame:
    """Put predictions next to references by row id."""
    return predictions.join(references, key)


def both_present(prediction: str = "prediction", reference: str = "reference") -> Column:
    return has_text(prediction) & has_text(reference)


def nonblank_pairs(
    df: DataFrame, prediction: str = "prediction", reference: str = "reference"
) -> DataFrame:
    """Pairs with text on both sides, stripped."""
    kept = df.where(both_present(prediction, reference))
    return kept.withColumns({c: strip(c) for c in (prediction, reference)})


def rejected_pairs(
    df: DataFrame,
    key: str = "row_id",
    prediction: str = "prediction",
    reference: str = "reference",
    show: int = 5,
    inputs: DataFrame | None = None,
) -> DataFrame:
    """First rejected pairs by id, each with the number of rejected pairs left out.

    ``inputs`` (the key and, say, the input text; a key at most once) is looked up for the
    pairs that are shown only.
    """
    bad = df.where(~both_present(prediction, reference))
    total = bad.agg(F.count("*")).scalar()
    shown = bad.orderBy(key).limit(show)
    if inputs is not None:  # a handful of rows, so the inputs are filtered where they lie
        found = inputs.join(F.broadcast(shown.select(key)), key, "left_semi")
        shown = shown.join(F.broadcast(found), key, "left")
    return shown.withColumn("more", F.greatest(total - F.lit(show), F.lit(0)))


def rejected_count(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    return df.agg(
        F.count_if(~both_present(prediction, reference)).alias("rejected"), F.count("*").alias("pairs")
    )


def meteor(
    df: DataFrame, key: str = "row_id", prediction: str = "prediction", reference: str = "reference"
) -> DataFrame:
    """METEOR, exact-match stage, per pair.

    Pairs are spread by id once, before words are unfolded; every later window
    and group refines that spread, so word rows are never shuffled. The k-th
    occurrence of a word from the end of one text meets the k-th from the end of
    the other.
    """
    spread = df.select(key, prediction, reference).repartition(key)
    rows = token_rows(spread, [key], {"hyp": F.lower(prediction), "ref": F.lower(reference)})
    from_end = Window.partitionBy(key, "field", "token").orderBy(F.col("pos").desc())
    numbered = rows.withColumn("nth", F.row_number().over(from_end))

    def at(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("pos")))

    met = numbered.groupBy(key, "token", "nth").agg(at("hyp").alias("h"), at("ref").alias("r"))
    matched = F.col("h").isNotNull() & F.col("r").isNotNull()
    along = Window.partitionBy(key, "matched").orderBy("h")
    follows = (F.col("h") == F.lag("h").over(along) + 1) & (F.col("r") == F.lag("r").over(along) + 1)
    chunked = met.withColumn("matched", matched).withColumn(
        "starts", F.col("matched") & ~F.coalesce(follows, F.lit(False))
    )
    counts = chunked.groupBy(key).agg(
        F.count_if("matched").alias("matches"),
        F.count_if("starts").alias("chunks"),
        F.count("h").alias("hyp_words"),
        F.count("r").alias("ref_words"),
    )
    m = F.col("matches")
    precision, recall = m / F.col("hyp_words"), m / F.col("ref_words")
    fmean = precision * recall / (F.lit(ALPHA) * precision + F.lit(1 - ALPHA) * recall)
    penalty = F.lit(GAMMA) * F.pow(F.col("chunks") / m, F.lit(BETA))
    return counts.withColumn("meteor", F.when(m > 0, fmean * (1 - penalty)).otherwise(0.0))


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


@F.pandas_udf(T.StructType([T.StructField(s, T.ArrayType(T.DoubleType())) for s in ("hyp", "ref")]))
def _best_cosines(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Best cosine of every vector of one block with the vectors of the other."""
    best = {"hyp": [], "ref": []}
    for a, b in zip(hyp, ref):
        cosine = _unit_rows(a) @ _unit_rows(b).T
        best["hyp"].append(cosine.max(axis=1))
        best["ref"].append(cosine.max(axis=0))
    return pd.DataFrame(best)


def embedding_match(
    tokens: DataFrame,
    pair: str = "row_id",
    side: str = "side",
    pos: str = "pos",
    vector: str = "vector",
    block: int = 256,
) -> DataFrame:
    """Greedy-match precision, recall and F1 of token vectors, per pair.

    ``side`` is ``hyp`` or ``ref``; ``pos`` numbers a side's tokens. Tokens travel
    in blocks, so a task multiplies two small matrices and neither a long pair
    nor its token combinations are ever held or written out as rows. A pair with
    tokens on one side only scores 0.
    """
    in_order = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(vector).alias("vector"))))
    blocks = (
        tokens.withColumn("block", F.floor(F.col(pos) / block))
        .groupBy(pair, side, "block")
        .agg(F.transform(in_order, lambda t: t["vector"]).alias("vectors"))
    )
    hyp, ref = (
        blocks.where(F.col(side) == s).select(
            pair, F.col("block").alias(f"{s}_block"), F.col("vectors").alias(f"{s}_vectors")
        )
        for s in ("hyp", "ref")
    )
    # which blocks meet is joined first, so that a long pair's vectors are many keys, not one
    meets = hyp.select(pair, "hyp_block").join(ref.select(pair, "ref_block"), pair)
    met = meets.join(hyp, [pair, "hyp_block"]).join(ref, [pair, "ref_block"])
    best = met.select(
        pair, "hyp_block", "ref_block", _best_cosines("hyp_vectors", "ref_vectors").alias("best")
    )

    def token_bests(s: str) -> Column:
        return F.transform(
            f"best.{s}",
            lambda c, i: F.struct(F.lit(s).alias("s"), F.col(f"{s}_block").alias("b"), i.alias("i"), c.alias("c")),
        )

    per_token = (
        best.select(pair, F.explode(F.concat(token_bests("hyp"), token_bests("ref"))).alias("t"))
        .groupBy(pair, "t.s", "t.b", "t.i")
        .agg(F.max("t.c").alias("c"))
    )

    def mean_of(s: str) -> Column:
        return F.avg(F.when(F.col("s") == s, F.col("c")))

    scores = per_token.groupBy(pair).agg(mean_of("hyp").alias("precision"), mean_of("ref").alias("recall"))
    every = tokens.select(pair).distinct().join(scores, pair, "left").fillna(0.0, ["precision", "recall"])
    p, r = F.col("precision"), F.col("recall")
    return every.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def mean_scores(scores: DataFrame, *names: str) -> DataFrame:
    """Mean of score columns over all pairs; null when there is no pair."""
    return scores.agg(*[F.avg(n).alias(n) for n in names])


def mean_pool(
    df: DataFrame, key: str, vector: str, mask: str | None = None, mask_pad: bool = False
) -> DataFrame:
    """Mean vector per key. Padded positions count unless ``mask_pad`` is set."""
    used = df.where(F.col(mask) == 1) if mask_pad and mask else df
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    return used.groupBy(key).agg(vector_to_array(Summarizer.mean(as_vector)).alias("mean"))
