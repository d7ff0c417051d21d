"""Two-class metrics from label, decision and score columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.scan import SEGMENT


def confusion(df: DataFrame, truth: str, decision: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(truth), F.col(decision)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def class_metrics(df: DataFrame, truth: str, decision: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1, sensitivity and specificity from one pass of counts.

    F1 without any positive is 0; the other ratios are null when undefined.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion(df, truth, decision, by).select(
        *by,
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def roc_auc(df: DataFrame, truth: str, score: str, segments: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing.

    Rows shrink to counts per distinct score first. Ranges of scores are then
    counted side by side, and only one row per range meets in a single task.
    """
    known = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(truth, score)
    counts = known.groupBy(score).agg(
        F.count_if(F.col(truth) == 1).cast("double").alias("pos"),
        F.count_if(F.col(truth) == 0).cast("double").alias("neg"),
    )
    dealt = counts.repartitionByRange(segments, score) if segments else counts.repartitionByRange(score)
    per_score = dealt.withColumn(SEGMENT, F.spark_partition_id())
    below = Window.partitionBy(SEGMENT).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.sum("neg").over(below), F.lit(0.0)) + F.col("neg") / 2
    per_segment = (
        per_score.select(SEGMENT, "pos", "neg", (F.col("pos") * beaten).alias("won"))
        .groupBy(SEGMENT)
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    )
    earlier = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    won = per_segment.select("pos", "neg", (F.col("won") + F.col("pos") * carried).alias("won"))
    return won.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("won").alias("w")).select(
        _ratio(F.col("w"), F.col("p") * F.col("n")).alias("roc_auc")
    )
