"""Line fits out of stored moments, so that new rows do not read old ones again.

The moments of a set of rows (number, means, centred sums) are a row for each target; the
moments of two sets combine without cancellation, and a line follows from them. Moments
are stored for each part (a file, a day, a split) and combined for any choice of parts.
Only first-stage fits can be kept so: a second stage fits rounded residuals of the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.columns import nan_to_null

MOMENTS = ("rows", "control_rows", "control_mean", "pairs", "x_mean", "y_mean", "sxx", "sxy", "syy")


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def line_moments(df: DataFrame, targets: Sequence[str], control: str, by: Sequence[str] = ()) -> DataFrame:
    """Moments of every target against the control: ``by``, target and MOMENTS.

    Pairs with a null or NaN side are only counted. Sums are centred by Spark's own
    mergeable aggregates, so large offsets do not cancel.
    """
    x = nan_to_null(_name(control))
    long = df.select(
        *(_name(g).alias(g) for g in by), x.alias("__x"), F.posexplode(F.array(*(nan_to_null(_name(t)) for t in targets))).alias("__t", "__y")
    )
    x, y = F.col("__x").cast("double"), F.col("__y").cast("double")
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    pairs = F.count_if(both)
    sums = long.groupBy(*(_name(g) for g in by), "__t").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("control_rows"),
        F.avg(x).alias("control_mean"),
        pairs.alias("pairs"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_avgy(y, x).alias("y_mean"),
        F.coalesce(F.regr_sxx(y, x), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.regr_sxy(y, x), F.lit(0.0)).alias("sxy"),
        F.coalesce(F.regr_syy(y, x), F.lit(0.0)).alias("syy"),
    )
    target = F.get(F.array(*(F.lit(t) for t in targets)), F.col("__t"))
    return sums.select(*(_name(g) for g in by), target.alias("target"), *MOMENTS)


def merged_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of all rows together, for each ``by`` and target.

    The centred sum of the whole is the sum of those of the parts plus what the distances of
    their means from the common mean add; means first, so that nothing large cancels.
    """
    keys = [_name(k) for k in (*by, "target")]
    zero = F.lit(0.0)

    def weighted(mean: str, count: str) -> Column:
        total = F.sum(count)
        return F.when(total > 0, F.sum(F.col(mean) * F.col(count)) / total)

    centre = moments.groupBy(*keys).agg(
        weighted("control_mean", "control_rows").alias("__c"), weighted("x_mean", "pairs").alias("__x"), weighted("y_mean", "pairs").alias("__y")
    )
    old = moments.alias("m")
    names = [*by, "target"]
    same = [F.col(f"m.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in names]
    joined = old.join(centre.alias("c"), same)
    dx, dy, n = F.col("x_mean") - F.col("__x"), F.col("y_mean") - F.col("__y"), F.col("pairs")
    return joined.groupBy(*(F.col(f"m.`{k}`").alias(k) for k in names)).agg(
        F.sum("rows").alias("rows"),
        F.sum("control_rows").alias("control_rows"),
        F.first("__c").alias("control_mean"),
        F.sum("pairs").alias("pairs"),
        F.first("__x").alias("x_mean"),
        F.first("__y").alias("y_mean"),
        F.sum(F.col("sxx") + F.coalesce(n * dx * dx, zero)).alias("sxx"),
        F.sum(F.col("sxy") + F.coalesce(n * dx * dy, zero)).alias("sxy"),
        F.sum(F.col("syy") + F.coalesce(n * dy * dy, zero)).alias("syy"),
    )


def lines_from_moments(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lines that the moments amount to, in the columns of ``regression.fit_lines``.

    A constant control gives slope 0 and the mean as intercept; no pair gives nulls.
    """
    slope = F.when(F.col("pairs") > 0, F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0))
    return moments.select(
        *(_name(g) for g in by),
        "target",
        slope.alias("slope"),
        (F.col("y_mean") - slope * F.col("x_mean")).alias("intercept"),
        "control_mean",
        "pairs",
        (F.col("rows") - F.col("pairs")).alias("dropped"),
    )
