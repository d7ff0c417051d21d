"""Parameter importance by variance decomposition over a random forest.

A tree over n parameters is a step function on boxes of the unit cube. The mean square of
the function after all parameters but some are averaged out is a sum over pairs of its
boxes, so the share of the variance that a parameter, or a pair of them, accounts for
comes from one join of the boxes with themselves, tree by tree.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import mul

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.trials import param_scaled

_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^( *)Predict: (\S+)$")


def forest(trials: DataFrame, params: Sequence[str], value: str, trees: int = 32, depth: int = 6, seed: int = 42):
    """A random forest of the objective over the parameters, which are already scaled to [0, 1]."""
    rows = VectorAssembler(inputCols=list(params), outputCol="__x").transform(trials)
    grown = RandomForestRegressor(
        featuresCol="__x", labelCol=value, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed
    )
    return grown.fit(rows)


def boxes(spark: SparkSession, model: RandomForestRegressionModel, params: int) -> DataFrame:
    """The leaves of all trees: tree, leaf, value, and the bounds of each parameter.

    At most ``2 ** depth`` rows for each tree.
    """
    rows = []
    for number, tree in enumerate(model.trees):
        leaf, path = 0, []  # path: (indent, parameter, is upper bound, threshold)
        for line in tree.toDebugString.splitlines()[1:]:
            if split := _SPLIT.match(line):
                indent = len(split[1])
                path = [p for p in path if p[0] < indent]
                path.append((indent, int(split[3]), split[4] == "<=", float(split[5])))
            elif end := _LEAF.match(line):
                low, high = [0.0] * params, [1.0] * params
                for indent, param, upper, at in path:
                    if indent < len(end[1]):
                        side = high if upper else low
                        side[param] = min(high[param], at) if upper else max(low[param], at)
                rows.append((number, leaf, float(end[2]), low, high))
                leaf += 1
    schema = "tree int, leaf int, value double, low array<double>, high array<double>"
    return spark.createDataFrame(rows, schema)


def _squares(found: DataFrame, n: int, subsets: Sequence[tuple[int, ...]]) -> DataFrame:
    """For each tree its mean, and the mean square of its part in each subset of parameters."""
    other = found.select("tree", F.col("value").alias("v2"), F.col("low").alias("l2"), F.col("high").alias("h2"))

    def apart(i: int) -> Column:
        return (F.col("high")[i] - F.col("low")[i]) * (F.col("h2")[i] - F.col("l2")[i])

    def shared(i: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col("high")[i], F.col("h2")[i]) - F.greatest(F.col("low")[i], F.col("l2")[i]))

    sizes = reduce(mul, (F.col("high")[i] - F.col("low")[i] for i in range(n)))
    means = found.groupBy("tree").agg(F.sum(F.col("value") * sizes).alias("mean"))
    pairs = found.join(other, "tree")
    # each factor once per pair, whatever the number of subsets
    pairs = pairs.select(
        "tree", (F.col("value") * F.col("v2")).alias("v"), *(apart(i).alias(f"a{i}") for i in range(n)),
        *(shared(i).alias(f"s{i}") for i in range(n)),
    )
    sums = [
        F.sum(reduce(mul, (F.col(f"s{i}" if i in subset else f"a{i}") for i in range(n)), F.col("v"))).alias(f"u{k}")
        for k, subset in enumerate(subsets)
    ]
    return pairs.groupBy("tree").agg(*sums).join(means, "tree")


def variance_parts(found: DataFrame, params: Sequence[str]) -> DataFrame:
    """Variance of each tree by parameter and pair of parameters: tree, param, other, variance, total.

    The row without a param is the rest, which only more than two parameters together explain.
    """
    n = len(params)
    subsets = [(i,) for i in range(n)] + list(combinations(range(n), 2)) + [tuple(range(n))]
    squares = _squares(found, n, subsets)
    around = {subset: F.col(f"u{k}") - F.col("mean") * F.col("mean") for k, subset in enumerate(subsets[:-1])}
    total = F.col(f"u{len(subsets) - 1}") - F.col("mean") * F.col("mean")
    parts = [((params[i], None), around[i,]) for i in range(n)]
    parts += [((params[i], params[j]), around[i, j] - around[i,] - around[j,]) for i, j in combinations(range(n), 2)]
    rest = reduce(lambda a, b: a - b, (part for _, part in parts), total)
    parts.append(((None, None), rest))
    text = F.lit(None).cast("string")
    long = [
        F.struct((F.lit(a) if a else text).alias("param"), (F.lit(b) if b else text).alias("other"), part.alias("variance"))
        for (a, b), part in parts
    ]
    return squares.select("tree", total.alias("total"), F.explode(F.array(*long)).alias("p")).select("tree", "p.*", "total")


def param_fanova(
    trials: DataFrame, params: Sequence[str], value: str, trees: int = 32, depth: int = 6, seed: int = 42
) -> DataFrame:
    """Share of the objective's variance by parameter and pair: param, other, variance, importance.

    Parameters are scaled to [0, 1] over the table and taken as uniform there. Each tree's
    variance is split into the parts of single parameters, of pairs, and the rest (no
    param); ``variance`` is the mean over the trees, ``importance`` the mean of the shares, which
    add up to 1. Trials with a null or NaN in a parameter or the value are left out; when all
    values are equal the shares are 0. ``depth`` bounds the boxes of a tree to ``2 ** depth``.
    """
    names = [*params, value]
    known = trials.select(*(F.col(c).cast("double").alias(c) for c in names))
    for c in names:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    model = forest(param_scaled(known, params), params, value, trees, depth, seed)
    parts = variance_parts(boxes(trials.sparkSession, model, len(params)), params)
    share = F.when(F.col("total") > 0, F.col("variance") / F.col("total")).otherwise(0.0)
    return parts.groupBy("param", "other").agg(F.avg("variance").alias("variance"), F.avg(share).alias("importance"))
