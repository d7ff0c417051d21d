"""A parameter search whose passes over the rows serve all trials at once.

Every trial is a logistic fit with its own penalty and class weight, on every fold. One
pass works out, in each task, the gradients and curvatures of all fits for its rows;
Spark adds them up, and the driver makes one Newton step for each fit. The number of
passes is that of the slowest fit, however many trials there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import stored

#: Sums of all fits of one pass, in a task and on the driver.
BLOCK_BYTES = 64 << 20
#: First level of the sums: so many groups for each fit.
SALTS = 64


@dataclass(frozen=True)
class Search:
    """``trials``: one row per trial with its parameters, ``value`` (mean held-out loss), rows
    and whether all its fits converged. ``weights``: trial, fold, intercept and coefficients."""

    trials: DataFrame
    weights: DataFrame
    passes: int


def _sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, fits: Sequence[tuple], weights: np.ndarray) -> np.ndarray:
    """For each fit: loss, weight, held-out loss and rows, gradient, upper half of the curvature."""
    n = x.shape[1]
    upper = np.triu_indices(n)
    out = np.zeros((len(fits), 4 + n + len(upper[0])))
    for held in {f[1] for f in fits}:
        own = [i for i, f in enumerate(fits) if f[1] == held]
        inside, outside = fold != held, fold == held
        xi, yi, beta = x[inside], y[inside], weights[own].T
        margin = xi @ beta
        positive = np.array([fits[i][3] for i in own])
        case = np.where(yi[:, None] == 1, positive, 1.0)
        # log(1 + exp(-margin)) of the true side, without overflow
        loss = np.logaddexp(0, np.where(yi[:, None] == 1, -margin, margin))
        p = np.exp(-np.logaddexp(0, -margin))
        gradient = xi.T @ (case * (p - yi[:, None]))
        bent = case * p * (1 - p)
        apart = np.logaddexp(0, np.where(y[outside][:, None] == 1, -1, 1) * (x[outside] @ beta))
        for k, i in enumerate(own):
            curvature = (xi * bent[:, k : k + 1]).T @ xi
            out[i] = np.concatenate(
                [[(case * loss)[:, k].sum(), case[:, k].sum(), apart[:, k].sum(), outside.sum()], gradient[:, k], curvature[upper]]
            )
    return out


def _pass(rows: DataFrame, fits: list[tuple], weights: np.ndarray) -> np.ndarray:
    """The sums of all fits over all rows: one job."""
    sent = rows.sparkSession.sparkContext.broadcast((fits, weights))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        todo, beta = sent.value
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(len(flat)), flat])
            found = _sums(x, batch.column("y").to_numpy(), batch.column("fold").to_numpy(), todo, beta)
            total = found if total is None else total + found
        if total is not None:
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_pydict(
                {"fit": np.arange(len(total)), "salt": np.full(len(total), salt), "sums": list(total)}
            )

    parts = rows.mapInArrow(partial, "fit bigint, salt bigint, sums array<double>")
    some = parts.groupBy("fit", "salt").agg(Summarizer.sum(array_to_vector("sums")).alias("v"))
    whole = some.groupBy("fit").agg(Summarizer.sum(F.col("v")).alias("v"))
    out = np.zeros((len(fits), 0))
    for row in whole.select("fit", vector_to_array("v").alias("v")).collect():
        out = np.zeros((len(fits), len(row.v))) if not out.size else out
        out[row.fit] = row.v
    return out


def _newton(rows: DataFrame, fits: list[tuple], width: int, most: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Weights, last sums and convergence of all fits, and the passes it took.

    A step that makes the objective worse is halved in the next pass.
    """
    weights = np.zeros((len(fits), width))
    before, base = np.full(len(fits), np.inf), weights.copy()
    final = np.zeros((len(fits), 4))
    done = np.zeros(len(fits), bool)
    upper = np.triu_indices(width)
    step = np.zeros_like(weights)
    passes = 0
    while passes < most and not done.all():
        open_fits = np.flatnonzero(~done)
        sums = _pass(rows, [fits[i] for i in open_fits], weights[open_fits])
        passes += 1
        if not sums.size:
            break
        for i, s in zip(open_fits, sums):
            penalty = np.full(width, fits[i][2])
            penalty[0] = 0
            size = max(s[1], 1e-300)
            objective = s[0] / size + (penalty * weights[i] ** 2).sum() / 2
            final[i] = s[:4]
            if objective > before[i] + 1e-12 * abs(before[i]):
                step[i] /= 2
                weights[i] = base[i] + step[i]
                continue
            bent = np.zeros((width, width))
            bent[upper] = s[4 + width :] / size
            bent = bent + np.triu(bent, 1).T + np.diag(penalty)
            change = -np.linalg.lstsq(bent, s[4 : 4 + width] / size + penalty * weights[i], rcond=1e-14)[0]
            if np.abs(change).max() <= tol * (1 + np.abs(weights[i]).max()):
                done[i] = True
                continue
            before[i], base[i], step[i] = objective, weights[i], change
            weights[i] = weights[i] + change
    return weights, final, done, passes


def search_trials(
    rows: DataFrame,
    grid: DataFrame,
    features: str = "features",
    label: str = "cancer_risk",
    fold: str = "fold",
    trial: str = "trial",
    reg: str = "reg",
    positive_weight: str = "positive_weight",
    max_passes: int = 50,
    tol: float = 1e-9,
) -> Search:
    """Fit every trial on every fold's other rows, and judge it by the loss on the fold.

    ``rows`` has an array of features, a label (0 or 1) and a whole-number fold; ``grid``
    has a trial id, the ridge penalty ``reg`` (above 0 wherever classes may be
    separable) and the weight of label 1. A fit minimises the weighted mean log loss plus
    half of reg times the squared coefficients (not the intercept). ``value`` is the mean
    unweighted log loss over all rows, each scored by the fit that has not seen it.

    Rows with a null or NaN anywhere, or another number of features than the first row, are left out; so are
    trials without a parameter. Without rows or trials the result is empty. A grid is a stated, small
    set: it is read to the driver. Beyond BLOCK_BYTES of sums, trials are searched in blocks.
    """
    spark = rows.sparkSession
    x = F.col(features).cast("array<double>")
    known = rows.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("bigint").alias("fold"))
    known = known.where(F.col("y").isin(0.0, 1.0) & F.col("fold").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    first = known.select(F.size("x").alias("size")).first()
    names = list(grid.columns)
    drawn = grid.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (trial, reg, positive_weight))).orderBy(trial).collect()
    id_type = grid.schema[trial].dataType.simpleString()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema)
    trial_schema = f"{columns}, value double, rows bigint, converged boolean"
    weight_schema = f"`{trial}` {id_type}, fold bigint, intercept double, coefficients array<double>"
    if first is None or not drawn:
        return Search(spark.createDataFrame([], trial_schema), spark.createDataFrame([], weight_schema), 0)
    width = first.size + 1
    table = stored(known.where(F.size("x") == first.size), "search")
    folds = sorted(r.fold for r in table.select("fold").distinct().collect())
    per_block = max(1, BLOCK_BYTES // (8 * len(folds) * (4 + width + width * (width + 1) // 2)))
    trial_rows, weight_rows, passes = [], [], 0
    for start in range(0, len(drawn), per_block):
        block = drawn[start : start + per_block]
        fits = [(k, held, float(row[reg]), float(row[positive_weight])) for k, row in enumerate(block) for held in folds]
        weights, final, done, took = _newton(table, fits, width, max_passes, tol)
        passes += took
        for k, row in enumerate(block):
            own = [i for i, f in enumerate(fits) if f[0] == k]
            seen = final[own, 3].sum()
            value = float(final[own, 2].sum() / seen) if seen else None
            trial_rows.append((*(row[c] for c in names), value, int(seen), bool(done[own].all())))
            weight_rows += [(row[trial], folds[j], float(weights[i][0]), weights[i][1:].tolist()) for j, i in enumerate(own)]
    return Search(spark.createDataFrame(trial_rows, trial_schema), spark.createDataFrame(weight_rows, weight_schema), passes)


def score_equations(
    scored: DataFrame, features: str, label: str, probability: str, coefficients: Sequence[float], reg: float
) -> DataFrame:
    """How far a fitted classifier is from the optimum of its features: one row per feature.

    ``gradient`` is the mean of (probability - label) times the centred and scaled
    feature, ``ridge`` the penalty's part, ``reg`` times the coefficient of the scaled
    feature; at the optimum they cancel out (``residual`` 0). ``coefficients`` belong to the
    features as they are, in the order of the array; a constant feature has gradient 0.
    One pass for the sums; rows with gaps are left out.
    """
    known = scored.where(f"`{probability}` IS NOT NULL AND `{label}` IS NOT NULL")
    long = known.select((F.col(probability) - F.col(label)).alias("r"), F.posexplode(F.col(features)).alias("feature", "x"))
    sums = long.groupBy("feature").agg(
        F.avg(F.col("r") * F.col("x")).alias("rx"), F.avg("r").alias("r"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")
    )
    own = F.get(F.array(*[F.lit(float(c)) for c in coefficients]), F.col("feature"))
    gradient = F.when(F.col("sd") > 0, (F.col("rx") - F.col("r") * F.col("mean")) / F.col("sd")).otherwise(0.0)
    ridge = F.lit(float(reg)) * own * F.col("sd")
    return sums.select("feature", gradient.alias("gradient"), ridge.alias("ridge"), (gradient + ridge).alias("residual"))
