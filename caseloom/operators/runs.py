"""Training histories as tables: losses, best epochs, stopping and learning rates.

A run may be of any length: everything along its epochs is a segmented scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.scan import Running, running, step_segment, with_value_segments
from caseloom.session import stored

def epoch_loss(
    batches: DataFrame, by: Sequence[str] = ("run_id", "epoch"), loss: str = "loss", rows: str | None = None
) -> DataFrame:
    """Mean loss per epoch over all batches, a failed (null) batch counting as 0.

    With a ``rows`` column also the row-weighted mean over the good batches.
    """
    good = F.col(loss).isNotNull()
    extra = []
    if rows:
        size = F.sum(F.when(good, F.col(rows)))
        extra = [F.when(size > 0, F.sum(F.col(loss) * F.col(rows)) / size).alias("weighted_loss")]
    return batches.groupBy(*by).agg(
        F.count("*").alias("batches"),
        F.count_if(~good).alias("failed"),
        (F.sum(F.coalesce(F.col(loss), F.lit(0.0))) / F.count("*")).alias("mean_loss"),
        *extra,
    )


def running_loss(
    batches: DataFrame, keys: Sequence[str] = ("run_id", "epoch"), step: str = "batch", loss: str = "loss"
) -> DataFrame:
    """Mean loss so far within each epoch; failed batches count as 0."""
    scanned = running(
        batches,
        keys,
        [step],
        [
            Running("__sum", "sum", F.coalesce(F.col(loss), F.lit(0.0))),
            Running("__seen", "sum", F.lit(1).cast("bigint")),
        ],
        step_segment(step),
    )
    return scanned.withColumn("running_loss", F.col("__sum") / F.col("__seen")).drop("__sum", "__seen")


def epoch_eta(
    history: DataFrame, total_epochs: int, run: str = "run_id", epoch: str = "epoch", seconds: str = "epoch_seconds"
) -> DataFrame:
    """Elapsed time, mean epoch time and expected remaining time after each epoch."""
    scanned = running(
        history, [run], [epoch], [Running("elapsed", "sum", F.col(seconds))], step_segment(epoch)
    )
    mean = F.col("elapsed") / F.col(epoch)
    return scanned.withColumns(
        {"mean_epoch": mean, "remaining": mean * (F.lit(total_epochs) - F.col(epoch))}
    )


def _number(loss: str) -> Column:
    """The loss where it can improve on anything: NaN and infinity cannot."""
    return F.when(F.col(loss) < math.inf, F.col(loss))


def _best_before(loss: str) -> Running:
    return Running("best_before", "min", _number(loss), through=False)


def _beats(loss: str) -> Column:
    return F.coalesce(_number(loss) < F.coalesce("best_before", F.lit(math.inf)), F.lit(False))


def best_so_far(history: DataFrame, loss: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Best loss through each epoch and whether the epoch is a strict improvement.

    A NaN or infinite loss improves on nothing and is no best.
    """
    scanned = running(
        history.where(F.col(loss).isNotNull()), [run], [epoch], [_best_before(loss)], step_segment(epoch)
    )
    return scanned.withColumns(
        {"improved": _beats(loss), "best": F.least(_number(loss), F.col("best_before"))}
    ).drop("best_before")


def best_epoch(history: DataFrame, loss: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """First epoch with the lowest loss, per run; nulls for a run without a finite loss."""
    row = F.struct(F.col(loss).alias("best_loss"), F.col(epoch).alias("best_epoch"))
    least = F.min(F.when(_number(loss).isNotNull(), row))
    return history.groupBy(run).agg(least.alias("b")).select(run, "b.best_loss", "b.best_epoch")


def _bar(best: Column, relative: float, absolute: float) -> Column:
    """The value a loss must fall below to count as an improvement on ``best``."""
    return best - F.abs(best) * F.lit(relative) - F.lit(absolute)


def numbered_checks(history: DataFrame, loss: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Rows with a loss, numbered per run (``check``); new minima are marked ``lowest``.

    Stored once, because what follows reads it several times.
    """
    scanned = running(
        history.where(F.col(loss).isNotNull()).select(run, epoch, loss),
        [run],
        [epoch],
        [Running("check", "sum", F.lit(1).cast("bigint")), _best_before(loss)],
        step_segment(epoch),
    )
    return stored(scanned.withColumn("lowest", _beats(loss)).drop("best_before"))


def improvements(
    checks: DataFrame,
    loss: str,
    run: str = "run_id",
    epoch: str = "epoch",
    relative: float = 0.0,
    absolute: float = 0.0,
) -> DataFrame:
    """Checks that improve on the best loss so far.

    Without a margin an improvement is a new minimum. With one, the best value is
    not simply the minimum so far, because small gains do not count; then
    improvements form a chain through the new minima of the run. The relative
    margin is a share of the best loss without its sign, so a loss below zero
    has to fall further, too.
    """
    minima = checks.where("lowest").select(run, epoch, "check", F.col(loss).alias("loss"))
    if not relative and not absolute:
        return minima
    minima = stored(minima)
    longest = minima.groupBy(run).count().agg(F.max("count")).first()[0] or 0
    return _doubled_chain(minima, run, epoch, relative, absolute, longest)


def _doubled_chain(
    minima: DataFrame, run: str, epoch: str, relative: float, absolute: float, longest: int
) -> DataFrame:
    """The chain, by joins whose reach doubles every round.

    Minima fall along a run, so the successor of a minimum is found by counting
    the minima that are not below its bar.
    """
    asked = _bar(F.col("loss"), relative, absolute)
    both = minima.select(
        run,
        epoch,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("asks"), (-F.col("loss")).alias("down")),
                F.struct(F.lit(1).alias("asks"), (-asked).alias("down")),
            )
        ).alias("r"),
    ).select(run, epoch, "r.*")
    cut = with_value_segments(both, "down", run, "asks", epoch)
    counted = running(
        cut, [run], ["down", "asks", epoch], [Running("seen", "sum", (1 - F.col("asks")).cast("bigint"))]
    )
    links = stored(
        counted.groupBy(run, epoch).agg(
            F.max(F.when(F.col("asks") == 0, F.col("seen"))).alias("at"),
            F.max(F.when(F.col("asks") == 1, F.col("seen") + 1)).alias("to"),
        )
    )
    jumps = links.select(run, "at", "to")
    reached = jumps.where("at = 1").select(run, "at")
    for _ in range(math.ceil(math.log2(max(longest, 2)))):
        ahead = reached.join(jumps, [run, "at"]).select(run, F.col("to").alias("at"))
        reached = stored(reached.unionByName(ahead.join(links, [run, "at"], "left_semi")))
        second = jumps.select(run, F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = stored(jumps.join(second, [run, "to"]).select(run, "at", F.col("beyond").alias("to")))
    kept = links.join(reached, [run, "at"], "left_semi").select(run, epoch)
    return minima.join(kept, [run, epoch], "left_semi").select(run, epoch, "check", "loss")


def _last_improvement(
    checks: DataFrame, better: DataFrame, run: str, epoch: str, rising: Sequence[str] = ()
) -> DataFrame:
    """Add number, epoch and loss of the latest improvement, and the checks since then (``waited``).

    Along a run's improvements the loss falls and the rest (also the ``rising``
    columns of ``better``) never does, so the latest values are a minimum and maxima.
    """
    at = better.select(
        run,
        epoch,
        F.col("check").alias("__check"),
        F.col("loss").alias("__loss"),
        *[F.col(c).alias(f"__{c}") for c in rising],
    )
    latest = [
        Running("last_check", "max", F.col("__check")),
        Running("last_epoch", "max", F.when(F.col("__check").isNotNull(), F.col(epoch))),
        Running("last_loss", "min", F.col("__loss")),
        *[Running(f"last_{c}", "max", F.col(f"__{c}")) for c in rising],
    ]
    scanned = running(checks.join(at, [run, epoch], "left"), [run], [epoch], latest, step_segment(epoch))
    return scanned.withColumns(
        {"improved": F.col("__check").isNotNull(), "waited": F.col("check") - F.coalesce("last_check", F.lit(0))}
    ).drop("__check", "__loss", *[f"__{c}" for c in rising])


def patience_counter(
    history: DataFrame,
    loss: str,
    run: str = "run_id",
    epoch: str = "epoch",
    min_delta: float = 0.0,
) -> DataFrame:
    """Checks without improvement, after each check. A NaN loss counts as a check."""
    checks = numbered_checks(history, loss, run, epoch)
    better = improvements(checks, loss, run, epoch, absolute=min_delta)
    return _last_improvement(checks, better, run, epoch)


def early_stop(
    history: DataFrame,
    loss: str,
    patience: int = 10,
    min_delta: float = 0.0,
    run: str = "run_id",
    epoch: str = "epoch",
) -> DataFrame:
    """Per run the epoch that stops training (null: none) and the best one by then.

    A run without any check has nulls throughout.
    """
    counted = patience_counter(history, loss, run, epoch, min_delta)
    due = F.when(F.col("waited") >= patience, F.col(epoch))
    stopped = F.min(due)

    def then(value: str) -> Column:
        """The value at the stop, or at the last check of a run that never stops."""
        return F.when(stopped.isNotNull(), F.min_by(value, due)).otherwise(F.max_by(value, epoch))

    found = counted.groupBy(run).agg(
        stopped.alias("stop_epoch"),
        then("last_epoch").alias("best_epoch"),
        then("last_loss").alias("best_loss"),
    )
    return history.select(run).distinct().join(found, run, "left")


def lr_plateau(
    history: DataFrame,
    loss: str,
    lr: float,
    factor: float = 0.5,
    patience: int = 3,
    threshold: float = 1e-4,
    min_lr: float = 0.0,
    eps: float = 1e-8,
    run: str = "run_id",
    epoch: str = "epoch",
) -> DataFrame:
    """Learning rate after each check, cut by ``factor`` after too many bad checks.

    The count of bad checks restarts at an improvement and at a cut, so a cut
    falls on every ``patience + 1``-th check since the last improvement. A cut
    that would change the rate by no more than ``eps`` is not made.
    """
    checks = numbered_checks(history, loss, run, epoch)
    better = improvements(checks, loss, run, epoch, relative=threshold)
    # cuts in the stretches that an improvement has closed
    by_check = step_segment("check")
    since = running(better, [run], ["check"], [Running("prev", "max", F.col("check"), through=False)], by_check)
    closed = F.floor((F.col("check") - F.coalesce("prev", F.lit(0)) - 1) / (patience + 1))
    summed = running(since, [run], ["check"], [Running("closed", "sum", closed)], by_check)
    scanned = _last_improvement(checks, summed, run, epoch, ["closed"])
    cuts = F.coalesce("last_closed", F.lit(0)) + F.floor(F.col("waited") / (patience + 1))
    rates = [lr]  # one entry per cut that takes effect
    while rates[-1] - max(rates[-1] * factor, min_lr) > eps:
        rates.append(max(rates[-1] * factor, min_lr))
    ladder = F.array(*[F.lit(r) for r in rates])
    made = F.least(cuts, F.lit(len(rates) - 1)).cast("int")
    return scanned.select(run, epoch, loss, "improved", "waited", cuts.alias("cuts"), F.get(ladder, made).alias("lr"))
