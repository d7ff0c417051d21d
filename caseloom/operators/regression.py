"""Least-squares normalisation of many reading columns against control columns.

All lines are fitted in one aggregate. Without groups the coefficients enter the
projection as one scalar subquery, so the wide table is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.columns import nan_to_null, round_half_even, zero_label
from caseloom.session import stored

# The reading grid and its control columns.
SIDES = ("R", "L")
POSITIONS = tuple(range(10))
KINDS = ("int", "sk")
INTERNAL_CONTROLS = ("T1 int", "T1 sk")


def reading_columns(
    available: Iterable[str],
    sides: Sequence[str] = SIDES,
    kinds: Sequence[str] = KINDS,
) -> list[str]:
    """Reading columns present in ``available``, by side, position and kind."""
    present = set(available)
    grid = (f"{s}{p} {k}" for s in sides for p in POSITIONS for k in kinds)
    return [name for name in grid if name in present]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def fit_lines(
    df: DataFrame, targets: Sequence[str], control: str, group_by: Sequence[str] = ()
) -> DataFrame:
    """Straight lines of every target on ``control``: one row per group and target.

    Pairs with a missing side are left out and counted. A constant control gives
    slope 0 and the mean as intercept. Targets are unfolded into rows, so that
    forty columns cost one short aggregate and still one scan.
    """
    unfolded = df.select(
        *[_quoted(g) for g in group_by],
        nan_to_null(_quoted(control)).alias("__x"),
        F.posexplode(F.array(*[nan_to_null(_quoted(t)) for t in targets])).alias("__target", "__y"),
    )
    y, x = F.col("__y"), F.col("__x")
    sums = unfolded.groupBy(*group_by, "__target").agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_avgy(y, x).alias("y_mean"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.avg(x).alias("control_mean"),
        F.regr_count(y, x).alias("pairs"),
        F.count("*").alias("rows"),
    )
    slope = F.when(F.col("pairs") > 0, F.coalesce(F.col("slope"), F.lit(0.0)))
    return sums.select(
        *[_quoted(g) for g in group_by],
        F.array(*[F.lit(t) for t in targets])[F.col("__target")].alias("target"),
        slope.alias("slope"),
        (F.col("y_mean") - slope * F.col("x_mean")).alias("intercept"),
        "control_mean",
        "pairs",
        (F.col("rows") - F.col("pairs")).alias("dropped"),
    )


def _with_fits(
    df: DataFrame, fits: DataFrame, targets: Sequence[str], group_by: Sequence[str]
) -> DataFrame:
    """``df`` with its coefficients in ``__fit``: a scalar subquery, or a join by group.

    A named column holds the subquery, so that the plan contains it once however
    many targets read it.
    """
    line = F.struct("target", F.struct("slope", "intercept", "control_mean"))
    by_target = F.map_from_entries(F.collect_list(line)).alias("lines")  # one entry per target
    packed = F.struct(*[F.col("lines")[t].alias(t) for t in targets]).alias("__fit")
    if not group_by:
        return df.withColumn("__fit", fits.agg(by_target).select(packed).scalar())
    renamed = [_quoted(g).alias(f"__g_{g}") for g in group_by]
    packed_fits = stored(fits.groupBy(*renamed).agg(by_target).select(*[f"`__g_{g}`" for g in group_by], packed))
    same = [_quoted(g).eqNullSafe(F.col(f"`__g_{g}`")) for g in group_by]
    # stored: its size is known, so Spark broadcasts it only below the session's limit
    return df.join(packed_fits, same, "left")


def _not_nan(c: Column) -> Column:
    """``nan_to_null`` of a double as a higher-order function.

    Spark writes a stage's projections into one method, and the JVM does not compile long
    methods: 20 targets took 50 µs a row. A projection with a higher-order function is
    evaluated apart from that method and in short ones, so one target uses this form.
    """
    return F.get(F.filter(F.array(c), lambda v: ~F.isnan(v)), F.lit(0))


def _replace(
    df: DataFrame,
    targets: Sequence[str],
    control: str,
    group_by: Sequence[str],
    fits: DataFrame | None,
    formula: Callable[[Column, Column, Column], Column],
    digits: int | None,
) -> DataFrame:
    fits = fits if fits is not None else fit_lines(df, targets, control, group_by)
    joined, fit = _with_fits(df, fits, targets, group_by), F.col("__fit")
    wanted = set(targets)
    first = next((c for c in df.columns if c in wanted), None)

    def value(name: str) -> Column:
        if name not in wanted:
            return _quoted(name)
        new = formula(_quoted(name).cast("double"), _quoted(control).cast("double"), fit.getField(name))
        new = new if digits is None else round_half_even(new, digits)
        return (_not_nan(new) if name == first else nan_to_null(new)).alias(name)

    return joined.select(*[value(c) for c in df.columns])


def residual(
    df: DataFrame,
    targets: Sequence[str],
    control: str,
    group_by: Sequence[str] = (),
    fits: DataFrame | None = None,
    digits: int | None = 1,
) -> DataFrame:
    """Replace each target by its distance from the fitted line, rounded.

    Pass ``fits`` to apply coefficients learned on another table.
    """
    return _replace(
        df, targets, control, group_by, fits,
        lambda y, x, f: y - (f["slope"] * x + f["intercept"]), digits,
    )


def mean_shift(
    df: DataFrame,
    targets: Sequence[str],
    control: str,
    group_by: Sequence[str] = (),
    fits: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Move each target along the fitted slope to the mean of the control."""
    return _replace(
        df, targets, control, group_by, fits,
        lambda y, x, f: y + f["slope"] * (f["control_mean"] - x), digits,
    )


def staged_residual(
    df: DataFrame,
    targets: Sequence[str],
    controls: Sequence[str],
    group_by: Sequence[str] = (),
    digits: int | None = 1,
) -> DataFrame:
    """Residuals on the first control, refitted on the next one, and so on."""
    return staged_residual_counted(df, targets, controls, group_by, digits)[0]


def staged_residual_counted(
    df: DataFrame,
    targets: Sequence[str],
    controls: Sequence[str],
    group_by: Sequence[str] = (),
    digits: int | None = 1,
) -> tuple[DataFrame, DataFrame]:
    """The staged residuals, and per control (and group) and target the pairs used and dropped."""
    counts = []
    for control in controls:
        fits = fit_lines(df, targets, control, group_by)
        counts.append(fits.select(F.lit(control).alias("control"), *map(_quoted, group_by), "target", "pairs", "dropped"))
        df = residual(df, targets, control, group_by, fits=fits, digits=digits)
    return df, reduce(DataFrame.unionByName, counts)


def normalise_readings(
    df: DataFrame,
    kinds: Sequence[str] = ("int",),
    controls: Sequence[str] = INTERNAL_CONTROLS,
    group_by: Sequence[str] = (),
    method: str = "residual",
    digits: int | None = 1,
) -> DataFrame:
    """Normalise the readings present in a case table.

    The default takes internal readings through both controls. Skin readings on
    their own control are ``kinds=("sk",), controls=("T1 sk",)``.
    """
    targets = reading_columns(df.columns, kinds=kinds)
    if not targets:
        return df
    if method == "residual":
        return staged_residual(df, targets, controls, group_by, digits)
    if method != "mean_shift":
        raise ValueError(f"unknown method: {method}")
    for control in controls:
        df = mean_shift(df, targets, control, group_by, digits=digits)
    return df


def label_and_normalise(
    df: DataFrame, grade: str = "r:Th", label: str = "cancer_risk", group_by: Sequence[str] = ()
) -> DataFrame:
    """Risk label from the grade, then normalised internal readings."""
    return normalise_readings(df.withColumn(label, zero_label(_quoted(grade))), group_by=group_by)
