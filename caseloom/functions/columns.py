"""Column expressions: labels, rounding, losses, decisions and text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing in delimited files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# White space as a pattern class, the set that text stripping uses.
# Latin characters are listed singly and the rest sits behind one range test: a
# letter is then turned down by two quick checks.
WHITE = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing values -------------------------------------------------------

def na_to_null(c: Column | str) -> Column:
    """Text that spells a missing value becomes null."""
    c = as_column(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))


# --- labels and classes ---------------------------------------------------

def zero_label(c: Column | str) -> Column:
    """0 where the value is exactly zero, else 1; a missing value counts as 1."""
    return F.when(as_column(c) == 0, 0).otherwise(1)


def class_decision(z0: Column | str, z1: Column | str) -> Column:
    return F.when(as_column(z1) > as_column(z0), 1).otherwise(0)


def positive_probability(z0: Column | str, z1: Column | str) -> Column:
    """Softmax probability of class 1."""
    return 1 / (1 + F.exp(as_column(z0) - as_column(z1)))


# --- losses ---------------------------------------------------------------

def cross_entropy(z0: Column | str, z1: Column | str, y: Column | str) -> Column:
    """Two-class cross-entropy from logits, safe for large values."""
    z0, z1, y = as_column(z0), as_column(z1), as_column(y)
    top = F.greatest(z0, z1)
    return top + F.log(F.exp(z0 - top) + F.exp(z1 - top)) - F.when(y == 1, z1).when(y == 0, z0)


def weighted_loss(
    gen_loss: Column | str, cls_loss: Column | str, w_gen: float = 0.5, w_cls: float = 0.5
) -> Column:
    """Weighted sum of both losses; null unless both are known."""
    return as_column(gen_loss) * F.lit(w_gen) + as_column(cls_loss) * F.lit(w_cls)


def linear_score(vector: Column | str, weights: Sequence[float], bias: float) -> Column:
    """Dot product with a fixed weight vector, plus bias."""
    products = F.zip_with(
        as_column(vector), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) + F.lit(float(bias))


# --- numbers and text -----------------------------------------------------

def round_half_even(c: Column | str, digits: int = 1) -> Column:
    scale = float(10**digits)
    return F.rint(as_column(c) * F.lit(scale)) / F.lit(scale)


def two_decimals(c: Column | str) -> Column:
    """``%.2f`` of the exact binary value, ties to even; missing prints ``nan``.

    ``c * 100`` is itself rounded, which matters only where it lands on a half.
    Splitting ``c`` into two short halves gives the sign of that rounding error.
    """
    x = as_column(c).cast("double")
    hundred = x * F.lit(100.0)
    shifted = x * F.lit(134217729.0)
    high = shifted - (shifted - x)
    error = (high * F.lit(100.0) - hundred) + (x - high) * F.lit(100.0)
    on_half = (hundred - F.floor(hundred)) == F.lit(0.5)
    cents = (
        F.when(on_half & (error > 0), F.ceil(hundred).cast("double"))
        .when(on_half & (error < 0), F.floor(hundred).cast("double"))
        .otherwise(F.rint(hundred))
    )
    return F.when(x.isNull() | F.isnan(x), F.lit("nan")).otherwise(F.format_string("%.2f", cents / F.lit(100.0)))


def target_text(c: Column | str) -> Column:
    """Target text for generation: missing becomes the empty string."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def has_text(c: Column | str) -> Column:
    """True where something other than white space is present; null counts as blank."""
    return F.coalesce(as_column(c).rlike(f"[^{WHITE}]"), F.lit(False))


def words(c: Column | str) -> Column:
    """Split on white space, without empty parts; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(as_column(c), F.lit("")), f"[{WHITE}]+"), "")


def duration_text(seconds: Column | str) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``; fractions of a second are cut."""
    total = F.floor(as_column(seconds)).cast("bigint")
    hours, minutes, rest = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return (
        F.when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m "), rest, F.lit("s")))
        .when(minutes > 0, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(rest, F.lit("s")))
    )


def duration_seconds(text: Column | str) -> Column:
    """Inverse of :func:`duration_text`, in whole seconds."""
    text, shape = as_column(text), r"^(?:(\d+)h )?(?:(\d+)m )?(\d+)s$"
    parts = F.split(F.regexp_replace(text, shape, "$1:$2:$3"), ":")
    value = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda sixties, part: sixties * 60 + F.when(part != "", part).otherwise("0").cast("bigint"),
    )
    return F.when(text.rlike(shape), value)


def due(step: Column | str, interval: int) -> Column:
    """True for every ``interval``-th step, counted from 1."""
    return as_column(step) % F.lit(interval) == 0


def cycle_status(c: Column | str) -> Column:
    """``absent`` (missing, n/a, -1), ``irregular`` (a range), ``regular`` or ``other``."""
    text = F.trim(as_column(c).cast("string"))
    return (
        F.when(text.isNull() | text.isin(*NA_TOKENS) | text.rlike(r"^-1(\.0+)?$"), "absent")
        .when(text.rlike(r"^\d+(\.\d+)?\s*-\s*\d+(\.\d+)?$"), "irregular")
        .when(text.rlike(r"^\d+(\.\d+)?$"), "regular")
        .otherwise("other")
    )


def unit_interval(*parts: Column | str, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) from the parts' text and the seed."""
    text = F.concat_ws(":", *[as_column(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
