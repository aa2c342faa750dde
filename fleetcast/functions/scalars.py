"""Column expressions used by several operators. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetcast.config import UNIT_DECIMALS, UNIT_LABELS

INF = float("inf")


def finite_or_null(x: Column) -> Column:
    """NaN marks a value that cannot be computed; relations carry NULL instead."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def signed_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with IEEE results for a zero divisor and NULL for 0/0."""
    return (
        F.when(den != 0, num / den)
        .when(num > 0, F.lit(INF))
        .when(num < 0, F.lit(-INF))
    )


def ratio(num: Column, den: Column) -> Column:
    """Ratio of two magnitudes: positive infinity for a zero divisor, NULL for 0/0."""
    return F.when(den != 0, num / den).when(num != 0, F.lit(INF))


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded value without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def zero_normalized(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def unit_rounded(x: Column, unit: Column) -> Column:
    """Half-even rounding by unit. The scale must be a literal, so one branch per unit."""
    branches = F
    for name, digits in UNIT_DECIMALS.items():
        branches = branches.when(unit == name, F.bround(x, digits))
    return zero_normalized(branches)


def unit_label(unit: Column) -> Column:
    branches = F
    for name, label in UNIT_LABELS.items():
        branches = branches.when(unit == name, F.lit(label))
    return branches


def box_cox(y: Column, lam: Column) -> Column:
    return F.when(lam == 0, F.ln(y)).otherwise((F.pow(y, lam) - 1) / F.when(lam != 0, lam))


def inverse_box_cox(z: Column, lam: Column) -> Column:
    return F.when(lam == 0, F.exp(z)).otherwise(
        F.pow(z * lam + 1, 1 / F.when(lam != 0, lam))
    )


def soft_threshold(z: Column, limit: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - limit, F.lit(0.0))


def alpha_grid(index: Column, size: int) -> Column:
    """Value number ``index`` of the falling regularization grid 5e9 ... 5e-3."""
    return F.pow(F.lit(10.0), F.lit(10.0) - F.lit(12.0) * index / F.lit(float(size - 1))) * 0.5
