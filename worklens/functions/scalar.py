"""Small Column helpers: every one stays a built-in, code-generated expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(x, lo), hi)


def zero_to(x: Column, value: float) -> Column:
    """Replace an exact zero, used where the value becomes a denominator."""
    return F.when(x == 0.0, F.lit(value)).otherwise(x)


def ratio(num: Column, den: Column, otherwise: float | None) -> Column:
    """``num / den`` where the denominator is positive, a constant elsewhere."""
    guarded = F.when(den > 0.0, num / den)
    return guarded if otherwise is None else guarded.otherwise(F.lit(otherwise))


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal rounding by floor: the same result on any engine with IEEE doubles."""
    scale = F.lit(float(10 ** digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def percent_text(share: Column) -> Column:
    """0.725 -> '73%'."""
    return F.concat(F.floor(share * 100.0 + 0.5).cast("int").cast("string"), F.lit("%"))


def fixed_text(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_up(x, digits))


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that summation order no longer shows."""
    return df.selectExpr(*[
        f"floor(`{f.name}` * 1e{digits} + 0.5e0) / 1e{digits} as `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields
    ])
