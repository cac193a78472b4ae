"""Signal and sizing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

P_FLOOR = 1e-100  # fixed value: smallest p-value a logarithm sees


def net_conviction(bull_score: Column, n_bull: Column, bear_score: Column, n_bear: Column) -> Column:
    """Mean bullish minus mean bearish score; a side nobody took counts one vote."""
    def votes(n):
        return F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(n)

    return bull_score / votes(n_bull) - bear_score / votes(n_bear)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(P_FLOOR)))


def r2_scaled_size(capital: Column, base: float, r2: Column, floor: float = 0.1, ceiling: float = 0.8,
                   factor: float = 2.0) -> Column:
    """Capital share that grows with r², kept between floor and ceiling."""
    share = F.least(F.greatest(base * (1 + r2 * factor), F.lit(floor)), F.lit(ceiling))
    return capital * F.when(r2 <= 0, floor).otherwise(share)


def position_share(sizing: str, pred: Column, sigma: Column, r2: Column, base: float = 0.5,
                   floor: float = 0.1, ceiling: float = 0.8, factor: float = 2.0) -> Column:
    """Share of capital for one entry: fixed (``raw``), ``rsquared`` or ``kelly``."""
    def clip(c):
        return F.least(F.greatest(c, F.lit(floor)), F.lit(ceiling))

    if sizing == "rsquared":
        return base * clip(r2 * factor)
    if sizing == "kelly":
        return clip(F.try_divide(F.abs(pred), sigma * sigma))
    return F.lit(base)


def entry_side(pred: Column, sigma: Column, significant: Column, threshold: float = 2.0) -> Column:
    """``long``, ``short`` or NULL."""
    usable = significant & sigma.isNotNull() & (sigma != 0)
    return F.when(usable & (pred > threshold), "long").when(usable & (pred < -threshold), "short")
