"""Regression statistics: closed-form OLS from window or group aggregates, and p-values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ols_inputs(y: Column, x: Column, suffix: str = "") -> list[Column]:
    """Aggregates from which every OLS figure follows; rows with a NULL in x or y do not count."""
    return [
        F.regr_count(y, x).alias(f"n{suffix}"), F.regr_sxx(y, x).alias(f"sxx{suffix}"),
        F.regr_sxy(y, x).alias(f"sxy{suffix}"), F.regr_syy(y, x).alias(f"syy{suffix}"),
        F.regr_avgx(y, x).alias(f"avgx{suffix}"), F.regr_avgy(y, x).alias(f"avgy{suffix}"),
    ]


def ols(n: Column, sxx: Column, sxy: Column, syy: Column, avgx: Column, avgy: Column) -> dict[str, Column]:
    """Slope, intercept, r² and t; NULL for a constant predictor."""
    slope = F.try_divide(sxy, sxx)
    r2 = F.try_divide(sxy * sxy, sxx * syy)
    return {
        "coefficient": slope,
        "intercept": avgy - slope * avgx,
        "r_squared": r2,
        "rsquared_adj": 1 - F.try_divide((1 - r2) * (n - 1), n - 2),
        "t_stat": slope * F.sqrt(F.try_divide((n - 2) * sxx, syy - slope * sxy)),
    }


def _log_gamma(z):
    """Lanczos approximation, vectorised; z > 0.5."""
    import numpy as np

    # fixed values: Lanczos coefficients for g = 7, n = 9
    c = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
         -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
         1.5056327351493116e-7)
    z = np.asarray(z, dtype=float) - 1.0
    total = c[0] + sum(c[i] / (z + i) for i in range(1, 9))
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def beta_regularised(a, b, x):
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction, vectorised."""
    import numpy as np

    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        ) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        value = front * h
    value = np.where(z <= 0, 0.0, value)
    return np.where(swap, 1 - value, value)


def t_two_sided(t, df):
    """Two-sided Student-t p-value of arrays; tiny tails keep their relative accuracy."""
    import numpy as np

    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = beta_regularised(np.where(df > 0, df, 1) / 2, 0.5, np.where(df > 0, df, 1) / (df + t * t))
    return np.where(np.isnan(t) | (df <= 0), np.nan, p)


def normal_two_sided(z):
    import math

    import numpy as np

    return np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan for v in np.asarray(z, dtype=float)])


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value column; one Arrow batch at a time, applied to fits and never to raw rows."""

    @F.pandas_udf("double")
    def batch(t_values, df_values):
        import numpy as np
        import pandas as pd

        p = t_two_sided(t_values.to_numpy(dtype=float, na_value=np.nan), df_values.to_numpy(dtype=float, na_value=np.nan))
        return pd.Series(p).astype(object).where(~np.isnan(p), None)

    return batch(t.cast("double"), df.cast("double"))


def normal_p_value(z: Column) -> Column:
    """Two-sided normal p-value column, for fits only."""

    @F.pandas_udf("double")
    def batch(values):
        import numpy as np
        import pandas as pd

        p = normal_two_sided(values.to_numpy(dtype=float, na_value=np.nan))
        return pd.Series(p).astype(object).where(~np.isnan(p), None)

    return batch(z.cast("double"))
