"""Tail probabilities of Student t and chi-square as column expressions.

Each is a ratio of two integrals of the density's shape, the tail over the
whole, by Simpson's rule on a fixed number of points (``aggregate`` over a
bounded sequence).  Exponents are taken relative to the greatest one in the
range, so that small tails keep their relative accuracy, and ranges end where
the shape has fallen below 1e-18 of that; degrees of freedom may have any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

STEPS = 2_000  # even
_DROP = 45.0  # exponents below the greatest that a range reaches


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _integral(lo: Column, hi: Column, exponent: Callable[[Column], Column], shift: Column) -> Column:
    """Simpson's rule for exp(exponent(v) - shift) over [lo, hi]."""
    h = (hi - lo) / F.lit(float(STEPS))

    def add(total, i):
        w = F.when((i == 0) | (i == STEPS), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
        return total + w * F.exp(exponent(lo + h * i) - shift)
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), add) * h / 3.0


def _t_upper(t: Column, df: Column) -> Column:
    """P(T > t) for t >= 0: with t = sqrt(df) tan(a), the share of cos(a)^(df - 1) beyond a."""
    angle = F.atan(t / F.sqrt(df))
    quarter = F.lit(math.pi / 2)
    power = df - 1
    shape = lambda a: F.when(power == 0, F.lit(0.0)).otherwise(power * F.log(F.greatest(F.cos(a), F.lit(1e-300))))
    steep = F.greatest(power * F.tan(angle), F.sqrt(df / 2.0))
    far = lambda lo, rate: F.least(quarter, lo + _DROP / rate)
    tail = _integral(angle, far(angle, steep), shape, shape(angle)) * F.exp(shape(angle))
    # around 0 the shape falls like exp(-(df - 1) a^2 / 2)
    whole = _integral(F.lit(0.0), F.least(quarter, F.sqrt(2.0 * _DROP / F.greatest(power, F.lit(1e-9)))), shape, F.lit(0.0))
    return tail / (2.0 * whole)


def t_pvalue(t, df, alternative: str = "two-sided") -> Column:
    """p-value of a t statistic (Column); alternative 'two-sided' or 'greater'.
    Null without a statistic or with no degree of freedom."""
    tt, dd = _c(t), _c(df)
    ok = tt.isNotNull() & ~F.isnan(tt) & (dd > 0)
    upper = _t_upper(F.abs(tt), dd)
    if alternative == "two-sided":
        p = F.least(F.lit(1.0), 2.0 * upper)
    else:
        p = F.when(tt >= 0, upper).otherwise(1.0 - upper)
    return F.when(ok, p)


def r_pvalue(r, n) -> Column:
    """Two-sided p of Pearson r with n pairs: t = r * sqrt((n - 2) / (1 - r^2))."""
    rr, nn = _c(r), _c(n)
    t = rr * F.sqrt(F.try_divide(nn - 2, 1 - rr * rr))
    return F.when(F.abs(rr) >= 1, F.lit(0.0)).otherwise(t_pvalue(t, nn - 2))


def chi2_sf(chi2, dof) -> Column:
    """Upper tail of the chi-square distribution (Column): with chi2 = v^2, the
    share of v^(dof - 1) exp(-v^2 / 2) beyond v.  1 at or below 0."""
    x, k = _c(chi2), _c(dof)
    v, power = F.sqrt(F.greatest(x, F.lit(0.0))), k - 1
    peak = F.sqrt(power)
    shape = lambda u: F.when(power == 0, F.lit(0.0)).otherwise(power * F.log(F.greatest(u, F.lit(1e-300)))) - u * u / 2.0
    reach = F.lit(math.sqrt(2 * _DROP))
    top = F.greatest(v, peak)  # the greatest exponent of the tail is there
    steep = F.greatest(top - F.try_divide(power, F.greatest(top, F.lit(1e-9))), F.lit(1e-9))
    lo = F.greatest(v, peak - reach, F.lit(0.0))
    tail = _integral(lo, top + F.least(reach, _DROP / steep), shape, shape(top))
    whole = _integral(F.greatest(peak - reach, F.lit(0.0)), peak + reach, shape, shape(peak))
    p = F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail / whole * F.exp(shape(top) - shape(peak))))
    return F.when(x.isNotNull() & ~F.isnan(x) & (k > 0), p)
