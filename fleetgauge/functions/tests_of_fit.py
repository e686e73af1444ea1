"""P-values, as Column arithmetic: of normality from moments, and of Pearson's r."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_normality_p(df: DataFrame, name: str, n: str, skewness: str, kurtosis: str) -> DataFrame:
    """Adds the p-value of D'Agostino and Pearson's omnibus test, from count and shape.

    One step per column: a value that is used several times is then computed once.
    """
    steps = [
        {"_n": F.when(F.col(n) >= 10, F.col(n).cast("double")), "_g": F.col(skewness), "_k": F.col(kurtosis)},
        {
            "_y": "_g * sqrt((_n + 1) * (_n + 3) / (6 * (_n - 2)))",
            "_b": "3 * (_n * _n + 27 * _n - 70) * (_n + 1) * (_n + 3)"
                  " / ((_n - 2) * (_n + 5) * (_n + 7) * (_n + 9))",
            "_x": "(_k + 3 - 3 * (_n - 1) / (_n + 1))"
                  " / sqrt(24 * _n * (_n - 2) * (_n - 3) / ((_n + 1) * (_n + 1) * (_n + 3) * (_n + 5)))",
            "_q": "6 * (_n * _n - 5 * _n + 2) / ((_n + 7) * (_n + 9))"
                  " * sqrt(6 * (_n + 3) * (_n + 5) / (_n * (_n - 2) * (_n - 3)))",
        },
        {"_w": "sqrt(2 * (_b - 1)) - 1", "_a": "6 + 8 / _q * (2 / _q + sqrt(1 + 4 / (_q * _q)))"},
        {"_r": "_y / sqrt(2 / (_w - 1))", "_d": "1 + _x * sqrt(2 / (_a - 4))"},
        {
            "_z1": "ln(_r + sqrt(_r * _r + 1)) / sqrt(ln(_w) / 2)",
            "_z2": "(1 - 2 / (9 * _a) - signum(_d) * cbrt(try_divide(1 - 2 / _a, abs(_d)))) / sqrt(2 / (9 * _a))",
        },
        {name: "exp(-(_z1 * _z1 + _z2 * _z2) / 2)"},
    ]
    for step in steps:
        df = df.withColumns({c: F.expr(e) if isinstance(e, str) else e for c, e in step.items()})
    return df.drop(*[c for step in steps[:-1] for c in step])


#: Steps of the sum that stands for an integral, how far apart, and the step at zero: by these it is exact to about 1e-13.
_STEPS, _APART, _ZERO = 64, 0.125, 28


def _area(decay: Column, begin: Column) -> Column:
    """The integral of (cosh(begin) / cosh(v)) ** decay over v from `begin` to infinity.

    A trapezoid sum over y, where v = begin + scale * exp(y - exp(-y)): the steps get denser towards `begin`
    and follow the fall of the integrand, so that a fixed number of them does for every decay.
    """
    def log_cosh(v: Column) -> Column:
        return F.log1p(F.sinh(v) * F.sinh(v)) / 2

    scale = 1 / (F.sqrt(decay) + decay * F.tanh(begin))

    def step(total: Column, k: Column) -> Column:
        y = (k - _ZERO) * _APART
        x = F.exp(y - F.exp(-y))
        # Beyond 300 the integrand is zero, and sinh would not be finite.
        v = F.least(begin + scale * x, F.lit(300.0))
        return total + F.exp(decay * (log_cosh(begin) - log_cosh(v))) * x * (1 + F.exp(-y))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS)), F.lit(0.0), step) * scale


def pearson_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation r over n pairs; null below three pairs.

    With r = tanh(v) the density of r among unrelated pairs is that of cosh(v) ** -(n - 2), so p is the part of
    its area that lies beyond abs(r).
    """
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    size, decay = F.abs(r), n.cast("double") - 2
    begin = F.atanh(size)
    tail = F.exp(-decay * F.log1p(F.sinh(begin) * F.sinh(begin)) / 2)
    p = F.least(tail * _area(decay, begin) / _area(decay, F.lit(0.0)), F.lit(1.0))
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), F.when(size >= 1, 0.0).otherwise(p))
