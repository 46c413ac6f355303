"""P-values of correlation coefficients and the significance class of a metric.

The p-value functions run once per metric, on the aggregated coefficients.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the significance classes.
LEVELS = ((0.001, "highly_significant"), (0.01, "significant"), (0.05, "marginally_significant"))
NOT_SIGNIFICANT = "not_significant"


def _log_beta_half(a: float) -> float:
    """log B(a, 1/2), by series where the difference of log-gammas would lose digits."""
    if a < 1e4:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return 0.5 * math.log(math.pi / a) + 1 / (8 * a) - 1 / (192 * a**3)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def two_sided_t(r: float, n: float) -> float:
    """P(|R| >= |r|) for a correlation of ``n`` independent pairs: I_{1-r^2}((n-2)/2, 1/2)."""
    if abs(r) >= 1:
        return 0.0
    if r == 0:
        return 1.0
    a, b = (n - 2) / 2, 0.5
    log_front = a * math.log1p(-r * r) + b * math.log(r * r) - _log_beta_half(a)
    # Near r = 0 the complement is taken: 1 - r^2 would lose the digits of r.
    if a * r * r > 4:
        return math.exp(log_front) * _beta_fraction(a, b, 1 - r * r) / a
    return 1 - math.exp(log_front) * _beta_fraction(b, a, r * r) / b


def exact_kendall(n: int, discordant: int) -> float:
    """Two-sided exact p-value without ties, from the number of permutations by inversions."""
    fewer = min(discordant, n * (n - 1) // 2 - discordant)
    if n <= 2:
        return 1.0
    if fewer <= 1:
        ways = (1, n)[fewer]
    else:
        counts = [1] + [0] * fewer
        for k in range(2, n + 1):
            running, window = 0, []
            for i, count in enumerate(counts):
                running += count - (counts[i - k] if i >= k else 0)
                window.append(running)
            counts = window
        ways = sum(counts)
    # Logarithms, because n! soon exceeds every double; exp gives 0 where the result is below the smallest one.
    return min(1.0, math.exp(math.log(2 * ways) - math.lgamma(n + 1)))


def t_test_p_value(r: Column, n: Column, two_pairs: Column) -> Column:
    """P-value of a Pearson or Spearman coefficient; ``two_pairs`` is the result for n = 2."""

    @F.pandas_udf("double")
    def p_value(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(r) or n <= 2 else two_sided_t(r, n) for r, n in zip(rs, ns)], dtype="float64")

    tested = p_value(r.cast("double"), n.cast("double"))
    return F.when(r.isNull(), F.lit(None).cast("double")).when(n == 2, two_pairs).otherwise(tested)


def kendall_p_value(z: Column, n: Column, discordant: Column, untied: Column) -> Column:
    """P-value of tau-b: exact for small or nearly ordered samples without ties, else normal."""

    @F.pandas_udf("double")
    def p_value(zs: pd.Series, ns: pd.Series, ds: pd.Series, free: pd.Series) -> pd.Series:
        out = []
        for z, n, d, no_ties in zip(zs, ns, ds, free):
            if pd.isna(z):
                out.append(None)
            elif no_ties and (n <= 33 or min(d, n * (n - 1) / 2 - d) <= 1):
                out.append(exact_kendall(int(n), int(d)))
            else:
                out.append(math.erfc(abs(z) / math.sqrt(2)))
        return pd.Series(out, dtype="float64")

    return p_value(z.cast("double"), n.cast("double"), discordant.cast("double"), untied)


def significance_class(*p_values: Column) -> Column:
    """Class of the smallest available p-value; NULL if there is none."""
    smallest = F.least(*p_values) if len(p_values) > 1 else p_values[0]
    chain = F.when(smallest.isNull(), F.lit(None).cast("string"))
    for bound, name in LEVELS:
        chain = chain.when(smallest < bound, name)
    return chain.otherwise(NOT_SIGNIFICANT)
