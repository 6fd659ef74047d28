"""Test statistics as column arithmetic on aggregated rows.

Spark has no error function; ``erfc`` is a series near zero and a continued fraction in the tail,
both with a fixed number of terms. Normal quantiles are literals from the standard library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the usual two-sided 95 % normal quantile, as published in the result tables.
Z95 = 1.96
# Fixed value: the 95 % quantile of chi-square with one degree of freedom.
CHI2_95_DF1 = 3.841458820694124

# Terms of the series and of the continued fraction, and where one gives way to the other: both are
# exact to double precision on their side.
SERIES, FRACTION, TAIL = 50, 40, 2.5


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _numbers(most: int) -> Column:
    return F.array(*[F.lit(float(k)) for k in range(most, 0, -1)])


def erfc(x: Column) -> Column:
    """Complementary error function of ``x`` >= 0; null stays null."""
    square = x * x
    series = F.aggregate(_numbers(SERIES), F.lit(1.0), lambda acc, k: 1.0 + acc * (2.0 * square) / (2.0 * k + 1.0))
    far = F.when(x < TAIL, F.lit(TAIL)).otherwise(x)  # the branch below never divides by zero
    fraction = F.aggregate(_numbers(FRACTION), far, lambda acc, k: far + (k / 2.0) / acc)
    bell = F.exp(-square)
    return F.when(x < TAIL, 1.0 - 2.0 / math.sqrt(math.pi) * x * bell * series).otherwise(
        bell / (math.sqrt(math.pi) * fraction)
    )


def p_from_z(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def p_from_chi2_df1(chi2: Column) -> Column:
    return erfc(F.sqrt(chi2 / 2.0))
