"""Column helpers that stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division where a zero (or null) denominator gives null instead of an ANSI error."""
    return top / F.nullif(bottom, F.lit(0.0))


def keyed_integer(*parts: Column) -> Column:
    """Repeatable integer in [0, 2^32) drawn from the parts; independent of partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def keyed_uniform(*parts: Column) -> Column:
    """Repeatable uniform draw strictly inside (0, 1)."""
    return (keyed_integer(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation of pairs, null where one side is constant (the built-in one divides by zero there)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_correlation(x: str, y: str) -> Column:
    """Aggregate: ``correlation`` of tie-averaged ranks. Twice a rank is a whole number, so the sums are exact and a correlation of 0 is 0."""
    a, b = ((F.col(c) * 2).cast("long") for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    total = lambda c: F.sum(F.when(both, c).cast("decimal(38,0)"))
    n = F.count_if(both).cast("decimal(20,0)")
    centred = lambda c, d: (n * total(c * d) - total(c) * total(d)).cast("double")
    return F.try_divide(centred(a, b), F.sqrt(centred(a, a)) * F.sqrt(centred(b, b)))


def keyed_normal(*parts: Column) -> Column:
    """Repeatable standard normal draw (Box-Muller over two keyed uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(keyed_uniform(*parts, F.lit("u"))))
    return radius * F.cos(F.lit(2.0 * math.pi) * keyed_uniform(*parts, F.lit("v")))


# W. J. Cody's rational Chebyshev approximations of the error function (Mathematics of Computation 23,
# 1969; the public netlib routine CALERF), good to double precision. Numerator and denominator of three ranges of |x|.
ERF_SMALL = (
    (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
    (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
ERFC_MIDDLE = (
    (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
     4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
ERFC_LARGE = (
    (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2),
    (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
SMALL_UP_TO, MIDDLE_UP_TO = 0.46875, 4.0


def _rational(tables: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    """Quotient of two polynomials; the last numerator coefficient is the leading one, the denominator's leading one is 1."""
    (*top, lead), bottom = tables
    above, below = F.lit(lead), F.lit(1.0)
    for c in top:
        above = above * x + F.lit(c)
    for c in bottom:
        below = below * x + F.lit(c)
    return above / below


def normal_upper_tail(t: Column) -> Column:
    """P(Z > t) for a standard normal; null or non-finite statistics give 1."""
    x = t / F.lit(math.sqrt(2.0))
    z = F.abs(x)
    fall = F.exp(-z * z)
    inverse = F.lit(1.0) / (z * z)
    far = (F.lit(1.0 / math.sqrt(math.pi)) - inverse * _rational(ERFC_LARGE, inverse)) / z * fall
    beyond = F.when(z <= MIDDLE_UP_TO, _rational(ERFC_MIDDLE, z) * fall).otherwise(far)
    two_sided = (
        F.when(z <= SMALL_UP_TO, F.lit(1.0) - x * _rational(ERF_SMALL, z * z))
        .when(x >= 0, beyond)
        .otherwise(F.lit(2.0) - beyond)
    )
    unusable = t.isNull() | F.isnan(t) | (F.abs(t) == F.lit(float("inf")))
    return F.when(unusable, F.lit(1.0)).otherwise(F.lit(0.5) * two_sided)
