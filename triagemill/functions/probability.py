"""Tail probabilities as column expressions: gamma and beta functions, rank distributions.

Series and continued fractions are folds over a sequence of steps. Their number grows with the
root of the parameters, which is what both need for double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 12
_HUGE = 1e300


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0, by Stirling's series at z + 12."""
    y = z + _SHIFT
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    shifted = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    below = F.lit(0.0)
    for i in range(_SHIFT):
        below = below + F.ln(z + i)
    return shifted - below


def _steps(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(100) + 20 * F.sqrt(size)).cast("int"))


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0; 1 for x <= 0.

    Twice the argument and twice the shape make it the upper tail of chi-square. Null in, null out.
    """
    a, x = a.cast("double"), x.cast("double")
    steps = _steps(F.greatest(a, F.lit(1.0)))
    scale = F.exp(a * F.ln(x) - x - ln_gamma(a))

    def add(state: Column, n: Column) -> Column:
        term = state["term"] * x / (a + n)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    lower = F.aggregate(steps, start, add, lambda s: s["total"])

    def step(state: Column, n: Column) -> Column:
        numerator = -n * (n - a)
        b = x + 1 - a + 2 * n
        d = 1 / (numerator * state["d"] + b)
        c = b + numerator / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    first = 1 / (x + 1 - a)
    begin = F.struct(F.lit(_HUGE).alias("c"), first.alias("d"), first.alias("h"))
    fraction = F.aggregate(steps, begin, step, lambda s: s["h"])
    return (
        F.when(a.isNull() | x.isNull() | F.isnan(x), F.lit(None).cast("double"))
        .when(x <= 0, F.lit(1.0))
        .when(x < a + 1, 1 - scale * lower)
        .otherwise(scale * fraction)
    )


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom > x)."""
    return upper_gamma(dof / 2, x / 2)


def normal_two_sided(z: Column) -> Column:
    """P(|standard normal| > |z|)."""
    return upper_gamma(F.lit(0.5), z * z / 2)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, odd and even steps in turn."""
    steps = F.sequence(F.lit(1), (F.lit(200) + 20 * F.sqrt(F.greatest(a, b))).cast("int"))

    def step(state: Column, n: Column) -> Column:
        m = F.floor(n / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        numerator = F.when(n % 2 == 0, even).otherwise(odd)
        d = 1 / (1 + numerator * state["d"])
        c = 1 + numerator / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    one = F.lit(1.0)
    return F.aggregate(
        steps,
        F.struct(F.lit(_HUGE).alias("c"), one.alias("d"), one.alias("h")),
        step,
        lambda s: s["h"],
    )


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0 and x from 0 to 1."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    scale = F.exp(
        ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)
    )
    return (
        F.when(x.isNull() | F.isnan(x) | a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(x <= 0, F.lit(0.0))
        .when(x >= 1, F.lit(1.0))
        .when(x < (a + 1) / (a + b + 2), scale * _beta_fraction(x, a, b) / a)
        .otherwise(1 - scale * _beta_fraction(1 - x, b, a) / b)
    )


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation over n pairs, by Student's t with n - 2 degrees.

    Two pairs always lie on a line: 1. Fewer pairs or an undefined correlation: null.
    """
    tail = incomplete_beta(1 - r * r, (n - 2) / 2, F.lit(0.5))
    return (
        F.when(r.isNull() | F.isnan(r) | (n < 2), F.lit(None).cast("double"))
        .when(n == 2, F.lit(1.0))
        .otherwise(tail)
    )


def signed_rank_p(
    statistic: Column, n: Column, tie_term: Column, zeros: Column, exact_up_to: int = 50
) -> Column:
    """Two-sided p-value of a signed-rank statistic over n blocks that differ; 1 for none.

    Exact for up to ``exact_up_to`` blocks without ties or zeros, by the number of sets of ranks
    with each sum; else the normal tail with tie correction, the rule of the usual test.
    """
    def with_rank(counts: Column, rank: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(counts) + rank),
            lambda i: F.coalesce(F.get(counts, i - 1), F.lit(0.0))
            + F.when(i > rank, F.coalesce(F.get(counts, i - 1 - rank), F.lit(0.0))).otherwise(0.0),
        )

    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), with_rank)
    low = F.slice(ways, 1, F.floor(statistic).cast("int") + 1)
    below = F.aggregate(low, F.lit(0.0), lambda total, w: total + w)
    exact = F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    normal = normal_two_sided((statistic - mean) / F.sqrt(variance))
    none = statistic.isNull() | n.isNull() | (n == 0)
    return (
        F.when(none, F.lit(1.0))
        .when((n <= exact_up_to) & (tie_term == 0) & (zeros == 0), exact)
        .otherwise(normal)
    )
