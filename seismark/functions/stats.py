"""Column helpers: tie-safe sign, time credit, hashed draws, t quantiles, chi-square tail."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a pooled difference this small is a tie; held-out ties use the finer one
TIE_EPS = 1e-9
HELDOUT_EPS = 1e-12

# fixed values: Student t quantile at 0.975 for 1..30 degrees of freedom
T_975 = [12.706204736432095, 4.302652729911275, 3.182446305284263, 2.776445105197799, 2.570581835636314,
         2.446911851144969, 2.364624251592785, 2.306004135204166, 2.262157162740992, 2.228138851964939,
         2.200985160082949, 2.178812829663418, 2.160368656461013, 2.144786687916927, 2.131449545559323,
         2.119905299221011, 2.109815577833181, 2.100922040240960, 2.093024054408263, 2.085963447265837,
         2.079613844727662, 2.073873067904015, 2.068657610419041, 2.063898561628021, 2.059538552753294,
         2.055529438642871, 2.051830516480283, 2.048407141795244, 2.045229642132703, 2.042272456301238]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sgn(x, eps: float = TIE_EPS) -> Column:
    """-1, 0 or 1, where anything within ``eps`` of zero is 0."""
    x = _c(x)
    return F.when(F.abs(x) <= eps, F.lit(0)).otherwise(F.signum(x)).cast("int")


def time_credit(d, kind: str, p: float) -> Column:
    """Credit for an answer ``d`` seconds away: uniform over [0, p], exponential with rate p, or a step at p."""
    d = _c(d)
    if kind == "uniform":
        v = F.greatest(F.lit(0.0), 1.0 - d / F.lit(float(p)))
    elif kind == "exponential":
        v = F.exp(-F.lit(float(p)) * d)
    elif kind == "point":
        v = F.when(d <= p, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown credit {kind}")
    return F.coalesce(v, F.lit(0.0))


def hash32(*cols) -> Column:
    """Uniform integer in [0, 2^32) from the text of ``cols``; the same value in any engine with md5."""
    key = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def t975(df) -> Column:
    """0.975 quantile of Student's t; null below one degree of freedom, a normal-based expansion above 30."""
    df = _c(df).cast("double")
    z = 1.959963984540054
    far = (F.lit(z) + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / F.pow(df, 2)
           + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / F.pow(df, 3))
    table = F.array(*[F.lit(v) for v in T_975])
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= 30, F.get(table, df.cast("int") - 1)).otherwise(far)


def chi2_sf(x, k) -> Column:
    """Upper tail of the chi-square distribution for integer degrees of freedom; null below one of them.

    A sum of Poisson-like terms whose logarithms are carried along, so large x and k neither underflow nor overflow. For odd
    k the complementary error function comes first; its series is such a sum as well.
    """
    x, k = _c(x).cast("double"), _c(k).cast("int")
    h, zero = x / 2, F.lit(0.0)
    start = F.when(k % 2 == 0, zero).otherwise(F.lit(0.5))  # exponent of the first term; its Gamma is 1 or sqrt(pi) / 2
    first = -h + start * F.log(h) - F.when(k % 2 == 0, zero).otherwise(F.lit(math.log(math.pi) / 2 - math.log(2)))

    def total(n) -> Column:
        terms = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        step = lambda acc, i: F.struct((acc["t"] + F.log(h) - F.log(i + start)).alias("t"), F.when(i < n, acc["s"] + F.exp(acc["t"] + F.log(h) - F.log(i + start))).otherwise(acc["s"]).alias("s"))
        return F.aggregate(terms, F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda acc: acc["s"])

    erfc = F.when(h <= 40, F.greatest(1 - total(F.lit(200)), zero)).otherwise(zero)  # below 1e-18 beyond
    half = F.floor(k / 2).cast("int")
    sf = F.when(k % 2 == 0, total(half)).otherwise(erfc + F.when(half > 0, total(half)).otherwise(zero))
    return F.when(x.isNull() | F.isnan(x) | (k < 1), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), sf))


def pctl(col, q: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(_c(col), F.lit(q))
