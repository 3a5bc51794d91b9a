"""Distribution functions without further libraries: on numbers, and the normal one on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _inverse(cdf, p: float, lo: float, hi: float) -> float:
    """The quantile by bisection between bounds that are widened until they hold it."""
    if math.isnan(p):
        return math.nan
    while cdf(lo) > p:
        lo *= 2
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    if p <= 0 or p >= 1:
        return math.copysign(math.inf, p - 0.5)
    return _inverse(norm_cdf, p, -1.0, 1.0)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * total / a


def t_cdf(x: float, df: float) -> float:
    if math.isinf(x) or df <= 0:
        return float(x > 0) if df > 0 else math.nan
    tail = beta_cdf(df / (df + x * x), df / 2, 0.5) / 2
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, df: float) -> float:
    if df <= 0 or math.isnan(p):
        return math.nan
    if p <= 0 or p >= 1:
        return math.copysign(math.inf, p - 0.5)
    return _inverse(lambda x: t_cdf(x, df), p, -1.0, 1.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    """P(F > x)."""
    if x <= 0:
        return 1.0
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square > x): a series below the mean, a continued fraction above."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= y / n
            total += term
        return 1 - total * scale
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h


def kolmogorov_sf(x: float) -> float:
    """The limit law of the two-sided Kolmogorov statistic."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: The rational approximations of erf in fdlibm, for |x| below 0.84375, to 1.25, to 1 / 0.35 and beyond; numerators and denominators.
ERF = (
    ((1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05), (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)),
    ((-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03), (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)),
    ((-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00), (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02)),
    ((-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02), (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01)),
)


def erf(x: Column) -> Column:
    """The error function of a column, to double precision nearly, by rational approximations: plain arithmetic, which Spark compiles."""
    v = x.cast("double")
    z = F.least(F.abs(v), F.lit(6.0))

    def ratio(i: int, t: Column) -> Column:
        def polynomial(c: tuple) -> Column:
            out = F.lit(c[-1])
            for a in reversed(c[:-1]):
                out = out * t + a
            return out

        return polynomial(ERF[i][0]) / polynomial(ERF[i][1])

    far = F.greatest(z, F.lit(1.0))
    tail = lambda i: 1 - F.exp(-far * far - 0.5625 + ratio(i, 1 / (far * far))) / far
    size = F.when(z < 0.84375, z + z * ratio(0, z * z)).when(z < 1.25, 8.45062911510467529297e-01 + ratio(1, z - 1)).when(z < 1 / 0.35, tail(2)).otherwise(tail(3))
    return F.when(F.isnan(v), v).otherwise(F.signum(v) * size)


def cdf(x: Column) -> Column:
    """The normal distribution function of a column."""
    return (1 + erf(x / math.sqrt(2))) / 2
