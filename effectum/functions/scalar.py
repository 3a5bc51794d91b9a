"""Scalar and aggregate functions that Spark names differently or lacks. All but the two hashes stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import cdf, erf  # noqa: F401

e, pi = F.e, F.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def divide(x, y) -> Column:
    """x / y as a double; null where y is 0."""
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def modulo(x, y) -> Column:
    return F.try_mod(_c(x), _c(y))


def maximum(*cols) -> Column:
    """Of one column the largest value, of several the greatest in the row."""
    return F.max(_c(cols[0])) if len(cols) == 1 else F.greatest(*map(_c, cols))


def minimum(*cols) -> Column:
    return F.min(_c(cols[0])) if len(cols) == 1 else F.least(*map(_c, cols))


def quantile(x, level: float, exact: bool = False) -> Column:
    """A value of the column; exact: the smallest with at least that share of rows at or below it."""
    return F.expr(f"percentile_disc({level}) within group (order by {x})") if exact else F.percentile_approx(_c(x), F.lit(level))


def quantiles(x, *levels: float, exact: bool = False) -> Column:
    return F.array(*[quantile(x, v, True) for v in levels]) if exact else F.percentile_approx(_c(x), F.array(*map(F.lit, levels)))


def any_last(x, order, *place) -> Column:
    """The value in the last row by ``order``, of rows with a value and an order. Of equal ones it is the first by ``place`` (numbers); without it, any."""
    return F.max_by(_c(x), F.when(_c(x).isNotNull() & _c(order).isNotNull(), F.struct(_c(order), *[-_c(p) for p in place])) if place else _c(order))


any_max = any_last


def any_min(x, order, *place) -> Column:
    """The same in the first row by ``order``."""
    return F.min_by(_c(x), F.when(_c(x).isNotNull() & _c(order).isNotNull(), F.struct(_c(order), *map(_c, place))) if place else _c(order))


def rand(seed: int = 0) -> Column:
    """A whole number from 0 up to 2^32."""
    return F.floor(F.rand(seed) * 2.0**32).cast("long")


def rand_canonical(seed: int = 0) -> Column:
    return F.rand(seed)


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _c(x))


def exp10(x) -> Column:
    return F.pow(F.lit(10.0), _c(x))


def int_exp2(x) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _c(x).cast("int"))


def int_exp10(x) -> Column:
    return F.pow(F.lit(10.0), _c(x)).cast("long")


def round_half_even(x, n: int = 0) -> Column:
    return F.bround(_c(x), n)


def erfc(x) -> Column:
    """1 - erf(x); from 2 on by a continued fraction, which keeps the tail's precision."""
    v = _c(x).cast("double")
    z = F.abs(v)
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: (k / 2.0) / (z + a))
    tail = F.exp(-z * z) / math.sqrt(math.pi) / (z + fraction)
    return F.when(v >= 2, tail).otherwise(1 - erf(v))


#: The coefficients of Lanczos' approximation for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x) -> Column:
    """log |Gamma(x)|; null at poles."""
    v = _c(x).cast("double")

    def positive(t: Column) -> Column:
        y = t - 1
        s = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            s = s + c / (y + i)
        w = y + 7.5
        return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(w) - w + F.log(s)

    sine = F.abs(F.sin(math.pi * v))
    mirrored = F.when((v <= 0) & (v == F.floor(v)), None).otherwise(F.log(F.lit(math.pi) / F.nullif(sine, F.lit(0.0))) - positive(1 - v))
    return F.when(v < 0.5, mirrored).otherwise(positive(F.greatest(v, F.lit(0.5))))


def tgamma(x) -> Column:
    """Gamma(x); null at poles."""
    v = _c(x).cast("double")
    sign = F.when((v < 0) & (F.floor(v) % 2 != 0), -1.0).otherwise(1.0)
    return sign * F.exp(lgamma(v))


def gcd(x, y) -> Column:
    """The greatest common divisor, by Euclid's steps: as many as the smaller number's digits can need (64-bit numbers fewer than 92)."""
    a, b = F.abs(_c(x).cast("long")), F.abs(_c(y).cast("long"))
    # Each two steps shrink the remainder by the square of the golden ratio at least: 1.4405 = 1 / log2 of it.
    steps = F.least(F.lit(92), F.floor(F.log2(F.least(a, b).cast("double") + 1) * 1.4405).cast("int") + 3)
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"]))


def lcm(x, y) -> Column:
    """The least common multiple; 0 if one is 0."""
    a, b = _c(x).cast("long"), _c(y).cast("long")
    return F.when((a == 0) | (b == 0), 0).otherwise(F.abs(F.call_function("div", a, gcd(a, b)) * b))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def l1_norm(x) -> Column:
    return _sum(F.transform(_c(x), lambda v: F.abs(v.cast("double"))))


def l2_norm(x) -> Column:
    return F.sqrt(_sum(F.transform(_c(x), lambda v: v.cast("double") * v)))


def linf_norm(x) -> Column:
    return F.array_max(F.transform(_c(x), lambda v: F.abs(v.cast("double"))))


def lp_norm(x, p: float = 2.0) -> Column:
    return F.pow(_sum(F.transform(_c(x), lambda v: F.pow(F.abs(v.cast("double")), F.lit(float(p))))), F.lit(1 / p))


def _difference(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") - b.cast("double"))


def l1_distance(x, y) -> Column:
    return l1_norm(_difference(x, y))


def l2_distance(x, y) -> Column:
    return l2_norm(_difference(x, y))


def l2_squared_distance(x, y) -> Column:
    return _sum(F.transform(_difference(x, y), lambda v: v * v))


def linf_distance(x, y) -> Column:
    return linf_norm(_difference(x, y))


def lp_distance(x, y, p: float = 2.0) -> Column:
    return lp_norm(_difference(x, y), p)


def _normalized(x, norm: Column) -> Column:
    return F.transform(_c(x), lambda v: F.try_divide(v.cast("double"), norm))


def l1_normalize(x) -> Column:
    return _normalized(x, l1_norm(x))


def l2_normalize(x) -> Column:
    return _normalized(x, l2_norm(x))


def linf_normalize(x) -> Column:
    return _normalized(x, linf_norm(x))


def lp_normalize(x, p: float = 2.0) -> Column:
    return _normalized(x, lp_norm(x, p))


def cosine_similarity(x, y) -> Column:
    dot = _sum(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")))
    return F.try_divide(dot, l2_norm(x) * l2_norm(y))


def cosine_distance(x, y) -> Column:
    return 1 - cosine_similarity(x, y)


def _rotl(x: int, r: int, bits: int) -> int:
    return ((x << r) | (x >> (bits - r))) & ((1 << bits) - 1)


def murmur3_32_of(data: bytes, seed: int = 0) -> int:
    """MurmurHash3_x86_32."""
    mask, h = 0xFFFFFFFF, seed
    for i in range(0, len(data) & ~3, 4):
        k = _rotl(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15, 32) * 0x1B873593 & mask
        h = (_rotl(h ^ k, 13, 32) * 5 + 0xE6546B64) & mask
    if tail := data[len(data) & ~3 :]:
        h ^= _rotl(int.from_bytes(tail, "little") * 0xCC9E2D51 & mask, 15, 32) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def murmur3_64_of(data: bytes, seed: int = 0) -> int:
    """The two halves of MurmurHash3_x64_128, combined by exclusive or."""
    mask, h1, h2 = (1 << 64) - 1, seed, seed
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    mix1 = lambda k: _rotl(k * c1 & mask, 31, 64) * c2 & mask
    mix2 = lambda k: _rotl(k * c2 & mask, 33, 64) * c1 & mask
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        h1 = (_rotl(h1 ^ mix1(int.from_bytes(data[i : i + 8], "little")), 27, 64) + h2 & mask) * 5 + 0x52DCE729 & mask
        h2 = (_rotl(h2 ^ mix2(int.from_bytes(data[i + 8 : i + 16], "little")), 31, 64) + h1 & mask) * 5 + 0x38495AB5 & mask
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= mix2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= mix1(int.from_bytes(tail[:8], "little"))

    def final(k: int) -> int:
        k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & mask
        k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return k ^ k >> 33

    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = h1 + h2 & mask
    h2 = h2 + h1 & mask
    h1, h2 = final(h1), final(h2)
    h1 = h1 + h2 & mask
    return h1 ^ (h2 + h1 & mask)


def _hash(function, kind: str):
    def apply(x) -> Column:
        from pyspark.sql.functions import pandas_udf

        @pandas_udf(kind)
        def run(s):
            return s.map(lambda v: None if v is None else function(v.encode()) if kind == "long" else _as_decimal(function(v.encode())))

        return run(_c(x).cast("string"))

    return apply


def _as_decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


murmur_hash3_32 = _hash(murmur3_32_of, "long")
murmur_hash3_64 = _hash(murmur3_64_of, "decimal(20,0)")
