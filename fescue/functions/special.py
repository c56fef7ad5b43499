"""Functions that Spark lacks, as Column expressions that stay in generated code."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Stirling series of log gamma, fixed values.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Coefficients of the rational approximation to the normal distribution function (Hart, 1968), fixed values.
_HART_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_LOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: The argument is moved up by this much before a series is used.
_SHIFT = 8


def _up(x: Column) -> Column:
    return x + float(_SHIFT)


def lgamma(x: Column) -> Column:
    """log gamma of a positive column."""
    z, product = _up(x), x
    for k in range(1, _SHIFT):
        product = product * (x + float(k))
    series = sum((F.lit(c) / F.pow(z, F.lit(float(2 * k + 1))) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * F.log(F.lit(2 * pi)) + series - F.log(product)


def digamma(x: Column) -> Column:
    z = _up(x)
    series = sum((F.lit(c * (2 * k + 1)) / F.pow(z, F.lit(float(2 * k + 2))) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    return F.log(z) - 0.5 / z - series - sum((1.0 / (x + float(k)) for k in range(_SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    z = _up(x)
    series = sum((F.lit(c * (2 * k + 1) * (2 * k + 2)) / F.pow(z, F.lit(float(2 * k + 3))) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    return 1.0 / z + 0.5 / (z * z) + series + sum((1.0 / ((x + float(k)) * (x + float(k))) for k in range(_SHIFT)), F.lit(0.0))


def _horner(x: Column, coefs: tuple) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    near = F.exp(-a * a / 2) * _horner(a, _HART_TOP) / _horner(a, _HART_LOW)
    far = F.exp(-a * a / 2) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit((2 * pi) ** 0.5)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Haversine distance of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
