"""The normal distribution in built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Wichura's rational approximation of the quantile (AS 241), from the highest power down.
_CENTRE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0],
)
_SIDE = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0],
)
_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0],
)
#: The polynomial in the exponent of a Chebyshev fit to the complementary error function, from the highest power down.
_ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Coefficients from the highest power down."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile to about 16 digits; null outside (0, 1)."""

    def ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
        return polynomial(x, parts[0]) / polynomial(x, parts[1])

    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1.0 - p)))
    outer = F.when(r <= 5.0, ratio(r - 1.6, _SIDE)).otherwise(ratio(r - 5.0, _TAIL))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(F.lit(0.180625) - q * q, _CENTRE)).otherwise(F.signum(q) * outer))


def normal_above(z: Column) -> Column:
    """The standard normal's probability above ``z``; its relative error is below 2e-7 in both tails."""
    x = F.abs(z) / 2.0**0.5
    t = 1.0 / (1.0 + x / 2.0)
    half = t * F.exp(-x * x + polynomial(t, _ERFC)) / 2.0
    return F.when(z >= 0, half).otherwise(1.0 - half)
