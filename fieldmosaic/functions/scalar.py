"""Scalar column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once: an expression that stands in a lambda isn't shared otherwise."""
    return F.transform(F.array(value), use)[0]


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return F.when(den != 0, num / den)


def logit(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(F.log(p / (F.lit(1.0) - p)))


def expit(x: Column) -> Column:
    return F.when(x > 36, F.lit(1.0)).when(x < -709, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def expit2(x: Column) -> Column:
    """The other form of expit, with narrower bounds."""
    return F.when(x > 100, F.lit(1.0)).when(x < -100, F.lit(0.0)).otherwise(F.exp(F.least(x, F.lit(100.0))) / (1.0 + F.exp(F.least(x, F.lit(100.0)))))


def binomial_logit_log(y: Column, n: Column, eta: Column) -> Column:
    """Log probability of y of n, without the constant that doesn't depend on eta; safe for large |eta|."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return -soft(-eta) * y - soft(eta) * (n - y)


# fixed values: Lanczos' coefficients for g = 7
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x of 0.5 and more, to about 15 digits."""
    z, t = x - 1.0, x + 6.5
    series = reduce(lambda acc, k: acc + F.lit(LANCZOS[k]) / (z + k), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n: Column, y: Column) -> Column:
    """Log of the binomial coefficient; 0 where y is 0 or n."""
    return F.when((y <= 0) | (y >= n), F.lit(0.0)).otherwise(log_gamma(n + 1.0) - log_gamma(y + 1.0) - log_gamma(n - y + 1.0))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    long = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / F.when(long > 0, long)))).otherwise(0.0)
    return F.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def logit_normal_mean(mu: Column, sigma: Column) -> Column:
    """Approximate mean of expit(X) for a normal X, by a scaled argument."""
    k = 16 * 3**0.5 / (15 * 3.141592653589793)
    return expit(mu / F.sqrt(1.0 + F.lit(k * k) * sigma * sigma))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit((2 * 3.141592653589793) ** 0.5)


# fixed values: Hart's rational approximation of the normal tail, highest power first
HART = (
    (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function to about 14 digits; a continued fraction far out."""

    def tail(a: Column) -> Column:
        over, under = (reduce(lambda acc, c: acc * a + F.lit(c), p[1:], F.lit(p[0])) for p in HART)
        far = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + 0.65)
        return F.exp(-a * a / 2) * F.when(a < 7.07106781186547, over / under).otherwise(1.0 / (far * F.lit((2 * 3.141592653589793) ** 0.5)))

    return let(let(F.abs(x), tail), lambda t: F.when(x > 0, 1.0 - t).otherwise(t))


def polar(radius: Column, angle: Column) -> tuple[Column, Column]:
    """East and north of a place at a distance and an angle from the east."""
    return radius * F.cos(angle), radius * F.sin(angle)


def title_case(s: Column) -> Column:
    """Capitals after blanks, slashes and hyphens."""
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"[^ /\-]+|[ /\-]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
