"""Random variates as columns: functions of keys, so that a row has the same value in any run, under any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import let

# fixed values: coefficients of algorithm AS 241 (PPND16), numerator and denominator, lowest power first
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def uniform(seed: str, *keys: Column) -> Column:
    """A number between 0 and 1, both excluded, of 52 bits of a hash of the seed and the keys. Another seed gives a stream of its own; a null key counts as a key like others."""
    text = F.concat_ws("/", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def _rational(x: Column, both: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    over, under = (reduce(lambda acc, c: acc * x + F.lit(c), reversed(p[:-1]), F.lit(p[-1])) for p in both)
    return over / under


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile to 16 digits; infinite at 0 and 1, null beyond or for null."""
    near = let(p - 0.5, lambda q: q * let(0.180625 - q * q, lambda r: _rational(r, CENTRE)))
    far = let(F.sqrt(-F.log(F.least(p, 1.0 - p))), lambda r: F.when(r <= 5, let(r - 1.6, lambda s: _rational(s, TAIL))).otherwise(let(r - 5.0, lambda s: _rational(s, FAR))))
    inner = F.when(F.abs(p - 0.5) <= 0.425, near).otherwise(F.signum(p - 0.5) * far)
    return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when((p > 0) & (p < 1), inner)


def normal(seed: str, *keys: Column) -> Column:
    return normal_quantile(uniform(seed, *keys))


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """The smallest y of which the binomial distribution function is u or more. Its terms are kept on the log scale, so a large n doesn't underflow; the work is n steps for each row."""
    count, chance = n.cast("int"), p.cast("double")
    odds = F.log(chance / (1.0 - chance))
    start = F.struct((count * F.log1p(-chance)).alias("term"), F.lit(0.0).alias("sum"), F.lit(0).alias("y"), odds.alias("odds"))

    def step(a: Column, i: Column) -> Column:
        total = a["sum"] + F.exp(a["term"])
        term = F.when(i < count, a["term"] + F.log((count - i) / (i + 1.0)) + a["odds"]).otherwise(a["term"])
        return F.struct(term.alias("term"), total.alias("sum"), (a["y"] + F.when(total < u, 1).otherwise(0)).alias("y"), a["odds"].alias("odds"))

    inner = F.aggregate(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), start, step, lambda a: F.least(a["y"], count))
    return F.when((count < 0) | (chance < 0) | (chance > 1) | u.isNull() | F.isnan(chance), F.lit(None).cast("int")).when(chance == 0, F.lit(0)).when(chance == 1, count).otherwise(inner)


def binomial(n: Column, p: Column, seed: str, *keys: Column) -> Column:
    return binomial_quantile(uniform(seed, *keys), n, p)
