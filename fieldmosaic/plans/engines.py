"""SQL text of the library's variates, for the other engine that checks queries."""

from __future__ import annotations

from functools import reduce

from fieldmosaic.functions.scalar import HART
from fieldmosaic.functions.variates import CENTRE, FAR, TAIL


def uniform_sql(seed: str, *keys: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))"


def _rational(x: str, both: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    def text(p: tuple[float, ...]) -> str:
        out = f"CAST({p[-1]!r} AS DOUBLE)"
        for c in reversed(p[:-1]):
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    return f"({text(both[0])} / {text(both[1])})"


def normal_sql(u: str) -> str:
    """The normal quantile of a column between 0 and 1."""
    root = f"sqrt(-ln(least({u}, 1 - {u})))"
    far = f"CASE WHEN {root} <= 5 THEN {_rational(f'({root} - 1.6)', TAIL)} ELSE {_rational(f'({root} - 5)', FAR)} END"
    return f"(CASE WHEN abs({u} - 0.5) <= 0.425 THEN ({u} - 0.5) * {_rational(f'(0.180625 - ({u} - 0.5) * ({u} - 0.5))', CENTRE)} ELSE sign({u} - 0.5) * {far} END)"


def binomial_sql(k: str, n: str, p: str) -> str:
    """The probability of k of n by log gamma functions."""
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def normal_cdf_sql(x: str) -> str:
    """The normal distribution function of a column up to seven deviations from the middle."""
    over, under = (reduce(lambda acc, c: f"({acc} * abs({x}) + CAST({c!r} AS DOUBLE))", p[1:], f"CAST({p[0]!r} AS DOUBLE)") for p in HART)
    tail = f"exp(-{x} * {x} / 2) * {over} / {under}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"
