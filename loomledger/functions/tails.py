"""Tail probabilities of Student's t, Fisher's F and chi-squared as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 200


def _let(values: list[Column], body) -> Column:
    """``body`` of several values, each worked out once."""
    names = [f"v{k}" for k in range(len(values))]
    held = F.struct(*(v.cast("double").alias(n) for v, n in zip(values, names)))
    return F.element_at(F.transform(F.array(held), lambda x: body(*(x[n] for n in names))), 1)


def lgamma(x: Column) -> Column:
    """Of a positive number: Stirling's series eight further up, less the logarithms in between."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    between = x
    for k in range(1, 8):
        between = between * (x + k)
    return series - F.log(between)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, two terms a step."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def term(s: Column, top: Column) -> Column:
        return _let([s["c"], s["d"], s["h"], top], lambda c, d, h, t: _let([1 / safe(1 + t * d), safe(1 + t / c), h], lambda d2, c2, h2: state(c2, d2, h2 * c2 * d2)))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.element_at(F.transform(F.array(term(s, even)), lambda half: term(half, odd)), 1)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), state(F.lit(1.0), first, first), step, lambda s: s["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""

    def of(a, b, x):
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log1p(-x))
        near = front * _fraction(a, b, x) / a
        far = 1 - front * _fraction(b, a, 1 - x) / b
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)

    return _let([a, b, x], of)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance that Student's t lies beyond ``t`` on either side; 0 for an infinite one."""
    square = t.cast("double") * t
    return F.when(F.abs(t) == float("inf"), 0.0).otherwise(beta_inc(df.cast("double") / 2, F.lit(0.5), df / (df + square)))


def f_upper(f: Column, first: Column, second: Column) -> Column:
    return F.when(f <= 0, 1.0).otherwise(beta_inc(second.cast("double") / 2, first.cast("double") / 2, second / (second + first * f)))


def chi2_upper(x: Column, df: int, steps: int = 400) -> Column:
    """By the series of the lower tail, which has no cancellation; beyond 300 nothing is left of the upper one."""
    a = df / 2

    def of(z):
        step = lambda s, n: _let([s["term"], s["total"], n, z], lambda term, total, k, z: _let([term * z / (a + k), total], lambda t, u: F.struct(t.alias("term"), (u + t).alias("total"))))
        start = F.struct(F.lit(1 / a).alias("term"), F.lit(1 / a).alias("total"))
        total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda n: n.cast("double")), start, step, lambda s: s["total"])
        return F.greatest(1 - total * F.exp(-z + a * F.log(z) - math.lgamma(a)), F.lit(0.0))

    return F.when(x <= 0, 1.0).when(x > 300, 0.0).otherwise(_let([x / 2], of))


def t_quantile(df: Column, level: float = 0.95, steps: int = 14) -> Column:
    """Within which Student's t lies with this chance: Newton's steps on the tail, from under the answer."""

    def of(df):
        peak = F.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / F.sqrt(df * math.pi)
        density = lambda t: peak * F.exp(-(df + 1) / 2 * F.log1p(t * t / df))
        step = lambda t, _: _let([t], lambda v: v + (t_two_sided(v, df) - (1 - level)) / (2 * density(v)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1.5), step)

    return F.when(df >= 1, _let([df], of))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs; 1 for under three, 0 for a perfect one."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n < 3, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, n - 2))
