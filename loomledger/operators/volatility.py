"""ARCH effects, ARCH/GARCH models, volatility forecasts and p-values, in column expressions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_upper, correlation_p, f_upper, t_quantile, t_two_sided


def _projected(lags: int) -> list[dict[str, Column]]:
    """Steps that decompose the covariances ``c_i_j`` of the lags (Cholesky), one column at a time, and project ``c_i_y``."""
    c = F.col
    total = lambda terms: reduce(lambda a, b: a + b, terms, F.lit(0.0))
    steps = []
    for j in range(1, lags + 1):
        left = c(f"c_{j}_{j}") - total(c(f"l_{j}_{k}") ** 2 for k in range(1, j))
        steps.append({f"l_{j}_{j}": F.when(left > 1e-10 * c(f"c_{j}_{j}"), F.sqrt(left))})  # null: the lag adds nothing
        safe = lambda x, j=j: F.coalesce(x / c(f"l_{j}_{j}"), F.lit(0.0))
        below = {f"l_{i}_{j}": safe(c(f"c_{j}_{i}") - total(c(f"l_{i}_{k}") * c(f"l_{j}_{k}") for k in range(1, j))) for i in range(j + 1, lags + 1)}
        below[f"z_{j}"] = safe(c(f"c_{j}_y") - total(c(f"l_{j}_{k}") * c(f"z_{k}") for k in range(1, j)))
        steps.append(below)
    return steps


def arch_effects(series: DataFrame, lags: int = 5) -> DataFrame:
    """Engle's test: ``series, lm, lm_p, f, f_p, n``; squared deviations regressed on their own ``lags`` values before.

    The lags come from a window, their covariances from one aggregate, and R² from the decomposition of these few
    numbers.  Series with fewer than ``lags + 10`` months give no row; without variation R² is 0.
    """
    whole, order = Window.partitionBy("series"), Window.partitionBy("series").orderBy("month")
    e2 = series.select("series", "month", F.pow(F.col("value") - F.avg("value").over(whole), 2).alias("e"), F.count("*").over(whole).alias("n")).where(F.col("n") >= lags + 10)
    e2 = e2.withColumn("y", F.coalesce(F.try_divide("e", F.avg("e").over(whole)), F.lit(0.0)))
    rows = e2.select("series", "n", "y", *(F.lag("y", k).over(order).alias(f"x{k}") for k in range(1, lags + 1))).where(f"x{lags} is not null")
    pairs = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c_{i}_{j}") for i in range(1, lags + 1) for j in range(i, lags + 1)]
    out = rows.groupBy("series").agg(F.max("n").alias("n"), F.count("*").alias("m"), F.var_pop("y").alias("c_y"), *(F.covar_pop(f"x{i}", "y").alias(f"c_{i}_y") for i in range(1, lags + 1)), *pairs)
    for step in _projected(lags):
        out = out.withColumns(step)
    fit = reduce(lambda a, b: a + b, (F.col(f"z_{k}") ** 2 for k in range(1, lags + 1)))
    out = out.withColumn("r2", F.least(F.coalesce(F.try_divide(fit, "c_y"), F.lit(0.0)), F.lit(1.0))).withColumn("df", F.col("m") - lags - 1)
    lm, f = F.col("m") * F.col("r2"), F.col("r2") / lags / F.greatest((1 - F.col("r2")) / F.col("df"), F.lit(1e-300))
    r6 = lambda c: F.round(c, 6)
    return out.select("series", r6(lm).alias("lm"), r6(chi2_upper(lm, lags)).alias("lm_p"), r6(f).alias("f"), r6(f_upper(f, F.lit(lags), F.col("df"))).alias("f_p"), "n")


def _variances(e2: Column, par: Column, p: int, q: int) -> tuple[Column, Column]:
    """Minus twice the log likelihood (without its constant) of standardised squares, and the recursion's steps as a state.

    ``par``: constant, p weights of squares and q of variances before; what lies before the first month is the mean, 1.
    """
    names = [*(f"e{k}" for k in range(1, p + 1)), *(f"v{k}" for k in range(1, q + 1))]
    start = F.struct(F.lit(0.0).alias("loss"), F.lit(1.0).alias("v"), *(F.lit(1.0).alias(n) for n in names))

    def step(s: Column, x: Column) -> Column:
        v = reduce(lambda a, b: a + b, (F.get(par, F.lit(k)) * s[n] for k, n in enumerate(names, 1)), F.get(par, F.lit(0)))
        moved = lambda v: F.struct((s["loss"] + F.log(v) + x / v).alias("loss"), v.alias("v"), *(({"e1": x, "v1": v}.get(n) if n in ("e1", "v1") else s[f"{n[0]}{int(n[1:]) - 1}"]).alias(n) for n in names))
        return F.element_at(F.transform(F.array(F.greatest(v, F.lit(1e-9))), moved), 1)

    return F.aggregate(e2, start, step, lambda s: s["loss"]), start


def _grid(p: int, q: int, points: int) -> list[tuple[float, ...]]:
    """Starting constants and weights; weights sum to under 1."""
    spread = lambda low, high: [low + (high - low) * k / (points - 1) for k in range(points)]
    constants = [0.02 * 50 ** (k / (points - 1)) for k in range(points)]
    return [(c, *w) for c in constants for w in product(*([spread(0.0, 0.8)] * p), *([spread(0.0, 0.95)] * q)) if sum(w) < 0.999]


def fit(series: DataFrame, p: int = 1, q: int = 1, rounds: int = 18) -> DataFrame:
    """Maximum likelihood with normal errors of GARCH(p, q), or ARCH(p) for ``q = 0``; up to four weights.

    ``series, mu, omega, alpha, beta, persistence, loglik, aic, bic, ljung_box, ljung_box_p, n``.  A series is an array of
    its months in one row; variances are a fold over it; the likelihood is worked out on a grid of parameters, then
    on finer ones around the best.  Series of under 50 months, or without variation, give no row.
    """
    dims = 1 + p + q
    if not 1 <= p or dims > 5:
        raise ValueError("p must be at least 1 and p + q at most 4")
    points = {2: 9, 3: 7, 4: 5, 5: 4}[dims]
    months = F.transform(F.array_sort(F.collect_list(F.struct("month", F.col("value").cast("double").alias("value")))), lambda x: x["value"])
    by = series.groupBy("series").agg(months.alias("x"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")).where("n >= 50 and sd > 0")
    by = by.withColumn("e2", F.transform("x", lambda v: F.pow((v - F.col("mu")) / F.col("sd"), 2))).drop("x")

    def best(candidates: Column) -> Column:
        total = lambda w: F.aggregate(F.slice(w, 2, dims - 1), F.lit(0.0), lambda a, b: a + b)
        scored = F.transform(F.filter(candidates, lambda w: total(w) < 0.9999), lambda w: F.struct(_variances(F.col("e2"), w, p, q)[0].alias("loss"), w.alias("par")))
        return F.array_min(F.filter(scored, lambda s: ~F.isnan(s["loss"])))

    table = lambda rows: F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in rows) + ")")
    moves = table([(float(a), *map(float, move)) for a in (-1, 0, 1) for move in product((-1, 0, 1), repeat=dims - 1)])

    def nearer(s: Column, _: Column) -> Column:
        """To the best of the neighbours on each side, which come a little nearer every round."""

        def around(m: Column) -> Column:
            weights = F.zip_with(F.slice(s["best"]["par"], 2, dims - 1), F.slice(m, 2, dims - 1), lambda a, b: F.greatest(a + b * s["step"], F.lit(0.0)))
            return F.concat(F.array(F.element_at(s["best"]["par"], 1) * F.pow(s["factor"], F.element_at(m, 1))), weights)

        return F.struct(best(F.transform(moves, around)).alias("best"), F.pow(s["factor"], F.lit(0.7)).alias("factor"), (s["step"] * 0.7).alias("step"))

    start = F.struct(best(table(_grid(p, q, points))).alias("best"), F.lit(50 ** (0.7 / (points - 1))).alias("factor"), F.lit(0.63 / (points - 1)).alias("step"))
    by = by.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, nearer, lambda s: s["best"]))
    weight = lambda start, length: F.slice("best.par", start, length)
    summed = F.aggregate(F.slice("best.par", 2, dims - 1), F.lit(0.0), lambda a, b: a + b)
    n, k = F.col("n"), 1 + dims
    loglik = -0.5 * (F.col("best.loss") + n * math.log(2 * math.pi)) - n * F.log("sd")
    names = ["v", *(f"e{i}" for i in range(1, p + 1)), *(f"v{i}" for i in range(1, q + 1))]

    def ratios(par: Column) -> Column:
        """Squares over their variances, month by month."""
        start = F.struct(F.array().cast("array<double>").alias("z"), *(F.lit(1.0).alias(x) for x in names))

        def move(s: Column, x: Column) -> Column:
            v = reduce(lambda a, b: a + b, (F.get(par, F.lit(i)) * s[m] for i, m in enumerate(names[1:], 1)), F.get(par, F.lit(0)))
            held = lambda v: F.struct(F.concat(s["z"], F.array(x / v)).alias("z"), v.alias("v"), *((x if m == "e1" else v if m == "v1" else s[f"{m[0]}{int(m[1:]) - 1}"]).alias(m) for m in names[1:]))
            return F.element_at(F.transform(F.array(F.greatest(v, F.lit(1e-9))), held), 1)

        return F.aggregate("e2", start, move, lambda s: s["z"])

    out = by.withColumn("z", ratios(F.col("best.par"))).withColumn("mean", F.aggregate("z", F.lit(0.0), lambda a, b: a + b) / n)
    out = out.withColumn("z", F.transform("z", lambda v: v - F.col("mean"))).withColumn("square", F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b))
    rho = lambda j: F.aggregate(F.zip_with(F.slice("z", F.lit(j + 1), n.cast("int") - j), F.slice("z", F.lit(1), n.cast("int") - j), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.col("square")
    ljung = n * (n + 2) * reduce(lambda a, b: a + b, (rho(j) ** 2 / (n - j) for j in range(1, 11)))
    return out.select(
        "series", "mu", (F.element_at("best.par", 1) * F.col("sd") ** 2).alias("omega"), weight(2, p).alias("alpha"), weight(2 + p, q).alias("beta"), summed.alias("persistence"),
        loglik.alias("loglik"), (2 * k - 2 * loglik).alias("aic"), (k * F.log(n.cast("double")) - 2 * loglik).alias("bic"), ljung.alias("ljung_box"), chi2_upper(ljung, 10).alias("ljung_box_p"), "n",
    )


def forecast(fits: DataFrame, horizon: int = 12) -> DataFrame:
    """The unconditional variance for each step ahead."""
    variance = F.col("omega") / F.greatest(1 - F.col("persistence"), F.lit(1e-6))
    return fits.select("series", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.round(variance, 6).alias("variance"))


def with_p_values(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Two-sided p-value of a correlation."""
    return df.withColumn("p_value", F.round(correlation_p(F.col(r), F.col(n)), 10))


def with_inference(fits: DataFrame, lost: int = 0) -> DataFrame:
    """p-value and 95 % interval of a regression's slope; a perfect fit has p-value 0."""
    df = F.col("n") - 2 - lost
    t = F.coalesce("t_value", F.lit(float("inf")))
    half = t_quantile(df) * F.col("slope_error")
    return fits.withColumns({"p_value": F.round(t_two_sided(t, df), 10), "low": F.round(F.col("slope") - half, 6), "high": F.round(F.col("slope") + half, 6)})
