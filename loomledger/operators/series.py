"""Monthly series: resampling, decomposition, correlation, regression and trend.

Series are long (``series, month, value``); months are dense between a series' first and last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import correlation_strength, safe_divide, trend_strength


def monthly(ledger: DataFrame, series: str | Column, how: str = "sum") -> DataFrame:
    """``series, month`` (its last day) ``, value``; months of value 0 are left out."""
    series = F.col(series) if isinstance(series, str) else series
    agg = {"sum": F.sum("amount").cast("double"), "mean": F.round(F.sum("amount").cast("double") / F.count("amount"), 6), "count": F.count("*").cast("double")}[how]
    return ledger.where("trandate is not null").groupBy(series.alias("series"), F.last_day("trandate").alias("month")).agg(agg.alias("value")).where("value <> 0")


def dense(series: DataFrame) -> DataFrame:
    """Missing months between the first and the last become 0; ``pos`` counts months from 0."""
    begins, whole = F.trunc("month", "MM"), Window.partitionBy("series")
    ahead = F.trunc(F.lead("month").over(whole.orderBy("month")), "MM")  # each row stands for the months up to the next row's
    rows = series.select("series", "value", begins.alias("a"), F.coalesce(F.add_months(ahead, -1), begins).alias("b"), F.trunc(F.min("month").over(whole), "MM").alias("zero"))
    rows = rows.select("series", "value", "a", "zero", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    pos = F.months_between("m", "zero").cast("int").alias("pos")
    return rows.select("series", F.last_day("m").alias("month"), pos, F.when(F.col("m") == F.col("a"), F.col("value")).otherwise(0.0).alias("value"))


def aligned(series: DataFrame, names: list[str], coverage: float = 0.5, least: int = 12) -> DataFrame:
    """One column per series over the union of months; sparse and short series are dropped first."""
    months = series.select("month").distinct().count()
    good = series.groupBy("series").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") >= coverage * months)).select("series")
    return series.join(good, "series", "left_semi").groupBy("month").pivot("series", names).agg(F.first("value"))


def decompose(series: DataFrame, period: int = 12, keep_short: bool = False) -> DataFrame:
    """Additive: centred moving average, mean by position in the period, rest.

    Series under two periods are left out, or kept without parts.
    """
    whole, order = Window.partitionBy("series"), Window.partitionBy("series").orderBy("pos")
    x = series.withColumn("n", F.count("*").over(whole))
    enough = F.col("n") >= 2 * period
    if not keep_short:
        x = x.where(enough)
    width = F.greatest(F.least(F.lit(period), F.floor(F.col("n") / 4)), F.lit(2)).cast("int")
    x = x.withColumn("w", width)
    trend = F.lit(None).cast("double")
    for w in range(2, period + 1):  # a frame per possible width; each series uses one
        ahead = (w - 1) // 2
        frame = order.rowsBetween(ahead + 1 - w, ahead)
        trend = F.when(F.col("w") == w, F.when(F.count("value").over(frame) == w, F.avg("value").over(frame))).otherwise(trend)
    x = x.withColumn("t", trend)
    back = F.first("t", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    fore = F.last("t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("trend", F.coalesce(back, fore))
    slot = Window.partitionBy("series", F.pmod("pos", F.lit(period)))
    x = x.withColumn("s", F.avg(F.col("value") - F.col("trend")).over(slot))
    # The means are centred on the mean of the (at most ``period``) slot means.
    first = F.row_number().over(slot.orderBy("pos")) == 1
    x = x.withColumn("one", F.when(first, F.col("s"))).withColumn("seasonal", F.col("s") - F.avg("one").over(whole))
    r6 = lambda c: F.when(enough, F.round(c, 6))
    return x.select("series", "month", "pos", "value", r6(F.col("trend")).alias("trend"), r6(F.col("seasonal")).alias("seasonal"), r6(F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonally_adjusted(series: DataFrame, period: int = 12) -> DataFrame:
    """Value less its seasonal part; a series too short for one is unchanged."""
    parts = decompose(series, period, keep_short=True)
    return parts.select("series", "month", "pos", "value", F.round(F.col("value") - F.coalesce("seasonal", F.lit(0.0)), 6).alias("adjusted"))


def seasonality_strength(parts: DataFrame) -> DataFrame:
    by = parts.groupBy("series").agg(F.var_pop("seasonal").alias("vs"), F.var_pop("residual").alias("vr"))
    strength = F.round(F.coalesce(safe_divide(F.col("vs"), F.col("vs") + F.col("vr")), F.lit(0.0)), 4)
    grade = F.when(strength >= 0.7, "strong").when(strength >= 0.4, "moderate").when(strength >= 0.2, "weak").otherwise("none")
    return by.select("series", strength.alias("strength"), grade.alias("grade"))


def ranks(df: DataFrame, value: str, by: list[str]) -> Column:
    """Average ranks of ties."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlate(pairs: DataFrame, by: list[str], method: str = "pearson") -> DataFrame:
    """``r, n`` of columns x and y per group; 0 for fewer than three rows or no variation."""
    if method == "spearman":
        pairs = pairs.select(*by, ranks(pairs, "x", by).alias("x"), ranks(pairs, "y", by).alias("y"))
    elif method == "kendall":
        return _kendall(pairs, by)
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("c"))
    r = F.when((F.col("n") < 3) | F.col("c").isNull() | F.isnan("c"), 0.0).otherwise(F.round("c", 6))
    return out.select(*by, r.alias("r"), "n")


def _kendall(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Tau-b without pairs of rows: inversions of y in the order of x, counted bit by bit of its rank.

    Two rows are inverted if the earlier one has the greater rank: at the first bit in which the ranks differ it has a 1
    and the later one a 0.  So of the rows with equal higher bits, each one with a 0 counts the 1s before it: a running
    sum for each bit, n log n rows in all.  Equal rows are counted first and go on as one, so what is sorted of a group
    is its different pairs of values.
    """
    rows = pairs.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("__k"))
    whole = Window.partitionBy(*by)
    tied = lambda *c: F.col("__k") * (F.sum("__k").over(Window.partitionBy(*by, *c)) - 1) / 2
    same = F.col("__k") * (F.col("__k") - 1) / 2
    rows = rows.select(*by, "__k", F.row_number().over(whole.orderBy("x", "y")).alias("__at"), (F.dense_rank().over(whole.orderBy("y")) - 1).alias("__rank"), tied("x").alias("__tx"), tied("y").alias("__ty"), same.alias("__txy"))
    base = rows.groupBy(*by).agg(F.sum("__k").alias("n"), F.sum("__tx").alias("tx"), F.sum("__ty").alias("ty"), F.sum("__txy").alias("txy"))
    bits = rows.withColumn("__top", F.max("__rank").over(whole))
    bits = bits.select(*by, "__k", "__at", "__rank", F.explode(F.sequence(F.lit(0), F.length(F.bin("__top")) - 1)).alias("__bit"))
    one = F.expr("shiftright(__rank, __bit) & 1")
    bits = bits.select(*by, "__k", "__at", "__bit", F.expr("shiftright(__rank, __bit + 1)").alias("__above"), one.alias("__one"))
    before = F.sum(F.col("__one") * F.col("__k")).over(Window.partitionBy(*by, "__bit", "__above").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    inverted = bits.select(*by, F.when(F.col("__one") == 0, F.col("__k") * before).alias("__before")).groupBy(*by).agg(F.sum("__before").alias("inverted"))
    out = base.join(inverted, by, "left")
    every = F.col("n") * (F.col("n") - 1) / 2
    score = every - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce("inverted", F.lit(0))
    tau = safe_divide(score, F.sqrt((every - F.col("tx")) * (every - F.col("ty"))))
    return out.select(*by, F.round(F.coalesce(tau, F.lit(0.0)), 6).alias("r"), "n")


def correlation_matrix(series: DataFrame, method: str = "pearson") -> DataFrame:
    """``a, b, r, n`` for each pair of series (a < b) over their common months."""
    a, b = series.select("month", F.col("series").alias("a"), F.col("value").alias("x")), series.select("month", F.col("series").alias("b"), F.col("value").alias("y"))
    return correlate(a.join(b, "month").where("a < b"), ["a", "b"], method)


def revenue_drivers(series: DataFrame, revenue: DataFrame, max_lag: int = 3, adjust: bool = True, method: str = "pearson") -> DataFrame:
    """Per expense series the lag (in months, expense after revenue) with the strongest correlation.

    ``series`` and ``revenue`` are dense.  Series of 24 months or more are seasonally adjusted first.
    Ties go to the smaller lag; fewer than three common months give no row.
    """
    if adjust:
        fit = lambda s: seasonally_adjusted(s).select("series", "month", F.col("adjusted").alias("value"))
        series, revenue = fit(series), fit(revenue)
    lagged = series.select("series", "value", "month", F.explode(F.array(*map(F.lit, range(max_lag + 1)))).alias("lag"))
    lagged = lagged.withColumn("month", F.last_day(F.add_months(F.trunc("month", "MM"), -F.col("lag"))))
    pairs = lagged.join(revenue.select("month", F.col("value").alias("y")), "month").select("series", "lag", F.col("value").alias("x"), "y")
    each = correlate(pairs, ["series", "lag"], method).where("n >= 3")
    best = Window.partitionBy("series").orderBy(F.abs("r").desc(), "lag")
    out = each.withColumn("k", F.row_number().over(best)).where("k = 1")
    return out.select("series", F.col("lag").alias("expense_lag_after_revenue"), "r", "n", correlation_strength(F.col("r")).alias("strength"))


def ranked_drivers(drivers: DataFrame, top_n: int = 10) -> DataFrame:
    """The strongest positive and negative drivers: ``direction`` and ``rank`` by \\|r\\|; ties by name, r = 0 in neither."""
    out = drivers.where("r <> 0").withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.abs("r").desc(), "series"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_n)


def regression(pairs: DataFrame, by: list[str], lost: int = 0) -> DataFrame:
    """Least squares of y on x with a constant, per group: slope, intercept, errors, R², n.  Fewer than three rows give none."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    df = F.col("n") - 2 - lost
    out = out.where((F.col("n") >= 3 + lost) & (F.col("sxx") > 0)).withColumn("b", F.col("sxy") / F.col("sxx"))
    sse = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    r2 = F.coalesce(1 - safe_divide(sse, F.col("syy")), F.lit(0.0))
    se = F.sqrt(sse / df / F.col("sxx"))
    r6 = lambda c: F.round(c, 6)
    return out.select(*by, r6(F.col("b")).alias("slope"), r6(F.col("my") - F.col("b") * F.col("mx")).alias("intercept"), r6(se).alias("slope_error"), r6(safe_divide(F.col("b"), se)).alias("t_value"), r6(r2).alias("r2"), r6(1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 1 - 1 - lost)).alias("adjusted_r2"), "n")


def seasonal_regression(pairs: DataFrame, by: list[str], slot: str) -> DataFrame:
    """With a dummy per slot that occurs: x and y less their slot means (Frisch-Waugh) give slope and error sum.

    R² is the whole model's, dummies included.  Groups without a degree of freedom give no row.
    """
    w = Window.partitionBy(*by, slot)
    inner = pairs.select(*by, slot, F.col("y").alias("whole"), (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    sums = [F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("within"), (F.var_pop("whole") * F.count("*")).alias("total")]
    out = inner.groupBy(*by).agg(F.count("*").alias("n"), F.size(F.collect_set(slot)).alias("slots"), *sums)
    df = F.col("n") - F.col("slots") - 1
    out = out.where((df > 0) & (F.col("sxx") > 0)).withColumn("b", F.col("sxy") / F.col("sxx"))
    sse = F.greatest(F.col("within") - F.col("b") * F.col("sxy"), F.lit(0.0))
    r2, se = F.coalesce(1 - safe_divide(sse, F.col("total")), F.lit(0.0)), F.sqrt(sse / df / F.col("sxx"))
    r6 = lambda c: F.round(c, 6)
    return out.select(*by, r6(F.col("b")).alias("slope"), r6(se).alias("slope_error"), r6(safe_divide(F.col("b"), se)).alias("t_value"), r6(r2).alias("r2"), r6(1 - (1 - r2) * (F.col("n") - 1) / df).alias("adjusted_r2"), "n")


def trend(series: DataFrame) -> DataFrame:
    """Slope per month and R² of each series on its position; fewer than two months give none."""
    out = series.groupBy("series").agg(F.regr_slope("value", "pos").alias("b"), F.regr_r2("value", "pos").alias("r2"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    r2 = F.round(F.coalesce("r2", F.lit(0.0)), 6)
    return out.where("n >= 2").select("series", F.round("b", 6).alias("slope"), r2.alias("r2"), "low", "high", trend_strength(r2).alias("strength"), "n")
