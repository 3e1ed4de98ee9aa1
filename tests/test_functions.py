"""Scalar functions, calendar, sources, sinks, cache, streams and statistics against values worked out by hand."""

import json
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger.functions import fiscal, tails, values
from loomledger.operators import aggregate, filters, registry, series, structure, volatility
from loomledger.plans import compiler
from loomledger.plans.spec import Intent, QuerySpec
from loomledger.sources import ledger as sources
from loomledger.sources import schema
from loomledger.streaming import events


def column(spark, kind, given, f):
    rows = spark.createDataFrame(list(enumerate(given)), f"k int, x {kind}").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_formats(spark):
    assert column(spark, "double", [0.0, -12.5, 1234.5, -2.5e6, None], values.format_currency) == ["$0.00", "-$12.50", "$1.23K", "-$2.50M", None]
    assert column(spark, "double", [999.0, 1500.0, 2.5e6, 3e9], values.format_axis) == ["999", "1.5K", "2.5M", "3.0B"]
    assert column(spark, "double", [0.1234, -1.0], values.format_percentage) == ["12.34%", "-100.00%"]
    assert column(spark, "double", [1.5, 0.0], values.format_ratio) == ["1.50x", "0.00x"]


def test_amounts_and_dates(spark):
    amounts = column(spark, "string", ["$1,234.50", "(99.00)", "($1,234.50)", "abc", "", "12", None], values.parse_amount)
    assert list(map(float, amounts)) == [1234.5, -99.0, -1234.5, 0.0, 0.0, 12.0, 0.0]
    days = column(spark, "string", ["2/13/2025", "2025-02-13", "13/2/2025", "2025-02-13T10:00:00", "no date", "Feb 13, 2025", None], values.parse_date)
    assert list(map(str, days)) == ["2025-02-13"] * 4 + ["None", "2025-02-13", "None"]


def test_safe_divide_and_tolerance(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(values.safe_divide(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None]
    rows = spark.createDataFrame([(100.5, 100.0), (102.0, 100.0), (0.0, 0.0), (1.0, 0.0)], "a double, e double")
    assert [r[0] for r in rows.select(values.within_tolerance(F.col("a"), F.col("e"))).collect()] == [True, False, True, False]


def test_names(spark):
    (found,) = column(spark, "string", ["Research & Development (Parent) : Platform"], values.aliases)
    assert {"platform", "research & development", "r&d", "research and development (parent) : platform"} <= {x.replace("  ", " ") for x in found}
    (joined,) = column(spark, "string", ["S & M"], values.aliases)
    assert {"s & m", "sm"} <= set(joined)
    assert column(spark, "string", ["A, B-a (c)/b", "", None], values.tokens) == [["a", "b", "c"], [], None]
    score = lambda term: (lambda name: F.round(values.match_score(F.lit(term), name, values.aliases(name)), 2))
    names = ["G&A (Parent) : Finance", "Finance", "R&D (Parent) : Product"]
    assert column(spark, "string", names, score("Finance")) == [1.0, 1.0, 0.0]


def test_account_classes(spark):
    assert column(spark, "string", ["598100", "591000", "100000", "410000", "99", None], values.account_class) == ["Depreciation & Amortization", "General & Administrative", "Assets", "Revenue", None, None]
    assert column(spark, "string", ["410000", "200000", "x"], values.statement_type) == ["income_statement", "balance_sheet", "unknown"]


AS_OF = date(2025, 6, 15)  # in fiscal year 2026, which began in February


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("FY26", date(2025, 2, 1), date(2026, 1, 31)),
        ("Q1 FY26", date(2025, 2, 1), date(2025, 4, 30)),
        ("FY2026 P3", date(2025, 4, 1), date(2025, 4, 30)),
        ("January 2024", date(2024, 1, 1), date(2024, 1, 31)),
        ("2024", date(2024, 1, 1), date(2024, 12, 31)),
        ("YTD", date(2025, 2, 1), date(2025, 5, 31)),
        ("QTD", date(2025, 5, 1), AS_OF),
        ("MTD", date(2025, 6, 1), AS_OF),
        ("last month", date(2025, 5, 1), date(2025, 5, 31)),
        ("last quarter", date(2025, 2, 1), date(2025, 4, 30)),
        ("this year", date(2025, 2, 1), date(2026, 1, 31)),
        ("last year", date(2024, 2, 1), date(2025, 1, 31)),
        ("ttm", date(2024, 6, 1), date(2025, 5, 31)),
    ],
)
def test_periods(text, start, end):
    p = fiscal.parse_period(text, AS_OF)
    assert (p.start, p.end) == (start, end)


def test_period_arithmetic():
    assert fiscal.parse_period("someday", AS_OF) is None
    assert fiscal.fiscal_year_of(date(2025, 1, 31)) == 2025 and fiscal.fiscal_year_of(date(2025, 2, 1)) == 2026
    assert fiscal.fiscal_year_of(date(2025, 1, 31), 1) == 2025
    leap = fiscal.months(date(2024, 2, 1), 1, "Feb")
    assert fiscal.prior_year(leap).end == date(2023, 2, 28) and fiscal.prior_period(leap).start == date(2024, 1, 1)
    assert fiscal.trailing_months(AS_OF, 12, legacy=True).start == date(2024, 5, 1)


def raw(spark):
    rows = [("$1,000.00", "2/13/2025", "510000", "VendBill"), ("(99.00)", "2025-03-01", "410000", None), ("abc", "no date", None, "Journal")]
    return spark.createDataFrame(rows, "Amount string, TRANDATE string, account_number string, type_text string")


def test_canonical_ledger(spark):
    df = schema.canonical(raw(spark))
    assert [(float(r.amount), str(r.trandate), str(r.period_start)) for r in df.collect()] == [(1000.0, "2025-02-13", "2025-02-01"), (-99.0, "2025-03-01", "2025-03-01"), (0.0, "None", "None")]
    schema.validate(raw(spark))
    with pytest.raises(ValueError):
        schema.validate(spark.createDataFrame([(1,)], "x int"))
    groups = {r[0]: r.n for r in aggregate.group(df, ["account_number"], ("count",)).collect()}
    assert groups == {"510000": 1, "410000": 1, "Unknown": 1}


def test_custom_filter_and_audit(spark):
    df = schema.canonical(raw(spark))
    part, audit = filters.apply(df, [("amount", "amount over 500", F.col("amount") > 500), ("subsidiary", "subsidiary US", F.lit(False))])
    assert part.count() == 1 and audit == ["amount over 500", "subsidiary US: field not found"]
    assert compiler.audit(df, QuerySpec(prefixes=("5",), departments=("x",)))[-1].endswith("field not found")
    detail = compiler.compile_spec(df, QuerySpec(Intent.DETAIL, prefixes=("4",), top_n=5))
    assert [r.account_number for r in detail.collect()] == ["410000"]
    with pytest.raises(ValueError):
        compiler.compile_spec(df, QuerySpec(questions=(("sales", ("a", "b")),)))


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sources.write(df, str(tmp_path / "out"), kind)
    back = spark.read.schema(df.schema).option("header", "true").format(kind).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]


def test_pages_of_a_response(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"success": True, "results": [{"id": 2 * k}, {"id": 2 * k + 1}]}, indent=1))
    assert sorted(r.id for r in sources.read_pages(spark, str(tmp_path)).collect()) == list(range(6))


def test_cache(spark):
    now, built = [0.0], []

    def build():
        built.append(1)
        return spark.range(10)

    cache = sources.ResultCache(ttl=60, clock=lambda: now[0])
    assert cache.filtered("base", build, "id > 7").count() == 2 and cache.filtered("base", build, "id < 3").count() == 3
    assert len(built) == 1 and cache.key("a") != cache.key("b")
    now[0] = 61
    cache.get("base", build)
    assert len(built) == 2
    cache.clear()


def test_synthetic_ledger(spark):
    df = schema.canonical(sources.synthetic_ledger(spark, 400))
    again = schema.canonical(sources.synthetic_ledger(spark, 400))
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))
    assert df.where("trandate is null or account_number is null").count() == 0 and df.select("account_number").distinct().count() == 8


def test_registry(spark):
    rows = [("G&A (Parent) : GPS East", "510000"), ("G&A (Parent) : GPS West", "510000"), ("R&D (Parent) : Product", "520000")]
    found = registry.build(spark.createDataFrame(rows, "department_name string, account_number string"))
    best = registry.lookup(found, "GPS").where("kind = 'department'").collect()
    assert len(best) == 2 and registry.is_ambiguous(best)
    assert registry.lookup(found, "nothing like it").count() == 0
    terms = spark.createDataFrame([("product",), ("gps",)], "term string")
    assert {(r.term, r.name) for r in registry.lookup_all(found, terms, 0.5).collect()} >= {("product", rows[2][0]), ("gps", rows[0][0])}


def test_change_and_liquidity(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 0.0), (-2.0, -4.0)], "a double, b double")
    assert [tuple(r) for r in df.select(*structure.change(F.col("a"), F.col("b"))).collect()] == [(1.0, 0.25), (5.0, 0.0), (2.0, 0.5)]
    (r,) = spark.range(1).select(*structure.liquidity(F.lit(5.0), F.lit(1.0), F.lit(0.0))).collect()
    assert r.current_ratio == math.inf and r.confidence == 0


TRACES = [("a", "revenue by month", "success", "2025-01-01T10:00:00", 100.0, 1.0), ("b", "Costs", "error", "2025-01-01T11:00:00", 300.0, 2.0), ("c", "revenue", "success", "2025-01-02T10:00:00", 200.0, 0.5)]


def write_traces(folder):
    for i, q, s, t, ms, cost in TRACES:
        (folder / f"{i}.json").write_text(json.dumps({"trace_id": i, "query": q, "status": s, "start_time": t, "duration_ms": ms, "metrics": {"cost": cost, "total_tokens": 10}}, indent=1))


def test_traces(spark, tmp_path):
    write_traces(tmp_path)
    df = events.traces(spark, str(tmp_path))
    assert {r.trace_id for r in events.search(df, text="REVENUE").collect()} == {"a", "c"}
    assert {r.trace_id for r in events.search(df, status="error", text="b").collect()} == {"b"}
    assert {(str(r.day), r.n, r.success_rate, r.cost) for r in events.trace_stats(df, "day").collect()} == {("2025-01-01", 2, 0.5, 3.0), ("2025-01-02", 1, 1.0, 0.5)}


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


def test_trace_stream(spark, tmp_path):
    write_traces(tmp_path)
    df = events.traces(spark, str(tmp_path), streaming=True)
    assert df.isStreaming and {r.trace_id for r in drained(events.search(df, status="success"), "found")} == {"a", "c"}
    seen = events.first_seen(events.traces(spark, str(tmp_path), streaming=True), ["status"], "start_time", "7 days")
    assert {r.status for r in drained(seen, "first")} == {"success", "error"} and spark.table("first").count() == 2


def test_daily_and_sessions_on_a_stream(spark, tmp_path):
    rows = [(1, "2025-01-01 10:00:00", "view", 1.0), (1, "2025-01-01 10:10:00", "view", 2.0), (1, "2025-01-01 12:00:00", "view", 4.0), (2, "2025-01-05 00:00:00", "click", 8.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    table = lambda rows: sorted(map(str, rows))
    assert table(drained(events.daily(stream), "days", "complete")) == table(events.daily(df).collect())
    got = drained(events.sessions(stream), "sessions", "complete")
    assert table(got) == table(events.sessions(df).collect()) and sorted(r.n for r in got) == [1, 1, 2]


def test_tails(spark):
    """Table values of the t, F and chi-square distributions."""
    cases = {
        "t": (tails.t_two_sided(F.lit(2.228), F.lit(10)), 0.05, 2e-4),
        "t1": (tails.t_two_sided(F.lit(1.0), F.lit(1)), 0.5, 1e-11),
        "far": (tails.t_two_sided(F.lit(0.01), F.lit(4000)), 0.992022, 1e-5),
        "q10": (tails.t_quantile(F.lit(10)), 2.228139, 1e-5),
        "q1": (tails.t_quantile(F.lit(1)), 12.706205, 1e-3),
        "q500": (tails.t_quantile(F.lit(500)), 1.964720, 1e-5),
        "f": (tails.f_upper(F.lit(3.33), F.lit(5), F.lit(10)), 0.05, 5e-4),
        "chi": (tails.chi2_upper(F.lit(11.0705), 5), 0.05, 1e-5),
        "chi10": (tails.chi2_upper(F.lit(18.307), 10), 0.05, 1e-5),
        "chi far": (tails.chi2_upper(F.lit(280.0), 5), 0.0, 1e-12),
        "r": (tails.correlation_p(F.lit(0.632), F.lit(10)), 0.05, 1e-3),
        "one": (tails.correlation_p(F.lit(1.0), F.lit(5)), 0.0, 0.0),
        "lgamma": (tails.lgamma(F.lit(0.5)), 0.5723649429, 1e-9),
    }
    (got,) = spark.range(1).select(*(c.alias(k) for k, (c, _, _) in cases.items())).collect()
    for k, (_, want, off) in cases.items():
        assert got[k] == pytest.approx(want, abs=off), k


def monthly(spark, **named):
    rows = [(k, date(2000 + i // 12, i % 12 + 1, 28), i, float(x)) for k, xs in named.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series string, month date, pos int, value double").withColumn("month", F.last_day("month"))


def test_seasons(spark):
    i, noise = np.arange(36), np.random.default_rng(42).normal(0, 10, 36)
    df = monthly(spark, seasonal=10 * i + 100 * np.sin(2 * np.pi * i / 12) + noise, pure=1000 + 100 * np.sin(2 * np.pi * i / 12), short=i[:20])
    strength = {r.series: r.strength for r in series.seasonality_strength(series.decompose(df)).collect()}
    assert strength["seasonal"] > 0.2 and strength["pure"] > 0.9 and "short" not in strength
    adjusted = series.seasonally_adjusted(df).where("series = 'short'").collect()
    assert len(adjusted) == 20 and all(r.adjusted == r.value for r in adjusted)


def test_drivers_find_the_lag(spark):
    r = np.random.default_rng(1)
    revenue = 1000 + r.normal(0, 100, 24)
    late = np.concatenate([[300.0, 300.0], 0.3 * revenue[:-2]])
    costs = monthly(spark, late=late + r.normal(0, 1, 24), office=r.normal(50, 5, 24))
    found = {x.series: x for x in series.revenue_drivers(costs, monthly(spark, revenue=revenue), adjust=False).collect()}
    assert found["late"].expense_lag_after_revenue == 2 and found["late"].r > 0.95 > abs(found["office"].r)
    pairs = monthly(spark, a=2 * np.arange(100) + 5 + r.normal(0, 1, 100)).select("series", F.col("pos").cast("double").alias("x"), F.col("value").alias("y"))
    (fit,) = volatility.with_inference(series.regression(pairs, ["series"])).collect()
    assert abs(fit.slope - 2) < 0.1 and fit.r2 > 0.9 and fit.n == 100 and fit.low < fit.slope < fit.high and fit.p_value < 1e-6


def test_seasonal_regression_is_the_model_with_dummies(spark):
    r = np.random.default_rng(3)
    n, k = 40, 4
    slot, x = np.arange(n) % k, r.normal(0, 1, n)
    y = 3 * x + slot * 10 + r.normal(0, 1, n)
    design = np.column_stack([x] + [(slot == j).astype(float) for j in range(k)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sse = ((y - design @ beta) ** 2).sum()
    df = spark.createDataFrame([("a", float(a), float(b), int(s)) for a, b, s in zip(x, y, slot)], "series string, x double, y double, slot int")
    (fit,) = series.seasonal_regression(df, ["series"], "slot").collect()
    assert fit.slope == pytest.approx(beta[0], abs=1e-5)
    assert fit.r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), abs=1e-5)
    assert fit.adjusted_r2 == pytest.approx(1 - sse / (n - k - 1) / (((y - y.mean()) ** 2).sum() / (n - 1)), abs=1e-5)


def simulated_garch(n=1500, omega=0.2, alpha=0.2, beta=0.7, seed=5):
    r, out, v = np.random.default_rng(seed), [], omega / (1 - alpha - beta)
    for _ in range(n):
        e = math.sqrt(v) * r.normal()
        out.append(e)
        v = omega + alpha * e * e + beta * v
    return np.array(out)


def normal_equations(x, lags=5):
    """LM and F of Engle's test by least squares."""
    e2 = (x - x.mean()) ** 2
    y, design = e2[lags:], np.column_stack([np.ones(len(x) - lags), *(e2[lags - k : -k] for k in range(1, lags + 1))])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    r2 = 1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum()
    return len(y) * r2, (r2 / lags) / ((1 - r2) / (len(y) - lags - 1))


def test_arch_effects(spark):
    garch, noise, flat = simulated_garch(400), np.random.default_rng(2).normal(0, 1, 300), np.ones(40)
    found = {r.series: r for r in volatility.arch_effects(monthly(spark, garch=garch, noise=noise, flat=flat, short=noise[:14])).collect()}
    assert set(found) == {"garch", "noise", "flat"} and found["flat"].lm == 0 and found["flat"].lm_p == 1
    for name, x in (("garch", garch), ("noise", noise)):
        lm, f = normal_equations(x)
        assert found[name].lm == pytest.approx(lm, abs=1e-5) and found[name].f == pytest.approx(f, abs=1e-5) and found[name].n == len(x)
    assert found["garch"].lm_p < 1e-3 < 0.01 < found["noise"].lm_p and found["garch"].f_p < 1e-3


def loglik(x, omega, alpha):
    """Of ARCH(1), what lies before the first value being the mean square."""
    e2 = (x - x.mean()) ** 2
    v = omega + alpha * np.concatenate(([e2.mean()], e2[:-1]))
    return -0.5 * (np.log(2 * np.pi * v) + e2 / v).sum()


def test_garch(spark):
    x = simulated_garch()
    rows = monthly(spark, garch=x, arch=simulated_garch(1200, 0.5, 0.4, 0.0, 8), short=x[:40])
    found = {r.series: r for r in volatility.fit(rows).collect()}
    assert set(found) == {"garch", "arch"}
    fit = found["garch"]
    assert fit.alpha[0] == pytest.approx(0.2, abs=0.08) and fit.persistence == pytest.approx(0.9, abs=0.08) and fit.omega == pytest.approx(0.2, abs=0.15)
    assert fit.ljung_box_p > 0.01 and fit.n == 1500 and fit.aic < fit.bic and not any("Pandas" in p for p in [volatility.fit(rows)._jdf.queryExecution().toString()])
    (arch,) = volatility.fit(rows.where("series = 'arch'"), 1, 0).collect()
    best = max((loglik(simulated_garch(1200, 0.5, 0.4, 0.0, 8), c, a), a) for c in np.linspace(0.3, 0.9, 61) for a in np.linspace(0, 0.8, 81))
    assert arch.loglik >= best[0] - 0.01 and arch.alpha[0] == pytest.approx(best[1], abs=0.02) and arch.beta == []
    assert found["arch"].loglik >= arch.loglik - 0.05
    (two,) = volatility.fit(rows.where("series = 'arch'"), 2, 0).collect()
    assert two.loglik >= arch.loglik - 0.05 and len(two.alpha) == 2
    rows = volatility.forecast(spark.createDataFrame([("a", 0.2, 0.9)], "series string, omega double, persistence double"), 3).collect()
    assert [(r.step, r.variance) for r in rows] == [(1, 2.0), (2, 2.0), (3, 2.0)]
