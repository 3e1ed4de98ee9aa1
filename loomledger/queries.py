"""Every queryable operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fiscal, values
from .operators import aggregate, analysis, filters, prefixes, ranges, registry, series, structure, trees, volatility
from .plans import compiler, semantics
from .plans.spec import Intent, QuerySpec
from .sources.ledger import LEDGER_SQL, account_list, profile, sample_ledger, sql_over, synthetic_ledger, tables
from .sources.schema import canonical
from .sources.scratch import Scratch
from .sources.store import LedgerStore
from .streaming import events

AS_OF = date(2000, 6, 15)
YTD = fiscal.year_to_date(AS_OF)
LAST_YTD = fiscal.prior_year(YTD)
FY = fiscal.fiscal_year(2000)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _days(p: fiscal.Period, c: str = "period_start") -> str:
    start = p.start.replace(day=1) if c == "period_start" else p.start
    return f"{c} BETWEEN DATE '{start}' AND DATE '{p.end}'"


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which reads alike in every engine."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, ledger: bool = True):
    """Register a query; ``sql`` may use the ledger view."""

    def add(f):
        if ledger:
            QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(sample_ledger(spark, sf_dir)))
        else:
            QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {LEDGER_SQL} " if ledger else "") + sql
        return f

    return add


FY_SQL = "(year(trandate) + CASE WHEN month(trandate) >= 2 THEN 1 ELSE 0 END)"
FQ_SQL = "CAST(((month(trandate) - 2 + 12) % 12) // 3 + 1 AS INTEGER)"
SUM = "CAST(sum(amount) AS DOUBLE)"
OPEX = "account_number LIKE '5%' AND lower(account_name) NOT LIKE '%total%'"


def case_sum(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN amount ELSE CAST(0 AS DECIMAL(18,4)) END)"


def compare_sql(dims: str, where: str = "TRUE", a: fiscal.Period = YTD, b: fiscal.Period = LAST_YTD) -> str:
    return f"""SELECT {dims}{", " if dims else ""}CAST(c AS DOUBLE) AS current, CAST(p AS DOUBLE) AS prior, CAST(c - p AS DOUBLE) AS variance,
        CASE WHEN p = 0 THEN NULL ELSE round(CAST(c - p AS DOUBLE) / CAST(abs(p) AS DOUBLE), 6) END AS variance_frac
        FROM (SELECT {dims}{", " if dims else ""}{case_sum(_days(a))} AS c, {case_sum(_days(b))} AS p FROM ledger
              WHERE ({_days(a)} OR {_days(b)}) AND {where} {"GROUP BY " + dims if dims else ""})"""


# Flagship: operating expenses by department, year to date against the year before, five largest.
@query(compare_sql("department_name", OPEX) + " ORDER BY current DESC, department_name LIMIT 5")
def opex_by_department_ytd(ledger: DataFrame) -> DataFrame:
    part = ledger.where(filters.account_type("prefix", ["5"]))
    out = aggregate.compare(part, filters.months(YTD), filters.months(LAST_YTD), ["department_name"])
    return aggregate.top(out, 5, "current", ties=["department_name"])


# Filters.
def _filtered(name: str, pred, where: str) -> None:
    def f(ledger: DataFrame) -> DataFrame:
        return ledger.where(pred()).groupBy("department_name").agg(aggregate.total().alias("total"), F.count("*").alias("n"))

    f.__name__ = name
    query(f"SELECT department_name, {SUM} AS total, count(*) AS n FROM ledger WHERE {where} GROUP BY department_name")(f)


_filtered("filter_department_full", lambda: filters.department(["europe (parent) : nation_3"]), "lower(department_name) = 'europe (parent) : nation_3'")
_filtered("filter_department_part", lambda: filters.department(["NATION_8", "nation_12"]), "lower(split_part(department_name, ' : ', 2)) IN ('nation_8', 'nation_12')")
_filtered("filter_department_parent", lambda: filters.department_under(["Asia"]), "lower(department_name) LIKE 'asia (parent) :%'")
_filtered("filter_date_range", lambda: filters.date_range(fiscal.Period(date(1999, 3, 5), date(1999, 9, 17), "")), "trandate BETWEEN DATE '1999-03-05' AND DATE '1999-09-17'")
_filtered("filter_period_months", lambda: filters.period(fiscal.Period(date(1999, 3, 5), date(1999, 9, 17), "")), "period_start BETWEEN DATE '1999-03-01' AND DATE '1999-09-01'")
_filtered("filter_account_contains", lambda: filters.account(["brand#1"]), "lower(account_name) LIKE '%brand#1%'")
_filtered("filter_account_prefix", lambda: filters.account_type("prefix", ["51", "53"]), "(account_number LIKE '51%' OR account_number LIKE '53%') AND lower(account_name) NOT LIKE '%total%'")
_filtered("filter_account_exact", lambda: filters.account_type("exact", ["511300"]), "account_number = '511300' AND lower(account_name) NOT LIKE '%total%'")
_filtered("filter_account_in_list", lambda: filters.account_type("in_list", ["511300", "401200"]), "account_number IN ('511300', '401200') AND lower(account_name) NOT LIKE '%total%'")
_filtered("filter_account_number_contains", lambda: filters.account_type("contains", ["13"]), "account_number LIKE '%13%' AND lower(account_name) NOT LIKE '%total%'")
_filtered("filter_account_name_prefix", lambda: filters.account_name("prefix", ["sales &"]), "lower(account_name) LIKE 'sales &%'")
_filtered("filter_account_name_exact", lambda: filters.account_name("exact", ["G&A : Brand#23"]), "lower(account_name) = 'g&a : brand#23'")
_filtered("filter_transaction_type", lambda: filters.transaction_type(["journal", "EXPREPT"]), "lower(type) IN ('journal', 'exprept')")
_filtered("filter_subsidiary", lambda: filters.subsidiary(["build", "AUTO"]), "lower(subsidiary) LIKE '%build%' OR lower(subsidiary) LIKE '%auto%'")
_filtered("filter_excluding", lambda: filters.excluding(filters.department(["nation_3"])) & filters.excluding(filters.account(["brand#2"])), "lower(split_part(department_name, ' : ', 2)) <> 'nation_3' AND lower(account_name) NOT LIKE '%brand#2%'")
_filtered(
    "filter_conjunction",
    lambda: filters.all_of([filters.months(YTD), filters.account_type("prefix", ["5"]), filters.transaction_type(["VendBill"]), filters.department(["Nation_3", "Nation_12"])]),
    f"{_days(YTD)} AND {OPEX} AND type = 'VendBill' AND split_part(department_name, ' : ', 2) IN ('NATION_3', 'NATION_12')",
)


# Classification and scalar functions.
@query(
    f"""SELECT statement_type, account_class, cost_category, department, count(*) AS n, {SUM} AS total FROM (
      SELECT amount, CASE WHEN account_number[1] IN ('4','5','6','7','8') THEN 'income_statement' ELSE 'balance_sheet' END AS statement_type,
      CASE substr(account_number, 1, 2) WHEN '51' THEN 'Cost of Goods Sold' WHEN '52' THEN 'R&D' WHEN '53' THEN 'Sales & Marketing' WHEN '59' THEN 'General & Administrative'
        ELSE CASE account_number[1] WHEN '4' THEN 'Revenue' WHEN '5' THEN 'Operating Expenses' ELSE 'Interest' END END AS account_class,
      split_part(account_name, ' : ', 1) AS cost_category, split_part(department_name, ' : ', 2) AS department FROM ledger) GROUP BY ALL"""
)
def classify_accounts(ledger: DataFrame) -> DataFrame:
    n = F.col("account_number")
    keys = [values.statement_type(n).alias("statement_type"), values.account_class(n).alias("account_class"), values.category_part(F.col("account_name")).alias("cost_category"), values.department_part(F.col("department_name")).alias("department")]
    return ledger.groupBy(*keys).agg(F.count("*").alias("n"), aggregate.total().alias("total"))


# Amounts and dates of the lines, written in the forms in which sources write them, and read again.
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_DAY = "CAST(l_shipdate AS DATE)"


@query(f"""SELECT form, count(*) AS n, CAST(sum(CASE form WHEN 1 THEN {_PRICE} WHEN 2 THEN -{_PRICE} WHEN 3 THEN -{_PRICE} WHEN 4 THEN {_PRICE} ELSE 0 END) AS DOUBLE) AS total FROM (SELECT l_extendedprice, CAST(l_orderkey % 6 AS INTEGER) AS form FROM lineitem) GROUP BY 1""", ledger=False)
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (line,) = tables(spark, sf_dir, "lineitem")
    price, form = F.col("l_extendedprice").cast("decimal(18,2)"), (F.col("l_orderkey") % 6).cast("int")
    text = F.format_number(price, 2)  # thousands by commas
    raw = F.when(form == 1, F.concat(F.lit("$"), text)).when(form == 2, F.concat(F.lit("("), text, F.lit(")"))).when(form == 3, F.concat(F.lit(" ($"), text, F.lit(") "))).when(form == 4, price.cast("string")).when(form == 5, "n/a").otherwise("")
    return line.select(form.alias("form"), values.parse_amount(raw).alias("amount")).groupBy("form").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


# Of day and month that could be either, month first is read; so in the day-first form days up to the 12th change places.
@query(f"""SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM (SELECT CASE WHEN form = 2 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) WHEN form < 6 THEN d END AS day FROM (SELECT {_DAY} AS d, CAST(l_orderkey % 7 AS INTEGER) AS form FROM lineitem)) GROUP BY 1""", ledger=False)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (line,) = tables(spark, sf_dir, "lineitem")
    day, form = F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 7).cast("int")
    raw = F.lit("no date")
    for k, pattern in enumerate(("M/d/yyyy", "yyyy-MM-dd", "d/M/yyyy", "yyyy/M/d", "MMM d, yyyy", "yyyy-MM-dd'T'10:00:00")):
        raw = F.when(form == k, F.date_format(day, pattern.replace("10:00:00", "HH:mm:ss"))).otherwise(raw)
    return line.select(values.parse_date(raw).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


# Aggregation.
@query(f"SELECT type, {SUM} AS total, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean, CAST(min(amount) AS DOUBLE) AS low, CAST(max(amount) AS DOUBLE) AS high FROM ledger GROUP BY type")
def agg_single(ledger: DataFrame) -> DataFrame:
    return aggregate.group(ledger, ["type"], ("sum", "count", "avg", "min", "max"))


for _grain, _sql in {"day": "strftime(trandate, '%Y-%m-%d')", "week": "strftime(trandate, '%Y-W%W')", "month": "strftime(trandate, '%Y-%m')", "quarter": "year(trandate) || '-Q' || quarter(trandate)", "year": "CAST(year(trandate) AS VARCHAR)"}.items():

    def _by(ledger: DataFrame, grain: str = _grain) -> DataFrame:
        return aggregate.by_period(ledger, grain)

    _by.__name__ = f"agg_by_{_grain}"
    query(f"SELECT {_sql} AS period, {SUM} AS total, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean FROM ledger GROUP BY 1")(_by)


@query(f"SELECT CAST({FY_SQL} AS INTEGER) AS fy, {FQ_SQL} AS fq, 'Q' || {FQ_SQL} || '''' || lpad(CAST({FY_SQL} % 100 AS VARCHAR), 2, '0') AS label, type, {SUM} AS total, count(*) AS n FROM ledger GROUP BY ALL")
def agg_by_fiscal_quarter(ledger: DataFrame) -> DataFrame:
    return aggregate.by_fiscal_quarter(ledger, "type")


@query(f"SELECT department_name, 'FY' || {FY_SQL} || ' Q' || {FQ_SQL} AS quarter, {SUM} AS total, count(*) AS n FROM ledger GROUP BY ALL")
def agg_multi_dimension(ledger: DataFrame) -> DataFrame:
    return aggregate.group(ledger, ["department_name", "quarter"])


@query(f"SELECT 'FY' || {FY_SQL} || ' M' || lpad(CAST((month(trandate) - 2 + 12) % 12 + 1 AS VARCHAR), 2, '0') AS fiscal_month, {SUM} AS total, count(*) AS n FROM ledger GROUP BY ALL")
def agg_by_fiscal_month(ledger: DataFrame) -> DataFrame:
    return aggregate.group(ledger, ["fiscal_month"])


_TYPES = ["Journal", "VendBill", "ExpRept"]


@query("SELECT department_name, " + ", ".join(f"CAST(sum(amount) FILTER (type = '{t}') AS DOUBLE) AS \"{t}\"" for t in _TYPES) + " FROM ledger GROUP BY department_name")
def pivot_department_by_type(ledger: DataFrame) -> DataFrame:
    return aggregate.pivot(ledger, "department_name", "type", _TYPES)


@query(f"SELECT {SUM} AS total, count(*) AS n FROM ledger")
def agg_global(ledger: DataFrame) -> DataFrame:
    return aggregate.group(ledger, [])


@query(f"SELECT account_name, CAST(s AS DOUBLE) AS total, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 6) AS share_frac FROM (SELECT account_name, sum(amount) AS s FROM ledger GROUP BY account_name)")
def share_of_total(ledger: DataFrame) -> DataFrame:
    return aggregate.shares(ledger, "account_name")


@query(f"SELECT {SUM} AS total, count(*) AS n FROM ledger WHERE {_days(fiscal.year_to_day(AS_OF), 'trandate')}")
def ytd_total(ledger: DataFrame) -> DataFrame:
    return aggregate.group(ledger.where(filters.date_range(fiscal.year_to_day(AS_OF))), [])


# Comparison.
@query(compare_sql(""))
def compare_totals(ledger: DataFrame) -> DataFrame:
    return aggregate.compare(ledger, filters.months(YTD), filters.months(LAST_YTD), [])


@query(compare_sql("department_name, type"))
def compare_multi_dimension(ledger: DataFrame) -> DataFrame:
    return aggregate.compare(ledger, filters.months(YTD), filters.months(LAST_YTD), ["department_name", "type"])


@query(compare_sql("account_name", "TRUE", fiscal.month_of(date(2000, 5, 1)), fiscal.month_of(date(2000, 4, 1))))
def variance_by_category(ledger: DataFrame) -> DataFrame:
    return aggregate.compare(ledger, filters.months(fiscal.month_of(date(2000, 5, 1))), filters.months(fiscal.month_of(date(2000, 4, 1))), ["account_name"])


_RATIO = f"""SELECT CAST(period_start AS VARCHAR) AS period_start, round(CAST(a AS DOUBLE) / CAST(b AS DOUBLE), 6) AS ratio FROM (SELECT period_start, {case_sum("account_number LIKE '5%'")} AS a, {case_sum("account_number LIKE '4%'")} AS b FROM ledger GROUP BY 1) WHERE b <> 0"""


@query(_RATIO)
def ratio_by_month(ledger: DataFrame) -> DataFrame:
    return aggregate.ratio_over_time(ledger, structure.prefix("5"), structure.prefix("4"))


@query(f"SELECT first, last, average, round(last - first, 6) AS change, n FROM (SELECT min_by(ratio, period_start) AS first, max_by(ratio, period_start) AS last, round(avg(ratio), 6) AS average, count(*) AS n FROM ({_RATIO})) WHERE n >= 2")
def ratio_over_time(ledger: DataFrame) -> DataFrame:
    return aggregate.ratio_summary(aggregate.ratio_over_time(ledger, structure.prefix("5"), structure.prefix("4")))


# Budget: last year's actuals, 5 % up, for accounts of even number only (so that both sides have gaps).
def _budget(ledger: DataFrame) -> DataFrame:
    part = ledger.where(filters.months(LAST_YTD) & ((F.substring("account_number", 4, 1).cast("int") % 2) == 0))
    return part.select("account_number", "account_name", "department_name", "period_start", (F.col("amount") * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(18,4)").alias("budget_amount"))


_BUDGET_SQL = f"""(SELECT account_number, account_name, department_name, CAST(amount * CAST(1.05 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS budget_amount FROM ledger WHERE {_days(LAST_YTD)} AND CAST(substr(account_number, 4, 1) AS INTEGER) % 2 = 0)"""
_VARIANCE_SQL = f"""SELECT account_number, CAST(a AS DOUBLE) AS actual, CAST(b AS DOUBLE) AS budget, CAST(a - b AS DOUBLE) AS variance,
  round(CASE WHEN b = 0 THEN 0 ELSE CAST(a - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 END, 6) AS variance_pct,
  CASE WHEN a - b = 0 THEN 'neutral' WHEN (account_number LIKE '4%') = (a - b > 0) THEN 'favorable' ELSE 'unfavorable' END AS status
  FROM (SELECT coalesce(x.account_number, y.account_number) AS account_number, coalesce(a, 0) AS a, coalesce(b, 0) AS b
    FROM (SELECT account_number, sum(amount) AS a FROM ledger WHERE {_days(YTD)} GROUP BY 1) x
    FULL OUTER JOIN (SELECT account_number, sum(budget_amount) AS b FROM {_BUDGET_SQL} GROUP BY 1) y ON x.account_number = y.account_number)"""


@query(_VARIANCE_SQL)
def budget_vs_actual(ledger: DataFrame) -> DataFrame:
    return structure.budget_variance(ledger.where(filters.months(YTD)), _budget(ledger), ["account_number"])


@query(f"""SELECT round(sum(actual), 2) AS actual, round(sum(budget), 2) AS budget, count(*) FILTER (status = 'favorable') AS n_favorable, count(*) FILTER (status = 'unfavorable') AS n_unfavorable,
  max_by(account_number, abs(variance)) FILTER (status = 'favorable') AS most_favorable, max_by(account_number, abs(variance)) FILTER (status = 'unfavorable') AS most_unfavorable FROM ({_VARIANCE_SQL})""")
def budget_report_totals(ledger: DataFrame) -> DataFrame:
    return structure.variance_totals(structure.budget_variance(ledger.where(filters.months(YTD)), _budget(ledger), ["account_number"]))


_DIMS = {"department": ["department_name"], "account": ["account_number"], "both": ["department_name", "account_number"]}
for _kind, _dims in _DIMS.items():
    _keys = ", ".join(_dims)

    def _budgets(ledger: DataFrame, dims: list[str] = _dims) -> DataFrame:
        return structure.budget_by(_budget(ledger), dims)

    def _actuals(ledger: DataFrame, dims: list[str] = _dims) -> DataFrame:
        return structure.actuals_by(ledger.where(filters.months(YTD)), dims)

    _budgets.__name__, _actuals.__name__ = f"budget_by_{_kind}", f"actuals_by_{_kind}"
    query(f"SELECT {_keys}, CAST(sum(budget_amount) AS DOUBLE) AS budget, max(account_name) AS label, count(*) AS n FROM {_BUDGET_SQL} GROUP BY ALL")(_budgets)
    query(f"SELECT {_keys}, {SUM} AS actual, max(account_name) AS label, count(*) AS n FROM ledger WHERE {_days(YTD)} GROUP BY ALL")(_actuals)


@query(f"SELECT count(*) FILTER (ok) AS n_within, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT CASE WHEN budget = 0 THEN actual = 0 ELSE abs((actual - budget) / budget) <= 0.25 END AS ok FROM ({_VARIANCE_SQL}))")
def budget_accuracy(ledger: DataFrame) -> DataFrame:
    report = structure.budget_variance(ledger.where(filters.months(YTD)), _budget(ledger), ["account_number"])
    return structure.accuracy(report, "budget", "actual", 0.25)


@query(f"""SELECT strftime(period_start, '%Y-%m') AS period, CAST(t AS DOUBLE) AS total, round(CAST(t - p AS DOUBLE), 2) AS delta, round(CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE CAST(t - p AS DOUBLE) / CAST(abs(p) AS DOUBLE) END, 6) AS delta_frac
  FROM (SELECT *, lag(t) OVER (ORDER BY period_start) AS p FROM (SELECT period_start, sum(amount) AS t FROM ledger GROUP BY 1))""")
def month_over_month(ledger: DataFrame) -> DataFrame:
    months = aggregate.by_period(ledger, "month").select("period", "total", F.lag("total").over(Window.orderBy("period")).alias("before"))  # a row per month
    delta, share = structure.change(F.col("total"), F.col("before"))
    return months.select("period", "total", F.round(delta, 2).alias("delta"), F.round(share, 6).alias("delta_frac"))


_MARGIN_SUMS = f"""SELECT department_name, CAST({case_sum("account_number LIKE '4%'")} AS DOUBLE) AS r, CAST({case_sum("account_number LIKE '51%'")} AS DOUBLE) AS c, CAST({case_sum("account_number LIKE '5%'")} AS DOUBLE) AS o, CAST({case_sum("account_number[1] IN ('6','7','8')")} AS DOUBLE) AS x FROM ledger GROUP BY 1"""


@query(f"SELECT department_name, round((r - c) / r, 6) AS gross_margin, round((r - o) / r, 6) AS operating_margin, round((r - o - x) / r, 6) AS net_margin FROM ({_MARGIN_SUMS})")
def margin_ratios(ledger: DataFrame) -> DataFrame:
    return structure.margins(ledger, ["department_name"])


# Customers' balances above 0 are assets, those below 0 liabilities; what suppliers owe stands for the inventory.
@query("""SELECT assets / liabilities AS current_ratio, (assets - inventory) / liabilities AS quick_ratio, CAST(1.0 AS DOUBLE) AS confidence FROM
  (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (c_acctbal > 0) AS DOUBLE) AS assets, CAST(-sum(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (c_acctbal < 0) AS DOUBLE) AS liabilities FROM customer),
  (SELECT CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) FILTER (s_acctbal > 0) AS DOUBLE) AS inventory FROM supplier)""", ledger=False)
def liquidity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    money = lambda c, p, a: F.coalesce(F.sum(F.when(p, F.col(c).cast("decimal(18,2)"))), F.lit(0)).cast("double").alias(a)
    owed = customer.agg(money("c_acctbal", F.col("c_acctbal") > 0, "assets"), money("c_acctbal", F.col("c_acctbal") < 0, "owing"))
    stock = supplier.agg(money("s_acctbal", F.col("s_acctbal") > 0, "inventory"))
    return owed.join(stock).select(*structure.liquidity(F.col("assets"), F.col("inventory"), -F.col("owing")))  # one row each


# Windows, top-k, sets.
@query(f"""SELECT *, round(CASE WHEN p IS NULL OR p = 0 THEN NULL ELSE (total - p) / abs(p) END, 6) AS yoy_frac FROM (SELECT *, lag(total, 4) OVER (ORDER BY fy, fq) AS p FROM
  (SELECT CAST({FY_SQL} AS INTEGER) AS fy, {FQ_SQL} AS fq, 'Q' || {FQ_SQL} || '''' || lpad(CAST({FY_SQL} % 100 AS VARCHAR), 2, '0') AS label, {SUM} AS total, count(*) AS n FROM ledger GROUP BY ALL))""".replace("SELECT *, round", "SELECT fy, fq, label, total, n, round", 1))
def yoy_by_quarter(ledger: DataFrame) -> DataFrame:
    return aggregate.with_yoy(aggregate.by_fiscal_quarter(ledger))


@query(f"SELECT period, total, n, round(sum(total) OVER (ORDER BY period), 2) AS running FROM (SELECT strftime(trandate, '%Y-%m') AS period, {SUM} AS total, count(*) AS n FROM ledger GROUP BY 1)")
def running_total(ledger: DataFrame) -> DataFrame:
    out = aggregate.with_running_total(aggregate.by_period(ledger, "month").drop("mean"), "total", ["period"])
    return out.withColumn("running", F.round("running", 2))


@query(f"SELECT period, total, round(sum(total) OVER (ORDER BY period ROWS 11 PRECEDING), 2) AS trailing FROM (SELECT strftime(trandate, '%Y-%m') AS period, {SUM} AS total FROM ledger GROUP BY 1)")
def trailing_twelve_months(ledger: DataFrame) -> DataFrame:
    out = aggregate.trailing(aggregate.by_period(ledger, "month").select("period", "total"), "total", "period", 12)
    return out.withColumn("trailing", F.round("trailing", 2))


@query(f"SELECT account_name, {SUM} AS total, count(*) AS n FROM ledger GROUP BY 1 ORDER BY abs(total) DESC, account_name LIMIT 10")
def top_categories(ledger: DataFrame) -> DataFrame:
    return aggregate.top(aggregate.group(ledger, ["account_name"]), 10, F.abs("total"), ties=["account_name"])


@query(f"SELECT department_name, {SUM} AS total, count(*) AS n FROM ledger GROUP BY 1 ORDER BY total, department_name LIMIT 3")
def bottom_departments(ledger: DataFrame) -> DataFrame:
    return aggregate.top(aggregate.group(ledger, ["department_name"]), 3, ascending=True, ties=["department_name"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, account_number, CAST(trandate AS VARCHAR) AS trandate, type, CAST(amount AS DOUBLE) AS amount FROM ledger ORDER BY ledger.trandate DESC, amount DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET 50")
def page_of_lines(ledger: DataFrame) -> DataFrame:
    out = ledger.orderBy(F.desc("trandate"), F.desc("amount"), "l_orderkey", "l_linenumber", "l_partkey").offset(50).limit(25)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "account_number", "trandate", "type", F.col("amount").cast("double").alias("amount"))


@query(f"SELECT account_number FROM ledger WHERE {_days(YTD)} UNION SELECT account_number FROM ledger WHERE {_days(LAST_YTD)}")
def union_of_keys(ledger: DataFrame) -> DataFrame:
    side = lambda p: ledger.where(filters.months(p)).select("account_number")
    return side(YTD).union(side(LAST_YTD)).distinct()


@query("SELECT 'amount' AS column, count(amount) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(min(amount) AS DOUBLE) AS low, CAST(max(amount) AS DOUBLE) AS high, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean FROM ledger")
def profile_numeric(ledger: DataFrame) -> DataFrame:
    return profile(ledger, "amount").withColumn("mean", F.col("total") / F.col("n"))


# Joins, tree.
_TREE_SQL = """nodes AS (SELECT DISTINCT account_number AS node, substr(account_number, 1, 2) AS parent FROM ledger
  UNION SELECT DISTINCT substr(account_number, 1, 2), substr(account_number, 1, 1) FROM ledger UNION SELECT DISTINCT substr(account_number, 1, 1), 'all' FROM ledger UNION SELECT 'all', NULL),
  up AS (SELECT node AS ancestor, node AS descendant, 0 AS depth FROM nodes UNION ALL SELECT n.parent, up.descendant, up.depth + 1 FROM up JOIN nodes n ON n.node = up.ancestor WHERE n.parent IS NOT NULL)"""


def _sums(ledger: DataFrame) -> DataFrame:
    """Sums per account, as few rows as the chart; written, for the tree and its facts come from the same pass."""
    return Scratch(ledger.sparkSession).table(ledger.groupBy("account_number").agg(F.sum("amount").alias("amount")), "sums")


def _nodes(accounts: DataFrame) -> DataFrame:
    pair = lambda a, b: accounts.select(a.alias("node"), b.alias("parent"))
    n, cut = F.col("account_number"), lambda k: F.substring("account_number", 1, k)
    out = pair(n, cut(2)).union(pair(cut(2), cut(1))).union(pair(cut(1), F.lit("all"))).union(accounts.select(F.lit("all"), F.lit(None).cast("string")))
    return out.distinct()


def _rec(sql: str) -> str:
    return f"WITH RECURSIVE {LEDGER_SQL}, {_TREE_SQL} {sql}"


@query()
def rollup_accounts(ledger: DataFrame) -> DataFrame:
    sums = _sums(ledger)
    return trees.rollup(sums, _nodes(sums))


ORACLE_SQL["rollup_accounts"] = _rec("SELECT ancestor AS node, CAST(coalesce(sum(CASE WHEN ancestor = descendant THEN s END), 0) AS DOUBLE) AS direct, CAST(coalesce(sum(s), 0) AS DOUBLE) AS rolled FROM up LEFT JOIN (SELECT account_number, sum(amount) AS s FROM ledger GROUP BY 1) f ON f.account_number = descendant GROUP BY 1")


@query()
def rollup_level_two(ledger: DataFrame) -> DataFrame:
    sums = _sums(ledger)
    nodes = _nodes(sums)
    return trees.rollup(sums, nodes).join(trees.depths(nodes).where("level = 2"), "node").select("node", "level", "rolled")


@query()
def account_closure(ledger: DataFrame) -> DataFrame:
    """Every account and group of the chart with all above it."""
    return trees.closure(_nodes(_sums(ledger)))


ORACLE_SQL["account_closure"] = _rec("SELECT ancestor, descendant, CAST(depth AS INTEGER) AS depth FROM up")


# Parts as a deep tree: part k hangs below part k / 2, as far as there are parts; its lines are what it adds.
@query("""WITH RECURSIVE q AS (SELECT l_partkey AS node, sum(CAST(l_quantity AS DECIMAL(18,4))) AS s FROM lineitem GROUP BY 1), n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
  up AS (SELECT node AS ancestor, node AS descendant FROM n UNION ALL SELECT n.parent, descendant FROM up JOIN n ON n.node = ancestor WHERE n.parent IS NOT NULL)
  SELECT ancestor AS node, CAST(coalesce(sum(CASE WHEN ancestor = descendant THEN s END), 0) AS DOUBLE) AS direct, CAST(coalesce(sum(s), 0) AS DOUBLE) AS rolled FROM up LEFT JOIN q ON q.node = descendant WHERE ancestor IN (SELECT node FROM n) GROUP BY 1""", ledger=False)
def rollup_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables(spark, sf_dir, "lineitem", "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return trees.rollup(line.select("l_partkey", F.col("l_quantity").cast("decimal(18,4)").alias("q")), nodes, "l_partkey", "q")


ORACLE_SQL["rollup_level_two"] = _rec("SELECT node, level, CAST(s AS DOUBLE) AS rolled FROM (SELECT descendant AS node, CAST(max(depth) AS INTEGER) AS level FROM up GROUP BY 1) JOIN (SELECT substr(account_number, 1, 2) AS p, sum(amount) AS s FROM ledger GROUP BY 1) ON p = node WHERE level = 2")


@query("SELECT o_orderkey, o_totalprice, c_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1997-07-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500", ledger=False)
def recent_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    out = orders.where(F.col("o_orderdate") >= F.lit(date(1997, 7, 1))).join(customer, orders.o_custkey == customer.c_custkey, "left")
    return out.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice", "c_name", F.col("o_orderdate").cast("date").alias("day"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, o_orderstatus, p_name, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= DATE '1999-06-15' AND l_shipdate < DATE '2000-06-16' ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 500""", ledger=False)
def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their header and account over the twelve months to ``AS_OF``, the latest 500."""
    line, orders, part = tables(spark, sf_dir, "lineitem", "orders", "part")
    recent = line.where((F.col("l_shipdate") >= F.lit(fiscal.add_months(AS_OF, -12))) & (F.col("l_shipdate") < F.lit(AS_OF + timedelta(days=1))))
    out = recent.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    day = F.col("l_shipdate").cast("date").alias("day")
    out = out.select("l_orderkey", "l_linenumber", "l_partkey", day, "o_orderstatus", "p_name", "l_extendedprice")
    return out.orderBy(F.desc("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").limit(500)


@query("SELECT account_number, max(account_name) AS account_name FROM ledger GROUP BY 1 ORDER BY 1 LIMIT 100")
def accounts_listed(ledger: DataFrame) -> DataFrame:
    return account_list(ledger)


@query(f"SELECT subsidiary, {SUM} AS total, count(DISTINCT account_number) AS accounts FROM ledger WHERE type = 'Journal' GROUP BY 1")
def sql_over_ledger(ledger: DataFrame) -> DataFrame:
    return sql_over(ledger, "SELECT subsidiary, CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT account_number) AS accounts FROM {ledger} WHERE type = 'Journal' GROUP BY subsidiary")


@query(f"SELECT d.name AS period, count(*) AS n, {SUM} AS total FROM ledger JOIN (VALUES ('H1', DATE '1999-02-01', DATE '1999-07-31'), ('Q2', DATE '1999-05-01', DATE '1999-07-31'), ('H2', DATE '1999-08-01', DATE '2000-01-31')) d(name, a, b) ON trandate BETWEEN d.a AND d.b GROUP BY 1")
def period_overlap_join(ledger: DataFrame) -> DataFrame:
    periods = [("H1", date(1999, 2, 1), date(1999, 7, 31)), ("Q2", date(1999, 5, 1), date(1999, 7, 31)), ("H2", date(1999, 8, 1), date(2000, 1, 31))]
    dim = ledger.sparkSession.createDataFrame(periods, "period string, a date, b date")
    days = ledger.groupBy("trandate").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    found = ranges.overlap_join(days, dim, ("trandate", "trandate"), ("a", "b"), width=1)
    return found.groupBy("period").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


# Months, quarters and years of the ledger's calendar as a table of periods that overlap.
_PERIODS = f"""p AS (SELECT DISTINCT {FY_SQL} AS fy, {FQ_SQL} AS fq, period_start AS m FROM ledger), periods AS (
  SELECT strftime(m, '%Y-%m') AS period, m AS a, last_day(m) AS b FROM p UNION ALL SELECT 'FY' || fy || ' Q' || fq, min(m), last_day(max(m)) FROM p GROUP BY fy, fq UNION ALL SELECT 'FY' || fy, min(m), last_day(max(m)) FROM p GROUP BY fy)"""


@query()
def period_table_join(ledger: DataFrame) -> DataFrame:
    """Every period that a day lies in: a range join of the ledger's days with a table of periods."""
    days = Scratch(ledger.sparkSession).table(ledger.groupBy("trandate", "period_start").agg(F.count("*").alias("n"), F.sum("amount").alias("s")), "days")
    d = F.col("trandate")
    months = days.select(fiscal.fy(d).cast("string").alias("fy"), fiscal.fq(d).cast("string").alias("fq"), F.col("period_start").alias("m")).distinct()
    part = lambda name, *by: months.groupBy(*by).agg(F.min("m").alias("a"), F.last_day(F.max("m")).alias("b")).select(name.alias("period"), "a", "b")
    periods = part(F.date_format("m", "yyyy-MM"), "m").union(part(F.concat(F.lit("FY"), "fy", F.lit(" Q"), "fq"), "fy", "fq")).union(part(F.concat(F.lit("FY"), "fy"), "fy"))
    found = ranges.overlap_join(days.select("trandate", "n", "s"), periods, ("trandate", "trandate"), ("a", "b"), width=8)
    return found.groupBy("period").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


ORACLE_SQL["period_table_join"] = f"WITH {LEDGER_SQL}, {_PERIODS} SELECT period, count(DISTINCT trandate) AS days, count(*) AS n, {SUM} AS total FROM ledger JOIN periods ON trandate BETWEEN a AND b GROUP BY 1"


_SESSIONS = """s AS (SELECT user_id, min(ts) AS started, max(ts) AS ended FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM
  (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k)"""


@query(f"WITH {_SESSIONS} SELECT a.user_id, count(*) AS pairs, count(DISTINCT b.user_id) AS others FROM s a JOIN s b ON a.started <= b.ended AND b.started <= a.ended AND a.user_id <> b.user_id GROUP BY 1", ledger=False)
def session_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's sessions run beside those of others: counted in blocks of users, without a row per pair."""
    one = Scratch(spark).table(events.sessions(tables(spark, sf_dir, "events")[0]).select("user_id", F.col("started"), F.col("last_event").alias("ended")), "sessions")
    return ranges.overlap_counts(one, "user_id", ("started", "ended"))


# A rule for every beginning, up to four characters long, of every third part's number.
@query("""WITH r AS (SELECT DISTINCT left(CAST(p_partkey AS VARCHAR), k) AS prefix FROM part, unnest([1, 2, 3, 4]) u(k) WHERE p_partkey % 3 = 0), p AS (SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n FROM lineitem GROUP BY 1),
  m AS (SELECT part, n, (SELECT max(length(prefix)) FROM r WHERE starts_with(part, prefix)) AS k FROM p)
  SELECT left(part, k) AS rule, sum(n)::BIGINT AS n, count(*) AS parts FROM m GROUP BY 1""", ledger=False)
def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the longest rule that their part's number begins with; null for none."""
    line, part = tables(spark, sf_dir, "lineitem", "part")
    number = F.col("p_partkey").cast("string")
    rules = part.where("p_partkey % 3 = 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(number), F.lit(4))), lambda k: F.left(number, k))).alias("prefix")).distinct()
    counted = line.groupBy(F.col("l_partkey").cast("string").alias("part")).agg(F.count("*").alias("n"))
    found = prefixes.longest_prefix(counted, rules.withColumn("rule", F.col("prefix")), "part")
    return found.groupBy("rule").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))


# The stored ledger.
def _stored(ledger: DataFrame) -> LedgerStore:
    store = LedgerStore(ledger.sparkSession).write(ledger)
    accounts = store.ledger().groupBy("account_number").agg(F.max("account_name").alias("title"))
    return store.write_accounts(accounts.withColumn("class", values.account_class(F.col("account_number"))))


@query(f"SELECT account_number, max(account_name) AS title, {SUM} AS total, count(*) AS n FROM ledger WHERE {_days(FY)} GROUP BY 1")
def store_fiscal_year(ledger: DataFrame) -> DataFrame:
    """A fiscal year by account: only its months are read, and accounts join without an exchange."""
    store = _stored(ledger)
    lines = store.with_accounts(store.ledger().where(filters.months(FY)))
    return lines.groupBy("account_number", "title").agg(aggregate.total().alias("total"), F.count("*").alias("n"))


# Late lines: credits of every seventh order, booked into two months that are there and one that is not.
_LATE = """SELECT * REPLACE (-amount AS amount, CASE WHEN month(trandate) = 3 THEN DATE '2030-01-01' ELSE period_start END AS period_start) FROM ledger WHERE l_orderkey % 7 = 0 AND period_start IN (DATE '1999-01-01', DATE '1999-02-01', DATE '1999-03-01')"""


@query(f"SELECT CAST(period_start AS VARCHAR) AS period_start, {SUM} AS total, count(*) AS n FROM (SELECT * FROM ledger UNION ALL {_LATE}) GROUP BY 1")
def store_late_lines(ledger: DataFrame) -> DataFrame:
    store = LedgerStore(ledger.sparkSession).write(ledger)
    late = store.ledger().where((F.col("l_orderkey") % 7 == 0) & F.col("period_start").isin(*(date(1999, m, 1) for m in (1, 2, 3))))
    moved = F.when(F.month("trandate") == 3, F.lit(date(2030, 1, 1))).otherwise(F.col("period_start"))
    store.add(late.withColumns({"amount": (-F.col("amount")).cast("decimal(18,4)"), "period_start": moved}))
    return store.ledger().groupBy("period_start").agg(aggregate.total().alias("total"), F.count("*").alias("n"))


# Series.
_MONTHLY = f"SELECT type AS series, last_day(trandate) AS month, {SUM} AS value FROM ledger GROUP BY 1, 2 HAVING value <> 0"


@query(f"SELECT series, CAST(month AS VARCHAR) AS month, value FROM ({_MONTHLY})")
def series_monthly(ledger: DataFrame) -> DataFrame:
    return series.monthly(ledger, "type")


_DENSE = f"""m AS ({_MONTHLY}), g AS (SELECT series, unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS d FROM m GROUP BY 1),
  dense AS (SELECT g.series, last_day(CAST(g.d AS DATE)) AS month, CAST(row_number() OVER (PARTITION BY g.series ORDER BY g.d) - 1 AS INTEGER) AS pos, coalesce(value, 0) AS value FROM g LEFT JOIN m ON m.series = g.series AND m.month = last_day(CAST(g.d AS DATE)))"""


@query()
def series_dense(ledger: DataFrame) -> DataFrame:
    return series.dense(series.monthly(ledger, "type"))


ORACLE_SQL["series_dense"] = f"WITH {LEDGER_SQL}, {_DENSE} SELECT series, CAST(month AS VARCHAR) AS month, pos, value FROM dense"


@query()
def series_decompose(ledger: DataFrame) -> DataFrame:
    return series.decompose(series.dense(series.monthly(ledger, "type"))).select("series", "pos", F.round("trend", 2).alias("trend"), F.round("seasonal", 2).alias("seasonal"), F.round("residual", 2).alias("residual"))


_DECOMPOSED = f"""WITH {LEDGER_SQL}, {_DENSE},
  c AS (SELECT *, CASE WHEN count(value) OVER w = 12 THEN avg(value) OVER w END AS t FROM dense WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
  f AS (SELECT *, coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(t IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS trend FROM c),
  s AS (SELECT *, avg(value - trend) OVER (PARTITION BY series, pos % 12) AS sm FROM f),
  z AS (SELECT series, avg(sm) AS centre FROM (SELECT DISTINCT series, pos % 12 AS k, round(sm, 8) AS sm FROM s) GROUP BY 1)
"""
ORACLE_SQL["series_decompose"] = _DECOMPOSED + "SELECT series, pos, round(trend, 2) AS trend, round(sm - centre, 2) AS seasonal, round(value - trend - (sm - centre), 2) AS residual FROM s JOIN z USING (series)"
ORACLE_SQL["series_seasonality_strength"] = _DECOMPOSED + """SELECT series, k AS strength, CASE WHEN k >= 0.7 THEN 'strong' WHEN k >= 0.4 THEN 'moderate' WHEN k >= 0.2 THEN 'weak' ELSE 'none' END AS grade FROM
  (SELECT series, round(coalesce(var_pop(sm - centre) / nullif(var_pop(sm - centre) + var_pop(value - trend - (sm - centre)), 0), 0), 4) AS k FROM s JOIN z USING (series) GROUP BY 1)"""
ORACLE_SQL["series_adjusted"] = _DECOMPOSED + "SELECT series, pos, value, round(value - (sm - centre), 2) AS adjusted FROM s JOIN z USING (series)"


@query()
def series_adjusted(ledger: DataFrame) -> DataFrame:
    return series.seasonally_adjusted(series.dense(series.monthly(ledger, "type"))).select("series", "pos", "value", F.round("adjusted", 2).alias("adjusted"))


@query()
def series_seasonality_strength(ledger: DataFrame) -> DataFrame:
    return series.seasonality_strength(series.decompose(series.dense(series.monthly(ledger, "type"))))


@query(f"WITH m AS ({_MONTHLY}) SELECT a.series AS a, b.series AS b, round(corr(a.value, b.value), 6) AS r, count(*) AS n FROM m a JOIN m b ON a.month = b.month AND a.series < b.series GROUP BY 1, 2".replace("WITH m", ", m", 1))
def correlation_matrix(ledger: DataFrame) -> DataFrame:
    return series.correlation_matrix(series.monthly(ledger, "type"))


_PARTS = f"x AS (SELECT last_day(trandate) AS month, {SUM} AS y FROM ledger WHERE account_number LIKE '4%' GROUP BY 1), e AS (SELECT account_name AS series, last_day(trandate) AS month, {SUM} AS x FROM ledger WHERE account_number LIKE '5%' GROUP BY 1, 2)"


@query()
def correlation_spearman(ledger: DataFrame) -> DataFrame:
    return series.correlate(_with_revenue(ledger), ["series"], "spearman")


ORACLE_SQL["correlation_spearman"] = f"""WITH {LEDGER_SQL}, {_PARTS}, j AS (SELECT series, x, y FROM e JOIN x USING (month)), k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM j)
  SELECT series, round(corr(rx, ry), 6) AS r, count(*) AS n FROM k GROUP BY 1"""


@query()
def correlation_kendall(ledger: DataFrame) -> DataFrame:
    return series.correlate(_with_revenue(ledger), ["series"], "kendall")


ORACLE_SQL["correlation_kendall"] = f"""WITH {LEDGER_SQL}, {_PARTS}, j AS (SELECT series, x, y FROM e JOIN x USING (month))
  SELECT a.series, round(coalesce(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x)))) * sqrt(sum(abs(sign(a.y - b.y)))), 0), 0), 6) AS r, CAST(sqrt(count(*)) AS BIGINT) AS n FROM j a JOIN j b ON a.series = b.series GROUP BY 1"""


def _lines_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and discount of every line, by the first digit of its part: thousands of rows with many ties."""
    (line,) = tables(spark, sf_dir, "lineitem")
    return line.select((F.col("l_partkey") % 5).alias("part"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))


@query("""WITH c AS (SELECT l_partkey % 5 AS part, l_quantity AS x, l_discount AS y, count(*) AS k FROM lineitem GROUP BY 1, 2, 3)
  SELECT a.part, round(sum(a.k * b.k * sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(sum(a.k * b.k * abs(sign(a.x - b.x)))) * sqrt(sum(a.k * b.k * abs(sign(a.y - b.y))))), 6) AS r, CAST(round(sqrt(sum(a.k * b.k))) AS BIGINT) AS n FROM c a JOIN c b ON a.part = b.part GROUP BY 1""", ledger=False)
def kendall_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlate(_lines_by_part(spark, sf_dir), ["part"], "kendall")


def _with_revenue(ledger: DataFrame) -> DataFrame:
    return analysis.with_revenue(analysis.kept(analysis.driver_series(ledger.where(structure.prefix("4", "5")))))


@query()
def revenue_drivers(ledger: DataFrame) -> DataFrame:
    return analysis.drivers(analysis.kept(analysis.driver_series(ledger)))


@query()
def revenue_analysis(ledger: DataFrame) -> DataFrame:
    return analysis.revenue_analysis(ledger, 5)


# Drivers without seasonal adjustment, ranked: the lags, r and n of every cost series over dense months.
def _drivers_sql(where: str, tail: str) -> str:
    m = f"SELECT CASE WHEN account_number LIKE '4%' THEN 'revenue' ELSE account_name END AS series, last_day(trandate) AS month, {SUM} AS value FROM ledger WHERE account_number[1] IN ('4','5','6','7','8') AND {where} GROUP BY 1, 2 HAVING value <> 0"
    return f"""WITH {LEDGER_SQL}, {_DENSE.replace(_MONTHLY, m)},
  l AS (SELECT d.series, k.lag, d.value AS x, r.value AS y FROM dense d CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) k JOIN dense r ON r.series = 'revenue' AND r.month = last_day(CAST(date_trunc('month', d.month) - to_months(CAST(k.lag AS INTEGER)) AS DATE)) WHERE d.series <> 'revenue'),
  c AS (SELECT series, CAST(lag AS INTEGER) AS expense_lag_after_revenue, round(coalesce(CASE WHEN isnan(corr(x, y)) THEN 0 ELSE corr(x, y) END, 0), 6) AS r, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 3),
  best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, expense_lag_after_revenue) = 1) {tail}"""


@query()
def drivers_ranked(ledger: DataFrame) -> DataFrame:
    found = analysis.drivers(analysis.kept(analysis.driver_series(ledger)), adjust=False)
    return series.ranked_drivers(found, 5).select("series", "expense_lag_after_revenue", "r", "n", "direction", "rank")


ORACLE_SQL["drivers_ranked"] = _drivers_sql("TRUE", "SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY abs(r) DESC, series) AS INTEGER) AS rank FROM (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM best WHERE r <> 0) QUALIFY rank <= 5")


@query()
def regression_simple(ledger: DataFrame) -> DataFrame:
    return series.regression(_with_revenue(ledger), ["series"]).select("series", "slope", F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


ORACLE_SQL["regression_simple"] = f"WITH {LEDGER_SQL}, {_PARTS} SELECT series, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM e JOIN x USING (month) GROUP BY 1"


@query()
def regression_inference(ledger: DataFrame) -> DataFrame:
    return volatility.with_inference(series.regression(_with_revenue(ledger), ["series"]))


@query()
def regression_seasonal(ledger: DataFrame) -> DataFrame:
    pairs = _with_revenue(ledger).withColumn("slot", F.month("month"))
    return series.seasonal_regression(pairs, ["series"], "slot").select("series", "slope", "r2", "adjusted_r2", "n")


ORACLE_SQL["regression_seasonal"] = f"""WITH {LEDGER_SQL}, {_PARTS}, j AS (SELECT series, y AS whole, month(month) AS slot, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM e JOIN x USING (month) WINDOW w AS (PARTITION BY series, month(month))),
  f AS (SELECT series, regr_slope(dy, dx) AS b, 1 - (regr_syy(dy, dx) - regr_sxy(dy, dx) ** 2 / regr_sxx(dy, dx)) / (var_pop(whole) * count(*)) AS r2, count(*) AS n, count(DISTINCT slot) AS k FROM j GROUP BY 1)
  SELECT series, round(b, 6) AS slope, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k - 1), 6) AS adjusted_r2, n FROM f WHERE n > k + 1"""


@query()
def series_trend(ledger: DataFrame) -> DataFrame:
    out = series.trend(series.dense(series.monthly(ledger, "type")))
    return out.select("series", F.round("slope", 4).alias("slope"), "r2", "low", "high", "strength", "n")


ORACLE_SQL["series_trend"] = f"WITH {LEDGER_SQL}, {_DENSE} SELECT series, round(b, 4) AS slope, r2, low, high, CASE WHEN r2 >= 0.7 THEN 'strong' WHEN r2 >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength, n FROM (SELECT series, regr_slope(value, pos) AS b, round(regr_r2(value, pos), 6) AS r2, min(value) AS low, max(value) AS high, count(*) AS n FROM dense GROUP BY 1)"


@query()
def arch_effects(ledger: DataFrame) -> DataFrame:
    return volatility.arch_effects(series.monthly(ledger, "type"))


def _arch_sql(lags: int = 5) -> str:
    """LM and F by making each lag orthogonal to those before it, one after the other."""
    ks = range(1, lags + 1)
    steps = [f"e AS (SELECT type AS series, month, n, v AS y FROM (SELECT series AS type, month, count(*) OVER w AS n, power(value - avg(value) OVER w, 2) AS v FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY series)) WHERE n >= {lags + 10})"]
    steps.append("g AS (SELECT series, n, y, " + ", ".join(f"lag(y, {k}) OVER w AS x{k}" for k in ks) + " FROM e WINDOW w AS (PARTITION BY series ORDER BY month))")
    steps.append(f"o0 AS (SELECT series, n, y - avg(y) OVER w AS y, " + ", ".join(f"x{k} - avg(x{k}) OVER w AS x{k}" for k in ks) + f", y - avg(y) OVER w AS whole FROM g WHERE x{lags} IS NOT NULL WINDOW w AS (PARTITION BY series))")
    for k in ks:  # what the k-th lag explains is taken from all later lags and from y
        take = lambda c, k=k: f"{c} - x{k} * (sum({c} * x{k}) OVER w / sum(x{k} * x{k}) OVER w) AS {c}"
        steps.append(f"o{k} AS (SELECT series, n, whole, {', '.join([take('y'), *(take(f'x{j}') for j in range(k + 1, lags + 1))])} FROM o{k - 1} WINDOW w AS (PARTITION BY series))")
    return f"WITH {LEDGER_SQL}, {', '.join(steps)} SELECT series, round(m * r2, 6) AS lm, round((r2 / {lags}) / ((1 - r2) / (m - {lags + 1})), 6) AS f, n FROM (SELECT series, max(n) AS n, count(*) AS m, 1 - sum(y * y) / sum(whole * whole) AS r2 FROM o{lags} GROUP BY 1)"


@query()
def arch_statistics(ledger: DataFrame) -> DataFrame:
    return volatility.arch_effects(series.monthly(ledger, "type")).select("series", "lm", "f", "n")


ORACLE_SQL["arch_statistics"] = _arch_sql()


@query()
def garch_forecast(ledger: DataFrame) -> DataFrame:
    return volatility.forecast(volatility.fit(series.monthly(ledger, "type")), 6)


# Catalogue and questions.
@query("""SELECT kind, name, count(*) AS n_rows FROM (SELECT unnest([{'kind': 'department', 'name': department_name}, {'kind': 'account', 'name': account_name}, {'kind': 'account_number', 'name': account_number}, {'kind': 'subsidiary', 'name': subsidiary}, {'kind': 'transaction_type', 'name': type}], recursive := true) FROM ledger) GROUP BY 1, 2""")
def registry_counts(ledger: DataFrame) -> DataFrame:
    return registry.build(ledger).select("kind", "name", "n_rows")


@query("SELECT 'department' AS kind, department_name AS name, CAST(1.0 AS DOUBLE) AS score, count(*) AS n_rows FROM ledger WHERE split_part(department_name, ' : ', 2) = 'NATION_3' GROUP BY 2")
def registry_lookup(ledger: DataFrame) -> DataFrame:
    return registry.lookup(registry.build(ledger), "nation_3").where("score >= 0.5")


_ASKED = ["Operating Expenses", "r&d", "invoices", "nation_3", "brand#12", "unheard of"]


@query("""SELECT term, choice, kind, value FROM (VALUES ('operating expenses', NULL, 'account_prefix', '5'), ('invoices', NULL, 'type', 'CustInvc'), ('unheard of', NULL, NULL, NULL),
    ('r&d', 'research and development accounts (52)', 'account_prefix', '52'), ('r&d', 'accounts named R&D', 'account_name', 'r&d'), ('r&d', 'both', 'account_prefix', '52'), ('r&d', 'both', 'account_name', 'r&d')) t(term, choice, kind, value)
  UNION ALL SELECT DISTINCT 'nation_3', NULL, 'department', department_name FROM ledger WHERE split_part(department_name, ' : ', 2) = 'NATION_3'
  UNION ALL SELECT DISTINCT 'brand#12', NULL, 'account', account_name FROM ledger WHERE lower(split_part(account_name, ' : ', 2)) = 'brand#12'""")
def resolve_terms(ledger: DataFrame) -> DataFrame:
    asked = ledger.sparkSession.createDataFrame([(x,) for x in _ASKED], "term string")
    return semantics.resolve(asked, registry.build(ledger))


# Questions in structured form; the period of the sample ledger follows from the date.
def _question(name: str, spec: QuerySpec, sql: str) -> None:
    f = lambda ledger: compiler.compile_spec(ledger, spec)
    f.__name__ = name
    query(sql if not sql.startswith("WITH") else None)(f)
    if sql.startswith("WITH"):
        ORACLE_SQL[name] = sql


_NATION_3 = "split_part(department_name, ' : ', 2) = 'NATION_3'"
_question("ask_total", QuerySpec(Intent.TOTAL, FY, prefixes=("5",)), f"SELECT coalesce({SUM}, 0) AS total, count(*) AS n FROM ledger WHERE {_days(FY)} AND {OPEX}")
_question("ask_top", QuerySpec(Intent.TOP_N, FY, group_by=("account_name",), top_n=5), f"SELECT account_name, {SUM} AS total, count(*) AS n FROM ledger WHERE {_days(FY)} GROUP BY 1 ORDER BY abs(total) DESC, account_name LIMIT 5")
_question("ask_compare", QuerySpec(Intent.COMPARISON, YTD, departments=("Nation_3", "Nation_8"), prefixes=("5",), compare_departments=True), f"SELECT department_name, {SUM} AS total, count(*) AS n FROM ledger WHERE {_days(YTD)} AND {OPEX} AND split_part(department_name, ' : ', 2) IN ('NATION_3', 'NATION_8') GROUP BY 1")
_question("ask_yoy", QuerySpec(Intent.VARIANCE, YTD, comparison="yoy", comparison_period=LAST_YTD, prefixes=("4",), group_by=("department_name",)), compare_sql("department_name", "account_number LIKE '4%'"))
_question("ask_trend", QuerySpec(Intent.TREND, FY, prefixes=("53",)), f"SELECT strftime(trandate, '%Y-%m') AS period, {SUM} AS total, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean FROM ledger WHERE {_days(FY)} AND account_number LIKE '53%' GROUP BY 1")
_TWO = "split_part(department_name, ' : ', 2) IN ('NATION_3', 'NATION_8')"
_TWO_SUMS = _MARGIN_SUMS.replace("FROM ledger", f"FROM ledger WHERE {_days(FY)} AND {_TWO}")
_question("ask_ratio", QuerySpec(Intent.RATIO, FY, departments=("Nation_3", "Nation_8"), group_by=("department_name",)), f"SELECT department_name, round((r - c) / r, 6) AS gross_margin, round((r - o) / r, 6) AS operating_margin, round((r - o - x) / r, 6) AS net_margin FROM ({_TWO_SUMS})")
_question("ask_breakdown", QuerySpec(Intent.BREAKDOWN, FY, prefixes=("5",), group_by=("subsidiary",)), f"SELECT subsidiary, CAST(s AS DOUBLE) AS total, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 6) AS share_frac FROM (SELECT subsidiary, sum(amount) AS s FROM ledger WHERE {_days(FY)} AND {OPEX} GROUP BY 1)")
_question("ask_excluding", QuerySpec(Intent.TOTAL, FY, prefixes=("5",), not_departments=("Nation_3",), not_accounts=("brand#2",), group_by=("type",)), f"SELECT type, {SUM} AS total, count(*) AS n FROM ledger WHERE {_days(FY)} AND {OPEX} AND NOT {_NATION_3} AND lower(account_name) NOT LIKE '%brand#2%' GROUP BY 1")
_question("ask_regression", QuerySpec(Intent.REGRESSION, departments=("Nation_3",), types=("Journal",)), f"""WITH {LEDGER_SQL}, {_PARTS.replace("WHERE account_number LIKE '4%'", f"WHERE {_NATION_3} AND type = 'Journal' AND account_number LIKE '4%'").replace("WHERE account_number LIKE '5%'", f"WHERE {_NATION_3} AND type = 'Journal' AND account_number[1] IN ('5','6','7','8')")},
  j AS (SELECT series, x, y FROM e JOIN x USING (month)), f AS (SELECT series, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, greatest(regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x), 0) AS sse, regr_syy(y, x) AS syy, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM j GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) > 0)
  SELECT series, round(b, 6) AS slope, round(my - b * mx, 6) AS intercept, round(sqrt(sse / (n - 2) / sxx), 6) AS slope_error, round(b / sqrt(sse / (n - 2) / sxx), 6) AS t_value, round(1 - sse / syy, 6) AS r2, round(1 - sse / syy * (n - 1) / (n - 2), 6) AS adjusted_r2, n FROM f""")


@query()
def ask_correlation(ledger: DataFrame) -> DataFrame:
    """Of one department's costs in one fiscal year: too short for seasons, so r and lag are those of the plain months."""
    out = compiler.compile_spec(ledger, QuerySpec(Intent.CORRELATION, FY, departments=("Nation_3",)))
    return out.select("series", "expense_lag_after_revenue", "r", "n")


ORACLE_SQL["ask_correlation"] = _drivers_sql(f"{_days(FY)} AND {_NATION_3}", "SELECT * FROM best")


# Streams, as tables.
@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", ledger=False)
def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily(tables(spark, sf_dir, "events")[0])


_TRACED = "(SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'fail' ELSE 'success' END AS status, value FROM events)"


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: their value stands for duration and cost."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "fail").otherwise("success")
    return tables(spark, sf_dir, "events")[0].select(F.col("ts").alias("start_time"), status.alias("status"), F.col("value").alias("duration_ms"), F.struct(F.col("value").alias("cost"), F.length("event_type").cast("long").alias("total_tokens")).alias("metrics"))


for _by in ([], ["status"], ["day"], ["day", "status"]):

    def _stats(spark: SparkSession, sf_dir: str, by: list[str] = _by) -> DataFrame:
        return events.trace_stats(_traces(spark, sf_dir), *by).drop("mean_tokens")

    _stats.__name__ = "_".join(["trace_stats", *_by])
    _keys = "".join(f"CAST({c} AS VARCHAR) AS {c}, " for c in _by)
    query(f"SELECT {_keys}count(*) AS n, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(sum(value), 6) AS cost, round(avg(value), 6) AS mean_ms FROM {_TRACED} GROUP BY ALL", ledger=False)(_stats)


@query(f"SELECT count(*) AS n, count(*) FILTER (status = 'success') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'success') / count(*), 6) AS pass_rate FROM {_TRACED}", ledger=False)
def suite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.suite_stats(_traces(spark, sf_dir).withColumn("status", F.regexp_replace("status", "success", "PASS")))


@query("""SELECT user_id, min(ts) AS started, max(ts) AS last_event, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""", ledger=False)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(tables(spark, sf_dir, "events")[0])


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3", ledger=False)
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.last_turns(tables(spark, sf_dir, "conversations")[0], 3)


@query(ledger=False)
def synthetic_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic ledger with a row for each line of the tables."""
    return aggregate.group(canonical(synthetic_ledger(spark, tables(spark, sf_dir, "lineitem")[0].count())), ["account_number"])


for _name, _sql in ORACLE_SQL.items():
    ORACLE_SQL[_name] = _sql.replace(") , m AS", "), m AS")

from . import catalogue_queries  # noqa: E402, F401  (registers its queries with these)
