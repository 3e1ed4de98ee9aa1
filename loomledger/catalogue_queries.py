"""Further queries over the driver's tables, and their SQL: names and terms, sketches, dimensions, charts, sets.

``queries`` registers them with its own.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fiscal, values
from .operators import aggregate, filters, registry, series, sketches, structure, volatility
from .plans import semantics, spotting
from .queries import _MONTHLY, _PARTS, _TYPES, FQ_SQL, FY, FY_SQL, ORACLE_SQL, SUM, _days, _with_revenue, query
from .sources.ledger import LEDGER_SQL, sample_ledger, tables
from .sources.scratch import Scratch
from .streaming import upserts

_KINDS = {"department": "department_name", "account": "account_name", "account_number": "account_number", "subsidiary": "subsidiary", "transaction_type": "type"}


def _aliases_sql() -> str:
    """``names(kind, name, n_rows, canon, child, alias)``: the catalogue with every alias, in SQL."""
    short = ", ".join(f"CASE WHEN contains(low, '{name}') THEN [{', '.join(repr(x) for x in words)}] ELSE [] END" for name, words in values.ABBREVIATIONS.items())
    rows = ", ".join(f"{{'kind': '{k}', 'name': {c}}}" for k, c in _KINDS.items())
    return rf"""n0 AS (SELECT kind, name, count(*) AS n_rows, lower(trim(name)) AS low FROM (SELECT unnest([{rows}], recursive := true) FROM ledger) GROUP BY 1, 2),
  n1 AS (SELECT *, trim(regexp_replace(regexp_replace(low, '\s*\(parent\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS clean, regexp_split_to_array(low, ' : | - | / |, | – ') AS parts FROM n0),
  n2 AS (SELECT *, list_transform(parts, lambda p: trim(regexp_replace(p, '\s*\(parent\)\s*', '', 'g'))) AS bare, regexp_extract_all(clean, '\b([a-z]+)\b', 1) AS ws FROM n1),
  n3 AS (SELECT *, array_to_string(list_transform(ws, lambda w: w[1:1]), '') AS acronym FROM n2),
  names AS (SELECT kind, name, n_rows, lower(name) AS canon, trim(string_split(lower(name), ' : ')[-1]) AS child, flatten([[low, clean], list_filter(list_transform(parts, lambda p: trim(p)), lambda p: length(p) > 1), list_filter(bare, lambda p: length(p) > 1),
    CASE WHEN len(bare) = 2 THEN [array_to_string(bare, ' ')] ELSE [] END, CASE WHEN contains(low, '&') THEN [replace(low, '&', ' and '), replace(replace(low, '&', ''), '  ', ' '), replace(low, ' & ', '')] ELSE [] END,
    CASE WHEN len(ws) >= 2 AND length(acronym) BETWEEN 2 AND 6 THEN [acronym] ELSE [] END, {short}]) AS alias FROM n3)"""


def _tokens_sql(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[,&()\-/]', ' ', 'g'), '\s+'), lambda w: w <> ''))"


# The ladder of scores: exact, alias, last segment, its words, all words, some words, substrings of names and of aliases.
_SCORE_SQL = """CASE WHEN q = canon THEN 1.0 WHEN list_contains(alias, q) AND NOT (nested AND q = child) THEN 0.95 WHEN nested AND q = child THEN 1.0
  WHEN nested AND n > 0 AND list_has_all(cw, qw) THEN greatest(0.85, least(0.94, 0.85 + n / len(cw) * 0.09))
  WHEN n > 1 AND hits = n THEN greatest(0.6, least(0.84, 0.5 + n / len(aw) * 0.34)) WHEN n > 1 THEN CASE WHEN hits > 0 THEN 0.3 ELSE 0.0 END
  WHEN contains(canon, q) THEN CASE WHEN length(q) >= 5 THEN greatest(0.6, least(0.8, length(q) / length(canon) + 0.35)) ELSE greatest(0.5, least(0.7, length(q) / length(canon) + 0.2)) END
  WHEN contains(q, canon) THEN 0.35
  ELSE coalesce(list_max(list_transform(alias, lambda a: CASE WHEN contains(a, q) THEN greatest(0.35, least(0.6, length(q) / length(a) + 0.1)) WHEN contains(q, a) THEN 0.3 ELSE 0.0 END)), 0.0) END"""


def _scores_sql(terms: str, least: float) -> str:
    return f"""WITH {LEDGER_SQL}, {_aliases_sql()}, asked AS (SELECT DISTINCT term, lower(trim(term)) AS q FROM ({terms}) WHERE trim(term) <> ''),
      b AS (SELECT *, contains(canon, ' : ') AS nested, {_tokens_sql("q")} AS qw, {_tokens_sql("child")} AS cw, {_tokens_sql("canon")} AS aw FROM asked CROSS JOIN names),
      c AS (SELECT *, len(qw) AS n, len(list_intersect(qw, aw)) AS hits FROM b)
      SELECT * FROM (SELECT term, kind, name, n_rows, round(CAST({_SCORE_SQL} AS DOUBLE), 4) AS score FROM c) WHERE score >= {least}"""


# Terms as people misspell and shorten the names of departments, accounts and segments.
_TERMS_SQL = """SELECT unnest([n_name, left(n_name, length(n_name) - 1), substr(n_name, 3), 'the ' || lower(n_name), n_name || 's', ' ' || n_name || ' ']) AS term FROM nation
  UNION SELECT unnest([r_name, r_name || ' nation_1', left(r_name, 2)]) FROM region UNION SELECT unnest([p_brand, substr(p_brand, 2), 'sales ' || p_brand, 'r&d ' || p_brand, p_brand || ' costs of sales']) FROM part
  UNION SELECT unnest([left(c_mktsegment, 5), c_mktsegment || ' group']) FROM customer UNION SELECT unnest(['&', 'g', 'no such thing', 'cogs', ' '])"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, part, customer = tables(spark, sf_dir, "nation", "region", "part", "customer")
    say = lambda df, *c: df.select(F.explode(F.array(*c)).alias("term"))
    n, r, p, m, text = F.col("n_name"), F.col("r_name"), F.col("p_brand"), F.col("c_mktsegment"), F.lit
    found = say(nation, n, F.left(n, F.length(n) - 1), F.substring(n, 3, 100), F.concat(text("the "), F.lower(n)), F.concat(n, text("s")), F.concat(text(" "), n, text(" ")))
    found = found.union(say(region, r, F.concat(r, text(" nation_1")), F.left(r, text(2))))
    found = found.union(say(part, p, F.substring(p, 2, 100), F.concat(text("sales "), p), F.concat(text("r&d "), p), F.concat(p, text(" costs of sales"))))
    return found.union(say(customer, F.left(m, text(5)), F.concat(m, text(" group")))).union(say(spark.range(1), *map(text, ("&", "g", "no such thing", "cogs", " ")))).distinct()


for _name, _least in {"registry_scores": 0.3, "registry_close": 0.6}.items():

    def _scored(spark: SparkSession, sf_dir: str, least: float = _least) -> DataFrame:
        return registry.lookup_all(registry.build(sample_ledger(spark, sf_dir)), _terms(spark, sf_dir), least)

    _scored.__name__ = _name
    query(_scores_sql(_TERMS_SQL, _least), ledger=False)(_scored)


# Terms in texts: the first two and the first four words of every text, and the dictionary's terms, looked for in all texts.
_EDGES_SQL = spotting.EDGES.replace("'", "''")
_WORDS_SQL = rf"list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '{_EDGES_SQL}', '', 'g')), lambda w: w <> '')"
_DICTIONARY_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in semantics.TERMS)


@query(f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, conv_id, {_WORDS_SQL} AS ws FROM conversations WHERE text IS NOT NULL),
  t AS (SELECT min(term) AS term, said FROM (SELECT term, {_WORDS_SQL.replace("lower(text)", "lower(term)")} AS said FROM (SELECT DISTINCT array_to_string(ws[1:k], ' ') AS term FROM w, unnest([2, 4]) u(k) UNION SELECT unnest([{_DICTIONARY_SQL}]))) WHERE len(said) > 0 GROUP BY said),
  f AS (SELECT id, conv_id, term, len(said) AS n, p - 1 AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM w) x JOIN t ON x.ws[p] = t.said[1] AND x.ws[p:p + len(said) - 1] = said),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS k FROM f),
  g AS (SELECT id, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT, term VARCHAR, conv_id BIGINT)[] AS taken FROM w UNION ALL
    SELECT g.id, r.k, CASE WHEN len(list_filter(g.taken, lambda y: y.a < r.pos + r.n AND r.pos < y.b)) = 0 THEN list_append(g.taken, {{'a': r.pos, 'b': r.pos + r.n, 'term': r.term, 'conv_id': r.conv_id}}) ELSE g.taken END FROM g JOIN r ON r.id = g.id AND r.k = g.k + 1),
  done AS (SELECT id, arg_max(taken, k) AS taken FROM g GROUP BY 1)
  SELECT x.term AS term, count(*) AS n, count(DISTINCT x.conv_id) AS conversations FROM (SELECT unnest(taken) AS x FROM done) GROUP BY 1""", ledger=False)
def terms_in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term occurs where no longer one covers it, and in how many conversations."""
    (talk,) = tables(spark, sf_dir, "conversations")
    said = spotting.words(F.col("text"))
    openings = talk.select(said.alias("said")).select(F.explode(F.array(*(F.array_join(F.slice("said", 1, k), " ") for k in (2, 4)))).alias("term"))
    terms = openings.union(semantics.dictionary(spark).select("term")).distinct()
    found = spotting.spot(talk.select("conv_id", "turn", "text"), terms)
    return found.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


# Sketches by day, one half of them made first and the other when it comes.
_SKETCHED = (["account_number", "l_orderkey"], ["amount"])


@query(f"SELECT fy, n, true AS distinct_ok, true AS quantiles_ok, true AS refreshed FROM (SELECT CAST({FY_SQL} AS INTEGER) AS fy, count(*) AS n FROM ledger GROUP BY 1)")
def sketched_years(ledger: DataFrame) -> DataFrame:
    """Per fiscal year, whether estimates merged from daily sketches are within their bounds: 4 % of the distinct values, 2 % of the rank."""
    scratch = Scratch(ledger.sparkSession)
    rows = scratch.table(ledger.select("trandate", "account_number", "l_orderkey", F.col("amount").cast("double").alias("amount")), "rows")
    half = scratch.table(sketches.daily(rows.where(F.dayofmonth("trandate") <= 15), "trandate", *_SKETCHED), "half")
    days = scratch.table(sketches.refresh(half, rows, "trandate", *_SKETCHED), "days")
    year = lambda c: fiscal.fy(F.col(c)).cast("int").alias("fy")
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}"))
    middle = F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("quantiles_amount"), F.lit(0.5))
    merged = days.select(year("day"), "*").groupBy("fy").agg(F.sum("n").alias("n"), estimate("l_orderkey").alias("orders"), estimate("account_number").alias("accounts"), middle.alias("middle"))
    exact = rows.select(year("trandate"), "*").join(merged.select("fy", "middle"), "fy").groupBy("fy")
    # How much lies under the estimated middle, and up to it: the true rank is in between.
    share = lambda c: F.avg(c.cast("double"))
    exact = exact.agg(F.countDistinct("l_orderkey").alias("o"), F.countDistinct("account_number").alias("a"), share(F.col("amount") < F.col("middle")).alias("under"), share(F.col("amount") <= F.col("middle")).alias("upto"))
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= F.greatest(0.04 * F.col(y), F.lit(2))
    whole = rows.agg(F.countDistinct("trandate").alias("w")).crossJoin(days.agg(F.count("*").alias("d")))  # one row each
    checks = [(near("orders", "o") & near("accounts", "a")).alias("distinct_ok"), ((F.col("under") <= 0.52) & (F.col("upto") >= 0.48)).alias("quantiles_ok"), (F.col("w") == F.col("d")).alias("refreshed")]
    return merged.join(exact, "fy").crossJoin(F.broadcast(whole)).select("fy", "n", *checks)


# p-values of Student's t by the finite sums that whole degrees of freedom allow.
def _t_sql(t: str, df: str) -> str:
    """The chance beyond ``t`` on either side, in SQL: other sums than ``tails`` uses."""
    cos2, angle = f"({df} / ({df} + {t} * {t}))", f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi())) * power({cos2}, j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: 0.5 * exp(0.5 * ln(pi()) + lgamma(j + 1.0) - lgamma(j + 1.5)) * power({cos2}, j))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


@query()
def regression_p_values(ledger: DataFrame) -> DataFrame:
    """Revenue on each cost series: t, to six places, and its p-value."""
    fits = volatility.with_inference(series.regression(_with_revenue(ledger), ["series"]))
    return fits.select("series", F.round("t_value", 4).alias("t_value"), F.round("p_value", 6).alias("p_value"), "n")


ORACLE_SQL["regression_p_values"] = f"""WITH {LEDGER_SQL}, {_PARTS}, j AS (SELECT series, x, y FROM e JOIN x USING (month)),
  f AS (SELECT series, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse FROM j GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) > 0),
  g AS (SELECT series, n, n - 2 AS df, round(b / sqrt(sse / (n - 2) / sxx), 6) AS t FROM f)
  SELECT series, round(t, 4) AS t_value, round({_t_sql("t", "df")}, 6) AS p_value, n FROM g"""


# Budgets by the ids of account and period, as a planning system keeps them; both dimensions are tables of their own.
_MONTH_SQL = "DATE '1990-01-01' + to_months(CAST(period_id AS INTEGER))"


@query(f"""WITH b AS (SELECT l_partkey AS account_id, date_diff('month', DATE '1990-01-01', CAST(date_trunc('month', l_shipdate) AS DATE)) AS period_id, sum(CAST(l_extendedprice AS DECIMAL(18,4))) * CAST(1.1 AS DECIMAL(3,1)) AS amount FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1, 2)
  SELECT p_brand AS account, strftime({_MONTH_SQL}, '%b %Y') AS period, CAST(sum(amount) AS DOUBLE) AS budget, count(*) AS n FROM b JOIN part ON p_partkey = account_id WHERE {_MONTH_SQL} BETWEEN DATE '{FY.start}' AND DATE '{FY.end}' GROUP BY 1, 2""", ledger=False)
def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables(spark, sf_dir, "lineitem", "part")
    zero, month = F.lit(date(1990, 1, 1)), F.trunc(F.col("l_shipdate").cast("date"), "MM")
    planned = F.sum(F.col("l_extendedprice").cast("decimal(18,4)")) * F.lit("1.1").cast("decimal(3,1)")
    budget = line.where("l_partkey % 4 <> 0").groupBy(F.col("l_partkey").alias("account_id"), F.months_between(month, zero).cast("int").alias("period_id")).agg(planned.alias("amount"))
    accounts = part.select(F.col("p_partkey").alias("account_id"), F.col("p_brand").alias("account"))
    periods = line.select(month.alias("start")).distinct().select(F.months_between("start", zero).cast("int").alias("period_id"), F.date_format("start", "MMM yyyy").alias("period"), "start")
    return structure.budget_lines(budget, accounts, periods, F.col("start").between(F.lit(FY.start), F.lit(FY.end)), ["account", "period"])


# Chart data: amounts by day, and quarters with their change on the year before as far as there are enough of them.
@query(f"SELECT CAST(trandate AS VARCHAR) AS day, {SUM} AS total FROM ledger WHERE {_days(FY)} GROUP BY trandate QUALIFY count(*) OVER () >= 3")
def chart_by_day(ledger: DataFrame) -> DataFrame:
    return aggregate.chart_by_day(ledger.where(filters.months(FY)))


_LABEL = f"'Q' || {FQ_SQL} || '''' || lpad(CAST({FY_SQL} % 100 AS VARCHAR), 2, '0')"
_QUARTERS = f"SELECT type, CAST({FY_SQL} AS INTEGER) AS fy, {FQ_SQL} AS fq, {_LABEL} AS label, {SUM} AS total, count(*) AS n FROM ledger WHERE type <> 'ExpRept' OR trandate >= DATE '2000-11-01' GROUP BY ALL"


@query(f"""SELECT type, fy, fq, label, total, n, CASE WHEN k >= 8 THEN round(CASE WHEN p = 0 THEN NULL ELSE (total - p) / abs(p) END, 6) END AS yoy_frac FROM
  (SELECT *, count(*) OVER (PARTITION BY type) AS k, lag(total, 4) OVER (PARTITION BY type ORDER BY fy, fq) AS p FROM ({_QUARTERS})) WHERE k >= 4""")
def chart_quarters(ledger: DataFrame) -> DataFrame:
    rows = ledger.where((F.col("type") != "ExpRept") | (F.col("trandate") >= F.lit(date(2000, 11, 1))))
    return aggregate.chart_quarters(aggregate.by_fiscal_quarter(rows, "type"), ["type"])


@query()
def series_aligned(ledger: DataFrame) -> DataFrame:
    return series.aligned(series.monthly(ledger, "type"), _TYPES)


ORACLE_SQL["series_aligned"] = f"""WITH {LEDGER_SQL}, m AS ({_MONTHLY}), c AS (SELECT count(DISTINCT month) AS k FROM m), g AS (SELECT series FROM m, c GROUP BY series, k HAVING count(*) >= 12 AND count(*) >= 0.5 * k)
  SELECT CAST(month AS VARCHAR) AS month, {", ".join(f"max(value) FILTER (series = '{t}') AS " + '"' + t + '"' for t in _TYPES)} FROM m JOIN g USING (series) GROUP BY 1"""


# Orders all of whose parts another order of the same customer has too.
@query("""WITH o AS (SELECT o_custkey, o_orderkey, list(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS within FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE list_has_all(b.parts, a.parts)""", ledger=False)
def order_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = tables(spark, sf_dir, "orders", "lineitem")
    of = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_partkey")
    return structure.subsets(of, "o_custkey", "o_orderkey", "l_partkey")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(28,6))), 4) AS DOUBLE) AS total FROM events GROUP BY CAST(ts AS DATE), event_type", ledger=False)
def events_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days kept by batches: the events in three batches by user, so that each corrects days of the others; one runs twice."""
    (rows,) = tables(spark, sf_dir, "events")
    table = upserts.DailyTable(spark, Scratch(spark).path("days"))
    for batch in (0, 1, 2, 1):
        table.upsert(rows.where(F.pmod("user_id", F.lit(3)) == batch), batch)
    return table.read()
