"""Operators that replace products of tables: results against plain versions, and the plans that they make."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger import queries
from loomledger.functions import values
from loomledger.operators import prefixes, ranges, registry, series, sketches, structure, trees
from loomledger.plans import spotting
from loomledger.shipping import ship
from loomledger.sources.store import LedgerStore
from loomledger.streaming import events, memory, upserts

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_product(df):
    return not any(word in physical(df) for word in ("NestedLoop", "CartesianProduct"))


# Names.
def catalogue(spark, seed=2):
    r = random.Random(seed)
    word = ["sales", "r&d", "research & development", "gps", "north america", "it", "a", "über", "cost of sales", "x-ray", "ops", "general and administrative"]
    names = {" ".join(r.choice(word) for _ in range(r.randint(1, 3))) + r.choice(["", " (Parent) : ", " : ", " - "]) + r.choice(word).title() + r.choice(["", " 1", "/2"]) for _ in range(150)}
    rows = [(n, r.choice(["510000", "520000", "1"])) for n in names for _ in range(r.randint(1, 3))]
    return registry.build(spark.createDataFrame(rows, "department_name string, account_number string"))


@pytest.mark.parametrize("least", [0.05, 0.3, 0.34, 0.6, 0.95])
def test_lookup_is_that_of_a_full_scan(spark, least):
    found = catalogue(spark)
    names = [r.name for r in found.collect()]
    r = random.Random(1)
    terms = {None, "", "  ", "&", "-", "s", "gp", "GPS", "the sales team", "Über", "sales r&d it"} | {n for n in r.sample(names, 20)} | {n[a : a + k] for n in names for a, k in [(r.randrange(len(n)), r.randint(1, 9))]} | {n + "zz" for n in r.sample(names, 10)}
    asked = spark.createDataFrame([(t,) for t in sorted(terms, key=str)], "term string")
    score = F.round(values.match_score(F.col("term"), F.col("name"), F.col("aliases")), 4)
    every = asked.where("trim(term) <> ''").crossJoin(found).withColumn("score", score).where(F.col("score") >= least)
    columns = ("term", "kind", "name", "n_rows", "score")
    got = registry.lookup_all(found, asked.union(asked), least)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, every.select(*columns).collect()))
    assert no_product(got)


def test_lookup_needs_a_limit(spark):
    with pytest.raises(ValueError):
        registry.lookup_all(catalogue(spark), spark.range(0).select(F.col("id").cast("string").alias("term")), 0)


@pytest.mark.parametrize("name", ["resolve_terms", "registry_lookup", "registry_scores"])
def test_aliases_are_not_worked_out_for_ledger_rows(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate") :]
    assert "array_union" in plan and "array_union" not in below


def test_aliases_keep_digits(spark):
    (row,) = spark.sql("SELECT 'Asia (Parent) : Nation_11' AS n").select(values.aliases(F.col("n")).alias("a")).collect()
    assert "nation_11" in row.a and "nation_" not in row.a


# Trees.
def plain_tree(parents):
    """node -> its ancestors with distance, or None on or below a cycle."""
    out = {}
    for node in parents:
        above, at, seen = {node: 0}, node, {node}
        while (at := parents.get(at)) is not None:
            if at in seen:
                above = None
                break
            seen.add(at)
            above[at] = len(above)
        out[node] = above
    return out


def tree_cases():
    r = random.Random(4)
    chain = {str(k): str(k - 1) if k else None for k in range(1000)}
    wild = {str(k): None if k < 3 else str(r.randrange(k)) for k in range(120)}
    ring = {"a": "b", "b": "c", "c": "a", "below": "a", "x": None, "y": "x", "self": "self", "orphan": "nobody"}
    return {"chain": chain, "wild": wild, "ring": ring, "one": {"x": None}}


@pytest.mark.parametrize("name", ["chain", "wild", "ring", "one"])
def test_trees(spark, name):
    parents = tree_cases()[name]
    want = plain_tree(parents)
    nodes = spark.createDataFrame(list(parents.items()) + list(parents.items())[:2] + [(None, "1")], "node string, parent string")
    got = {r.node: (r.root, r.level) for r in trees.depths(nodes).collect()}
    assert got == {n: (None, None) if a is None else (max(a, key=a.get), max(a.values())) for n, a in want.items()}
    assert {r.node for r in trees.cycles(nodes).collect()} == {n for n, a in want.items() if a is None}
    if name != "chain":  # half a million pairs
        pairs = sorted((r.ancestor, r.descendant, r.depth) for r in trees.closure(nodes).collect())
        assert pairs == sorted((up, n, d) for n, a in want.items() if a is not None for up, d in a.items())
    facts = [(n, k + 0.5) for k, n in enumerate(parents)] + [("nowhere", 5.0), (None, 1.0)] + [(next(iter(parents)), 2.0)]
    rolled = {r.node: (r.direct, r.rolled) for r in trees.rollup(spark.createDataFrame(facts, "account_number string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,4)")), nodes).collect()}
    own = {}
    for n, x in facts:
        own[n] = own.get(n, 0) + x
    below = {n: sum(own[m] for m, a in want.items() if a is not None and n in a) for n, a in want.items() if a is not None}
    assert rolled == {n: (own[n], s) for n, s in below.items()}


# Ranges and prefixes.
@pytest.mark.parametrize("width, base, levels", [(1, 4, 4), (7, 16, 6), (1000, 2, 1)])
def test_overlap_join(spark, width, base, levels):
    r = random.Random(width)
    day = lambda k: date(2000, 1, 1) + timedelta(days=k)

    def spans(n, seed):
        out = []
        for k in range(n):
            a = r.randrange(-400, 800)
            b = a + r.choice([0, 0, 1, 5, 40, 300, 3000, -2])
            out.append((k, day(a) if r.random() > 0.05 else None, day(b) if r.random() > 0.05 else None))
        return out

    one, two = spans(90, 1), spans(70, 2)
    left, right = spark.createDataFrame(one, "i long, a date, b date"), spark.createDataFrame(two, "j long, c date, d date")
    got = ranges.overlap_join(left, right, ("a", "b"), ("c", "d"), width, base, levels)
    ok = lambda a, b: a is not None and b is not None and a <= b
    want = sorted((i, j) for i, a, b in one for j, c, d in two if ok(a, b) and ok(c, d) and a <= d and c <= b)
    assert sorted((x.i, x.j) for x in got.collect()) == want and got.columns == ["i", "a", "b", "j", "c", "d"]
    assert no_product(got)
    with pytest.raises(ValueError):
        ranges.overlap_join(left, left, ("a", "b"), ("a", "b"), 1)
    assert ranges.overlap_join(left.limit(0), right, ("a", "b"), ("c", "d"), 1).collect() == []


def test_range_queries_make_no_product(spark):
    for name in ("period_overlap_join", "period_table_join", "session_overlaps", "prefix_rules"):
        assert no_product(queries.QUERIES[name](spark, SF)), name


def test_overlap_counts_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(60)]), r.choice([0, 0, 0, 1, 3, 50, -1])) for _ in range(400)]
    rows = [(u, a, None if a is None else a + k) for u, a, k in rows] + [(77, 1000, 1001), (78, 2000, 2000), (78, 2000, 2000)]
    fine = [x for x in rows if None not in x and x[1] <= x[2]]
    want = {}
    for u, a, b in fine:
        met = [v for v, c, d in fine if v != u and a <= d and c <= b]
        if met:
            n, others = want.get(u, (0, set()))
            want[u] = n + len(met), others | set(met)
    want = sorted((u, n, len(others)) for u, (n, others) in want.items())
    df = spark.createDataFrame(rows, "u long, a long, b long")
    for blocks in (1, 3):
        monkeypatch.setattr(ranges, "BLOCKS", blocks)
        got = ranges.overlap_counts(df, "u", ("a", "b"))
        assert sorted(map(tuple, got.collect())) == want
    assert "Join" not in physical(got)  # no row per pair
    assert ranges.overlap_counts(df.limit(0), "u", ("a", "b")).collect() == []
    # The same in one block, some rows and pairs at a time, whether its groups are one or two.
    monkeypatch.setattr(ranges, "PAIRS", 7)
    fine.sort(key=lambda x: x[1])
    for alone in (True, False):
        block, sides = ranges._Block(alone), np.array([0 if alone else u % 2 for u, _, _ in fine])
        columns = [np.array(c) for c in zip(*fine)]
        for k in range(0, len(fine), 11):
            block.add(sides[k : k + 11], *(c[k : k + 11] for c in columns))
        met = lambda u, v: u != v if alone else u % 2 != v % 2
        plain = {u: (sum(met(u, v) and x == u and a <= d and c <= b for x, a, b in fine for v, c, d in fine), len({v for x, a, b in fine if x == u for v, c, d in fine if met(u, v) and a <= d and c <= b})) for u in set(columns[0].tolist())}
        assert {u: (n, k) for u, n, k in zip(*(x.tolist() for x in block.counts()))} == plain


def test_sessions_beside_others_make_no_row_per_pair(spark):
    assert "Join" not in physical(queries.QUERIES["session_overlaps"](spark, SF))


def test_longest_prefix(spark):
    r = random.Random(9)
    digits = lambda k: "".join(r.choice("0123") for _ in range(k))
    rules = [(digits(r.randint(1, 6)), f"rule {k}") for k in range(300)] + [("01", "a"), ("01", "b"), (None, "none")]
    facts = [(k, digits(r.randint(0, 8))) for k in range(400)] + [(900, None), (901, "zz"), (902, "")]
    best = {}
    for p, label in rules:
        if p is not None:
            best[p] = min(best.get(p, label), label)

    def plain(v):
        fits = [p for p in best if v is not None and v.startswith(p)]
        return (max(fits, key=len), best[max(fits, key=len)]) if fits else (None, None)

    df = spark.createDataFrame(facts, "k long, number string")
    got = prefixes.longest_prefix(df, spark.createDataFrame(rules, "prefix string, label string"), "number")
    assert sorted(map(str, ((x.k, x.prefix, x.label) for x in got.collect()))) == sorted(map(str, ((k, *plain(v)) for k, v in facts)))
    assert no_product(got)
    default = prefixes.longest_prefix(df, spark.createDataFrame([("", "rest")], "prefix string, label string"), "number")
    assert {x.k for x in default.collect() if x.label is None} == {900}


# The stored ledger.
def stored(spark, tmp_path):
    rows = [(f"{40 + k % 7}0000", float(k), date(2024, 1 + k % 5, 1)) for k in range(200)] + [("400000", 1.0, None)]
    ledger = spark.createDataFrame(rows, "account_number string, amount double, period_start date").withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    store = LedgerStore(spark, str(tmp_path / "store"), buckets=4).write(ledger)
    store.write_accounts(ledger.select("account_number").distinct().withColumn("title", F.concat(F.lit("Account "), "account_number")))
    return store, ledger


def test_stored_ledger_reads_its_months_and_joins_without_an_exchange(spark, tmp_path):
    store, ledger = stored(spark, tmp_path)
    part = store.ledger().where(F.col("period_start").between(F.lit(date(2024, 2, 1)), F.lit(date(2024, 3, 31))))
    plan = physical(part)
    assert "PartitionFilters: [isnotnull(period_start" in plan and "period_start#" in plan.split("PartitionFilters")[1]
    joined = store.with_accounts(part)
    assert "Exchange" not in physical(joined) and "SortMergeJoin" in physical(joined)
    assert joined.count() == ledger.where("period_start between '2024-02-01' and '2024-03-31'").count()
    by_dimension = store.ledger().join(spark.createDataFrame([(date(2024, 4, 1), "April")], "period_start date, label string").where("label like 'A%'"), "period_start")
    assert "dynamicpruning" in physical(by_dimension) and by_dimension.count() == 40
    store.drop()


def test_late_lines_rewrite_their_months_only(spark, tmp_path):
    store, ledger = stored(spark, tmp_path)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "lines").rglob("*.parquet")}
    before = files()
    late = spark.createDataFrame([("410000", 7.0, date(2024, 3, 1)), ("999999", 8.0, date(2025, 1, 1)), ("1", 2.0, None)], "account_number string, amount double, period_start date")
    late = late.withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    store.add(late)
    after = files()
    month = lambda path: path.split("period_start=")[1].split("/")[0]
    assert {month(p) for p in before.items() - after.items() for p in [p[0]]} == {"2024-03-01", "__HIVE_DEFAULT_PARTITION__"}
    assert {month(p) for p in after.keys() - before.keys()} == {"2024-03-01", "2025-01-01", "__HIVE_DEFAULT_PARTITION__"}
    assert sorted(map(str, store.ledger().select(*ledger.columns).collect())) == sorted(map(str, ledger.union(late).collect()))
    assert "Exchange" not in physical(store.with_accounts())
    store.drop()


# Terms in texts.
def scanned(text, terms):
    clean = lambda w: w.strip(".,;:!?()\"'-")
    said = [w for w in map(clean, text.lower().split()) if w]
    spans = [(len(t), at, name) for name, t in terms.items() for at in range(len(said) - len(t) + 1) if said[at : at + len(t)] == t]
    taken = []
    for n, at, name in sorted(spans, key=lambda s: (-s[0], s[1], s[2])):
        if all(at + n <= b or a + m <= at for m, b, _ in taken for a in [b]):
            taken.append((n, at, name))
    return [(name, at, n) for n, at, name in taken]


def test_spotting_takes_the_longest(spark):
    r = random.Random(6)
    names = ["sales", "cost of sales", "sales and marketing", "marketing", "of", "r&d", "R&D costs", "sales & marketing", "us", "and marketing costs", "Sales "]
    terms = {}
    for n in sorted(names):
        terms.setdefault(tuple(n.lower().split()), n)
    terms = {name: list(said) for said, name in terms.items()}
    pool = "sales cost of and marketing r&d costs us the & (sales) Marketing, of.".split()
    texts = [(k, " ".join(r.choice(pool) for _ in range(r.randint(0, 25)))) for k in range(120)] + [(500, None), (501, " \n "), (7, "cost of sales and marketing costs")]
    got = spotting.spot(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(n,) for n in [*names, "", None]], "term string"))
    assert sorted((x.k, x.term, x.at, x.n_words) for x in got.collect()) == sorted((k, *s) for k, t in texts if t for s in scanned(t, terms))
    assert no_product(got)


def test_terms_that_begin_alike_meet_only_their_own_places(spark):
    texts = spark.createDataFrame([(k, f"the w{k} x") for k in range(300)] + [(900, "(the) w7, y")], "k long, text string")
    terms = texts.where("k < 900").select(F.array_join(F.slice(spotting.words(F.col("text")), 1, 2), " ").alias("term"))
    got = spotting.spot(texts, terms)
    assert sorted((x.k, x.term, x.at) for x in got.collect()) == [*((k, f"the w{k}", 0) for k in range(300)), (900, "the w7", 0)]
    assert got.columns == ["k", "term", "at", "n_words"]
    (join,) = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "said" in join and "first" not in join  # by all words, not by the first with the others compared afterwards


# Sketches.
def test_sketches_merge_and_refresh(spark):
    rows = spark.range(40_000).select((F.lit(date(2024, 1, 1)) + (F.col("id") % 20).cast("int")).alias("day"), (F.col("id") % 9000).alias("user"), (F.col("id") * 7919 % 40_000).cast("double").alias("x"))
    columns = ("day", ["user"], ["x"])
    first = spark.createDataFrame(sketches.daily(rows.where("day < '2024-01-11'"), *columns).collect(), sketches.daily(rows, *columns).schema)
    both = sketches.refresh(first, rows, *columns)
    (s,) = sketches.summary(both, ["user"], ["x"]).collect()
    assert s.n == 40_000 and abs(s.distinct_user - 9000) <= 0.04 * 9000
    assert all(abs(q / 40_000 - p) <= 0.02 for q, p in zip(s.quantiles_x, (0.25, 0.5, 0.75)))
    (part,) = sketches.summary(both.where("day = '2024-01-05'"), ["user"], ["x"]).collect()
    assert part.n == 2000
    changed = rows.union(rows.where("day = '2024-01-02'"))  # a day that is there already is not read again
    assert sketches.refresh(first, changed, *columns).agg(F.sum("n")).first()[0] == 40_000


# Rank correlation.
def test_kendall(spark):
    r = random.Random(8)
    rows = [(g, float(r.randrange(k)), float(r.randrange(k)) + (a if g == "b" else 0)) for g, k in (("a", 7), ("b", 1000), ("c", 1)) for a in range(200)] + [("d", 1.0, 2.0), ("a", None, 1.0)]
    sign = lambda x: (x > 0) - (x < 0)
    want = {}
    for g in "abcd":
        mine = [(x, y) for h, x, y in rows if h == g and x is not None]
        s = sum(sign(a - c) * sign(b - d) for a, b in mine for c, d in mine)
        nx, ny = sum(a != c for a, _ in mine for c, _ in mine), sum(b != d for _, b in mine for _, d in mine)
        want[g] = (round(s / (nx * ny) ** 0.5, 6) if nx * ny else 0.0, len(mine))
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = series.correlate(df, ["g"], "kendall")
    assert {x.g: (x.r, x.n) for x in got.collect()} == want
    big = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    plan = series.correlate(big, ["g"], "kendall")
    assert plan.first().r == -1.0 and no_product(plan)


def test_kendall_sorts_different_pairs_of_values_only(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.lit("a").alias("g"), (F.col("id") % 7).alias("x"), (F.col("id") % 7 * 3 % 5).alias("y"))
    got = series.correlate(rows, ["g"], "kendall")
    sign = lambda x: (x > 0) - (x < 0)
    k = {(x, x * 3 % 5): sum(i % 7 == x for i in range(20_000)) for x in range(7)}
    s, nx, ny = (sum(n * m * f(a, b) for a, n in k.items() for b, m in k.items()) for f in (lambda a, b: sign(a[0] - b[0]) * sign(a[1] - b[1]), lambda a, b: a[0] != b[0], lambda a, b: a[1] != b[1]))
    assert [tuple(x) for x in got.collect()] == [("a", round(s / (nx * ny) ** 0.5, 6), 20_000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    windows = [i for i, line in enumerate(plan) if "Window" in line]
    assert windows and all(any("Aggregate" in line and depth(line) > depth(plan[i]) for line in plan[i + 1 :]) for i in windows)


# Dimensions and sets.
def test_budget_lines_and_subsets(spark):
    budget = spark.createDataFrame([(1, 10, 5.0), (1, 11, 7.0), (2, 10, 1.0), (3, 10, 9.0), (1, 99, 4.0)], "account_id long, period_id long, amount double")
    accounts = spark.createDataFrame([(1, "Rent"), (2, None)], "account_id long, account string")
    periods = spark.createDataFrame([(10, "Jan"), (11, "Feb")], "period_id long, period string")
    got = structure.budget_lines(budget, accounts, periods, F.col("period") == "Jan", ["account", "period"])
    assert sorted(map(tuple, got.collect())) == [("Rent", "Jan", 5.0, 1), ("Unknown", "Jan", 1.0, 1)]
    members = spark.createDataFrame([("g", "a", 1), ("g", "a", 1), ("g", "b", 1), ("g", "b", 2), ("h", "c", 1), ("g", "d", 2), ("g", "d", 1)], "g string, o string, i long")
    assert sorted(map(tuple, structure.subsets(members, "g", "o", "i").collect())) == [("g", "a", "b"), ("g", "a", "d"), ("g", "b", "d"), ("g", "d", "b")]


def test_subsets_meet_on_one_item_of_each(spark):
    r = random.Random(12)
    rows = [(r.choice("gh"), k % 60, r.choice([1, 1, 2, 3, 4])) for k in range(200)] + [("g", 70, None), ("g", 70, 1), ("g", 71, None), (None, 72, 1), (None, 73, 1)]
    sets = {}
    for g, o, i in rows:
        sets.setdefault((g, o), set()).add(i)
    want = sorted((g, o, p) for (g, o), x in sets.items() for (h, p), y in sets.items() if g and g == h and o != p and None not in x and x <= y)
    got = structure.subsets(spark.createDataFrame(rows, "g string, o long, i long"), "g", "o", "i")
    assert sorted(map(tuple, got.collect())) == want
    assert "Window" not in physical(got) and no_product(got)


# Streams.
def at(text):
    return datetime.fromisoformat(f"2025-01-{text}")


def test_upserted_days(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, user_id long"
    batches = [[(at("01 10:00"), "view", 1.5, 1), (at("02 10:00"), "view", 2.0, 1)], [(at("02 23:00"), "view", 4.0, 2), (at("03 01:00"), "buy", 8.0, 2)], [(at("01 09:00"), "view", 16.0, 3), (None, "view", 1.0, 3)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    table, numbers = upserts.DailyTable(spark, str(tmp_path / "days")), []
    query = table.follow(stream, str(tmp_path / "checkpoint"), numbers.append)
    query.awaitTermination(120)
    assert query.exception() is None and len(numbers) >= 3
    whole = spark.createDataFrame([x for b in batches for x in b if x[0]], schema)
    plain = lambda df: sorted((str(r.day), r.event_type, r.n, r.total) for r in df.collect())
    want = plain(events.daily(whole))
    assert plain(table.read()) == want
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    before = files()
    again = next(k for k in range(3) if any(f"batch={k}" in p and "day=2025-01-03" in p for p in before))
    table.upsert(spark.createDataFrame(batches[1], schema), again)  # the same batch once more
    assert plain(table.read()) == want
    assert {p for p, t in files().items() if before.get(p) != t} and all(f"batch={again}" in p for p, t in files().items() if before.get(p) != t)
    assert plain(table.compact(max(numbers), str(tmp_path / "compact")).read()) == want


def test_last_turns_expire(spark, tmp_path):
    ship(spark)
    schema = "session_id string, ts timestamp, text string"
    batches = [
        [("a", at("01 10:00"), "one"), ("a", at("01 10:05"), "two"), ("b", at("01 10:00"), "hello"), ("a", None, "no time")],
        [("a", at("01 10:06"), "three"), ("c", at("01 12:00"), "moves on")],
        [("a", at("01 10:07"), "too late"), ("c", at("01 12:01"), None), ("a", at("01 12:02"), "new life")],
        [("d", at("01 15:00"), "end")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rows = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", memory.ROCKSDB)
    try:
        out = memory.last_turns(stream, most=2).writeStream.outputMode("update").foreachBatch(lambda b, k: rows.extend(b.collect()))
        query = out.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda s: [(r.event, r.turns) for r in rows if r.session_id == s]
    assert of("a") == [("update", "one | two"), ("update", "two | three"), ("expired", "two | three"), ("update", "new life"), ("expired", "new life")]
    assert of("b") == [("update", "hello"), ("expired", "hello")] and of("d") == [("update", "end")]
    assert of("c") == [("update", "moves on"), ("update", "moves on | "), ("expired", "moves on | ")]
