"""Invariants of ranks, scores, funds, market data and checks on literal tables."""

import bisect
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cinderflow import config
from cinderflow.functions import dates, numbers, text
from cinderflow.operators import aggregates, checks, entities, joins, market, portfolio, ranking, scoring, timeseries
from cinderflow.plans import check_queries, fixtures, linking_queries, operator_queries


def ranks_of(spark, values, better=True):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "t string, v double").where("v is not null")
    got = df.select("t", ranking.rank01(F.col("v"), [F.lit(1)], F.lit(better)).alias("r")).collect()
    return {r["t"]: r["r"] for r in got}


def test_ranks(spark):
    assert ranks_of(spark, [1.0, 2.0, 3.0]) == {"0": 0.0, "1": 0.5, "2": 1.0}
    assert ranks_of(spark, [1.0, 1.0, 2.0]) == {"0": 0.25, "1": 0.25, "2": 1.0}
    assert ranks_of(spark, [1.0, 2.0, 3.0], False) == {"0": 1.0, "1": 0.5, "2": 0.0}
    assert ranks_of(spark, [7.0]) == {"0": 0.5} and ranks_of(spark, [None, 5.0, 6.0]) == {"1": 0.0, "2": 1.0}


def test_buckets_close_on_the_right(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(1, 11)], "p double")
    assert [r[0] for r in df.select(ranking.bucket(F.col("p"), 5)).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_coverage_rule(spark):
    rows = [("a", "x", 1.0, 3.0), ("a", "y", 0.5, 1.0), ("b", "x", None, 3.0), ("b", "y", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, i string, rank01 double, weight double").withColumn("category", F.lit("c"))
    got = {r["ticker"]: r for r in scoring.category_scores(df, 0.5).collect()}
    assert got["a"]["score"] == 87.5 and got["b"]["score"] is None and got["b"]["weight_share"] == 0.25


def market_of(spark, n=60, seed=1):
    draw = random.Random(seed)
    rows = [(k, f"t{k:03}", f"n{k}", draw.choice(["A", "B", "C", ""]), draw.choice(["X", "Y"]), f"c{k - (k % 10 == 1)}", draw.choice([None, draw.uniform(1, 100)])) for k in range(n)]
    return spark.createDataFrame(rows, "ordinal int, ticker string, name string, sector string, sub_industry string, cik string, cap double")


def scored(spark, universe, seed=2):
    draw = random.Random(seed)
    rows = [(r["ticker"], r["name"], r["sector"], draw.choice([None, round(draw.uniform(0, 100), 1)])) for r in universe.orderBy("ordinal").collect()]
    return spark.createDataFrame(rows, "ticker string, name string, sector string, total_score double")


@pytest.mark.parametrize("over", [{}, {"tilt_strength": 4.0, "max_weight": 0.09}, {"method": "exclude"}, {"benchmark": "equal", "max_weight": 0.022}, {"sector_neutral": False, "tilt_strength": 4.0, "max_weight": 0.09}])
def test_fund_invariants(spark, over):
    u = market_of(spark)
    s = config.portfolio_settings(config.Profile("p"), {"benchmark": "cap", "exclude_bottom_pct": 0.2, "max_weight": 0.2, "exclude_sub_industries": ["Y"] if "benchmark" not in over else [], **over})
    f = portfolio.allocate(scored(spark, u), u, s).collect()
    assert len(f) == len({r["cik"] for r in f})
    assert abs(sum(r["weight"] for r in f) - 1) < 1e-9 and abs(sum(r["benchmark_weight"] for r in f) - 1) < 1e-9
    assert max(r["weight"] for r in f) <= s["max_weight"] + 1e-9
    for r in f:
        assert r["weight"] >= 0 and r["reason"]
        if r["policy"] or r["benchmark_weight"] == 0:
            assert r["weight"] == 0
        if r["total_score"] is None and r["eligible"] > 0:
            assert r["weight"] > 0  # missing data is no reason to sell
    if s["sector_neutral"] and not over:
        for sector in {r["sector"] for r in f}:
            a, b = (sum(r[c] for r in f if r["sector"] == sector) for c in ("neutral", "eligible"))
            assert abs(a - b) < 1e-9


def test_a_cap_too_low_is_an_error(spark):
    u = market_of(spark)
    s = config.portfolio_settings(config.Profile("p"), {"max_weight": 0.01})
    with pytest.raises(ValueError, match="cannot hold"):
        portfolio.allocate(scored(spark, u), u, s)
    capless = config.portfolio_settings(config.Profile("p"), {"benchmark": "cap"})
    with pytest.raises(ValueError, match="market cap"):
        portfolio.allocate(scored(spark, u), u.withColumn("cap", F.lit(None).cast("double")), capless)
    everything = sorted({r[0] for r in u.select("sub_industry").collect() if r[0]})
    with pytest.raises(ValueError, match="leave no company"):
        portfolio.allocate(scored(spark, u), u, {**capless, "exclude_sub_industries": everything})


def loop_fill(w, total, cap):
    out, free, left = [0.0] * len(w), [i for i, x in enumerate(w) if x > 0], total
    while free and left > 1e-15:
        scale = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * scale > cap + 1e-12]
        if not over:
            for i in free:
                out[i] = w[i] * scale
            break
        for i in over:
            out[i] = cap
        left -= cap * len(over)
        free = [i for i in free if i not in over]
    return out


def test_closed_form_cap_equals_rounds(spark):
    draw = random.Random(9)
    rows, want = [], {}
    for g in range(60):
        n = draw.randrange(1, 12)
        w = [draw.choice([0.0, draw.random(), draw.random() ** 6]) for _ in range(n)]
        for i, (x, y) in enumerate(zip(w, loop_fill(w, sum(w), 0.3), strict=True)):
            rows.append((f"g{g}", f"t{i:02}", x))
            want[f"g{g}", f"t{i:02}"] = y
    df = spark.createDataFrame(rows, "g string, ticker string, w double")
    for r in portfolio.waterfill(df, "w", 0.3, ["g"], "out").collect():
        assert abs(r["out"] - want[r["g"], r["ticker"]]) < 1e-12


def test_points_add_up_to_the_total(spark):
    draw = random.Random(7)
    u = market_of(spark, 40)
    ids = [("e1", "economic", True, 1.0), ("e2", "economic", False, 2.0), ("s1", "social", True, 1.0), ("v1", "environmental", False, 1.5)]
    catalog = spark.createDataFrame(ids, "indicator_id string, category string, higher_is_better boolean, weight double")
    facts = spark.createDataFrame([(i, f"t{k:03}", y, draw.random()) for k in range(40) for i, *_ in ids for y in (2019, 2020) if draw.random() > 0.15], "indicator_id string, ticker string, year int, value double")
    p = config.Profile("p", min_weight_share=0.5, sector_relative=True, min_year=2000)
    ranks = scoring.profile_ranks(u, facts, catalog, p).cache()
    points = {r["ticker"]: r["p"] for r in scoring.explain(ranks, scoring.category_scores(ranks, 0.5), p.category_weights).groupBy("ticker").agg(F.sum("points").alias("p")).collect()}
    table = scoring.score_profile(u, facts, catalog, p).collect()
    assert any(r["total_score"] is not None for r in table)
    for r in table:
        if r["total_score"] is not None:
            assert abs(points[r["ticker"]] - r["total_score"]) <= 0.05 + 1e-9
    runs = spark.createDataFrame([(1, "indicator", i, w) for i, _, _, w in ids] + [(1, "category", c, 1.0) for c in config.CATEGORIES], "run int, kind string, id string, weight double")
    fast = {r["ticker"]: r["total_score"] for r in scoring.many_totals(ranks, runs, 0.5).collect()}
    assert {r["ticker"]: r["total_score"] for r in table} == fast
    mates = {r["ticker"]: r["rank01"] for r in ranks.where("indicator_id = 'e1'").collect()}
    assert mates["t000"] == mates["t001"]  # share classes of one company share its rank


def test_profile_round_trip():
    p = config.Profile("x", {"economic": 2.0, "social": 1.0, "environmental": 1.0}, {"a": 0.5}, portfolio={"tilt_strength": 1.5, "exclude_sub_industries": ["A \"b\" é"]}, description="d")
    assert config.load_profile(config.to_toml(p)) == p
    assert config.load_profile('name = "y"\n[categories]\nsocial = 0.0').category_weights == {"economic": 1.0, "social": 0.0, "environmental": 1.0}
    for bad in ("nonsense = 1", "min_weight_share = 2", "[categories]\nspace = 1.0", "[indicators]\na = -1.0"):
        with pytest.raises(ValueError):
            config.load_profile(bad)
    plain = config.portfolio_settings(config.Profile("p"))
    assert plain == {"method": "tilt", "benchmark": "equal", "tilt_strength": 0.6, "exclude_bottom_pct": 0.1, "max_weight": 0.05, "sector_neutral": True, "exclude_sub_industries": []}
    with pytest.raises(ValueError):
        config.portfolio_settings(p, {"max_weight": 0})
    with pytest.raises(ValueError):
        config.portfolio_settings(p, {"colour": 1})


def test_profit_at_risk(spark):
    rows = [(0.0, 5.0), (10.0, 1000.0), (10.0, -5.0), (100.0, 100.0), (10.0, None)]
    df = spark.createDataFrame(rows, "t double, p double")
    assert [r[0] for r in df.select(market.profit_at_risk(F.col("t"), F.col("p"), F.lit(10.0))).collect()] == [0.0, 0.1, 1.0, 1.0, None]
    assert df.select(market.profit_at_risk(F.col("t"), F.col("p"), F.lit(0.0))).collect()[2][0] == 0.0


def test_asof_keeps_all_lines_of_the_newest(spark):
    left = spark.sql("select * from values ('a', date'2020-06-30'), ('b', date'2020-06-30') t(k, at)")
    right = spark.sql("select * from values ('a', date'2020-01-01', 1), ('a', date'2020-05-01', 2), ('a', date'2020-05-01', 3), ('a', date'2020-07-01', 4), ('b', date'2019-01-01', 5) t(k, as_of, v)")
    assert sorted(r["v"] for r in joins.asof_within(left, right, "k", "at", "as_of", 400).collect()) == [2, 3]


def test_series_rules(spark):
    df = spark.sql("select * from values ('a', 2018, 1.0), ('a', 2019, 2.0), ('a', 2021, 5.0) t(k, year, value)")
    assert [(r["year"], r["delta"]) for r in timeseries.consecutive_delta(df, ["k"]).collect()] == [(2019, 1.0)]
    assert sorted((r["year"], r["carried"]) for r in timeseries.carried_forward(df, ["k"], 2023).collect())[-2:] == [(2022, True), (2023, True)]
    assert timeseries.lagged(df, ["k"], 3).collect()[0]["then"] == 1.0
    one = spark.sql("select 1.0d x, id y from range(5)").agg(aggregates.pearson(F.col("x"), F.col("y").cast("double")).alias("r"))
    assert one.collect()[0]["r"] is None


def test_checks(spark):
    cols = "ticker string, year string, value string, source string, source_url string, retrieved string"
    good = ("A", "2020", "1.5", "s", "u", "2024-01-01")
    bad = [("a", "2020", "1", "s", "u", "2024-01-01"), ("B", "20x", "1", "s", "u", "2024-01-01"), ("C", "2020", "inf", "s", "u", "2024-13-01"), ("D", "2020", "1", " ", None, "2024-01-01"), ("A", "2020", "2", "s", "u", "2024-01-01")]
    got = {r["rule"]: r["n_bad"] for r in checks.indicator_findings(spark.createDataFrame([good, *bad], cols)).collect()}
    assert got == {"ticker": 1, "year": 1, "value": 1, "source": 1, "source_url": 1, "retrieved": 1, "duplicate": 2}


def test_company_matches(spark):
    """Names that parents and subsidiaries share, generic and short names, legal forms, names under several numbers."""
    parents = spark.createDataFrame([("Kroger Co.", "k"), ("Acme & Sons", "a"), ("Twin Falls", "k"), ("Twin Falls", "a"), ("HCA Inc", "h")], "name string, entity string")
    subs = spark.createDataFrame([("Twin Falls LLC", "k"), ("Kroger Foods LLC", "k"), ("Financial Services LLC", "k"), ("Jasper Holdings Ltd.", "a"), ("Ryan LLC", "a"), ("Mountain View Hospital", "h"), ("Oak Valley Clinic", "h"), ("Acme and Sons", "h")], "name string, entity string")
    eins = spark.createDataFrame([("12-3456789", "k")], "ein string, entity string")
    rows = [
        (1, "123456789", "whatever", "k", "ein"), (2, None, "KROGER COMPANY", "k", "name"), (3, None, "Twin Falls", None, None), (4, None, "Kroger Foods Inc", "k", "subsidiary"),
        (5, None, "Financial Services, LLC", None, None), (6, None, "Jasper Holdings, Inc.", None, None), (7, None, "Ryan L.L.C.", None, None), (8, "22-2222222", "Mountain View Hospital", "h", "subsidiary"),
        (9, "33-3333333", "Oak Valley Clinic", None, None), (10, "44-4444444", "Oak Valley Clinic", None, None), (11, None, "Acme & Sons", None, None), (12, "00-0000000", None, None, None),
    ]
    records = spark.createDataFrame([r[:3] for r in rows], "id long, ein string, name string")
    assert sorted((r["id"], r["entity"], r["tier"]) for r in entities.company_matches(records, eins, parents, subs).collect()) == [(r[0], *r[3:]) for r in rows]


def test_whole_tables_are_joined(spark, tmp_path):
    """As-of join and split over every order and line, by brute force."""
    import datetime
    from collections import Counter

    from cinderflow.plans import catalogue

    draw, first = random.Random(4), datetime.date(1996, 1, 1)
    orders = [(k, draw.randrange(6), first + datetime.timedelta(draw.randrange(1500)), float(k)) for k in range(1, 81)]
    lines = [(k, n, draw.randrange(5), float(draw.randrange(1, 51))) for k, *_ in orders for n in range(2)]
    kinds = [(k, f"LARGE KIND{k} TIN") for k in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(kinds, "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = Counter()
    for k, c, at, _ in orders:
        older = [(x[2], x[0]) for x in orders if x[1] == c and x[0] != k and 0 <= (at - x[2]).days <= 400]
        want.update((k, c, j, float(j)) for then, j in older if then == max(older)[0])
    assert Counter(map(tuple, catalogue.queries()["j12_asof_all"](spark, str(tmp_path)).collect())) == want
    got = catalogue.queries()["j23_explode_all"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((o, n, p, w) for o, n, p, _ in lines for k, t in kinds if k == p for w in t.split())


def test_drawn_weightings(spark):
    """A thousand seeded weightings and what comes of them, against plain numpy and pandas."""
    import numpy as np
    import pandas as pd

    from cinderflow.plans import score_queries

    assert score_queries.DRAWS == 1000
    catalog = [("a", "economic", 1.0), ("b", "economic", 2.0), ("off", "social", 0.0), ("c", "social", 1.0), ("d", "environmental", 1.0)]
    rng = np.random.default_rng(7)
    r = rng.uniform(0, 1, (60, 5))
    r[rng.uniform(0, 1, r.shape) < 0.2] = np.nan
    ranks = spark.createDataFrame([(f"t{k:02}", c, i, None if np.isnan(r[k, j]) else float(r[k, j])) for k in range(60) for j, (i, c, _) in enumerate(catalog) if i != "off"], "ticker string, category string, indicator_id string, rank01 double")
    profile = config.Profile("p", {"economic": 1.0, "social": 1.0, "environmental": 0.0})

    def totals(cats, w):
        parts = []
        for c in config.CATEGORIES[:2]:
            at = [j for j, x in enumerate(catalog) if x[1] == c and x[0] != "off"]
            have = ~np.isnan(r[:, at]) * w[at]
            s = np.nansum(r[:, at] * w[at], 1) / np.where(have.sum(1) > 0, have.sum(1), np.nan)
            parts.append(np.where(have.sum(1) / w[at].sum() >= 0.6, s, np.nan))
        p, cw = np.column_stack(parts), np.array(cats[:2])
        have = ~np.isnan(p) * cw
        with np.errstate(invalid="ignore"):
            return pd.Series(np.round(np.where(have.sum(1) / cw.sum() >= 0.6, np.nansum(p * cw, 1) / have.sum(1), np.nan) * 100, 1), [f"t{k:02}" for k in range(60)])

    base = totals(np.ones(3), np.array([x[2] for x in catalog])).dropna()
    default = spark.createDataFrame(list(base.items()), "ticker string, total_score double")
    draw, top, bottom, rhos = np.random.default_rng(2026), 0, 0, []
    for _ in range(1000):
        s = totals(draw.uniform(0.05, 1, 3), draw.uniform(0.05, 1, 5))[base.index]
        pct = s.rank(ascending=False, pct=True)
        top, bottom = top + (pct <= 0.2), bottom + (pct > 0.8)
        rhos.append(base.rank().corr(s.rank()))
    table = spark.createDataFrame(catalog, "indicator_id string, category string, weight double")
    got_totals = scoring.many_totals(ranks, scoring.drawn_weightings(table, profile), 0.6).cache()
    got = {x["ticker"]: (x["default_score"], x["top_share"], x["bottom_share"]) for x in checks.weight_frequencies(got_totals, default, 1000).collect()}
    assert set(got) == set(base.index)
    for t, (score, high, low) in got.items():
        assert score == base[t] and abs(high - top[t] / 1000) < 0.0015 and abs(low - bottom[t] / 1000) < 0.0015
    verdict = checks.weight_verdict(got_totals, default, 1000).collect()[0]
    assert verdict["companies"] == len(base) and abs(verdict["median_rho"] - np.median(rhos)) < 1e-4 and abs(verdict["rho_p5"] - np.percentile(rhos, 5)) < 1e-3


def test_matching(spark):
    links = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 1), (2, "a", "x", 1), (2, "c", "y", 1), (3, "a", "x", 2), (3, "c", "y", 1)], "record int, entity string, company string, strength int")
    assert sorted((r["record"], r["entity"]) for r in entities.resolve_conflicts(links).collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_scalar_functions(spark):
    row = lambda *c: spark.range(1).select(*c).collect()[0]
    assert list(row(*[numbers.half_even(F.lit(x), 1) for x in (0.25, 0.35, 0.05)])) == [0.2, 0.4, 0.0]
    assert row(numbers.clip(F.lit(None).cast("double"), 0.0, 1.0))[0] is None
    day = lambda x: F.lit(x).cast("date")
    assert list(row(dates.fiscal_year_from_end(day("2021-01-03")), dates.fiscal_year_from_end(day("2021-01-31")), dates.fiscal_year_mid(day("2021-06-30")), dates.quarter_label(day("2021-06-30")))) == [2020, 2021, 2020, "2021Q2"]
    assert row(dates.excel_serial(F.lit(45292)))[0].isoformat() == "2024-01-01" and row(dates.parse_any(F.lit("02012020"), "MM/dd/yyyy", "MMddyyyy"))[0].isoformat() == "2020-02-01"
    assert list(row(dates.fiscal_year_of_filing(day("2021-03-01"), F.lit(12), F.lit(31)), dates.fiscal_year_of_filing(day("2021-12-30"), F.lit(9), F.lit(30)))) == [2020, 2021]
    assert list(row(text.core_name(F.lit("Acme Group, Inc.")), text.normalised_name(F.lit("The Acme Co.")), text.slug(F.lit("!!")), text.slug(F.lit("My Plan 2")))) == ["acme", "acme", "profile", "my_plan_2"]
    assert [tuple(x) for x in row(text.owners(F.lit("A (74.5%); B")))[0]] == [("A", 0.745), ("B", 1.0)]
    assert row(text.scaled_number(F.lit("1,234.5 million")))[0] == 1234.5e6
    assert list(row(text.html_text(F.lit("<p>a<b>b</b></p><script>x</script>c")), text.inline_text(F.lit("<p>a<b>b</b></p><p>c</p>")))) == ["a b c", "ab\nc"]


def test_sums_in_any_order(spark):
    """The same prices in other orders have one total to the last bit; plain sums of them differ."""
    draw, prices = random.Random(3), [round(random.Random(5).uniform(1, 2) * 10**k + k / 100, 2) for k in (2, 3, 4, 5, 5, 4, 3, 1)]
    orders = [draw.sample(prices, len(prices)) for _ in range(50)]
    df = spark.createDataFrame([(k, x) for k, xs in enumerate(orders) for x in xs], "k int, x double").coalesce(1)
    got = df.groupBy("k").agg(numbers.steady_sum(F.col("x")).alias("steady"), F.sum("x").alias("plain")).collect()
    assert len({r["steady"] for r in got}) == 1 < len({r["plain"] for r in got})
    assert abs(got[0]["steady"] - math.fsum(prices)) <= math.ulp(got[0]["steady"])
    assert spark.createDataFrame([(None,), (None,)], "x double").agg(numbers.steady_sum(F.col("x"))).first()[0] is None


def test_equal_companies_have_equal_facts(spark, tmp_path):
    """Customers whose orders and lines have the same figures, in other orders, tie in every indicator."""
    draw = random.Random(11)
    orders, lines, twins = [], [], 60
    figures = [[(round(draw.uniform(1, 10**draw.randint(2, 6)), 2), round(draw.uniform(900, 100000), 2), draw.randint(0, 10) / 100) for _ in range(9)] for _ in range(6)]
    for who in range(twins):
        for y, year in enumerate(figures):
            for k, (total, price, discount) in enumerate(draw.sample(year, len(year))):
                key = len(orders)
                orders.append((key, who, total, f"{1995 + y}-03-01"))
                lines.append((key, k % 3, 10.0, price, discount, "RN"[k == 4], f"{1995 + y}-05-01"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, d string").selectExpr("*", "timestamp(d) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, d string")
    lineitem.selectExpr("* except (l_suppkey)", "0L l_suppkey", "timestamp(d) l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    years = fixtures.order_years(spark, str(tmp_path)).collect()
    assert len(years) == twins * 6 and len({(r["year"], r["total"]) for r in years}) == 6
    sums = fixtures.line_years(spark, str(tmp_path)).drop("ticker").distinct()
    assert sums.count() == 6


def test_totals_by_slices_and_blocks(spark, monkeypatch):
    """Totals of many runs are dealt to tasks by slice of the runs and block of tickers, and are the same however they are dealt."""
    draw = random.Random(2)
    ranks = spark.createDataFrame([(str(t), i, k, draw.choice([None, draw.random()])) for t in range(20) for i, k in (("a", "x"), ("b", "x"), ("c", "y"))], "ticker string, indicator_id string, category string, rank01 double")
    runs = spark.createDataFrame([(r, kind, i, draw.choice([0.0, draw.random()])) for r in range(1, 12) for kind, i in (("indicator", "a"), ("indicator", "b"), ("indicator", "c"), ("category", "x"), ("category", "y"))], "run int, kind string, id string, weight double")
    whole = sorted(map(tuple, scoring.many_totals(ranks, runs, 0.6).collect()), key=str)
    monkeypatch.setattr(scoring, "SLICE_RUNS", 2)
    monkeypatch.setattr(scoring, "BLOCK_TICKERS", 6)
    monkeypatch.setattr(scoring, "CELLS", 5)
    cut = scoring.many_totals(ranks, runs, 0.6)
    assert cut.rdd.getNumPartitions() == 4 * 6 * 4 and dict(cut.dtypes)["run"] == "int"
    assert sorted(map(tuple, cut.collect()), key=str) == whole and any(t is None for _, _, t in whole) and any(t is not None for _, _, t in whole)


def test_places_of_many_values(spark):
    """Values beyond the quantiles' accuracy, in many parts: ranges and places read the same quantiles, made once, and places are exact."""
    draw = random.Random(9)
    values = [draw.choice([draw.random(), draw.randint(0, 50) / 50]) for _ in range(60_000)]
    df = spark.createDataFrame([("k" if i % 2 else None, v) for i, v in enumerate(values)] + [("k", None)], "k string, v double").repartition(16)
    got = ranking.placed(df, "v", ["k"])
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["k"], r["v"]): (r["before"], r["count"], r["n"]) for r in got.collect()}
    for k, own in (("k", sorted(values[1::2])), (None, sorted(values[::2]))):
        want = {(k, v): (bisect.bisect_left(own, v), bisect.bisect_right(own, v) - bisect.bisect_left(own, v), len(own)) for v in own}
        assert {x: y for x, y in found.items() if x[0] == k} == want
    places = {r["v"]: r["place"] for r in ranking.ranked(df.where("k = 'k'"), "v", []).collect()}
    assert places == {v: b + (c + 1) / 2 for (k, v), (b, c, _) in found.items() if k == "k"}
    assert "percentile_approx" not in ranking.ranked(df, "v", ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_exact_quantiles(spark):
    """Quantiles from counts are those of percentile(), of null keys and keys without values too, and no task holds all values of a key."""
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.random(), 0.5, None])) for _ in range(3_000)] + [("one", 7.0), ("none", None)]
    df, shares = spark.createDataFrame(rows, "k string, v double"), {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p100": 1.0}
    got = aggregates.quantiles(df, ["k"], "v", shares)
    assert " percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = df.groupBy("k").agg(*[F.percentile("v", q).alias(name) for name, q in shares.items()])
    rounded = lambda t: sorted((str(r[0]), *[x if x is None else round(x, 12) for x in r[1:]]) for r in t.collect())
    assert rounded(got) == rounded(want) and len(rounded(got)) == 5
    plan = operator_queries.QUERIES["a05_quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_quarters_are_dealt_by_what_they_make(spark, tmp_path, monkeypatch):
    """Suppliers of one small file with wide results go to several tasks; before the first quarter there is none."""
    spark.createDataFrame([(k,) for k in range(400)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(linking_queries, "TASK_FRAMES", 1_000, raising=False)
    got = linking_queries.QUERIES["fd07_quarter_frames"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    frames = {r["s_suppkey"]: r["frames"] for r in got.collect()}
    assert len(frames) == 400 and frames[0] == "CY1999Q1I CY1998Q4I CY1998Q3I" and frames[399].startswith("CY2008Q4I CY2008Q3I ")
    days = spark.createDataFrame([("1998-07-01",), ("1998-06-30",), (None,)], "d string").select(dates.quarter_frames(1998, F.col("d").cast("date")).alias("q"))
    assert [r["q"] for r in days.collect()] == [["CY1998Q3I"], [], None]


def test_penalties_by_parts_of_orders(spark, monkeypatch):
    """The lines of orders are dealt in parts of a size, as many as the files ask for, not by the session's number."""
    monkeypatch.setattr(check_queries, "PART_BYTES", 5_000, raising=False)
    plan = check_queries.QUERIES["i08_penalty_intensity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) > 4
