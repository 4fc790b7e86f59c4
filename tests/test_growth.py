"""Steps whose tasks must not grow with the tables."""

import os

import numpy as np
import pandas as pd
import pytest

from cinderflow.operators import aggregates, checks, ranking
from cinderflow.plans import check_queries, fixtures, portfolio_queries

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_lines_are_dealt_by_customer_once(spark, monkeypatch):
    """Lines by order, orders, and what they make by customer: three exchanges, in parts that follow the size of the files."""
    monkeypatch.setattr(fixtures, "PART_BYTES", 1 << 13)
    got = fixtures.line_years(spark, DIR)
    assert plan(got).count("Exchange hashpartitioning") == 3
    lines = os.path.getsize(f"{DIR}/lineitem.parquet")
    assert f", {-(-lines // (1 << 13))})" in plan(got).replace(", REPARTITION_BY_NUM", ")")
    assert fixtures.dealt(spark.range(10), "id", 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_latest_needs_no_sort(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("b", 2, 5.0), ("b", 1, 6.0)], "k string, year int, v double")
    got = ranking.latest(df, ["k"])
    assert "SortAggregate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 3, None), ("b", 2, 5.0)]


@pytest.mark.parametrize("query, module", [("v14_climate", portfolio_queries), ("q05_weight_robustness", check_queries)])
@tables
def test_facts_are_made_once(spark, monkeypatch, query, module):
    made, facts = [], fixtures.facts
    monkeypatch.setattr(fixtures, "facts", lambda *a: made.append(1) or facts(*a))
    module.QUERIES[query](spark, DIR)
    assert len(made) == 1


def test_rank_correlation_by_counts(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(x), float(y)) for k in ("a", "b") for x, y in zip(rng.integers(0, 9, 60), rng.integers(0, 40, 60), strict=True)] + [("a", None, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    pairs = {(r["k"], r["x"], r["y"]): r for r in aggregates.paired_ranks(df, ["k"], "x", "y").collect()}
    held = pd.DataFrame(rows, columns=["k", "x", "y"]).dropna()
    by = held.groupby("k")
    held = held.assign(rx=by["x"].rank(), ry=by["y"].rank())
    for r in held.itertuples():
        assert (pairs[r.k, r.x, r.y]["rx"], pairs[r.k, r.x, r.y]["ry"]) == (r.rx, r.ry)
    assert sum(r["count"] for r in pairs.values()) == len(held)
    got = {r["k"]: r for r in aggregates.spearman(df, ["k"], "x", "y").collect()}
    assert got["c"]["rho"] is None and got["c"]["n"] == 2
    for k in ("a", "b"):
        one = held[held["k"] == k]
        assert got[k]["n"] == 60 and got[k]["rho"] == pytest.approx(one["rx"].corr(one["ry"]))


def test_fences_by_counts(spark, monkeypatch):
    """Fences are numpy's quartiles, and no aggregate holds the values of a key."""
    rows = [(k, float(v)) for k, n in (("a", 41), ("b", 30)) for v in np.random.default_rng(n).normal(size=n)] + [("b", None), *[("c", 2.0)] * 5]
    got = {r["k"]: r for r in aggregates.fences(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("a", "b"):
        q1, q3 = np.quantile([v for g, v in rows if g == k and v is not None], [0.25, 0.75])
        assert (got[k]["low"], got[k]["high"]) == pytest.approx((q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)))
    assert got["b"]["n"] == 30 and got["c"]["low"] is None and got["c"]["high"] is None
    facts = spark.createDataFrame([("i", str(t), y, float(t % 7 + 100 * (t == 3) * (y == 2001))) for t in range(30) for y in (2000, 2001)], "indicator_id string, ticker string, year int, value double")
    found = checks.plausibility(facts, 2000)
    assert "percentile(" not in plan(found)
    assert {(r["kind"], r["ticker"]) for r in found.collect()} == {("level", "3")}


@tables
def test_pages_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """The pages' table is one part; its files are made by as many tasks as there are cores, a file a page."""
    from cinderflow.plans import final_queries

    monkeypatch.setattr(final_queries, "fresh_path", lambda *a: f"file://{tmp_path}/tree")
    got = final_queries.s12_html_documents(spark, DIR)
    files = list((tmp_path / "tree").glob("page_id=*/part-*"))
    assert len({f.name.split("-")[1] for f in files}) == spark.sparkContext.defaultParallelism
    assert len(files) == got.count() == spark.read.parquet(f"{DIR}/pages.parquet").where("html is not null").count()


def test_a_text_is_searched_once(spark):
    """spots() names its search once, and its places are those of the matches, also where there are none."""
    from pyspark.sql import functions as F

    from cinderflow.functions.spots import spots

    df = spark.createDataFrame([(1, "a1b22c"), (2, "none"), (3, None), (4, "7")], "id int, text string").repartition(1)
    got = df.select("id", spots(F.col("text"), "[0-9]+").alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {r["id"]: [tuple(x) for x in r["s"]] for r in got.collect()} == {1: [(1, "1"), (3, "22")], 2: [], 3: [], 4: [(0, "7")]}


def _weighted(spark, monkeypatch):
    """Ranks with gaps, seven weightings, and a default that lacks a score or has no ranks here and there; counted in small blocks, chunks and parts of the runs."""
    from cinderflow import config
    from cinderflow.operators import scoring

    for name, n in {"LEAST_COUNTED": 9, "MOST_COUNTED": 20, "RUNS_AT_ONCE": 3, "CHUNK": 8, "TILE": 16, "SLICE_RUNS": 2}.items():
        monkeypatch.setattr(scoring, name, n)
    catalog = [("a", "economic", 1.0), ("b", "economic", 2.0), ("off", "social", 0.0), ("c", "social", 1.0), ("d", "environmental", 1.0)]
    rng = np.random.default_rng(3)
    r = np.where(rng.uniform(0, 1, (80, 5)) < 0.25, np.nan, np.round(rng.uniform(0, 1, (80, 5)), 1))
    rows = [(f"t{k:02}", c, i, None if np.isnan(r[k, j]) else float(r[k, j])) for k in range(80) for j, (i, c, _) in enumerate(catalog) if i != "off"]
    ranks = spark.createDataFrame(rows, "ticker string, category string, indicator_id string, rank01 double")
    default = spark.createDataFrame([(f"t{k:02}", None if k % 11 == 0 else k % 20 / 10) for k in range(82)], "ticker string, total_score double")
    table = spark.createDataFrame(catalog, "indicator_id string, category string, weight double")
    return ranks, scoring.drawn_weightings(table, config.Profile("p", {"economic": 1.0, "social": 1.0, "environmental": 0.0}), 7), default


def test_verdict_from_counts_made_in_tasks(spark, monkeypatch):
    """The verdict on totals that are never rows is the one on many_totals()' rows."""
    from cinderflow.operators import scoring

    ranks, runs, default = _weighted(spark, monkeypatch)
    want = checks.weight_verdict(scoring.many_totals(ranks, runs, 0.6), default, 7).collect()[0].asDict()
    got = checks.drawn_verdict(ranks, runs, default, 0.6).collect()[0].asDict()
    assert got == {k: v if not isinstance(v, float) else pytest.approx(v, abs=1e-12) for k, v in want.items()} and want["companies"] == 74


@tables
def test_verdict_makes_no_row_a_company_and_run(spark, monkeypatch):
    from cinderflow.operators import scoring

    monkeypatch.setattr(scoring, "many_totals", None)
    assert check_queries.q05_weight_verdict(spark, DIR).collect()[0]["runs"] == 1000


@tables
def test_frequencies_come_from_a_companys_row(spark, monkeypatch):
    """Shares are those of many_totals()' rows; a company is counted in its task, so nothing is joined or added up after."""
    from cinderflow.operators import scoring

    with monkeypatch.context() as m:
        ranks, runs, default = _weighted(spark, m)
        want = sorted(map(tuple, checks.weight_frequencies(scoring.many_totals(ranks, runs, 0.6), default, 7).collect()))
        assert sorted(map(tuple, checks.drawn_frequencies(ranks, runs, default, 0.6).collect())) == want and any(x[2] for x in want) and any(x[3] for x in want)
    made = plan(check_queries.q05_weight_frequencies(spark, DIR))
    assert "Join" not in made and "Aggregate" not in made and made.count("Exchange") == 1


def test_pages_make_plain_files(spark, tmp_path, monkeypatch):
    """In a local folder a page is one file and nothing beside it, pages that share an id too; what is written again takes its place, and few tasks read them."""
    from cinderflow.plans import final_queries
    from cinderflow.sources import files

    rows = [(k, f"u{k}", f"<p>é\n{k}</p>") for k in range(40)] + [(3, "twice", "<p>other</p>"), (50, "none", None), (51, "empty", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    monkeypatch.setattr(final_queries, "fresh_path", lambda *a: f"file://{tmp_path}/tree")
    monkeypatch.setattr(files, "READ_TASKS", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a file a task otherwise
    try:
        got = [final_queries.s12_html_documents(spark, f"file://{tmp_path}") for _ in range(2)][1]
        assert sorted(map(tuple, got.collect())) == sorted([(k, "UTF-8", f"é {k}") for k in range(40)] + [(3, "UTF-8", "other"), (51, "UTF-8", "")])
        assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = [f for f in (tmp_path / "tree").rglob("*") if f.is_file()]
    assert len(made) == 42 and all(f.name.startswith("part-") for f in made)


def test_tree_in_other_stores(spark, tmp_path):
    """A store that only Spark reaches gets the same documents from Spark's writer."""
    from cinderflow.sources import files

    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.trees.link./t", f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, "b")], "k long, html string")
    files.write_tree(df, "viewfs://trees/t/far")
    assert sorted(r["text"] for r in files.read_html(spark, "viewfs://trees/t/far").collect()) == ["a", "b"]
