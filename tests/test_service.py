"""Answers, kept results, evidence, and the sources and sinks around them."""

import bz2
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cinderflow import config, service
from cinderflow.functions import arrays, extract
from cinderflow.operators import joins, linking, market, scoring
from cinderflow.plans import fixtures as X
from cinderflow.sources import files
from cinderflow.storage import settled, ship_package, small

DIR = "/root/testdata/sf0.001"


def inputs(spark):
    return X.universe(spark, DIR), X.facts(spark, DIR), X.catalog(spark)


def test_request_weights():
    base = config.Profile("p", {"economic": 1.0, "social": 2.0, "environmental": 3.0}, {"a": 1.0})
    assert service.asked_profile(base) == base
    got = service.asked_profile(base, {"social": 5}, {"b": 2, "a": 0})
    assert got.category_weights == {"economic": 0.0, "social": 5.0, "environmental": 0.0} and got.indicator_weights == {"a": 0.0, "b": 2.0}
    with pytest.raises(ValueError):
        service.asked_profile(base, None, {"a": -1})


def test_answer_and_kept_scores_agree(spark, tmp_path, capsys):
    profile = config.Profile("mine", indicator_weights={"nothing": 1.0}, min_year=2000)
    answer = service.score_answer(*inputs(spark), profile)
    kept = service.build_scores(*inputs(spark), profile, f"file://{tmp_path}")
    assert "nothing" in capsys.readouterr().out
    rows = lambda df: sorted((r["ticker"], r["position"], r["total_score"]) for r in df.collect())
    assert rows(answer["rows"]) == rows(kept) and answer["counts"].first()["scored"] == sum(t is not None for *_, t in rows(kept))
    assert (tmp_path / "mine" / "indicator_ranks").is_dir()
    points = {r["ticker"]: json.loads(r["points"]) for r in answer["fingerprints"].collect()}
    assert all(0 <= p <= 100 for one in points.values() for p in one.values())


def test_many_totals_equal_score_profile(spark):
    """Every weighting's totals, from one row a ticker, are those that the profile of these weights gets."""
    u, f, c = inputs(spark)
    profile = config.Profile("p", min_year=2000)
    runs = scoring.drawn_weightings(c, profile, 3)
    ranks = scoring.profile_ranks(u, f, scoring.indicator_weights(c, profile), profile)
    got = {(r["run"], r["ticker"]): r["total_score"] for r in scoring.many_totals(ranks, runs, 0.5).collect()}
    weights = {}
    for r in runs.collect():
        weights.setdefault(r["run"], {}).setdefault(r["kind"], {})[r["id"]] = r["weight"]
    for run, w in weights.items():
        one = config.Profile("q", w["category"], w["indicator"], min_year=2000)
        for r in scoring.score_profile(u, f, c, one).collect():
            assert (got[run, r["ticker"]] is None) == (r["total_score"] is None)
            assert r["total_score"] is None or abs(got[run, r["ticker"]] - r["total_score"]) < 0.1001


def test_evidence_and_audit(spark):
    u, f, c = inputs(spark)
    got = service.evidence("weight_robustness", u, f, c, config.Profile("p", min_year=2000), runs=5).first()
    assert got["runs"] == 5 and 0 <= got["median_rho"] <= 1
    with pytest.raises(KeyError):
        service.evidence("nothing", u, f, c, config.Profile("p"))
    none = spark.createDataFrame([], "entity string, text string")
    notes, cases, air = (spark.createDataFrame([], s) for s in ("ticker string, indicator_id string, year int, note string", "cik string, case string, year int, penalty double", "ticker string, year int, tonnes double"))
    with pytest.raises(KeyError):
        service.audit(u, "nobody", none, notes, cases, air)
    assert all(df.count() == (name == "company") for name, df in service.audit(u, "7", none, notes, cases, air).items())


def test_checks_are_kept_and_registered(spark, tmp_path):
    assert {r["status"] for r in service.stored_checks(spark, f"file://{tmp_path}/none", ["a", "b"]).collect()} == {"not_run"}
    files.write_result(spark.createDataFrame([("x", float("nan"))], "k string, v double"), f"file://{tmp_path}/c/a", "a", "passed")
    got = {r["id"]: (r["status"], r["ran_at"] is not None) for r in service.stored_checks(spark, f"file://{tmp_path}/c", ["a", "b"]).collect()}
    assert got == {"a": ("passed", True), "b": ("not_run", False)}
    assert service.as_records(spark.createDataFrame([("x", float("nan"), 1)], "k string, v double, n int")) == ['{"k":"x","v":null,"n":1}']

    @service.indicator("test_only")
    def build(session):
        return session.range(1)

    with pytest.raises(ValueError):
        service.indicator("test_only")(build)
    del service.INDICATORS["test_only"]


def test_paged_and_quoted_sources(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for k, ids in enumerate([[1, 2], [2, 3], []]):
        (tmp_path / "pages" / f"p{k}.json").write_text(json.dumps({"results": [{"id": i, "name": f"n{i}", "more": 1} for i in ids], "pages": 3}))
    assert sorted(map(tuple, files.read_pages(spark, f"file://{tmp_path}/pages", "id int, name string", "id").collect())) == [(1, "n1"), (2, "n2"), (3, "n3")]
    (tmp_path / "dump.csv.bz2").write_bytes(bz2.compress(b'id,title,x\n1,"a, ""b""\nc",z\n007,plain,\n'))
    assert sorted(map(tuple, files.read_quoted_dump(spark, f"file://{tmp_path}/dump.csv.bz2", {1: "title", 0: "id"}).collect())) == [('a, "b"\nc', "1"), ("plain", "007")]
    (tmp_path / "entities").mkdir()
    (tmp_path / "entities" / "AA.json").write_text('{"dockets": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "entities" / "BB.json").write_text("null")
    assert sorted(map(tuple, files.read_entities(spark, f"file://{tmp_path}/entities", "k int", "dockets").collect())) == [("AA", 1), ("AA", 2)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "cobalt_ore_1.json").write_text('{"hits": [{"cik": "1", "year": 2020}, {"cik": "1", "year": 2020}]}')
    (tmp_path / "m" / "other_1.json").write_text('{"hits": [{"cik": "1", "year": 2020}]}')
    assert list(map(tuple, files.read_mentions(spark, f"file://{tmp_path}/m", {"cobalt_ore": "cobalt"}).collect())) == [("1", 2020, "cobalt")]


def test_indicators_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2020, 1.0, "s", "http://x", "2024-01-01", "")], "ticker string, year int, value double, source string, source_url string, retrieved string, note string").withColumn("retrieved", F.to_date("retrieved"))
    for name in ("one", "two", "one"):
        files.write_indicator(rows, f"file://{tmp_path}/i", name)
    assert sorted(r["indicator_id"] for r in spark.read.parquet(f"file://{tmp_path}/i").collect()) == ["one", "two"]


def test_one_to_one_refuses_twins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="right"):
        joins.one_to_one(a, b, ["k"])
    assert joins.one_to_one(a, b.limit(1), ["k"]).count() == 2


def test_cover_pages_scale_and_skip(spark):
    ship_package(spark)
    page = """<th class="tl"><div>in millions</div></th><th class="th"><div>Jan 2, 2024</div></th><tr><a defref_dei_TradingSymbol'></a><td class="text">n/a</td></tr>
    <tr><a defref_dei_EntityCommonStockSharesOutstanding'></a><td class="nump">$ 1.5</td></tr><tr><a defref_x_Axis=B'></a></tr><tr><a defref_dei_TradingSymbol'></a><td class="text">bb</td></tr>
    <tr><a defref_dei_EntityCommonStockSharesOutstanding'></a><td class="nump">$ 2.5</td></tr>"""
    got = market.cover_counts(spark.createDataFrame([(1, page), (2, None), (3, "<p>"), (4, page.replace("Jan 2", "Feb. 30"))], "k int, p string"), "k", "p").collect()
    assert sorted((r["k"], r["symbol"], r["shares"], str(r["as_of"])) for r in got) == [(1, "BB", 2.5e6, "2024-01-02"), (4, "BB", 2.5e6, "None")]


def test_sentences_go_on_behind_abbreviations(spark):
    said = "In 2021 the U.S. Environmental Protection Agency fined Acme Corp. Together with Mr. Smith it agreed to pay $4 million for the spill of hazardous waste. The rest is about goods sold in stores last year."
    got = service.passages(spark.createDataFrame([("a", said), ("b", None)], "entity string, text string")).collect()
    assert {r["sentence"] for r in got} == {said[: said.index(" The rest")]}


def test_lists_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("", "a"), ("x|y||x", "b")], "p string, q string")
    got = df.select(arrays.unpiped(F.col("p")).alias("l")).collect()
    assert [r["l"] for r in got] == [[], [], ["x", "y", "x"]]
    assert [r["m"] for r in df.select(linking.distinctive_tokens(F.col("p")).alias("m")).collect()] == [None, [], []]


def test_settled_and_small(spark, tmp_path):
    spark.range(100).write.parquet(f"file://{tmp_path}/r")
    scan = spark.read.parquet(f"file://{tmp_path}/r")
    assert settled(scan, "x") is scan and settled(scan.repartition(3), "x") is not scan
    assert "BroadcastExchange" in scan.join(small(scan.withColumnRenamed("id", "b"), 100), F.col("id") == F.col("b"))._jdf.queryExecution().executedPlan().toString()


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "cinderflow", *a], capture_output=True, text=True, timeout=300)
    listed = run("queries")
    assert listed.returncode == 0 and "c10_score_profile" in listed.stdout
    assert run("nonsense").returncode == 2
    assert run("portfolio", DIR, f"file://{tmp_path}/out").returncode == 0 and list((tmp_path / "out" / "balanced" / "portfolio").glob("part-*.csv"))
