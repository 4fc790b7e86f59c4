"""Queries of the scoring core."""

from pyspark.sql import functions as F

from cinderflow.config import CATEGORIES
from cinderflow.functions.numbers import half_even, r6
from cinderflow.operators import ranking, scoring
from cinderflow.plans import fixtures as X
from cinderflow.storage import written

CW = X.PROFILE.category_weights


def _ranks(spark, d, profile=X.PROFILE):
    """The ranks, written: every branch of a query reads them."""
    return written(scoring.profile_ranks(X.universe(spark, d), X.facts(spark, d), scoring.indicator_weights(X.catalog(spark), profile), profile), "ranks")


def _score(spark, d, facts=None):
    return scoring.score_profile(X.universe(spark, d), X.facts(spark, d) if facts is None else facts, X.catalog(spark), X.PROFILE)


def c10_score_profile(spark, d):
    s = _score(spark, d)
    return s.select("ticker", "name", "sector", "position", "total_score", "total_weight_share", *[f"{c}_{x}" for c in CATEGORIES for x in ("score", "n_indicators", "weight_share")])


def c02_latest_value(spark, d):
    return ranking.latest(X.facts(spark, d), ["indicator_id", "ticker"]).select("indicator_id", "ticker", "year", r6(F.col("value")).alias("value"))


def c04_rank_sector(spark, d):
    return _ranks(spark, d).where("ticker = primary and rank01 is not null").select("indicator_id", "ticker", "sector", r6(F.col("rank01")).alias("rank01"))


def c04_rank_universe(spark, d):
    from dataclasses import replace

    got = _ranks(spark, d, replace(X.PROFILE, sector_relative=False))
    return got.where("ticker = primary and rank01 is not null").select("indicator_id", "ticker", r6(F.col("rank01")).alias("rank01"))


def c05_profile_ranks(spark, d):
    return _ranks(spark, d).select("ticker", "primary", "indicator_id", "year", r6(F.col("rank01")).alias("rank01"))


def c08_weighted_coverage(spark, d):
    got = scoring.category_scores(_ranks(spark, d), X.PROFILE.min_weight_share)
    return got.select("ticker", "category", r6(F.col("score")).alias("score"), "n_indicators", r6(F.col("weight_share")).alias("weight_share"))


def c09_active_categories(spark, d):
    """Categories that weigh in a score, of a catalogue of parts' brands: indicators whose weight is above 0, times the profile's weight of the category."""
    kind = F.element_at(F.array(*map(F.lit, [*CW, "unweighed"])), (F.col("p_size") % (len(CW) + 1) + 1).cast("int"))
    catalog = X.table(spark, d, "part").select(F.col("p_brand").alias("indicator_id"), kind.alias("category"), (F.col("p_partkey") % 3 - 1).cast("double").alias("weight"))
    cat = scoring.indicator_weights(catalog, X.PROFILE)
    weight = F.create_map(*[x for c, w in CW.items() for x in (F.lit(c), F.lit(w))])[F.col("category")]
    return cat.groupBy("category").agg(F.count(F.lit(1)).alias("indicators"), F.first(weight).alias("weight")).where("weight > 0")


#: Weightings 1..20, from a rule both engines can follow: a weight is 0.05 + 0.95 * ((run * a + i * b) mod 97) / 97.
RUNS = 20


def weightings(spark):
    rows = []
    for run in range(1, RUNS + 1):
        for i, (k, *_) in enumerate(X.CATALOG):
            rows.append((run, "indicator", k, 0.05 + 0.95 * ((run * 31 + i * 17) % 97) / 97))
        for i, c in enumerate(CATEGORIES):
            rows.append((run, "category", c, 0.05 + 0.95 * ((run * 13 + i * 41) % 97) / 97))
    return spark.createDataFrame(rows, "run int, kind string, id string, weight double")


def c11_many_weightings(spark, d):
    return scoring.many_totals(_ranks(spark, d).where("ticker = primary"), weightings(spark), X.PROFILE.min_weight_share)


#: The robustness check's own weightings: so many seeded draws. No SQL: DuckDB can't follow numpy's draws.
DRAWS = 1000


def drawn_totals(spark, d):
    runs = scoring.drawn_weightings(X.catalog(spark), X.PROFILE, DRAWS)
    return scoring.many_totals(_ranks(spark, d).where("ticker = primary"), runs, X.PROFILE.min_weight_share)


def c11_drawn_weightings(spark, d):
    return drawn_totals(spark, d)


def c12_explain(spark, d):
    ranks = _ranks(spark, d)
    got = scoring.explain(ranks, scoring.category_scores(ranks, X.PROFILE.min_weight_share), CW)
    return got.select("ticker", "category", "indicator_id", r6(F.col("rank01")).alias("rank01"), r6(F.col("share_in_category")).alias("share_in_category"), r6(F.col("points")).alias("points"))


def c13_peers(spark, d):
    return scoring.peers(_ranks(spark, d), "7", "soc2").select("ticker", r6(F.col("value")).alias("value"), "position")


def c14_category(spark, d):
    """One category with catalog weights over entities with an even key, ranked across sectors after the filter."""
    some = X.universe(spark, d).where("ordinal % 2 = 0").select("ticker")
    cat = X.catalog(spark).where("category = 'social'")
    newest = ranking.latest(X.facts(spark, d), ["indicator_id", "ticker"]).join(some, "ticker", "left_semi").join(F.broadcast(cat), "indicator_id")
    ranked = newest.withColumn("rank01", ranking.rank01(F.col("value"), ["indicator_id"], F.col("higher_is_better")))
    grid = ranked.select("ticker").distinct().crossJoin(F.broadcast(cat)).join(ranked.select("ticker", "indicator_id", "rank01"), ["ticker", "indicator_id"], "left")
    got = scoring.category_scores(grid, X.PROFILE.min_weight_share)
    return got.select("ticker", half_even(F.col("score"), 1).alias("score"), "n_indicators", half_even(F.col("weight_share"), 2).alias("weight_share"))


def c16_sector_medians(spark, d):
    s = _score(spark, d).where("sector is not null and sector <> ''")
    return s.groupBy("sector").agg(*[r6(F.percentile(f"{c}_score", 0.5)).alias(f"{c}_median") for c in CATEGORIES], r6(F.percentile("total_score", 0.5)).alias("total_median"), F.count("total_score").alias("n"))


def c17_fingerprints(spark, d):
    got = _ranks(spark, d).where("rank01 is not null").withColumn("p", F.rint(F.col("rank01") * 100).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("indicator_id", "p"))), lambda x: F.concat(x["indicator_id"], F.lit(":"), x["p"].cast("string"))), ",")
    return got.groupBy("ticker").agg(text.alias("fingerprint"))


def h01_meta(spark, d):
    """Coverage and year range of each indicator, as the service's start page shows them."""
    f, n = X.facts(spark, d), X.universe(spark, d).agg(F.count(F.lit(1)).alias("n_all"))
    by = f.groupBy("indicator_id").agg(F.countDistinct("ticker").alias("companies"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return by.crossJoin(F.broadcast(n)).join(F.broadcast(X.catalog(spark)), "indicator_id").select("indicator_id", "category", "companies", "first_year", "last_year", r6(F.col("companies") / F.col("n_all")).alias("coverage"))


P = X.SQL
_RUNS_SQL = """, runs AS (SELECT CAST(range AS INTEGER) AS run FROM range(1, 21)),
wi AS (SELECT run, indicator_id, 0.05 + CAST(0.95 AS DOUBLE) * ((run * 31 + i * 17) % 97) / 97 AS w FROM runs CROSS JOIN (VALUES ('eco1',0),('eco2',1),('soc1',2),('soc2',3),('env1',4),('env2',5)) t(indicator_id, i)),
wc AS (SELECT run, category, 0.05 + CAST(0.95 AS DOUBLE) * ((run * 13 + i * 41) % 97) / 97 AS cw FROM runs CROSS JOIN (VALUES ('economic',0),('social',1),('environmental',2)) t(category, i)),
rc AS (SELECT run, ticker, category, sum(rank01 * w) / nullif(sum(CASE WHEN rank01 IS NOT NULL THEN w END), 0) * 100 AS score, coalesce(sum(CASE WHEN rank01 IS NOT NULL THEN w END), 0) / sum(w) AS sh
  FROM ranks JOIN wi USING (indicator_id) WHERE ticker = primary_ticker GROUP BY 1, 2, 3),
rs AS (SELECT run, ticker, category, CASE WHEN sh >= 0.6 THEN score END AS score FROM rc),
rt AS (SELECT run, ticker, sum(score / 100 * cw) / nullif(sum(CASE WHEN score IS NOT NULL THEN cw END), 0) * 100 AS t, coalesce(sum(CASE WHEN score IS NOT NULL THEN cw END), 0) / sum(cw) AS sh FROM rs JOIN wc USING (run, category) GROUP BY 1, 2),
totals AS (SELECT run, ticker, CASE WHEN sh >= 0.6 THEN round_even(t * 10, 0) / 10 END AS total_score FROM rt)
"""
ORACLE = {
    "c10_score_profile": P + "SELECT * REPLACE (CAST(position AS INTEGER) AS position) FROM scores",
    "c02_latest_value": P + "SELECT indicator_id, ticker, year, round(value, 6) AS value FROM newest",
    "c04_rank_sector": P + "SELECT indicator_id, ticker, sector, round(rank01, 6) AS rank01 FROM ranks WHERE ticker = primary_ticker AND rank01 IS NOT NULL",
    "c04_rank_universe": P + """, u AS (SELECT indicator_id, ticker, higher_is_better, rank() OVER (PARTITION BY indicator_id ORDER BY value) + (count(*) OVER (PARTITION BY indicator_id, value) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY indicator_id) AS n
      FROM dense WHERE ticker = primary_ticker AND value IS NOT NULL)
      SELECT indicator_id, ticker, round(CASE WHEN n = 1 THEN 0.5 WHEN higher_is_better THEN (ar - 1) / (n - 1) ELSE 1 - (ar - 1) / (n - 1) END, 6) AS rank01 FROM u""",
    "c05_profile_ranks": P + 'SELECT ticker, primary_ticker AS "primary", indicator_id, year, round(rank01, 6) AS rank01 FROM ranks',
    "c08_weighted_coverage": P + "SELECT ticker, category, round(score, 6) AS score, n_indicators, round(weight_share, 6) AS weight_share FROM cats",
    "c09_active_categories": "SELECT category, count(*) AS indicators, any_value(w) AS weight FROM (SELECT CASE p_size % " + str(len(CW) + 1) + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CW)) + " END AS category, CASE p_size % " + str(len(CW) + 1) + " " + " ".join(f"WHEN {i} THEN CAST({w} AS DOUBLE)" for i, w in enumerate(CW.values())) + " END AS w FROM part WHERE p_partkey % 3 - 1 > 0) WHERE w > 0 GROUP BY 1",
    "c11_many_weightings": P + _RUNS_SQL + "SELECT run, ticker, total_score FROM totals",
    "c12_explain": P + """, sh AS (SELECT ticker, category, cw / sum(cw) OVER (PARTITION BY ticker) AS cs FROM cats JOIN catw USING (category) WHERE score IS NOT NULL),
      own AS (SELECT *, coalesce(CASE WHEN rank01 IS NOT NULL THEN weight END / nullif(sum(CASE WHEN rank01 IS NOT NULL THEN weight END) OVER (PARTITION BY ticker, category), 0), 0) AS sic FROM ranks)
      SELECT ticker, category, indicator_id, round(rank01, 6) AS rank01, round(CAST(sic AS DOUBLE), 6) AS share_in_category, round(coalesce(rank01 * 100 * sic * coalesce(cs, 0), 0), 6) AS points FROM own LEFT JOIN sh USING (ticker, category)""",
    "c13_peers": P + """SELECT ticker, round(value, 6) AS value, CAST(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS DOUBLE) AS position FROM dense
      WHERE indicator_id = 'soc2' AND value IS NOT NULL AND ticker = primary_ticker AND sector = (SELECT sector FROM universe WHERE ticker = '7')""",
    "c14_category": P + """, v AS (SELECT n.indicator_id, n.ticker, n.value, c.higher_is_better, rank() OVER (PARTITION BY n.indicator_id ORDER BY value) + (count(*) OVER (PARTITION BY n.indicator_id, value) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY n.indicator_id) AS n
        FROM newest n JOIN catalog c ON n.indicator_id = c.indicator_id AND category = 'social' WHERE n.ticker IN (SELECT ticker FROM universe WHERE ordinal % 2 = 0)),
      r AS (SELECT indicator_id, ticker, CASE WHEN n = 1 THEN 0.5 WHEN higher_is_better THEN (ar - 1) / (n - 1) ELSE 1 - (ar - 1) / (n - 1) END AS rank01 FROM v),
      g AS (SELECT t.ticker, c.weight, r.rank01 FROM (SELECT DISTINCT ticker FROM r) t CROSS JOIN (SELECT * FROM catalog WHERE category = 'social') c LEFT JOIN r ON r.ticker = t.ticker AND r.indicator_id = c.indicator_id),
      a AS (SELECT ticker, sum(rank01 * weight) / nullif(sum(CASE WHEN rank01 IS NOT NULL THEN weight END), 0) * 100 AS s, count(rank01) AS n, coalesce(sum(CASE WHEN rank01 IS NOT NULL THEN weight END), 0) / sum(weight) AS sh FROM g GROUP BY 1)
      SELECT ticker, CASE WHEN sh >= 0.6 THEN round_even(s * 10, 0) / 10 END AS score, n AS n_indicators, round_even(CAST(sh AS DOUBLE) * 100, 0) / 100 AS weight_share FROM a""",
    "c16_sector_medians": P + "SELECT sector, round(quantile_cont(economic_score, 0.5), 6) AS economic_median, round(quantile_cont(social_score, 0.5), 6) AS social_median, round(quantile_cont(environmental_score, 0.5), 6) AS environmental_median, round(quantile_cont(total_score, 0.5), 6) AS total_median, count(total_score) AS n FROM scores WHERE sector <> '' GROUP BY 1",
    "c17_fingerprints": P + "SELECT ticker, string_agg(indicator_id || ':' || CAST(CAST(round_even(rank01 * 100, 0) AS INTEGER) AS VARCHAR), ',' ORDER BY indicator_id) AS fingerprint FROM ranks WHERE rank01 IS NOT NULL GROUP BY 1",
    "h01_meta": P + "SELECT indicator_id, category, count(DISTINCT ticker) AS companies, min(year) AS first_year, max(year) AS last_year, round(count(DISTINCT ticker) / CAST((SELECT count(*) FROM universe) AS DOUBLE), 6) AS coverage FROM facts JOIN catalog USING (indicator_id) GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (c10_score_profile, c02_latest_value, c04_rank_sector, c04_rank_universe, c05_profile_ranks, c08_weighted_coverage, c09_active_categories, c11_many_weightings, c11_drawn_weightings, c12_explain, c13_peers, c14_category, c16_sector_medians, c17_fingerprints, h01_meta)}
