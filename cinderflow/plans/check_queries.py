"""Queries of checks, indicators, entities and text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderflow.functions import text as TX
from cinderflow.functions.numbers import half_even, r6, ratio
from cinderflow.operators import checks as Q
from cinderflow.operators import entities as E
from cinderflow.operators import joins as J
from cinderflow.operators import ranking as R
from cinderflow.operators import scoring
from cinderflow.operators import timeseries as T
from cinderflow.operators.portfolio import companies
from cinderflow.plans import fixtures as X
from cinderflow.plans.operator_queries import _PAIRS, _QUARTERS, pairs, panel
from cinderflow.plans.score_queries import _RUNS_SQL, DRAWS, _ranks, weightings
from cinderflow.storage import sized

QUERIES, ORACLE = {}, {}
P = X.SQL


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _t(spark, d, name):
    return X.table(spark, d, name)


def sourced(spark, d):
    """Indicator rows as text with provenance, some of them broken by a rule."""
    k = F.col("ticker").cast("long")
    return X.facts(spark, d).select(
        "indicator_id", F.when(k % 97 == 0, F.lit("x1")).otherwise(F.col("ticker")).alias("ticker"), F.when(k % 89 == 0, F.lit("20x0")).otherwise(F.col("year").cast("string")).alias("year"),
        F.when(k % 83 == 0, F.lit("n/a")).otherwise(F.lit("1.5")).alias("value"), F.when(k % 79 == 0, F.lit(" ")).otherwise(F.lit("ledger")).alias("source"),
        F.when(F.col("indicator_id") == "env1", F.lit("http://all")).when(k % 73 == 0, F.lit("")).otherwise(F.concat(F.lit("http://x/"), "ticker")).alias("source_url"),
        F.when(k % 71 == 0, F.lit("2024/01/01")).otherwise(F.lit("2024-01-01")).alias("retrieved"),
    )


_SRC = P + """, src AS (SELECT indicator_id, CASE WHEN k % 97 = 0 THEN 'x1' ELSE ticker END AS ticker, CASE WHEN k % 89 = 0 THEN '20x0' ELSE CAST(year AS VARCHAR) END AS year, CASE WHEN k % 83 = 0 THEN 'n/a' ELSE '1.5' END AS value, CASE WHEN k % 79 = 0 THEN ' ' ELSE 'ledger' END AS source,
 CASE WHEN indicator_id = 'env1' THEN 'http://all' WHEN k % 73 = 0 THEN '' ELSE 'http://x/' || ticker END AS source_url, CASE WHEN k % 71 = 0 THEN '2024/01/01' ELSE '2024-01-01' END AS retrieved FROM (SELECT *, CAST(ticker AS BIGINT) AS k FROM facts))"""


@query(_SRC + """, s AS (SELECT *, count(*) OVER (PARTITION BY ticker, year) > 1 AS twice FROM src WHERE indicator_id = 'soc2')
SELECT 'ticker' AS rule, count(*) FILTER (trim(ticker) = '' OR ticker <> upper(ticker)) AS n_bad FROM s UNION ALL SELECT 'year', count(*) FILTER (try_cast(year AS DOUBLE) IS NULL OR try_cast(year AS DOUBLE) NOT BETWEEN 1990 AND 2100) FROM s UNION ALL SELECT 'value', count(*) FILTER (try_cast(value AS DOUBLE) IS NULL) FROM s
UNION ALL SELECT 'source', count(*) FILTER (trim(source) = '') FROM s UNION ALL SELECT 'source_url', count(*) FILTER (trim(source_url) = '') FROM s UNION ALL SELECT 'retrieved', count(*) FILTER (retrieved LIKE '%/%') FROM s UNION ALL SELECT 'duplicate', count(*) FILTER (twice) FROM s""")
def q01_validate(spark, d):
    return Q.indicator_findings(sourced(spark, d).where("indicator_id = 'soc2'"))


#: A catalogue as text, of all parts: ids, weights and the like are bad in many ways.
_LISTED = """SELECT CASE WHEN p_partkey % 7 = 3 THEN 'Bad id ' ELSE 'b' END || CAST(p_partkey - p_partkey % 11 % 2 AS STRING) AS indicator_id, CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' END AS higher_is_better,
CASE p_size % 5 WHEN 0 THEN '0' WHEN 1 THEN 'x' WHEN 2 THEN '-1' WHEN 3 THEN '2.5' ELSE '1' END AS weight, CASE p_partkey % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'soon' WHEN 2 THEN 'dropped' ELSE 'ready' END AS status,
CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 17 > 0 THEN p_type END AS unit FROM {part}"""


@query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY indicator_id) AS n FROM ({_LISTED.replace('{part}', 'part')})) SELECT rule, n_bad FROM (SELECT count(*) FILTER (NOT coalesce(regexp_matches(indicator_id, '^[a-z][a-z0-9_]*$'), false)) AS indicator_id,
count(*) FILTER (lower(coalesce(higher_is_better, '')) NOT IN ('true', 'false')) AS higher_is_better, count(*) FILTER (NOT coalesce(TRY_CAST(weight AS DOUBLE) > 0, false)) AS weight, count(*) FILTER (status NOT IN ('ready', 'planned', 'dropped')) AS status,
count(*) FILTER (status = 'ready' AND (trim(coalesce(name, '')) = '' OR trim(coalesce(unit, '')) = '')) AS ready_needs_text, count(*) FILTER (n > 1) AS duplicate FROM c) UNPIVOT (n_bad FOR rule IN (indicator_id, higher_is_better, weight, status, ready_needs_text, duplicate))""")
def q02_catalog(spark, d):
    return Q.catalog_findings(spark.sql(_LISTED, part=X.table(spark, d, "part")))


@query(P + "SELECT c.indicator_id, count(f.ticker) = 0 AS missing FROM catalog c LEFT JOIN facts f USING (indicator_id) GROUP BY 1")
def q03_repository(spark, d):
    f = X.facts(spark, d).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"))
    return X.catalog(spark).join(f, "indicator_id", "left").select("indicator_id", F.col("n").isNull().alias("missing"))


_AS_OF = P.replace("newest AS (SELECT indicator_id, ticker, max(year) AS year, arg_max(value, year) AS value FROM facts GROUP BY 1, 2)", "newest AS (SELECT indicator_id, ticker, max(year) AS year, arg_max(value, year) AS value FROM facts WHERE year <= 1999 GROUP BY 1, 2)").replace("n.year >= 2000", "n.year >= 1996")


@query(_AS_OF + """, sc AS (SELECT s.ticker, s.sector, s.total_score AS score FROM scores s JOIN universe u USING (ticker) JOIN primaries p ON p.primary_ticker = u.ticker WHERE s.total_score IS NOT NULL),
pc AS (SELECT *, (rank() OVER (PARTITION BY sector ORDER BY score) + (count(*) OVER (PARTITION BY sector, score) - 1) / 2.0) / count(*) OVER (PARTITION BY sector) AS p FROM sc),
b AS (SELECT CAST(CASE WHEN p <= 0.2 THEN 1 WHEN p <= 0.4 THEN 2 WHEN p <= 0.6 THEN 3 WHEN p <= 0.8 THEN 4 ELSE 5 END AS INTEGER) AS bucket, CASE WHEN ticker IN (SELECT ticker FROM bought WHERE year >= 2000 AND l_returnflag = 'R' AND l_quantity >= 48) THEN 1.0 ELSE 0.0 END AS hit FROM pc)
SELECT bucket, count(*) AS companies, CAST(sum(hit) AS DOUBLE) AS hits, round(CAST(avg(hit) AS DOUBLE), 6) AS share FROM b GROUP BY 1""")
def q04_point_in_time(spark, d):
    from dataclasses import replace

    profile = replace(X.PROFILE, min_year=1996)
    past = X.facts(spark, d).where("year <= 1999")
    first = scoring.primaries(X.universe(spark, d)).select(F.col("primary").alias("ticker"))
    table = scoring.score_profile(X.universe(spark, d), past, X.catalog(spark), profile).join(first, "ticker", "left_semi")
    later = X.bought(spark, d).where("year >= 2000 and l_returnflag = 'R' and l_quantity >= 48")
    got = Q.outcome_by_quintile(table.select("ticker", "sector", F.col("total_score").alias("score")), later)
    return got.select("bucket", "companies", "hits", r6(F.col("share")).alias("share"))


@query(P + _RUNS_SQL + """, m AS (SELECT run, t.ticker, t.total_score AS a, s.total_score AS b FROM totals t JOIN scores s USING (ticker) WHERE t.total_score IS NOT NULL AND s.total_score IS NOT NULL),
k AS (SELECT run, rank() OVER (PARTITION BY run ORDER BY a) + (count(*) OVER (PARTITION BY run, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY run ORDER BY b) + (count(*) OVER (PARTITION BY run, b) - 1) / 2.0 AS rb, count(*) OVER (PARTITION BY run) AS n FROM m)
SELECT run, count(*) AS n, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho, round(count(*) FILTER (1 - ra / n < 0.2 AND 1 - rb / n < 0.2) / CAST(count(*) FILTER (1 - rb / n < 0.2) AS DOUBLE), 6) AS top_kept FROM k GROUP BY 1""")
def q05_weight_robustness(spark, d):
    ranks = _ranks(spark, d)  # made once, for the weightings and for the default
    totals = scoring.many_totals(ranks.where("ticker = primary"), weightings(spark), X.PROFILE.min_weight_share)
    got = Q.weight_robustness(totals, scoring.score_ranks(X.universe(spark, d), ranks, X.PROFILE))
    return got.select("run", "n", r6(F.col("rho")).alias("rho"), r6(F.col("top_kept")).alias("top_kept"))


def _drawn(spark, d):
    first = scoring.primaries(X.universe(spark, d)).select(F.col("primary").alias("ticker"))
    ranks = _ranks(spark, d)
    default = scoring.score_ranks(X.universe(spark, d), ranks, X.PROFILE).join(first, "ticker", "left_semi")
    return ranks.where("ticker = primary"), scoring.drawn_weightings(X.catalog(spark), X.PROFILE, DRAWS), default, X.PROFILE.min_weight_share


@query()
def q05_weight_frequencies(spark, d):
    return Q.drawn_frequencies(*_drawn(spark, d))


@query()
def q05_weight_verdict(spark, d):
    return Q.drawn_verdict(*_drawn(spark, d))


@query(P + """, mv AS (SELECT * FROM (SELECT *, value - lag(value) OVER w AS delta, year - lag(year) OVER w AS gap FROM facts WINDOW w AS (PARTITION BY indicator_id, ticker ORDER BY year)) WHERE gap = 1),
nw AS (SELECT * FROM (SELECT *, max(year) OVER (PARTITION BY indicator_id) AS m FROM facts) WHERE year = m),
f1 AS (SELECT indicator_id, quantile_cont(delta, 0.25) AS q1, quantile_cont(delta, 0.75) AS q3 FROM mv GROUP BY 1 HAVING count(*) >= 20), f2 AS (SELECT indicator_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM nw GROUP BY 1 HAVING count(*) >= 20)
SELECT 'future' AS kind, indicator_id, ticker, year, round(value, 6) AS value FROM facts WHERE year > 2001 UNION ALL SELECT 'change', mv.indicator_id, ticker, year, round(value, 6) FROM mv JOIN f1 USING (indicator_id) WHERE q3 > q1 AND (delta < q1 - 3 * (q3 - q1) OR delta > q3 + 3 * (q3 - q1))
UNION ALL SELECT 'level', nw.indicator_id, ticker, year, round(value, 6) FROM nw JOIN f2 USING (indicator_id) WHERE q3 > q1 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))""")
def q06_plausibility(spark, d):
    return Q.plausibility(X.facts(spark, d), 2000).select("kind", "indicator_id", "ticker", "year", r6(F.col("value")).alias("value"))


@query(_PAIRS + "SELECT a, b, n, round_even(rho * 1000, 0) / 1000 AS rho, abs(rho) >= 0.8 AS flagged FROM rho WHERE n >= 50")
def q07_redundancy(spark, d):
    return pairs(spark, d).where("n >= 50").select("a", "b", "n", half_even(F.col("rho"), 3).alias("rho"), (F.abs("rho") >= 0.8).alias("flagged"))


@query(P + """, y2 AS (SELECT a.indicator_id, a.year, a.value AS x, b.value AS y FROM facts a JOIN facts b ON a.indicator_id = b.indicator_id AND a.ticker = b.ticker AND a.year = b.year + 1),
k AS (SELECT indicator_id, year, rank() OVER (PARTITION BY indicator_id, year ORDER BY x) + (count(*) OVER (PARTITION BY indicator_id, year, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY indicator_id, year ORDER BY y) + (count(*) OVER (PARTITION BY indicator_id, year, y) - 1) / 2.0 AS ry FROM y2)
SELECT indicator_id, year, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM k GROUP BY 1, 2 HAVING count(*) >= 100""")
def q08_stability(spark, d):
    return Q.stability(X.facts(spark, d)).select("indicator_id", "year", "n", r6(F.col("rho")).alias("rho"))


@query(P + "SELECT indicator_id, count(value) AS n, round(1 - count(DISTINCT value) / CAST(count(value) AS DOUBLE), 6) AS tie_ratio FROM newest GROUP BY 1 HAVING count(value) >= 20")
def q09_ties(spark, d):
    got = Q.tie_ratios(R.latest(X.facts(spark, d), ["indicator_id", "ticker"]))
    return got.select("indicator_id", "n", r6(F.col("tie_ratio")).alias("tie_ratio"))


@query(_SRC + "SELECT indicator_id, count(DISTINCT ticker) AS companies, count(*) AS rows, count(*) FILTER (trim(source_url) <> '') AS with_source, count(DISTINCT source_url) = 1 AND count(DISTINCT ticker) > 5 AS generic FROM src GROUP BY 1")
def q10_traceability(spark, d):
    return Q.traceability(sourced(spark, d))


@query("SELECT count(*) AS n, round(avg(CASE WHEN abs(o_totalprice - s) <= 0.01 * o_totalprice THEN 1.0 ELSE 0.0 END), 6) AS agree, avg(CASE WHEN abs(o_totalprice - s) <= 0.01 * o_totalprice THEN 1.0 ELSE 0.0 END) >= 0.7 AS passed FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q11_cross_source(spark, d):
    s = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    same = F.avg((F.abs(F.col("o_totalprice") - F.col("s")) <= 0.01 * F.col("o_totalprice")).cast("double"))
    return _t(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), r6(same).alias("agree"), (same >= 0.7).alias("passed"))


# ---------------------------------------------------------------- indicators
def _indicator(key):
    def f(spark, d):
        return X.facts(spark, d).where(F.col("indicator_id") == key).select("ticker", "year", r6(F.col("value")).alias("value"))

    return f


for _name, _key in (("i02_revenue_volatility", "eco2"),):
    QUERIES[_name] = _indicator(_key)
    ORACLE[_name] = P + f"SELECT ticker, year, round(value, 6) AS value FROM facts WHERE indicator_id = '{_key}'"


@query(P + "SELECT a.ticker, a.year, round(pow(CAST(a.n AS DOUBLE) / b.n, CAST(1 AS DOUBLE) / 3) - 1, 6) AS value FROM order_years a JOIN order_years b ON a.ticker = b.ticker AND a.year = b.year + 3 WHERE CAST(a.n AS DOUBLE) / b.n BETWEEN 0.15 AND 6")
def i03_employment_growth(spark, d):
    met = T.lagged(X.order_years(spark, d).select("ticker", "year", F.col("n").cast("double").alias("value")), ["ticker"], 3).withColumn("q", F.col("value") / F.col("then"))
    return met.where("q between 0.15 and 6").select("ticker", "year", r6(F.pow("q", F.lit(1 / 3)) - 1).alias("value"))


#: Bytes of a table's files that a task of i08 gets.
PART_BYTES = 8 << 20


@query(P + """, pen AS (SELECT ticker, year, sum(l_extendedprice / m) AS v FROM bought JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1) ON l_orderkey = k WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT y.ticker, y.year, round(coalesce((SELECT sum(v) FROM pen WHERE pen.ticker = y.ticker AND pen.year BETWEEN y.year - 4 AND y.year), 0) / y.mean * 1000, 6) AS value FROM
(SELECT a.ticker, a.year, avg(b.total) AS mean FROM order_years a JOIN order_years b ON a.ticker = b.ticker AND b.year BETWEEN a.year - 4 AND a.year GROUP BY 1, 2 HAVING count(*) >= 3) y""")
def i08_penalty_intensity(spark, d):
    from cinderflow.operators.aggregates import equal_split

    # Dealt by order in parts of a size, for the count of members and for the joins: what a task holds doesn't grow with the tables.
    lines, size = sized(X.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.year("l_shipdate").alias("year")), "lines")
    dealt = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "l_orderkey")
    members = equal_split(dealt, ["l_orderkey"], "l_suppkey", "l_extendedprice").where("l_returnflag = 'R'").select("l_orderkey", "year", "share")
    owners = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("ticker"))
    pen = members.join(owners, "l_orderkey").groupBy("ticker", "year").agg(F.sum("share").alias("v"))
    y = X.order_years(spark, d)
    w = Window.partitionBy("ticker").orderBy("year").rangeBetween(-4, 0)
    both = y.join(pen, ["ticker", "year"], "full")
    told = both.withColumn("_s", F.coalesce(F.sum("v").over(w), F.lit(0.0))).withColumn("_m", F.avg("total").over(w)).withColumn("_n", F.count("total").over(w))
    return told.where("total is not null and _n >= 3").select("ticker", "year", r6(F.col("_s") / F.col("_m") * 1000).alias("value"))


@query(P + """, risk AS (SELECT p_brand, sum(v * v) / (sum(v) * sum(v)) AS hhi FROM (SELECT p_brand, s_nationkey, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1),
ex AS (SELECT ticker, year, p_brand, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY ticker, year) AS share FROM bought JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT ticker, year, round(sum(share * hhi), 6) AS value, arg_max(p_brand, (round(share * hhi, 9), p_brand)) AS top FROM ex JOIN risk USING (p_brand) GROUP BY 1, 2""")
def i09_supply_risk(spark, d):
    from cinderflow.operators.aggregates import herfindahl

    p, s = _t(spark, d, "part").select("p_partkey", "p_brand"), _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    risk = lines.groupBy("p_brand", "s_nationkey").agg(F.sum("l_extendedprice").alias("v")).groupBy("p_brand").agg(herfindahl(F.col("v")).alias("hhi"))
    by = X.bought(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "year", "p_brand").agg(F.sum("l_extendedprice").alias("v"))
    ex = by.withColumn("x", F.col("v") / F.sum("v").over(Window.partitionBy("ticker", "year"))).join(risk, "p_brand").withColumn("c", F.col("x") * F.col("hhi"))
    return ex.groupBy("ticker", "year").agg(r6(F.sum("c")).alias("value"), F.max_by("p_brand", F.struct(F.round("c", 9), "p_brand")).alias("top"))


_SUITS = _QUARTERS + ", ret AS (SELECT o_custkey AS k, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS p, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2), pn AS (SELECT k, p, v, coalesce(c, 0) AS c FROM panel LEFT JOIN ret USING (k, p))"


@query(P + _SUITS + "SELECT k, p, round(sc / nullif(sv, 0) * 1000000, 6) AS value FROM (SELECT k, p, sum(c) OVER w AS sc, sum(v) OVER w AS sv, count(*) OVER w AS n FROM pn WINDOW w AS (PARTITION BY k ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4")
def i13_litigation(spark, d):
    ret = X.bought(spark, d).where("l_returnflag = 'R'").groupBy(F.col("o_custkey").alias("k"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    pn = panel(spark, d).join(ret, ["k", "p"], "left").na.fill(0, ["c"])
    got = pn.withColumn("sc", T.trailing(F.col("c"), ["k"], "p", 4)).withColumn("sv", T.trailing(F.col("v"), ["k"], "p", 4))
    return got.where("sc is not null").select("k", "p", r6(ratio(F.col("sc").cast("double"), F.col("sv")) * 1e6).alias("value"))


# ---------------------------------------------------------------- entities
@query("SELECT p_type || ' ' || CAST(p_size AS VARCHAR) AS name, min(p_brand) AS entity FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def e02_unambiguous(spark, d):
    return E.unambiguous(_t(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("entity")))


@query("""WITH l AS (SELECT l_orderkey AS record, l_suppkey AS entity, l_suppkey % 10 AS company, l_linenumber AS strength FROM lineitem), b AS (SELECT record, min(strength) AS s FROM l GROUP BY 1), t AS (SELECT l.* FROM l JOIN b ON l.record = b.record AND strength = s)
SELECT record, entity, company, strength FROM t WHERE record IN (SELECT record FROM t GROUP BY 1 HAVING count(DISTINCT company) = 1)""")
def e03_conflict(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("entity"), (F.col("l_suppkey") % 10).alias("company"), F.col("l_linenumber").alias("strength"))
    return E.resolve_conflicts(l).select("record", "entity", "company", "strength")


@query("""WITH nm AS (SELECT p_name AS name, min(p_partkey) AS entity FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), sb AS (SELECT p_type AS name, min(p_partkey) AS entity FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS name FROM part)
SELECT r.id, r.name, coalesce(i.p_partkey, nm.entity, sb.entity) AS entity, CASE WHEN i.p_partkey IS NOT NULL THEN 'id' WHEN nm.entity IS NOT NULL THEN 'name' WHEN sb.entity IS NOT NULL THEN 'subsidiary' END AS tier
FROM r LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0) i ON i.p_partkey = r.id LEFT JOIN nm ON nm.name = r.name LEFT JOIN sb ON sb.name = r.name""")
def e01_tiered(spark, d):
    p = _t(spark, d, "part")
    records = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("name"))
    ids = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("entity"))
    named = lambda c: p.select(F.col(c).alias("name"), F.col("p_partkey").alias("entity"))
    return E.tiered(records, ids, named("p_name"), named("p_type")).select("id", "name", "entity", "tier")


@query(P + "SELECT cik, primary_ticker AS ticker FROM primaries")
def e09_primary(spark, d):
    return scoring.primaries(X.universe(spark, d)).select("cik", F.col("primary").alias("ticker"))


@query(P + "SELECT cik, min(ticker) AS ticker FROM universe GROUP BY 1")
def e10_holding(spark, d):
    u = X.universe(spark, d)
    return companies(u.select("ticker", "name", "sector"), u).select("cik", "ticker")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS text FROM part)
SELECT t.p_partkey, n.name FROM t JOIN n ON string_split(n.name, ' ')[1] IN (SELECT unnest(string_split(t.text, ' '))) AND contains(' ' || t.text || ' ', ' ' || n.name || ' ')""")
def j22_token_block(spark, d):
    p = _t(spark, d, "part")
    texts = p.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return J.token_candidates(p.select(F.col("p_name").alias("name")).distinct(), texts, "name", "text").select("p_partkey", "name")


# ---------------------------------------------------------------- text
_WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT p_partkey, array_to_string(list_filter(string_split(" + _WORDS.format("p_name || ' Holdings, Inc. ' || p_type") + ", ' '), lambda x: x NOT IN ('inc','corp','corporation','company','co','ltd','llc','plc','the','group','holdings')), ' ') AS name, regexp_replace(" + _WORDS.format("p_name || ' Holdings, Inc.'") + ", '(?: (?:inc|corp|corporation|company|co|ltd|llc|plc|group|holdings))+$', '') AS core FROM part")
def fs04_normalise(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", TX.normalised_name(F.concat("p_name", F.lit(" Holdings, Inc. "), "p_type")).alias("name"), TX.core_name(F.concat("p_name", F.lit(" Holdings, Inc."))).alias("core"))


@query("SELECT url_id AS page_id, CASE WHEN s = '' THEN 'profile' ELSE s END AS slug, regexp_replace(url, '(?i)((?:api_?key|token|utm_source)=)[^&#]*', '\\1***', 'g') AS redacted FROM (SELECT page_id AS url_id, url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)")
def fs02_slug_redact(spark, d):
    return _t(spark, d, "pages").select("page_id", TX.slug(F.col("url")).alias("slug"), TX.redacted(F.col("url")).alias("redacted"))


@query("""SELECT k AS l_orderkey, trim(regexp_replace(p, '\\([0-9.]+%\\)', '', 'g')) AS name, round(coalesce(try_cast(regexp_extract(p, '\\(([0-9.]+)%\\)', 1) AS DOUBLE) / 100, 1.0), 6) AS share FROM
(SELECT k, unnest(string_split(t, ';')) AS p FROM (SELECT l_orderkey AS k, string_agg('S' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_suppkey % 2 = 0 THEN ' (' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5%)' ELSE '' END, '; ' ORDER BY l_suppkey, l_quantity) AS t FROM lineitem GROUP BY 1)) WHERE trim(p) <> ''""")
def fs11_owner_parse(spark, d):
    one = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" ("), F.col("l_quantity").cast("int").cast("string"), F.lit(".5%)"))).otherwise(""))
    t = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_quantity", one.alias("x")))), lambda s: s["x"]), "; ").alias("t"))
    return t.select("l_orderkey", F.explode(TX.owners(F.col("t"))).alias("o")).select("l_orderkey", "o.name", r6(F.col("o.share")).alias("share"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def x01_html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", TX.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)</?(?:b|i|u|em|strong|span|font|a)(?: [^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")
def x02_inline_text(spark, d):
    return _t(spark, d, "pages").select("page_id", TX.inline_text(F.col("html")).alias("text"))


@query("""WITH s AS (SELECT doc_id, trim(unnest(string_split(replace(text, chr(10), ' '), '. '))) AS s FROM documents), k AS (SELECT doc_id, s, 2 * CASE WHEN len(regexp_extract_all(lower(s), '\\b(?:percent|million|billion|employees|hours|tons|reduced|increased|invested)\\b|[0-9]+')) > 0 THEN 1 ELSE 0 END
 + len(regexp_extract_all(lower(s), '\\b(?:safety|training|diversity|turnover|union|benefits|wages|retention)\\b')) - 2 * len(regexp_extract_all(lower(s), '\\b(?:may|might|could|believe|aim|strive|seek|intend)\\b')) AS score FROM s WHERE length(s) >= 20)
SELECT doc_id, s AS sentence, CAST(score AS INTEGER) AS score FROM k WHERE score >= 2""")
def x09_concrete_sentences(spark, d):
    s = _t(spark, d, "documents").select("doc_id", F.explode(TX.sentences(F.col("text"))).alias("sentence"))
    return s.withColumn("score", TX.sentence_score(F.col("sentence"))).where("score >= 2").select("doc_id", "sentence", F.col("score").cast("int").alias("score"))


@query("SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(lower(text || ' safety Training wages'), '\\b(?:safety|training|diversity|turnover|union|benefits|wages|retention)\\b'))) AS INTEGER) AS topics FROM conversations")
def x11_topic_score(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", TX.topic_score(F.concat("text", F.lit(" safety Training wages"))).cast("int").alias("topics"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 1000000.0 WHEN 1 THEN o_custkey * 1000.0 ELSE o_custkey END AS DOUBLE) AS n FROM orders")
def fs12_scaled_number(spark, d):
    k = F.col("o_orderkey") % 3
    t = F.concat(F.lit("about "), F.format_number("o_custkey", 0), F.when(k == 0, " million").when(k == 1, " thousand").otherwise(""))
    return _t(spark, d, "orders").select("o_orderkey", TX.scaled_number(t).alias("n"))
