"""Queries of the fund, market data, risk and stress."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderflow.config import portfolio_settings
from cinderflow.functions.numbers import half_even, r6, ratio
from cinderflow.operators import market as M
from cinderflow.operators import portfolio as V
from cinderflow.operators import ranking as R
from cinderflow.plans import fixtures as X
from cinderflow.plans.operator_queries import splits
from cinderflow.plans.score_queries import _score
from cinderflow.storage import written

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


SETTINGS = {"max_weight": 0.02, "tilt_strength": 2.0}


def _scores(spark, d, facts=None):
    return _score(spark, d, facts).select("ticker", "name", "sector", "total_score", "economic_score", "social_score", "environmental_score")


def fund(spark, d, scores=None, **more):
    """The fund, written: what follows reads its one row a company."""
    return written(V.allocate(_scores(spark, d) if scores is None else scores, X.universe(spark, d), portfolio_settings(X.PROFILE, {**SETTINGS, **more})), "fund")


def fund_sql(tilt=2.0, neutral=True):
    """CTEs co .. fund, after the scoring CTEs."""
    n = "CASE WHEN sum(t) OVER s > 0 THEN t * sum(e) OVER s / sum(t) OVER s ELSE e END" if neutral else "t"
    return X.SQL + f""", held AS (SELECT cik, min(ticker) AS ticker, count(*) AS classes FROM universe GROUP BY 1),
co AS (SELECT u.ticker, u.name, u.sector, u.sub_industry, u.cap, u.cik, s.total_score, s.economic_score, s.social_score, s.environmental_score,
    (SELECT string_agg(o.ticker, ', ' ORDER BY o.ticker) FROM universe o WHERE o.cik = u.cik AND o.ticker <> u.ticker AND h.classes > 1) AS other_classes FROM held h JOIN universe u ON u.ticker = h.ticker JOIN scores s ON s.ticker = u.ticker),
b1 AS (SELECT *, coalesce(cap, 0) / sum(coalesce(cap, 0)) OVER () AS b FROM co),
b2 AS (SELECT *, sub_industry = 'FURNITURE' AS policy, CASE WHEN sub_industry = 'FURNITURE' THEN 0 ELSE b END AS e0 FROM b1),
b3 AS (SELECT *, e0 / sum(e0) OVER () AS e FROM b2),
b4 AS (SELECT *, avg(CASE WHEN e > 0 THEN total_score END) OVER () AS m, stddev_pop(CASE WHEN e > 0 THEN total_score END) OVER () AS sd FROM b3),
b5 AS (SELECT *, coalesce((total_score - m) / nullif(sd, 0), 0) AS z FROM b4),
b6 AS (SELECT *, e * exp(least(greatest({tilt} * z, -20), 20)) AS t0 FROM b5),
b7 AS (SELECT *, t0 / sum(t0) OVER () AS t FROM b6),
b8 AS (SELECT *, {n} AS n0 FROM b7 WINDOW s AS (PARTITION BY sector)),
b9 AS (SELECT *, n0 / sum(n0) OVER () AS n FROM b8)"""


#: Water filling of b9.n under 0.02 by sector, by rounds: 40 rounds of (capped set, scale) are far more than needed.
CAP_SQL = """, c1 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY n DESC, ticker) - 1 AS r, sum(n) OVER (PARTITION BY sector) AS tt, sum(n) OVER (PARTITION BY sector ORDER BY n DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b9),
c2 AS (SELECT *, (tt - r * 0.02) / nullif(rest, 0) AS sc FROM c1),
c3 AS (SELECT *, min(CASE WHEN n > 0 AND n * sc <= 0.02 + 1e-12 THEN r END) OVER (PARTITION BY sector) AS fr FROM c2),
c4 AS (SELECT *, max(CASE WHEN r = fr THEN sc END) OVER (PARTITION BY sector) AS fs FROM c3),
c5 AS (SELECT *, CASE WHEN n <= 0 THEN 0.0 WHEN fr IS NULL OR r < fr THEN 0.02 ELSE n * fs END AS filled FROM c4),
d1 AS (SELECT *, 1 - sum(filled) OVER () AS spill, CASE WHEN n > 0 AND 0.02 - filled > 1e-12 THEN 0.02 - filled END AS room, CASE WHEN n > 0 AND 0.02 - filled > 1e-12 THEN n END AS tw FROM c5),
d2 AS (SELECT *, row_number() OVER o AS nr, coalesce(sum(room) OVER (ORDER BY room / tw NULLS LAST, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(tw) OVER (ORDER BY room / tw NULLS LAST, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tr FROM d1 WINDOW o AS (ORDER BY room / tw NULLS LAST, ticker)),
d3 AS (SELECT *, (spill - bef) / nullif(tr, 0) AS lv FROM d2),
d4 AS (SELECT *, min(CASE WHEN tw IS NOT NULL AND tw * lv <= room THEN nr END) OVER () AS fn FROM d3),
d5 AS (SELECT *, max(CASE WHEN nr = fn THEN lv END) OVER () AS fl FROM d4),
fund AS (SELECT *, filled + CASE WHEN tw IS NULL OR spill <= 1e-12 THEN 0 WHEN fn IS NULL OR nr < fn THEN room ELSE tw * fl END AS w FROM d5),
fs AS (SELECT *, CASE WHEN b <= 0 THEN 'no_market_cap' WHEN policy THEN 'excluded_policy' WHEN w <= 0 THEN 'excluded_score' ELSE 'held' END AS status FROM fund)
"""
FUND = fund_sql() + CAP_SQL


@query(fund_sql() + "SELECT ticker, cik, coalesce(other_classes, '') AS other_classes FROM co")
def v01_companies(spark, d):
    return V.companies(_score(spark, d), X.universe(spark, d)).select("ticker", "cik", "other_classes")


@query(fund_sql() + "SELECT ticker, round(b, 9) AS benchmark_weight FROM b1")
def v02_benchmark(spark, d):
    held = written(V.companies(_score(spark, d), X.universe(spark, d)), "companies")
    return V.scaled(held, "b", F.coalesce("cap", F.lit(0.0))).select("ticker", F.round("b", 9).alias("benchmark_weight"))


@query(fund_sql() + "SELECT ticker, policy, round(e, 9) AS eligible FROM b3")
def v03_exclusion(spark, d):
    return fund(spark, d).select("ticker", "policy", F.round("eligible", 9).alias("eligible"))


@query(fund_sql() + "SELECT ticker, round(z, 6) AS z FROM b5")
def v04_z(spark, d):
    return fund(spark, d).select("ticker", r6(F.col("z")).alias("z"))


@query(fund_sql() + "SELECT ticker, round(t, 9) AS tilted FROM b7")
def v05_tilt(spark, d):
    return fund(spark, d).select("ticker", F.round("tilted", 9).alias("tilted"))


@query(fund_sql() + """, x1 AS (SELECT *, total_score IS NOT NULL AND e > 0 AS sc FROM b5), x2 AS (SELECT *, count(*) FILTER (sc) OVER () AS n, row_number() OVER (ORDER BY CASE WHEN sc THEN 0 ELSE 1 END, total_score, ticker) AS nr FROM x1),
x3 AS (SELECT ticker, CASE WHEN sc AND nr <= floor(n * 0.2) THEN 0 ELSE e END AS w FROM x2) SELECT ticker, round(w / sum(w) OVER (), 9) AS weight FROM x3""")
def v06_exclude_worst(spark, d):
    return fund(spark, d, method="exclude").select("ticker", F.round("tilted", 9).alias("weight"))


@query(fund_sql() + "SELECT ticker, round(n, 9) AS neutral FROM b9")
def v07_neutral(spark, d):
    return fund(spark, d).select("ticker", F.round("neutral", 9).alias("neutral"))


@query(FUND + "SELECT ticker, round(filled, 9) AS filled FROM c5")
def v08_cap(spark, d):
    return V.waterfill(fund(spark, d), "neutral", SETTINGS["max_weight"], ["sector"], "filled").select("ticker", F.round("filled", 9).alias("filled"))


@query(FUND + "SELECT ticker, round(w, 9) AS weight FROM fund")
def v09_cap_spill(spark, d):
    return fund(spark, d).select("ticker", F.round("weight", 9).alias("weight"))


@query(FUND + "SELECT ticker, round(w, 9) AS weight, round(b, 9) AS benchmark_weight, round(w - b, 9) AS active_weight, status FROM fs")
def v11_allocate(spark, d):
    return fund(spark, d).select("ticker", F.round("weight", 9).alias("weight"), F.round("benchmark_weight", 9).alias("benchmark_weight"), F.round("active_weight", 9).alias("active_weight"), "status")


@query(FUND + """SELECT ticker, status, CASE status WHEN 'no_market_cap' THEN 'left out: its market cap is not known' WHEN 'excluded_policy' THEN 'left out by policy (' || sub_industry || ')' WHEN 'excluded_score' THEN 'left out by its score of ' || printf('%.1f', total_score)
  ELSE 'held at ' || printf('%.2f', w / e) || ' of its index weight' || CASE WHEN w >= 0.02 - 1e-9 THEN ' up to the cap' ELSE '' END || CASE WHEN total_score IS NULL THEN ': not scored' ELSE ': scored ' || printf('%.1f', total_score) || ' (' || printf('%+.2f', z) || ' deviations)' END || '; tilt of 2, sector weights kept' END
  || CASE WHEN coalesce(other_classes, '') <> '' THEN '; stands for ' || other_classes || ' too' ELSE '' END AS reason FROM fs""")
def v12_reasons(spark, d):
    return fund(spark, d).select("ticker", "status", "reason")


@query(FUND + """SELECT count(*) FILTER (w > 0) AS holdings, count(*) AS companies, count(*) FILTER (status = 'excluded_policy') AS excluded_policy, count(*) FILTER (status = 'excluded_score') AS excluded_score, count(*) FILTER (status = 'no_market_cap') AS no_market_cap,
 round(max(w), 6) AS max_weight, round(sum(abs(w - b)) / 2, 6) AS active_share, round(coalesce(sum(CASE WHEN total_score IS NULL THEN w END), 0), 6) AS unscored_weight,
 round(sum(CASE WHEN total_score IS NOT NULL AND w > 0 THEN total_score * w END) / sum(CASE WHEN total_score IS NOT NULL AND w > 0 THEN w END), 6) AS score, round(sum(CASE WHEN total_score IS NOT NULL AND w > 0 THEN w END) / sum(CASE WHEN w > 0 THEN w END), 6) AS score_cover,
 round(sum(CASE WHEN total_score IS NOT NULL AND b > 0 THEN total_score * b END) / sum(CASE WHEN total_score IS NOT NULL AND b > 0 THEN b END), 6) AS index_score, round(sum(CASE WHEN total_score IS NOT NULL AND b > 0 THEN b END) / sum(CASE WHEN b > 0 THEN b END), 6) AS index_cover,
 round((SELECT sum(w) FROM (SELECT w FROM fs ORDER BY w DESC LIMIT 10)), 6) AS top10_weight, round((SELECT sum(b) FROM (SELECT b FROM fs ORDER BY b DESC LIMIT 10)), 6) AS top10_benchmark_weight FROM fs""")
def v13_summary(spark, d):
    s = V.summary(fund(spark, d))
    return s.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(FUND + "SELECT sector, round(sum(w), 6) AS portfolio, round(sum(b), 6) AS benchmark, round(sum(w) - sum(b), 6) AS active FROM fs GROUP BY 1")
def v13_sectors(spark, d):
    return V.sector_table(fund(spark, d)).select("sector", *[r6(F.col(c)).alias(c) for c in ("portfolio", "benchmark", "active")])


@query(FUND + """, k AS (SELECT fs.*, i.value AS i, CAST(l.total AS INTEGER) % 5 AS l FROM fs LEFT JOIN newest i ON i.ticker = fs.ticker AND i.indicator_id = 'env1' LEFT JOIN order_years l ON l.ticker = fs.ticker AND l.year = 2000)
SELECT round(sum(CASE WHEN i IS NOT NULL AND w > 0 THEN i * w END) / sum(CASE WHEN i IS NOT NULL AND w > 0 THEN w END), 6) AS intensity_portfolio, round(sum(CASE WHEN l >= 2 AND w > 0 THEN w END) / sum(CASE WHEN l IS NOT NULL AND w > 0 THEN w END), 6) AS target_portfolio, round(sum(CASE WHEN l = 4 THEN w END) / sum(CASE WHEN l IS NOT NULL THEN w END), 6) AS validated_portfolio,
 round(sum(CASE WHEN i IS NOT NULL AND b > 0 THEN i * b END) / sum(CASE WHEN i IS NOT NULL AND b > 0 THEN b END), 6) AS intensity_benchmark, round(sum(CASE WHEN l >= 2 AND b > 0 THEN b END) / sum(CASE WHEN l IS NOT NULL AND b > 0 THEN b END), 6) AS target_benchmark, round(sum(CASE WHEN l = 4 THEN b END) / sum(CASE WHEN l IS NOT NULL THEN b END), 6) AS validated_benchmark FROM k""")
def v14_climate(spark, d):
    facts = X.facts(spark, d)  # made once, for the scores and for the intensity
    i = R.latest(facts.where("indicator_id = 'env1'"), ["indicator_id", "ticker"])
    l = X.order_years(spark, d).where("year = 2000").select("ticker", (F.rint("total").cast("int") % 5).alias("value"))
    s = V.climate(fund(spark, d, _scores(spark, d, facts)), i, l)
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


@query(FUND + "SELECT ticker, round_even(w * 1000000, 0) AS usd FROM fs WHERE w > 0")
def v15_dollars(spark, d):
    return V.with_dollars(fund(spark, d), 1e6).where("weight > 0").select("ticker", "usd")


@query(X.SQL + "SELECT max(month) AS month FROM (SELECT month FROM prices GROUP BY 1 HAVING count(DISTINCT symbol) >= 0.95 * (SELECT count(*) FROM supplier))")
def k04_latest_month(spark, d):
    return M.latest_month(X.prices(spark, d), X.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n")))


@query(X.SQL + """, sh AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS as_of, o_totalprice AS shares, CASE WHEN o_orderkey % 2 = 0 THEN 'frame' ELSE 'cover' END AS source FROM orders),
sp AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day, 1 + l_discount AS ratio FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 49),
q AS (SELECT CAST(c_custkey AS VARCHAR) AS cik, m AS month, last_day(CAST(m || '-01' AS DATE)) AS e FROM customer CROSS JOIN (VALUES ('1998-06'), ('2000-06')) t(m)),
a AS (SELECT q.cik, q.month, sh.* EXCLUDE (cik) FROM q JOIN sh ON q.cik = sh.cik AND sh.as_of <= e AND date_diff('day', sh.as_of, e) <= 400 QUALIFY sh.as_of = max(sh.as_of) OVER (PARTITION BY q.cik, q.month)),
l AS (SELECT DISTINCT cik, month, symbol, as_of, shares FROM a QUALIFY source = 'frame' OR NOT bool_or(source = 'frame') OVER (PARTITION BY cik, month)),
f AS (SELECT l.*, (SELECT coalesce(product(ratio), 1.0) FROM sp WHERE sp.symbol = l.symbol AND sp.day > l.as_of) AS factor FROM l),
c AS (SELECT f.cik, f.month, sum(shares * close * factor) AS cap, bool_or(close IS NULL) AS gap FROM f LEFT JOIN prices p ON p.symbol = f.symbol AND p.month = f.month GROUP BY 1, 2)
SELECT q.cik, q.month, round(CASE WHEN NOT gap THEN cap END, 2) AS cap FROM q LEFT JOIN c USING (cik, month)""")
def k05_caps(spark, d):
    n = X.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    o = X.table(spark, d, "orders").crossJoin(F.broadcast(n))
    shares = o.select(F.col("o_custkey").cast("string").alias("cik"), (F.col("o_custkey") % F.col("n") + 1).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("as_of"), F.col("o_totalprice").alias("shares"), F.when(F.col("o_orderkey") % 2 == 0, "frame").otherwise("cover").alias("source"))
    months = spark.createDataFrame([("1998-06",), ("2000-06",)], "month string")
    asked = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cik")).crossJoin(F.broadcast(months))
    return M.caps(shares, X.prices(spark, d), splits(spark, d), asked).select("cik", "month", F.round("cap", 2).alias("cap"))


_RET = X.SQL + """, ret AS (SELECT a.symbol, a.month, a.close / nullif(b.close, 0) - 1 AS ret FROM prices a JOIN prices b ON a.symbol = b.symbol AND CAST(a.month || '-01' AS DATE) = CAST(b.month || '-01' AS DATE) + INTERVAL 1 MONTH WHERE a.close IS NOT NULL AND b.close <> 0),
sw AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END AS w, 1.0 AS b FROM supplier),
mf AS (SELECT month, sum(ret * w) / sum(w) AS f FROM ret JOIN sw USING (symbol) WHERE w > 0 GROUP BY 1), mb AS (SELECT month, sum(ret * b) / sum(b) AS i FROM ret JOIN sw USING (symbol) GROUP BY 1)
"""


def _supplier_fund(spark, d):
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"), F.lit(1.0).alias("benchmark_weight"))


@query(_RET + "SELECT month, round(f, 6) AS ret FROM mf")
def k06_returns(spark, d):
    got = M.series(M.returns(X.prices(spark, d)), _supplier_fund(spark, d).select("symbol", "weight"))
    return got.select("month", r6(F.col("ret")).alias("ret"))


@query(_RET + """, g AS (SELECT month, f, product(1 + f) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT * FROM mf ORDER BY month DESC LIMIT 36)), h AS (SELECT *, g / max(g) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g)
SELECT round(pow(arg_max(g, month), 12.0 / count(*)) - 1, 6) AS annual_return, round(stddev_samp(f) * sqrt(12), 6) AS volatility, round(min(dd), 6) AS max_drawdown, round(arg_max(g, month) - 1, 6) AS total_return, count(*) AS months FROM h""")
def k07_stats(spark, d):
    s = M.stats(M.last_months(M.series(M.returns(X.prices(spark, d)), _supplier_fund(spark, d).select("symbol", "weight")), 36), "ret")
    return s.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(_RET + ", j AS (SELECT * FROM mf JOIN mb USING (month) ORDER BY month DESC LIMIT 36) SELECT count(*) AS months, round(stddev_samp(f - i) * sqrt(12), 6) AS tracking_error, round(covar_pop(f, i) / nullif(stddev_pop(f) * stddev_pop(i), 0), 6) AS correlation FROM j HAVING count(*) >= 12")
def k08_risk_report(spark, d):
    return M.risk_report(M.returns(X.prices(spark, d)), _supplier_fund(spark, d)).select("months", r6(F.col("tracking_error")).alias("tracking_error"), r6(F.col("correlation")).alias("correlation"))


_EXPO = ", ex AS (SELECT ticker, q AS tonnes, CASE WHEN CAST(ticker AS BIGINT) % 11 <> 0 THEN e - 100000 END AS pretax FROM line_years WHERE year = 2000)"


def exposure(spark, d):
    b = X.bought(spark, d).where("year = 2000").groupBy("ticker").agg(F.sum("l_quantity").alias("tonnes"), F.sum("l_extendedprice").alias("e"))
    return b.select("ticker", "tonnes", F.when(F.col("ticker").cast("long") % 11 != 0, F.col("e") - 100000).alias("pretax"))


_RISK = "CASE WHEN coalesce(tonnes, 0) <= 0 THEN 0.0 WHEN pretax <= 0 THEN CASE WHEN price > 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN pretax IS NOT NULL THEN least(greatest(tonnes * price / pretax, 0), 1) END END"


@query(X.SQL + _EXPO + f"SELECT ticker, round(tonnes, 6) AS tonnes, round(pretax, 4) AS pretax, round({_RISK}, 6) AS risk FROM (SELECT *, 130.0 AS price FROM ex)")
def k10_profit_at_risk(spark, d):
    risk = M.profit_at_risk(F.col("tonnes"), F.col("pretax"), F.lit(130.0))
    return exposure(spark, d).select("ticker", r6(F.col("tonnes")).alias("tonnes"), F.round("pretax", 4).alias("pretax"), r6(risk).alias("risk"))


def _curve_sql(before, funds):
    return before + _EXPO + f""", fu AS ({funds}), pr AS (SELECT CAST(p AS DOUBLE) AS price FROM (VALUES (0),(25),(50),(75),(100),(130),(175),(200),(250)) t(p)),
z AS (SELECT fund, price, weight, CASE WHEN tonnes IS NOT NULL THEN {_RISK} END AS risk FROM fu LEFT JOIN ex USING (ticker) CROSS JOIN pr WHERE weight > 0)
SELECT fund, price, round(sum(risk * weight) / nullif(sum(CASE WHEN risk IS NOT NULL THEN weight END), 0), 6) AS risk, round(coalesce(sum(CASE WHEN risk IS NOT NULL THEN weight END), 0) / sum(weight), 6) AS covered, round(coalesce(sum(CASE WHEN risk >= 0.25 THEN weight END), 0) / nullif(sum(CASE WHEN risk IS NOT NULL THEN weight END), 0), 6) AS heavy_share FROM z GROUP BY 1, 2"""


def _curve(spark, d, funds):
    s = M.stress(exposure(spark, d), funds)
    return s.select("fund", "price", *[r6(F.col(c)).alias(c) for c in ("risk", "covered", "heavy_share")])


@query(_curve_sql(FUND, "SELECT 'fund' AS fund, ticker, w AS weight FROM fs UNION ALL SELECT 'index', ticker, b FROM fs"))
def k11_stress_curve(spark, d):
    f = fund(spark, d)
    long = f.unpivot("ticker", ["weight", "benchmark_weight"], "k", "w")
    return _curve(spark, d, long.select(F.when(F.col("k") == "weight", "fund").otherwise("index").alias("fund"), "ticker", F.col("w").alias("weight")))


@query(_curve_sql(FUND, "SELECT 'fund' AS fund, ticker, w AS weight FROM fs UNION ALL SELECT 'index', ticker, b FROM fs UNION ALL SELECT 'exclusion', ticker, e FROM b3"))
def k13_three_funds(spark, d):
    """The index, exclusions alone (no tilt, no cap that binds), and the fund."""
    s = written(_scores(spark, d), "scores")
    f, plain = fund(spark, d, s), fund(spark, d, s, tilt_strength=0.0, max_weight=1.0)
    pick = lambda df, name, c: df.select(F.lit(name).alias("fund"), "ticker", F.col(c).alias("weight"))
    return _curve(spark, d, pick(f, "fund", "weight").unionByName(pick(f, "index", "benchmark_weight")).unionByName(pick(plain, "exclusion", "weight")))


_DEC = """, de AS (SELECT ticker, CASE WHEN status = 'excluded_policy' THEN 'excluded' WHEN coalesce(w / nullif(b, 0), 1) < 0.9 THEN 'less' WHEN coalesce(w / nullif(b, 0), 1) > 1.1 THEN 'more' ELSE 'same' END AS decision FROM fs)"""


@query(FUND + _DEC + """SELECT n_name AS state, round(coalesce(sum(q) FILTER (decision = 'excluded'), 0), 6) AS excluded, round(coalesce(sum(q) FILTER (decision = 'less'), 0), 6) AS less, round(coalesce(sum(q) FILTER (decision = 'same'), 0), 6) AS same, round(coalesce(sum(q) FILTER (decision = 'more'), 0), 6) AS more, round(sum(q), 6) AS total
 FROM (SELECT n_name, coalesce(decision, 'same') AS decision, sum(l_quantity) AS q FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey LEFT JOIN de USING (ticker) WHERE year = 2000 GROUP BY 1, 2) GROUP BY 1""")
def k12_decision_pivot(spark, d):
    f = fund(spark, d).select("ticker", M.decision(F.col("status"), F.col("weight"), F.col("benchmark_weight")).alias("decision"))
    s, n = X.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), X.table(spark, d, "nation").select("n_nationkey", "n_name")
    b = X.bought(spark, d).where("year = 2000").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(f, "ticker", "left")
    kinds = ["excluded", "less", "same", "more"]
    wide = b.groupBy(F.col("n_name").alias("state")).pivot("decision", kinds).agg(F.sum("l_quantity")).na.fill(0.0)
    total = b.groupBy(F.col("n_name").alias("state")).agg(F.sum("l_quantity").alias("total"), F.coalesce(F.sum(F.when(F.col("decision").isNull(), F.col("l_quantity"))), F.lit(0.0)).alias("others"))
    out = total.join(wide, "state").withColumn("same", F.col("same") + F.col("others"))
    return out.select("state", *[r6(F.col(k)).alias(k) for k in [*kinds, "total"]])
