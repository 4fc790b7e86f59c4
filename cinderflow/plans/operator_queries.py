"""Queries of the windows, aggregates, joins, set operations and reshapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderflow.functions.numbers import clip, half_even, r6, ratio
from cinderflow.operators import aggregates as A
from cinderflow.operators import joins as J
from cinderflow.operators import ranking as R
from cinderflow.operators import timeseries as T
from cinderflow.plans import fixtures as X

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


P = X.SQL


def _t(spark, d, name):
    return X.table(spark, d, name)


# ---------------------------------------------------------------- windows
@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS DOUBLE) AS position FROM orders")
def w01_average_rank(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", R.average_rank(F.col("o_totalprice"), ["o_orderpriority"]).alias("position"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment) AS p FROM customer)
SELECT c_custkey, round(CAST(p AS DOUBLE), 6) AS pct, CASE WHEN p <= 0.2 THEN 1 WHEN p <= 0.4 THEN 2 WHEN p <= 0.6 THEN 3 WHEN p <= 0.8 THEN 4 ELSE 5 END AS quintile FROM r""")
def w06_quintiles(spark, d):
    p = R.percentile_rank(F.col("c_acctbal"), ["c_mktsegment"])
    return _t(spark, d, "customer").withColumn("p", p).select("c_custkey", r6(F.col("p")).alias("pct"), R.bucket(F.col("p"), 5).alias("quintile"))


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w07_latest(spark, d):
    o = _t(spark, d, "orders")
    return R.pick(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


_W08 = "SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, round(l_extendedprice, 6) AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {}) AS nr FROM lineitem) WHERE nr = 1"
_LINE = ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query(_W08.format("l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC"))
def w08_dedupe_last(spark, d):
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")]
    return R.pick(_t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], order).select(*_LINE)


@query(_W08.format("l_shipdate, l_linenumber, l_partkey, l_extendedprice"))
def w08_dedupe_first(spark, d):
    order = [F.asc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")]
    return R.pick(_t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], order).select(*_LINE)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def w17_duplicate_flag(spark, d):
    return R.duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(P + "SELECT ticker, year, round(total / nullif(lag(total) OVER (PARTITION BY ticker ORDER BY year), 0) - 1, 6) AS change FROM order_years")
def w09_yoy(spark, d):
    return X.order_years(spark, d).select("ticker", "year", r6(T.change(F.col("total"), ["ticker"], "year")).alias("change"))


@query(P + """SELECT ticker, year, round(total - before, 6) AS delta FROM (SELECT *, lag(total) OVER w AS before, lag(year) OVER w AS y FROM order_years WINDOW w AS (PARTITION BY ticker ORDER BY year)) WHERE year - y = 1""")
def w10_consecutive(spark, d):
    return T.consecutive_delta(X.order_years(spark, d), ["ticker"], "total").select("ticker", "year", r6(F.col("delta")).alias("delta"))


@query(P + "SELECT ticker, year, round(total, 6) AS total FROM growth WHERE nr <= 6")
def w11_trailing_rows(spark, d):
    nr = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("year")))
    return X.order_years(spark, d).withColumn("nr", nr).where("nr <= 6").select("ticker", "year", r6(F.col("total")).alias("total"))


_QUARTERS = """, q AS (SELECT o_custkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
grid AS (SELECT c_custkey AS k, CAST(range AS INTEGER) AS p FROM customer CROSS JOIN range((SELECT min(p) FROM q), (SELECT max(p) + 1 FROM q))),
panel AS (SELECT k, p, coalesce(v, 0) AS v FROM grid LEFT JOIN q USING (k, p))
"""


def panel(spark, d):
    """customer (k) x quarter (p = 4 x year + quarter - 1), order value v, 0 where there is none."""
    o = _t(spark, d, "orders")
    q = o.groupBy(F.col("o_custkey").alias("k"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("p")).agg(F.sum("o_totalprice").alias("v"))
    periods = q.agg(F.explode(F.sequence(F.min("p"), F.max("p"))).alias("p"))
    return J.grid(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")), periods, q, ["k", "p"], ["v"])


@query(P + _QUARTERS + "SELECT k, p, round(v, 6) AS v FROM panel")
def j10_grid_zero_fill(spark, d):
    return panel(spark, d).select("k", "p", r6(F.col("v")).alias("v"))


@query(P + _QUARTERS + "SELECT k, p, round(s, 6) AS trailing FROM (SELECT k, p, CASE WHEN count(*) OVER w = 4 THEN sum(v) OVER w END AS s FROM panel WINDOW w AS (PARTITION BY k ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE s IS NOT NULL")
def w12_trailing4(spark, d):
    got = panel(spark, d).withColumn("s", T.trailing(F.col("v"), ["k"], "p", 4))
    return got.where("s is not null").select("k", "p", r6(F.col("s")).alias("trailing"))


@query(P + "SELECT ticker, year, round(sum(total) OVER (PARTITION BY ticker ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM order_years")
def w13_trailing5y(spark, d):
    return X.order_years(spark, d).select("ticker", "year", r6(T.trailing_range(F.col("total"), ["ticker"], "year", 5)).alias("trailing"))


_DAILY = """WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
r AS (SELECT user_id, day, n / nullif(lag(n) OVER (PARTITION BY user_id ORDER BY day), 0) - 1 AS r FROM days),
g AS (SELECT user_id, day, product(1 + r) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS growth FROM r WHERE r IS NOT NULL)
"""


def _growth(spark, d):
    days = _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ret = days.withColumn("r", T.change(F.col("n"), ["user_id"], "day")).where("r is not null")
    return ret.withColumn("growth", T.compounded(F.col("r"), ["user_id"], "day"))


@query(_DAILY + "SELECT user_id, CAST(day AS VARCHAR) AS day, round(growth, 6) AS growth FROM g")
def w14_cumprod(spark, d):
    return _growth(spark, d).select("user_id", F.col("day").cast("string").alias("day"), r6(F.col("growth")).alias("growth"))


@query(_DAILY + "SELECT user_id, round(min(growth / nullif(peak, 0) - 1), 6) AS drawdown FROM (SELECT *, max(growth) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM g) GROUP BY 1")
def w15_drawdown(spark, d):
    peak = F.max("growth").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return _growth(spark, d).withColumn("peak", peak).groupBy("user_id").agg(r6(F.min(ratio(F.col("growth"), F.col("peak")) - 1)).alias("drawdown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 0), 6) AS share FROM lineitem")
def w16_group_transform(spark, d):
    share = ratio(F.col("l_extendedprice"), F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey")))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(share).alias("share"))


@query(P + """, last AS (SELECT * FROM (SELECT *, max(year) OVER (PARTITION BY ticker) AS m FROM order_years) WHERE year = m)
SELECT ticker, year, round(total, 6) AS total, false AS carried FROM order_years
UNION ALL SELECT ticker, CAST(unnest(range(year + 1, 2004)) AS INTEGER), round(total, 6), true FROM last WHERE year < 2003""")
def w18_carry_forward(spark, d):
    return T.carried_forward(X.order_years(spark, d), ["ticker"], 2003).select("ticker", "year", r6(F.col("total")).alias("total"), "carried")


@query("""WITH q AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS qt, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3),
y AS (SELECT k, y, sum(v) AS total FROM q GROUP BY 1, 2),
three AS (SELECT k, y, sum(v) AS s FROM q WHERE qt <= 3 GROUP BY 1, 2 HAVING count(*) = 3)
SELECT k, y, round(total - s, 6) AS fourth FROM y JOIN three USING (k, y) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = y.k AND q.y = y.y AND qt = 4)""")
def w19_derived_quarter(spark, d):
    o = _t(spark, d, "orders")
    q = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("qt")).agg(F.sum("o_totalprice").alias("v"))
    by = q.groupBy("k", "y").agg(F.sum("v").alias("total"), F.sum(F.when(F.col("qt") <= 3, F.col("v"))).alias("s"), F.count_if(F.col("qt") <= 3).alias("n"), F.count_if(F.col("qt") == 4).alias("fourths"))
    return by.where("n = 3 and fourths = 0").select("k", "y", r6(F.col("total") - F.col("s")).alias("fourth"))


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice, 6) AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS nr FROM lineitem) WHERE nr = 1")
def w20_top_contribution(spark, d):
    got = R.pick(_t(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")])
    return got.select("l_orderkey", "l_partkey", r6(F.col("l_extendedprice")).alias("l_extendedprice"))


# ---------------------------------------------------------------- aggregates
@query("SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 4) AS total, round(max(l_discount), 6) AS top, count(DISTINCT l_partkey) AS parts, count(*) AS n, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS first_order FROM lineitem GROUP BY 1, 2")
def a02_multi_measure(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.round(F.sum("l_extendedprice"), 4).alias("total"), r6(F.max("l_discount")).alias("top"), F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"),
        F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("first_order"),
    )


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY 1")
def a04_conditional_count(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY 1")
def a05_quantiles(spark, d):
    names = {f"p{q:02d}": q / 100 for q in (5, 25, 50, 75)}
    return A.quantiles(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", names).select("l_returnflag", *[r6(F.col(k)).alias(k) for k in names])


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS pop, round(stddev_samp(l_quantity), 6) AS samp FROM lineitem GROUP BY 1")
def a06_moments(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.avg(q)).alias("mean"), r6(F.stddev_pop(q)).alias("pop"), r6(F.stddev_samp(q)).alias("samp"))


@query("SELECT l_suppkey, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def a08_pearson(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(A.pearson(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))


_PAIRS = P + """, pr AS (SELECT a.indicator_id AS a, b.indicator_id AS b, a.ticker, a.value AS x, b.value AS y FROM newest a JOIN newest b ON a.ticker = b.ticker AND a.indicator_id < b.indicator_id),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pr),
rho AS (SELECT a, b, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM rk GROUP BY 1, 2)
"""


def pairs(spark, d):
    v = R.latest(X.facts(spark, d), ["indicator_id", "ticker"])
    a, b = v.select("ticker", F.col("indicator_id").alias("a"), F.col("value").alias("x")), v.select("ticker", F.col("indicator_id").alias("b"), F.col("value").alias("y"))
    return A.spearman(a.join(b, "ticker").where("a < b"), ["a", "b"], "x", "y")


@query(_PAIRS + "SELECT a, b, n, round(rho, 6) AS rho FROM rho")
def a09_spearman_pairs(spark, d):
    return pairs(spark, d).select("a", "b", "n", r6(F.col("rho")).alias("rho"))


@query("SELECT l_suppkey, round(product(1 + l_discount / 100), 6) AS grown FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1")
def a10_product(spark, d):
    return _t(spark, d, "lineitem").where("l_discount >= 0.09").groupBy("l_suppkey").agg(r6(F.product(1 + F.col("l_discount") / 100)).alias("grown"))


@query(P + "SELECT ticker, year, round(sum(v * v) / nullif(sum(v) * sum(v), 0), 6) AS hhi FROM nation_years GROUP BY 1, 2")
def a12_hhi(spark, d):
    return X.line_years(spark, d).where("hhi is not null").select("ticker", "year", r6(F.col("hhi")).alias("hhi"))


@query("SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem GROUP BY 1, 2")
def a13_share_of_total(spark, d):
    by = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    return by.select("l_suppkey", "l_returnflag", r6(ratio(F.col("v"), F.sum("v").over(Window.partitionBy("l_suppkey")))).alias("share"))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, round(max(p_retailprice), 6) AS price FROM part GROUP BY 1")
def a14_argmax(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("p_partkey"), r6(F.max("p_retailprice")).alias("price"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type))[1:5], ', ') AS types FROM part GROUP BY 1")
def a15_sorted_list(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(A.sorted_list(F.col("p_type"), 5).alias("types"))


@query("SELECT CAST(least(floor(l_discount / 0.1 * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def a16_histogram(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") / 0.1 * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 4), 0) AS "F", coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 4), 0) AS "O", coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 4), 0) AS "P",
 round(sum(o_totalprice) FILTER (o_orderstatus IN ('F', 'O', 'P')), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a17_pivot(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    wide = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")).na.fill(0.0)
    return wide.select("c_mktsegment", *[F.round(x, 4).alias(x) for x in "FOP"], F.round(F.col("F") + F.col("O") + F.col("P"), 4).alias("total"))


@query(P + "SELECT ticker, round(avg(CASE WHEN year = 1998 THEN total END), 6) AS y1998, round(avg(CASE WHEN year = 1999 THEN total END), 6) AS y1999, round(avg(CASE WHEN year = 2000 THEN total END), 6) AS y2000 FROM order_years GROUP BY 1")
def a18_pivot_mean(spark, d):
    wide = X.order_years(spark, d).groupBy("ticker").pivot("year", [1998, 1999, 2000]).agg(F.avg("total"))
    return wide.select("ticker", *[r6(F.col(str(y))).alias(f"y{y}") for y in (1998, 1999, 2000)])


@query("SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2, 3")
def a19_keyed_accumulation(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").cast("string").alias("day")).agg(r6(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(l_extendedprice / m, 6) AS share FROM lineitem l JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def a20_equal_split(spark, d):
    got = A.equal_split(_t(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_extendedprice")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("share")).alias("share"))


@query("SELECT round(1 - count(DISTINCT o_totalprice) / CAST(count(*) AS DOUBLE), 6) AS tie_ratio, round(max(o_totalprice), 6) AS top, count(*) AS n FROM orders")
def a21_global_scalars(spark, d):
    return _t(spark, d, "orders").agg(r6(1 - F.countDistinct("o_totalprice") / F.count(F.lit(1))).alias("tie_ratio"), r6(F.max("o_totalprice")).alias("top"), F.count(F.lit(1)).alias("n"))


@query(P + "SELECT ticker, round(sum(total) / sum(n), 6) AS ratio FROM order_years WHERE year BETWEEN 1997 AND 2001 GROUP BY 1 HAVING count(*) >= 3")
def a22_ratio_of_sums(spark, d):
    y = X.order_years(spark, d).where("year between 1997 and 2001").groupBy("ticker").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("years"))
    return y.where("years >= 3").select("ticker", r6(F.col("t") / F.col("n")).alias("ratio"))


# ---------------------------------------------------------------- joins
@query("SELECT o_orderkey, 'lines' AS source, round(sum(l_extendedprice), 4) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, 'order', round(o_totalprice, 4) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j06_anti_fallback(spark, d):
    first = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("value")).select("o_orderkey", F.lit("lines").alias("source"), "value")
    other = _t(spark, d, "orders").select("o_orderkey", F.lit("order").alias("source"), F.round("o_totalprice", 4).alias("value"))
    return J.with_fallback(first, other, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def j07_semi(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT a.o_orderkey, a.o_custkey, b.as_of_key, round(b.v, 6) AS v FROM orders a JOIN (SELECT o_custkey, o_orderdate AS ad, o_orderkey AS as_of_key, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0) b
 ON a.o_custkey = b.o_custkey AND b.ad <= a.o_orderdate AND date_diff('day', b.ad, a.o_orderdate) <= 400 WHERE a.o_orderkey % 3 = 1
 QUALIFY b.ad = max(b.ad) OVER (PARTITION BY a.o_orderkey)""")
def j12_asof_max_age(spark, d):
    o = _t(spark, d, "orders").withColumn("at", F.to_date("o_orderdate"))
    left = o.where("o_orderkey % 3 = 1").select("o_orderkey", "o_custkey", "at")
    right = o.where("o_orderkey % 3 = 0").select("o_custkey", F.col("at").alias("as_of"), F.col("o_orderkey").alias("as_of_key"), F.col("o_totalprice").alias("v"))
    return J.asof_within(left, right, "o_custkey", "at", "as_of", 400).select("o_orderkey", "o_custkey", "as_of_key", r6(F.col("v")).alias("v"))


@query()
def j12_asof_all(spark, d):
    """All orders against all: the customer's newest earlier orders, at most 400 days older and of another key."""
    o = _t(spark, d, "orders").withColumn("at", F.to_date("o_orderdate"))
    left = o.select("o_orderkey", "o_custkey", "at")
    right = o.select("o_custkey", F.col("at").alias("as_of"), F.col("o_orderkey").alias("as_of_key"), F.col("o_totalprice").alias("v"))
    return J.asof_within(left, right, "o_custkey", "at", "as_of", 400, F.col("as_of_key") != F.col("o_orderkey")).select("o_orderkey", "o_custkey", "as_of_key", r6(F.col("v")).alias("v"))


_SPLITS = "splits AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS date, 1 + l_discount AS ratio FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 49)"


def splits(spark, d):
    return _t(spark, d, "lineitem").where("l_discount >= 0.09 and l_quantity >= 49").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("date"), (1 + F.col("l_discount")).alias("ratio"))


@query(f"WITH {_SPLITS}, d AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, y FROM supplier CROSS JOIN (VALUES (1996), (1998), (2000)) t(y)) SELECT d.symbol, CAST(d.y AS INTEGER) AS y, round(coalesce(product(ratio), 1.0), 6) AS factor FROM d LEFT JOIN splits s ON d.symbol = s.symbol AND year(s.date) > d.y GROUP BY 1, 2")
def j13_split_product(spark, d):
    years = spark.createDataFrame([(1996,), (1998,), (2000,)], "y int")
    asked = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol")).crossJoin(F.broadcast(years))
    s = splits(spark, d).withColumn("sy", F.year("date"))
    # Ratios are multiplied by symbol and year first: the range join meets at most a row a year.
    by = s.groupBy("symbol", "sy").agg(F.product("ratio").alias("r"))
    met = asked.join(by, "symbol", "left").groupBy("symbol", "y").agg(F.product(F.when(F.col("sy") > F.col("y"), F.col("r")).otherwise(1.0)).alias("f"))
    return met.select("symbol", "y", r6(F.coalesce("f", F.lit(1.0))).alias("factor"))


@query(P + "SELECT a.ticker, a.year, round(pow(a.total / b.total, CAST(1 AS DOUBLE) / 3) - 1, 6) AS cagr FROM order_years a JOIN order_years b ON a.ticker = b.ticker AND a.year = b.year + 3 WHERE a.total / b.total BETWEEN 0.15 AND 6")
def j15_lag3(spark, d):
    met = T.lagged(X.order_years(spark, d).select("ticker", "year", F.col("total").alias("value")), ["ticker"], 3).withColumn("q", ratio(F.col("value"), F.col("then")))
    return met.where("q between 0.15 and 6").select("ticker", "year", r6(F.pow("q", F.lit(1 / 3)) - 1).alias("cagr"))


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(arg_min(o_totalprice, (o_orderpriority, o_orderkey)), 6) AS value FROM orders GROUP BY 1, 2")
def j16_priority_chain(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("value"))
    return J.first_by_priority(o, ["o_custkey", "year"], ["o_orderpriority", "o_orderkey"], "value").select("o_custkey", "year", r6(F.col("value")).alias("value"))


@query("""WITH anchor AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS ak FROM orders WHERE o_orderpriority LIKE '1%')
SELECT a.ak, arg_min(o.o_orderkey, (o.o_orderpriority, o.o_orderkey)) AS picked FROM anchor a JOIN orders o ON o.o_custkey = a.o_custkey AND month(o.o_orderdate) = month(a.dt) AND year(o.o_orderdate) = year(a.dt) AND o.o_orderkey <> a.ak GROUP BY 1""")
def j17_period_exact(spark, d):
    o = _t(spark, d, "orders").withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    a = o.where(F.col("o_orderpriority").startswith("1")).select("o_custkey", "m", F.col("o_orderkey").alias("ak"))
    met = a.join(o, ["o_custkey", "m"]).where("o_orderkey <> ak")
    return J.first_by_priority(met.withColumn("picked", F.col("o_orderkey")), ["ak"], ["o_orderpriority", "o_orderkey"], "picked")


@query(P + """, base AS (SELECT ticker, year, total AS value FROM order_years WHERE year <= 1999), top AS (SELECT ticker, year, n * 1000.0 AS value FROM order_years WHERE year >= 1999)
SELECT ticker, year, round(CAST(coalesce(top.value, base.value) AS DOUBLE), 6) AS value FROM base FULL JOIN top USING (ticker, year)""")
def j18_overlay(spark, d):
    y = X.order_years(spark, d)
    base, top = y.where("year <= 1999").select("ticker", "year", F.col("total").alias("value")), y.where("year >= 1999").select("ticker", "year", (F.col("n") * 1000.0).alias("value"))
    return J.overlay(base, top, ["ticker", "year"]).select("ticker", "year", r6(F.col("value")).alias("value"))


@query(P + "SELECT ticker, year, round(rq / nullif(q, 0), 6) AS value FROM line_years l WHERE NOT (rq = 0 AND EXISTS (SELECT 1 FROM facts f WHERE f.indicator_id = 'eco1' AND f.ticker = l.ticker AND f.year = l.year AND f.value > 0))")
def j19_contradiction(spark, d):
    f = X.facts(spark, d)
    zero = f.where("indicator_id = 'eco1' and value > 0").select("ticker", "year").withColumn("_c", F.lit(True))
    s = f.where("indicator_id = 'soc1'").join(zero, ["ticker", "year"], "left").where("not (value = 0 and _c is not null)")
    return s.select("ticker", "year", r6(F.col("value")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(unnest(string_split(p_type, ' ')) AS VARCHAR) AS word FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49")
def j23_explode_split(spark, d):
    l, p = _t(spark, d, "lineitem").where("l_quantity >= 49"), _t(spark, d, "part").select("p_partkey", "p_type")
    return l.join(p, l.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query()
def j23_explode_all(spark, d):
    l, p = _t(spark, d, "lineitem"), _t(spark, d, "part").select("p_partkey", "p_type")
    return l.join(p, l.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("SELECT ticker, round(coalesce(a.total, 0), 6) AS early, round(coalesce(b.total, 0), 6) AS late, a.ticker IS NULL AS only_late FROM (SELECT CAST(o_custkey AS VARCHAR) AS ticker, sum(o_totalprice) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) a FULL JOIN (SELECT CAST(o_custkey AS VARCHAR) AS ticker, sum(o_totalprice) AS total FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1) b USING (ticker)")
def j05_full_outer(spark, d):
    y = X.order_years(spark, d)
    a, b = y.where("year = 1996").select("ticker", F.col("total").alias("a")), y.where("year = 2000").select("ticker", F.col("total").alias("b"))
    return a.join(b, "ticker", "full").select("ticker", r6(F.coalesce("a", F.lit(0.0))).alias("early"), r6(F.coalesce("b", F.lit(0.0))).alias("late"), F.col("a").isNull().alias("only_late"))


# ---------------------------------------------------------------- sets, reshape, limits
@query("SELECT 'only_orders' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'both', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)")
def r03_setdiff(spark, d):
    o, l = _t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(o.subtract(l), "only_orders").unionByName(count(o.intersect(l), "both"))


@query("SELECT ticker, kind, round(CAST(value AS DOUBLE), 6) AS value FROM (" + P + "SELECT ticker, year, 'total' AS kind, total AS value FROM order_years UNION ALL SELECT ticker, year, 'n', CAST(n AS DOUBLE) FROM order_years)")
def r04_melt(spark, d):
    y = X.order_years(spark, d).select("ticker", "total", F.col("n").cast("double").alias("n"))
    return y.unpivot("ticker", ["total", "n"], "kind", "value").where("value is not null").select("ticker", "kind", r6(F.col("value")).alias("value"))


@query(P + "SELECT ticker, " + ", ".join(f"round(max(CASE WHEN indicator_id = '{k}' THEN value END), 6) AS {k}" for k, *_ in X.CATALOG) + " FROM newest GROUP BY 1")
def r05_pivot(spark, d):
    ids = [k for k, *_ in X.CATALOG]
    wide = R.latest(X.facts(spark, d), ["indicator_id", "ticker"]).groupBy("ticker").pivot("indicator_id", ids).agg(F.first("value"))
    return wide.select("ticker", *[r6(F.col(k)).alias(k) for k in ids])


@query(P + "SELECT a.ticker, a.indicator_id AS a, b.indicator_id AS b, round(a.value - b.value, 6) AS diff FROM newest a JOIN newest b ON a.ticker = b.ticker AND a.indicator_id < b.indicator_id")
def r07_pairs(spark, d):
    v = R.latest(X.facts(spark, d), ["indicator_id", "ticker"])
    a, b = v.select("ticker", F.col("indicator_id").alias("a"), F.col("value").alias("x")), v.select("ticker", F.col("indicator_id").alias("b"), F.col("value").alias("y"))
    return a.join(b, "ticker").where("a < b").select("ticker", "a", "b", r6(F.col("x") - F.col("y")).alias("diff"))


@query("SELECT DISTINCT key, kind FROM (SELECT o_custkey AS key, 'customer' AS kind FROM orders UNION ALL SELECT l_suppkey, 'supplier' FROM lineitem UNION ALL SELECT c_custkey, 'customer' FROM customer)")
def r02_union_dedupe(spark, d):
    parts = [("orders", "o_custkey", "customer"), ("lineitem", "l_suppkey", "supplier"), ("customer", "c_custkey", "customer")]
    dfs = [_t(spark, d, t).select(F.col(c).alias("key"), F.lit(k).alias("kind")) for t, c, k in parts]
    return dfs[0].unionByName(dfs[1]).unionByName(dfs[2]).distinct()


@query("SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def t03_top_k(spark, d):
    return _t(spark, d, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(10).select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS nr, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE nr > floor(n * 0.2)")
def t04_drop_bottom(spark, d):
    w = Window.partitionBy("c_mktsegment")
    got = _t(spark, d, "customer").withColumn("nr", F.row_number().over(w.orderBy("c_acctbal", "c_custkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    return got.where(F.col("nr") > F.floor(F.col("n") * 0.2)).select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, left(p_name, 6) ORDER BY p_retailprice DESC, p_partkey) AS dup FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nr FROM a WHERE dup = 1) SELECT p_brand, p_partkey, p_name FROM b WHERE nr <= 3""")
def t05_first_n_deduped(spark, d):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    once = R.pick(_t(spark, d, "part").withColumn("prefix", F.substring("p_name", 1, 6)), ["p_brand", "prefix"], order)
    return once.withColumn("nr", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order))).where("nr <= 3").select("p_brand", "p_partkey", "p_name")


# ---------------------------------------------------------------- predicates and scalar functions
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' AND NOT (o_orderpriority LIKE '5%') AND o_custkey IS NOT NULL")
def p_filters(spark, d):
    o = _t(spark, d, "orders")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    keep = F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(1000, 200000) & (F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1998-01-01")) & ~F.col("o_orderpriority").startswith("5")
    return o.where(keep & F.col("o_custkey").isNotNull()).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN date_diff('day', o_orderdate, l_shipdate) BETWEEN 75 AND 100 THEN 'quarter' WHEN date_diff('day', o_orderdate, l_shipdate) > 100 THEN 'long' ELSE 'short' END AS span FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def p06_durations(spark, d):
    l, o = _t(spark, d, "lineitem"), _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", F.when(days.between(75, 100), "quarter").when(days > 100, "long").otherwise("short").alias("span"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) <= 7 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_end, CAST(year(CAST(o_orderdate AS DATE) - 182) AS INTEGER) AS fiscal_mid,
 CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end, CAST((month(o_orderdate) + 8) % 12 + 1 AS INTEGER) AS calendar_month,
 CAST((year(o_orderdate) + 1) // 2 * 2 AS INTEGER) AS cycle, CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS regime FROM orders""")
def fd_calendar(spark, d):
    from cinderflow.functions import dates as D

    e = F.col("o_orderdate")
    return _t(spark, d, "orders").select(
        "o_orderkey", D.fiscal_year_from_end(e).alias("fiscal_end"), D.fiscal_year_mid(e).alias("fiscal_mid"), D.quarter_label(e).alias("quarter"), F.last_day(F.to_date(e)).cast("string").alias("month_end"),
        D.calendar_month(F.month(e)).alias("calendar_month"), D.two_year_cycle(F.year(e)).alias("cycle"), F.when(F.year(e) < 1998, "early").otherwise("late").alias("regime"),
    )


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal / 1000, -1), 5) END, 6) AS clipped, round(exp(least(greatest(c_acctbal / 1000, -2), 2)), 6) AS tilt, round_even(c_acctbal / 100 * 10, 0) / 10 AS rounded,
 round(c_acctbal / nullif(c_custkey % 3, 0), 6) AS guarded, round(least(greatest((c_acctbal + 1000) / 11000 * 100, 0), 100), 6) AS rescaled FROM customer""")
def fm_numbers(spark, d):
    b = F.col("c_acctbal")
    return _t(spark, d, "customer").select(
        "c_custkey", r6(clip(b / 1000, -1, 5)).alias("clipped"), r6(F.exp(clip(b / 1000, -2, 2))).alias("tilt"), half_even(b / 100, 1).alias("rounded"),
        r6(ratio(b, F.col("c_custkey") % 3)).alias("guarded"), r6(clip((b + 1000) / 11000 * 100, 0, 100)).alias("rescaled"),
    )


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def s07_json_facts(spark, d):
    e = _t(spark, d, "events").withColumn("j", F.from_json("props", "k bigint"))
    return e.where("j.k is not null").select("event_id", "event_type", F.col("j.k").alias("k"))
