"""The scoring model's tables as views of the sample tables, in Spark and as SQL for the oracle."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderflow.config import Profile
from cinderflow.functions.numbers import ratio, steady_sum
from cinderflow.storage import sized, small, written

CATALOG = [
    ("eco1", "economic", True, 1.0), ("eco2", "economic", False, 1.0), ("soc1", "social", False, 2.0),
    ("soc2", "social", True, 1.0), ("env1", "environmental", False, 1.0), ("env2", "environmental", False, 1.5),
]
PROFILE = Profile(
    "balanced", {"economic": 1.0, "social": 1.0, "environmental": 2.0}, sector_relative=True, min_year=2000, min_weight_share=0.6,
    portfolio={"benchmark": "cap", "exclude_bottom_pct": 0.2, "exclude_sub_industries": ["FURNITURE"]},
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "indicator_id string, category string, higher_is_better boolean, weight double")


def universe(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    cik = F.col("c_custkey") - F.when(F.col("c_custkey") % 50 == 1, 1).otherwise(0)
    return joined.select(
        F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("ticker"), F.col("c_name").alias("name"), F.col("r_name").alias("sector"),
        F.col("c_mktsegment").alias("sub_industry"), cik.cast("string").alias("cik"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("cap"),
    )


def order_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("ticker"), F.year("o_orderdate").alias("year")).agg(
        steady_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n")
    )


def bought(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the customer of their order."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return l.join(o.select("o_orderkey", "o_custkey"), l.l_orderkey == o.o_orderkey).withColumn("ticker", F.col("o_custkey").cast("string")).withColumn("year", F.year("l_shipdate"))


#: Bytes of a table's files that a task of the facts gets.
PART_BYTES = 8 << 20


def dealt(df: DataFrame, key: str, size: int) -> DataFrame:
    """df, dealt by key in parts for so many bytes of files: what a task sorts or hashes doesn't grow with the tables."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def line_years(spark: SparkSession, d: str) -> DataFrame:
    """ticker, year and sums over lines: quantity, returned quantity, price, discount, and the concentration of price by supplier nation.

    Lines meet their orders once and are then dealt by customer once: the aggregate by nation and the one above it run where the lines lie.
    """
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    l, size = sized(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("r"), F.year("l_shipdate").alias("year")), "lines")
    lines = l.join(small(s), F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("l_suppkey", "s_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    met = dealt(lines, "l_orderkey", size).join(dealt(o, "o_orderkey", size).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    price = F.col("l_extendedprice")
    by_nation = dealt(met, "custkey", size).groupBy("custkey", "year", "s_nationkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("r"), F.col("l_quantity")).otherwise(0.0)).alias("rq"), steady_sum(price).alias("e"), steady_sum(price * F.col("l_discount")).alias("ed")
    )
    known = F.when(F.col("s_nationkey").isNotNull(), F.col("e"))
    by_year = by_nation.groupBy("custkey", "year").agg(*[steady_sum(F.col(c)).alias(c) for c in ("q", "rq", "e", "ed")], ratio(steady_sum(known * known), steady_sum(known) * steady_sum(known)).alias("hhi"))
    return by_year.withColumn("ticker", F.col("custkey").cast("string")).drop("custkey")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """indicator_id, ticker, year, value of all six indicators: two aggregates, written once and read by every branch of a query.

    Sums don't depend on the order of rows: equal companies get equal values in the last bit, and so share their rank.
    """
    o, size = sized(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), "o_totalprice"), "orders")
    by_year = Window.partitionBy("custkey").orderBy("year")
    y = dealt(o, "custkey", size).groupBy("custkey", "year").agg(steady_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))
    y = y.withColumn("before", F.lag("total").over(by_year)).withColumn("gap", F.col("year") - F.lag("year").over(by_year))
    y = y.withColumn("nr", F.row_number().over(Window.partitionBy("custkey").orderBy(F.desc("year")))).withColumn("g", ratio(F.col("total"), F.col("before")) - 1)
    whole = Window.partitionBy("custkey")
    few = lambda x, n: F.when(F.col("nr") <= n, x)
    y = y.withColumn("years", F.count(few(F.lit(1), 6)).over(whole)).withColumn("s", F.stddev_samp(few(F.col("g"), 5)).over(whole)).withColumn("m", F.avg(few(F.col("g"), 5)).over(whole))
    steady = (F.col("nr") == 1) & (F.col("years") == 6) & (F.abs("m") >= 0.005)
    orders = {"eco1": F.when(F.col("gap") == 1, F.col("g")), "eco2": F.when(steady, ratio(F.col("s"), F.abs("m"))), "soc2": F.col("total") / F.col("n")}
    lines = {"soc1": ratio(F.col("rq"), F.col("q")), "env1": ratio(F.col("ed"), F.col("e")), "env2": F.col("hhi")}
    long = lambda df, made: df.select("ticker", F.col("year").cast("int").alias("year"), *[x.alias(k) for k, x in made.items()]).unpivot(["ticker", "year"], list(made), "indicator_id", "value")
    both = long(y.withColumn("ticker", F.col("custkey").cast("string")), orders).unionByName(long(line_years(spark, d), lines)).where("value is not null")
    return written(both.select("indicator_id", "ticker", "year", F.round("value", 9).alias("value")), "facts")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """symbol, month (YYYY-MM), close: mean unit price of a supplier's lines by month."""
    l = table(spark, d, "lineitem")
    return l.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.round(F.avg(ratio(F.col("l_extendedprice"), F.col("l_quantity"))), 9).alias("close")
    )



#: The same views for the oracle; every query's SQL continues after them.
SQL = """
WITH universe AS (
  SELECT c_custkey AS ordinal, CAST(c_custkey AS VARCHAR) AS ticker, c_name AS name, r_name AS sector, c_mktsegment AS sub_industry,
    CAST(c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS cik, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS cap
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
catalog AS (SELECT * FROM (VALUES ('eco1','economic',true,1.0),('eco2','economic',false,1.0),('soc1','social',false,2.0),
  ('soc2','social',true,1.0),('env1','environmental',false,1.0),('env2','environmental',false,1.5)) t(indicator_id, category, higher_is_better, weight)),
catw AS (SELECT * FROM (VALUES ('economic',1.0),('social',1.0),('environmental',2.0)) t(category, cw)),
order_years AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1, 2),
bought AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(year(l_shipdate) AS INTEGER) AS year, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
growth AS (SELECT ticker, year, total, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS nr,
  total / nullif(lead(total) OVER (PARTITION BY ticker ORDER BY year DESC), 0) - 1 AS g FROM order_years),
spread AS (SELECT ticker, max(year) AS year, count(*) AS n, stddev_samp(CASE WHEN nr <= 5 THEN g END) AS s, avg(CASE WHEN nr <= 5 THEN g END) AS m FROM growth WHERE nr <= 6 GROUP BY 1),
line_years AS (SELECT ticker, year, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS rq, sum(l_extendedprice) AS e, sum(l_extendedprice * l_discount) AS ed FROM bought GROUP BY 1, 2),
nation_years AS (SELECT ticker, year, s_nationkey, sum(l_extendedprice) AS v FROM bought JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
raw_facts AS (
  SELECT 'eco1' AS indicator_id, a.ticker, a.year, a.total / nullif(b.total, 0) - 1 AS value FROM order_years a JOIN order_years b ON a.ticker = b.ticker AND a.year = b.year + 1
  UNION ALL SELECT 'eco2', ticker, year, s / nullif(abs(m), 0) FROM spread WHERE n = 6 AND abs(m) >= 0.005
  UNION ALL SELECT 'soc1', ticker, year, rq / nullif(q, 0) FROM line_years
  UNION ALL SELECT 'soc2', ticker, year, total / n FROM order_years
  UNION ALL SELECT 'env1', ticker, year, ed / nullif(e, 0) FROM line_years
  UNION ALL SELECT 'env2', ticker, year, sum(v * v) / nullif(sum(v) * sum(v), 0) FROM nation_years GROUP BY 2, 3),
facts AS (SELECT indicator_id, ticker, year, round(value, 9) AS value FROM raw_facts WHERE value IS NOT NULL),
newest AS (SELECT indicator_id, ticker, max(year) AS year, arg_max(value, year) AS value FROM facts GROUP BY 1, 2),
primaries AS (SELECT cik, arg_min(ticker, ordinal) AS primary_ticker FROM universe GROUP BY 1),
dense AS (
  SELECT u.*, p.primary_ticker, c.indicator_id, c.category, c.higher_is_better, c.weight, CASE WHEN n.year >= 2000 THEN n.value END AS value, CASE WHEN n.year >= 2000 THEN n.year END AS year
  FROM universe u CROSS JOIN catalog c JOIN primaries p ON u.cik = p.cik LEFT JOIN newest n ON n.ticker = u.ticker AND n.indicator_id = c.indicator_id),
pool AS (
  SELECT indicator_id, sector, ticker, value, higher_is_better, rank() OVER (PARTITION BY indicator_id, sector ORDER BY value) + (count(*) OVER (PARTITION BY indicator_id, sector, value) - 1) / 2.0 AS ar,
    count(*) OVER (PARTITION BY indicator_id, sector) AS n
  FROM dense WHERE ticker = primary_ticker AND value IS NOT NULL),
ranked AS (SELECT indicator_id, ticker AS primary_ticker, CASE WHEN n = 1 THEN 0.5 WHEN higher_is_better THEN (ar - 1) / (n - 1) ELSE 1 - (ar - 1) / (n - 1) END AS rank01 FROM pool),
ranks AS (SELECT d.*, r.rank01 FROM dense d LEFT JOIN ranked r ON d.indicator_id = r.indicator_id AND d.primary_ticker = r.primary_ticker),
cats0 AS (SELECT ticker, category, sum(rank01 * weight) AS s, sum(CASE WHEN rank01 IS NOT NULL THEN weight END) AS have, sum(weight) AS w, count(rank01) AS n_indicators FROM ranks GROUP BY 1, 2),
cats AS (SELECT ticker, category, n_indicators, coalesce(have, 0) / w AS weight_share, CASE WHEN coalesce(have, 0) / w >= 0.6 THEN s / nullif(have, 0) * 100 END AS score FROM cats0),
tot0 AS (SELECT ticker, sum(score / 100 * cw) AS s, sum(CASE WHEN score IS NOT NULL THEN cw END) AS have, sum(cw) AS w FROM cats JOIN catw USING (category) GROUP BY 1),
tot AS (SELECT ticker, coalesce(have, 0) / w AS weight_share, CASE WHEN coalesce(have, 0) / w >= 0.6 THEN s / nullif(have, 0) * 100 END AS score FROM tot0),
scores AS (
  SELECT u.ticker, u.name, u.sector, CASE WHEN t.score IS NOT NULL THEN rank() OVER (ORDER BY round_even(t.score * 10, 0) / 10 DESC NULLS LAST) END AS position,
    round_even(t.score * 10, 0) / 10 AS total_score, round_even(t.weight_share * 100, 0) / 100 AS total_weight_share,
    round_even(e.score * 10, 0) / 10 AS economic_score, e.n_indicators AS economic_n_indicators, round_even(e.weight_share * 100, 0) / 100 AS economic_weight_share,
    round_even(s.score * 10, 0) / 10 AS social_score, s.n_indicators AS social_n_indicators, round_even(s.weight_share * 100, 0) / 100 AS social_weight_share,
    round_even(v.score * 10, 0) / 10 AS environmental_score, v.n_indicators AS environmental_n_indicators, round_even(v.weight_share * 100, 0) / 100 AS environmental_weight_share
  FROM universe u LEFT JOIN tot t USING (ticker) LEFT JOIN (SELECT * FROM cats WHERE category = 'economic') e USING (ticker)
    LEFT JOIN (SELECT * FROM cats WHERE category = 'social') s USING (ticker) LEFT JOIN (SELECT * FROM cats WHERE category = 'environmental') v USING (ticker)),
prices AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_extendedprice / nullif(l_quantity, 0)), 9) AS close FROM lineitem GROUP BY 1, 2)
"""
