"""Market caps, return series, risk, and the carbon-price stress."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.functions.numbers import clip, ratio
from cinderflow.operators.aggregates import pearson
from cinderflow.operators.joins import asof_within
from cinderflow.operators.portfolio import weighted_over

MAX_AGE = 400
PRICES = (0, 25, 50, 75, 100, 130, 175, 200, 250)
HEAVY = 0.25


def latest_month(prices: DataFrame, universe_size: DataFrame, share: float = 0.95) -> DataFrame:
    """month: the newest that has prices of at least `share` of the universe (universe_size: one row, n)."""
    counts = prices.where("close is not null").groupBy("month").agg(F.countDistinct("symbol").alias("_c"))
    return counts.crossJoin(F.broadcast(universe_size)).where(F.col("_c") >= share * F.col("n")).agg(F.max("month").alias("month"))


def caps(shares: DataFrame, prices: DataFrame, splits: DataFrame, asked: DataFrame) -> DataFrame:
    """cik, month, cap of asked (cik, month): the newest share count within MAX_AGE days of the month's end, all its
    lines times price and later splits; NULL if any line has no price.

    shares: cik, symbol, as_of, shares, source ('frame' beats 'cover' of the same day). prices: symbol, month, close.
    """
    ends = asked.withColumn("end", F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    met = asof_within(ends, shares, "cik", "end", "as_of", MAX_AGE)
    best = F.max(F.col("source") == "frame").over(Window.partitionBy("cik", "month"))
    lines = met.withColumn("_f", best).where(~F.col("_f") | (F.col("source") == "frame"))
    # Split ratios by symbol and day, then one factor for each line.
    daily = splits.groupBy("symbol", F.to_date("date").alias("day")).agg(F.product("ratio").alias("r"))
    keys = ["cik", "month", "symbol", "as_of", "shares"]
    factor = lines.select(*keys).join(daily, "symbol", "left").groupBy(*keys).agg(F.product(F.when(F.col("day") > F.col("as_of"), F.col("r")).otherwise(1.0)).alias("factor"))
    priced = factor.join(prices, ["symbol", "month"], "left")
    cap = F.when(F.count_if(F.col("close").isNull()) == 0, F.sum(F.col("shares") * F.col("close") * F.coalesce("factor", F.lit(1.0))))
    return asked.join(priced.groupBy("cik", "month").agg(cap.alias("cap")), ["cik", "month"], "left")


def returns(prices: DataFrame) -> DataFrame:
    """symbol, month, ret: change to the month before; NULL where a price is missing.

    Months are the calendar, so a gap in a symbol's prices is no return.
    """
    at = F.to_date(F.concat("month", F.lit("-01")))
    now = prices.withColumn("_m", at)
    then = prices.select("symbol", F.add_months(at, 1).alias("_m"), F.col("close").alias("_c"))
    return now.join(then, ["symbol", "_m"]).select("symbol", "month", (ratio(F.col("close"), F.col("_c")) - 1).alias("ret")).where("ret is not null")


def series(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """month, ret: weights (symbol, weight) rescaled over the names that have a return in the month."""
    held = rets.join(weights.where("weight > 0"), "symbol")
    return held.groupBy("month").agg(ratio(F.sum(F.col("ret") * F.col("weight")), F.sum("weight")).alias("ret"))


def last_months(monthly: DataFrame, n: int) -> DataFrame:
    """The newest n months; there is one row a month, so the limit is a top-n."""
    return monthly.orderBy(F.desc("month")).limit(n)


def stats(monthly: DataFrame, r: str, by=()) -> DataFrame:
    """Annual return, volatility, drawdown and total of monthly returns. The start is no peak."""
    order = Window.partitionBy(*by, F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    grown = monthly.withColumn("_g", F.product(1 + F.col(r)).over(order))
    grown = grown.withColumn("_d", F.col("_g") / F.max("_g").over(order) - 1)
    total = F.max_by("_g", "month")
    return grown.groupBy(*by).agg(
        (F.pow(total, 12 / F.count(F.lit(1))) - 1).alias("annual_return"), (F.stddev_samp(r) * F.sqrt(F.lit(12.0))).alias("volatility"), F.min("_d").alias("max_drawdown"), (total - 1).alias("total_return"), F.count(F.lit(1)).alias("months")
    )


def risk_report(rets: DataFrame, fund: DataFrame, months: int = 36, least: int = 12) -> DataFrame:
    """One row: tracking error and correlation of the fund (symbol, weight, benchmark_weight) with its index over the last months; none if fewer than `least`."""
    a = series(rets, fund.select("symbol", "weight")).withColumnRenamed("ret", "fund")
    b = series(rets, fund.select("symbol", F.col("benchmark_weight").alias("weight"))).withColumnRenamed("ret", "index")
    both = last_months(a.join(b, "month"), months)
    out = both.agg(F.count(F.lit(1)).alias("months"), (F.stddev_samp(F.col("fund") - F.col("index")) * F.sqrt(F.lit(12.0))).alias("tracking_error"), pearson(F.col("fund"), F.col("index")).alias("correlation"))
    return out.where(F.col("months") >= least)


def profit_at_risk(tonnes, pretax, price):
    """Share of pre-tax profit a carbon price takes: no tonnes 0, a loss all of it (if there is a price), unknown income NULL."""
    return F.when(F.coalesce(tonnes, F.lit(0.0)) <= 0, 0.0).when(pretax <= 0, F.when(price > 0, 1.0).otherwise(0.0)).otherwise(clip(ratio(tonnes * price, pretax), 0.0, 1.0))


def stress(exposure: DataFrame, funds: DataFrame, prices=PRICES, heavy: float = HEAVY) -> DataFrame:
    """fund, price, risk, covered, heavy_share. exposure: ticker, tonnes, pretax; funds: fund, ticker, weight."""
    grid = exposure.sparkSession.createDataFrame([(float(p),) for p in prices], "price double")
    held = funds.where("weight > 0").join(exposure, "ticker", "left").crossJoin(F.broadcast(grid))
    risk = F.when(F.col("tonnes").isNotNull(), profit_at_risk(F.col("tonnes"), F.col("pretax"), F.col("price")))
    at, w = held.withColumn("risk", risk), F.col("weight")
    mean, cover = weighted_over(F.col("risk"), w)
    known = F.sum(F.when(F.col("risk").isNotNull(), w))
    return at.groupBy("fund", "price").agg(mean.alias("risk"), cover.alias("covered"), ratio(F.coalesce(F.sum(F.when(F.col("risk") >= heavy, w)), F.lit(0.0)), known).alias("heavy_share"))


def decision(status, weight, bench):
    """excluded, less, same or more money than in the index."""
    rel = F.coalesce(ratio(weight, bench), F.lit(1.0))
    return F.when(status == "excluded_policy", "excluded").when(rel < 0.9, "less").when(rel > 1.1, "more").otherwise("same")


def share_counts(frames: DataFrame, covers: DataFrame, universe: DataFrame, needed: DataFrame, days: int = MAX_AGE) -> DataFrame:
    """cik, symbol, as_of, shares, source: counts of frames for companies with one ticker, and of cover pages for companies that lack a count
    within `days` before any of the needed dates.

    frames: cik, as_of, shares; covers: cik, symbol, as_of, shares; universe: ticker, cik; needed: day.
    """
    tickers = universe.groupBy("cik").agg(F.count(F.lit(1)).alias("_n"), F.min("ticker").alias("symbol"))
    single = frames.join(tickers.where("_n = 1"), "cik").select("cik", "symbol", "as_of", "shares", F.lit("frame").alias("source"))
    asked = tickers.select("cik").crossJoin(F.broadcast(needed))
    met = asof_within(asked.withColumnRenamed("day", "end"), single, "cik", "end", "as_of", days).select("cik", F.col("end").alias("day")).distinct()
    lacking = asked.join(met, ["cik", "day"], "left_anti").select("cik").distinct()
    paged = covers.where("as_of is not null").join(lacking, "cik", "left_semi").select("cik", "symbol", "as_of", "shares", F.lit("cover").alias("source"))
    return single.unionByName(paged).dropDuplicates(["cik", "symbol", "as_of", "source"])


def market_coverage(caps: DataFrame) -> DataFrame:
    """One row of caps (cik, month, cap) a month: companies, with_cap, coverage, total."""
    by = caps.groupBy("month").agg(F.count(F.lit(1)).alias("companies"), F.count("cap").alias("with_cap"), F.sum("cap").alias("total"))
    return by.withColumn("coverage", F.col("with_cap") / F.col("companies"))


def month_bars(bars: DataFrame, running: str) -> DataFrame:
    """symbol, month, close: the last bar (symbol, at, close) of each month before the running one; bars without a close don't count."""
    told = bars.where("close is not null").withColumn("month", F.date_format("at", "yyyy-MM")).where(F.col("month") < running)
    return told.groupBy("symbol", "month").agg(F.max_by("close", "at").alias("close"))


def split_ratios(events: DataFrame) -> DataFrame:
    """symbol, date, ratio of split events (symbol, date, numerator, denominator); none without a denominator."""
    good = events.where("denominator <> 0")
    return good.select("symbol", "date", (F.col("numerator") / F.col("denominator")).alias("ratio")).distinct()


def cover_counts(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, symbol, shares, as_of of every share class on a cover page that has a symbol and a count.

    A page's cells become rows; a class's symbol is the first that is given, its count the first number, scaled as the page's head says, as of its column's day.
    """
    from cinderflow.functions.extract import page_cells

    cells = pages.select(key, F.explode(page_cells(F.col(page))).alias("c")).select(key, "c.*")
    of = lambda concept: F.col("concept") == concept
    figure = F.regexp_replace("text", r"[,$\s]", "")
    is_count = of("dei_EntityCommonStockSharesOutstanding") & figure.rlike(r"^\d+(?:\.\d+)?$")
    classes = cells.where(~of("head") & ~of("day")).groupBy(key, "member").agg(
        F.min_by(F.when(of("dei_TradingSymbol") & (F.col("text") != ""), F.upper("text")), F.when(of("dei_TradingSymbol") & (F.col("text") != ""), F.col("place"))).alias("symbol"),
        F.min(F.when(is_count, F.struct("place", figure.cast("double").alias("n")))).alias("count"),
    )
    head = F.lower(F.max(F.when(of("head"), F.col("text"))))
    scale = F.when(head.contains("in millions"), 1_000_000).when(head.contains("in thousands"), 1000).otherwise(1)
    # "Dec. 31, 2023" and "Dec 31, 2023"
    day = F.to_date(F.try_to_timestamp(F.replace(F.col("text"), F.lit("."), F.lit("")), F.lit("MMM d, yyyy")))
    told = cells.groupBy(key).agg(scale.alias("scale"), F.map_from_entries(F.collect_list(F.when(of("day"), F.struct(F.col("place"), day.alias("day"))))).alias("days"))
    met = classes.where((F.col("symbol") != "") & ~F.col("symbol").isin("NONE", "N/A") & F.col("count").isNotNull()).join(told, key)
    return met.select(key, "symbol", (F.col("count.n") * F.col("scale")).alias("shares"), F.try_element_at("days", F.col("count.place")).alias("as_of"))
