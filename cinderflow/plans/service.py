"""What a service would answer, as functions that return DataFrames, and rows-only text queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from cinderflow import service
from cinderflow.config import CATEGORIES
from cinderflow.functions import extract
from cinderflow.functions.numbers import r6
from cinderflow.operators import market, portfolio, scoring
from cinderflow.plans import check_queries
from cinderflow.plans import fixtures as X
from cinderflow.plans.portfolio_queries import FUND, ORACLE as FUND_ORACLE, fund
from cinderflow.plans.score_queries import CW, _ranks
from cinderflow.plans.score_queries import ORACLE as SCORE_ORACLE
from cinderflow.sources import files
from cinderflow.storage import ship_package
from cinderflow.streaming import events


def h03_explain_one(spark, d, ticker="7"):
    """The explanation of one entity with the rows behind it."""
    ranks = _ranks(spark, d)
    told = scoring.explain(ranks, scoring.category_scores(ranks, X.PROFILE.min_weight_share), CW).where(F.col("ticker") == ticker)
    return told.select("indicator_id", "category", "year", r6(F.col("value")).alias("value"), r6(F.col("rank01")).alias("rank01"), r6(F.col("points")).alias("points"))


def h04_portfolio(spark, d):
    """Holdings of the fund; why each is held as it is, is v12_reasons."""
    got = portfolio.with_dollars(fund(spark, d), 1e6)
    return got.select("ticker", *[F.round(c, 9).alias(c) for c in ("weight", "benchmark_weight", "active_weight")], "status", "usd")


def h08_trace(spark, d, ticker="7"):
    """Every step of one holding's weight."""
    cols = ["benchmark_weight", "eligible", "z", "tilted", "neutral", "weight"]
    return fund(spark, d).where(F.col("ticker") == ticker).select("ticker", *[F.round(c, 9).alias(c) for c in cols])


def _told(spark, d):
    """Conversation texts with statements of the kind that filings make."""
    ship_package(spark)
    n = F.format_number(F.col("conv_id") * 37 + 100, 0)
    said = F.concat(F.lit("Item 1. Business\nAs of year end we employed approximately "), n, F.lit(" full-time employees. The pay ratio of median compensation is "), (F.col("conv_id") % 300 + 2).cast("string"), F.lit(" to 1 &amp; more.\nItem 2. Properties\n"))
    return X.table(spark, d, "conversations").withColumn("said", F.concat(said, "text"))


def x04_stated_employees(spark, d):
    return _told(spark, d).select("conv_id", "turn", extract.stated_employees("said").alias("employees"))


def x05_headcount_udf(spark, d):
    return _told(spark, d).select("conv_id", "turn", extract.headcount("said").alias("h")).select("conv_id", "turn", "h.value", "h.quote")


def x06_candidates_udf(spark, d):
    got = _told(spark, d).select("conv_id", "turn", extract.ratio_candidates("said").alias("c"))
    return got.select("conv_id", "turn", extract.best_ratio(F.col("c")).alias("ratio"), F.size("c").alias("candidates"))


def x07_section_udf(spark, d):
    return _told(spark, d).select("conv_id", "turn", extract.section("said", F.lit("Business")).alias("section"))


def x08_disclosures(spark, d):
    return _told(spark, d).select("conv_id", "turn", extract.disclosure_types(F.col("said")).alias("types"))


def fs14_unescape_udf(spark, d):
    return _told(spark, d).select("conv_id", "turn", extract.unescaped("said").alias("text"))


def z_tumbling_counts(spark, d):
    got = events.counted(X.table(spark, d, "events"))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6(F.col("total")).alias("total"))


def h02_sectors(spark, d):
    """The sector part of the score answer, for weights a request gives."""
    profile = service.asked_profile(X.PROFILE, {"economic": 1, "environmental": 2})
    got = service.score_answer(X.universe(spark, d), X.facts(spark, d), X.catalog(spark), profile)["sectors"]
    return got.select("sector", "companies", "scored", *[r6(F.col(c)).alias(c) for c in ("total", *CATEGORIES)])


def h02_fingerprints(spark, d):
    return service.score_answer(X.universe(spark, d), X.facts(spark, d), X.catalog(spark), X.PROFILE)["fingerprints"]


def h02_rows(spark, d):
    """The rows of the score answer, as a request without weights of its own gets them."""
    got = service.score_answer(X.universe(spark, d), X.facts(spark, d), X.catalog(spark), service.asked_profile(X.PROFILE))["rows"]
    return got.select("ticker", "position", "total_score")


#: A filing of each company: sentences on the themes, filler, and one that hedges.
_FILING = ["Our plants cut greenhouse gas emissions by {n} percent in 2023 and carbon use fell by {n} metric tons over the whole year at all sites.",
           "We may face a lawsuit or class action that could cost us a great deal and we cannot assure any outcome in 2024 or in later years.",
           "In 2022 the company agreed to pay ${n} million in a settlement agreement over alleged violations of the safety rules at one plant.",
           "Safety training reached {n} percent of all staff and turnover fell, as the collective bargaining round of 2021 had set out to do.",
           "The stores opened on time and sold more of all goods than in any year before that one, which pleased all those who hold shares in it."]


def _filings(spark, d):
    n = (F.col("ordinal") % 40 + 2).cast("string")
    said = [F.concat(*[p for piece in s.replace("{n}", "\0{n}\0").split("\0") for p in ([n] if piece == "{n}" else [F.lit(piece)])]) for s in _FILING]
    return X.universe(spark, d).select(F.col("cik").alias("entity"), "ordinal", F.concat_ws(" ", *[F.when(F.col("ordinal") % (k + 2) != 0, s) for k, s in enumerate(said)]).alias("text"))


def q13_passages(spark, d):
    """An audit's most concrete sentences of every filing, by theme."""
    got = service.passages(_filings(spark, d).groupBy("entity").agg(F.min_by("text", "ordinal").alias("text")))
    return got.select("entity", "theme", "place", "sentence", F.col("score").cast("int").alias("score"))


def _notes(spark, d):
    said = F.concat(F.lit('source; quote: "and the median of all employees of the company earned '), "ticker", F.lit(' thousand dollars in the year that went by" | page 3'))
    return X.facts(spark, d).select("ticker", "indicator_id", "year", F.when(F.col("indicator_id").isin("soc1", "soc2"), said).otherwise("no words").alias("note"))


def q13_quotes(spark, d):
    return service.quotes(_notes(spark, d))


def h05_audit(spark, d, ticker="7"):
    """One company's regulator record of the audit answer."""
    cases = X.bought(spark, d).where("l_returnflag = 'R'").select(F.col("ticker").alias("cik"), F.col("l_orderkey").alias("case"), "year", F.col("l_extendedprice").alias("penalty"))
    got = service.audit(X.universe(spark, d), ticker, _filings(spark, d), _notes(spark, d), cases, X.order_years(spark, d).select("ticker", "year", F.col("total").alias("tonnes")))
    return got["cases"].select("case", "year", F.round("penalty", 4).alias("penalty"))


def h06_evidence(spark, d):
    """Caught later, for weights that a request chose."""
    profile = service.asked_profile(replace(X.PROFILE, min_year=1996), {"economic": 1, "social": 1, "environmental": 2})
    later = X.bought(spark, d).where("year >= 2000 and l_returnflag = 'R' and l_quantity >= 48")
    got = service.evidence("caught_later", X.universe(spark, d), X.facts(spark, d), X.catalog(spark), profile, upto=1999, outcome=later)
    return got.select("bucket", "companies", "hits", r6(F.col("share")).alias("share"))


def h09_checks(spark, d):
    """Kept results of checks, and not_run for those without one."""
    from cinderflow.storage import fresh_path

    folder = fresh_path(spark, "checks")
    files.write_result(X.catalog(spark).select("indicator_id", "weight"), f"{folder}/redundancy", "redundancy", "passed")
    return service.stored_checks(spark, folder, ["caught_later", "redundancy", "stability"]).select("id", "status")


def c15_kept_scores(spark, d):
    """Scores built, kept as CSV and read back."""
    from cinderflow.storage import fresh_path

    got = service.build_scores(X.universe(spark, d), X.facts(spark, d), X.catalog(spark), X.PROFILE, fresh_path(spark, "scores"))
    return got.select("ticker", "position", "total_score")


def k01_share_counts(spark, d):
    o = X.table(spark, d, "orders")
    u = X.universe(spark, d)
    frames = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").cast("string").alias("cik"), F.to_date("o_orderdate").alias("as_of")).agg(F.max("o_totalprice").alias("shares"))
    covers = o.where("o_orderkey % 3 = 1").groupBy(F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit("S"), (F.col("o_orderkey") % 2).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("as_of")).agg(F.max("o_totalprice").alias("shares"))
    days = spark.createDataFrame([("1998-06-30",), ("1999-06-30",)], "day string").select(F.to_date("day").alias("day"))
    got = market.share_counts(frames, covers, u, days)
    return got.select("cik", "symbol", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), F.round("shares", 4).alias("shares"), "source")


_COVER = ('<table><tr><th class="tl"><div>Cover - shares in thousands</div></th><th class="th"><div>Dec. 31, 2023</div></th><th class="th"><div>Jan. 20, 2024</div></th></tr>'
          '<tr><td onclick="defref_dei_TradingSymbol\'"></td><td class="text">none</td></tr><tr><td onclick="x defref_us-gaap_StatementClassOfStockAxis=A\'"></td></tr>'
          '<tr><td onclick="defref_dei_TradingSymbol\'"></td><td class="text"> ab{n} </td></tr><tr><td onclick="defref_dei_EntityCommonStockSharesOutstanding\'"></td><td class="text">&nbsp;</td><td class="nump">1,{n}</td></tr></table>')  # fmt: skip


def k02_cover_pages(spark, d):
    ship_package(spark)
    n = F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")
    page = F.replace(F.lit(_COVER), F.lit("{n}"), n)
    got = market.cover_counts(X.table(spark, d, "supplier").select("s_suppkey", page.alias("page")), "s_suppkey", "page")
    return got.select("s_suppkey", "symbol", "shares", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


def k03_split_ratios(spark, d):
    e = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.floor("l_quantity").alias("numerator"), (F.col("l_linenumber") - 1).alias("denominator"))
    return market.split_ratios(e).withColumn("ratio", r6(F.col("ratio")))


def v16_market_coverage(spark, d):
    from cinderflow.plans.portfolio_queries import k05_caps

    got = market.market_coverage(k05_caps(spark, d))
    return got.select("month", "companies", "with_cap", F.round("total", 2).alias("total"), r6(F.col("coverage")).alias("coverage"))


QUERIES = {f.__name__: f for f in (h02_sectors, h02_fingerprints, h02_rows, q13_passages, q13_quotes, h05_audit, h06_evidence, h09_checks, c15_kept_scores, k01_share_counts, k02_cover_pages, k03_split_ratios, v16_market_coverage, h03_explain_one, h04_portfolio, h08_trace, x04_stated_employees, x05_headcount_udf, x06_candidates_udf, x07_section_udf, x08_disclosures, fs14_unescape_udf, z_tumbling_counts)}
_SAID = "'Item 1. Business' || chr(10) || 'As of year end we employed approximately ' || n || ' full-time employees. '"
_NO_SOCIAL = X.SQL.replace("('social',1.0),", "('social',0.0),").replace("JOIN catw USING (category)", "JOIN catw USING (category) WHERE cw > 0")
_SCORED = X.SQL + "SELECT ticker, CAST(position AS INTEGER) AS position, total_score FROM scores"
_SENT = " UNION ALL ".join(f"SELECT cik AS entity, ordinal, {k} AS pos, replace('{s}', '{{n}}', CAST(ordinal % 40 + 2 AS VARCHAR)) AS sentence FROM firsts WHERE ordinal % {k + 2} <> 0" for k, s in enumerate(_FILING))
_THEME_SQL = " UNION ALL ".join(f"SELECT entity, pos, sentence, '{k}' AS theme, len(regexp_extract_all(lower(sentence), '{p}')) AS n FROM told" for k, p in service.THEMES.items())
ORACLE = {
    "h02_sectors": _NO_SOCIAL + "SELECT sector, count(*) AS companies, count(total_score) AS scored, round(quantile_cont(total_score, 0.5), 6) AS total, round(quantile_cont(economic_score, 0.5), 6) AS economic, round(quantile_cont(social_score, 0.5), 6) AS social, round(quantile_cont(environmental_score, 0.5), 6) AS environmental FROM scores WHERE sector <> '' GROUP BY 1",
    "h02_fingerprints": X.SQL + """SELECT ticker, '{' || string_agg('"' || indicator_id || '":' || CAST(CAST(round_even(rank01 * 100, 0) AS INTEGER) AS VARCHAR), ',' ORDER BY indicator_id) || '}' AS points FROM ranks WHERE rank01 IS NOT NULL GROUP BY 1""",
    "h02_rows": _SCORED, "c15_kept_scores": _SCORED, "h06_evidence": check_queries.ORACLE["q04_point_in_time"],
    "q13_passages": X.SQL + f""", firsts AS (SELECT cik, min(ordinal) AS ordinal FROM universe GROUP BY 1), s AS ({_SENT}), told AS (SELECT * FROM s WHERE length(sentence) BETWEEN 80 AND 360 AND NOT regexp_matches(lower(sentence), '{service.NOT_THEME}')), th AS ({_THEME_SQL}),
      k AS (SELECT *, 2 * CASE WHEN regexp_matches(lower(sentence), '{service.CONCRETE}') THEN 1 ELSE 0 END + n - 2 * len(regexp_extract_all(lower(sentence), '{service.HEDGES}')) AS score FROM th WHERE n > 0)
      SELECT entity, theme, CAST(place AS INTEGER) AS place, sentence, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity, theme ORDER BY score DESC, pos) AS place FROM k WHERE score >= 2) WHERE place <= 2""",
    "q13_quotes": X.SQL + """SELECT ticker, indicator_id, year, '…the median of all employees of the company earned ' || ticker || ' thousand dollars in the year that went…' AS quote FROM newest WHERE indicator_id IN ('soc1', 'soc2')""",
    "h05_audit": X.SQL + """SELECT l_orderkey AS "case", year, round(l_extendedprice, 4) AS penalty FROM bought WHERE l_returnflag = 'R' AND ticker = (SELECT cik FROM universe WHERE ticker = '7')""",
    "h09_checks": "SELECT * FROM (VALUES ('caught_later', 'not_run'), ('redundancy', 'passed'), ('stability', 'not_run')) AS t(id, status)",
    "k01_share_counts": X.SQL + """, tk AS (SELECT cik, count(*) AS n, min(ticker) AS symbol FROM universe GROUP BY 1), fr AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderdate AS DATE) AS as_of, max(o_totalprice) AS shares FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
      cv AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, 'S' || (o_orderkey % 2) AS symbol, CAST(o_orderdate AS DATE) AS as_of, max(o_totalprice) AS shares FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1, 2, 3), sg AS (SELECT fr.cik, symbol, as_of, shares FROM fr JOIN tk USING (cik) WHERE n = 1),
      lk AS (SELECT DISTINCT cik FROM tk CROSS JOIN (VALUES (DATE '1998-06-30'), (DATE '1999-06-30')) AS q(day) WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.cik = tk.cik AND sg.as_of <= day AND date_diff('day', sg.as_of, day) <= 400))
      SELECT cik, symbol, strftime(as_of, '%Y-%m-%d') AS as_of, round(shares, 4) AS shares, 'frame' AS source FROM sg UNION ALL SELECT cik, symbol, strftime(as_of, '%Y-%m-%d'), round(shares, 4), 'cover' FROM cv WHERE cik IN (SELECT cik FROM lk)""",
    "k02_cover_pages": "SELECT s_suppkey, 'AB' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS symbol, CAST('1' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS DOUBLE) * 1000 AS shares, '2024-01-20' AS as_of FROM supplier",
    "k03_split_ratios": "SELECT DISTINCT l_suppkey AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS date, round(floor(l_quantity) / (l_linenumber - 1), 6) AS ratio FROM lineitem WHERE l_linenumber <> 1",
    "v16_market_coverage": "WITH caps AS (" + FUND_ORACLE["k05_caps"] + ") SELECT month, count(*) AS companies, count(cap) AS with_cap, round(sum(cap), 2) AS total, round(count(cap) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM caps GROUP BY 1",
    "h03_explain_one": SCORE_ORACLE["c12_explain"].replace("SELECT ticker, category, indicator_id, round(rank01, 6) AS rank01, round(CAST(sic AS DOUBLE), 6) AS share_in_category,", "SELECT indicator_id, category, year, round(value, 6) AS value, round(rank01, 6) AS rank01,") + " WHERE ticker = '7'",
    "h04_portfolio": FUND + "SELECT ticker, round(w, 9) AS weight, round(b, 9) AS benchmark_weight, round(w - b, 9) AS active_weight, status, round_even(w * 1000000, 0) AS usd FROM fs",
    "h08_trace": FUND + "SELECT ticker, round(b, 9) AS benchmark_weight, round(e, 9) AS eligible, round(z, 9) AS z, round(t, 9) AS tilted, round(n, 9) AS neutral, round(w, 9) AS weight FROM fs WHERE ticker = '7'",
    "x04_stated_employees": "SELECT conv_id, turn, conv_id * 37 + 100 AS employees FROM conversations",
    "z_tumbling_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2",
}
