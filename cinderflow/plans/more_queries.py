"""Queries of the remaining data operators: roll-ups, indexes, aliases, denominators, price and share builders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderflow.functions import dates, text
from cinderflow.functions.numbers import r6, ratio
from cinderflow.operators import joins as J
from cinderflow.operators import ranking as R
from cinderflow.plans import fixtures as X

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


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderstatus <> 'P', o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def z01_lookup(spark, d):
    """The latest value that is not blank ('P' stands for blank); a blank only where there is no other."""
    o = _t(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct(F.col("o_orderstatus") != "P", "o_orderdate", "o_orderkey")).alias("status"))


@query("SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey, l_extendedprice)) AS l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def z02_transactions(spark, d):
    """Of known filers only, one row an id, the first by file order."""
    known = _t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    l = _t(spark, d, "lineitem").join(known, "l_suppkey", "left_semi")
    return l.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_partkey", "l_extendedprice")).alias("l_partkey"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, round(sum(l_extendedprice), 2) AS amount, count(*) AS n FROM lineitem WHERE coalesce(l_linestatus, '') <> 'X' GROUP BY 1, 2, 3, 4, 5")
def z03_rollup(spark, d):
    l = _t(spark, d, "lineitem").where(F.coalesce("l_linestatus", F.lit("")) != "X")
    return l.groupBy("l_suppkey", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count(F.lit(1)).alias("n"))


@query("SELECT name, array_to_string(list_sort(list(DISTINCT k)), '|') AS ids FROM (SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS k FROM part UNION ALL SELECT lower(p_type), CAST(p_partkey AS VARCHAR) FROM part) WHERE name <> '' GROUP BY 1")
def z04_inverted_index(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b"), F.col("p_partkey").cast("string").alias("k"))
    return p.unpivot("k", ["a", "b"], "c", "name").where("name <> ''").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("k")), "|").alias("ids"))


@query("""WITH u AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)), f AS (SELECT string_split(lower(p_type), ' ')[1] AS w, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT c_custkey, (SELECT count(*) FROM f) AS loose FROM u""")
def z07_review_unmatched(spark, d):
    o = _t(spark, d, "orders").where(F.year("o_orderdate") == 2001)
    left = _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    firsts = _t(spark, d, "part").agg(F.countDistinct(F.get(F.split(F.lower("p_type"), " "), F.lit(0))).alias("loose"))
    return left.crossJoin(F.broadcast(firsts)).select("c_custkey", "loose")


@query(P + "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2")
def z10_first_and_last(spark, d):
    by = F.struct("o_orderdate", "o_orderkey")
    return _t(spark, d, "orders").where("o_totalprice > 0").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.min_by("o_orderkey", by).alias("first_key"), F.max_by("o_orderkey", by).alias("last_key"))


@query(P + "SELECT ticker, CAST(year AS VARCHAR) || 'Q' || CAST(q AS VARCHAR) AS quarter, round(total, 6) AS value FROM order_years CROSS JOIN (VALUES (1), (2), (3), (4)) t(q)")
def z14_quarters_of_years(spark, d):
    y = X.order_years(spark, d).select("ticker", "year", "total", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("q"))
    return y.select("ticker", F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("q").cast("string")).alias("quarter"), r6(F.col("total")).alias("value"))


@query(P + "SELECT year, count(*) AS entities, count(*) FILTER (n >= 3) AS dense, CASE WHEN count(*) >= 100 THEN 'ok' ELSE 'thin' END AS verdict FROM order_years GROUP BY 1")
def z15_coverage_report(spark, d):
    by = X.order_years(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") >= 3).alias("dense"))
    return by.withColumn("verdict", F.when(F.col("entities") >= 100, "ok").otherwise("thin"))


@query("SELECT o_custkey AS k, CAST(y AS VARCHAR) || 'Q' || CAST((m - 1) // 3 + 1 AS VARCHAR) AS quarter, round(sum(v), 4) AS value FROM (SELECT o_custkey, (month(o_orderdate) + 8) % 12 + 1 AS m, year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS y, o_totalprice AS v FROM orders) GROUP BY 1, 2")
def z17_fiscal_quarters(spark, d):
    """Fiscal months and years to calendar quarters: month 1 is October of the year before."""
    m = F.month("o_orderdate")
    o = _t(spark, d, "orders").withColumn("m", dates.calendar_month(m)).withColumn("y", F.year("o_orderdate") - F.when(m <= 3, 1).otherwise(0))
    label = F.concat(F.col("y").cast("string"), F.lit("Q"), F.floor((F.col("m") - 1) / 3 + 1).cast("string"))
    return o.groupBy(F.col("o_custkey").alias("k"), label.alias("quarter")).agg(F.round(F.sum("o_totalprice"), 4).alias("value"))


@query("SELECT p_brand, p_type, round(p / sum(p) OVER (PARTITION BY p_brand), 6) AS weight FROM (SELECT p_brand, p_type, sum(p_retailprice) AS p FROM part GROUP BY 1, 2)")
def z22_bills(spark, d):
    by = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("p"))
    return by.select("p_brand", "p_type", r6(ratio(F.col("p"), F.sum("p").over(Window.partitionBy("p_brand")))).alias("weight"))


@query(P + "SELECT DISTINCT indicator_id, year FROM facts")
def z28_years(spark, d):
    return X.facts(spark, d).select("indicator_id", "year").distinct()


@query("SELECT p_partkey, arg_min(owner, ordinal) AS owner FROM (SELECT p.p_partkey, n.ordinal, n.name AS owner FROM part p JOIN (SELECT min(p_partkey) AS ordinal, p_name AS name FROM part GROUP BY 2) n ON contains(' ' || p.p_name || ' of ' || lower(p.p_brand) || ' ', ' ' || n.name || ' ')) GROUP BY 1")
def j20_containment(spark, d):
    """Whole-word containment; of several names the first in universe order."""
    p = _t(spark, d, "part")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal"))
    texts = p.select("p_partkey", F.concat("p_name", F.lit(" of "), F.lower("p_brand")).alias("text"))
    return J.token_candidates(names, texts, "name", "text").groupBy("p_partkey").agg(F.min_by("name", "ordinal").alias("owner"))


@query("SELECT a.p_partkey, c.core FROM part a JOIN (SELECT DISTINCT string_split(lower(p_type), ' ')[1] AS core FROM part) c ON lower(a.p_type) = c.core OR starts_with(lower(a.p_type), c.core || ' ')")
def j21_prefix_match(spark, d):
    """A name equals a core or starts with it and a space: prefixes of whole words are the join key."""
    p = _t(spark, d, "part").withColumn("name", F.lower("p_type"))
    words = F.split("name", " ")
    keys = p.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("core"))
    return keys.join(p.select(F.get(words, F.lit(0)).alias("core")).distinct(), "core").select("p_partkey", "core")


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(coalesce(max(CASE WHEN o_orderpriority < '3' THEN o_totalprice END), arg_min(CASE WHEN o_orderpriority >= '3' THEN o_totalprice END, CASE WHEN o_orderpriority >= '3' THEN (o_orderpriority, o_orderkey) END)), 6) AS revenue FROM orders GROUP BY 1, 2")
def i19_revenue(spark, d):
    """The largest of the total tags, else the first fallback tag."""
    total = F.max(F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice")))
    other = F.min_by("o_totalprice", F.when(F.col("o_orderpriority") >= "3", F.struct("o_orderpriority", "o_orderkey")))
    return _t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(r6(F.coalesce(total, other)).alias("revenue"))


@query("SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS level FROM events GROUP BY 1")
def i07_ordinal_target(spark, d):
    """Ordinal levels of commitments; the best row of a company counts."""
    kind = F.col("event_type")
    return _t(spark, d, "events").groupBy("user_id").agg(F.max(F.when(kind == "purchase", 4).when(kind == "click", 2).when(kind == "view", 1).otherwise(0)).alias("level"))


@query("SELECT l_suppkey AS symbol, strftime(l_shipdate, '%Y-%m') AS month, round(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey)), 6) AS close FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') < (SELECT max(strftime(l_shipdate, '%Y-%m')) FROM lineitem) GROUP BY 1, 2")
def k03_last_bar(spark, d):
    """The last bar of each month; the running month goes."""
    l = _t(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    now = l.agg(F.max("month").alias("running"))
    kept = l.crossJoin(F.broadcast(now)).where("month < running")
    return kept.groupBy(F.col("l_suppkey").alias("symbol"), "month").agg(r6(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))).alias("close"))


@query(P + "SELECT l.ticker, l.year, round(q, 6) AS tonnes, round(total, 6) AS pretax FROM (SELECT *, max(year) OVER (PARTITION BY ticker) AS m FROM line_years) l LEFT JOIN order_years o ON o.ticker = l.ticker AND o.year = l.year WHERE l.year = m")
def k09_exposure(spark, d):
    """Income of the same year as the tonnes, else none."""
    tonnes = R.latest(X.bought(spark, d).groupBy("ticker", "year").agg(F.sum("l_quantity").alias("q")), ["ticker"])
    return tonnes.join(X.order_years(spark, d).select("ticker", "year", "total"), ["ticker", "year"], "left").select("ticker", "year", r6(F.col("q")).alias("tonnes"), r6(F.col("total")).alias("pretax"))


@query("SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')), lambda x: x NOT IN ('the', 'and', 'for'))) AS INTEGER) AS n, contains(' ' || lower(text) || ' ', ' the ') AS has FROM conversations")
def fs09_distinctive(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(text.distinctive_words(F.col("text"), ["the", "and", "for"])).alias("n"), text.contains_words(F.lower("text"), F.lit("the")).alias("has"))


@query("SELECT page_id, CAST(len(list_filter(string_split(regexp_replace(html, '</(?:p|div|td|li|h1|title)>', chr(10), 'g'), chr(10)), lambda x: length(trim(regexp_replace(x, '<[^>]*>', '', 'g'))) > 0)) AS INTEGER) AS lines FROM pages")
def x03_lines(spark, d):
    cut = F.split(F.regexp_replace("html", "</(?:p|div|td|li|h1|title)>", "\n"), "\n")
    return _t(spark, d, "pages").select("page_id", F.size(F.filter(cut, lambda x: F.length(F.trim(F.regexp_replace(x, "<[^>]*>", ""))) > 0)).alias("lines"))


@query("SELECT event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS quote FROM events WHERE regexp_extract(props, '\"k\": *([0-9]+)', 1) <> ''")
def x10_quotes(spark, d):
    got = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    return _t(spark, d, "events").where(got != "").select("event_id", got.alias("quote"))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_custkey % 10 = 1 AND c_name LIKE 'Customer%' AND c_mktsegment = 'BUILDING') OR (c_custkey % 10 = 2 AND c_name LIKE 'Cust%' AND c_mktsegment = 'MACHINERY')")
def p15_label_guard(spark, d):
    """Reviewed overrides with guards: key, name prefix and segment must all fit."""
    rules = spark.createDataFrame([(1, "Customer", "BUILDING"), (2, "Cust", "MACHINERY")], "k long, prefix string, segment string")
    fit = (F.col("c_custkey") % 10 == F.col("k")) & (F.col("c_mktsegment") == F.col("segment")) & F.col("c_name").startswith(F.col("prefix"))
    return _t(spark, d, "customer").join(F.broadcast(rules), fit).select("c_custkey", "c_name")


@query("SELECT a.cik, a.alias FROM (SELECT c_custkey AS cik, lower(c_mktsegment) AS alias, lower(c_name) AS current FROM customer) a WHERE a.alias <> a.current AND a.cik % 4 <> 0")
def e12_aliases(spark, d):
    """Former names that differ from the current one and have not expired."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.lower("c_mktsegment").alias("alias"), F.lower("c_name").alias("current"))
    return c.where("alias <> current and cik % 4 <> 0").select("cik", "alias")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 0 THEN 'none' ELSE 'downloaded' END AS state, CASE WHEN n IS NOT NULL THEN n END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1) ON o_custkey = c_custkey")
def e13_coverage_states(spark, d):
    """Unresolved is a gap, never a zero."""
    o = _t(spark, d, "orders").where(F.year("o_orderdate") == 2000).groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    got = _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return got.select("c_custkey", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 0, "none").otherwise("downloaded").alias("state"), "n")
