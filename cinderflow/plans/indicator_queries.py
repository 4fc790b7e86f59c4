"""Queries of the indicator formulas. Their inputs are views of the sample tables, written in SQL that both engines take."""

from pyspark.sql import functions as F

from cinderflow.functions.numbers import r6
from cinderflow.operators import indicators as I
from cinderflow.plans import fixtures as X

QUERIES, ORACLE = {}, {}


def query(sql):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


#: Views by name; {table} is a sample table or an earlier view.
VIEWS = {
    "tax": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(l_shipdate) AS INT) AS year, max(CAST(l_shipdate AS DATE)) AS period_end, sum(l_extendedprice * l_tax) AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "pretax": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(l_shipdate) AS INT) AS year, max(CASE WHEN l_linenumber <= 5 THEN CAST(l_shipdate AS DATE) END) AS period_end, sum(l_extendedprice * (0.3 - 5 * l_discount)) AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "spend": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.2 ELSE 0 END) AS obligations FROM {orders} GROUP BY 1, 2, 3",
    "name_checks": "SELECT CAST(c_custkey AS STRING) AS ticker, c_custkey % 3 <> 0 AS verified, CASE WHEN c_custkey % 5 = 0 THEN 'AB-1' ELSE c_name END AS search_name FROM {customer}",
    "plants": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(l_shipdate) AS INT) AS year, l_suppkey AS facility_id, l_quantity AS tonnes, 1 - l_discount AS share FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_custkey % 4 <> 0",
    "sales": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS revenue FROM {orders} GROUP BY 1, 2",
    "pledges": """SELECT CAST(p_partkey % 140 AS STRING) AS ticker, CASE WHEN p_partkey % 4 < 2 THEN 'Targets set' WHEN p_partkey % 4 = 2 THEN 'Committed' END AS near,
        CASE p_size % 5 WHEN 0 THEN '1.5°C' WHEN 1 THEN 'Well-below 2°C/1.5°C' WHEN 2 THEN '2°C' WHEN 3 THEN 'to be told' ELSE '1.5C / 2C' END AS classes, CASE WHEN p_partkey % 37 = 0 THEN 'Targets set' WHEN p_partkey % 11 = 0 THEN 'Committed' END AS net_zero FROM {part} WHERE p_partkey % 140 < 100""",
    "output": "SELECT p_brand AS material, s_nationkey AS country, CAST(year(l_shipdate) AS INT) AS year, l_quantity - 1 AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE CAST(substr(p_brand, 7) AS INT) <= year(l_shipdate) - 1980",
    "governed": "SELECT n_nationkey AS country, CAST(year AS INT) AS year, dimension, CASE WHEN (n_nationkey + year + dimension) % 17 <> 0 THEN ((n_nationkey * 7 + year * 3 + dimension * 5) % 50) / 10.0 - 2.5 END AS score FROM {nation} CROSS JOIN (VALUES (1996), (1997), (1998), (1999)) AS y(year) CROSS JOIN (VALUES (1), (2), (3)) AS k(dimension) WHERE n_nationkey % 8 <> 3",
    "mentioned": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(l_shipdate) AS INT) AS year, p_brand AS material FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey",
    "sites": """SELECT CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 50 END AS company, CAST(year(l_shipdate) AS INT) AS year, l_suppkey * 100 + l_partkey % 7 AS site, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS id, l_shipdate AS created,
        CASE l_partkey % 9 WHEN 0 THEN 2 WHEN 1 THEN NULL ELSE 1 END AS sector, CAST(l_suppkey % 10 AS STRING) AS zip, CASE WHEN l_partkey % 13 = 0 THEN 900.0 ELSE 100 + l_quantity END AS employees,
        CASE WHEN l_partkey % 13 = 0 THEN 1800000.0 ELSE (100 + l_quantity) * (300 + (l_partkey * 7) % 4000) END AS hours, CASE WHEN l_partkey % 29 > 0 THEN floor(l_quantity / 20) END AS away, floor(l_discount * 20) AS restricted, CAST(l_linenumber % 2 AS DOUBLE) AS other
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "plans": """SELECT CASE WHEN o_custkey % 13 > 0 THEN o_custkey % 100 END AS company, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey AS STRING) AS ack, o_custkey AS sponsor, o_orderkey % 3 AS number, o_orderpriority AS name,
        CASE o_orderkey % 6 WHEN 0 THEN '2E2J' WHEN 1 THEN '1A2E' WHEN 2 THEN '2t3d' WHEN 3 THEN '3B' WHEN 4 THEN NULL ELSE '2A' END AS codes, CAST(o_orderkey % 300 AS DOUBLE) AS participants, o_totalprice - 20000 AS contributions, CAST(o_orderdate AS DATE) AS received FROM {orders}""",
    "cash_facts": """SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderkey % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'CashNet' WHEN 2 THEN 'Cash' WHEN 3 THEN 'Buy' WHEN 4 THEN 'BuyNet' ELSE 'Dividend' END AS tag,
        make_date(CAST(year(o_orderdate) AS INT), CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END, 1) AS period_start, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period_end, max(CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END) AS val FROM {orders} GROUP BY 1, 2, 3, 4, 5""",
    "denials": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'buybacks' ELSE 'dividends' END AS kind FROM {orders} WHERE o_orderkey % 9 = 0",
    "gifts": """SELECT 'C' || CAST(o_custkey AS STRING) AS committee, CAST(year(l_shipdate) AS STRING) || 'Q' || CAST(quarter(l_shipdate) AS STRING) AS quarter, CASE l_linenumber WHEN 1 THEN '24K' WHEN 2 THEN '24z' WHEN 3 THEN '24G' WHEN 4 THEN NULL ELSE '24E' END AS kind,
        CASE l_suppkey % 4 WHEN 0 THEN 'REP' WHEN 1 THEN 'dem' WHEN 2 THEN 'DEM' END AS party, l_quantity AS amount FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "sponsors": "SELECT 'C' || CAST(c_custkey AS STRING) AS committee, CAST(c_custkey AS STRING) AS ticker FROM {customer} WHERE c_custkey % 4 <> 3 UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), CAST(c_custkey - 1 AS STRING) FROM {customer} WHERE c_custkey % 50 = 1",
    "coverage": "SELECT CAST(c_custkey AS STRING) AS ticker, CASE WHEN c_custkey % 5 = 4 THEN 'unresolved' WHEN c_custkey % 4 = 3 THEN 'no_pac' ELSE 'downloaded' END AS status, CASE WHEN c_custkey % 9 = 0 THEN '1996|1998' ELSE '' END AS gaps FROM {customer}",
    "periods": "SELECT DISTINCT CAST(year(o_orderdate) AS STRING) || 'Q' || CAST(quarter(o_orderdate) AS STRING) AS quarter, CAST(year(o_orderdate) AS INT) AS year, CAST(floor((year(o_orderdate) + 1) / 2) * 2 AS INT) AS cycle, CASE WHEN year(o_orderdate) % 8 < 4 THEN 'REP' ELSE 'DEM' END AS power FROM {orders}",
    "filed": """SELECT CAST(o_custkey AS STRING) AS ticker, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tag, CASE WHEN o_orderkey % 5 = 0 THEN '10-Q' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) - CAST(330 + o_orderkey % 60 AS INT) AS period_start, CAST(o_orderdate AS DATE) AS period_end,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS filed, max(o_totalprice) AS val FROM {orders} GROUP BY 1, 2, 3, 4, 5, 6""",
    "staff": "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS accession, o_orderkey % 97 AS employees FROM {orders}",
    "periodic": """SELECT CAST(o_custkey AS STRING) AS ticker, make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate) AS INT) * 3 - 2, 1) AS period_start, last_day(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate) AS INT) * 3, 1)) AS period_end, make_date(CAST(year(o_orderdate) AS INT) + 1, 1, 15) AS filed, sum(o_totalprice) AS val
        FROM {orders} WHERE NOT (o_custkey % 2 = 0 AND quarter(o_orderdate) = 4) GROUP BY 1, 2, 3, 4 UNION ALL SELECT CAST(o_custkey AS STRING), make_date(CAST(year(o_orderdate) AS INT), 1, 1), make_date(CAST(year(o_orderdate) AS INT), 12, 31), make_date(CAST(year(o_orderdate) AS INT) + 1, 2, 1), sum(o_totalprice) FROM {orders} GROUP BY 1, 2, 3, 4""",
}
TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]


def view(spark, d, name):
    sql = VIEWS[name]
    return spark.sql(sql, **{t: X.table(spark, d, t) for t in TABLES if "{" + t + "}" in sql})


def _with(*names):
    """The views as CTEs for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names)


@query(_with("tax", "pretax") + " SELECT ticker, year, round(0.21 - t.value / p.value, 4) AS value FROM tax t JOIN pretax p USING (ticker, year, period_end) WHERE p.value > 0")
def i01_tax_rate_gap(spark, d):
    return I.tax_rate_gap(view(spark, d, "tax"), view(spark, d, "pretax"))


@query(_with("spend", "name_checks") + """, y AS (SELECT ticker, year, sum(obligations) / sum(revenue) AS x, count(DISTINCT quarter) AS quarters FROM spend GROUP BY 1, 2 HAVING count(DISTINCT quarter) >= 2 AND sum(revenue) > 0)
SELECT ticker, year, round(least(greatest(x, 0), 1), 4) AS value, quarters FROM y LEFT JOIN name_checks USING (ticker) WHERE NOT (x > 0.3 AND NOT coalesce(verified, false)) AND NOT (x > 1 AND coalesce(length(regexp_replace(search_name, '[^A-Za-z0-9]', '', 'g')) <= 3, false))""")
def i05_contract_exposure(spark, d):
    return I.contract_exposure(view(spark, d, "spend"), view(spark, d, "name_checks"))


@query(X.SQL + ", " + _with("plants", "sales").removeprefix("WITH ") + """, owned AS (SELECT cik, p.ticker, p.year, sum(tonnes * share) AS t, count(DISTINCT facility_id) AS f FROM plants p JOIN universe u ON u.ticker = p.ticker GROUP BY 1, 2, 3),
own AS (SELECT o.cik, arg_min(o.ticker, u.ordinal) AS ticker FROM owned o JOIN universe u ON u.ticker = o.ticker GROUP BY 1), firsts AS (SELECT cik, arg_min(ticker, ordinal) AS ticker FROM universe GROUP BY 1),
base AS (SELECT cik, year, revenue FROM sales JOIN firsts USING (ticker) WHERE revenue > 0)
SELECT u.ticker, b.year, round(coalesce(t, 0) / (revenue / 1e6), 3) AS value, coalesce(f, 0) AS facilities FROM base b JOIN universe u ON u.cik = b.cik LEFT JOIN (SELECT owned.* FROM owned JOIN own USING (cik, ticker)) o ON o.cik = b.cik AND o.year = b.year""")
def i06_ghg_intensity(spark, d):
    return I.emission_intensity(view(spark, d, "plants"), view(spark, d, "sales"), X.universe(spark, d))


@query(X.SQL + ", " + _with("pledges").removeprefix("WITH ") + """, parts AS (SELECT *, list_transform(string_split(replace(coalesce(classes, ''), '°', ''), '/'), lambda p: CASE trim(p) WHEN '1.5C' THEN 3 WHEN 'Well-below 2C' THEN 2 WHEN '2C' THEN 2 END) AS ls FROM pledges),
lv AS (SELECT ticker, CASE WHEN net_zero = 'Targets set' THEN 4 WHEN near = 'Targets set' THEN CASE WHEN len(list_filter(ls, lambda x: x IS NULL)) = 0 THEN list_min(ls) END WHEN near = 'Committed' OR net_zero = 'Committed' THEN 1 ELSE 0 END AS level FROM parts),
best AS (SELECT cik, max(level) AS level, count(level) AS rows FROM lv JOIN universe USING (ticker) GROUP BY 1)
SELECT ticker, coalesce(level, 0) AS value, coalesce(rows, 0) AS rows FROM universe LEFT JOIN best USING (cik) WHERE rows IS NULL OR rows > 0""")
def i07_climate_target(spark, d):
    return I.climate_target(view(spark, d, "pledges"), X.universe(spark, d))


_RISK = """, newest AS (SELECT material, max(year) AS year FROM output WHERE value > 0 GROUP BY 1), by_country AS (SELECT material, country, o.year, sum(value) AS value FROM output o JOIN newest USING (material, year) WHERE value > 0 GROUP BY 1, 2, 3),
shares AS (SELECT material, country, value / sum(value) OVER (PARTITION BY material) AS share FROM by_country QUALIFY count(*) OVER (PARTITION BY material) >= 3),
means AS (SELECT country, year, avg(score) AS m FROM governed WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT dimension) = (SELECT count(DISTINCT dimension) FROM governed)),
risks AS (SELECT country, year, least(greatest(100 * (2.5 - m) / 5.0, 0), 100) AS risk, false AS carried FROM means),
gov AS (SELECT * FROM risks UNION ALL SELECT country, CAST(y AS INTEGER), arg_max(risk, year), true FROM risks CROSS JOIN generate_series((SELECT max(year) + 1 FROM risks), 2001) g(y) GROUP BY country, y),
hhi AS (SELECT material, 100 * sum(share * share) AS c FROM shares GROUP BY 1),
risk AS (SELECT material, year, 0.5 * any_value(c) + 0.5 * sum(share * risk) / sum(share) AS value, bool_or(carried) AS carried FROM shares JOIN gov USING (country) JOIN hhi USING (material) GROUP BY 1, 2)"""


def material_risk(spark, d):
    return I.material_risk(I.production_shares(view(spark, d, "output")), I.governance_risk(view(spark, d, "governed"), 2001))


@query(_with("output", "governed") + _RISK + " SELECT material, year, round(value, 6) AS value, carried FROM risk")
def i11_material_risk(spark, d):
    return material_risk(spark, d).select("material", "year", r6(F.col("value")).alias("value"), "carried")


@query(_with("output", "governed", "mentioned") + _RISK + """ SELECT ticker, year, round(sum(risk.value) / 2500, 4) AS value, string_agg(material, ', ' ORDER BY material) AS named FROM (SELECT DISTINCT * FROM mentioned) JOIN risk USING (material, year) GROUP BY 1, 2""")
def i10_disclosure(spark, d):
    return I.disclosure(view(spark, d, "mentioned"), material_risk(spark, d), 25)


@query(_with("cash_facts", "denials") + """, cash AS (SELECT ticker, year, arg_min(val, k) AS cash, arg_min(period_start, k) AS period_start, arg_min(period_end, k) AS period_end FROM (SELECT *, (CASE tag WHEN 'Cash' THEN 1 ELSE 2 END, period_start) AS k FROM cash_facts WHERE tag IN ('Cash', 'CashNet')) GROUP BY 1, 2),
bb AS (SELECT ticker, year, period_start, arg_min(val, CASE tag WHEN 'Buy' THEN 1 ELSE 2 END) AS v FROM cash_facts WHERE tag IN ('Buy', 'BuyNet') GROUP BY 1, 2, 3), dv AS (SELECT ticker, year, period_start, val AS v FROM cash_facts WHERE tag = 'Dividend'),
m AS (SELECT c.*, bb.v AS b, dv.v AS d, EXISTS (SELECT 1 FROM bb x WHERE x.ticker = c.ticker AND x.year = c.year) AS bs, EXISTS (SELECT 1 FROM dv x WHERE x.ticker = c.ticker AND x.year = c.year) AS ds,
  EXISTS (SELECT 1 FROM denials x WHERE x.ticker = c.ticker AND x.year = c.year AND kind = 'buybacks') AS bd, EXISTS (SELECT 1 FROM denials x WHERE x.ticker = c.ticker AND x.year = c.year AND kind = 'dividends') AS dd
  FROM cash c LEFT JOIN bb USING (ticker, year, period_start) LEFT JOIN dv USING (ticker, year, period_start) WHERE cash > 0)
SELECT ticker, year, round((abs(coalesce(b, 0)) + abs(coalesce(d, 0))) / cash, 4) AS value FROM m WHERE (b IS NOT NULL OR NOT bs AND NOT bd) AND (d IS NOT NULL OR NOT ds AND NOT dd) AND (abs(coalesce(b, 0)) + abs(coalesce(d, 0))) / cash <= 10""")
def i15_payout_ratio(spark, d):
    return I.payout_ratio(view(spark, d, "cash_facts"), view(spark, d, "denials"), {"cash": ["Cash", "CashNet"], "buybacks": ["Buy", "BuyNet"], "dividends": ["Dividend"]})


@query(_with("sites") + """, a AS (SELECT * FROM sites QUALIFY row_number() OVER (PARTITION BY site, year ORDER BY created DESC, id DESC) = 1),
b AS (SELECT DISTINCT company, year, employees, hours, zip, away, restricted, other FROM a WHERE coalesce(sector, 1) = 1 AND hours > 0 AND hours / nullif(employees, 0) BETWEEN 500 AND 4000 AND away IS NOT NULL AND restricted IS NOT NULL AND other IS NOT NULL AND company IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY company, year, employees, hours) > 1 AND hours >= 1000000 AS copied FROM b), e AS (SELECT *, sum(CASE WHEN copied THEN hours ELSE 0 END) OVER (PARTITION BY company, year) / sum(hours) OVER (PARTITION BY company, year) AS sh FROM c)
SELECT company, year, round(sum(away + restricted + other) * 200000 / sum(hours), 3) AS value, count(*) AS sites FROM e WHERE NOT copied AND sh < 0.25 GROUP BY 1, 2 HAVING sum(hours) >= 500000 AND NOT (sum(away + restricted + other) = 0 AND sum(hours) >= 5000000)""")
def i16_injury_rate(spark, d):
    return I.injury_rate(view(spark, d, "sites"))


@query(_with("plans") + """, g AS (SELECT *, regexp_extract_all(upper(coalesce(codes, '')), '[0-9][A-Z]') AS ps FROM plans WHERE participants > 0 AND contributions >= 0),
l AS (SELECT * FROM g WHERE len(list_filter(ps, lambda p: p[1] = '2')) > 0 AND len(list_filter(ps, lambda p: p[1] = '1')) = 0 QUALIFY row_number() OVER (PARTITION BY sponsor, number, year ORDER BY received DESC, ack DESC) = 1)
SELECT company, year, round(sum(contributions) / sum(participants), 2) AS value, count(*) AS plans, arg_max(name, (participants, ack)) AS largest FROM l WHERE company IS NOT NULL GROUP BY 1, 2 HAVING sum(participants) >= 100""")
def i17_plan_contributions(spark, d):
    return I.plan_contributions(view(spark, d, "plans"))


_PANEL = _with("gifts", "sponsors", "coverage", "periods", "sales") + """, m AS (SELECT g.*, s.ticker, p.power, upper(coalesce(kind, '')) IN ('24K', '24Z', '24E', '24C', '24F', '24R') AS gift FROM gifts g JOIN (SELECT DISTINCT * FROM sponsors) s USING (committee) JOIN periods p USING (quarter)),
b AS (SELECT ticker, quarter, sum(CASE WHEN gift THEN amount ELSE 0 END) AS given, sum(amount) AS al, sum(CASE WHEN gift AND upper(party) = 'REP' THEN amount ELSE 0 END) AS r, sum(CASE WHEN gift AND upper(party) = 'DEM' THEN amount ELSE 0 END) AS dm, sum(CASE WHEN gift AND upper(coalesce(party, '')) = power THEN amount ELSE 0 END) AS a FROM m GROUP BY 1, 2),
pn AS (SELECT c.ticker, p.quarter, p.year, c.status, coalesce(given, 0) AS given, coalesce(al, 0) AS al, coalesce(r, 0) AS r, coalesce(dm, 0) AS dm, coalesce(a, 0) AS a, revenue FROM coverage c CROSS JOIN periods p LEFT JOIN b USING (ticker, quarter) LEFT JOIN sales s ON s.ticker = c.ticker AND s.year = p.year
  WHERE c.status IN ('downloaded', 'no_pac') AND NOT list_contains(string_split(c.gaps, '|'), CAST(p.cycle AS VARCHAR)))"""


def alignment_panel(spark, d):
    return I.alignment_panel(*[view(spark, d, n) for n in ("gifts", "sponsors", "coverage", "sales", "periods")])


@query(_PANEL + """ SELECT ticker, quarter, year, status, round(given, 6) AS given, round(al, 6) AS "all", round(CASE WHEN revenue > 0 THEN given / (revenue / 1e6) END, 6) AS value, round((r - dm) / nullif(r + dm, 0), 6) AS skew, round(a / nullif(given, 0), 6) AS in_power FROM pn""")
def i14_alignment_panel(spark, d):
    return alignment_panel(spark, d).select("ticker", "quarter", "year", "status", *[r6(F.col(c)).alias(c) for c in ("given", "all", "value", "skew", "in_power")])


@query(_PANEL + " SELECT ticker, year, round(sum(given) / (max(revenue) / 1e6), 6) AS value FROM pn GROUP BY 1, 2 HAVING max(revenue) > 0")
def i14_alignment(spark, d):
    return I.alignment(alignment_panel(spark, d)).select("ticker", "year", r6(F.col("value")).alias("value"))


@query(_with("filed") + """, g AS (SELECT *, CAST(year(period_end) - CASE WHEN month(period_end) = 1 AND day(period_end) <= 7 THEN 1 ELSE 0 END AS INTEGER) AS year, CASE tag WHEN 'B' THEN 1 ELSE 2 END AS p FROM filed WHERE form = '10-K' AND date_diff('day', period_start, period_end) BETWEEN 340 AND 380 AND tag IN ('B', 'A'))
SELECT ticker, year, round(arg_max(val, (-p, period_end, filed)), 6) AS value, arg_max(tag, (-p, period_end, filed)) AS tag FROM g GROUP BY 1, 2""")
def i20_annual_facts(spark, d):
    return I.annual_facts(view(spark, d, "filed"), ["B", "A"]).withColumn("value", r6(F.col("value")))


@query(_with("staff") + " SELECT ticker, year, arg_max(employees, accession) AS employees FROM staff WHERE employees > 0 GROUP BY 1, 2")
def i21_employees(spark, d):
    return I.employees(view(spark, d, "staff"))


@query(_with("periodic") + """, q AS (SELECT ticker, period_start, period_end, arg_max(val, filed) AS val, date_diff('day', period_start, period_end) AS n FROM periodic GROUP BY 1, 2, 3), s AS (SELECT * FROM q WHERE n BETWEEN 75 AND 100), y AS (SELECT * FROM q WHERE n BETWEEN 350 AND 380),
r AS (SELECT y.ticker, y.period_end, any_value(y.val) - sum(s.val) AS val FROM y JOIN s ON s.ticker = y.ticker AND s.period_start >= y.period_start AND s.period_end <= y.period_end GROUP BY 1, 2 HAVING count(*) = 3 AND max(s.period_end) < y.period_end)
SELECT ticker, CAST(year(period_end) AS INTEGER) AS year, CAST(quarter(period_end) AS INTEGER) AS quarter, round(val, 4) AS value, derived FROM (SELECT ticker, period_end, val, false AS derived FROM s UNION ALL SELECT *, true FROM r)""")
def i22_quarterly_revenue(spark, d):
    return I.quarterly_revenue(view(spark, d, "periodic")).select("ticker", "year", "quarter", F.round("value", 4).alias("value"), "derived")
