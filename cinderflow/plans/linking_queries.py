"""Queries of names, lists and entity linking. Companies, committees, parties and the like are views of the sample tables in SQL that both engines take."""

import re

from pyspark.sql import functions as F

from cinderflow.functions import arrays as A
from cinderflow.functions import dates as DT
from cinderflow.functions import text as T
from cinderflow.functions.numbers import r6
from cinderflow.operators import checks as C
from cinderflow.operators import entities as E
from cinderflow.operators import joins as J
from cinderflow.operators import linking as L
from cinderflow.operators import scoring
from cinderflow.plans import fixtures as X
from cinderflow.plans import indicator_queries as IQ

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def word(k: str) -> str:
    """SQL of a made-up word that names a key."""
    return f"('m' || translate(lpad(CAST({k} AS STRING), 6, '0'), '0123456789', 'aeioubdkst'))"


def base(k: str) -> str:
    """SQL of a company's bare name: the key's word, and often words that others use too."""
    return f"({word(k)} || CASE {k} % 4 WHEN 0 THEN '' WHEN 1 THEN ' tools' WHEN 2 THEN ' air lines' ELSE ' global services' END)"


def dressed(k: str, *forms: str) -> str:
    """SQL of a name by key, in turn in each form; {b} is the bare name, {u} the same in capitals."""
    spelt = lambda f: "'" + f.replace("'", "''").replace("{b}", f"' || {base(k)} || '").replace("{u}", f"' || upper({base(k)}) || '") + "'"
    return f"CASE {k} % {len(forms)} " + " ".join(f"WHEN {i} THEN {spelt(f)}" for i, f in enumerate(forms)) + " END"


NAMES = [
    "The {b} Company, Inc.", "{b}'s USA, LLC", "{u} A O CORP", "{u} INC/DE", "{u} CO /DE/", "3M {b} Co", "{b} Inc.", "Global Systems Group", "{u}", "{b} Mobil Holdings Corp", "  brk-b {b} ", "{b} (Old) Holdings Ltd. Class A",
    "Waste {b}, Inc.", "12 34", "THE", "{u} SERVICES L.L.C.", "O'{b} & Sons Co", "United Hospital", "The First {b} Group, Ltd.",
]
NAME_ROWS = f"SELECT c_custkey AS id, {dressed('c_custkey', *NAMES)} AS name FROM customer UNION ALL SELECT s_suppkey + 1000000, {dressed('s_suppkey', *NAMES[::-1])} FROM supplier"
#: RE2 of DuckDB takes the same patterns; '' in SQL is one quote.
_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_OWNER = _SQ.format(f"regexp_replace(regexp_replace(upper({{0}}), '[^A-Z0-9 ]', ' ', 'g'), '\\b({T.OWNER_SUFFIXES})\\b', ' ', 'g')")
_ALIAS = _SQ.format(f"regexp_replace(regexp_replace(lower({{0}}), '[^a-z0-9 ]+', ' ', 'g'), '\\b({T.ALIAS_SUFFIXES})\\b', ' ', 'g')")
_PARTY = "regexp_replace(" + _SQ.format("regexp_replace(regexp_replace(lower({0}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')") + f", '( ({'|'.join(T.PARTY_SUFFIXES)}))+$', '')"
_LEGAL = "', '".join(E.LEGAL_WORDS)
_NORM = f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(replace(lower(coalesce({{0}}, '')), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('{_LEGAL}')), ' ')"
_GENERIC = "', '".join(E.GENERIC_WORDS)
_USABLE = f"(length({{0}}) >= 4 AND len(list_filter(string_split({{0}}, ' '), lambda w: w <> '' AND w NOT IN ('{_GENERIC}') AND NOT regexp_matches(w, '^[0-9]+$'))) > 0)"


_TABLE = re.compile(r"\b(FROM|JOIN) (customer|supplier|part|orders|nation|documents)\b")


def _rows(spark, d, sql):
    """The rows of a view over the sample tables."""
    names = {m[2] for m in _TABLE.finditer(sql)}
    return spark.sql(_TABLE.sub(r"\1 {\2}", sql), **{n: X.table(spark, d, n) for n in names})


@query(f"SELECT id, replace(upper(trim(name)), '-', '.') AS ticker, replace(replace(upper(trim(name)), '.', '-'), '/', '-') AS symbol, lpad(CAST(id AS VARCHAR), 10, '0') AS padded FROM ({NAME_ROWS})")
def fs01_symbols(spark, d):
    return _rows(spark, d, NAME_ROWS).select("id", T.ticker(F.col("name")).alias("ticker"), T.exchange_symbol(F.col("name")).alias("symbol"), T.padded(F.col("id"), 10).alias("padded"))


@query(f"SELECT id, {_OWNER.format('name')} AS owner FROM ({NAME_ROWS})")
def fs05_owner_name(spark, d):
    return _rows(spark, d, NAME_ROWS).select("id", T.owner_name(F.col("name")).alias("owner"))


@query(f"SELECT id, {_PARTY.format('name')} AS core, trim(regexp_replace(regexp_replace(name, '\\s*/[A-Z]{{2,3}}/?\\s*$', ''), '(?i)([,.]?\\s*\\b({T.RECIPIENT_SUFFIXES})\\.?\\s*)+$', '')) AS recipient FROM ({NAME_ROWS})")
def fs06_cores(spark, d):
    return _rows(spark, d, NAME_ROWS).select("id", T.party_core(F.col("name")).alias("core"), T.recipient_name(F.col("name")).alias("recipient"))


@query(f"SELECT id, {_ALIAS.format('name')} AS alias FROM ({NAME_ROWS})")
def fs07_alias_name(spark, d):
    return _rows(spark, d, NAME_ROWS).select("id", T.alias_name(F.col("name")).alias("alias"))


_FORMS = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.LEGAL_FORMS.items()) + " END"


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(name), '\\bl\\.?\\s?l\\.?\\s?c\\b', 'llc', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: {_FORMS}), lambda x: x IS NOT NULL))), '|') AS forms FROM ({NAME_ROWS})")
def fs08_legal_forms(spark, d):
    return _rows(spark, d, NAME_ROWS).select("id", F.array_join(F.array_sort(E.legal_form(F.col("name"))), "|").alias("forms"))


@query(f"SELECT id, norm, {_USABLE.format('norm')} AS usable, length(core) <= 4 AS short FROM (SELECT id, {_NORM.format('name')} AS norm, {_PARTY.format('name')} AS core FROM ({NAME_ROWS}))")
def fs10_usable(spark, d):
    n = _rows(spark, d, NAME_ROWS).withColumn("norm", E.normalised(F.col("name")))
    return n.select("id", "norm", E.usable(F.col("norm")).alias("usable"), T.is_short(T.party_core(F.col("name"))).alias("short"))


@query("""SELECT page_id, '…' || trim(b) || '…' AS quote FROM (SELECT page_id, CASE WHEN NOT regexp_matches(a, '[.!?)"]$') AND contains(a, ' ') THEN regexp_replace(a, ' [^ ]*$', '') ELSE a END AS b FROM
(SELECT page_id, CASE WHEN NOT regexp_matches(t, '^\\p{Lu}') AND contains(t, ' ') THEN regexp_replace(t, '^[^ ]+ ', '') ELSE t END AS a FROM (SELECT page_id, trim(regexp_replace(substr(html, 40 + CAST(page_id % 30 AS INTEGER), 90), '\\s+', ' ', 'g')) AS t FROM pages)))""")
def fs18_whole_quotes(spark, d):
    cut = F.substr("html", (F.lit(40) + F.col("page_id") % 30).cast("int"), F.lit(90))
    return X.table(spark, d, "pages").select("page_id", T.whole_quote(cut).alias("quote"))


# ---------------------------------------------------------------- lists
_LINES = "SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS parts, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS amounts FROM lineitem GROUP BY 1"


def _lines(spark, d):
    sets = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    by = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(sets.alias("s"))
    return by.select("k", F.transform("s", lambda x: x["l_partkey"]).alias("parts"), F.transform("s", lambda x: x["l_quantity"]).alias("amounts"))


@query(f"SELECT k, unnest(parts) AS parts, unnest(amounts) AS amounts FROM ({_LINES})")
def fj02_parallel_lists(spark, d):
    return A.rows_of_lists(_lines(spark, d), ["k"], ["parts", "amounts"])


@query(f"SELECT k, list_filter(amounts, lambda x: x >= 25)[1] AS first_large FROM ({_LINES})")
def fj03_first_fit(spark, d):
    return _lines(spark, d).select("k", A.first_fit(F.col("amounts"), lambda x: x >= 25).alias("first_large"))


_IDS = "SELECT o_custkey AS k, list_distinct(list(o_orderkey % 7) FILTER (o_orderstatus = 'F')) AS a, list_distinct(list(o_orderkey % 7) FILTER (o_orderstatus <> 'F')) AS b FROM orders GROUP BY 1"


@query(f"SELECT k, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), '|') AS both, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), '|') AS every FROM ({_IDS})")
def fj04_id_sets(spark, d):
    of = lambda cond: F.collect_set(F.when(cond, F.col("o_orderkey") % 7))
    ids = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(of(F.col("o_orderstatus") == "F").alias("a"), of(F.col("o_orderstatus") != "F").alias("b"))
    said = lambda c: A.piped(F.array_sort(c).cast("array<string>"))
    return ids.select("k", said(A.shared_ids(F.col("a"), F.col("b"))).alias("both"), said(A.all_ids(F.col("a"), F.col("b"))).alias("every"))


@query(f"SELECT k, CAST(len(list_filter(string_split(p, '|'), lambda x: x <> '')) AS INTEGER) AS n, p AS again FROM (SELECT k, array_to_string(parts, '|') AS p FROM ({_LINES}))")
def fj05_piped(spark, d):
    p = _lines(spark, d).select("k", A.piped(F.col("parts").cast("array<string>")).alias("p"))
    return p.select("k", F.size(A.unpiped(F.col("p"))).alias("n"), A.piped(A.unpiped(F.col("p"))).alias("again"))


@query("SELECT k, string_agg(CAST(v AS VARCHAR), '|' ORDER BY o) AS vs FROM (SELECT l_orderkey AS k, l_suppkey % 5 AS v, min((l_linenumber, l_partkey, l_quantity)) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fj06_ordered_distinct(spark, d):
    sets = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", (F.col("l_suppkey") % 5).alias("v"))))
    by = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(sets, lambda x: x["v"]).alias("vs"))
    return by.select("k", A.piped(A.ordered_distinct(F.col("vs")).cast("array<string>")).alias("vs"))


@query("""SELECT '{"s_suppkey":' || s_suppkey || ',"odd":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(CAST(s_nationkey AS DOUBLE) AS VARCHAR) END || ',"s_name":"' || s_name || '"}' AS record FROM supplier""")
def r08_records(spark, d):
    s = X.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, float("nan")).otherwise(F.col("s_nationkey").cast("double")).alias("odd"), "s_name")
    return A.records(s)


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def j04_one_to_one(spark, d):
    n = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), "n_name")
    return J.one_to_one(X.table(spark, d, "supplier").select("s_suppkey", "s_name"), n, ["s_suppkey"])


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def t02_stable_places(spark, d):
    """A sort whose ties keep an earlier order: that order is part of the key, as a shuffle keeps none."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return X.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_acctbal > 0 THEN round(s_acctbal, -2) END DESC NULLS LAST, CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place FROM supplier")
def t01_order(spark, d):
    """Places of a sort by value, nulls last, then by ticker."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc_nulls_last(F.when(F.col("s_acctbal") > 0, F.round("s_acctbal", -2))), F.col("s_suppkey").cast("string"))
    return X.table(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + 30 END, make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31)) AS VARCHAR) AS day FROM orders")
def fd10_first_date(spark, d):
    """Entered, else lodged, else the end of the fiscal year."""
    day = F.to_date("o_orderdate")
    entered, lodged = F.when(F.col("o_orderkey") % 3 == 0, day), F.when(F.col("o_orderkey") % 3 == 1, F.date_add(day, 30))
    return X.table(spark, d, "orders").select("o_orderkey", F.coalesce(entered, lodged, F.make_date(F.year(day), F.lit(12), F.lit(31))).cast("string").alias("day"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0) GROUP BY 1")
def p03_not_in(spark, d):
    """NOT IN over a frame as an anti join, which a null on the other side doesn't empty."""
    away = X.table(spark, d, "supplier").select(F.when(F.col("s_acctbal") < 0, F.col("s_suppkey")).alias("l_suppkey"))
    return X.table(spark, d, "lineitem").join(away, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- linking
COMPANIES = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS ticker, 1 AS place, {dressed("s_suppkey", "The {b} Company", "{u} CORP", "{b} Inc", "{u} CORP /DE/", "{b} Corporation")} AS name, 'current' AS kind FROM supplier
UNION ALL SELECT 'T' || CAST(s_suppkey AS STRING), 2, {word("(s_suppkey + 500000)")} || ' Corp', 'former' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'NONE' || CAST(n_nationkey AS STRING), 1, 'The Company', 'current' FROM nation"""
#: A committee of each customer: most are named after a supplier, in one of nine ways.
_OWNER_OF = "(c_custkey % (SELECT count(*) FROM supplier))"
_B = base("k")
COMMITTEES = f"""SELECT 'C' || CAST(c_custkey AS STRING) AS committee,
CASE c_custkey % 9 WHEN 0 THEN upper({_B}) || ' POLITICAL ACTION COMMITTEE' WHEN 1 THEN upper(replace({_B}, ' ', '')) || ' PAC' WHEN 2 THEN 'ALLPAC' WHEN 3 THEN 'EMPLOYEES OF ' || upper({_B}) || ' CORPORATION PAC' WHEN 4 THEN {_B} || ' PAC'
 WHEN 5 THEN upper({_B}) || ' CITIZENS POLITICAL FUND' WHEN 6 THEN {word("(k + 500000)")} || ' EMPLOYEES PAC' WHEN 7 THEN upper({_B}) || ' ALLISON CORP PAC' ELSE 'UNRELATED GROUP PAC' END AS name,
CASE c_custkey % 9 WHEN 0 THEN {_B} || ' company' WHEN 1 THEN upper(replace({_B}, ' ', '')) || ' HOLDINGS CORP' WHEN 2 THEN upper({_B}) || ' INSURANCE CO.' WHEN 7 THEN upper({_B}) || ' ALLISON CORP' WHEN 8 THEN '' END AS affiliation,
CASE WHEN c_custkey % 10 = 0 THEN 'L' ELSE 'C' END AS org_type, CASE c_custkey % 5 WHEN 0 THEN '2018|2020' WHEN 1 THEN '2020' WHEN 2 THEN '2016|2020' WHEN 3 THEN '1998' ELSE '2020|2022' END AS cycles FROM (SELECT c_custkey, {_OWNER_OF} AS k FROM customer)"""
REJECTED = f"SELECT 'T' || CAST({_OWNER_OF} AS STRING) AS ticker, 'C' || CAST(c_custkey AS STRING) AS committee FROM customer WHERE c_acctbal < 0"
_TOK = (
    "regexp_replace(array_to_string(list_filter(string_split(regexp_replace(replace(replace(lower(regexp_replace(coalesce({0}, ''), '\\s*/\\s*[A-Za-z]{{2}}\\s*/?\\s*$', ' ')), '&', ' and '), '''s', 's'), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('"
    + "', '".join(L.LEGAL_WORDS) + "')), ' '), '( (" + "|".join(L.TRAILING_FILLER) + "))+$', '')"
)
_PAC = "', '".join(w.replace("'", "''") for w in L.PAC_WORDS)


@query(f"""WITH n AS (SELECT *, {_TOK.format('name')} AS core FROM ({COMPANIES})), c AS (SELECT *, {_TOK.format('name')} AS own, {_TOK.format('affiliation')} AS affil, list_sort(list_filter(string_split(cycles, '|'), lambda y: y IN ('2018', '2020', '2022'))) AS cy FROM ({COMMITTEES}) WHERE org_type = 'C'),
p AS (SELECT n.ticker, n.place, n.name AS matched, n.kind, c.committee, c.affil, core, array_to_string(cy, '|') AS cycles, CASE WHEN affil <> '' AND replace(affil, ' ', '') = replace(core, ' ', '') THEN 'affiliated_exact'
  WHEN affil = core OR starts_with(affil, core || ' ') THEN CASE WHEN contains(core, ' ') THEN 'affiliated_prefix' ELSE 'affiliated_prefix_1tok' END
  WHEN starts_with(own, core || ' ') AND len(list_filter(string_split(substr(own, length(core) + 2), ' '), lambda w: w NOT IN ('{_PAC}'))) = 0 THEN 'name_prefix_pac'
  WHEN contains(' ' || own || ' ', ' ' || core || ' ') AND (contains(' ' || own || ' ', ' pac ') OR contains(' ' || own || ' ', ' political ')) THEN 'name_contains_pac' END AS rule FROM n CROSS JOIN c WHERE core <> '' AND len(cy) > 0),
q AS (SELECT *, NOT contains(core, ' ') AND rule LIKE 'name%' AS loose FROM p WHERE rule IS NOT NULL)
SELECT ticker, committee, arg_min(CASE WHEN loose AND affil = '' THEN rule || '_weak' ELSE rule END, place) AS rule, arg_min(matched, place) AS matched, arg_min(kind, place) AS kind, any_value(cycles) AS cycles FROM q WHERE NOT loose OR length(core) >= 5 GROUP BY 1, 2 HAVING NOT EXISTS (SELECT 1 FROM ({REJECTED}) r WHERE r.ticker = q.ticker AND r.committee = q.committee)""")
def e04_committee_links(spark, d):
    committees = _rows(spark, d, COMMITTEES).withColumn("cycles", F.split("cycles", r"\|").cast("array<int>"))
    return L.committee_links(_rows(spark, d, COMPANIES), committees, [2018, 2020, 2022], _rows(spark, d, REJECTED))


LISTED = f"""SELECT CAST(c_custkey AS STRING) AS id, CASE c_custkey % 3 WHEN 0 THEN 'US' || CAST(k AS STRING) WHEN 1 THEN 'XX' || CAST(c_custkey AS STRING) END AS isin, {dressed("k", "{b} Inc", "{u} LTD", "{b}", "The {b} Corporation", "Global Services")} AS name,
CASE c_nationkey % 4 WHEN 0 THEN 'United States of America (USA)' WHEN 1 THEN 'United States' WHEN 2 THEN 'France' END AS location FROM (SELECT *, {_OWNER_OF} AS k FROM customer)"""
ISINS = """SELECT 'US' || CAST(s_suppkey AS STRING) AS isin, 'T' || CAST(s_suppkey AS STRING) AS ticker FROM supplier UNION ALL SELECT 'US' || CAST(s_suppkey AS STRING), 'T' || CAST(s_suppkey + 1 AS STRING) FROM supplier WHERE s_suppkey % 8 = 3
UNION ALL SELECT 'US' || CAST(s_suppkey AS STRING), 'OUT' FROM supplier WHERE s_suppkey % 5 = 0"""
LISTED_NAMES = f"""SELECT {dressed("s_suppkey", "{b} Corporation", "{b}", "{b} Inc", "{u} Co", "Global Services")} AS name, 'T' || CAST(s_suppkey AS STRING) AS ticker FROM supplier UNION ALL SELECT {base("s_suppkey")}, 'TWIN' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 6 = 5"""
TICKERS = "SELECT 'T' || CAST(s_suppkey AS STRING) AS ticker FROM supplier WHERE s_suppkey % 7 <> 4"
REVIEWED = "SELECT CAST(c_custkey AS STRING) AS id, 'T' || CAST(c_nationkey AS STRING) AS ticker FROM customer WHERE c_acctbal > 9900"
FOREIGN = "SELECT CAST(c_custkey AS STRING) AS id FROM customer WHERE c_mktsegment = 'BUILDING'"
WRONG = f"SELECT CAST(c_custkey AS STRING) AS id, 'T' || CAST({_OWNER_OF} AS STRING) AS ticker FROM customer WHERE c_mktsegment = 'MACHINERY'"


@query(f"""WITH s AS ({LISTED}), i AS (SELECT isin, count(DISTINCT ticker) AS n, min(ticker) AS t FROM ({ISINS}) WHERE ticker IN (SELECT ticker FROM ({TICKERS})) GROUP BY 1),
nm AS (SELECT norm, min(ticker) AS t FROM (SELECT {_NORM.format('name')} AS norm, ticker FROM ({LISTED_NAMES})) WHERE {_USABLE.format('norm')} GROUP BY 1 HAVING count(DISTINCT ticker) = 1),
m AS (SELECT s.id, CASE WHEN r.ticker IS NOT NULL THEN r.ticker WHEN i.n = 1 THEN i.t WHEN i.n > 1 THEN NULL WHEN location LIKE 'United States%' OR s.id IN (SELECT id FROM ({FOREIGN})) THEN nm.t END AS ticker, CASE WHEN r.ticker IS NOT NULL THEN 'manual' WHEN i.n = 1 THEN 'isin' ELSE 'name' END AS match
 FROM s LEFT JOIN ({REVIEWED}) r ON r.id = s.id LEFT JOIN i USING (isin) LEFT JOIN nm ON nm.norm = {_NORM.format('s.name')})
SELECT * FROM m WHERE ticker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({WRONG}) w WHERE w.id = m.id AND w.ticker = m.ticker)""")
def e05_cascade(spark, d):
    of = lambda sql: _rows(spark, d, sql)
    return L.cascade(of(LISTED), of(REVIEWED), of(ISINS), of(LISTED_NAMES), of(TICKERS), of(FOREIGN), of(WRONG))


PARTIES = f"""SELECT c_custkey AS id, {dressed("k", "{b} Corporation", "{b} Services, LLC", "{u} Pension Plan", "{b} Contracting, LLC", "{b} Group Health Care Plan", "The {b} Companies, Inc.", "{b} (US) Federal Services")} AS party FROM (SELECT c_custkey, {_OWNER_OF} AS k FROM customer)
UNION ALL SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'John Doe' WHEN 1 THEN {word("c_custkey")} || ' Inc' END FROM customer
UNION ALL SELECT c_custkey, upper(translate(CAST(c_custkey % 900 AS STRING), '0123456789', 'aeioubdkst')) || CASE c_custkey % 3 WHEN 0 THEN ' Pension Plan' WHEN 1 THEN ' Contracting, LLC' ELSE ' Inc.' END FROM customer"""
CORES = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS entity, {base("s_suppkey")} AS core FROM supplier UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), translate(CAST(s_suppkey AS STRING), '0123456789', 'aeioubdkst') FROM supplier"""
_TAILS = "', '".join([*T.PARTY_SUFFIXES, *L.PLAN_WORDS])


@query(f"""SELECT DISTINCT id AS "case", entity FROM (SELECT id, {_PARTY.format('party')} AS p FROM ({PARTIES})) JOIN ({CORES}) ON p = core OR (starts_with(p, core || ' ') AND (length(core) > 4 OR len(list_filter(string_split(substr(p, length(core) + 2), ' '), lambda w: w NOT IN ('{_TAILS}'))) = 0))""")
def e06_party_matches(spark, d):
    cases = _rows(spark, d, PARTIES).groupBy(F.col("id").alias("case")).agg(F.collect_list("party").alias("parties"))
    return L.party_matches(cases, _rows(spark, d, CORES))


TITLES = f"""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 7 THEN NULL WHEN 6 THEN 'In re ' || {base("k")} || ' Inc' ELSE {dressed("k", "{b}", "Smith", "EEOC", "Doe", "Jones et al")} || CASE c_custkey % 3 WHEN 0 THEN ' v. ' WHEN 1 THEN ' vs. ' ELSE ' versus ' END
 || {dressed("c_custkey", "Radius Health", "The {b} Companies, Inc.", "{b} Services LLC", "{u} Corp.", "Jasper {b} Pension Plan", "{b} Federal")} END AS title FROM (SELECT c_custkey, {_OWNER_OF} AS k FROM customer)"""
_CORP = "', '".join(L.CORPORATE)


@query(f"""SELECT DISTINCT id AS "case", entity FROM (SELECT id, s, {_PARTY.format('s')} AS p FROM (SELECT id, unnest(regexp_split_to_array(title, '(?i)\\s+v(?:s?\\.?|ersus)\\s+')) AS s FROM ({TITLES}))) JOIN ({CORES})
ON (p = core OR ends_with(p, ' ' || core) OR (length(core) > 4 AND contains(' ' || p || ' ', ' ' || core || ' '))) AND (contains(core, ' ') OR len(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda w: w IN ('{_CORP}'))) > 0)""")
def e07_case_names(spark, d):
    return L.case_name_matches(_rows(spark, d, TITLES).withColumnRenamed("id", "case"), _rows(spark, d, CORES))


SEARCHED = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS entity, upper({base("s_suppkey")}) AS name FROM supplier"""
SUGGESTED = f"""SELECT 'T' || CAST(k AS STRING) AS entity, CAST(floor(c_custkey / 7) AS INT) AS place, CASE c_custkey % 7 WHEN 0 THEN 'APPLIED INDUSTRIAL TECHNOLOGIES' WHEN 1 THEN 'GLOBAL SERVICES INC' WHEN 2 THEN upper({base("k")}) || ' COMPANY, THE' WHEN 3 THEN 'AIR FREIGHT' WHEN 4 THEN 'PATTERSON TOOLS' ELSE upper({word("c_custkey")}) END AS suggestion
FROM (SELECT c_custkey, {_OWNER_OF} AS k FROM customer) WHERE k % 9 <> 8"""
_FILL = "', '".join(L.FILLER)
_DT = f"list_filter(list_distinct(regexp_extract_all(upper({{0}}), '[A-Z0-9]+')), lambda w: length(w) >= 2 AND w NOT IN ('{_FILL}'))"


@query(f"""SELECT entity, count(*) FILTER (hit) > 0 AS verified, coalesce(arg_min(suggestion, place) FILTER (hit), '') AS matched FROM (SELECT s.entity, g.place, g.suggestion, coalesce(len(list_intersect({_DT.format('s.name')}, {_DT.format('g.suggestion')})) > 0, false) AS hit FROM ({SEARCHED}) s LEFT JOIN ({SUGGESTED}) g USING (entity)) GROUP BY 1""")
def e08_verified_names(spark, d):
    return L.verified_names(_rows(spark, d, SEARCHED), _rows(spark, d, SUGGESTED))


OWNERS = f"""SELECT 'T' || CAST(k AS STRING) AS entity, {dressed("k", "{b} Inc", "{u} CORP", "{b}")} AS name, CAST(year(o_orderdate) AS INT) AS year FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders)"""
BLOCKS = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS entity, upper({word("s_suppkey")}) AS prefix, CASE WHEN s_suppkey % 6 = 0 THEN 1995 END AS since FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'T' || CAST(s_suppkey + 1 AS STRING), upper({word("s_suppkey")}), NULL FROM supplier"""


@query(f"SELECT entity, name, year FROM ({OWNERS}) o WHERE NOT EXISTS (SELECT 1 FROM ({BLOCKS}) b WHERE b.entity = o.entity AND starts_with(upper(o.name), b.prefix) AND o.year >= coalesce(b.since, 0))")
def e11_unblocked(spark, d):
    return L.unblocked(_rows(spark, d, OWNERS), _rows(spark, d, BLOCKS)).select("entity", "name", "year")


ALIASES = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS entity, 1 AS place, {dressed("s_suppkey", "{b} Inc.", "The {b} Company", "{u} CORP")} AS name, 'current' AS kind, CAST(NULL AS STRING) AS valid_to FROM supplier
UNION ALL SELECT 'T' || CAST(s_suppkey AS STRING), 2, {dressed("s_suppkey", "{u} INC", "{b} Travelers Group Inc", "{b}")}, 'former', CASE s_suppkey % 4 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '1998-10-01' WHEN 2 THEN '2014-01-01' END FROM supplier
UNION ALL SELECT 'T' || CAST(s_suppkey AS STRING), 3, {word("(s_suppkey + 500000)")} || ' Inc', 'former', '2020-04-01' FROM supplier WHERE s_suppkey % 3 = 0"""


@query(f"""WITH a AS (SELECT *, {_ALIAS.format('name')} AS n FROM ({ALIASES})) SELECT entity, name, kind FROM a WHERE kind = 'current' OR (coalesce(valid_to, '') >= '2014-01-01' AND NOT EXISTS (SELECT 1 FROM a c WHERE c.kind = 'current' AND c.entity = a.entity AND c.n = a.n))""")
def e12_valid_aliases(spark, d):
    return L.valid_aliases(_rows(spark, d, ALIASES), "2014-01-01").select("entity", "name", "kind")


#: Names of three periods a company: the first two ended on a day, some gave theirs to another company.
DATED = f"""SELECT 'T' || CAST(s_suppkey AS STRING) AS entity, {dressed("s_suppkey", "{b} Inc.", "The {b} Company")} AS name, CAST('1992-01-01' AS DATE) AS valid_from, CAST('1995-01-01' AS DATE) + CAST(s_suppkey % 700 AS INT) AS valid_to FROM supplier
UNION ALL SELECT 'T' || CAST(s_suppkey AS STRING), {word("(s_suppkey + 500000)")} || ' Corp', CAST('1995-01-01' AS DATE) + CAST(s_suppkey % 700 AS INT), CASE WHEN s_suppkey % 4 > 0 THEN CAST('1998-06-01' AS DATE) END FROM supplier
UNION ALL SELECT 'T' || CAST(s_suppkey + 1 AS STRING), {base("s_suppkey")}, CAST('1996-03-01' AS DATE), NULL FROM supplier UNION ALL SELECT 'U' || CAST(s_suppkey AS STRING), {base("s_suppkey")}, CAST('1997-01-01' AS DATE), NULL FROM supplier WHERE s_suppkey % 5 = 0"""
DATED_ASKED = f"""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN upper({base("k")}) || ' CORP' WHEN 1 THEN {word("(k + 500000)")} ELSE {base("k")} || ' Co' END AS name, CAST(o_orderdate AS DATE) AS day FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders)"""


@query(f"""SELECT id, name, strftime(day, '%Y-%m-%d') AS day, min(entity) AS entity FROM (SELECT *, {_ALIAS.format('name')} AS n FROM ({DATED_ASKED})) q JOIN (SELECT entity, valid_from, valid_to, {_ALIAS.format('name')} AS m FROM ({DATED})) d
ON n = m AND day >= valid_from AND (valid_to IS NULL OR day < valid_to) GROUP BY 1, 2, 3 HAVING count(DISTINCT entity) = 1""")
def e12_names_at(spark, d):
    """Whose name it was on the day of an order: aliases that hold for a time."""
    got = L.names_at(_rows(spark, d, DATED_ASKED).withColumnRenamed("day", "at"), _rows(spark, d, DATED), "2005-12-31")
    return got.select("id", "name", F.date_format("at", "yyyy-MM-dd").alias("day"), "entity")


#: Companies and their subsidiaries by name, and records that bear such names or an employer's number.
PARENTS = f"""SELECT {dressed("s_suppkey", "{b} Inc", "{u} Corp", "The {b} Company")} AS name, 'T' || CAST(s_suppkey AS STRING) AS entity FROM supplier UNION ALL SELECT {base("(s_suppkey + 1)")}, 'T' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 11 = 4"""
OWNED = f"""SELECT {dressed("c_custkey", "{b} of Ohio LLC", "Hospital Services Inc", "{b} Retail, Ltd.", "{u} CORP")} AS name, 'T' || CAST({_OWNER_OF} AS STRING) AS entity FROM customer WHERE c_acctbal > 0"""
EINS = "SELECT lpad(CAST(1000000 + s_suppkey AS STRING), 9, '0') AS ein, 'T' || CAST(s_suppkey AS STRING) AS entity FROM supplier"
FILED = f"""SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 5 = 0 THEN '00-' || CAST(1000000 + o_orderkey % 150 AS STRING) WHEN o_orderkey % 5 = 1 THEN CAST(20000000 + o_custkey AS STRING) END AS ein,
CASE o_orderkey % 4 WHEN 0 THEN {dressed("o_custkey", "{b} of Ohio, Inc.", "Hospital Services", "{b} Retail", "{u} LLC")} WHEN 1 THEN {base("k")} ELSE {dressed("o_custkey", "{b} of Ohio LLC", "{b} Services", "{b} Retail Ltd", "{u} Corp")} END AS name FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders)"""
_FORM_SET = f"list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower({{0}}), '\\bl\\.?\\s?l\\.?\\s?c\\b', 'llc', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: {_FORMS}), lambda x: x IS NOT NULL))"
_CLEAN = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) BETWEEN 8 AND 9 AND NOT regexp_matches(regexp_replace({0}, '[^0-9]', '', 'g'), '^0+$') THEN lpad(regexp_replace({0}, '[^0-9]', '', 'g'), 9, '0') END"


@query(f"""WITH r AS (SELECT *, {_CLEAN.format('ein')} AS e, {_NORM.format('name')} AS n, {_FORM_SET.format('name')} AS f FROM ({FILED})), p AS (SELECT entity, {_NORM.format('name')} AS n FROM ({PARENTS})), s AS (SELECT entity, {_NORM.format('name')} AS n, {_FORM_SET.format('name')} AS f FROM ({OWNED})),
b AS (SELECT n, min(entity) AS entity, min(kind) AS kind FROM (SELECT n, entity, 'name' AS kind FROM p UNION ALL SELECT n, entity, 'subsidiary' FROM s) WHERE {_USABLE.format('n')} GROUP BY n HAVING count(DISTINCT entity) = 1),
own AS (SELECT entity, list_distinct(flatten(list(list_filter(string_split(n, ' '), lambda w: w NOT IN ('{_GENERIC}') AND length(w) >= 3)))) AS ws FROM p GROUP BY 1), fs AS (SELECT n, list_distinct(flatten(list(f))) AS fs FROM s GROUP BY 1), sh AS (SELECT n, count(DISTINCT e) AS k FROM r GROUP BY 1),
i AS (SELECT {_CLEAN.format('ein')} AS e, min(entity) AS entity FROM ({EINS}) GROUP BY 1 HAVING count(DISTINCT entity) = 1),
m AS (SELECT r.id, r.name, i.entity AS ie, b.entity AS be, b.kind, b.kind = 'name' OR coalesce(len(list_intersect(string_split(r.n, ' '), own.ws)) > 0, false) OR (k <= 1 AND (len(r.f) = 0 OR len(coalesce(fs.fs, [])) = 0 OR len(list_intersect(r.f, fs.fs)) > 0) AND (contains(r.n, ' ') OR length(r.n) >= 6)) AS ok
 FROM r LEFT JOIN i ON i.e = r.e LEFT JOIN b ON b.n = r.n LEFT JOIN own ON own.entity = b.entity LEFT JOIN fs ON fs.n = r.n LEFT JOIN sh ON sh.n = r.n)
SELECT id, name, coalesce(ie, CASE WHEN be IS NOT NULL AND ok THEN be END) AS entity, CASE WHEN ie IS NOT NULL THEN 'ein' WHEN be IS NOT NULL AND ok THEN kind END AS tier FROM m""")
def e01_company_matches(spark, d):
    """The whole matcher: employer's number, then names that mean one company, then subsidiaries that pass the strict tests."""
    of = lambda sql: _rows(spark, d, sql)
    return E.company_matches(of(FILED), of(EINS), of(PARENTS), of(OWNED)).select("id", "name", "entity", "tier")


#: Every company's bare name against the whole text of every document, some of which speak of a company.
TOLD = f"""SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 3 WHEN 0 THEN ' said by ' || {base("(doc_id * 7)")} || ' today' WHEN 1 THEN ' from ' || {word("doc_id")} || ' global' ELSE ' tools air lines' END AS text FROM documents"""
BARE = f"SELECT DISTINCT {base('c_custkey')} AS name FROM customer UNION SELECT {base('s_suppkey')} FROM supplier"


@query(f"SELECT doc_id, name FROM ({TOLD}) t JOIN ({BARE}) n ON contains(' ' || text || ' ', ' ' || name || ' ')")
def j20_names_in_texts(spark, d):
    """Companies named in documents: blocked by each name's rarest word, so 'air' and 'tools' bring no candidates."""
    return J.token_candidates(_rows(spark, d, BARE), _rows(spark, d, TOLD), "name", "text").select("doc_id", "name")


@query(f"""SELECT entity, string_agg(c, '|' ORDER BY p) AS cores FROM (SELECT entity, {_PARTY.format('name')} AS c, min(place) AS p FROM ({ALIASES}) GROUP BY 1, 2) WHERE length(c) >= 2 GROUP BY 1""")
def z16_search_cores(spark, d):
    return L.search_cores(_rows(spark, d, ALIASES), 5).select("entity", A.piped(F.col("cores")).alias("cores"))


@query(f"SELECT ticker, place, {_TOK.format('name')} AS core, replace({_TOK.format('name')}, ' ', '') AS squeezed FROM ({COMPANIES})")
def z05_core_names(spark, d):
    core = L.committee_tokens(F.col("name"))
    return _rows(spark, d, COMPANIES).select("ticker", "place", F.array_join(core, " ").alias("core"), F.array_join(core, "").alias("squeezed"))


@query("SELECT c_custkey, count(DISTINCT w) AS candidates, array_to_string(list_sort(list(DISTINCT k))[1:4], '|') AS first_ids FROM (SELECT c_custkey, lower(split_part(c_mktsegment, ' ', 1)) AS w FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)) JOIN (SELECT p_partkey AS k, lower(split_part(p_type, ' ', 1)) AS w FROM part UNION ALL SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'furniture' ELSE 'x' END FROM supplier) USING (w) GROUP BY 1")
def z07_loose_candidates(spark, d):
    """Unmatched companies with loose candidates: records that share the first word of a name; the first four ids."""
    late = X.table(spark, d, "orders").where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey"))
    word = lambda c: F.lower(F.get(F.split(c, " "), F.lit(0)))
    asked = X.table(spark, d, "customer").join(late, "c_custkey", "left_anti").select("c_custkey", word("c_mktsegment").alias("w"))
    k = F.col("s_suppkey") % 3
    known = X.table(spark, d, "part").select(F.col("p_partkey").alias("k"), word("p_type").alias("w")).unionByName(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(k == 0, "building").when(k == 1, "furniture").otherwise("x").alias("w")))
    # Ids by word first: a common word's list is made once, not for each company.
    ids = known.groupBy("w").agg(F.slice(F.array_sort(F.collect_set("k")), 1, 4).alias("ids"))
    by = asked.join(ids, "w").groupBy("c_custkey").agg(F.countDistinct("w").alias("candidates"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, 4).alias("ids"))
    return by.select("c_custkey", "candidates", A.piped(F.col("ids").cast("array<string>")).alias("first_ids"))


@query("SELECT l_suppkey, l_shipdate, CAST(sum(l_quantity) AS DOUBLE) AS tonnes, arg_min(l_partkey, (l_linenumber, l_orderkey, l_partkey)) AS parent FROM lineitem GROUP BY 1, 2")
def z20_facility_totals(spark, d):
    """The sum of a facility and day, and the parent of its first row."""
    return X.table(spark, d, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("tonnes"), F.min_by("l_partkey", F.struct("l_linenumber", "l_orderkey", "l_partkey")).alias("parent"))


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_totalprice, (o_orderdate, -o_orderkey)) AS employees FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2")
def z11_collect_employees(spark, d):
    """The latest end of a year counts, zero doesn't; of equal ends the first seen."""
    return X.table(spark, d, "orders").where("o_totalprice > 0").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("employees"))


@query(X.SQL + "SELECT cik, string_agg(ticker, '|' ORDER BY ticker) AS tickers FROM (SELECT cik, ticker FROM universe UNION SELECT '9' || cik, ticker FROM universe WHERE ordinal % 40 = 0) GROUP BY 1")
def z12_ids_to_tickers(spark, d):
    """Id to its tickers, with predecessors' ids."""
    u = X.universe(spark, d)
    both = u.select("cik", "ticker").union(u.where("ordinal % 40 = 0").select(F.concat(F.lit("9"), "cik"), "ticker")).distinct()
    return both.groupBy("cik").agg(A.piped(F.array_sort(F.collect_list("ticker"))).alias("tickers"))


@query("SELECT o_custkey, max(CASE WHEN nr = 1 THEN o_orderkey END) AS newest, max(CASE WHEN nr = 1 THEN y END) AS year, arg_max(o_orderkey, (y2, o_orderkey)) FILTER (y2 = m - 3) AS earlier FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(year(o_orderdate) AS INTEGER) AS y2, max(CAST(year(o_orderdate) AS INTEGER)) OVER (PARTITION BY o_custkey) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nr FROM orders) GROUP BY 1")
def z19_filing_pair(spark, d):
    """The newest filing and the one of three years before (the last of that year)."""
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year"))
    newest = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "year"), F.struct("o_orderdate", "o_orderkey")).alias("n")).select("o_custkey", F.col("n.o_orderkey").alias("newest"), F.col("n.year").alias("year"))
    before = o.groupBy("o_custkey", "year").agg(F.max("o_orderkey").alias("earlier")).withColumn("year", F.col("year") + 3)
    return newest.join(before, ["o_custkey", "year"], "left").select("o_custkey", "newest", "year", "earlier")


@query("SELECT count(*) FILTER (twice) AS duplicates, count(*) FILTER (bad) AS bad_ids, count(*) FILTER (blank) AS blanks, count(*) FILTER (other) AS other_ids FROM (SELECT count(*) OVER (PARTITION BY t) > 1 AS twice, NOT regexp_matches(i, '^[0-9]{10}$') AS bad, trim(n) = '' AS blank, o IS NOT NULL AND o <> i AS other FROM (SELECT upper(c_mktsegment) || CAST(c_custkey // 2 AS VARCHAR) AS t, CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS i, CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE c_name END AS n, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey + c_custkey % 2 AS VARCHAR), 10, '0') END AS o FROM customer))")
def z23_universe_checks(spark, d):
    """Duplicates, malformed ids, blanks, and ids that another source has otherwise, of a universe before it is written."""
    from pyspark.sql import Window

    k, pad = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 10, "0")
    u = X.table(spark, d, "customer").select(
        F.concat(F.upper("c_mktsegment"), F.floor(k / 2).cast("string")).alias("t"), F.when(k % 9 == 0, k.cast("string")).otherwise(pad(k)).alias("i"), F.when(k % 50 == 7, " ").otherwise(F.col("c_name")).alias("n"), F.when(k % 3 == 0, pad(k + k % 2)).alias("o")
    )
    u = u.withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("t")) > 1)
    return u.agg(F.count_if("twice").alias("duplicates"), F.count_if(~F.col("i").rlike("^[0-9]{10}$")).alias("bad_ids"), F.count_if(F.trim("n") == "").alias("blanks"), F.count_if(F.col("o") != F.col("i")).alias("other_ids"))


@query(X.SQL + "SELECT c.indicator_id, c.category, count(f.value) AS rows, count(DISTINCT f.ticker) AS companies, count(DISTINCT CASE WHEN f.year % 2 = 0 THEN 'a' WHEN f.value IS NOT NULL THEN 'b' END) > 1 AS eligible FROM catalog c LEFT JOIN facts f USING (indicator_id) GROUP BY 1, 2")
def z24_all_indicators(spark, d):
    """Every indicator of the catalog with what it has; those with more than one source can be quoted."""
    f = X.facts(spark, d).withColumn("url", F.when(F.col("year") % 2 == 0, "a").otherwise("b"))
    met = X.catalog(spark).join(f, "indicator_id", "left")
    return met.groupBy("indicator_id", "category").agg(F.count("value").alias("rows"), F.countDistinct("ticker").alias("companies"), (F.countDistinct("url") > 1).alias("eligible"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def z27_newest_of_a_form(spark, d):
    return X.table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey)) AS quantity, arg_max(s_name, (l_shipdate, l_partkey, l_suppkey)) AS filer FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def z06_compact_rows(spark, d):
    """Rows of per-filer files with a nested filer, one an id (the last sent in), flattened."""
    s = X.table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), "s_nationkey").alias("filer"))
    l = X.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    last = l.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.struct("l_quantity", "filer"), F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("r"))
    return last.select("l_orderkey", "l_linenumber", F.col("r.l_quantity").alias("quantity"), F.col("r.filer.name").alias("filer"))


@query("SELECT l_suppkey, count(*) FILTER (upper(coalesce(l_returnflag, '')) IN ('R', 'A')) AS gifts, round(sum(CASE WHEN upper(coalesce(l_returnflag, '')) IN ('R', 'A') THEN l_quantity ELSE 0 END), 6) AS amount FROM lineitem GROUP BY 1")
def z09_contributions(spark, d):
    """Types in a list, read without regard to case, a missing one in none."""
    gift = F.upper(F.coalesce("l_returnflag", F.lit(""))).isin("R", "A")
    return X.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(gift).alias("gifts"), r6(F.sum(F.when(gift, F.col("l_quantity")).otherwise(0.0))).alias("amount"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def z13_all_hits(spark, d):
    """All hits of the entities, kept as rows for the matching of periods."""
    known = X.table(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"))
    return X.table(spark, d, "lineitem").where("l_linestatus = 'F'").join(known, "l_suppkey", "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT n_nationkey, coalesce(o.code, upper(substr(n_name, 1, 3)) || n_nationkey) AS code FROM nation LEFT JOIN (VALUES ('NATION_3', 'XYZ'), ('NATION_7', 'QQQ')) AS o(name, code) ON o.name = n_name")
def z21_codes(spark, d):
    """Names to codes, with overrides."""
    n = X.table(spark, d, "nation")
    base = n.select("n_nationkey", F.concat(F.upper(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string")).alias("value"))
    fixed = n.join(spark.createDataFrame([("NATION_3", "XYZ"), ("NATION_7", "QQQ")], "n_name string, value string"), "n_name").select("n_nationkey", "value")
    return J.overlay(base, fixed, ["n_nationkey"]).withColumnRenamed("value", "code")


# ---------------------------------------------------------------- calendar and checks
@query("SELECT o_orderkey, CAST(year(d) - CASE WHEN make_date(CAST(year(d) AS INTEGER), CAST(1 + o_custkey % 12 AS INTEGER), least(CAST(25 + o_custkey % 7 AS INTEGER), 28)) < d THEN 0 ELSE 1 END AS INTEGER) AS year FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fd03_year_of_filing(spark, d):
    o = X.table(spark, d, "orders")
    return o.select("o_orderkey", DT.fiscal_year_of_filing(F.col("o_orderdate"), (1 + F.col("o_custkey") % 12).cast("int"), (25 + F.col("o_custkey") % 7).cast("int")).alias("year"))


#: Names of quarters that a task makes, about.
TASK_FRAMES = 4_000_000


@query("SELECT s_suppkey, array_to_string(list_transform(list_reverse(generate_series(DATE '1998-07-01', date_trunc('quarter', DATE '1999-01-15' + CAST(s_suppkey * 9 AS INTEGER)), INTERVAL 3 MONTH)), lambda m: 'CY' || year(m) || 'Q' || quarter(m) || 'I'), ' ') AS frames FROM supplier")
def fd07_quarter_frames(spark, d):
    upto = F.date_add(F.lit("1999-01-15").cast("date"), (F.col("s_suppkey") * 9).cast("int"))
    suppliers = X.table(spark, d, "supplier").select("s_suppkey")
    # A row's text grows with its key, so a small file makes a large result: rows are dealt to tasks by what they make, not by what is read.
    frames = suppliers.agg(F.sum(F.greatest(F.datediff(upto, F.lit("1998-07-01").cast("date")) / 91, F.lit(0)))).first()[0] or 0
    return suppliers.repartition(1 + int(frames / TASK_FRAMES)).select("s_suppkey", F.array_join(DT.quarter_frames(1998, upto), " ").alias("frames"))


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def fd08_month_of_epoch(spark, d):
    return X.table(spark, d, "events").select("event_id", DT.month_of_epoch(F.unix_timestamp("ts")).alias("month"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS parsed, strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 9000 AS INTEGER), '%Y-%m-%d') AS serial FROM orders")
def fd09_parsed_dates(spark, d):
    k = F.col("o_orderkey") % 3
    text_ = F.when(k == 0, F.date_format("o_orderdate", "MMddyyyy")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    told = lambda c: F.date_format(c, "yyyy-MM-dd")
    return X.table(spark, d, "orders").select("o_orderkey", told(DT.parse_any(text_, "MMddyyyy", "MM/dd/yyyy", "yyyy-MM-dd")).alias("parsed"), told(DT.excel_serial(30000 + F.col("o_orderkey") % 9000)).alias("serial"))


#: A catalogue of kinds and brands of parts: a brand belongs to a kind, a few to two; files are there for most.
CATALOGS = """SELECT category, indicator_id, CASE WHEN n % 5 = 0 THEN 'planned' ELSE 'ready' END AS status FROM (SELECT CASE WHEN p_partkey % 400 = 0 THEN 'MIXED' ELSE 'KIND' || CAST(p_size % 9 AS STRING) END AS category, p_brand || '-' || CAST(p_size AS STRING) AS indicator_id, min(p_partkey) AS n FROM part GROUP BY 1, 2) AS x"""
KEPT = """SELECT DISTINCT 'KIND' || CAST((p_size + CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END) % 9 AS STRING) AS category, p_brand || '-' || CAST(p_size AS STRING) AS indicator_id FROM part WHERE p_retailprice > 905"""


@query(f"""WITH c AS ({CATALOGS}), f AS ({KEPT}) SELECT 'clash' AS rule, category, indicator_id FROM c WHERE indicator_id IN (SELECT indicator_id FROM c GROUP BY 1 HAVING count(DISTINCT category) > 1) UNION ALL SELECT 'no_file', category, indicator_id FROM c WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM f WHERE f.category = c.category AND f.indicator_id = c.indicator_id)
UNION ALL SELECT 'not_listed', category, indicator_id FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE f.category = c.category AND f.indicator_id = c.indicator_id) UNION ALL SELECT 'few_ready', category, NULL FROM c GROUP BY category HAVING count(*) FILTER (status = 'ready') < 3""")
def q03_repository_rules(spark, d):
    return C.repository_findings(_rows(spark, d, CATALOGS), _rows(spark, d, KEPT))


@query(IQ._with("tax", "pretax") + """, n AS (SELECT t.ticker, t.year, round(t.value / p.value, 4) AS x FROM tax t JOIN pretax p USING (ticker, year, period_end) WHERE p.value > 0),
f AS (SELECT tax.ticker, tax.year, tax.value / nullif(pretax.value, 0) + CASE WHEN CAST(tax.ticker AS BIGINT) % 5 = 0 THEN 0.5 ELSE 0 END AS value FROM tax JOIN pretax USING (ticker, year))
SELECT count(*) AS n, round(avg(CASE WHEN abs(x - value) <= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS agree, avg(CASE WHEN abs(x - value) <= 0.01 THEN 1.0 ELSE 0.0 END) >= 0.7 AS passed FROM n JOIN f USING (ticker, year) WHERE value IS NOT NULL""")
def q11_note_against_fact(spark, d):
    """The rate in an indicator's note against the rate of the facts, some of which disagree."""
    tax, pretax = IQ.view(spark, d, "tax"), IQ.view(spark, d, "pretax")
    met = tax.alias("t").join(pretax.alias("p"), ["ticker", "year", "period_end"]).where("p.value > 0")
    notes = met.select("ticker", "year", F.concat(F.lit("effective_rate="), F.format_string("%.4f", F.round(F.col("t.value") / F.col("p.value"), 4)), F.lit(" (tax, pretax)")).alias("note"))
    off = F.when(F.col("ticker").cast("long") % 5 == 0, 0.5).otherwise(0.0)
    facts = tax.alias("t").join(pretax.alias("p"), ["ticker", "year"]).select("ticker", "year", (F.col("t.value") / F.nullif(F.col("p.value"), F.lit(0.0)) + off).alias("value"))
    return C.note_against_fact(notes, facts, r"effective_rate=(-?[0-9.]+)").withColumn("agree", r6(F.col("agree")))


#: What profiles weigh: the brands of each customer's last orders' lines.
_WEIGHED = "SELECT DISTINCT 'Brand#' || CAST(o_custkey % 40 AS STRING) AS indicator_id FROM orders"


@query(f"SELECT indicator_id FROM ({_WEIGHED}) WHERE indicator_id NOT IN (SELECT p_brand FROM part)")
def c07_unknown_weights(spark, d):
    """Indicators that a profile weighs in vain: brands that no part has."""
    from dataclasses import replace

    weighed = {r[0]: 1.0 for r in _rows(spark, d, _WEIGHED).collect()}  # 40 at most
    catalog = X.table(spark, d, "part").select(F.col("p_brand").alias("indicator_id")).distinct()
    found = scoring.unknown_weights(catalog, replace(X.PROFILE, indicator_weights=weighed))
    return spark.createDataFrame([(i,) for i in found], "indicator_id string")


_FOLD = [f.replace("'", "''") for f in T.FOLDED]


@query(f"SELECT conv_id, turn, translate(text || ' {_FOLD[0]} a', '{_FOLD[0]}', '{_FOLD[1]}') AS text FROM conversations")
def fs13_folded(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.folded(F.concat("text", F.lit(f" {T.FOLDED[0]} a"))).alias("text"))


@query("SELECT o_orderkey, 'total of ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' in ' || CAST(year(o_orderdate) AS VARCHAR) AS note FROM orders")
def fs16_notes(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("total of "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" in "), F.year("o_orderdate").cast("string")).alias("note"))
