"""Queries of pay, workforce sections and disclosures over filings made of all documents.

FILINGS puts statements of many wordings before each document's whole text, in SQL that both engines take; the statements follow from doc_id, so the
oracle knows what was said and the queries have to find it.
"""

from pyspark.sql import functions as F

from cinderflow.operators import filings as L
from cinderflow.plans import fixtures as X

QUERIES, ORACLE = {}, {}


def query(sql):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def commas(n: str) -> str:
    """SQL of a whole number below a thousand million with commas."""
    part = lambda k: f"CAST(CAST(floor(({n}) / {k}) AS BIGINT) % 1000 AS STRING)"
    pad = lambda k: f"lpad({part(k)}, 3, '0')"
    return f"CASE WHEN ({n}) >= 1000000 THEN {part(1000000)} || ',' || {pad(1000)} || ',' || {pad(1)} WHEN ({n}) >= 1000 THEN {part(1000)} || ',' || {pad(1)} ELSE CAST(({n}) AS STRING) END"


STAFF, RATIO, MEDIAN = "(60 + doc_id * 37)", "(20 + doc_id % 400)", "(30000 + doc_id * 7919 % 60000)"
#: Of every fifth filing the chief's pay doesn't agree with ratio and median; every seventh states no ratio, every ninth no median.
CHIEF = f"({MEDIAN} * {RATIO} + CASE WHEN doc_id % 5 = 0 THEN {MEDIAN} * {RATIO} ELSE 0 END)"
_BULK = "'We hire for talent and invest in training, retention, compensation and benefits across our workforce, and our leadership speaks with employees about safety, culture, career development and wellbeing. ' || 'Managers hold regular talks on engagement and inclusion, and every colleague can raise concerns with personnel staff at any workplace. ' || 'Labor relations are good in all regions where our associates and team members work, including those with long careers.'"
_PAY = f"""CASE doc_id % 4 WHEN 0 THEN 'For the year, the median employee (identified from all staff, excluding our CEO) was paid $' || {commas(MEDIAN)} || '. The ratio of our CEO''s annual total compensation to that of our median employee was ' || CAST({RATIO} AS STRING) || ' to 1.'
 WHEN 1 THEN 'Annual total compensation of our median compensated employee: $' || {commas(MEDIAN)} || '. CEO pay ratio to the median employee: ' || CAST({RATIO} AS STRING) || ':1. For the 25th percentile of peers the median ratio is 3:1.'
 WHEN 2 THEN 'The median of the annual total compensation of all employees other than Mr. Creed, was $' || {commas(MEDIAN)} || '.00. The ratio of median employee to our chief executive is 1 to ' || CAST({RATIO} AS STRING) || '. Median pay of peers was above $50,000.'
 ELSE 'Our median associate earned $' || {commas(MEDIAN)} || ' in total. The CEO pay ratio is ' || {commas(RATIO)} || '-to-1, as in Proposal 3-1; terms run 1 to 5 years. The CEO earned ' || CAST({RATIO} AS STRING) || ' times the pay of the median associate.' END"""
_PEOPLE = f"""CASE doc_id % 3 WHEN 0 THEN 'As of December 31, 2024 we employed approximately ' || {commas(STAFF)} || ' full-time employees. ' WHEN 1 THEN 'In 2023 employees met often. ' ELSE 'Total headcount was ' || {commas(STAFF)} || ' people. ' END
 || CASE WHEN doc_id % 2 = 0 THEN 'Voluntary turnover was ' || CAST(5 + doc_id % 20 AS STRING) || '.5% in the year. ' ELSE 'We kept 91% customer retention in stores. ' END
 || CASE WHEN doc_id % 5 = 1 THEN 'Our total recordable incident rate was 0.' || CAST(10 + doc_id % 80 AS STRING) || ' per 200,000 hours. ' ELSE '' END
 || CASE WHEN doc_id % 7 = 2 THEN 'Women made up ' || CAST(20 + doc_id % 40 AS STRING) || '% of managers. ' ELSE '' END
 || CASE doc_id % 6 WHEN 0 THEN 'Volunteers gave 4,000 hours of training to children. ' WHEN 1 THEN 'Staff completed 12,500 hours of training. ' ELSE '' END"""
_HEAD = "CASE doc_id % 4 WHEN 0 THEN 'Human Capital\n' WHEN 1 THEN 'Our People\n' WHEN 2 THEN 'HUMAN CAPITAL. ' ELSE 'Employees - ' END"
_STOP = "CASE doc_id % 3 WHEN 0 THEN 'Item 1A. Risk Factors' WHEN 1 THEN 'Available Information' ELSE 'Item 2. Properties' END"
FILINGS = f"""SELECT doc_id AS filing_id, CASE WHEN doc_id % 11 = 5 THEN coalesce(text, '') ELSE 'Item 1. Business
The company sells goods.
' || {_HEAD} || {_PEOPLE} || {_BULK} || '
' || {_STOP} || '
Risks related to human capital are described elsewhere in this report.
' || CASE WHEN doc_id % 7 = 3 THEN '' ELSE {_PAY} END || CASE WHEN doc_id % 9 = 4 THEN '' ELSE '
Total: $' || {commas(CHIEF)} || '
' END || '
' || coalesce(text, '') END AS text FROM {{documents}}"""
_ORACLE = FILINGS.replace("{documents}", "documents")
_TOLD = "doc_id % 11 <> 5 AND doc_id % 7 <> 3"


def filings(spark, d):
    return spark.sql(FILINGS, documents=X.table(spark, d, "documents").where("doc_id is not null"))


@query(f"SELECT doc_id AS filing_id, CAST({RATIO} AS DOUBLE) AS ratio, 5 AS score FROM documents WHERE {_TOLD} AND doc_id IS NOT NULL")
def i12_pay_ratio(spark, d):
    """The pay ratio that each filing states: of statements in three forms the best scored."""
    return L.pay_ratio(filings(spark, d)).select("filing_id", "ratio", "score")


@query(f"SELECT doc_id AS filing_id, CAST({MEDIAN} AS DOUBLE) AS median, CAST({RATIO} AS DOUBLE) AS ratio FROM documents WHERE {_TOLD} AND doc_id % 5 <> 0 AND doc_id % 9 <> 4 AND {MEDIAN} * {RATIO} >= 250000 AND doc_id IS NOT NULL")
def i04_median_pay(spark, d):
    """The median pay of filings in which it agrees with the stated ratio and the chief's pay."""
    return L.median_pay(filings(spark, d)).select("filing_id", "median", "ratio")


_HEADING = "CASE doc_id % 4 WHEN 0 THEN 'Human Capital' WHEN 1 THEN 'Our People' WHEN 2 THEN 'HUMAN CAPITAL' ELSE 'Employees' END"


@query(f"SELECT doc_id AS filing_id, {_HEADING} AS heading, {_PEOPLE} || {_BULK} AS section FROM documents WHERE doc_id % 11 <> 5 AND doc_id IS NOT NULL")
def x07_sections(spark, d):
    """The workforce discussion of each filing, by headings clustered where they lie close."""
    return L.sections(filings(spark, d))


_TYPES = f"""list_filter([CASE WHEN doc_id % 3 <> 1 AND {STAFF} NOT BETWEEN 1900 AND 2099 THEN 'headcount' END, CASE WHEN doc_id % 7 = 2 THEN 'representation_pct' END, CASE WHEN doc_id % 2 = 0 THEN 'turnover_retention' END,
 CASE WHEN doc_id % 6 = 1 THEN 'training' END, CASE WHEN doc_id % 5 = 1 THEN 'safety' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id AS filing_id, {_HEADING} AS heading, array_to_string({_TYPES}, ',') AS types, CAST(len({_TYPES}) AS INTEGER) AS n_types FROM documents WHERE doc_id % 11 <> 5 AND doc_id IS NOT NULL")
def i18_disclosures(spark, d):
    """How many kinds of figures each filing's workforce discussion discloses, and which."""
    told = L.disclosures(L.sections(filings(spark, d)))
    return told.select("filing_id", "heading", F.array_join(F.transform("types", lambda t: t["type"]), ",").alias("types"), "n_types")
