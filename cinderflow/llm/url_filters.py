"""URL filters: host-suffix and path-prefix expressions, matched by hash prefix, then digest.

Every URL is expanded into the expressions under which a rule could name it (each suffix of the
host by whole labels, times each prefix of the path that has the length of some rule's path). An
expression meets the rules by an equi-join on the first eight hex digits of its SHA-256; the full
digest then confirms the match and the longest rule wins. Everything is DataFrame functions.

Edge cases
* null URL, or one without ``://``: host and path are empty; only a rule for the empty host fits.
* repeated rows and null or repeated page ids: each row is judged by itself and returned once.
* rules with equal host and path but both verdicts: block wins.
* no rules or no pages: an empty join; every page gets the default verdict.
* very long hosts or paths: a URL gives at most (labels of the longest rule) x (distinct lengths of
  rules' paths) expressions, whatever its own length.
* extra columns of the input, also ones that clash with names used here, are left out of the result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.storage import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules their table is sent to all executors (about 150 bytes each); above, both sides are shuffled.
BROADCAST_RULES, SALTS = 100_000, 16
PREFIX_DIGITS = 8
#: The rules of the registered query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url):
    """Columns host and path of a URL column."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule_table(rules: DataFrame) -> DataFrame:
    expression = F.concat_ws("\n", "host", "path")
    # One row per (host, path): max(verdict = block) is the precedence among equal rules.
    return (
        rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .select(
            F.sha2(expression, 256).alias("rule_digest"),
            F.struct(
                (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("host"), F.col("path"),
                F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"),
            ).alias("rule"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages (page_id, url).

    rules: host, path, verdict (``block`` or ``allow``). The two shapes of the rules that bound the
    expansion (most labels in a host, distinct path lengths) are aggregates of the rules alone.
    """
    table = _rule_table(rules)
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).first()
    host, path = host_and_path(F.col("url"))
    keyed = settled(pages.select("page_id", "url"), "filter-pages").select("page_id", F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, shape["labels"] or 1)))), lambda k: F.array_join(F.slice(labels, -k, k), ".")
    )
    lengths = F.array(*[F.lit(x) for x in shape["lengths"]]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))

    asked = keyed.select("*", F.explode_outer(expressions).alias("expression")).withColumn("digest", F.sha2("expression", 256))
    short = F.substring("digest", 1, PREFIX_DIGITS)
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("rule"))
    if shape["n"] <= broadcast_rules:
        hits = asked.withColumn("prefix", short).join(F.broadcast(table), "prefix", "left").withColumn("rule", confirmed)
    else:
        # Many pages share an expression such as a top-level domain: each is judged once, and its verdict then meets its pages in SALTS parts.
        # Pages without an expression go by their own number.
        once = asked.where("expression is not null").select("expression", "digest").distinct().withColumn("prefix", short).join(table, "prefix")
        found = once.where("digest = rule_digest").select("expression", "rule", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        part = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        own = F.coalesce("expression", F.concat(F.lit("\0"), F.col("row").cast("string")))
        hits = asked.withColumn("expression", own).withColumn("part", part).join(found, ["expression", "part"], "left")
    # The rows of a page lie together, so the partial aggregate leaves one row a page for the shuffle; "row" has no hot value.
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max("rule").alias("rule"))
    return best.select(
        "page_id", "host", "path", F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE_SQL = {
    "op1_url_filters": """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""
}
