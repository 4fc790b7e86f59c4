"""Aggregates that plain SQL lacks or that need a guard."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderflow.functions.numbers import ratio
from cinderflow.operators.ranking import met, placed, ranked
from cinderflow.storage import written


def pearson(x, y):
    """Correlation; NULL for a constant column (corr() would raise)."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def paired_ranks(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """keys, x, y, count, rx, ry (average ranks within the key), n: a row for each different pair of values; rows lacking either value are left out.

    Pairs are counted and written, and both ranks come from counts by value, so no window holds a key.
    """
    keys = list(keys)
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_pairs")), "value-pairs")
    of_x = ranked(pairs, x, keys, "_pairs").withColumnRenamed("place", "rx")
    of_y = ranked(pairs, y, keys, "_pairs").withColumnRenamed("place", "ry").drop("n")
    return met(met(pairs, of_x, [*keys, x]), of_y, [*keys, y]).withColumnRenamed("_pairs", "count")


def rank_correlation(pairs: DataFrame, keys) -> DataFrame:
    """keys, n, rho of paired_ranks(). Average ranks of n rows have the mean (n + 1) / 2, so one aggregate of squares is all; NULL for a constant side."""
    c, mean = F.col("count"), (F.col("n") + 1) / 2
    dx, dy = F.col("rx") - mean, F.col("ry") - mean
    return pairs.groupBy(*keys).agg(F.sum(c).alias("n"), ratio(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx)) * F.sqrt(F.sum(c * dy * dy))).alias("rho"))


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """keys, n, rho: correlation of average ranks within each key; rows lacking either value are left out."""
    return rank_correlation(paired_ranks(df, keys, x, y), keys)


def herfindahl(v):
    """Sum of squared shares."""
    return ratio(F.sum(v * v), F.sum(v) * F.sum(v))


def fences(df: DataFrame, keys: list[str], value: str, width: float = 3.0) -> DataFrame:
    """keys, low, high, n: fences at `width` interquartile ranges, NULL (no fence) where the range is 0; n is the number of values.

    From exact quantiles by counts: percentile() would hold a key's values in one task.
    """
    found = quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    spread, counts = F.col("q3") - F.col("q1"), df.groupBy(*keys).agg(F.count(value).alias("n"))
    low, high = F.when(spread > 0, F.col("q1") - width * spread), F.when(spread > 0, F.col("q3") + width * spread)
    return met(found, counts, keys).select(*keys, low.alias("low"), high.alias("high"), "n")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: exact quantiles with linear interpolation between neighbours; NULL for a key without values.

    percentile() holds every different value of a key in one task. Here values are counted, placed by ranges, and only the two neighbours of each quantile are picked.
    """
    before, at = F.col("before"), {name: (F.col("n") - 1) * share for name, share in shares.items()}
    pick = lambda k: F.max(F.when((before <= k) & (k < before + F.col("count")), F.col(value)))
    found = placed(df, value, keys).groupBy(*keys).agg(*[x for k, h in at.items() for x in (pick(F.floor(h)).alias(f"{k}_low"), pick(F.ceil(h)).alias(f"{k}_high"), F.max(h - F.floor(h)).alias(f"{k}_part"))])
    between = lambda k: F.when(F.col(f"{k}_low") == F.col(f"{k}_high"), F.col(f"{k}_low")).otherwise((1 - F.col(f"{k}_part")) * F.col(f"{k}_low") + F.col(f"{k}_part") * F.col(f"{k}_high"))
    told = found.select(*keys, *[between(k).alias(k) for k in shares])
    return met(df.select(*keys).distinct(), told, keys, "left") if keys else told


def sorted_list(x, n: int | None = None, sep: str = ", "):
    """Distinct values in order, the first n, as text."""
    held = F.array_sort(F.collect_set(x))
    return F.array_join(F.slice(held, 1, n) if n else held, sep)


def equal_split(df: DataFrame, keys, member: str, amount: str) -> DataFrame:
    """df with share: the amount of a key over its distinct members."""
    members = df.groupBy(*keys).agg(F.countDistinct(member).alias("_m"))
    return df.join(members, keys).withColumn("share", ratio(F.col(amount), F.col("_m"))).drop("_m")
