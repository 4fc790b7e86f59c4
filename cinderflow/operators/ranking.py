"""Ranks, percentiles, buckets, and picking one row per key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.storage import written


def average_rank(value, partition):
    """Position from 1 by ascending value; ties share the mean of their positions. For rows whose value is not NULL."""
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2


#: Ranges a partition's values are cut into, so that no task orders all of them.
RANGES = 64


def met(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with other by keys of which NULL is one; without keys, with its one row."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    told = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return df.join(told, [df[k].eqNullSafe(told[f"_of_{k}"]) for k in keys], how).drop(*[f"_of_{k}" for k in keys])


def placed(df: DataFrame, value: str, partition: list[str], weight: str | None = None) -> DataFrame:
    """partition, value, before (rows of the partition with a lower value), count (rows with this one), n (rows of the partition): a row for each different value that is not NULL.

    Two levels: rows are counted by value, partial before the shuffle, so ties are one row; approximate quantiles cut each partition's values into
    ranges; counts of the ranges before, and of the values before in the same range, add up to the place. No window holds more than a range.
    With weight (whole numbers, never NULL) a row stands for so many.
    The quantiles are written: ranges and places both read them, and quantiles made twice may differ, as they depend on the order in which parts arrive.
    """
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*partition, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count")), "value-counts")
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    bounds = written(counts.groupBy(*partition).agg(F.percentile_approx(value, steps, F.lit(10_000)).alias("_b"), F.sum("count").alias("n")), "value-bounds")
    told = met(counts, bounds, partition).withColumn("_p", F.size(F.filter("_b", lambda b: b < F.col(value)))).drop("_b")
    earlier = lambda by, order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = told.groupBy(*partition, "_p").agg(F.sum("count").alias("_s"))  # RANGES rows a partition at most
    bases = ranges.select(*partition, "_p", F.coalesce(F.sum("_s").over(earlier(Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0)), "_p")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("count").over(earlier(Window.partitionBy(*partition, "_p"), value)), F.lit(0))
    return met(told.withColumn("_inside", inside), bases, [*partition, "_p"]).select(*partition, value, (F.col("_base") + F.col("_inside")).alias("before"), "count", "n")


def ranked(df: DataFrame, value: str, partition: list[str], weight: str | None = None) -> DataFrame:
    """partition, value, place (average rank from 1 by ascending value), n (rows of the partition): a row for each different value that is not NULL."""
    return placed(df, value, partition, weight).select(*partition, value, (F.col("before") + (F.col("count") + 1) / 2).alias("place"), "n")


def rank01_of(place, n, higher_is_better):
    """0 = worst to 1 = best from a place among n; a lone value gets 0.5."""
    up = (place - 1) / F.nullif(n - 1, F.lit(0))
    return F.when(n == 1, F.lit(0.5)).when(higher_is_better, up).otherwise(1 - up)


def rank01(value, partition, higher_is_better):
    """0 = worst to 1 = best within the partition; a lone value gets 0.5."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    up = (average_rank(value, partition) - 1) / F.nullif(n - 1, F.lit(0))
    return F.when(n == 1, F.lit(0.5)).when(higher_is_better, up).otherwise(1 - up)


def percentile_rank(value, partition):
    """Average rank over count, in (0, 1]."""
    return average_rank(value, partition) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def bucket(pct, n: int):
    """1..n for n equal steps of (0, 1], each closed on the right."""
    out = F.lit(n)
    for k in range(n - 1, 0, -1):
        out = F.when(pct <= k / n, F.lit(k)).otherwise(out)
    return out


def pick(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nr = 1").drop("_nr")


#: Types of fixed width.
FIXED = {"boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp"}


def latest(df: DataFrame, keys, by="year") -> DataFrame:
    """The row with the greatest `by` of each key, by a partial aggregate instead of a sort.

    Columns of fixed width are picked one by one, which a hash aggregate does; a struct, or a text, would have all rows sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    if all(df.schema[c].dataType.typeName() in FIXED for c in rest):
        return df.groupBy(*keys).agg(*[(F.max(c) if c == by else F.max_by(c, by)).alias(c) for c in rest])
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Every member of a key with more than one row."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")
