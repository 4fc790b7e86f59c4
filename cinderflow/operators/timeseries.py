"""Changes, trailing windows and compounding on (entity, period) rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.functions.numbers import ratio


def _by(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def change(value, keys, order):
    """v / previous row's v - 1."""
    return ratio(value, F.lag(value).over(_by(keys, order))) - 1


def consecutive_delta(df: DataFrame, keys, value="value", year="year") -> DataFrame:
    """Rows whose year follows the one before without a gap, with the change of the value."""
    w = _by(keys, year)
    told = df.withColumn("_y", F.lag(year).over(w)).withColumn("before", F.lag(value).over(w))
    return told.where(F.col(year) - F.col("_y") == 1).withColumn("delta", F.col(value) - F.col("before")).drop("_y")


def trailing(value, keys, order, rows: int):
    """Sum of the last `rows` rows; NULL until there are as many."""
    w = _by(keys, order).rowsBetween(1 - rows, 0)
    return F.when(F.count(F.lit(1)).over(w) == rows, F.sum(value).over(w))


def trailing_range(value, keys, order, span: int):
    """Sum over the rows whose order lies within the last `span` units."""
    return F.sum(value).over(_by(keys, order).rangeBetween(1 - span, 0))


def compounded(ret, keys, order):
    """Product of 1 + r up to the row."""
    return F.product(1 + ret).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def carried_forward(df: DataFrame, keys, until, year="year") -> DataFrame:
    """The latest row of each key, repeated for the years after it up to `until`, with carried = true."""
    latest = F.max(year).over(Window.partitionBy(*keys))
    last = df.withColumn("_m", latest).where(F.col(year) == F.col("_m")).drop("_m")
    more = last.where(F.col(year) < until).withColumn("_y", F.explode(F.sequence(F.col(year) + 1, F.lit(until))))
    more = more.withColumn(year, F.col("_y")).drop("_y").withColumn("carried", F.lit(True))
    return df.withColumn("carried", F.lit(False)).unionByName(more)


def lagged(df: DataFrame, keys, years: int, value="value", year="year") -> DataFrame:
    """Rows with the value of exactly `years` earlier (an equi-join, not a lag by rows)."""
    then = df.select(*keys, (F.col(year) + years).alias(year), F.col(value).alias("then"))
    return df.join(then, [*keys, year])
