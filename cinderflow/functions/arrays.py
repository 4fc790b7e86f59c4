"""Lists in columns: parallel lists, first fits, sets of ids, joined lists, records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of_lists(df: DataFrame, keys, lists) -> DataFrame:
    """A row for each place of parallel lists; shorter lists end in NULL."""
    return df.select(*keys, F.explode(F.arrays_zip(*lists)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in lists])


def first_fit(items, fits):
    """The first item that fits, or NULL."""
    return F.get(F.filter(items, fits), F.lit(0))


def shared_ids(a, b):
    return F.array_intersect(a, b)


def all_ids(a, b):
    return F.array_union(a, b)


def unpiped(x):
    """'a|b' as a list; no items for NULL or an empty text."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda p: p != "")


def piped(items):
    return F.array_join(items, "|")


def ordered_distinct(items):
    """Each item once, where it stands first."""
    return F.array_distinct(items)


def record(*columns):
    """The columns as one JSON object; NaN and infinite numbers are null, as JSON has none."""
    whole = lambda c: F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(None)).otherwise(c)
    return F.to_json(F.struct(*[(whole(F.col(c)) if number else F.col(c)).alias(c) for c, number in columns]), {"ignoreNullFields": "false"})


def records(df: DataFrame) -> DataFrame:
    """record: every row as a JSON object."""
    return df.select(record(*[(c, t in ("double", "float")) for c, t in df.dtypes]).alias("record"))
