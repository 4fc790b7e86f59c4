"""Where a pattern matches in a text, as arrays of (at, found), and the text around a match: Column functions of whole texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = "array<struct<at: int, found: string>>"


def spots(text, pattern: str):
    """Every match of a pattern that never matches nothing: its place (from 0) and what it matched, in order.

    The pieces between the matches give the places. The list grows with the matches of one text, not with its length.
    A text is searched once, and cut into pieces only if something was found.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(_NONE).alias("out"))

    def step(acc, p):
        at = acc["end"] + F.length(p["piece"])
        return F.struct((at + F.length(p["found"])).alias("end"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), p["found"].alias("found")))).alias("out"))

    def placed(f):
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f))
        return F.aggregate(F.arrays_zip(pieces.alias("piece"), f.alias("found")), start, step, lambda acc: acc["out"])

    # A list of one binds the matches: named twice, they would be searched for twice.
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) == 0, F.array().cast(_NONE)).otherwise(placed(f))), F.lit(0))


def cut(text, low, high):
    """Characters low to before high, counted from 0; low may lie before the text."""
    low = F.greatest(low, F.lit(0))
    return F.substr(text, low + 1, F.greatest(high - low, F.lit(0)))


def end_of(spot):
    return spot["at"] + F.length(spot["found"])


def has(text, pattern: str):
    """Whether the pattern matches somewhere, in any case."""
    return text.rlike(f"(?i){pattern}")


def number(text):
    """A figure with commas as a double."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def computed(df: DataFrame, **columns) -> DataFrame:
    """df with more columns, each computed once a row.

    A generator of one row keeps the optimizer from folding a column into the filters and lambdas above it, where it would be computed for every element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
