"""Calendar functions of fiscal reporting."""

from pyspark.sql import functions as F


def fiscal_year_from_end(end):
    """Year of a period's end; an end in the first week of January belongs to the year before."""
    return (F.year(end) - F.when((F.month(end) == 1) & (F.dayofmonth(end) <= 7), 1).otherwise(0)).cast("int")


def fiscal_year_mid(end):
    """Year of the day 182 days before the end."""
    return F.year(F.date_sub(F.to_date(end), 182))


def fiscal_year_of_filing(filed, month, day):
    """Year of the last fiscal year end (month, day) strictly before the filing."""
    own = F.make_date(F.year(filed), month, F.least(day, F.lit(28)))
    return F.year(filed) - F.when(own < F.to_date(filed), 0).otherwise(1)


def quarter_label(day):
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def calendar_month(fiscal_month):
    """Calendar month of a federal fiscal month (October is 1)."""
    return ((fiscal_month + 8) % 12 + 1).cast("int")


def two_year_cycle(year):
    return (F.floor((year + 1) / 2) * 2).cast("int")


def parse_any(text, *formats):
    """The date of the first format that fits, else NULL."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def excel_serial(n):
    return F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))


def month_of_epoch(seconds):
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def quarter_frames(first_year: int, upto):
    """Names of quarter-end frames from the third quarter of first_year to the quarter of `upto`, newest first."""
    begin, end = F.lit(first_year * 4 + 2), F.year(upto) * 4 + F.quarter(upto) - 1
    numbers = F.when(end >= begin, F.sequence(end, F.least(begin, end), F.lit(-1))).when(end < begin, F.array().cast("array<int>"))
    return F.transform(numbers, lambda q: F.concat(F.lit("CY"), F.floor(q / 4).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"), F.lit("I")))
