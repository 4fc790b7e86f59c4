"""Embedding columns: which rows take part, and their components as whole numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are held within so many, so that they are exact in a double and sums of some billions stay exact.
MOST = 1 << 52


def finite(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has neither null, NaN nor infinite components. An empty vector is finite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.col(column).isNotNull() & F.coalesce(F.forall(F.col(column), lambda x: ok(x.cast("double"))), F.lit(False)))


def whole(column: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift of every component, the component as a double, as longs."""
    most = float(MOST)
    return F.transform(F.col(column), lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(most)), F.lit(-most))) + F.lit(shift).cast("long"))
