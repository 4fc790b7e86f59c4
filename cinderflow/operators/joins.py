"""Joins with structure: as-of, ranges, priorities, overlays, grids, contradictions, token blocks."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.storage import settled, small, written


def asof_within(left: DataFrame, right: DataFrame, key: str, at: str, as_of: str, days: int, also=None) -> DataFrame:
    """For each left row, all right rows of the newest as_of at or before `at` and at most `days` older, of those that meet `also`.

    Both sides are cut into periods of `days`: a match lies in the left row's own period or the one
    before, so the range condition becomes an equi-join on (key, period) with two copies of the left side.
    """
    period = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    # Left rows are numbered; a task that runs again must number them alike, so rows from a shuffle are written first.
    numbered = settled(left, "asof-left").withColumn("_row", F.monotonically_increasing_id())
    asked = numbered.withColumn("_p", F.explode(F.array(period(at), period(at) - 1)))
    held = right.withColumn("_p", period(as_of))
    age = F.datediff(F.col(at), F.col(as_of))
    met = asked.join(held, [key, "_p"]).where((age >= 0) & (age <= days) & (F.lit(True) if also is None else also)).drop("_p")
    newest = F.max(as_of).over(Window.partitionBy("_row"))
    return met.withColumn("_n", newest).where(F.col(as_of) == F.col("_n")).drop("_n", "_row")


def first_by_priority(df: DataFrame, keys, priority, value: str) -> DataFrame:
    """keys and the value of the row that comes first by priority; a partial aggregate."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*priority)).alias(value))


def overlay(base: DataFrame, top: DataFrame, keys, value="value") -> DataFrame:
    """The union of both, with top's value where both have a key."""
    b, t = base.select(*keys, F.col(value).alias("_b")), top.select(*keys, F.col(value).alias("_t"))
    return b.join(t, keys, "full").select(*keys, F.coalesce("_t", "_b").alias(value))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys) -> DataFrame:
    """primary, and the fallback rows of keys that it doesn't have."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def grid(entities: DataFrame, periods: DataFrame, facts: DataFrame, keys, values) -> DataFrame:
    """Every entity in every period, with 0 where there is no fact."""
    full = entities.crossJoin(F.broadcast(periods)).join(facts, keys, "left")
    return full.na.fill(0, values)


#: Texts of a word that meet its names in one task: a word that stands in more is dealt to parts.
PART_TEXTS = 100_000


def by_rarest_word(names: DataFrame, texts: DataFrame, words: str = "_words") -> DataFrame:
    """All pairs of names and texts in which the text has the name's rarest word: what holds all of a name's words is among them.

    words: an array column of either side. A word's texts are counted, partial before the shuffle; only words that are the rarest of some name are looked up,
    and one that stands in many texts is dealt to parts, to which its names are copied. Names without words, or with a word that no text has, meet nothing.
    """
    each = lambda df: df.select(words, F.explode(F.array_distinct(words)).alias("_w"))
    known = each(names).select("_w").distinct()
    held = each(texts).groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).join(known, "_w")
    rarest = each(names.select(words).distinct()).join(held, "_w", "left").groupBy(words).agg(F.min_by(F.struct("_w", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_w")).alias("_r"))
    rare = written(rarest.where("_r._n is not null").select(words, F.col("_r._w").alias("_w"), F.ceil(F.col("_r._n") / PART_TEXTS).cast("int").alias("_parts")), "rarest-words")
    asked = names.join(rare, words).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", words)
    told = texts.withColumn("_w", F.explode(F.array_distinct(words))).join(small(rare.select("_w", "_parts").distinct()), "_w")
    deal = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*[c for c in texts.columns if c != words]), F.col("_parts"))).otherwise(0)
    return asked.join(told.withColumn("_part", deal.cast("int")).drop("_parts", words), ["_w", "_part"]).drop("_w", "_part")


def token_candidates(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """(names, texts) pairs in which the whole words of a name stand in the text in a row. The other columns of texts are its key.

    Blocked by the name's rarest word; candidates carry keys only, and their texts are then fetched and the sequence is verified.
    """
    key = [c for c in texts.columns if c != text]
    n = names.withColumn("_words", F.split(name, " ")).where(F.col(name) != "")
    met = by_rarest_word(n, texts.select(*key, F.split(text, " ").alias("_words"))).join(texts, key)
    return met.where(F.concat(F.lit(" "), F.col(text), F.lit(" ")).contains(F.concat(F.lit(" "), F.col(name), F.lit(" "))))


def one_to_one(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """left joined with right; an error, raised at once, if a key stands twice on either side."""
    for name, df in (("left", left), ("right", right)):
        twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"keys stand more than once on the {name}: {[tuple(r)[:-1] for r in twice]}")
    return left.join(right, list(keys), how)
