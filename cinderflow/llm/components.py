"""Connected components of a link table by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderflow.storage import written


#: Parts into which the links of a node are dealt.
SALTS = 8


def salted(links: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """links joined by key with the one row that `one` has for it. A node may hold most links: they are dealt by the other end too."""
    part = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    return links.withColumn("_part", part).join(one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_part"]).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node in links (a, b).

    Each round is two grouped aggregations, written to the shared folder; nothing but the count of
    changed rows reaches the driver. A node's neighbours are not gathered: only their minimum is.

    Edge cases: links of a node with itself, repeated links and links with a null end say nothing and are left out;
    without links the result is empty.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        # Large star: every greater neighbour is tied to the node's least one (itself included).
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("v")))
        least = both.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m"))
        large = salted(both.where("v > n"), least, "n", "v").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # Small star: the lesser neighbours and the node itself are tied to the least.
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = salted(large, down, "hi", "lo")
        small = tied.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down.select("hi", F.col("m").alias("lo")))
        new = written(small.distinct(), "links")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)
