"""Panels of all entities, built in batches that an interrupted build resumes."""

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "batch int, entities long, fingerprint long, at long"


def batch_of(entity, batches: int):
    return F.pmod(F.xxhash64(entity), F.lit(batches)).cast("int")


def done(spark, path: str) -> DataFrame:
    """The manifest: batch, entities, fingerprint (of what was asked) and time of each batch that was completed."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException:  # nothing built yet
        return spark.createDataFrame([], MANIFEST)


def build_panels(asked: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, batches: int = 8) -> DataFrame:
    """The panel of every asked entity (entity, and whatever make() reads), kept below path and returned.

    Entities are dealt to batches; a batch is one partition of the panel, written in place of what it held, and only then noted in the manifest with a
    fingerprint of what was asked. A batch that is noted with the same fingerprint is left as it is: a build that was stopped goes on with the
    batches that are missing, one whose question changed builds those it changed for, and repeating a build changes nothing. make() gets the rows of
    one batch and returns their panel with a column entity.

    Edge cases: nothing asked: an empty panel of make()'s columns. Null entities make a batch like others. Repeated rows are asked twice.
    """
    spark = asked.sparkSession
    dealt = asked.withColumn("batch", batch_of(F.col("entity"), batches))
    rows = F.xxhash64(*[F.col(c) for c in asked.columns])
    wanted = dealt.groupBy("batch").agg(F.countDistinct("entity").alias("entities"), F.sum(F.shiftright(rows, 16)).alias("fingerprint"))
    old = done(spark, path).groupBy("batch").agg(F.max_by("fingerprint", "at").alias("old"))
    todo = wanted.join(old, "batch", "left").where(~F.col("fingerprint").eqNullSafe(F.col("old"))).orderBy("batch").collect()  # a row a batch
    for r in todo:
        part = make(dealt.where(F.col("batch") == r["batch"]).drop("batch")).withColumn("batch", F.lit(r["batch"]))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/panel")
        spark.createDataFrame([(r["batch"], r["entities"], r["fingerprint"], time.time_ns())], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    try:
        return spark.read.parquet(f"{path}/panel").drop("batch")
    except AnalysisException:
        return make(asked.limit(0))
