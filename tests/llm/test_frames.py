"""Operators on frames that don't come from files, on rows that agree in part, and on the ways taken beyond a size."""

import collections

import pytest
from pyspark.sql import functions as F

from cinderflow.llm import class_lm, decontamination, jaccard_join, mixing, token_ids
from cinderflow.storage import from_files, ship_package, sized, written

KIND = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship_package(spark)


def rows():
    base = "one two three four five six seven eight nine ten eleven twelve"
    return [(k, f"{base} {'x' * (k % 2)}" if k < 6 else f"text {k} stands alone with words {k * 7} and {k * 11} here") for k in range(40)]


def frames(spark):
    made = spark.createDataFrame(rows(), KIND)
    of_rdd = spark.createDataFrame(made.repartition(3).rdd, KIND)
    small = spark.range(40).select(F.col("id").alias("doc_id"))
    twice = made.join(small, "doc_id").join(small.withColumnRenamed("doc_id", "other"), F.col("doc_id") == F.col("other")).drop("other")
    return {"created": made, "rdd": of_rdd, "joined": twice, "file": written(made, "frame")}


@pytest.mark.parametrize("kind", ["created", "rdd", "joined", "file"])
def test_sizes_follow_rows_not_plans(spark, kind):
    df = frames(spark)[kind]
    assert from_files(df) == (kind == "file")
    settled, size = sized(df, "test-sized")
    assert from_files(settled) and 0 < size < 1 << 20


@pytest.mark.parametrize("kind", ["created", "rdd", "joined"])
def test_operators_on_made_frames(spark, kind):
    given = frames(spark)
    df, file = given[kind], given["file"]
    for f in (token_ids.write_and_read, jaccard_join.join, class_lm.score):
        told = lambda x: collections.Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect())
        assert told(f(df)) == told(f(file))


def test_mixed_keeps_rows_that_differ_elsewhere(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s1"), (1, "a b c", "de", "s2"), (1, "a b c", "de", "s2"), (1, "a b c", None, "s2"), (2, "d e", "en", "s1"), (None, "f", "fr", None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("lang")))
    taken = collections.Counter()
    for r in mixing.mix(docs.select("doc_id", "text", "source", "lang")).collect():
        taken[r["doc_id"]] += r["taken"]
    out = [r for r in mixing.mixed(docs).collect()]
    assert {(r["doc_id"], r["lang"], r["source"]) for r in out} <= {(r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
    by_source = collections.Counter()
    for r in out:
        by_source[r["source"]] += len(r["text"].split())
    targets = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(docs)).collect()}
    assert {s: n for s, n in by_source.items()} == pytest.approx(targets, abs=1) and sum(taken.values()) == pytest.approx(sum(targets.values()), abs=2)


def test_decontamination_shuffled_with_clean_documents(spark, monkeypatch):
    item = "Tom has 3 apples and buys 5 more apples at the old market how many apples does Tom have in the end"
    benchmark = spark.createDataFrame([(7, item), (None, item + " today"), (8, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"clean text number {k} about nothing at all") for k in range(300)] + [(900, "Before. " + item + " After."), (901, None), (None, item)], KIND)
    direct = collections.Counter((r["doc_id"], r["contaminated"], tuple(r["items"]), r["n_windows"]) for r in decontamination.contaminated(docs, benchmark).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    shuffled = collections.Counter((r["doc_id"], r["contaminated"], tuple(r["items"]), r["n_windows"]) for r in decontamination.contaminated(docs, benchmark).collect())
    assert direct == shuffled and sum(direct.values()) == 303
    assert {d for d, bad, *_ in direct if bad} == {900, None}
