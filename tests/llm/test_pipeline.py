"""The pipeline's stages, each judged on its own input, over the smallest sample tables."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderflow.llm import decontamination, jaccard_join, mixing
from cinderflow.storage import written

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages_on_their_inputs(spark):
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    # odd rows, and columns with names that the operators use
    odd = documents.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    docs = documents.unionByName(odd).unionByName(documents.limit(2)).withColumns({c: F.lit("x") for c in ("row", "score", "n", "cls", "group", "shard", "place", "hits", "print", "size", "ids", "start", "__text", "spot")})
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], DIR)
        if k < 4:
            assert out.columns == docs.columns
        inputs.append(written(out, "test-stage"))
    start, good, unique, clean, mix, ids = inputs
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    assert good.count() <= start.count()
    comps = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(good.select("doc_id", "text")).collect()}
    assert {r["doc_id"] for r in unique.collect()} == {i for i, c in comps.items() if i is None or i == c}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    holds = {r["doc_id"]: any(t in " ".join((r["text"] or "").lower().split()) for t in items) for r in unique.collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, bad in holds.items() if not bad}
    taken = collections.Counter()  # repeated rows add up
    for r in mixing.mix(clean).collect():
        taken[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in mix.collect():
        got[r["doc_id"]] += count(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}
    assert ids.count() == mix.count()
    assert collections.Counter(r["doc_id"] for r in ids.collect()) == collections.Counter(r["doc_id"] for r in mix.collect())
    assert not any(r["contaminated"] for r in decontamination.contaminated(clean, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, DIR), "test-empty")
        assert docs.count() == 0


def test_run_leaves_no_earlier_stage(spark):
    from cinderflow import storage

    shared = storage.shared_dir(spark).removeprefix("file://")
    with storage.scratch(spark) as own:
        out = corpus_pipeline.run(spark, DIR)
        names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in own.paths if os.path.isdir(f"{shared}/{p.rsplit('/', 1)[1]}")]
        assert out.count() > 0 and [n for n in names if n.startswith("stage-")] == ["stage-3"] and not any(n.startswith(("sets", "mix-sizes", "stats")) for n in names)
        lengths = [r["n_tokens"] for r in out.orderBy("start").collect()]
    left = {p.rsplit("/", 1)[1] for p in own.paths}
    assert not left & set(os.listdir(shared))  # nothing was kept, so all of it went
    assert lengths == [r["n_tokens"] for r in corpus_pipeline.run(spark, DIR).orderBy("start").collect()]  # reruns agree


def test_runs_side_by_side(spark):
    """Three runs in one session, two of one operator, leave one another's tables alone."""
    from concurrent.futures import ThreadPoolExecutor

    from cinderflow.llm import class_lm

    def model():
        return sorted((r["doc_id"], round(r["score"], 6)) for r in class_lm.op6_class_lm(spark, DIR).collect())

    with ThreadPoolExecutor(3) as pool:
        one, two, three = pool.submit(model), pool.submit(model), pool.submit(lambda: corpus_pipeline.run(spark, DIR).count())
        assert one.result() == two.result() and three.result() > 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
