"""Panels that resume, HTML documents by charset, kept matches, and ranks in two levels."""

import os

import pytest
from pyspark.sql import functions as F

from cinderflow.operators import ranking
from cinderflow.operators.joins import token_candidates
from cinderflow.sources import files
from cinderflow.sources.panels import build_panels, done


def test_interrupted_panels_resume(spark, tmp_path):
    path = f"file://{tmp_path}/panels"
    asked = spark.createDataFrame([(f"e{k}", k) for k in range(20)], "entity string, v int")
    made = []

    def make(rows, fail=False):
        made.append(rows.count())
        if fail and len(made) == 2:
            raise OSError("stopped")
        return rows.select("entity", F.explode(F.array(F.col("v"), F.col("v") * 10)).alias("x"))

    with pytest.raises(OSError):
        build_panels(asked, lambda r: make(r, True), path, batches=3)
    assert done(spark, path).count() == 1
    got = sorted(map(tuple, build_panels(asked, make, path, batches=3).collect()))
    assert got == sorted((f"e{k}", x) for k in range(20) for x in (k, k * 10)) and len(made) == 4  # the finished batch was left alone
    assert sorted(map(tuple, build_panels(asked, make, path, batches=3).collect())) == got and len(made) == 4
    more = asked.unionByName(spark.createDataFrame([("new", 7)], "entity string, v int"))
    assert build_panels(more, make, path, batches=3).count() == len(got) + 2 and len(made) == 5  # only the batch that changed
    assert build_panels(asked.limit(0), make, f"file://{tmp_path}/none").count() == 0


def test_html_by_charset(spark, tmp_path):
    page = '<html><head><meta charset="{}"><title>T é</title><script>x</script></head><body>naïve</body></html>'
    kinds = {"a": ("utf-8", "utf-8"), "b": ("ISO-8859-1", "latin-1"), "c": ("windows-1252", "latin-1"), "d": ("unheard-of", "utf-8")}
    for name, (said, real) in kinds.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "p.html").write_bytes(page.format(said).encode(real))
    (tmp_path / "a" / "mark.htm").write_bytes("\ufeff<title>m</title>ü".encode("utf-16-le"))
    (tmp_path / "a" / "bad.html").write_bytes(b"<meta charset=utf-8>ok \xff end")
    (tmp_path / "a" / "empty.html").write_bytes(b"")
    got = {os.path.relpath(r["file"].removeprefix("file:"), tmp_path): (r["charset"], r["title"], r["text"]) for r in files.read_html(spark, f"file://{tmp_path}").collect()}
    assert all(got[f"{n}/p.html"][1:] == ("T é", "T é naïve") for n in kinds) and got["b/p.html"][0] == "ISO-8859-1"
    assert got["a/mark.htm"] == ("UTF-16LE", "m", "m ü") and "a/empty.html" not in got and got["a/bad.html"][2] == "ok � end"


def test_kept_matches(spark, tmp_path):
    rows = [("T1", "C2", "r", "m", "current", "2018|2020"), ("T1", "C1", "-struck", "m", "current", "2018")]
    files.write_matches(spark.createDataFrame(rows, files.MATCHES), f"file://{tmp_path}/m")
    assert [(r["committee"], r["cycles"]) for r in files.load_matches(spark, f"file://{tmp_path}/m").collect()] == [("C2", ["2018", "2020"])]
    files.write_matches(spark.createDataFrame([rows[0]] * 2, files.MATCHES), f"file://{tmp_path}/n")
    with pytest.raises(ValueError, match="twice"):
        files.load_matches(spark, f"file://{tmp_path}/n")


def test_ranks_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", 5)
    rows = [(p, float(v)) for p in "ab" for v in [3] * 40 + list(range(50)) + [1, 1, 2]] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "p string, v double")
    got = {(r["p"], r["v"]): (r["place"], r["n"]) for r in ranking.ranked(df, "v", ["p"]).collect()}
    for (p, v), (place, n) in got.items():
        own = sorted(x for q, x in rows if q == p and x is not None)
        at = [i + 1 for i, x in enumerate(own) if x == v]
        assert (place, n) == (sum(at) / len(at), len(own))
    assert len(got) == len({(p, v) for p, v in rows if v is not None})
    assert {r["v"]: r["place"] for r in ranking.ranked(df.where("p = 'c'"), "v", []).collect()} == {1.0: 1.0}


def test_names_in_texts_with_hot_words(spark, monkeypatch):
    from cinderflow.operators import joins

    monkeypatch.setattr(joins, "PART_TEXTS", 3)
    names = spark.createDataFrame([("the",), ("the moon",), ("moon base alpha",), ("mars",), ("",)], "name string")
    texts = [(k, t) for k, t in enumerate(["the moon is far", "on moon base alpha the crew", "base moon alpha", "the the the", None, "", *["the sun"] * 9])]
    got = sorted((r["k"], r["name"]) for r in token_candidates(names, spark.createDataFrame(texts, "k int, text string"), "name", "text").collect())
    assert got == sorted((k, n) for k, t in texts for n in ("the", "the moon", "moon base alpha", "mars") if f" {n} " in f" {t or ''} ")
