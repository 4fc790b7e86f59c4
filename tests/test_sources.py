"""Sources and sinks on files made here, extraction rules, and the stream."""

import bz2
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cinderflow.functions import extract
from cinderflow.sources import files
from cinderflow.storage import ship_package
from cinderflow.streaming import events


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def test_text_csv_keeps_blanks_and_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cik,name\n007,\n,x\n")
    assert [tuple(r) for r in files.read_text_csv(spark, str(tmp_path / "a.csv"), ["cik", "name"]).collect()] == [("007", ""), ("", "x")]


def test_positional_lines(spark, tmp_path):
    (tmp_path / "a.txt.bz2").write_bytes(bz2.compress(b"a|b|c\nshort|x\n1|2|3|4\n"))
    assert sorted(tuple(r) for r in files.read_positional(spark, str(tmp_path), ["x", "y", "z"]).collect()) == [("1", "2", "3"), ("a", "b", "c")]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("data.csv", "id,name,v\n01,é,\n02,b,3\n".encode("latin-1"))
    got = files.read_zipped_csv(spark, str(tmp_path / "*.zip"), ["id", "name", "v"], encoding="latin-1", keep=["id", "name"])
    assert [tuple(r) for r in got.collect()] == [("01", "é"), ("02", "b")]


def test_xlsx(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Name</t></si><si><t>Ac</t><t>me</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>45292</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in files.read_xlsx(spark, str(tmp_path / "*.xlsx"), ["name", "b", "day"]).collect()] == [("Acme", None, "45292")]


def test_json_facts(spark, tmp_path):
    fact = lambda end, val, filed, start="2020-01-01": {"start": start, "end": end, "val": val, "form": "10-K", "filed": filed}
    tree = {"facts": {"us-gaap": {"Sales": {"units": {"USD": [fact("2020-12-31", 5, "2021-02-01"), fact("2020-12-31", 6, "2022-02-01"), fact("2020-03-31", 1, "2021-02-01")]}}, "Revenues": {"units": {"USD": [fact("2020-12-31", 9, "2021-02-01")]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(tree))
    (tmp_path / "b.json").write_text("null")
    facts = files.facts_of(files.read_json_tree(spark, str(tmp_path / "*.json"), files.FACTS))
    assert facts.count() == 4
    assert [tuple(r) for r in files.annual_facts(facts, ["Sales", "Revenues"]).collect()] == [("a.json", 2020, 6.0)]
    assert [tuple(r) for r in files.annual_facts(facts, ["Revenues", "Sales"]).collect()] == [("a.json", 2020, 9.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert files.append_new(rows, path, ["k"]) == 2 and files.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    good = spark.sql("select 'A' ticker, 2020 year, 1.5d value, 's' source, 'u' source_url, date'2024-01-01' retrieved, '' note")
    files.write_indicator(good, str(tmp_path / "ind"), "eco1")
    assert spark.read.parquet(str(tmp_path / "ind")).collect()[0]["indicator_id"] == "eco1"
    with pytest.raises(ValueError, match="duplicate"):
        files.write_indicator(good.union(good), str(tmp_path / "ind"), "eco1")
    assert files.stale(spark, str(tmp_path / "ind/*/*.parquet"), 90).count() == 0
    assert files.demo(spark).count() == files.demo(spark).count() > 1000


def test_extraction(spark):
    text = "Item 1. Business\nWe employed approximately 12,500 full-time employees. About 900 employees are covered by union agreements.\nThe median compensation gives a pay ratio of 120 to 1; the CEO got $6,000,000 and the median $50,000. Leverage is 3 to 1.\nItem 2. Properties\nnone"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(
        extract.stated_employees("t").alias("n"), extract.headcount("t").alias("h"), extract.ratio_candidates("t").alias("c"), extract.dollar_amounts("t").alias("d"), extract.section("t", F.lit("Business")).alias("s"), extract.disclosure_types(F.col("t")).alias("k")
    )
    got = row.withColumn("best", extract.best_ratio(F.col("c"))).withColumn("median", extract.plausible_median(F.col("c"), F.col("d"))).collect()
    assert got[0]["n"] == 12500 and got[0]["h"]["value"] == 12500 and got[0]["best"] == 120.0 and got[0]["median"] == 50000
    assert got[0]["s"].startswith("We employed") and "Properties" not in got[0]["s"] and got[0]["k"] >= 3
    assert got[1]["n"] is None and got[1]["s"] is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id % 7 event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id % 7 as int)*6,0,0) ts, 1L user_id, 'a' event_type, 1.0d value, '' props from range(14)")
    rows.write.parquet(str(tmp_path / "in"))
    query = events.counted(events.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = sorted(map(tuple, events.counted(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert sorted(map(tuple, spark.table("counted").collect())) == want and sum(r[2] for r in want) == 7
