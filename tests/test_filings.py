"""Pay, sections and disclosures of filings: hand-made texts, edge cases, and places of matches against Python's own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderflow.functions.spots import cut, spots
from cinderflow.operators import filings as L

WORK = "We hire for talent and invest in training, retention, compensation and benefits across our workforce. Our leadership speaks with employees about safety, culture, career development and wellbeing. " * 3


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "filing_id long, text string")


def test_spots_equal_finditer(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab1, \n$é") for _ in range(draw.randrange(60))) for _ in range(80)] + ["", None]
    for pattern in (r"a+", r"\d[\d,]*", r"(?md)^[^\n]+$", r"[^\n]*\n|[^\n]+$"):
        got = frame(spark, *texts).select("text", spots(F.col("text"), pattern).alias("s")).collect()
        for r in got:
            assert [(x["at"], x["found"]) for x in r["s"]] == [(m.start(), m.group(0)) for m in re.finditer(pattern.replace("(?md)", "(?m)"), r["text"] or "")]


def test_cut_is_a_slice(spark):
    for low, high in ((-5, 3), (2, 2), (3, 1), (0, 99), (4, 6)):
        assert spark.range(1).select(cut(F.lit("abcdefgh"), F.lit(low), F.lit(high))).first()[0] == "abcdefgh"[max(0, low) : max(high, max(0, low))]


@pytest.mark.parametrize(
    ("text", "ratio"),
    [
        ("The ratio of the pay of our CEO to the median employee was 533 to 1.", 533), ("Ratio of median pay to our chief executive's: 1:346.", 346), ("The CEO pay ratio: the CEO earned 206 times that of our median employee.", 206),
        ("The CEO pay ratio, median to CEO: the ratio is 1 to 0.97.", 1.03), ("the median ratio for S&P 500 companies (195:1)", None), ("Proposal 3-1 on median terms", None), ("Median bonus: 6x annual base pay at median", None),
        ("median: in 2025 to 1 ratio", None), ("the pay ratio of median is 40 to 1. Adjusted ratio: the pay ratio of median is 60 to 1, pay ratio 40 to 1", 40), ("", None), (None, None),
    ],
)
def test_pay_ratio(spark, text, ratio):
    got = L.pay_ratio(frame(spark, text)).collect()
    assert [r["ratio"] for r in got] == ([ratio] if ratio else [])


def test_head_has_all_ratios_behind_the_wording(spark):
    """Beyond the last wording texts aren't searched, and no match is lost or cut there; a text without the wording isn't searched at all."""
    draw = random.Random(7)
    words = ["median ", "Pay Ratio ", "1", "12,345", " to ", ":1", "-", " one ", "3 x ", "times", ".5", "a sentence of other words, ", "b" * 90, "\n", "É", " 7" * 40]
    texts = ["".join(draw.choice(words) for _ in range(draw.randrange(90))) + "z" * draw.randrange(400) + " 5 to 1, 6 times" for _ in range(150)] + ["", "1 to 5", None]
    for kind, pattern in L.RATIOS.items():
        rows = frame(spark, *texts).withColumn("head", L.head(F.col("text"))).select("text", spots(F.col("head"), f"(?i){pattern}").alias("s"), spots(F.col("text"), f"(?i){pattern}").alias("whole")).collect()
        for r in rows:
            text = r["text"] or ""
            told = lambda at: re.search("median|pay ratio", text[max(0, at - L.RATIO_BEFORE) : at].lower())  # noqa: B023, E731
            assert [x for x in r["s"] if told(x["at"])] == [x for x in r["whole"] if told(x["at"])], kind
    assert {r["head"] for r in frame(spark, "b 1 to 5 " * 9).select(L.head(F.col("text")).alias("head")).collect()} == {""}


def test_median_pay_needs_agreement(spark):
    said = "The median employee was paid $50,000. The ratio is {} to 1. Our CEO received ${}."
    texts = [said.format(100, "5,000,000"), said.format(100, "5,090,000"), said.format(100, "6,000,000"), said.format(3, "150,000"), "The median employee, unlike our CEO, was paid $50,000; 100 to 1; $5,000,000", "Peers: median employee at the 25th percentile $50,000; 100 to 1; $5,000,000", None, ""]
    got = {r["filing_id"]: (r["median"], r["ratio"]) for r in L.median_pay(frame(spark, *texts)).collect()}
    assert got == {0: (50_000, 100), 1: (50_000, 100)}


def test_sections_are_islands(spark):
    two = f"Item 1. Business\nHuman Capital\n{WORK}\nOur People\n{WORK}\nItem 2. Properties\nLand."
    far = f"Talent Management\n{WORK}\nItem 2. Properties\n" + "Sales of goods rose. " * 200 + f"\nHuman Capital\n{WORK}\nPart II\n"
    trimmed = f"Human Capital\n{WORK}\nOrders Received\n" + "Orders came from all regions and prices held. " * 40 + "\nItem 2. Properties"
    risky = f"Risks Related to Human Capital\n{WORK}\nItem 2. Properties"
    none = "Item 1. Business\nWe sell goods."
    plain = "Part I\n" + WORK + "As of year end, we employed approximately 12,000 full-time employees worldwide, of whom staff and personnel in labor union jobs are few.\n" + "Sales of goods rose in all of our markets last year, as did the prices that we paid for raw goods and for land.\n"
    got = {r["filing_id"]: (r["heading"], r["section"]) for r in L.sections(frame(spark, two, far, trimmed, risky, none, plain, None, "")).collect()}
    assert got[0] == ("Human Capital", f"{WORK}\nOur People\n{WORK}".strip())
    assert got[1] == ("Human Capital", WORK.strip())
    assert got[2] == ("Human Capital", WORK.strip())
    assert got[5][0] == "(no heading)" and "12,000 full-time employees" in got[5][1] and "Sales of goods" not in got[5][1]
    assert set(got) == {0, 1, 2, 5}


def test_disclosures(spark):
    cases = {
        "We employed approximately 12,000 full-time employees.": {"headcount"}, "As of 2023 employees met.": set(), "59% of our employees met.": set(), "Our workforce\ntables\n\nwas 4,500": {"headcount"},
        "Voluntary turnover was 9.5%.": {"turnover_retention"}, "We kept 91% customer retention.": set(), "Staff took 12,500 hours of training.": {"training"}, "Volunteers gave 4,000 hours of training to children.": set(),
        "Our TRIR was 0.41 in the year.": {"safety"}, "Women\nTotal\n41%": {"representation_pct"}, "The gender pay gap is 2%.": {"pay_equity", "representation_pct"}, "Our engagement survey had 88% favorable answers.": {"engagement_score"},
        "About 27% of our total room count is union run.": set(), "A union covers 30% of staff.": {"union_coverage"},
    }
    rows = spark.createDataFrame([(i, "h", t) for i, t in enumerate(cases)] + [(99, "h", None)], "filing_id long, heading string, section string")
    got = {r["filing_id"]: {t["type"] for t in r["types"]} for r in L.disclosures(rows).collect()}
    wrong = {t: (got[i], want) for i, (t, want) in enumerate(cases.items()) if got[i] != want}
    assert wrong == {} and got[99] == set()
