"""Extraction from running text whose rules look around a match: Arrow-batched pandas UDFs."""

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_NUMBER = r"(\d{1,3}(?:,\d{3})+|\d{2,7})"
_EMPLOYED = re.compile(rf"{_NUMBER}\s+(?:full-time\s+|part-time\s+|total\s+)?(?:employees|associates|people|persons|team members)", re.I)
_STRICT = re.compile(rf"(?:employed|had|have|has)\s+(?:approximately\s+|about\s+|over\s+)?{_NUMBER}\s+(?:full-time\s+)?employees", re.I)
_NOT_OURS = re.compile(r"union|covered by|laid off|retired|per cent|%|students|customers", re.I)
_RATIO = re.compile(r"(\d{1,4}(?:\.\d+)?)\s*(?:to|:)\s*1\b", re.I)
_DOLLARS = re.compile(r"\$\s?(\d{1,3}(?:,\d{3})+|\d{4,9})(?:\.\d+)?")


def _int(text: str) -> int:
    return int(text.replace(",", ""))


def _unescaped(x: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return x.map(lambda t: None if t is None else html.unescape(t))


def _stated_employees(x: pd.Series) -> pd.Series:
    """The first number that a sentence says is employed."""
    return x.map(lambda t: _int(m[1]) if t and (m := _STRICT.search(t)) else None).astype("Int64")


def _headcount(x: pd.Series) -> pd.DataFrame:
    """The largest employee number whose surroundings don't speak of a part (unions, layoffs), with its surroundings."""

    def best(t):
        found = []
        for m in _EMPLOYED.finditer(t or ""):
            before, after = t[max(0, m.start() - 60) : m.start()], t[m.end() : m.end() + 60]
            around = before.rpartition(". ")[2] + m[0] + after.partition(". ")[0]  # of the same sentence
            if not _NOT_OURS.search(around):
                found.append((_int(m[1]), around.strip()))
        return max(found, default=(None, None))

    rows = [best(t) for t in x]
    return pd.DataFrame({"value": pd.array([r[0] for r in rows], "Int64"), "quote": [r[1] for r in rows]})


def _ratio_candidates(x: pd.Series) -> pd.Series:
    """'N to 1' statements with a score: nearby words of pay raise it, words of other ratios lower it."""

    def found(t):
        out = []
        for m in _RATIO.finditer(t or ""):
            near = t[max(0, m.start() - 200) : m.end() + 100].lower()
            score = 2 * ("median" in near) + 2 * ("pay ratio" in near) + ("compensation" in near) - 3 * ("leverage" in near or "split" in near)
            out.append({"ratio": float(m[1]), "score": int(score), "at": m.start()})
        return out

    return x.map(found)


def _dollar_amounts(x: pd.Series) -> pd.Series:
    return x.map(lambda t: [_int(m[1]) for m in _DOLLARS.finditer(t or "")])


def _udf(f, kind: str):
    """A column function that makes its UDF when it is called: executors import this module without a session."""

    def call(*columns):
        return F.pandas_udf(f, kind)(*columns)

    call.__doc__ = f.__doc__
    return call


def best_ratio(candidates):
    """Of ratio_candidates() the best scored; ties go to the more often stated, then to the first."""
    times = lambda c: F.size(F.filter(candidates, lambda o: o["ratio"] == c["ratio"]))
    ranked = F.transform(candidates, lambda c: F.struct(c["score"].alias("s"), times(c).alias("n"), (-c["at"]).alias("a"), c["ratio"].alias("r")))
    return F.array_max(ranked)["r"]


def plausible_median(candidates, amounts, tolerance: float = 0.02, least: int = 250_000):
    """A median pay: an amount that, times the ratio, is again a stated amount of `least` or more within the tolerance."""
    ratio = best_ratio(candidates)
    return F.get(F.filter(amounts, lambda m: F.exists(amounts, lambda p: (p >= least) & (F.abs(m * ratio - p) <= p * tolerance))), F.lit(0))


def _section(x: pd.Series, heading: pd.Series) -> pd.Series:
    """The text under a heading: the longest run from a line that is the heading to the next heading-like line."""

    def one(t, h):
        lines, best = (t or "").split("\n"), ""
        title = re.compile(rf"^\W*(?:item\s+\d+\w?\W+)?{re.escape(h)}\W*$", re.I)
        for i, line in enumerate(lines):
            if title.match(line):
                j = i + 1
                while j < len(lines) and not re.match(r"^\W*(?:item\s+\d|part\s+[iv]+\b)|^[A-Z][A-Z &]{8,60}$", lines[j], re.I if lines[j][:4].lower() in ("item", "part") else 0):
                    j += 1
                best = max(best, "\n".join(lines[i + 1 : j]).strip(), key=len)
        return best or None

    return pd.Series([one(t, h) for t, h in zip(x, heading, strict=True)])


#: Disclosure types and the patterns that show them.
DISCLOSURES = {
    "headcount": r"\d[\d,]* (?:full-time )?employees", "turnover": r"turnover|attrition", "diversity": r"diversity|women|minorit", "training": r"training|development hours", "safety": r"safety|injur|incident rate",
    "engagement": r"engagement survey|surveyed", "unions": r"union|collective bargaining", "pay": r"compensation|benefits|pay equity",
}


def disclosure_types(x):
    """How many of the disclosure types a text shows."""
    return sum((F.coalesce(F.lower(x).rlike(p).cast("int"), F.lit(0)) for p in DISCLOSURES.values()), F.lit(0))


unescaped = _udf(_unescaped, "string")
stated_employees = _udf(_stated_employees, "long")
headcount = _udf(_headcount, "value long, quote string")
ratio_candidates = _udf(_ratio_candidates, "array<struct<ratio: double, score: int, at: int>>")
dollar_amounts = _udf(_dollar_amounts, "array<long>")
section = _udf(_section, "string")


class _Page(HTMLParser):
    """Cells of a facts page as (member, concept, place, text): the member of the class they stand under, what they are, and their place in the row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells, self.member, self.concept, self.place, self.days, self.open, self.said = [], "", None, 0, 0, None, []

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs).get("class") or ""
        if tag == "tr":
            self.concept, self.place = None, 0
        _, named, rest = (self.get_starttag_text() or "").partition("defref_")
        if named and self.concept is None:
            self.concept = rest.partition("'")[0]
            _, axis, member = self.concept.partition("Axis=")
            if axis:
                self.member = member
        if tag == "th" and kind in ("tl", "th"):
            self.open = "head" if kind == "tl" else "day"
        elif tag == "td" and kind in ("num", "nump", "text"):
            self.open = "cell"
        elif tag in ("td", "th"):
            self.open = None
        self.said = [] if tag in ("td", "th") else self.said

    def handle_data(self, data):
        if self.open:
            self.said.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open:
            told = " ".join("".join(self.said).split())
            if self.open == "day":
                self.cells.append({"member": "", "concept": "day", "place": self.days, "text": told})
                self.days += 1
            elif self.open == "head":
                self.cells.append({"member": "", "concept": "head", "place": 0, "text": told})
            elif self.concept and "Axis=" not in self.concept:
                self.cells.append({"member": self.member, "concept": self.concept, "place": self.place, "text": told})
                self.place += 1
            self.open = None


def _page_cells(x: pd.Series) -> pd.Series:
    """All cells of a page of facts: the head, the columns' days, and the values by class member and concept."""

    def read(page):
        parser = _Page()
        parser.feed(page or "")
        parser.close()
        return parser.cells

    return x.map(read)


page_cells = _udf(_page_cells, "array<struct<member: string, concept: string, place: int, text: string>>")
