"""What annual filings and proxies state: pay ratio, median pay, the workforce section, and the figures it discloses.

A filing is a row (filing_id, text). Matches of a pattern are an array of a row, so the text stays where it is; what has to be ordered or
clustered over many candidates goes on as narrow rows without text.

Edge cases: a null or empty text states nothing (no pay, no section). Repeated filing_ids are told apart by nothing here: give each filing one row.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.functions.spots import computed, cut, end_of, has, number, spots
from cinderflow.storage import written

# Patterns of amounts, ratios and of the words around them, and limits on what they mean.
_NUM = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
_SEP = r"\s*(-?\s*to\s*-?|:|-)\s*"
_END = r"(?![\d,]*\d|\.\d)"
RATIOS = {"forward": _NUM + _SEP + "(?:1|one)" + _END, "reverse": r"(?<![\d.,])(?:1|one)" + _SEP + _NUM + _END, "times": _NUM + r"\s*(?:x|times)\b"}
STATED_RATIO = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(?:-?\s*to\s*-?|:)\s*(?:1|one)(?![\d,]*\d)|(?<![\d.,])(?:1|one)\s*(?:-?\s*to\s*-?|:)\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?![\d,]*\d)"
DOLLAR = r"\$\s?(\d{1,3}(?:,\d{3})+|\d{4,7})(?:\.\d{2})?(?![\d,]*\d)(?!\s*(?:million|billion|thousand|k\b))"
MEDIAN_PERSON = (
    r"median\s+(?:compensated\s+|paid\s+|identified\s+)?(?:employee|associate|worker|team\s+member|colleague|individual|partner)"
    r"|median\s+(?:of\s+the\s+)?(?:annual\s+)?(?:total\s+)?compensation\s+of\s+(?:all\s+)?(?:[\w&.'-]+\s+){0,3}?(?:employees|associates|team\s+members)"
)
CHIEF = r"\bceo\b|chief executive|president|chairman|mr\.|ms\.|named executive"
NOT_PAY = r"percentile|threshold|less than|below|above|more than|per hour|hourly|range|average|u\.s\.|united states"
PARENTHESES = r"\([^()]{0,300}\)"
ASIDE = r",?\s*(?:other than|excluding|except(?: for)?)\s+[^,$]{0,60},"
BENCHMARK = r"s&p|peer|average|companies"
COMPARED = r"lower|higher|less|more|base|salary"
MOST_RATIO, LEAST_CHIEF, TOLERANCE = 20_000, 250_000, 0.02
RATIO_BEFORE, NEAR, AFTER, MEDIAN_BEFORE, AROUND, QUOTE_BEFORE, QUOTE_AFTER = 350, 150, 120, 300, 1_500, 220, 40


def _quote(x):
    return F.trim(cut(F.col("text"), x["at"] - QUOTE_BEFORE, end_of(x) + QUOTE_AFTER))


#: No match of RATIOS, and nothing it looks ahead to, goes beyond another character than these.
_WITHIN = r"\d,.\s:\-toneximsTONEXIMS"
HEAD = rf"(?is)^.*(?:median|pay ratio).{{0,{RATIO_BEFORE + 10}}}[{_WITHIN}]*+.?"


def head(text):
    """The text up to where the last number can stand that has the disclosure's wording before it, and on to a character that ends any match: matches there are those of the whole text."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), HEAD, 0)


def _ratios_of(kind: str, nth: int):
    """Statements of one kind that read like the chief's pay over the median, with a score. Needs text and its head()."""
    text, pattern = F.col("text"), RATIOS[kind]
    # What stands before comes first, and only numbers behind the disclosure's wording get the rest: places of a text are counted from its start each time.
    said = F.transform(spots(F.col("head"), f"(?i){pattern}"), lambda x, i: F.struct(x["at"].alias("at"), x["found"].alias("found"), F.lower(cut(text, x["at"] - RATIO_BEFORE, x["at"])).alias("before"), (F.lit(nth * 1_000_000) + i).alias("nth")))
    around = F.transform(
        F.filter(said, lambda x: x["before"].contains("median") | x["before"].contains("pay ratio")),
        lambda x: F.struct(
            x["found"].alias("found"), x["before"].alias("before"), F.lower(cut(text, end_of(x), end_of(x) + AFTER)).alias("after"),
            F.regexp_extract(x["found"], f"(?i){pattern}", 2 if kind == "reverse" else 1).alias("figure"), F.regexp_extract(x["found"], f"(?i){pattern}", 1 if kind == "reverse" else 2).alias("sep") if kind != "times" else F.lit("").alias("sep"),
            F.right(x["before"], F.lit(NEAR)).alias("near"), _quote(x).alias("quote"), x["nth"].alias("nth"),
        ),
    )
    ok = lambda x: ~x["figure"].rlike(r"^(?:19|20)\d\d$") & ~F.right(x["near"], F.lit(80)).rlike(BENCHMARK)
    if kind == "times":
        fit = lambda x: ok(x) & x["after"].contains("median") & ~F.left(x["after"], F.lit(15)).rlike(COMPARED)
    elif kind == "reverse":
        fit = lambda x: ok(x) & x["near"].contains("ratio")
    else:
        fit = lambda x: ok(x) & (x["near"].contains("ratio") | (F.trim(x["sep"]) != "-"))
    value = lambda x: number(x["figure"])
    if kind == "reverse":  # "chief to median: 1 to 0.97"
        value = lambda x: F.when((number(x["figure"]) > 0) & (number(x["figure"]) < 1), F.round(1 / number(x["figure"]), 2)).otherwise(number(x["figure"]))
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = lambda x: one(x["near"].contains("ratio"), 2) + one(x["before"].contains("ceo") | x["before"].contains("chief executive"), 1) + (0 if kind == "times" else 2) - one(x["near"].contains("adjusted"), 1)
    told = F.transform(F.filter(around, fit), lambda x: F.struct(score(x).alias("score"), value(x).alias("value"), x["quote"].alias("quote"), x["nth"].alias("nth")))
    return F.filter(told, lambda x: x["value"].between(1, MOST_RATIO))


def pay_ratio(filings: DataFrame) -> DataFrame:
    """filing_id, ratio, score, quote, others: the chief's pay as a multiple of the median employee's, of filings that state one.

    The best scored statement; of equal ones the number that is stated most often, then the first. others: up to five other numbers, ascending.
    """
    found = computed(computed(filings, head=head(F.col("text"))), c=F.concat(*[_ratios_of(k, i) for i, k in enumerate(RATIOS)])).select("filing_id", "c")
    times = lambda x: F.size(F.filter("c", lambda o: o["value"] == x["value"]))
    ranked = F.transform("c", lambda x: F.struct(x["score"].alias("score"), times(x).alias("times"), (-x["nth"]).alias("before"), x["value"].alias("value"), x["quote"].alias("quote")))
    best = computed(found, best=F.array_max(ranked)).where("best is not null")
    others = F.filter(F.array_sort(F.array_distinct(F.transform("c", lambda x: x["value"]))), lambda v: v != F.col("best.value"))
    return best.select("filing_id", F.col("best.value").alias("ratio"), "best.score", "best.quote", F.slice(others, 1, 5).alias("others"))


def median_pay(filings: DataFrame) -> DataFrame:
    """filing_id, median, ratio, quote: the median employee's pay, of filings in which it agrees with a stated ratio and the chief's pay.

    Candidates are amounts after the disclosure's wording, nearest first; one counts if, times a ratio stated around it, it is again an amount of the
    filing within the tolerance. The first candidate and its least such ratio are taken.
    """
    text = F.col("text")
    amount = lambda x: number(F.regexp_extract(x["found"], r"\$\s?([\d,]+)", 1))
    dollars = computed(filings.select("filing_id", "text"), d=spots(text, f"(?i){DOLLAR}"))
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, PARENTHESES, " "), f"(?i){ASIDE}", " ")
    before = F.transform("d", lambda x: F.struct(x["at"].alias("at"), amount(x).alias("value"), _quote(x).alias("quote"), plain(cut(text, x["at"] - MEDIAN_BEFORE, x["at"])).alias("before")))
    phrase = F.transform(
        before,
        lambda x: F.struct(
            x["at"].alias("at"), x["value"].alias("value"), x["quote"].alias("quote"), F.try_element_at(F.regexp_extract_all(x["before"], F.lit(f"(?i){MEDIAN_PERSON}"), F.lit(0)), F.lit(-1)).alias("phrase"),
            F.try_element_at(F.split(x["before"], f"(?i){MEDIAN_PERSON}", -1), F.lit(-1)).alias("between"),
        ),
    )
    fit = lambda x: x["phrase"].isNotNull() & x["value"].between(1_000, 1_000_000) & ~has(x["between"], CHIEF) & ~has(F.concat(x["phrase"], x["between"]), NOT_PAY) & ~has(x["between"], DOLLAR)
    said = computed(dollars, amounts=F.transform("d", amount), c=F.filter(phrase, fit)).where(F.size("c") > 0)
    ordered = F.array_sort(F.transform("c", lambda x: F.struct(F.length(x["between"]).alias("far"), x["value"].alias("value"), x["quote"].alias("quote"), x["at"].alias("at"))))
    figure = lambda m: F.coalesce(number(F.nullif(F.regexp_extract(m, f"(?i){STATED_RATIO}", 1), F.lit(""))), number(F.regexp_extract(m, f"(?i){STATED_RATIO}", 2)))
    near = lambda x: F.regexp_extract_all(cut(text, x["at"] - AROUND, x["at"] + AROUND), F.lit(f"(?i){STATED_RATIO}"), F.lit(0))
    ratios = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(near(x), figure), lambda r: (r > 1) & (r <= MOST_RATIO))))
    agrees = lambda x, r: (x["value"] * r >= LEAST_CHIEF) & F.exists("amounts", lambda d: (d != x["value"]) & (F.abs(d - x["value"] * r) <= TOLERANCE * x["value"] * r))
    tried = F.transform(ordered, lambda x: F.struct(x["value"].alias("median"), F.get(F.filter(ratios(x), lambda r: agrees(x, r)), F.lit(0)).alias("ratio"), x["quote"].alias("quote")))
    picked = computed(said, p=F.get(F.filter(tried, lambda x: x["ratio"].isNotNull()), F.lit(0))).where("p is not null")
    return picked.select("filing_id", "p.median", "p.ratio", "p.quote")


# Headings that open the workforce discussion, the most specific first; what ends it; its words; limits of a section.
HEADINGS = [
    r"human capital\w*",
    r"(?:our|about our|focus on our|investing in our|supporting our)\s+(?:people|employees|workforce|associates|team members|colleagues|talent|workers)",
    r"(?:people|employees|workforce|talent|culture|associates|team members)\s*(?:,|and|&)\s*(?:culture|people|talent|community|communities|diversity|inclusion|development|engagement|human capital|benefits|workplace)",
    r"(?:employees|people|workforce|associates|team members|colleagues|our team)",
    r"talent\s+(?:management|development|acquisition|strategy)",
    r"(?:workforce|employee|team member)\s+(?:engagement|development|experience)",
]
WRAP = r"[A-Za-z&,'/ -]{0,30}"
LEAD, RUN_LEAD = r"^[\s\d.ivx()•-]{0,8}", r"^[\s\d.()•-]{0,8}"
STOP = (
    r"^[ ]{0,4}(?:item\s+\d+[a-c]?\b[^\n]{0,60}|part\s+[iv]+\b[^\n]{0,40}"
    r"|(?:available information|information about[^\n]{0,60}executive officers[^\n]{0,20}|executive officers[^\n]{0,40}|risk factors|our properties|properties|legal proceedings|unresolved staff comments|government regulation|"
    r"governmental regulation|regulation(?:s)?(?: and supervision)?|supervision and regulation|regulatory (?:matters|environment|oversight)|intellectual property|seasonality|competition|research and development|human rights|"
    r"[^\n]{0,30}(?:environmental|sustainability|climate|corporate responsibility|community (?:engagement|impact|investment|relations)|government supervision|supervision and regulation)[^\n]{0,40}|"
    r"corporate (?:information|governance)|website access|forward[- ]looking statements|climate change|backlog|raw materials|suppliers|sales and marketing|our strategy|business strategy|segment information|"
    r"where (?:you can find|to find)[^\n]{0,40}information|investor information|general development of business|reportable segments|products and services|manufacturing|distribution|customers|insurance|patents|trademarks)"
    r")[ :.\-]*$"
)
TOPICS = (
    r"\b(employee|employees|workforce|workers|associates|team members|colleagues|talent|hiring|hire\w*|recruit\w*|retention|turnover|training|benefits|compensation|"
    r"diversity|inclusion|safety|engagement|wellbeing|well-being|wellness|labor|union|collective bargaining|development|culture|our people|workplace|wages|career|careers|"
    r"mentoring|leadership|employment|staff|personnel)\b"
)
TITLE = r"^[A-Z0-9][^a-z\n]{2,69}$|^(?:[A-Z][\w'&/,.-]*[ ]?){1,9}$"
MOST_SECTION, LEAST_SECTION, OPENING, GAP, RANK_COST = 30_000, 400, 2_500, 1_500, 2
APART, APART_LEAST, APART_TOPICS, APART_DIGITS = 1_500, 600, 2, 0.03
UNHEADED_SCORE, UNHEADED_CHARS, UNHEADED_LINE = 8, 300, 80

#: Of the patterns of HEADINGS on a line of their own, and run into the text: how each opens, and the rank it starts from.
_OPENERS = [(rf"{LEAD}({WRAP}\b{k}\b{WRAP})[\s:.-]*$", "", i) for i, k in enumerate(HEADINGS)]
_OPENERS += [(rf"{RUN_LEAD}({k}[A-Za-z&,'/ -]{{0,25}}?)\s*[.:;-]?\s+", "(?=[A-Z])", i) for i, k in enumerate(HEADINGS[:2])]
_OPENERS += [(rf"{RUN_LEAD}({k})\s*[-:]\s+", "(?=[A-Z])", i) for i, k in enumerate(HEADINGS[2:4], 2)]


def topic_score(x):
    """How many different words of the workforce a text uses."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(TOPICS), F.lit(0))))


def stripped(x):
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _apart(window):
    """Whether what follows a heading has stopped being about the workforce; tables of figures, and too little text, have not."""
    n = F.length(window)
    digits = F.length(F.regexp_replace(window, "[^0-9]", ""))
    return (n >= APART_LEAST) & (digits <= APART_DIGITS * n) & (topic_score(window) <= APART_TOPICS)


def _heads(opener: str, ahead: str, rank: int):
    """Headings of one pattern: what they say, where their text starts, and their rank."""
    text, flags = F.col("text"), "(?imd)"
    after_line = lambda x: F.call_function("locate", F.lit("\n"), text, x["at"] + 1)
    begin = (lambda x: end_of(x)) if ahead else (lambda x: F.coalesce(F.nullif(after_line(x), F.lit(0)), F.length(text)))
    heading = lambda x: stripped(F.regexp_extract(x["found"], f"{flags}{opener}\\z", 1))
    return F.transform(spots(text, f"{flags}{opener}{ahead}"), lambda x: F.struct(begin(x).cast("int").alias("start"), heading(x).alias("heading"), F.lit(rank).alias("rank")))


def _spans(filings: DataFrame) -> DataFrame:
    """filing_id, nth, start, end, heading, score: the text under each heading, up to what ends it, if it is long enough and on its topic.

    A heading goes on as a row with the text behind it, MOST_SECTION at most.
    """
    text = F.col("text")
    heads = filings.select("filing_id", "text", F.posexplode(F.concat(*[_heads(*o) for o in _OPENERS])).alias("nth", "h")).select("filing_id", "text", "nth", "h.*")
    # A line in which a run-in body starts doesn't open there: what stands before it is too long for STOP to reach over.
    front = F.when(cut(text, F.col("start") - 1, F.col("start")) == "\n", "\n").otherwise("x" * 40)
    rest = heads.where(~has(F.col("heading"), r"\brisks?\b")).select("filing_id", "nth", "start", "heading", "rank", front.alias("front"), cut(text, F.col("start"), F.col("start") + MOST_SECTION).alias("rest"))
    stop = computed(rest, stop=F.regexp_instr(F.concat("front", "rest"), F.lit(f"(?imd){STOP}")))
    body = computed(stop, body=stripped(F.when(F.col("stop") > 0, cut(F.col("rest"), F.lit(0), F.col("stop") - 1 - F.length("front"))).otherwise(F.col("rest")))).drop("rest", "front", "stop")
    # The body goes up to the first line that looks like a heading, is not about the workforce, and opens text that isn't either.
    long = computed(body.where(F.length("body") >= LEAST_SECTION), lines=F.transform(spots(F.col("body"), r"[^\n]+"), lambda x: F.struct(x["at"].alias("at"), stripped(x["found"]).alias("line"))))
    shaped = F.filter("lines", lambda x: (x["at"] > 0) & F.length(x["line"]).between(3, 70) & ~x["line"].rlike("[.,;:]$"))
    titles = F.filter(F.filter(shaped, lambda x: x["line"].rlike(TITLE)), lambda x: topic_score(x["line"]) == 0)
    windows = F.transform(titles, lambda x: F.struct(x["at"].alias("at"), cut(F.col("body"), x["at"], x["at"] + APART).alias("window")))
    ended = computed(computed(long, titles=windows), to=F.get(F.filter("titles", lambda x: _apart(x["window"])), F.lit(0))["at"])
    trimmed = computed(ended.withColumnRenamed("body", "whole"), body=F.when(F.col("to").isNull(), F.col("whole")).otherwise(stripped(cut(F.col("whole"), F.lit(0), F.col("to"))))).where(F.length("body") >= LEAST_SECTION)
    # Scored by how it opens. White space before a body counts as part of it, as it has been cut from its start.
    scored = computed(trimmed, end=F.col("start") + F.length("body"), score=topic_score(F.left("body", F.lit(OPENING))) - RANK_COST * F.col("rank")).select("filing_id", "nth", "start", "end", "heading", "score")
    return scored.where("score > 0")


def _unheaded(filings: DataFrame) -> DataFrame:
    """filing_id, start, end, heading, score: runs of lines that all speak of the workforce (or are short), of filings without a heading."""
    lines = filings.select("filing_id", F.explode(spots(F.col("text"), r"[^\n]*\n|[^\n]+$")).alias("l")).select("filing_id", "l.at", F.col("l.found").alias("line"))
    by = Window.partitionBy("filing_id").orderBy("at")
    on = (topic_score(F.col("line")) > 0) | (F.length(F.trim("line")) <= UNHEADED_LINE)
    runs = lines.select("filing_id", "at", (F.col("at") + F.length("line")).alias("end"), on.alias("on")).withColumn("run", F.sum(F.when(~F.col("on"), 1).otherwise(0)).over(by)).where("on")
    spans = runs.groupBy("filing_id", "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    met = filings.join(spans, "filing_id").select("filing_id", "start", "end", stripped(cut(F.col("text"), F.col("start"), F.col("end"))).alias("body")).where(F.length("body") >= UNHEADED_CHARS)
    told = met.select("filing_id", "start", "end", F.lit("(no heading)").alias("heading"), topic_score(F.left("body", F.lit(OPENING))).alias("score"), "body")
    counted = F.greatest(*[has(F.col("body"), f"(?md){p}").cast("int") for p in DISCLOSURES["headcount"]]) == 1
    return told.where((F.col("score") >= UNHEADED_SCORE) & counted).drop("body")


def sections(filings: DataFrame) -> DataFrame:
    """filing_id, heading, section: the workforce discussion of each filing that has one.

    Spans under headings that touch, or lie less than GAP apart, are one island; of a filing's islands the one with the best scored span is taken.
    """
    headed = written(_spans(filings), "section-spans")
    rest = filings.join(headed.select("filing_id").distinct(), "filing_id", "left_anti")
    every = headed.unionByName(_unheaded(rest).withColumn("nth", F.lit(0)))
    by = Window.partitionBy("filing_id").orderBy("start", "nth")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("reach") + GAP, 1).otherwise(0)).over(by)
    marked = every.withColumn("reach", reach).withColumn("island", island)
    islands = marked.groupBy("filing_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.min_by("heading", F.struct("start", "nth")).alias("heading"))
    best = islands.groupBy("filing_id").agg(F.max_by(F.struct("start", "end", "heading"), F.struct("score", -F.col("island"))).alias("b"))
    met = filings.join(best, "filing_id")
    return met.select("filing_id", "b.heading", stripped(cut(F.col("text"), F.col("b.start"), F.least("b.end", F.col("b.start") + MOST_SECTION))).alias("section"))


# Figures, the words of workers, and for each disclosure type the patterns that show it; what makes a match speak of something else.
NUM = r"(?:\d[\d,]*(?:\.\d+)?)"
PCT = r"(?:\d{1,3}(?:\.\d+)?\s?(?:%|percent))"
RATE = r"(?:\d{1,3}\.\d+)"
WORKER = (
    r"(?:employees|team members|teammates|associates|colleagues|co[- ]?workers|workers|crew members|cast members|persons|people|individuals|staff members|staff|personnel|"
    r"(?:employee )?equivalents?|FTEs?|professionals)\b"
)
#: Up to three stretches of 90 characters, each perhaps with a line end behind it; spelt so that a line end settles where a stretch ends, as a repeat of
#: a repeat would be tried in thousands of ways.
GAPS = r"(?:[^.\n]{0,90}\n[^.\n]{0,90}\n[^.\n]{0,90}\n?|[^.\n]{0,180}\n[^.\n]{0,90}\n?|[^.\n]{0,90}\n[^.\n]{0,180}\n?|[^.\n]{0,270}\n?)"
ABOUT = r"(?:approximately|about|roughly|over|more than|nearly|some|in excess of|a total of|almost)?"
GROUPS = r"women|female|gender|racially|ethnic\w*|minorit\w*|people of color|underrepresented|black|hispanic|latin[oax]\w*|asian|indigenous"
LEARNING = r"training|learning|education|tuition|upskilling|reskilling"
UNION = r"union|collective(?:ly)? bargain\w*|collective labor|labor agreement|works council|organized labor|CBAs?\b"
DISCLOSURES: dict[str, list[str]] = {
    "headcount": [
        rf"\b(?:had|have|has|employ|employs|employed|employing|totaled|totaling|numbered|with|our)\s+{ABOUT}\s*{NUM}\s*(?:million|thousand)?\s*(?:[\w][\w,.-]*\s+){{0,5}}{WORKER}",
        r"(?:workforce|headcount|head count|employee (?:base|population|count)|number of (?:[\w-]+\s+){0,3}(?:employees|associates|team members|teammates|colleagues|workers)|global team|total (?:employees|associates|team members|teammates|headcount))"
        rf"{GAPS}(?:was|of|is|are|totaled|comprised|consisted of|consists of|stood at|includes?|included|increased to|decreased to|to|:)\s*(?:approximately|about|over|more than|nearly|roughly)?\s*{NUM}",
        rf"as of [^.\n]{{0,45}}(?:approximately|about|roughly|over|more than|nearly)?\s*{NUM}\s*(?:[\w][\w,.-]*\s+){{0,4}}{WORKER}",
        rf"{WORKER}[^.\n]{{0,160}}(?:totaled|totalled|numbered|stood at)\s*(?:approximately|about|roughly|over|more than|nearly)?\s*{NUM}",
        rf"\b(?:employed|employs|employ)\s+{ABOUT}\s*{NUM}\b",
        rf"{NUM}\s*(?:[\w][\w,.-]*\s+){{0,3}}{WORKER}[^.\n]{{0,40}}(?:are|were|is|was)\s+employed\b",
        r"^(?:full|part)[- ]time[^\n]{0,30}\s[\d,]{4,}",
    ],
    "representation_pct": [
        rf"^[^.\n]{{0,60}}\b(?:women|female|gender|ethnicity|race|minorit\w*|people of color|underrepresented)\b[^.\n]{{0,60}}$(?:\n[^\n]{{0,140}}){{0,4}}\n[^\n]{{0,140}}{PCT}",
        rf"{PCT}{GAPS}\b(?:woman|{GROUPS})\b",
        rf"\b(?:{GROUPS})\b{GAPS}{PCT}",
    ],
    "turnover_retention": [
        rf"\b(?:voluntary|involuntary|overall|total|annual\w*|global|employee|regretted)?\s*(?:turnover|attrition|retention)\s*(?:rate|ratio|level)?[^.\n]{{0,60}}{PCT}",
        rf"{PCT}[^.\n]{{0,60}}\b(?:voluntary |involuntary |overall |annual |employee )?(?:turnover|attrition|retention)\b",
        rf"(?:voluntary|involuntary)\s+(?:termination|separation|departure)s?[^.\n]{{0,40}}{PCT}",
    ],
    "training": [
        rf"{NUM}\s*(?:million|thousand)?\s*(?:hours|hrs)\b[^.\n]{{0,80}}\b(?:training|learning|develop\w*|instruction|courses?|education)\b",
        rf"{NUM}\s*(?:million|thousand)?\s*(?:[\w][\w,.-]*\s+){{0,5}}(?:training|learning|development|instruction\w*|educational?)\s*(?:hours|hrs)\b",
        rf"\b(?:training|learning|develop\w*|upskilling|reskilling|education|tuition|courses?)\b[^.\n]{{0,80}}{NUM}\s*(?:million|thousand)?\s*(?:hours|hrs)\b",
        rf"(?:invested|spent|contributed|provided|reimbursed|committed)\s*(?:approximately|about|over|more than|nearly)?\s*\$\s?{NUM}\s*(?:million|billion|thousand)?[^.\n]{{0,80}}\b(?:{LEARNING}|develop\w* program\w*)\b",
        rf"\b(?:{LEARNING})\b[^.\n]{{0,80}}\$\s?{NUM}\s*(?:million|billion|thousand)?",
    ],
    "safety": [
        r"(?:total\s+)?(?:recordable|lost[- ]time|lost workday|days away|incident|injur\w*|illness|accident|fatality|DART|TRIR|TCIR|OSHA)\s*(?:and illness\s*|injury\s*|incident\s*|case\s*|severity\s*){0,2}"
        rf"(?:rate|frequency|ratio|index)[^.\n]{{0,90}}{RATE}",
        rf"\b(?:TRIR|TCIR|DART|LTIR|RIR|OSHA)\b[^.\n]{{0,50}}{RATE}",
        rf"{RATE}[^.\n]{{0,60}}(?:recordable|lost[- ]time|lost workday|injur\w*|incident|DART|TRIR)\s*(?:injury\s*|incident\s*|case\s*){{0,2}}(?:rate|frequency|index)",
    ],
    "pay_equity": [
        rf"(?:pay|compensation|wage|salary|gender|ethnicity)\s*(?:equity|gap|parity|equality|differenc\w*)[^.\n]{{0,80}}(?:{PCT}|{NUM}\s*(?:to|:)\s*{NUM}|\$\s?1(?:\.00)?\b)",
        rf"(?:{PCT}|\$\s?1(?:\.00)?)[^.\n]{{0,80}}(?:pay|compensation|wage)\s*(?:equity|gap|parity|equality)",
        rf"(?:women|female|minorit\w*|people of color|underrepresented)[^.\n]{{0,50}}\bearn\w*[^.\n]{{0,50}}(?:{PCT}|\$\s?{NUM})",
    ],
    "engagement_score": [
        r"(?:engagement|engaged|satisfaction|favorabilit\w*|eNPS|net promoter|(?:employee experience|inclusion|engagement|culture) index|pulse)\s*(?:survey\s*|index\s*|score\s*|rate\s*|result\w*\s*|ratin\w*\s*){0,2}"
        rf"[^.\n]{{0,70}}(?:{PCT}|score of\s*{NUM}|{NUM}\s*out of\s*{NUM})",
        rf"(?:{PCT}|score of\s*{NUM})[^.\n]{{0,70}}(?:engagement|favorab\w*|(?:employee |job )?satisfaction)",
        rf"{PCT}\s*of\s*(?:our\s*|surveyed\s*)?{WORKER}[^.\n]{{0,60}}(?:responded|agreed|said|reported|feel|felt|indicated|participated in (?:the |our )?(?:survey|engagement))",
        rf"{PCT}[^.\n]{{0,50}}(?:response rate|participation|completion rate)[^.\n]{{0,60}}survey",
        rf"survey[^.\n]{{0,60}}(?:response|participation) rate[^.\n]{{0,30}}{PCT}",
    ],
    "union_coverage": [
        rf"{PCT}[^.\n]{{0,90}}(?:{UNION})",
        rf"(?:{UNION})[^.\n]{{0,90}}{PCT}",
        rf"{NUM}\s*(?:[A-Za-z][A-Za-z-]*\s+){{0,4}}{WORKER}[^.\n]{{0,60}}(?:were |are |was |is )?(?:covered by|represented by|subject to|members of|belong to)[^.\n]{{0,50}}(?:collective bargaining|labor union|unions?|works council)",
    ],
}
NOT_STAFF_SHARE = r"(?:%|percent)\s+of\s+(?:our\s+|the\s+|its\s+)?(?:total\s+)?(?:room|revenue|sales|store|propert|site|hotel|restaurant|square|fleet|capacity)"
NOT_STAFF = r"\b(?:customer|client|subscriber|revenue|net|gross|dollar|member|user|patient|guest|policy|sales) (?:retention|turnover|satisfaction)\b"
NOT_TRAINING = r"volunteer|dependent|children|spouse|customer|client"
LEAST_HEADCOUNT, PAD = 50, 60


def _plausible(kind: str, x):
    """Whether a match has a figure that is not just a year, and speaks of the workforce."""
    figures = F.filter(F.regexp_extract_all(x["found"], F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda n: ~F.replace(n, F.lit(","), F.lit("")).rlike(r"^(?:19|20)\d\d$"))
    if kind == "headcount":  # a share of the workforce is no count; a count below 50 is one of something else
        figures = F.filter(figures, lambda n: ~F.regexp_like(x["found"], F.concat(F.lit(r"(?i)\Q"), n, F.lit(r"\E\s*(?:%|percent)"))))
    ok = (F.size(figures) > 0) & ~has(x["found"], NOT_STAFF)
    if kind == "union_coverage":
        ok = ok & ~has(x["found"], NOT_STAFF_SHARE)
    if kind == "headcount":
        ok = ok & ((F.array_max(F.transform(figures, number)) >= LEAST_HEADCOUNT) | has(x["found"], r"\b(?:million|thousand)\b"))
    return ok


def _sentence(text, x):
    """A match with a little around it, cut at full stops."""
    before, after = cut(text, x["at"] - PAD, x["at"]), cut(text, end_of(x), end_of(x) + PAD)
    left = F.when(before.contains("."), F.substring_index(before, ".", -1)).otherwise(before)
    right = F.when(after.contains("."), F.concat(F.substring_index(after, ".", 1), F.lit("."))).otherwise(after)
    return F.trim(F.regexp_replace(F.concat(left, x["found"], right), r"\s+", " "))


def _first_hit(kind: str, text):
    """The quote of the first plausible match, of the first pattern that has one."""
    hits = []
    for pattern in DISCLOSURES[kind]:
        fit = F.filter(spots(text, f"(?imd){pattern}"), lambda x: _plausible(kind, x))
        quotes = F.transform(fit, lambda x: _sentence(text, x))
        if kind == "training":
            quotes = F.filter(quotes, lambda q: ~has(q, NOT_TRAINING))
        hits.append(F.get(quotes, F.lit(0)))
    return F.coalesce(*hits)


def disclosures(sections_: DataFrame) -> DataFrame:
    """filing_id, heading, types (of DISCLOSURES, with the quote that shows each), n_types: figures that the sections disclose."""
    hits = F.array(*[F.struct(F.lit(k).alias("type"), _first_hit(k, F.col("section")).alias("quote")) for k in DISCLOSURES])
    told = computed(sections_, types=F.filter(hits, lambda h: h["quote"].isNotNull()))
    return told.select("filing_id", "heading", "types", F.size("types").alias("n_types"))
