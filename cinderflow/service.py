"""What the dashboard and the command line ask: answers as DataFrames, built and kept results, and registered indicators."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.config import CATEGORIES, Profile
from cinderflow.functions import arrays, text
from cinderflow.operators import checks, scoring
from cinderflow.sources import files
from cinderflow.storage import written

#: Indicators by id: functions from a session to the indicator's rows.
INDICATORS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def indicator(name: str):
    """Registers a function that builds an indicator under its id."""

    def keep(f):
        if name in INDICATORS:
            raise ValueError(f"{name} is registered twice")
        INDICATORS[name] = f
        return f

    return keep


def asked_profile(base: Profile, category_weights: dict | None = None, indicator_weights: dict | None = None) -> Profile:
    """base with a request's weights: listed category weights replace all three (missing ones are 0), indicator weights are added to the profile's."""
    if category_weights:
        base = replace(base, category_weights={c: float(category_weights.get(c, 0)) for c in CATEGORIES})
    if indicator_weights:
        base = replace(base, indicator_weights=base.indicator_weights | {k: float(v) for k, v in indicator_weights.items()})
    return base


def score_answer(universe: DataFrame, facts: DataFrame, catalog: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """rows (the score table), sectors (companies, scored and medians), fingerprints (points by indicator as JSON) and counts."""
    ranks = written(scoring.profile_ranks(universe, facts, scoring.indicator_weights(catalog, profile), profile), "ranks")
    table = scoring.score_ranks(universe, ranks, profile)
    half = lambda c: F.percentile(c, 0.5)
    sectors = table.where("sector <> ''").groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.count("total_score").alias("scored"), half("total_score").alias("total"), *[half(f"{c}_score").alias(c) for c in CATEGORIES])
    points = ranks.where("rank01 is not null").select("ticker", "indicator_id", F.rint(F.col("rank01") * 100).cast("int").alias("p"))
    prints = points.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator_id", "p"))))).alias("points"))
    counts = table.agg(F.count("total_score").alias("scored"), half("total_score").alias("median"))
    return {"rows": table, "sectors": sectors, "fingerprints": prints, "counts": counts}


def build_scores(universe: DataFrame, facts: DataFrame, catalog: DataFrame, profile: Profile, folder: str) -> DataFrame:
    """Scores a profile and keeps the table and the ranks as CSV below folder/name; returns the kept table. Prints what the profile weighs in vain."""
    for name in scoring.unknown_weights(catalog, profile):
        print(f"profile {profile.name}: {name} is no ready indicator and is left out")
    ranks = written(scoring.profile_ranks(universe, facts, scoring.indicator_weights(catalog, profile), profile), "ranks")
    table = scoring.score_ranks(universe, ranks, profile)
    files.write_csv(table.orderBy(F.desc_nulls_last("total_score"), "ticker"), f"{folder}/{profile.name}/scores")
    files.write_csv(ranks.where("rank01 is not null").select("ticker", "indicator_id", F.col("rank01").alias("rank")), f"{folder}/{profile.name}/indicator_ranks")
    return files.read_csv(universe.sparkSession, f"{folder}/{profile.name}/scores", table.schema)


#: What an audit looks for in a filing, by theme, and what speaks against a sentence.
THEMES = {
    "planet": r"greenhouse gas|\bghg\b|emissions|climate|carbon|environmental protection agency|\bepa\b|pollut|hazardous (?:waste|substances)|renewable|spill|contaminat",
    "people": r"\bsafety\b|injur|\bosha\b|fatalit|collective bargaining|labor unions?|unionized|work stoppage|\bstrikes?\b|discriminat|harass|turnover",
    "legal": r"lawsuit|class action|litigation|consent decree|civil penalt|settlement agreement|agreed to pay|\bfined\b|violations? of|alleg",
}
CONCRETE = r"\$\s?\d|\d[\d,.]*\s?(?:%|percent|metric tons|tons|tonnes|million|billion)|\b(?:19|20)\d\d\b"
ABBREVIATIONS = r"\b[A-Z]|U\.S|No|Inc|Corp|Co|Mr|Ms|Dr|Jr|St|vs"
#: Where a sentence ends: not after an abbreviation's full stop, so a sentence goes on behind one.
SENTENCE_ENDS = rf"(?<=[.!?])(?<!(?:{ABBREVIATIONS})\.)\s+(?=[A-Z(])"
HEDGES = r"\b(?:may|could|might|cannot assure|no assurance|forward-looking|risk factors?)\b"
NOT_THEME = r"tax benefit|derivative|stock awards|shares? (?:were|are) reserved|european union"


def passages(filings: DataFrame, per_theme: int = 2, themes: dict[str, str] = THEMES) -> DataFrame:
    """entity, theme, place, sentence, score: the most concrete sentences of a filing (entity, text) on each theme; of those that begin alike the best."""
    from pyspark.sql import Window

    cut = F.split(F.regexp_replace("text", r"\s+", " "), SENTENCE_ENDS)
    told = filings.select("entity", F.posexplode(cut).alias("at", "sentence")).where(F.length("sentence").between(80, 360) & ~F.lower("sentence").rlike(NOT_THEME))
    low = F.lower("sentence")
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("theme"), F.regexp_count(low, F.lit(p)).alias("n")) for k, p in themes.items()]))
    score = 2 * F.when(low.rlike(CONCRETE), 1).otherwise(0) + F.col("t.n") - 2 * F.regexp_count(low, F.lit(HEDGES))
    good = told.select("*", of.alias("t")).where("t.n > 0").select("entity", "at", "sentence", "t.theme", score.alias("score")).where("score >= 2")
    alike = good.groupBy("entity", "theme", F.substring("sentence", 1, 60).alias("_b")).agg(F.max_by(F.struct("sentence", "score", "at"), F.struct("score", -F.col("at"))).alias("r"))
    best = Window.partitionBy("entity", "theme").orderBy(F.desc("r.score"), "r.at")
    return alike.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_theme).select("entity", "theme", "place", "r.sentence", "r.score")


def quotes(notes: DataFrame) -> DataFrame:
    """ticker, indicator_id, year, quote: the first quote of the newest note (ticker, indicator_id, year, note) of each indicator that has one."""
    newest = notes.groupBy("ticker", "indicator_id").agg(F.max_by("note", "year").alias("note"), F.max("year").alias("year"))
    found = F.regexp_extract("note", r'quote: "+(.{40,400}?)"+(?:\s*\||;|$)', 1)
    return newest.where(found != "").select("ticker", "indicator_id", "year", text.whole_quote(found).alias("quote"))


def audit(universe: DataFrame, ticker: str, filings: DataFrame, notes: DataFrame, cases: DataFrame, emissions: DataFrame) -> dict[str, DataFrame]:
    """A company's own words and its regulators' record: passages, quotes, cases (newest and dearest first), its latest emissions above 0.

    filings: entity (cik), text; cases: cik, case, year, penalty; emissions: ticker, year, tonnes.
    """
    company = universe.where(F.col("ticker") == ticker)
    if company.isEmpty():
        raise KeyError(ticker)
    cik = company.select("cik")
    own = filings.join(F.broadcast(cik.withColumnRenamed("cik", "entity")), "entity", "left_semi")
    record = cases.join(F.broadcast(cik), "cik", "left_semi").orderBy(F.desc("year"), F.desc("penalty"))
    air = emissions.where((F.col("ticker") == ticker) & (F.col("tonnes") > 0)).agg(F.max("year").alias("year"), F.max_by("tonnes", "year").alias("tonnes")).where("year is not null")
    return {"company": company, "passages": passages(own), "quotes": quotes(notes.where(F.col("ticker") == ticker)), "cases": record, "emissions": air}


def evidence(check: str, universe: DataFrame, facts: DataFrame, catalog: DataFrame, profile: Profile, **more) -> DataFrame:
    """A check's answer for the weights asked for: caught_later (outcome: ticker, upto: last year known) or weight_robustness (runs)."""
    first = scoring.primaries(universe).select(F.col("primary").alias("ticker"))
    if check == "caught_later":
        table = scoring.score_profile(universe, facts.where(F.col("year") <= more["upto"]), catalog, profile).join(first, "ticker", "left_semi")
        return checks.outcome_by_quintile(table.select("ticker", "sector", F.col("total_score").alias("score")), more["outcome"])
    if check == "weight_robustness":
        runs = more.get("runs", 1000)
        ranks = written(scoring.profile_ranks(universe, facts, scoring.indicator_weights(catalog, profile), profile), "ranks")
        default = scoring.score_ranks(universe, ranks, profile).join(first, "ticker", "left_semi")
        return checks.drawn_verdict(ranks.where("ticker = primary"), scoring.drawn_weightings(catalog, profile, runs), default, profile.min_weight_share)
    raise KeyError(f"no evidence check {check!r}")


def stored_checks(spark: SparkSession, folder: str, ids: list[str]) -> DataFrame:
    """id, status, ran_at of each check: as last kept below folder, or not_run."""
    from pyspark.errors import AnalysisException

    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, place int")
    try:
        kept = spark.read.schema("id string, status string, ran_at string").json(f"{folder}/*")
    except AnalysisException:  # none kept yet
        kept = spark.createDataFrame([], "id string, status string, ran_at string")
    return wanted.join(kept, "id", "left").select("id", F.coalesce("status", F.lit("not_run")).alias("status"), "ran_at", "place").orderBy("place").drop("place")


def as_records(df: DataFrame) -> list[str]:
    """An answer's rows as JSON texts, for a page of a dashboard (a few hundred rows)."""
    return [r["record"] for r in arrays.records(df).collect()]


def netzero(fund: DataFrame, exposure: DataFrame, prices: list[float]) -> DataFrame:
    """fund ('fund' or 'index'), price, risk, covered, heavy_share: the share of profits that a carbon price takes, of an allocated fund and its benchmark.

    exposure: ticker, tonnes, pretax. Prices are those of the request; what a company without figures weighs is not covered.
    """
    from cinderflow.operators import market

    long = fund.unpivot("ticker", ["weight", "benchmark_weight"], "_k", "weight_")
    sides = long.select(F.when(F.col("_k") == "weight", "fund").otherwise("index").alias("fund"), "ticker", F.col("weight_").alias("weight"))
    return market.stress(exposure, sides, prices)
