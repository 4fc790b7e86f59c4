"""Indicator formulas with their guards: each from long tables of facts to ticker, year, value (a gap is no row)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.functions.numbers import ratio

STATUTORY_RATE = 0.21


def tax_rate_gap(tax: DataFrame, pretax: DataFrame) -> DataFrame:
    """Statutory less effective rate. tax, pretax: ticker, year, period_end, value; only facts of one period meet, with income above 0."""
    met = tax.alias("t").join(pretax.alias("p"), ["ticker", "year", "period_end"]).where("p.value > 0")
    return met.select("ticker", "year", F.round(STATUTORY_RATE - F.col("t.value") / F.col("p.value"), 4).alias("value"))


#: Least quarters of a year; the ratio above which a name must be verified; letters of a name that is too short for a ratio above 1.
LEAST_QUARTERS, UNVERIFIED_RATIO, SHORT_NAME = 2, 0.3, 3


def contract_exposure(panel: DataFrame, checks: DataFrame) -> DataFrame:
    """ticker, year, value, quarters. panel: ticker, year, quarter, revenue, obligations; checks: ticker, verified, search_name.

    A ratio that a collision of names could explain is dropped: above UNVERIFIED_RATIO without a verified name, above 1 with a short one.
    """
    by = panel.where("revenue is not null").groupBy("ticker", "year").agg(F.sum("obligations").alias("_o"), F.sum("revenue").alias("_r"), F.countDistinct("quarter").alias("quarters"))
    told = by.where((F.col("quarters") >= LEAST_QUARTERS) & (F.col("_r") > 0)).join(checks, "ticker", "left").withColumn("_x", F.col("_o") / F.col("_r"))
    letters = F.length(F.regexp_replace("search_name", "[^A-Za-z0-9]", ""))
    doubtful = ((F.col("_x") > UNVERIFIED_RATIO) & ~F.coalesce("verified", F.lit(False))) | ((F.col("_x") > 1) & F.coalesce(letters <= SHORT_NAME, F.lit(False)))
    return told.where(~doubtful).select("ticker", "year", F.round(F.least(F.greatest("_x", F.lit(0.0)), F.lit(1.0)), 4).alias("value"), "quarters")


def emission_intensity(segments: DataFrame, revenue: DataFrame, universe: DataFrame) -> DataFrame:
    """ticker, year, value, facilities: tonnes by owned share over revenue in millions, 0 where a company has revenue but no facility.

    segments: ticker, year, facility_id, tonnes, share; revenue: ticker, year, revenue (by each company's first ticker);
    universe: ticker, cik, ordinal. All share classes get the company's value.
    """
    cik = universe.select("ticker", "cik", "ordinal")
    owned = segments.join(cik.select("ticker", "cik"), "ticker").groupBy("cik", "year", "ticker").agg(F.sum(F.col("tonnes") * F.col("share")).alias("_t"), F.countDistinct("facility_id").alias("_f"))
    # Facilities are found under one of a company's tickers: the first that has any in any year.
    own = owned.select("cik", "ticker").distinct().join(cik.select("ticker", "ordinal"), "ticker").groupBy("cik").agg(F.min_by("ticker", "ordinal").alias("ticker"))
    tonnes = owned.join(own, ["cik", "ticker"], "left_semi").select("cik", "year", "_t", "_f")
    first = cik.groupBy("cik").agg(F.min_by("ticker", "ordinal").alias("ticker"))
    base = revenue.where("revenue > 0").join(first, "ticker").select("cik", "year", "revenue").join(tonnes, ["cik", "year"], "left")
    value = F.round(F.coalesce("_t", F.lit(0.0)) / (F.col("revenue") / 1e6), 3)
    return base.join(cik.select("cik", "ticker"), "cik").select("ticker", "year", value.alias("value"), F.coalesce("_f", F.lit(0)).alias("facilities"))


#: Levels of a near-term target's parts.
TARGET_LEVELS = {"1.5C": 3, "Well-below 2C": 2, "2C": 2}


def target_level(near, classes, net_zero):
    """0 to 4: net-zero target 4, near-term target by its weakest part, commitment 1, else 0; NULL where a part is not known."""
    known = F.create_map(*[F.lit(x) for kv in TARGET_LEVELS.items() for x in kv])
    parts = F.transform(F.split(F.replace(F.coalesce(classes, F.lit("")), F.lit("°"), F.lit("")), "/"), lambda p: known[F.trim(p)])
    weakest = F.when(F.exists(parts, lambda p: p.isNull()), F.lit(None)).otherwise(F.array_min(parts))
    said = lambda what: F.coalesce(near == what, F.lit(False)), lambda what: F.coalesce(net_zero == what, F.lit(False))
    return F.when(said[1]("Targets set"), 4).when(said[0]("Targets set"), weakest).when(said[0]("Committed") | said[1]("Committed"), 1).otherwise(0)


def climate_target(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """ticker, value, rows of a company's rows (ticker, row, near, classes, net_zero): its best row; 0 if it has none, a gap if none of them has a known level."""
    cik = universe.select("ticker", "cik")
    told = rows.join(cik, "ticker").select("cik", target_level(F.col("near"), F.col("classes"), F.col("net_zero")).cast("int").alias("level"))
    best = told.groupBy("cik").agg(F.max("level").alias("level"), F.count("level").alias("rows"))
    met = cik.join(best, "cik", "left").where("rows is null or rows > 0")
    return met.select("ticker", F.coalesce("level", F.lit(0)).alias("value"), F.coalesce("rows", F.lit(0)).alias("rows"))


LEAST_PRODUCERS, CONCENTRATION_WEIGHT = 3, 0.5
WORST_GOVERNED, BEST_GOVERNED = -2.5, 2.5


def production_shares(production: DataFrame) -> DataFrame:
    """material, country, year, share: of each material's newest year, stages of one country together; none with fewer than LEAST_PRODUCERS countries."""
    good = production.where("value > 0")
    newest = good.groupBy("material").agg(F.max("year").alias("year"))
    by = good.join(newest, ["material", "year"]).groupBy("material", "country", "year").agg(F.sum("value").alias("value"))
    whole = by.groupBy("material").agg(F.sum("value").alias("_all"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_PRODUCERS)
    return by.join(whole, "material").select("material", "country", "year", (F.col("value") / F.col("_all")).alias("share"))


def governance_risk(scores: DataFrame, upto: int) -> DataFrame:
    """country, year, risk (0 to 100), carried: means of the governance scores (country, year, dimension, score) that are complete, the
    newest of each country carried forward to the years after the last one."""
    kinds = scores.select("dimension").distinct().agg(F.count(F.lit(1)).alias("_kinds"))
    mean = scores.where("score is not null").groupBy("country", "year").agg(F.avg("score").alias("m"), F.countDistinct("dimension").alias("n"))
    whole = mean.join(F.broadcast(kinds), F.col("n") == F.col("_kinds"))
    risk = whole.select("country", "year", F.least(F.greatest(100 * (BEST_GOVERNED - F.col("m")) / (BEST_GOVERNED - WORST_GOVERNED), F.lit(0.0)), F.lit(100.0)).alias("risk"), F.lit(False).alias("carried"))
    last = risk.agg((F.max("year") + 1).alias("_from")).where(F.col("_from") <= upto)
    newest = risk.groupBy("country").agg(F.max_by("risk", "year").alias("risk"))
    years = F.explode(F.sequence("_from", F.lit(upto)))
    later = newest.join(F.broadcast(last.select(years.alias("year"))), F.lit(True)).select("country", "year", "risk", F.lit(True).alias("carried"))
    return risk.unionByName(later)


def material_risk(shares: DataFrame, governance: DataFrame) -> DataFrame:
    """material, year, value, carried: half concentration (of all producers), half governance by share of the producers that have a score."""
    hhi = shares.groupBy("material").agg((100 * F.sum(F.col("share") * F.col("share"))).alias("_c"))
    met = shares.select("material", "country", "share").join(governance, "country")
    by = met.groupBy("material", "year").agg((F.sum(F.col("share") * F.col("risk")) / F.sum("share")).alias("_g"), F.max("carried").alias("carried"))
    blend = CONCENTRATION_WEIGHT * F.col("_c") + (1 - CONCENTRATION_WEIGHT) * F.col("_g")
    return by.join(hhi, "material").select("material", "year", blend.alias("value"), "carried")


def disclosure(mentions: DataFrame, risk: DataFrame, materials: int) -> DataFrame:
    """ticker, year, value, named: risk of the materials a filing names over what all of them at the worst would give. mentions: ticker, year, material."""
    met = mentions.select("ticker", "year", "material").distinct().join(risk.select("material", "year", F.col("value").alias("risk")), ["material", "year"]).where("risk is not null")
    return met.groupBy("ticker", "year").agg(F.round(F.sum("risk") / (materials * 100), 4).alias("value"), F.array_join(F.array_sort(F.collect_set("material")), ", ").alias("named"))


#: Hours an employee can have worked; hours below which a year says nothing; from which equal totals are copies; share of copies
#: that spoils a year; hours that can't go without a case.
HOURS_EACH, LEAST_HOURS, COPIED_HOURS, COPIED_SHARE, CASELESS_HOURS = (500, 4000), 500_000, 1_000_000, 0.25, 5_000_000


def injury_rate(sites: DataFrame) -> DataFrame:
    """company, year, value, sites: recordable cases per 200,000 hours, after six rules against errors of the data.

    sites: company, year, site, id, created, sector (1 private), zip, employees, hours, away, restricted, other.
    """
    last = Window.partitionBy("site", "year").orderBy(F.desc("created"), F.desc("id"))
    one = sites.withColumn("_nr", F.row_number().over(last)).where("_nr = 1").drop("_nr")  # corrections: the last submission
    each = ratio(F.col("hours"), F.col("employees"))
    one = one.where((F.coalesce("sector", F.lit(1)) == 1) & (F.col("hours") > 0) & each.between(*HOURS_EACH) & F.col("away").isNotNull() & F.col("restricted").isNotNull() & F.col("other").isNotNull() & F.col("company").isNotNull())
    total = ["company", "year", "employees", "hours"]
    one = one.dropDuplicates([*total, "zip", "away", "restricted", "other"])  # one place sent in twice
    copied = (F.count(F.lit(1)).over(Window.partitionBy(*total)) > 1) & (F.col("hours") >= COPIED_HOURS)
    of = Window.partitionBy("company", "year")
    told = one.withColumn("_copied", copied).withColumn("_share", F.sum(F.when(F.col("_copied"), F.col("hours")).otherwise(0.0)).over(of) / F.sum("hours").over(of))
    by = told.where(~F.col("_copied") & (F.col("_share") < COPIED_SHARE)).groupBy("company", "year").agg(
        F.sum(F.col("away") + F.col("restricted") + F.col("other")).alias("_cases"), F.sum("hours").alias("_hours"), F.count(F.lit(1)).alias("sites")
    )
    sound = (F.col("_hours") >= LEAST_HOURS) & ~((F.col("_cases") == 0) & (F.col("_hours") >= CASELESS_HOURS))
    return by.where(sound).select("company", "year", F.round(F.col("_cases") * 200_000 / F.col("_hours"), 3).alias("value"), "sites")


LEAST_PARTICIPANTS = 100


def defined_contribution(codes):
    """Whether a plan's two-character feature codes have one of defined contribution (2x) and none of defined benefit (1x)."""
    pairs = F.regexp_extract_all(F.upper(F.coalesce(codes, F.lit(""))), F.lit("[0-9][A-Z]"), 0)
    return F.exists(pairs, lambda p: p.startswith("2")) & ~F.exists(pairs, lambda p: p.startswith("1"))


def plan_contributions(plans: DataFrame) -> DataFrame:
    """company, year, value, plans, largest: employer contributions over active participants of defined contribution plans.

    plans: company, year, ack, sponsor, number, name, codes, participants, contributions, received; the last filing of a plan and year counts.
    """
    good = plans.where(defined_contribution(F.col("codes")) & F.col("year").isNotNull() & (F.col("participants") > 0) & (F.col("contributions") >= 0))
    rest = [c for c in good.columns if c not in ("sponsor", "number", "year")]
    last = good.groupBy("sponsor", "number", "year").agg(F.max_by(F.struct(*rest), F.struct("received", "ack")).alias("r")).select("year", "r.*").where("company is not null")
    by = last.groupBy("company", "year").agg(F.sum("contributions").alias("_c"), F.sum("participants").alias("_p"), F.count(F.lit(1)).alias("plans"), F.max_by("name", F.struct("participants", "ack")).alias("largest"))
    return by.where(F.col("_p") >= LEAST_PARTICIPANTS).select("company", "year", F.round(F.col("_c") / F.col("_p"), 2).alias("value"), "plans", "largest")


MOST_PAYOUT = 10


def payout_ratio(facts: DataFrame, contradictions: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """ticker, year, value: buybacks and dividends over operating cash flow of the same period.

    facts: ticker, year, tag, period_start, period_end, val; tags: chains for cash, buybacks, dividends, the first of a chain that has a fact wins.
    contradictions: ticker, year, kind, paid in shares or per share although no amount is found. A part that is tagged for another period
    only, or that is contradicted, makes the row a gap; otherwise a missing part is 0.
    """
    period = ["ticker", "year", "period_start", "period_end"]
    of = lambda kind: facts.where(F.col("tag").isin(tags[kind])).withColumn("_p", F.array_position(F.array(*map(F.lit, tags[kind])), F.col("tag")))
    cash = of("cash").groupBy("ticker", "year").agg(F.min_by(F.struct("period_start", "period_end", F.col("val").alias("cash")), F.struct("_p", "period_start", "period_end")).alias("c"))
    out = cash.select("ticker", "year", "c.*").where("cash > 0")
    for kind in ("buybacks", "dividends"):
        hits = of(kind)
        same = hits.groupBy(*period).agg(F.min_by("val", "_p").alias(kind))
        some = hits.select("ticker", "year").distinct().withColumn("_some", F.lit(True))
        denied = contradictions.where(F.col("kind") == kind).select("ticker", "year").distinct().withColumn("_denied", F.lit(True))
        met = out.join(same, period, "left").join(some, ["ticker", "year"], "left").join(denied, ["ticker", "year"], "left")
        out = met.where(F.col(kind).isNotNull() | (F.col("_some").isNull() & F.col("_denied").isNull())).drop("_some", "_denied")
    value = (F.abs(F.coalesce("buybacks", F.lit(0.0))) + F.abs(F.coalesce("dividends", F.lit(0.0)))) / F.col("cash")
    return out.where(value <= MOST_PAYOUT).select("ticker", "year", F.round(value, 4).alias("value"))


#: Transaction types that give money to a candidate or committee.
CONTRIBUTION_TYPES = ["24K", "24Z", "24E", "24C", "24F", "24R"]


def alignment_panel(money: DataFrame, links: DataFrame, coverage: DataFrame, revenue: DataFrame, quarters: DataFrame) -> DataFrame:
    """A row for each company whose money is known and each quarter: ticker, quarter, year, status, given, all, value, skew, in_power.

    money: committee, quarter, kind, party, amount; links: committee, ticker; coverage: ticker, status, gaps (cycles without a known committee,
    joined by |); revenue: ticker, year, revenue; quarters: quarter, year, cycle, power (the party in power). Companies whose status is neither
    downloaded nor no_pac have no rows; a quarter without money is then a real 0.
    """
    owned = money.join(links.select("committee", "ticker").distinct(), "committee").join(F.broadcast(quarters), "quarter")
    gift = F.upper(F.coalesce("kind", F.lit(""))).isin(CONTRIBUTION_TYPES)
    party, amount = F.upper(F.coalesce("party", F.lit(""))), F.col("amount")
    given = lambda cond: F.sum(F.when(gift & cond, amount).otherwise(0.0))
    by = owned.groupBy("ticker", "quarter").agg(given(F.lit(True)).alias("given"), F.sum("amount").alias("all"), given(party == "REP").alias("_r"), given(party == "DEM").alias("_d"), given(party == F.col("power")).alias("_a"))
    known = coverage.where(F.col("status").isin("downloaded", "no_pac")).withColumn("_gaps", F.split(F.coalesce("gaps", F.lit("")), r"\|"))
    grid = known.crossJoin(F.broadcast(quarters)).where(~F.array_contains("_gaps", F.col("cycle").cast("string")))
    full = grid.join(by, ["ticker", "quarter"], "left").na.fill(0.0, ["given", "all", "_r", "_d", "_a"]).join(revenue, ["ticker", "year"], "left")
    value = F.when(F.col("revenue") > 0, F.col("given") / (F.col("revenue") / 1e6))
    return full.select("ticker", "quarter", "year", "status", "given", "all", value.alias("value"), ratio(F.col("_r") - F.col("_d"), F.col("_r") + F.col("_d")).alias("skew"), ratio(F.col("_a"), F.col("given")).alias("in_power"), "revenue")


def alignment(panel: DataFrame) -> DataFrame:
    """ticker, year, value of a panel: what was given in the year per million of revenue."""
    by = panel.groupBy("ticker", "year").agg(F.sum("given").alias("_g"), F.max("revenue").alias("_r")).where("_r > 0")
    return by.select("ticker", "year", (F.col("_g") / (F.col("_r") / 1e6)).alias("value"))


def annual_facts(facts: DataFrame, tags: list[str]) -> DataFrame:
    """ticker, year, value, tag: facts of 340 to 380 days by the year they end in (the first days of January count back), of the first tag
    in the list that has the year; of one tag the period that ends last, as filed last. facts: ticker, tag, form, period_start, period_end, val, filed."""
    from cinderflow.functions.dates import fiscal_year_from_end

    place = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    days = F.datediff("period_end", "period_start")
    good = facts.where((F.col("form") == "10-K") & days.between(340, 380) & (place > 0)).withColumn("year", fiscal_year_from_end(F.col("period_end")))
    best = good.groupBy("ticker", "year").agg(F.max_by(F.struct("val", "tag"), F.struct((-place).alias("p"), "period_end", "filed")).alias("b"))
    return best.select("ticker", "year", F.col("b.val").alias("value"), F.col("b.tag").alias("tag"))


def employees(counts: DataFrame) -> DataFrame:
    """ticker, year, employees: of the filings (ticker, year, accession, employees) that state a number the last accession of each year."""
    return counts.where("employees > 0").groupBy("ticker", "year").agg(F.max_by("employees", "accession").alias("employees"))


def quarterly_revenue(facts: DataFrame) -> DataFrame:
    """ticker, year, quarter, value, derived: the last filed fact of each period of 75 to 100 days, by the quarter it ends in (of two the later), and
    a fourth quarter that is a year's (350 to 380 days) less its three others, where no quarter ends with the year. facts: ticker, period_start, period_end, filed, val."""
    last = facts.groupBy("ticker", "period_start", "period_end").agg(F.max_by("val", "filed").alias("val")).withColumn("days", F.datediff("period_end", "period_start"))
    short = last.where("days between 75 and 100").select("ticker", F.col("period_start").alias("qs"), F.col("period_end").alias("qe"), F.col("val").alias("value"))
    year = last.where("days between 350 and 380")
    inside = year.join(short, "ticker").where("qs >= period_start and qe <= period_end").groupBy("ticker", "period_end", "val").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("qe").alias("last"))
    rest = inside.where("n = 3 and last < period_end").select("ticker", F.col("period_end").alias("qe"), (F.col("val") - F.col("s")).alias("value"), F.lit(True).alias("derived"))
    both = short.select("ticker", "qe", "value", F.lit(False).alias("derived")).unionByName(rest)
    by = both.groupBy("ticker", F.year("qe").alias("year"), F.quarter("qe").alias("quarter")).agg(F.max_by(F.struct("value", "derived"), "qe").alias("b"))
    return by.select("ticker", "year", "quarter", "b.value", "b.derived")
