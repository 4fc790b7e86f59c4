"""Entity linking: rule cascades, parties of cases, verification by shared tokens, block lists.

All are equi-joins on a name's rarest word, a squeezed name or an id; rules then pick among the candidates.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderflow.functions import text as T
from cinderflow.operators.entities import normalised, unambiguous, usable
from cinderflow.operators.joins import by_rarest_word
from cinderflow.storage import small

#: Legal words and trailing filler left out of committees' names, and words that label a committee.
LEGAL_WORDS = "inc incorporated corp corporation co company companies ltd limited plc lp llc llp nv sa ag se spa ab oyj the and of na cos".split()
TRAILING_FILLER = "holdings holding class common stock new".split()
PAC_WORDS = "pac pacs political action committee cmte fund federal employees employee employer good government civic citizenship voice better citizens involvement participation responsibility active stakeholders associates people concerned effective responsible non partisan nonpartisan inc corp company co the and for of employees' usa us national".split()
#: Rules of committee_links() in order.
RULES = ["affiliated_exact", "affiliated_prefix", "affiliated_prefix_1tok", "name_prefix_pac", "name_contains_pac"]


def committee_tokens(x):
    """Words of a company's or committee's name without legal words, state tags and trailing filler (one word stays)."""
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*/\s*[A-Za-z]{2}\s*/?\s*(?=$|,)", " ")
    plain = F.replace(F.replace(F.lower(plain), F.lit("&"), F.lit(" and ")), F.lit("'s"), F.lit("s"))
    words = F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9 ]+", " "), " "), lambda w: (w != "") & ~w.isin(LEGAL_WORDS))
    return F.filter(F.split(F.regexp_replace(F.array_join(words, " "), rf"( ({'|'.join(TRAILING_FILLER)}))+$", ""), " "), lambda w: w != "")


def committee_links(names: DataFrame, committees: DataFrame, cycles: list[int], rejected: DataFrame) -> DataFrame:
    """ticker, committee, rule, matched, kind, cycles: corporate committees of the given cycles linked to companies by the first rule that fits.

    names: ticker, place, name, kind (of several names the first by place links); committees: committee, name, affiliation, org_type, cycles;
    rejected: ticker, committee, links known to be wrong.
    """
    shared = F.array_intersect("cycles", F.array(*map(F.lit, cycles)))
    active = committees.where((F.col("org_type") == "C") & (F.size(shared) > 0)).select(
        "committee", committee_tokens(F.col("name")).alias("own"), committee_tokens(F.col("affiliation")).alias("affil"), F.array_join(F.array_sort(shared), "|").alias("cycles")
    )
    asked = names.withColumn("core", committee_tokens(F.col("name"))).where(F.size("core") > 0).select("ticker", "place", F.col("name").alias("matched"), "kind", "core")
    # A pair can only fit if all of the core's words stand in the committee's name or affiliation, or both are one word when squeezed.
    sized = lambda c: F.array_join(c, "")
    worded = by_rarest_word(asked.withColumn("_words", F.col("core")), active.withColumn("_words", F.array_union("own", "affil")))
    same = asked.join(active, (sized(F.col("core")) == sized(F.col("affil"))) & (F.size("affil") > 0))
    pairs = worded.unionByName(same).distinct()
    n = F.size("core")
    begins = lambda c: F.slice(c, F.lit(1), n) == F.col("core")
    tail = F.when(F.size("own") > n, F.slice("own", n + 1, F.size("own") - n)).otherwise(F.array().cast("array<string>"))
    exact = (F.size("affil") > 0) & ((F.col("affil") == F.col("core")) | (F.array_join("affil", "") == F.array_join("core", "")))
    inside = T.contains_words(F.array_join("own", " "), F.array_join("core", " ")) & F.arrays_overlap("own", F.array(F.lit("pac"), F.lit("political")))
    rule = F.when(exact, RULES[0]).when(begins(F.col("affil")), F.when(n >= 2, RULES[1]).otherwise(RULES[2]))
    rule = rule.when(begins(F.col("own")) & (F.size(tail) > 0) & F.forall(tail, lambda w: w.isin(PAC_WORDS)), RULES[3]).when(inside, RULES[4])
    told = pairs.withColumn("rule", rule).where("rule is not null")
    # A single word in a committee's own name proves little: none of under five letters, and without an affiliation it is weak.
    loose = (n == 1) & F.col("rule").isin(RULES[3], RULES[4])
    told = told.where(~loose | (F.length(F.get("core", F.lit(0))) >= 5)).withColumn("rule", F.when(loose & (F.size("affil") == 0), F.concat("rule", F.lit("_weak"))).otherwise(F.col("rule")))
    best = told.groupBy("ticker", "committee").agg(F.min_by(F.struct("rule", "matched", "kind", "cycles"), F.struct("place", "matched")).alias("b"))
    return best.join(rejected, ["ticker", "committee"], "left_anti").select("ticker", "committee", "b.*")


def cascade(records: DataFrame, manual: DataFrame, isins: DataFrame, names: DataFrame, universe: DataFrame, foreign: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, ticker, match (manual, isin or name) of records (id, isin, name, location).

    A reviewed match comes first; then an ISIN that leads to exactly one ticker of the universe (several: no match at all);
    then a usable name of one ticker, for records of the home country and those in `foreign`. excluded: id, ticker known to be wrong.
    """
    by_isin = isins.join(universe.select("ticker"), "ticker", "left_semi").groupBy("isin").agg(F.countDistinct("ticker").alias("_n"), F.min("ticker").alias("_isin"))
    norm = names.select(normalised(F.col("name")).alias("_norm"), F.col("ticker").alias("_name")).where(usable(F.col("_norm")))
    met = records.withColumn("_norm", normalised(F.col("name"))).join(manual.select("id", F.col("ticker").alias("_manual")), "id", "left")
    met = met.join(by_isin, "isin", "left").join(unambiguous(norm, "_norm", "_name"), "_norm", "left").join(foreign.select("id", F.lit(True).alias("_foreign")), "id", "left")
    home = F.coalesce(F.col("location").startswith("United States"), F.lit(False)) | F.col("_foreign").isNotNull()
    pick = F.when(F.col("_manual").isNotNull(), F.struct(F.col("_manual").alias("ticker"), F.lit("manual").alias("match")))
    pick = pick.when(F.col("_n") == 1, F.struct(F.col("_isin").alias("ticker"), F.lit("isin").alias("match"))).when(F.col("_n") > 1, F.lit(None))
    pick = pick.when(home & F.col("_name").isNotNull(), F.struct(F.col("_name").alias("ticker"), F.lit("name").alias("match")))
    found = met.select("id", pick.alias("_p")).where("_p is not null").select("id", "_p.ticker", "_p.match")
    return found.join(excluded, ["id", "ticker"], "left_anti")


#: Words of benefit plans, that may follow even a short name.
PLAN_WORDS = "plan plans pension retirement savings benefit benefits welfare disability committee board trust administrative leave center program programs fund health employee employees care".split()


def party_matches(cases: DataFrame, cores: DataFrame) -> DataFrame:
    """case, entity of cases (case, parties) with a party that is the entity: equal to one of its cores (entity, core), or the core and more
    words; after a short core suffixes and words of benefit plans only."""
    party = cases.select("case", F.explode("parties").alias("_p")).select("case", T.party_core(F.col("_p")).alias("_p"))
    met = by_rarest_word(cores.withColumn("_words", F.split("core", " ")), party.withColumn("_words", F.split("_p", " ")))
    rest = F.split(F.substr("_p", F.length("core") + 2), " ")
    follows = F.startswith(F.col("_p"), F.concat("core", F.lit(" ")))
    same = (F.col("_p") == F.col("core")) | (follows & (~T.is_short(F.col("core")) | F.forall(rest, lambda w: w.isin([*T.PARTY_SUFFIXES, *PLAN_WORDS]))))
    return met.where(same).select("case", "entity").distinct()


#: Words that show that a party is a company.
CORPORATE = "inc incorporated corp corporation co cos company companies llc lp llp ltd limited plc nv sa ag holdings holding group trust plan plans pension benefit benefits systems technologies international industries enterprises partners bank".split()


def case_name_matches(cases: DataFrame, cores: DataFrame) -> DataFrame:
    """case, entity of case names (case, title: 'A v. B'): a core (entity, core) that ends a side, or that stands in it and is not short; a core of
    one word counts only where the side's own words show a company."""
    sides = cases.select("case", F.explode(F.split("title", r"(?i)\s+v(?:s?\.?|ersus)\s+")).alias("_side"))
    told = sides.select("case", F.split(T.party_core(F.col("_side")), " ").alias("_ws"), F.arrays_overlap(F.regexp_extract_all(F.lower("_side"), F.lit("[a-z]+"), 0), F.array(*map(F.lit, CORPORATE))).alias("_co"))
    met = by_rarest_word(cores.withColumn("_words", F.split("core", " ")), told.withColumnRenamed("_ws", "_words").withColumn("_side", F.array_join("_words", " ")))
    side = F.concat(F.lit(" "), F.col("_side"), F.lit(" "))
    same = F.endswith(F.col("_side"), F.concat(F.lit(" "), "core")) | (F.col("_side") == F.col("core")) | (side.contains(F.concat(F.lit(" "), "core", F.lit(" "))) & ~T.is_short(F.col("core")))
    return met.where(same & (F.col("core").contains(" ") | F.col("_co"))).select("case", "entity").distinct()


#: Words too common to prove that two names are one.
FILLER = "THE AND OF CORP CORPORATION INC INCORPORATED CO COMPANY GROUP HOLDINGS HOLDING LLC LTD LIMITED PLC NATIONAL AMERICAN GENERAL UNITED INTERNATIONAL GLOBAL INDUSTRIES SYSTEMS SERVICES TECHNOLOGIES TECHNOLOGY SOLUTIONS ENTERPRISES".split()


def distinctive_tokens(x):
    return F.filter(F.array_distinct(F.regexp_extract_all(F.upper(x), F.lit("[A-Z0-9]+"), 0)), lambda w: (F.length(w) >= 2) & ~w.isin(FILLER))


def verified_names(searches: DataFrame, suggestions: DataFrame) -> DataFrame:
    """entity, verified, matched: the first suggestion (entity, place, suggestion) that shares a distinctive word with the name searched for (entity, name)."""
    met = searches.join(suggestions, "entity", "left")
    shares = F.coalesce(F.arrays_overlap(distinctive_tokens(F.col("name")), distinctive_tokens(F.col("suggestion"))), F.lit(False))
    by = met.groupBy("entity").agg(F.min_by(F.when(shares, F.col("suggestion")), F.when(shares, F.col("place"))).alias("matched"))
    return by.select("entity", F.col("matched").isNotNull().alias("verified"), F.coalesce("matched", F.lit("")).alias("matched"))


def unblocked(links: DataFrame, rules: DataFrame) -> DataFrame:
    """links (entity, name, year, ..) without those that a reviewed rule (entity, prefix, since) blocks: a name that begins so, from that year on."""
    l, r = links.alias("l"), small(rules).alias("r")
    hit = (F.col("l.entity") == F.col("r.entity")) & F.upper("l.name").startswith(F.col("r.prefix")) & (F.col("l.year") >= F.coalesce("r.since", F.lit(0)))
    return l.join(r, hit, "left_anti")


def valid_aliases(names: DataFrame, least_end: str) -> DataFrame:
    """names (entity, name, kind, valid_to) that still serve: current ones, and former ones that were valid at least until least_end and
    differ from every current name of the entity in their loose form."""
    told = names.withColumn("_n", T.alias_name(F.col("name")))
    current = told.where("kind = 'current'").select("entity", "_n").distinct()
    former = told.where((F.col("kind") == "former") & (F.coalesce("valid_to", F.lit("")) >= least_end)).join(current, ["entity", "_n"], "left_anti")
    return told.where("kind = 'current'").unionByName(former.select(*told.columns)).drop("_n")


def _years(low, high):
    """The years from low to high as keys: periods that overlap share one."""
    return F.sequence(F.year(low), F.year(high))


def names_at(asked: DataFrame, aliases: DataFrame, latest: str) -> DataFrame:
    """asked (id, name, at) with the entity that bore the name on that day, where it was one only.

    aliases: entity, name, valid_from, valid_to (the first day it no longer held; NULL: it still does). An interval join: an alias is a row for each year
    it holds in, up to that of `latest`, so name and year are keys of an equi-join, and the days are then compared. Names are compared in their loose form.
    """
    end = F.coalesce(F.col("valid_to"), F.date_add(F.to_date(F.lit(latest)), 1))
    held = aliases.where(F.col("valid_from") < end).select("entity", T.alias_name(F.col("name")).alias("_n"), "valid_from", end.alias("_end"), F.explode(_years(F.col("valid_from"), F.date_sub(end, 1))).alias("_year"))
    told = asked.select("id", "name", "at", T.alias_name(F.col("name")).alias("_n"), F.year("at").alias("_year"))
    met = told.join(held, ["_n", "_year"]).where((F.col("at") >= F.col("valid_from")) & (F.col("at") < F.col("_end")))
    return met.groupBy("id", "name", "at").agg(F.countDistinct("entity").alias("_k"), F.min("entity").alias("entity")).where("_k = 1").drop("_k")


def search_cores(names: DataFrame, most: int) -> DataFrame:
    """entity, cores: distinct cores of the entity's names (entity, place, name) of two letters or more, in the order of place, at most so many."""
    by = names.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", T.party_core(F.col("name")).alias("c")))).alias("_l"))
    cores = F.array_distinct(F.filter(F.transform("_l", lambda x: x["c"]), lambda c: F.length(c) >= 2))
    return by.select("entity", F.slice(cores, 1, most).alias("cores")).where(F.size("cores") > 0)
