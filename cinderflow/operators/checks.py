"""Validation rules and data-quality checks as DataFrames of findings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.functions.numbers import ratio
from cinderflow.operators import aggregates as A
from cinderflow.operators import scoring
from cinderflow.operators import timeseries as T
from cinderflow.operators.ranking import average_rank, bucket, percentile_rank
from cinderflow.storage import small, written

ID_PATTERN, DATE_PATTERN = r"^[a-z][a-z0-9_]*$", r"^\d{4}-\d{2}-\d{2}$"


def _blank(c):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def indicator_findings(frame: DataFrame) -> DataFrame:
    """rule, n_bad of an all-text indicator frame (ticker, year, value, source, source_url, retrieved)."""
    year, value = F.expr("try_cast(year AS double)"), F.expr("try_cast(value AS double)")
    twice = F.count(F.lit(1)).over(Window.partitionBy("ticker", "year")) > 1
    rules = {
        "ticker": _blank("ticker") | (F.col("ticker") != F.upper("ticker")), "year": year.isNull() | (year != F.floor(year)) | ~year.between(1990, 2100),
        "value": value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "source": _blank("source"), "source_url": _blank("source_url"),
        "retrieved": ~F.coalesce(F.col("retrieved").rlike(DATE_PATTERN) & F.try_to_timestamp("retrieved", F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False)), "duplicate": F.col("_twice"),
    }
    told = frame.withColumn("_twice", twice).agg(*[F.count_if(x).alias(k) for k, x in rules.items()])
    return told.unpivot([], list(rules), "rule", "n_bad")


def catalog_findings(catalog: DataFrame) -> DataFrame:
    """rule, n_bad of an all-text catalog (indicator_id, higher_is_better, weight, status, name, unit)."""
    weight = F.expr("try_cast(weight AS double)")
    rules = {
        "indicator_id": ~F.coalesce(F.col("indicator_id").rlike(ID_PATTERN), F.lit(False)), "higher_is_better": ~F.coalesce(F.lower("higher_is_better").isin("true", "false"), F.lit(False)),
        "weight": ~F.coalesce(weight > 0, F.lit(False)), "status": ~F.coalesce(F.col("status").isin("ready", "planned", "dropped"), F.lit(False)),
        "ready_needs_text": (F.col("status") == "ready") & (_blank("name") | _blank("unit")), "duplicate": F.col("_n") > 1,
    }
    told = catalog.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("indicator_id"))).agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in rules.items()])
    return told.unpivot([], list(rules), "rule", "n_bad")


def plausibility(facts: DataFrame, this_year: int, least: int = 20) -> DataFrame:
    """kind, indicator_id, ticker, year, value of future years, unusual changes and unusual latest values."""
    future = facts.where(F.col("year") > this_year + 1).select(F.lit("future").alias("kind"), "indicator_id", "ticker", "year", "value")
    moves = T.consecutive_delta(facts, ["indicator_id", "ticker"])
    # A row an indicator: the last year comes from an aggregate, not from a window over all facts of it.
    last = facts.groupBy("indicator_id").agg(F.max("year").alias("_m"))
    newest = facts.join(F.broadcast(last), "indicator_id").where("year = _m").withColumn("delta", F.col("value"))
    out = [future]
    for kind, df in (("change", written(moves.drop("before"), "moves")), ("level", newest)):
        fence = A.fences(df, ["indicator_id"], "delta").where(F.col("n") >= least)
        far = df.join(F.broadcast(fence), "indicator_id").where("delta < low or delta > high")
        out.append(far.select(F.lit(kind).alias("kind"), "indicator_id", "ticker", "year", "value"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def stability(facts: DataFrame, least: int = 100) -> DataFrame:
    """indicator_id, year, n, rho: rank correlation with the year before."""
    met = T.lagged(facts.groupBy("indicator_id", "ticker", "year").agg(F.avg("value").alias("value")), ["indicator_id", "ticker"], 1)
    return A.spearman(met, ["indicator_id", "year"], "value", "then").where(F.col("n") >= least)


def tie_ratios(newest: DataFrame, least: int = 20) -> DataFrame:
    """indicator_id, n, tie_ratio: the share of values that repeat another."""
    by = newest.groupBy("indicator_id").agg(F.count("value").alias("n"), F.countDistinct("value").alias("_d")).where(F.col("n") >= least)
    return by.select("indicator_id", "n", (1 - F.col("_d") / F.col("n")).alias("tie_ratio"))


def traceability(rows: DataFrame) -> DataFrame:
    """indicator_id, companies, rows, with_source, generic (one address for more than five companies)."""
    has = F.trim(F.coalesce("source_url", F.lit(""))) != ""
    by = rows.groupBy("indicator_id").agg(F.countDistinct("ticker").alias("companies"), F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("with_source"), F.countDistinct("source_url").alias("_u"))
    return by.withColumn("generic", (F.col("_u") == 1) & (F.col("companies") > 5)).drop("_u")


def outcome_by_quintile(scores: DataFrame, outcome: DataFrame) -> DataFrame:
    """bucket (1 = worst), companies, hits, share: how often each sector-relative fifth of scores met the outcome (ticker)."""
    hit = outcome.select("ticker").distinct().withColumn("_hit", F.lit(1.0))
    t = scores.where("score is not null").withColumn("_p", percentile_rank(F.col("score"), ["sector"])).join(hit, "ticker", "left")
    by = t.groupBy(bucket(F.col("_p"), 5).alias("bucket")).agg(F.count(F.lit(1)).alias("companies"), F.sum(F.coalesce("_hit", F.lit(0.0))).alias("hits"))
    return by.withColumn("share", ratio(F.col("hits"), F.col("companies")))


def weight_robustness(totals: DataFrame, default: DataFrame, top: float = 0.2) -> DataFrame:
    """run, rho, top_kept, n: rank correlation of each run's totals (run, ticker, total_score) with the default's, and how much of its top fifth stays."""
    met = totals.join(small(written(default.select("ticker", F.col("total_score").alias("base")), "default-totals")), "ticker")
    # Rounded totals take at most 1,001 values: pairs of them are few, and all ranks come from their counts.
    pairs = written(A.paired_ranks(met, ["run"], "total_score", "base"), "run-pairs")
    a, b = 1 - F.col("rx") / F.col("n") < top, 1 - F.col("ry") / F.col("n") < top
    held = lambda x: F.coalesce(F.sum(F.when(x, F.col("count"))), F.lit(0))
    kept = pairs.groupBy("run").agg(ratio(held(a & b), held(b)).alias("top_kept"))
    return A.rank_correlation(pairs, ["run"]).join(kept, "run")


def _base_ranks(default: DataFrame) -> DataFrame:
    """ticker, base, base_rank: the scored of default (ticker, total_score) and their average ranks, which come from counts by total."""
    scored = default.where("total_score is not null").select("ticker", F.col("total_score").alias("base"))
    values = scored.groupBy("base").agg(F.count(F.lit(1)).alias("_c"))
    lower = F.coalesce(F.sum("_c").over(Window.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.join(F.broadcast(values.select("base", (lower + (F.col("_c") + 1) / 2).alias("base_rank"))), "base")


def _run_places(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """run, _k, rank, n of counts (run, _k, _c, _b, _bb: RunTotals.counts()); and by run rho, the correlation of rank and base_rank.

    Rounded totals take at most 1,001 values, so all ranks come from counts by total. Rows of one total share a rank, so rho comes from the same counts.
    """
    run = Window.partitionBy("run")
    below = F.coalesce(F.sum("_c").over(run.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"rank": below + (F.col("_c") + 1) / 2, "n": F.sum("_c").over(run), "_mean": F.sum("_b").over(run) / F.sum("_c").over(run)})
    places = written(placed, "run-ranks")
    c, b, mean, d = F.col("_c"), F.col("_b"), F.col("_mean"), F.col("rank") - (F.col("n") + 1) / 2
    spread = F.sum(c * d * d) * F.sum(F.col("_bb") - 2 * mean * b + c * mean * mean)
    rho = places.groupBy("run").agg(ratio(F.sum(d * (b - c * mean)), F.sqrt(spread)).alias("rho"))
    return places.select("run", "_k", "rank", "n"), rho


def _pct():
    return (F.col("n") + 1 - F.col("rank")) / F.col("n")


def _ranked_runs(totals: DataFrame, default: DataFrame) -> tuple[DataFrame, DataFrame]:
    """run, ticker, rank and n of totals that exist as rows; and by run rho, their correlation with the default's."""
    base = small(written(_base_ranks(default), "default-ranks"))
    met = totals.where("total_score is not null").join(base, "ticker").withColumn("_k", F.rint(F.col("total_score") * 10).cast("int"))
    counts = met.groupBy("run", "_k").agg(F.count(F.lit(1)).alias("_c"), F.sum("base_rank").alias("_b"), F.sum(F.col("base_rank") * F.col("base_rank")).alias("_bb"))
    places, rho = _run_places(counts)
    return met.join(F.broadcast(places), ["run", "_k"]).drop("_k"), rho


def _share(c: str, runs: int):
    return F.coalesce(F.col(c), F.lit(0)) / F.lit(runs)


def _top_and_bottom(ranked: DataFrame, default: DataFrame, runs: int, top: float) -> DataFrame:
    by = ranked.withColumn("pct", _pct()).groupBy("ticker").agg(F.count_if(F.col("pct") <= top).alias("_t"), F.count_if(F.col("pct") > 1 - top).alias("_b"))
    return default.where("total_score is not null").join(by, "ticker", "left").select("ticker", F.col("total_score").alias("default_score"), _share("_t", runs).alias("top_share"), _share("_b", runs).alias("bottom_share"))


def _drawn(ranks: DataFrame, runs: DataFrame, default: DataFrame, min_share: float, top: float) -> tuple[DataFrame, DataFrame, int]:
    """What _top_and_bottom() and _ranked_runs() give for the totals of many_totals(), and the number of runs, without a row a company and run.

    Ranks within a run rise with the total, so its top and bottom are two totals: these go to the tasks, and a company's shares come from its own row.
    """
    made = scoring.RunTotals(ranks, runs, min_share, _base_ranks(default))
    places, rho = _run_places(made.counts())
    ends = places.groupBy("run").agg(F.min(F.when(_pct() <= top, F.col("_k"))).alias("high"), F.max(F.when(_pct() > 1 - top, F.col("_k"))).alias("low"))
    hits = made.hits({r["run"]: (r["high"], r["low"]) for r in ends.collect()}, ["ticker", "base"])  # a row a run
    n = len(made.number)
    return hits.select("ticker", F.col("base").alias("default_score"), _share("_t", n).alias("top_share"), _share("_b", n).alias("bottom_share")), rho, n


def weight_frequencies(totals: DataFrame, default: DataFrame, runs: int, top: float = 0.2) -> DataFrame:
    """ticker, default_score, top_share, bottom_share: the shares of all runs in which a company is in the top and bottom fifth."""
    return _top_and_bottom(_ranked_runs(totals, default)[0], default, runs, top)


def drawn_frequencies(ranks: DataFrame, runs: DataFrame, default: DataFrame, min_share: float, top: float = 0.2) -> DataFrame:
    """weight_frequencies() of all weightings of runs, as many_totals() takes them with ranks."""
    return _drawn(ranks, runs, default, min_share, top)[0]


def _verdict(shares: DataFrame, by_run: DataFrame, runs: int) -> DataFrame:
    rho = by_run.agg(F.percentile("rho", 0.5).alias("median_rho"), F.percentile("rho", 0.05).alias("rho_p5"))
    shares = written(shares, "top-shares")
    best = shares.orderBy(F.desc("default_score"), "ticker").limit(50).agg(F.avg((F.col("top_share") >= 0.8).cast("double")).alias("top50_stay_share"))
    counts = shares.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("top_share") >= 0.9).alias("always_top"), F.count_if(F.col("bottom_share") >= 0.9).alias("always_bottom"))
    status = F.when(F.col("median_rho") >= 0.7, "passed").otherwise("flagged")
    return rho.crossJoin(best).crossJoin(counts).select(F.lit(runs).alias("runs"), "companies", "median_rho", "rho_p5", "top50_stay_share", "always_top", "always_bottom", status.alias("status"))


def weight_verdict(totals: DataFrame, default: DataFrame, runs: int, top: float = 0.2) -> DataFrame:
    """One row: companies, median_rho and rho_p5 of the runs' rank correlations with the default, top50_stay_share (of the
    default's first 50, those in the top fifth of 80 % of runs), always_top and always_bottom (90 %), status."""
    ranked, by_run = _ranked_runs(totals, default)
    return _verdict(_top_and_bottom(ranked, default, runs, top), by_run, runs)


def drawn_verdict(ranks: DataFrame, runs: DataFrame, default: DataFrame, min_share: float, top: float = 0.2) -> DataFrame:
    """weight_verdict() of all weightings of runs, as many_totals() takes them with ranks."""
    return _verdict(*_drawn(ranks, runs, default, min_share, top))


def repository_findings(catalog: DataFrame, files: DataFrame, least_ready: int = 3) -> DataFrame:
    """rule, category, indicator_id of all catalogs (category, indicator_id, status) and indicator files (category, indicator_id): an id of two
    categories, a ready one without a file, a file that is not listed, and categories (id NULL) with too few ready ones."""
    key = ["category", "indicator_id"]
    found = lambda df, rule: df.select(F.lit(rule).alias("rule"), *key)
    twice = catalog.groupBy("indicator_id").agg(F.countDistinct("category").alias("_n")).where("_n > 1")
    few = catalog.groupBy("category").agg(F.count_if(F.col("status") == "ready").alias("_n")).where(F.col("_n") < least_ready).select("category", F.lit(None).cast("string").alias("indicator_id"))
    out = found(catalog.join(twice, "indicator_id", "left_semi").distinct(), "clash")
    out = out.unionByName(found(catalog.where("status = 'ready'").join(files, key, "left_anti"), "no_file"))
    return out.unionByName(found(files.join(catalog, key, "left_anti"), "not_listed")).unionByName(found(few, "few_ready"))


def note_against_fact(notes: DataFrame, facts: DataFrame, pattern: str, tolerance: float = 0.01, least: float = 0.7) -> DataFrame:
    """n, agree, passed: numbers that pattern finds in notes (ticker, year, note) against an independent value (ticker, year, value)."""
    said = notes.withColumn("_x", F.regexp_extract("note", pattern, 1).try_cast("double")).where("_x is not null")
    same = F.avg((F.abs(F.col("_x") - F.col("value")) <= tolerance).cast("double"))
    return said.join(facts, ["ticker", "year"]).where("value is not null").agg(F.count(F.lit(1)).alias("n"), same.alias("agree"), (same >= least).alias("passed"))
