"""From indicator values to scores: latest values, ranks, weighted means with a coverage rule, positions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderflow.config import CATEGORIES, Profile
from cinderflow.functions.numbers import half_even, ratio
from cinderflow.operators.ranking import average_rank, latest, rank01_of, ranked
from cinderflow.storage import ship_package, written

NO_SECTOR = "(no sector)"


def weighted_mean(part, weight, min_share: float):
    """Aggregates of a weighted mean that skips missing parts: score (x 100), n, share (unrounded)."""
    held = F.when(part.isNotNull(), weight)
    share = ratio(F.coalesce(F.sum(held), F.lit(0.0)), F.sum(weight))
    score = F.when(share >= min_share, ratio(F.sum(part * weight), F.sum(held)) * 100)
    return score.alias("score"), F.count(part).alias("n_indicators"), share.alias("weight_share")


def primaries(universe: DataFrame) -> DataFrame:
    """cik, primary: the ticker that stands first in the universe of each company."""
    return universe.groupBy("cik").agg(F.min_by("ticker", "ordinal").alias("primary"))


def indicator_weights(catalog: DataFrame, profile: Profile) -> DataFrame:
    """catalog with the weights in force: the profile's, else the catalog's; only those above 0."""
    own = F.create_map(*[x for k, v in profile.indicator_weights.items() for x in (F.lit(k), F.lit(float(v)))]) if profile.indicator_weights else None
    weight = F.coalesce(own[F.col("indicator_id")], F.col("weight")) if own is not None else F.col("weight")
    return catalog.withColumn("weight", weight.cast("double")).where("weight > 0")


def unknown_weights(catalog: DataFrame, profile: Profile) -> list[str]:
    """Indicators that the profile weighs and the catalog doesn't have."""
    known = {r[0] for r in catalog.select("indicator_id").collect()}
    return sorted(set(profile.indicator_weights) - known)


def dense_values(universe: DataFrame, facts: DataFrame, catalog: DataFrame, min_year: int) -> DataFrame:
    """A row for every ticker and indicator with its latest value; NULL where there is none from min_year on."""
    newest = latest(facts, ["indicator_id", "ticker"])
    grid = universe.crossJoin(F.broadcast(catalog))
    met = grid.join(newest, ["indicator_id", "ticker"], "left")
    fresh = F.col("year") >= min_year
    return met.withColumn("value", F.when(fresh, F.col("value"))).withColumn("year", F.when(fresh, F.col("year")))


def profile_ranks(universe: DataFrame, facts: DataFrame, catalog: DataFrame, profile: Profile) -> DataFrame:
    """dense_values() with rank01. Share classes are ranked once, by their primary, and share its rank."""
    first = primaries(universe)
    # Read for the pool that is ranked, for its counts by value, and for all rows.
    dense = written(dense_values(universe, facts, catalog, profile.min_year).join(first, "cik"), "dense-values")
    sector = F.when(F.trim(F.coalesce("sector", F.lit(""))) == "", F.lit(NO_SECTOR)).otherwise(F.col("sector"))
    part = ["indicator_id", "_sector"] if profile.sector_relative else ["indicator_id"]
    pool = dense.where((F.col("ticker") == F.col("primary")) & F.col("value").isNotNull()).withColumn("_sector", sector)
    places = ranked(pool, "value", part)
    held = pool.join(places, [*part, "value"]).select("indicator_id", F.col("ticker").alias("primary"), rank01_of(F.col("place"), F.col("n"), F.col("higher_is_better")).alias("rank01"))
    return dense.join(held, ["indicator_id", "primary"], "left")


def category_scores(ranks: DataFrame, min_share: float, keys=("ticker",)) -> DataFrame:
    """keys, category, score (unrounded), n_indicators, weight_share (unrounded)."""
    return ranks.groupBy(*keys, "category").agg(*weighted_mean(F.col("rank01"), F.col("weight"), min_share))


def totals(by_category: DataFrame, category_weights: dict, min_share: float, keys=("ticker",)) -> DataFrame:
    """keys, score (unrounded), n_indicators, weight_share of the categories with a weight, as rows of by_category have them."""
    weights = {c: w for c, w in category_weights.items() if w > 0}
    weight = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])[F.col("category")]
    held = by_category.withColumn("w", weight).where("w is not null")
    return held.groupBy(*keys).agg(*weighted_mean(F.col("score") / 100, F.col("w"), min_share))


def score_profile(universe: DataFrame, facts: DataFrame, catalog: DataFrame, profile: Profile) -> DataFrame:
    """ticker, name, sector, position, total_score, total_weight_share, then score, n and share of each category."""
    return score_ranks(universe, profile_ranks(universe, facts, indicator_weights(catalog, profile), profile), profile)


def score_ranks(universe: DataFrame, ranks: DataFrame, profile: Profile) -> DataFrame:
    """score_profile() of ranks that are made already."""
    by_category = written(category_scores(ranks, profile.min_weight_share), "category-scores")
    total = totals(by_category, profile.category_weights, profile.min_weight_share)
    wide = by_category.groupBy("ticker").agg(
        *[
            F.max(F.when(F.col("category") == c, x)).alias(f"{c}_{n}")
            for c in CATEGORIES
            for n, x in (("score", half_even(F.col("score"), 1)), ("n_indicators", F.col("n_indicators")), ("weight_share", half_even(F.col("weight_share"), 2)))
        ]
    )
    scored = universe.select("ticker", "name", "sector").join(wide, "ticker", "left").join(
        total.select("ticker", half_even(F.col("score"), 1).alias("total_score"), half_even(F.col("weight_share"), 2).alias("total_weight_share")), "ticker", "left"
    )
    return with_position(scored)


def with_position(scored: DataFrame) -> DataFrame:
    """Adds position: 1 + the number of rows with a higher rounded total.

    Rounded totals take at most 1,001 values, so positions come from counts by total instead of one sort of all rows.
    """
    counts = scored.where("total_score is not null").groupBy("total_score").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("total_score")).rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("total_score", (F.coalesce(above, F.lit(0)) + 1).cast("int").alias("position"))
    return scored.join(F.broadcast(places), "total_score", "left")


#: Runs of a slice, and tickers of a block: a task makes the totals of a slice for a block. Totals made at once.
SLICE_RUNS, BLOCK_TICKERS, CELLS = 50, 65_536, 250_000


def _alike(rows: pa.RecordBatch, ids: int) -> tuple[pa.RecordBatch, np.ndarray, list[tuple]]:
    """Rows of rank_rows() in the order of what they lack, their ranks by indicator and ticker (NaN for NULL), and groups that lack the same: which, from, to."""
    ranks = np.empty((ids, rows.num_rows))
    for n in range(ids):
        ranks[n] = rows.column(f"r{n}").to_numpy(zero_copy_only=False)
    lacking, kind = np.unique(np.isnan(ranks), axis=1, return_inverse=True) if ids else (np.empty((0, 1), bool), np.zeros(rows.num_rows, int))
    order, ends = np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel()))
    return rows.take(pa.array(order)), ranks[:, order], [(lacking[:, k], int(a), int(b)) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def _tenths(ranks: np.ndarray, groups: list[tuple], w: np.ndarray, c: np.ndarray, members: list[list[int]], min_share: float) -> np.ndarray:
    """Totals in tenths, run by ticker, -1 where there is none: of ranks and groups of _alike(), and weights by run and indicator, by run and category.

    For tickers that lack the same indicators, what a run weighs is one number.
    """
    out = np.full((len(w), ranks.shape[1]), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for lacking, start, end in groups:
            have, every, points = np.zeros(len(w)), np.zeros(len(w)), np.zeros((len(w), end - start))
            for j, own in enumerate(members):
                there, whole, got = np.zeros(len(w)), np.zeros(len(w)), np.zeros((len(w), end - start))
                for n in own:
                    whole += w[:, n]
                    if not lacking[n]:
                        there += w[:, n]
                        got += w[:, n, None] * ranks[n, start:end]
                known = (whole != 0) & (there != 0) & (there / whole >= min_share)
                of = np.where(whole > 0, c[:, j], 0.0)
                have += np.where(known, of, 0.0)
                every += of
                got /= there[:, None]
                got *= 100
                got /= 100
                got *= of[:, None]
                got[~known] = 0.0
                points += got
            known = (have != 0) & (have / every >= min_share)
            points /= have[:, None]
            points *= 100
            points *= 10.0
            out[known, start:end] = np.rint(points[known])
    return out


def _made_totals(slices: list[tuple], members: list[list[int]], min_share: float):
    """Rows of ranks (ticker, r0 ..., _slice) to run, ticker, total_score for the slice's weightings: run numbers, weights by run and indicator, by run and category."""

    def run(batches):
        for b in batches:
            at = b.column("_slice").to_numpy()
            for number, w, c in (slices[k] for k in np.unique(at)):
                own = b.filter(pa.array(at == number[0]))
                step = max(1, CELLS // len(w))
                # A run that weighs no category has no rows.
                kept = sum(np.where(sum(w[:, n] for n in ids) > 0, c[:, j], 0.0) for j, ids in enumerate(members)) > 0
                for i in range(0, own.num_rows, step):
                    rows, ranks, groups = _alike(own.slice(i, step), w.shape[1])
                    score = _tenths(ranks, groups, w[kept], c[kept], members, min_share).T
                    ticker = rows.column("ticker").take(pa.array(np.repeat(np.arange(rows.num_rows), kept.sum())))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(number[1][kept], rows.num_rows)), ticker, pa.array((score / 10.0).ravel(), mask=(score < 0).ravel())], ["run", "ticker", "total_score"])

    return run


def _weighed(ranks: DataFrame, runs: DataFrame) -> tuple[list[str], list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Indicators of ranks in order, the places of each category's, and of runs their numbers, weights by run and indicator, and by run and category."""
    category = {r["indicator_id"]: r["category"] for r in ranks.select("indicator_id", "category").distinct().collect()}
    ids, kinds = sorted(category), sorted(set(category.values()))
    members = [[n for n, i in enumerate(ids) if category[i] == kind] for kind in kinds]
    given = runs.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(" "), "id"), F.col("weight").cast("double")))).alias("w"))
    weight = lambda kind, x: F.greatest(F.coalesce(F.col("w")[f"{kind} {x}"], F.lit(0.0)), F.lit(0.0))
    told = sorted(given.select("run", F.array(*[weight("indicator", i) for i in ids]).alias("w"), F.array(*[weight("category", k) for k in kinds]).alias("c")).collect())  # a row a run
    table = lambda k, wide: np.array([r[k] for r in told], float).reshape(len(told), wide)
    return ids, members, np.array([r["run"] for r in told], np.int64), table("w", len(ids)), table("c", len(kinds))


def rank_rows(ranks: DataFrame, ids: list[str]) -> DataFrame:
    """ticker, r0 ...: a ticker's ranks in one row, in the order of ids."""
    return ranks.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("indicator_id") == i, F.col("rank01"))).alias(f"r{n}") for n, i in enumerate(ids)]).drop("_n")


def many_totals(ranks: DataFrame, runs: DataFrame, min_share: float) -> DataFrame:
    """run, ticker, total_score for every weighting of runs (run, kind: 'indicator' or 'category', id, weight).

    Ranks don't depend on weights: each ticker is one row of them, and the weightings (a few thousand rows) go to every task as arrays. So all
    runs of a ticker come from its row without a shuffle of totals, which are plain sums over its indicators, by numpy. The rows are few and
    narrow, and what they grow to is not, so a task gets a block of tickers and a slice of the runs: counts by run and total shrink where the totals are made.
    """
    spark = ranks.sparkSession
    ship_package(spark)
    ids, members, number, w, c = _weighed(ranks, runs)
    slices = [((k, number[i : i + SLICE_RUNS]), w[i : i + SLICE_RUNS], c[i : i + SLICE_RUNS]) for k, i in enumerate(range(0, len(number), SLICE_RUNS))]
    kind = runs.schema["run"].dataType.simpleString()
    schema = f"run bigint, ticker {ranks.schema['ticker'].dataType.simpleString()}, total_score double"
    if not ids or not slices:
        return spark.createDataFrame([], schema).withColumn("run", F.col("run").cast(kind))
    held = written(rank_rows(ranks, ids), "rank-rows")
    blocks = max(1, -(-held.count() // BLOCK_TICKERS))
    dealt = held.withColumns({"_slice": F.explode(F.sequence(F.lit(0), F.lit(len(slices) - 1))), "_block": F.pmod(F.xxhash64("ticker"), F.lit(blocks))})
    # More partitions than tasks with rows, so that hashes seldom put two into one.
    dealt = dealt.repartition(4 * len(slices) * blocks, "_slice", "_block") if len(slices) * blocks > 1 else dealt
    made = dealt.drop("_block").mapInArrow(_made_totals(slices, members, min_share), schema)
    return made.withColumn("run", F.col("run").cast(kind))


#: Tickers that a task counts at least, and at most: a task returns up to 1,001 counts a run. Runs counted at once, tickers and totals reckoned at once.
LEAST_COUNTED, MOST_COUNTED, RUNS_AT_ONCE, CHUNK, TILE = 4_096, 262_144, 1_000, 8_192, 65_536


def _chunks(batches, rows: int):
    """Batches, put together up to so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_tiles(ranks: np.ndarray, groups: list[tuple], w: np.ndarray, c: np.ndarray, members: list[list[int]], min_share: float):
    """from, to, _tenths() of the runs between them."""
    step = max(1, TILE // ranks.shape[1])
    for i in range(0, len(w), step):
        yield i, min(i + step, len(w)), _tenths(ranks, groups, w[i : i + step], c[i : i + step], members, min_share)


class RunTotals:
    """The totals that many_totals() would return, never as rows: a company's are made in a task, counted there, and made again where counts are compared with.

    rows: ticker, r0 ... (rank_rows()), base_rank, and whatever is to be kept of a company.
    """

    def __init__(self, ranks: DataFrame, runs: DataFrame, min_share: float, companies: DataFrame) -> None:
        """companies: ticker, base_rank, and more; a row for each to be counted."""
        ship_package(ranks.sparkSession)
        ids, self.members, self.number, self.w, self.c = _weighed(ranks, runs)
        self.min_share, self.kind = min_share, runs.schema["run"].dataType.simpleString()
        rows = written(companies.join(rank_rows(ranks, ids), "ticker", "left"), "rank-rows")
        n = rows.count()
        blocks = max(1, -(-n // MOST_COUNTED), min(ranks.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_COUNTED)))
        self.rows = rows.repartition(blocks, "ticker")

    def counts(self) -> DataFrame:
        """run, _k (a total in tenths), _c, _b, _bb: how many companies have it, and the sum of their base_rank and of its square."""
        out = None
        for i in range(0, len(self.number), RUNS_AT_ONCE):
            number, w, c = (x[i : i + RUNS_AT_ONCE] for x in (self.number, self.w, self.c))
            made = self.rows.mapInArrow(_counted(number, w, c, self.members, self.min_share), "run bigint, _k int, _c bigint, _b double, _bb double")
            out = made if out is None else out.unionByName(made)
        if out is None:
            out = self.rows.sparkSession.createDataFrame([], "run bigint, _k int, _c bigint, _b double, _bb double")
        return out.groupBy(F.col("run").cast(self.kind).alias("run"), "_k").agg(*[F.sum(x).alias(x) for x in ("_c", "_b", "_bb")])

    def hits(self, bounds: dict, keep: list[str]) -> DataFrame:
        """keep, _t, _b: in how many runs a company's total in tenths reaches the run's upper bound, and in how many it doesn't pass the lower; bounds by run, None for none."""
        pairs = [bounds.get(int(r), (None, None)) for r in self.number]
        high, low = (np.array([none if p[k] is None else p[k] for p in pairs], np.int64) for k, none in ((0, np.iinfo(np.int64).max), (1, -1)))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.select(*keep).schema.fields)
        return self.rows.mapInArrow(_hit(self.w, self.c, self.members, self.min_share, high, low, keep), f"{schema}, _t bigint, _b bigint")


def _counted(number: np.ndarray, w: np.ndarray, c: np.ndarray, members: list[list[int]], min_share: float):
    def run(batches):
        wide = 1002  # a place for no total, then the tenths of 0 to 100
        counts, sums, squares = np.zeros((len(w), wide), np.int64), np.zeros((len(w), wide)), np.zeros((len(w), wide))
        for rows, ranks, groups in (_alike(x, w.shape[1]) for x in _chunks(batches, CHUNK)):
            base = rows.column("base_rank").to_numpy(zero_copy_only=False)
            for i, j, tenths in _by_tiles(ranks, groups, w, c, members, min_share):
                at = (tenths + 1 + wide * np.arange(j - i)[:, None]).ravel()
                held = np.broadcast_to(base, tenths.shape).ravel()
                shape, size = (j - i, wide), (j - i) * wide
                counts[i:j] += np.bincount(at, minlength=size).reshape(shape)
                sums[i:j] += np.bincount(at, held, size).reshape(shape)
                squares[i:j] += np.bincount(at, held * held, size).reshape(shape)
        for i in range(0, len(w), SLICE_RUNS):
            own = counts[i : i + SLICE_RUNS, 1:]
            r, k = np.nonzero(own)
            columns = [number[i + r], k.astype(np.int32), own[r, k], sums[i + r, k + 1], squares[i + r, k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["run", "_k", "_c", "_b", "_bb"])

    return run


def _hit(w: np.ndarray, c: np.ndarray, members: list[list[int]], min_share: float, high: np.ndarray, low: np.ndarray, keep: list[str]):
    def run(batches):
        for rows, ranks, groups in (_alike(x, w.shape[1]) for x in _chunks(batches, CHUNK)):
            top, bottom = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            for i, j, tenths in _by_tiles(ranks, groups, w, c, members, min_share):
                top += (tenths >= high[i:j, None]).sum(0)
                bottom += ((tenths <= low[i:j, None]) & (tenths >= 0)).sum(0)
            yield pa.RecordBatch.from_arrays([*[rows.column(x) for x in keep], pa.array(top), pa.array(bottom)], [*keep, "_t", "_b"])

    return run


def drawn_weightings(catalog: DataFrame, profile: Profile, runs: int = 1000, seed: int = 2026) -> DataFrame:
    """run, kind, id, weight as many_totals() takes them: uniform in [0.05, 1), each run's categories first, then every
    indicator of the catalog. What the profile gives no weight is drawn too and stays 0."""
    ids = [r[0] for r in catalog.select("indicator_id").collect()]
    chosen = {r[0] for r in indicator_weights(catalog, profile).select("indicator_id").collect()}
    draw, rows = np.random.default_rng(seed), []
    for run in range(1, runs + 1):
        for c, w in zip(CATEGORIES, draw.uniform(0.05, 1, len(CATEGORIES)).tolist(), strict=True):
            rows.append((run, "category", c, w if profile.category_weights.get(c, 0) > 0 else 0.0))
        for i, w in zip(ids, draw.uniform(0.05, 1, len(ids)).tolist(), strict=True):
            rows.append((run, "indicator", i, w if i in chosen else 0.0))
    return catalog.sparkSession.createDataFrame(rows, "run int, kind string, id string, weight double")


def explain(ranks: DataFrame, by_category: DataFrame, category_weights: dict) -> DataFrame:
    """A row for every ticker and indicator: its points add up to the ticker's total."""
    weight = F.create_map(*[x for c, w in category_weights.items() if w > 0 for x in (F.lit(c), F.lit(float(w)))])[F.col("category")]
    shares = by_category.where("score is not null").withColumn("cw", weight).where("cw is not null")
    shares = shares.select("ticker", "category", ratio(F.col("cw"), F.sum("cw").over(Window.partitionBy("ticker"))).alias("category_share"))
    inside = Window.partitionBy("ticker", "category")
    held = F.when(F.col("rank01").isNotNull(), F.col("weight"))
    own = F.coalesce(ratio(held, F.sum(held).over(inside)), F.lit(0.0))
    told = ranks.withColumn("share_in_category", own).join(shares, ["ticker", "category"], "left")
    points = F.coalesce(F.col("rank01") * 100 * F.col("share_in_category") * F.coalesce("category_share", F.lit(0.0)), F.lit(0.0))
    return told.select("ticker", "category", "indicator_id", "value", "year", "rank01", "weight", "share_in_category", points.alias("points"))


def peers(ranks: DataFrame, ticker: str, indicator_id: str, sector_relative: bool = True) -> DataFrame:
    """ticker, value, position (1 = lowest) of all that the ticker's company is ranked against."""
    pool = ranks.where((F.col("indicator_id") == indicator_id) & F.col("value").isNotNull() & (F.col("ticker") == F.col("primary")))
    if sector_relative:
        pool = pool.join(F.broadcast(ranks.where(F.col("ticker") == ticker).select("sector").distinct()), "sector", "left_semi")
    return pool.select("ticker", "value", average_rank(F.col("value"), ["indicator_id"]).alias("position"))
