"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each text becomes a vector of transformed statistics. For each (language, source), and for the languages and the whole corpus
as their priors, the h = (n + d + 1) / 2 vectors whose scatter has the smallest determinant are sought:

1. Three starts: medians and median deviations; covariance of spatial signs about them; correlations of squashed (tanh) values.
2. Concentration steps from each: distances under the present estimate, their quantile by group, moments of what lies
   within, until no log determinant of any group and start moves by more than SETTLED (MOST_STEPS steps at most). Steps never raise
   a determinant, and the start that ends lowest is taken.
3. A last step takes the moments of all vectors within the quantile of a tail of REWEIGHTED.
4. A vector is rejected if its Mahalanobis distance exceeds the chi-square quantile of a tail of TAIL.

So junk may hold nearly half of a group. Equal vectors of a group count once: copies, however many, weigh no more than one text.
All of a step is grouped aggregation with partial sums, so a group of any size is never gathered; only one row a
group and start is inverted.

A group of n vectors has its own estimate with weight n / (n + PRIOR) and its language's with the rest; a language in turn leans on the
corpus so. Every group is judged by its own estimate, of whatever size it is: there is no size at which that changes.

Statistics that are constant in most clean texts (no symbols at all, say) would make the scatter singular:
the squares of FLOOR are added to its diagonal, so no distance counts differences below measure.

Edge cases
* null or empty text: all counts 0, fails the base rule (fewer than 20 words), never kept.
* null language or source: a value of its own. No rows: empty result. Repeated rows: judged alike, each returned.
* a group of one vector, or of equal ones: judged by its language's estimate, moved towards it. All vectors equal: distance 0, kept.
* ties of determinants: the first of the starts. Extra columns, whatever their names, are left out.
"""

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm import textstats
from cinderflow.storage import written

REWEIGHTED, TAIL, PRIOR = 0.025, 1e-3, 50
MOST_STEPS, SETTLED, STARTS = 8, 1e-3, 3
#: Up to so many groups their parameters (at most 3 x 80 numbers each) are broadcast; parts of a group beyond that.
BROADCAST_POOLS, SALTS = 4_000, 32
#: Least standard deviation of each statistic.
FLOOR = [0.08, 0.08, 0.08, 0.08, 0.08, 0.08, 0.08, 0.12]
D = len(FLOOR)
_V = [f"v{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


def chi_square_cdf(x: float, k: int) -> float:
    return NormalDist().cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def consistency(share: float, k: int) -> float:
    """The scatter of the inner share of a normal distribution, times this, is the whole's."""
    return share / chi_square_cdf(chi_square_quantile(share, k), k + 2) if share < 1 else 1.0


#: Shares of vectors held: a group of n takes the one next to (n + d + 1) / 2n, a half in large ones, all in the smallest.
HELD = [0.5 + 0.025 * i for i in range(21)]


def vectors(counts: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of textstats.NAMES."""
    x = dict(zip(textstats.NAMES, counts.astype(float).T, strict=True))
    words = np.maximum(x["n_words"], 1)
    mean = x["word_chars"] / words
    spread = np.sqrt(np.maximum(x["sum_sq_length"] / words - mean**2, 0))
    return np.stack(
        [
            np.log(np.maximum(mean, 0.5)), np.sqrt(x["n_symbols"] / words), np.sqrt(x["n_repeat_words"] / words), np.sqrt(x["common"] / words),
            np.sqrt((x["ends"] + x["commas"]) / words), np.sqrt(x["upper"] / np.maximum(x["letters"], 1)), np.sqrt(x["bare"] / words),
            np.log(np.maximum(spread, 0.3)),
        ],
        axis=1,
    )


def _measured(batches):
    for b in batches:
        c = textstats.counts(b.column("text"))
        v = vectors(c)
        columns = [b.column("doc_id").cast(pa.int64()), b.column("lang"), b.column("source"), *(pa.array(c[:, textstats.NAMES.index(n)]) for n in BASE), *map(pa.array, v.T)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", *BASE, *_V])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the base rule, and the vector."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join([*(f"{n} long" for n in BASE), *(f"{v} double" for v in _V)]))


def groups():
    """The group of a row and those it leans on: language and source, language, all."""
    return [F.to_json(F.struct(F.lit(2), "lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct(F.lit(1), "lang"), {"ignoreNullFields": "false"}), F.lit("all")]


def _distance():
    """Squared Mahalanobis distance of v0.. under mu and inv (upper triangle, off-diagonal doubled)."""
    off = [F.col(v) - F.element_at("mu", i + 1) for i, v in enumerate(_V)]
    return sum((off[i] * off[j] * F.element_at("inv", k + 1) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _matrix(upper) -> np.ndarray:
    out = np.zeros((D, D))
    for x, (i, j) in zip(upper, _PAIRS, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _parameters(names: list[str], keys: list[pa.Array], found: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """keys, n, mu, cov (upper triangle), inv (its inverse, off-diagonal doubled), logdet."""
    inverses = [np.linalg.inv(c) for *_, c in found]
    many = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [
            *keys, pa.array([float(n) for n, *_ in found], pa.float64()), pa.array([mu.tolist() for _, mu, _ in found], many),
            pa.array([[float(c[i, j]) for i, j in _PAIRS] for *_, c in found], many), pa.array([[float(v[i, j] * (1 if i == j else 2)) for i, j in _PAIRS] for v in inverses], many),
            pa.array([float(np.linalg.slogdet(c)[1]) for *_, c in found], pa.float64()),
        ],
        [*names, "n", "mu", "cov", "inv", "logdet"],
    )


_SHAPE = "n double, mu array<double>, cov array<double>, inv array<double>, logdet double"
_FLOOR = np.diag(np.square(FLOOR))


def _estimated(batches):
    """One row a group and start: vectors in the group, share held, and the sums of _held(), to location and scatter."""
    for b in batches:
        found = []
        for whole, share, sums in zip(*(b.column(c).to_pylist() for c in ("whole", "share", "sums")), strict=True):
            sums = np.array(sums)
            mu = sums[1 : 1 + D] / sums[0]
            found.append((whole, mu, (_matrix(sums[1 + D :] / sums[0]) - np.outer(mu, mu)) * consistency(share, D) + _FLOOR))
        yield _parameters(["g", "start"], [b.column("g"), b.column("start")], found)


def _started(batches):
    """One row a group: its size, medians, deviations and the sums of _shapes(), to the starts."""
    for b in batches:
        found, g, start = [], [], []
        for name, whole, mu, sd, sums in zip(*(b.column(c).to_pylist() for c in ("g", "whole", "m", "s", "sums")), strict=True):
            mu, sd, means = np.array(mu), np.array(sd), np.array(sums) / whole
            signs, squashed = _matrix(means[: len(_PAIRS)]), _matrix(means[len(_PAIRS) :])
            size = np.sqrt(np.maximum(np.diag(squashed), 1e-9))
            for k, shape in enumerate((np.eye(D), signs * D, squashed / np.outer(size, size))):
                found.append((whole, mu, shape * np.outer(sd, sd) + _FLOOR))
                g.append(name)
                start.append(k)
        yield _parameters(["g", "start"], [pa.array(g, pa.string()), pa.array(start, pa.int32())], found)


_I, _J = (np.array([p[k] for p in _PAIRS]) for k in (0, 1))


def _list(column, n: int) -> np.ndarray:
    """A list column as a matrix of n rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _values(b) -> np.ndarray:
    return np.stack([b.column(v).to_numpy(zero_copy_only=False) for v in _V], 1)


def _squared(b) -> np.ndarray:
    """Squared distances of a batch's vectors, under each of the estimates (mu, inv) that stand beside them: a column for each."""
    n = b.num_rows
    v, mu, inv = _values(b), _list(b.column("mu"), n), _list(b.column("inv"), n)
    out = []
    for k in range(mu.shape[1] // D):
        off = v - mu[:, k * D : (k + 1) * D]
        out.append((off[:, _I] * off[:, _J] * inv[:, k * len(_PAIRS) : (k + 1) * len(_PAIRS)]).sum(1))
    return np.stack(out, 1) if out else np.zeros((n, 0))


def _distances(batches):
    for b in batches:
        if b.num_rows:
            d = _squared(b)
            yield pa.RecordBatch.from_arrays([b.column("g"), *(pa.array(d[:, k]) for k in range(STARTS))], ["g", *(f"d{k}" for k in range(STARTS))])


def _added(batches, parts):
    """Sums by group and start over a task's rows. parts(batch) gives for each start a mask (or None) and a matrix with a row a vector; a
    task sends a row a group and start."""
    held: dict[tuple, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("g").dictionary_encode()
        code, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        order = np.argsort(code, kind="stable")
        for k, (mask, m) in enumerate(parts(b)):
            at = order if mask is None else order[mask[order]]
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, code[at][1:] != code[at][:-1]))
            for c, x in zip(code[at][begin], np.add.reduceat(m[at], begin), strict=True):
                key = names[c], k
                held[key] = held[key] + x if key in held else x
    keys = list(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([held[k].tolist() for k in keys], pa.list_(pa.float64()))], ["g", "start", "sums"]
    )


def _held(batches):
    """Sums of 1, values and products of values over what is within upto, for each start."""

    def parts(b):
        v = _values(b)
        m = np.concatenate([np.ones((len(v), 1)), v, v[:, _I] * v[:, _J]], 1)
        within = _squared(b) <= _list(b.column("upto"), b.num_rows)
        return [(within[:, k], m) for k in range(within.shape[1])]

    yield from _added(batches, parts)


def _shapes(batches):
    """Sums of products of spatial signs and of squashed values about the medians (m) in units of the deviations (s)."""

    def parts(b):
        z = (_values(b) - _list(b.column("m"), b.num_rows)) / _list(b.column("s"), b.num_rows)
        u, t = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9), np.tanh(z)
        return [(None, np.concatenate([u[:, _I] * u[:, _J], t[:, _I] * t[:, _J]], 1))]

    yield from _added(batches, parts)


_SUMS = "g string, start int, sums array<double>"


def _total(partial: DataFrame) -> DataFrame:
    """g, start, sums of the tasks' sums: lists are added place by place."""
    by = partial.select("g", "start", F.posexplode("sums").alias("at", "x")).groupBy("g", "start", "at").agg(F.sum("x").alias("x"))
    return by.groupBy("g", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("sums"))


def blend(own: tuple, prior: tuple, k: float = PRIOR) -> tuple:
    """(n, mu, cov) of a group of n vectors leaning on a prior that counts as k."""
    (n, m, c), (_, m0, c0) = own, prior
    w = n / (n + k)
    return n, w * m + (1 - w) * m0, w * c + (1 - w) * c0 + w * (1 - w) * np.outer(m - m0, m - m0)


def _blended(batches):
    for b in batches:
        x = {c: b.column(c).to_pylist() for c in b.schema.names}
        found = []
        for r in range(b.num_rows):
            level = [(x[f"n{i}"][r], np.array(x[f"mu{i}"][r]), _matrix(x[f"cov{i}"][r])) for i in range(3) if x[f"n{i}"][r] is not None]
            while len(level) > 1:
                level[-2:] = [blend(level[-2], level[-1])]
            found.append(level[0])
        yield _parameters(["g"], [b.column("g")], found)


def leaning(found: DataFrame, tree: DataFrame) -> DataFrame:
    """The parameters of every group, leaning on those above it. found: parameters by g; tree: g, up1 and up2 (the groups above, or null)."""
    part = lambda i, key: found.select(F.col("g").alias(key), *[F.col(c).alias(f"{c}{i}") for c in ("n", "mu", "cov")])
    rows = tree.join(part(0, "g"), "g").join(part(1, "up1"), "up1", "left").join(part(2, "up2"), "up2", "left")
    return rows.select("g", *[f"{c}{i}" for i in range(3) for c in ("n", "mu", "cov")]).mapInArrow(_blended, "g string, " + _SHAPE)


def _with(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """rows with the rows that params has for their group.

    A group may hold most rows, so they are never dealt by group: params is broadcast where there are few groups,
    and repeated for SALTS parts of each where there are many.
    """
    if few:
        return rows.join(F.broadcast(params), "g")
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*_V), F.lit(SALTS)).cast("int"))
    return salted.join(params.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "_part"]).drop("_part")


def starts(vectors: DataFrame, few: bool) -> DataFrame:
    """g, start and parameters of the starts of each group."""
    medians = lambda xs: F.array(*[F.percentile_approx(x, 0.5) for x in xs])
    centre = written(vectors.groupBy("g").agg(F.count(F.lit(1)).alias("whole"), medians(_V).alias("m")), "mcd-centre")
    apart = _with(vectors, centre, few).groupBy("g").agg(medians([F.abs(F.col(v) - F.element_at("m", i + 1)) for i, v in enumerate(_V)]).alias("d"))
    # A median deviation times 1.4826 is a normal distribution's standard deviation.
    scale = apart.select("g", F.array(*[F.sqrt(F.pow(F.element_at("d", i + 1) * 1.4826, 2) + FLOOR[i] ** 2) for i in range(D)]).alias("s"))
    told = written(centre.join(scale, "g"), "mcd-scale")
    sums = _total(_with(vectors, told, few).select("g", "m", "s", *_V).mapInArrow(_shapes, _SUMS)).drop("start")
    return sums.join(told, "g").select("g", F.col("whole").cast("double").alias("whole"), "m", "s", "sums").mapInArrow(_started, "g string, start int, " + _SHAPE)


def _moments(vectors: DataFrame, cut: DataFrame, few: bool, share) -> DataFrame:
    """Parameters, by group and start, of the vectors within cut (g, n, mu, inv, upto: a list each with an entry for each start)."""
    near = _with(vectors, cut, few).select("g", "mu", "inv", "upto", *_V).mapInArrow(_held, _SUMS)
    told = _total(near).join(cut.select("g", F.col("n").alias("whole")), "g").withColumn("held", F.element_at("sums", 1))
    return written(told.select("g", "start", "whole", share.alias("share"), "sums").mapInArrow(_estimated, "g string, start int, " + _SHAPE), "mcd")


def determinants(vectors: DataFrame, few: bool, steps: int = MOST_STEPS) -> DataFrame:
    """g and the parameters of the held half with the least determinant of each group of vectors (g, v0 ..)."""
    now = written(starts(vectors, few), "mcd")
    share = F.least(F.greatest(F.ceil(((F.col("n") + D + 1) / (2 * F.col("n")) - 0.5) / 0.025).cast("int"), F.lit(0)), F.lit(len(HELD) - 1)) + 1
    for step in range(steps):
        by = now.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("start", "mu", "inv"))).alias("p"), F.first("n").alias("n"))
        wide = written(by.select("g", "n", F.flatten(F.transform("p", lambda x: x["mu"])).alias("mu"), F.flatten(F.transform("p", lambda x: x["inv"])).alias("inv")), "mcd-wide")
        far = _with(vectors, wide, few).select("g", "mu", "inv", *_V).mapInArrow(_distances, "g string, " + ", ".join(f"d{k} double" for k in range(STARTS)))
        quantiles = far.groupBy("g").agg(*[F.percentile_approx(f"d{k}", HELD).alias(f"u{k}") for k in range(STARTS)])
        cut = written(wide.join(quantiles, "g").select("g", "n", "mu", "inv", F.array(*[F.element_at(f"u{k}", share) for k in range(STARTS)]).alias("upto")), "mcd-cut")
        new = _moments(vectors, cut, few, F.least(F.lit(1.0), F.col("held") / F.col("whole")))
        moved = new.select("g", "start", F.col("logdet").alias("to")).join(now.select("g", "start", "logdet"), ["g", "start"]).agg(F.max(F.abs(F.col("to") - F.col("logdet")))).first()[0]
        now = new
        if step and (moved is None or moved <= SETTLED):
            break
    return now.groupBy("g").agg(F.min_by(F.struct("n", "mu", "cov", "inv", "logdet"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The final parameters of every (language, source) of rows, by g; and whether they are few enough to broadcast."""
    own, language, every = groups()
    levels = rows.select(F.explode(F.array(own, language, every)).alias("g"), *_V)
    vectors = written(levels.groupBy("g", *_V).agg(F.count(F.lit(1)).alias("copies")).drop("copies"), "mcd-vectors")
    tree = rows.select(own.alias("g"), language.alias("up1"), every.alias("up2")).distinct()
    above = tree.select(F.col("up1").alias("g"), F.col("up2").alias("up1"), F.lit(None).cast("string").alias("up2")).distinct()
    top = tree.select(F.col("up2").alias("g"), F.lit(None).cast("string").alias("up1"), F.lit(None).cast("string").alias("up2")).distinct()
    tree = written(tree.unionByName(above).unionByName(top), "mcd-tree")
    few = tree.limit(BROADCAST_POOLS + 1).count() <= BROADCAST_POOLS
    raw = written(leaning(determinants(vectors, few), tree), "mcd-raw")
    cut = raw.select("g", "n", "mu", "inv", F.array(F.lit(chi_square_quantile(1 - REWEIGHTED, D))).alias("upto"))
    # A group none of whose vectors is within keeps its raw estimate.
    last = _moments(vectors, cut, few, F.lit(1 - REWEIGHTED)).drop("start")
    last = last.unionByName(raw.join(last.select("g"), "g", "left_anti").select(*last.columns))
    return written(leaning(last, tree), "mcd-final"), few


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and distance (squared)."""
    rows = written(measured(docs), "stats")
    params, few = estimates(rows)
    found = _with(rows.withColumn("g", groups()[0]), params.select("g", "mu", "inv"), few).withColumn("distance", _distance())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("distance") <= chi_square_quantile(1 - TAIL, D))
    return found.select("doc_id", *BASE, failed.alias("base_failed"), kept.alias("kept"), "distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {}
