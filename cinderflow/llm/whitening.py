"""Embedding whitening: TSQR of the centred rows, then a one-sided Jacobi SVD of the one triangle that is left.

Vectors become whole numbers, so that sums, means and distances from the mean are exact whatever the order of rows. The model is fitted on
every distinct vector once (a grouping by the vector, partial before the shuffle, so copies of one vector are one row a task).

1. Sums by dimension, in two parts of a long each, are exact; only dimensions' totals reach the driver.
2. Each task centres its rows with the exact mean (as whole part and rest, so that nothing cancels) and keeps one triangle R while it reads:
   R of (R over the next rows). Triangles of FAN tasks are put together at a time, in as many rounds as that takes.
3. Of the last triangle (dimensions x dimensions, whatever the number of rows) plane rotations make the columns orthogonal. Their norms are the
   singular values, so the covariance's small eigenvalues keep their digits, which a covariance matrix would lose; the accumulated
   rotations are the components. Rotations of disjoint pairs of columns are done at once.
4. A second pass over the fit list measures how far the whitened covariance is from the identity.

Edge cases
* rows with a null vector, or with null or non-finite components: left out. Null or repeated vec_ids: rows of their own.
* vectors of different lengths: shorter ones, the empty one too, go on with zeros (before scaling and shift).
* components without variance (a singular value below dimensions x 2.2e-16 x the largest): none is returned, so fewer than asked for; with one
  distinct vector, or none, the result is empty.
* components beyond 2^52 after scaling count as 2^52. A deviation beyond a long is null.
* extra columns, whatever their names, are left out.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm.textkernel import trimmed
from cinderflow.llm.vectors import finite, whole
from cinderflow.storage import written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Triangles put together in one task; sweeps of rotations at most (some ten are usual).
FAN, SWEEPS = 64, 60
_LOW = 20
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Centre:
    """The exact mean of n vectors: S = n * whole + rest, 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    fill: int

    @property
    def dims(self) -> int:
        return len(self.whole)

    def offsets(self, column: pa.Array) -> np.ndarray:
        """x - whole of every row, exact."""
        return _matrix(column, self.dims, self.fill) - self.whole

    def centred(self, column: pa.Array) -> np.ndarray:
        return self.offsets(column) - self.rest / self.n

    def deviations(self, column: pa.Array) -> pa.Array:
        """Sum over dimensions of (n * x - S) squared, exact; null where a long can't hold it."""
        off = self.offsets(column)
        most = self.n * int(np.abs(off).max(initial=0)) + self.n
        if most * most * self.dims < 1 << 63:
            return pa.array(((self.n * off - self.rest) ** 2).sum(1))
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in off]
        return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


@dataclass
class Whitening:
    centre: Centre
    #: dims x components, unit columns by falling value; the values (of the covariance) and its trace.
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, column: pa.Array) -> np.ndarray:
        return self.centre.centred(column) @ self.axes / np.sqrt(self.values)


def _matrix(column: pa.Array, dims: int, fill: int) -> np.ndarray:
    """A column of lists of longs as rows of dims longs; shorter lists go on with fill."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * dims:
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), fill, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _sums(dims: int, fill: int):
    def run(batches):
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for b in batches:
            x = _matrix(b.column("x"), dims, fill)
            high += (x >> _LOW).sum(0)
            low += (x & ((1 << _LOW) - 1)).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dims, n))], ["dim", "high", "low", "n"])

    return run


def _centre(fit: DataFrame, dims: int, fill: int) -> Centre:
    cells = fit.mapInArrow(_sums(dims, fill), "dim int, high long, low long, n long").groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("dim").collect()
    n = cells[0]["n"] if cells else 0
    parts = [divmod((r["high"] << _LOW) + r["low"], n) for r in cells] if n else []
    return Centre(n, np.array([q for q, _ in parts], np.int64), np.array([r for _, r in parts], np.int64), fill)


def _over(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([r, rows]), mode="r")


def _triangles(centre: Centre):
    def run(batches):
        from pyspark import TaskContext

        r = np.zeros((0, centre.dims))
        for b in batches:
            if b.num_rows:
                r = _over(r, centre.centred(b.column("x")))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return run


def _together(dims: int):
    def run(key, table):
        r = np.zeros((0, dims))
        for raw in table.column("r"):
            r = _over(r, np.frombuffer(raw.as_py()).reshape(-1, dims))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R with R'R = the centred rows' sum of products, by rounds of FAN triangles."""
    parts, rs = fit.rdd.getNumPartitions(), fit.mapInArrow(trimmed(_triangles(centre)), "part int, r binary")
    while parts > 1:
        parts = -(-parts // FAN)
        rs = rs.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(_together(centre.dims), "part int, r binary")
    last = rs.select("r").collect()  # one triangle
    return np.frombuffer(last[0]["r"]).reshape(-1, centre.dims) if last else np.zeros((0, centre.dims))


def _rounds(d: int):
    """Pairs of columns by rounds of a tournament: each round's pairs are disjoint, all rounds are all pairs."""
    seats = list(range(d + d % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1:-1], strict=True) if max(a, b) < d]
        yield np.array([min(x) for x in pairs], np.int64), np.array([max(x) for x in pairs], np.int64)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns, by plane rotations of columns."""
    d = r.shape[1]
    a, v, rounds = r.copy(), np.eye(d), list(_rounds(d)) if d > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            turn = np.abs(gamma) > 4 * np.finfo(float).eps * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            p, q, ap, aq, gamma = p[turn], q[turn], ap[:, turn], aq[:, turn], gamma[turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    sizes = np.sqrt((a * a).sum(0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))


def fit(rows: DataFrame, components: int = COMPONENTS, fill: int = SHIFT) -> tuple[Whitening | None, DataFrame]:
    """The whitening of rows' distinct x (lists of longs), and the written fit list; None where there is no variance."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    full = F.concat("x", F.array_repeat(F.lit(fill).cast("long"), (F.lit(dims) - F.size("x")).cast("int")))
    distinct = written(rows.select(full.alias("x")).distinct(), "fit")
    centre = _centre(distinct, dims, fill) if dims else Centre(0, np.zeros(0, np.int64), np.zeros(0, np.int64), fill)
    if centre.n < 2:
        return None, distinct
    sizes, axes = jacobi(triangle(distinct, centre))
    held = min(components, int((sizes > dims * np.finfo(float).eps * sizes[0]).sum()))
    values = sizes**2 / centre.n
    return Whitening(centre, np.ascontiguousarray(axes[:, :held]), values[:held], float(values.sum())), distinct


def _moments(model: Whitening):
    k = len(model.values)

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.whitened(b.column("x"))
            one += w.sum(0)
            two += w.T @ w
        cells = np.concatenate([one, two.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "v"])

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, n = len(model.values), model.centre.n
    cells = np.zeros(k + k * k)
    for r in distinct.mapInArrow(_moments(model), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # components squared
        cells[r["cell"]] = r["v"] / n
    return float(np.abs(cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every finite vector and component."""
    rows = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column), column).select("vec_id", whole(column, scale, shift).alias("x"))
    model, distinct = fit(rows, components, shift)
    if model is None:
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _OUT.split(", ")[1:])))
    error, k = identity_error(distinct, model), len(model.values)
    explained = model.values / model.trace

    def run(batches):
        for b in batches:
            m = b.num_rows
            each = np.repeat(np.arange(m), k)
            deviation = model.centre.deviations(b.column("x")) if m else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)),
                    deviation.take(pa.array(each)), pa.array(model.whitened(b.column("x")).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [x.split()[0] for x in _OUT.split(", ")],
            )

    return rows.mapInArrow(trimmed(run), _OUT)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
#: Eigenvectors have no SQL; the tests compare with exact sums and numpy's eigh of the covariance.
ORACLE_SQL = {}
