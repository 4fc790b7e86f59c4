"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Labelled documents of label 1 are preferred to those of label 0. Pairs of one of each are drawn; the
model is the logistic loss on the difference of their features, so a document's score is a linear
function of its features. The threshold is the quantile of the scores of all training documents that
leaves the share of label 0 below it; the logistic function of the distance to it gives 0 .. 1, with 0.5 at the
threshold.

Training sees a bounded sample: of the labelled documents at most SAMPLE, those whose hash of doc_id lies below a
threshold (a documented parameter; a fit needs no more). Scoring sees every document and its whole text. Labels, lang, source and
doc_id are no inputs.

Edge cases
* null or empty text: its features are zero; it gets a score like any other.
* a doc_id labelled more than once: the mean label, halves up; labelled rows without a document, or with a
  null id or label: not used. Only one label present, or none: every score is 0.5 and 1 is predicted.
* held out: crc32 of the id as text mod 3 is 1; a null id is not.
* empty tables: an empty result. Repeated rows: each is scored. Extra columns are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm import textstats
from cinderflow.llm.textkernel import trimmed
from cinderflow.storage import written

SAMPLE, PAIRS, PAIRS_AT_A_TIME, ROUNDS, RIDGE, SEED = 20_000, 100_000, 10_000, 30, 1e-3, 7


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: rates by word and by byte, logarithms of sizes, and bends of each."""
    x = dict(zip(textstats.NAMES, textstats.counts(column).astype(float).T, strict=True))
    words, size = np.maximum(x["n_words"], 1), np.maximum(x["bytes"], 1)
    rates = np.stack(
        [
            x["n_symbols"] / words, x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / words, x["n_lines"] / words, x["letters"] / size,
            x["upper"] / np.maximum(x["letters"], 1), x["digits"] / size, x["ends"] / words, x["commas"] / words, x["common"] / words, x["bare"] / words,
            x["upper_words"] / words, x["word_chars"] / words / 10, x["wide"] / size, 1 - x["distinct"] / words,
            np.sqrt(np.maximum(x["sum_sq_length"] / words - (x["word_chars"] / words) ** 2, 0)) / 10,
        ]
    )
    logs = np.log1p(np.stack([x["n_words"], x["longest"], x["n_lines"]])) / 10
    # The expected share of repeats grows with length: its excess over what the length explains.
    repeat = (1 - x["distinct"] / words) / np.maximum(np.log1p(x["n_words"]), 1)
    base = np.concatenate([rates, logs, [repeat]])
    return np.concatenate([base, np.sqrt(np.abs(base)), base**2, np.minimum(base * 10, 1)]).T


class Model:
    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.spread, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS) -> Model:
    """Newton steps on the mean logistic loss of the differences of preference pairs."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(SEED)
    # Every document takes part as often as any other of its label, in a random order.
    n = max(len(good), len(bad), pairs)
    deal = lambda of: np.concatenate([draw.permutation(of) for _ in range(-(-n // len(of)))])[:n]
    better, worse = deal(good), deal(bad)
    # The loss and its slope need the documents' scores only. Products of pairs' features are made for so many pairs at a time.
    parts = [slice(i, i + PAIRS_AT_A_TIME) for i in range(0, n, PAIRS_AT_A_TIME)]
    w = np.zeros(width)
    apart = lambda w: (s := z @ w)[better] - s[worse]
    loss = lambda w: np.logaddexp(0, -apart(w)).mean() + RIDGE * (w @ w) / 2
    shares = lambda x: (np.bincount(better, x, len(z)), np.bincount(worse, x, len(z)))
    now = loss(w)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(apart(w), -30, 30)))
        up, down = shares(p)
        slope = RIDGE * w - (up - down) @ z / n
        q = p * (1 - p)
        cross = sum((z[better[i]] * q[i, None]).T @ z[worse[i]] for i in parts)
        bend = ((z * sum(shares(q))[:, None]).T @ z - cross - cross.T) / n + RIDGE * np.eye(width)
        step, rate = np.linalg.solve(bend, slope), 1.0
        while rate > 1e-4 and (new := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-4 or now - new < 1e-9:
            break
        w, now = w - rate * step, new
    s = z @ w
    # The quantile: between the last score that should fall below and the first above.
    ordered, k = np.sort(s), len(bad)
    cut = (ordered[k - 1] + ordered[min(k, len(s) - 1)]) / 2
    return Model(mean, scale, w, float(cut), float(max(s.std(), 1e-6)))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample labelled documents; their features are made on the executors."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    there = marked.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    marked = written(there.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)), "labelled")
    # Ids below a threshold of their hash are a sample whose size needs no sort: five deviations under the bound, for
    # which the limit only stands surety. So the broadcast is at most `sample` rows of an id and a number.
    n = marked.count()
    share = 1.0 if n <= sample else max(0.0, sample - 5 * sample**0.5) / n
    chosen = F.broadcast(marked.where(F.col("draw") <= min(int(share * (1 << 63)), (1 << 63) - 1)).select("doc_id", "quality").limit(sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text").mapInArrow(trimmed(_featured), "doc_id long, quality int, x binary")
    # Repeated rows of an id could pass the bound: one row an id.
    got = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.max("x").alias("x")).orderBy("doc_id").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, features(pa.array([""])).shape[1])), np.zeros(0))
    x = np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in got["x"]])
    return fit(x, got["quality"].to_numpy())


def _featured(batches):
    for b in batches:
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])


def _free(docs: DataFrame, name: str) -> str:
    """name, or it with underscores before it if docs has it."""
    while name in docs.columns:
        name = "_" + name
    return name


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "__score") -> DataFrame:
    """Columns keep of docs, and the score of each row's text under the name given."""

    def run(batches):
        for b in batches:
            s = pa.array(model.score(features(b.columns[-1])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], [*b.schema.names[:-1], name])

    from pyspark.sql.types import DoubleType, StructType

    kept = docs.select(*keep, F.col("text").alias(_free(docs, "__text")))
    schema = StructType([*docs.select(*keep).schema.fields]).add(name, DoubleType())
    return kept.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    name = _free(docs, "__score")
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= 0.5).drop(name)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL = {}
