"""Hard-negative mining: scores of anchors and rows as a block matrix product, tile by tile.

Rows are dealt to key ranges of (label, vec_id) and cut there into blocks of BLOCK_ROWS, so most blocks hold one label, and a label with a third of all rows
is many blocks. Anchors, taken as they pass, are blocks of ANCHOR_ROWS of their own. A block's matrix is cut into chunks of dimensions,
CHUNKS at most. Blocks are written once.

A tile is an anchor block against a row block. Its parts, one a chunk, are computed where the two blocks' chunks meet (an equi-join by
shard of row blocks, chunk and share of anchor blocks; both sides are copied to the shards they are needed in). Vectors of up to CHUNK_DIMS
dimensions are one chunk: a tile's scores never leave the task. Only of longer ones are the parts shuffled as int64 scores to the tile and added.
Of a tile only its best rows go on:

1. tiles whose labels overlap: each anchor's first rows of its own label; over all tiles, its positives;
2. tiles whose labels differ somewhere: for each anchor and positive, the first rows of another label within the positive's window; over all tiles, its negatives.

So a pair of rows is scored once, but for the few blocks that hold several labels. Windows by anchor take partial limits before
their shuffle: a task sends as many rows of an anchor as are asked for, not one a tile.

Parts are multiplied as doubles where the largest components prove that all sums stay below 2^53, as int64 otherwise; either is exact (modulo 2^64).

Edge cases
* rows with a null label, a null vector, or null or non-finite components: left out. Labels are whole numbers.
* vectors of different lengths: a component that one of the two lacks adds nothing. Empty vectors score 0.
* null vec_id: never an anchor; a row like others, last among ties. Ties of equal vec_ids: in any order.
* repeated rows: rows of their own (a copy of an anchor may be its positive); repeated anchors each have their results.
* anchors without positives, or positives without rows in their window: no results. Scores below 0 have no window.
* no rows or no anchors: an empty result. Extra columns, whatever their names, are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderflow.llm.textkernel import trimmed
from cinderflow.llm.vectors import finite, whole
from cinderflow.storage import written

BLOCK_ROWS, ANCHOR_ROWS = 2048, 128
#: Dimensions of a chunk at least, and chunks at most: a tile's sum has so many parts at most.
CHUNK_DIMS, CHUNKS = 1024, 8
#: Row blocks of a shard, at first and from MANY_SHARDS on, and anchor blocks of a share, on average.
SHARD_BLOCKS, LARGE_SHARD_BLOCKS, MANY_SHARDS, SHARE_BLOCKS = 8, 32, 64, 256
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
_NONE = np.iinfo(np.int64).min
_BLOCK = "anchors boolean, block long, chunk int, n int, width int, x binary, most long, lo long, hi long, first long, ids array<long>, labels array<long>, rows array<long>"


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _lists(values, n: int, chunks: int) -> pa.Array:
    """values in the first chunk's row, null in the others'."""
    return pa.array([values, *[None] * (chunks - 1)], pa.list_(pa.int64()))


def _cut(dims: int, chunk: int):
    """Blocks of a task's rows (vec_id, label, anchor, x), which come by label; anchors also as blocks of their own."""
    cuts = [(a, min(dims, a + chunk)) for a in range(0, max(dims, 1), chunk)]

    def rows_of(anchors: bool, number: int, ids, labels, rows, x, first: int) -> pa.RecordBatch:
        parts = [_narrow(x[:, a:b]) for a, b in cuts]
        k = len(cuts)
        same = lambda v, kind=pa.int64(): pa.array([v] * k, kind)
        return pa.RecordBatch.from_arrays(
            [
                same(anchors, pa.bool_()), same(number), pa.array(range(k), pa.int32()), same(len(labels), pa.int32()), pa.array([p.itemsize for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
                pa.array([int(np.abs(p.astype(np.int64)).max(initial=0)) for p in parts], pa.int64()), same(int(labels.min())), same(int(labels.max())), same(first), _lists(ids, len(labels), k), _lists(labels.tolist(), len(labels), k), _lists(rows.tolist(), len(labels), k),
            ],
            [c.split()[0] for c in _BLOCK.split(", ")],
        )

    def run(batches):
        from pyspark import TaskContext

        part, seen, count = TaskContext.get().partitionId() << 40, 0, 0
        held, asked = _Held(dims), _Held(dims)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                held.add(b.slice(i, BLOCK_ROWS))
                while held.n >= BLOCK_ROWS:
                    yield from block(held.take(BLOCK_ROWS), part, seen, count, asked)
                    seen, count = seen + BLOCK_ROWS, count + 1
                while asked.n >= ANCHOR_ROWS:
                    yield rows_of(True, part + count, *asked.take(ANCHOR_ROWS)[:4], 0)
                    count += 1
        if held.n:
            yield from block(held.take(held.n), part, seen, count, asked)
            count += 1
        while asked.n:
            yield rows_of(True, part + count, *asked.take(min(asked.n, ANCHOR_ROWS))[:4], 0)
            count += 1

    def block(taken, part, seen, count, asked):
        ids, labels, _, x, anchor = taken
        # by vec_id, null last: of equal scores the first is to be taken
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        ids, labels, x, anchor = [ids[i] for i in order], labels[order], x[order], anchor[order]
        rows = part + seen + np.arange(len(ids))
        yield rows_of(False, part + count, ids, labels, rows[:0], x, int(rows[0]))
        at = np.flatnonzero(anchor)
        if len(at):
            asked.put([ids[i] for i in at], labels[at], rows[at], x[at], anchor[at])

    return run


class _Held:
    """Rows that wait to be cut into blocks."""

    def __init__(self, dims: int) -> None:
        self.dims, self.n, self.parts = dims, 0, []

    def add(self, b: pa.RecordBatch) -> None:
        sizes = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
        x = np.zeros((b.num_rows, self.dims), np.int64)
        x[np.arange(self.dims) < sizes[:, None]] = b.column("x").flatten().to_numpy(zero_copy_only=False)
        label = b.column("label").to_numpy(zero_copy_only=False)
        self.put(b.column("vec_id").to_pylist(), label, np.zeros(len(label), np.int64), x, b.column("anchor").to_numpy(zero_copy_only=False))

    def put(self, *part) -> None:
        self.parts.append(part)
        self.n += len(part[0])

    def take(self, n: int) -> tuple:
        """The first n rows: ids, labels, row numbers, matrix, anchor flags."""
        ids = [i for p in self.parts for i in p[0]]
        arrays = [np.concatenate([p[k] for p in self.parts]) for k in range(1, 5)]
        self.n -= n
        self.parts = [(ids[n:], *(a[n:] for a in arrays))] if self.n else []
        return ids[:n], *(a[:n] for a in arrays)


def blocks(rows: DataFrame, anchor: Column) -> tuple[DataFrame, int]:
    """Written blocks of rows (vec_id, label, x) and of those that are anchors, and the chunks they are cut into."""
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    dims = dims or 0
    chunk = max(CHUNK_DIMS, -(-dims // CHUNKS))
    tasks = max(1, -(-n // (4 * BLOCK_ROWS)))
    order = [F.asc("label"), F.asc_nulls_last("vec_id")]
    dealt = rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))).repartitionByRange(tasks, *order).sortWithinPartitions(*order).coalesce(tasks)
    return written(dealt.mapInArrow(trimmed(_cut(dims, chunk)), _BLOCK), "blocks", compression="zstd"), max(1, -(-dims // chunk))


#: What the best rows of a tile need beside scores.
_ABOUT = ("a_ids", "a_labels", "a_rows", "a_found", "b_ids", "b_labels", "b_first")


def _products(batches):
    """Of each row: anchor block, row block, and the product of the two blocks' chunks."""
    for b in batches:
        for i in range(b.num_rows):
            at = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "about"}
            p, q = (np.frombuffer(at[f"{x}_x"], f"<i{at[f'{x}_width']}").reshape(at[f"{x}_n"], -1) for x in "ab")
            if at["a_most"] * at["b_most"] * p.shape[1] < 1 << 53:
                tile = (p.astype(float) @ q.astype(float).T).astype("<i8")
            else:
                with np.errstate(over="ignore"):
                    tile = p.astype("<i8") @ q.astype("<i8").T
            yield at, tile, b, i


def _multiply(batches):
    """A part of a tile from the two blocks' chunks."""
    for at, tile, b, i in _products(batches):
        yield pa.RecordBatch.from_arrays([pa.array([at["a"]]), pa.array([at["b"]]), pa.array([tile.tobytes()], pa.binary()), b.column("about").slice(i, 1)], ["a", "b", "scores", "about"])


def met(anchors: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """The chunks of anchor blocks (a_...) and row blocks (b_...) that meet in the wanted tiles; about: ids and labels, with the first chunk."""
    (n_a,), (n_b,) = (x.where("chunk = 0").agg(F.count(F.lit(1))).first() for x in (anchors, rows))
    shards, shares = max(1, min(-(-n_b // SHARD_BLOCKS), max(MANY_SHARDS, -(-n_b // LARGE_SHARD_BLOCKS)))), max(1, -(-n_a // SHARE_BLOCKS))
    left = anchors.withColumns({"share": F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    right = rows.withColumns({"shard": F.pmod(F.xxhash64("b"), F.lit(shards)).cast("int"), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
    about = F.when(F.col("chunk") == 0, F.struct(*(c for c in (*anchors.columns, *rows.columns) if c in _ABOUT)))
    both = left.join(right, ["shard", "share", "chunk"]).where(wanted)
    return both.select("a", "b", "a_n", "b_n", "a_x", "b_x", "a_width", "b_width", "a_most", "b_most", about.alias("about"))


def _sum(table: pa.Table) -> np.ndarray:
    total = None
    for raw in table.column("scores"):
        part = np.frombuffer(raw.as_buffer(), "<i8")
        total = part.copy() if total is None else np.add(total, part, out=total)
    return total


def _best(scores: np.ndarray, fit: np.ndarray, k: int):
    """Of each line the k greatest scores that fit, the first of equal ones first: lines, columns, scores."""
    held, lines = np.where(fit, scores, _NONE), np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = held.argmax(1)
        top = held[lines, at]
        found = top > _NONE
        if not found.any():
            return
        yield lines[found], at[found], top[found]
        held[lines, at] = _NONE


_FOUND = "anchor long, anchor_id long, a long, line int, score long, vec_id long, row long"
_NEGATIVE = "anchor long, anchor_id long, positive int, positive_id long, positive_score long, score long, vec_id long, row long"


def _taken(values: list, at: np.ndarray) -> pa.Array:
    return pa.array([values[i] for i in at.tolist()], pa.int64())


def _positives(k: int):
    def run(key, scores, about):
        rows, a_rows = about["b_first"] + np.arange(scores.shape[1]), np.array(about["a_rows"], np.int64)
        fit = (np.array(about["a_labels"])[:, None] == np.array(about["b_labels"])) & (a_rows[:, None] != rows)
        for line, at, top in _best(scores, fit, k):
            yield pa.table(
                {
                    "anchor": pa.array(a_rows[line]), "anchor_id": _taken(about["a_ids"], line), "a": pa.array(np.full(len(line), key[0].as_py())), "line": pa.array(line.astype(np.int32)),
                    "score": pa.array(top), "vec_id": _taken(about["b_ids"], at), "row": pa.array(rows[at]),
                }
            )

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, positives: int, low: int, high: int):
    def run(key, scores, about):
        n = len(scores)
        apart = np.array(about["a_labels"])[:, None] != np.array(about["b_labels"])
        rows, a_rows = about["b_first"] + np.arange(scores.shape[1]), np.array(about["a_rows"], np.int64)
        for rank in range(1, positives + 1):
            of = {x["line"]: x for x in about["a_found"] if x["rank"] == rank}
            lo, hi = np.zeros((n, 1), np.int64), np.full((n, 1), _NONE)
            for line, x in of.items():
                bounds = window(x["score"], low, high)
                lo[line], hi[line] = np.clip(bounds, _NONE, np.iinfo(np.int64).max)
            for line, at, top in _best(scores, apart & (scores >= lo) & (scores <= hi), k):
                met = [of[i] for i in line.tolist()]
                yield pa.table(
                    {
                        "anchor": pa.array(a_rows[line]), "anchor_id": _taken(about["a_ids"], line), "positive": pa.array(np.full(len(line), rank, np.int32)),
                        "positive_id": pa.array([x["vec_id"] for x in met], pa.int64()), "positive_score": pa.array([x["score"] for x in met], pa.int64()),
                        "score": pa.array(top), "vec_id": _taken(about["b_ids"], at), "row": pa.array(rows[at]),
                    }
                )

    return run


def _tiles(pairs: DataFrame, chunks: int, best, schema: str) -> DataFrame:
    """The best rows of each tile: where it is computed if it is one part, else its parts are shuffled and added first."""
    fields = [x.split() for x in schema.split(", ")]
    empty = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in fields]).empty_table()

    def run(key, table):
        about = next(v.as_py() for v in table.column("about") if v.is_valid)
        scores = _sum(table).reshape(len(about["a_labels"]), -1)
        out = [t.select(empty.schema.names) for t in best(key, scores, about)]
        return pa.concat_tables(out) if out else empty

    def at_once(batches):
        for at, tile, b, i in _products(batches):
            for t in best((pa.scalar(at["a"]), pa.scalar(at["b"])), tile, b.column("about")[i].as_py()):
                yield from t.select(empty.schema.names).to_batches()

    if chunks <= 1:
        return pairs.mapInArrow(trimmed(at_once), schema)
    found = pairs.mapInArrow(trimmed(_multiply), f"a long, b long, scores binary, about {pairs.schema['about'].dataType.simpleString()}")
    return found.groupBy("a", "b").applyInArrow(run, schema)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, x as longs)."""
    both, chunks = blocks(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x"), anchor)
    named = lambda side, rows: both.where(rows).select(F.col("block").alias(side), "chunk", F.col("width").alias(f"{side}_width"), F.col("x").alias(f"{side}_x"), F.col("most").alias(f"{side}_most"), F.col("n").alias(f"{side}_n"), *(F.col(c).alias(f"{side}_{c}") for c in ("lo", "hi", "first", "ids", "labels", "rows")))
    a, b = named("a", "anchors"), named("b", "not anchors")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]

    overlap = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    best = _tiles(met(a, b, overlap), chunks, _positives(positives), _FOUND)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= positives)
    found = written(first.groupBy("a").agg(F.collect_list(F.struct("line", "rank", "vec_id", "score")).alias("a_found")), "positives")

    a = a.join(found, "a")
    mixed = (F.col("a_lo") != F.col("a_hi")) | (F.col("b_lo") != F.col("b_hi")) | (F.col("a_lo") != F.col("b_lo"))
    best = _tiles(met(a, b, mixed), chunks, _negatives(negatives, positives, low, high), _NEGATIVE)
    last = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))).where(F.col("rank") <= negatives)
    return last.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finite(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), whole("embedding", SCALE).alias("x")), F.col("vec_id") % EVERY == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
}
