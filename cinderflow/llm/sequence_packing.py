"""Best-fit packing: documents' token ids in as few sequences as vector best fit finds.

A sequence has three capacities: tokens, documents (pieces), and attention cost (the sum of squared lengths of its pieces). Documents
longer than a piece may be (the tokens, or the root of the cost) are cut; all pieces are packed, longest first, each into the open sequence that holds it under
every capacity and fits best: the least weighted residual (rule "norm") or the greatest weighted dot product of the piece's
demands and the sequence's residuals (rule "dot"), both in shares of the capacities.

A piece's demands follow from its length alone. So the plan needs no pieces, only how many there are of each length: at most as many
numbers as a sequence has tokens, whatever the corpus, and it is the plan that best fit gives over all pieces at once. Sequences in equal state are one
group of the plan, filled together. A plan row says which pieces of a length, by their number among all of that length, go
where. Pieces are numbered where they are made: by task and within the task; how many of a length the earlier tasks made is a small table.
So the whole corpus is packed without a sort and without a group that grows: one join of narrow rows by (task, length).

Edge cases
* null or empty text: a piece of the end id alone. No rows: no pieces.
* null doc_id, repeated doc_ids, repeated rows: rows of their own.
* a text of many sequences' tokens: pieces of the largest length, and a shorter one at its end.
* capacities that bind: tested; with the query's (as many documents as tokens, the squared tokens as cost) only tokens bind.
* extra columns, whatever their names, are left out.
"""

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderflow.llm.textkernel import trimmed
from cinderflow.llm.token_ids import _slices, _together, encode_column
from cinderflow.storage import written

END_ID = 1
_PIECE = "doc_id long, piece int, start long, length int, part int, number long, ids binary"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096**2
    #: Weights of tokens, documents and cost in the choice of a sequence.
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents, self.cost) < 1 or self.rule not in ("norm", "dot"):
            raise ValueError(f"capacities are whole numbers above 0, the rule is norm or dot: {self}")

    @property
    def longest(self) -> int:
        """Tokens of a piece at most."""
        return min(self.tokens, isqrt(self.cost))


#: Of a plan: pieces numbered from (and below to) of a length go, `each` to a sequence, from sequence `first` on, at `offset` and behind.
_PLAN = np.dtype([("length", "<i8"), ("from", "<i8"), ("to", "<i8"), ("first", "<i8"), ("each", "<i8"), ("offset", "<i8")])


class _Open:
    """Groups of open sequences in equal state: number of the first, how many, residual tokens, documents and cost."""

    def __init__(self, cap: Capacity) -> None:
        self.cap, self.rows = cap, np.zeros((0, 5), np.int64)
        self.shares = np.array(cap.weights) / np.array([cap.tokens, cap.documents, cap.cost], float)

    def best(self, length: int) -> int | None:
        """The group whose sequences hold a piece of this length and fit it best."""
        need = np.array([length, 1, length * length])
        fit = np.flatnonzero((self.rows[:, 2:] >= need).all(1))
        if not len(fit):
            return None
        left = self.rows[fit, 2:]
        if self.cap.rule == "norm":
            return int(fit[np.argmin((left - need) @ self.shares)])
        return int(fit[np.argmax((left / [self.cap.tokens, self.cap.documents, self.cap.cost]) @ (need * self.shares))])

    def fill(self, at: int, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """Puts pieces into group `at`, as piece by piece would: (pieces, first sequence, each, offset) of what it takes."""
        first, n, tokens, documents, cost = (int(x) for x in self.rows[at])
        # By residual, the sequence that has just taken a piece is the best for the next; by dot product it is the worst.
        each = min(tokens // length, documents, cost // (length * length)) if self.cap.rule == "norm" else 1
        full = min(n, count // each)
        rest = count - full * each if full < n else 0
        rows, took = [], []
        if full:
            took.append((full * each, first, each, self.cap.tokens - tokens))
            rows.append((first, full, each))
        if rest:
            took.append((rest, first + full, rest, self.cap.tokens - tokens))
            rows.append((first + full, 1, rest))
        used = full + bool(rest)
        if n > used:
            rows.append((first + used, n - used, 0))
        made = np.array([(f, m, tokens - k * length, documents - k, cost - k * length * length) for f, m, k in rows], np.int64)
        self.rows = np.concatenate([self.rows[:at], self.rows[at + 1 :], made[(made[:, 2:] > 0).all(1)]])
        return took

    def open(self, first: int, n: int) -> None:
        self.rows = np.concatenate([self.rows, [[first, n, self.cap.tokens, self.cap.documents, self.cap.cost]]])


def plan(counts: dict[int, int], cap: Capacity) -> np.ndarray:
    """Rows of the plan for so many pieces of each length, by (length, from)."""
    held, out, sequences = _Open(cap), [], 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            at = held.best(length)
            if at is None:
                each = min(cap.tokens // length, cap.documents, cap.cost // (length * length))
                new = -(-left // each) if cap.rule == "norm" else 1
                held.open(sequences, new)
                sequences += new
                at = len(held.rows) - 1
            for took, first, each, offset in held.fill(at, length, left):
                out.append((length, number, number + took, first, each, offset))
                number, left = number + took, left - took
    return np.sort(np.array(out, _PLAN), order=["length", "from"])


def _pieces(tokenizer: str, end_id: int, longest: int):
    """Pieces of texts, numbered by length within the task."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for batch in _together(batches):
            for i, column in _slices(batch.column("text")):
                flat, starts = encode_column(tokenizer, column, end_id)
                sizes = np.diff(starts)
                pieces = -(-sizes // longest)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * longest
                length = np.minimum(longest, sizes[doc] - start)
                order = np.argsort(length, kind="stable")
                by_length = np.bincount(length, minlength=longest + 1)
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - np.repeat(np.cumsum(by_length) - by_length, by_length)
                number += seen[length]
                seen += by_length
                at = starts[:-1][doc] + start
                ids = flat.astype("<u4")
                raw = pa.array([ids[a:b].tobytes() for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], pa.binary())
                doc_id = batch.column("doc_id").slice(i, len(column)).cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(number), raw],
                    [x.split()[0] for x in _PIECE.split(", ")],
                )

    return run


def _placed(rows: np.ndarray):
    """sequence_id and offset from a piece's length and its number among all of that length."""
    lengths, begins = np.unique(rows["length"], return_index=True)
    begins = np.append(begins, len(rows))

    def run(batches):
        for b in batches:
            length, number = b.column("length").to_numpy().astype(np.int64), b.column("nth").to_numpy()
            at = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                k = np.searchsorted(lengths, value)
                at[mine] = begins[k] + np.searchsorted(rows["from"][begins[k] : begins[k + 1]], number[mine], "right") - 1
            chosen = rows[at]
            nth = number - chosen["from"]
            sequence, offset = chosen["first"] + nth // chosen["each"], chosen["offset"] + nth % chosen["each"] * length
            kept = [c for c in b.schema.names if c != "nth"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, cap: Capacity | None = None, end_id: int = END_ID, ids: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of docs (doc_id, text).

    ids: little-endian unsigned 32-bit ids as bytes, or the given column over them (it is taken before the join, which then moves no ids).
    """
    cap = cap or Capacity()
    pieces = written(docs.select("doc_id", "text").mapInArrow(trimmed(_pieces(tokenizer, end_id, cap.longest)), _PIECE), "pieces", compression="zstd")
    made = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # lengths, as many as a piece has tokens at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = made.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    narrow = pieces.select("doc_id", "piece", "start", F.col("length"), "part", "number", (F.col("ids") if ids is None else ids).alias("ids"))
    met = narrow.join(bases, ["part", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", (F.col("number") + F.col("base")).alias("nth"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name != "nth")
    return met.mapInArrow(_placed(plan(counts, cap)), f"{kinds}, sequence_id long, offset long")


def _joined(key, table):
    table = table.take(pc.sort_indices(table, [("offset", "ascending")]))
    ids = np.frombuffer(b"".join(x.as_py() for x in table.column("ids")), "<u4").astype(np.int64)
    lists = lambda v, kind: pa.array([v], pa.list_(kind))
    return pa.table(
        {
            "sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": lists(ids, pa.int64()),
            "doc_ids": lists(table.column("doc_id").to_pylist(), pa.int64()), "starts": lists(table.column("start").to_pylist(), pa.int64()), "offsets": lists(table.column("offset").to_pylist(), pa.int64()),
        }
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and doc_ids, starts, offsets of its pieces, in order: the training rows of pack()'s result."""
    return packed.select("sequence_id", "doc_id", "start", "offset", "ids").groupBy("sequence_id").applyInArrow(_joined, "sequence_id long, ids array<long>, doc_ids array<long>, starts array<long>, offsets array<long>")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")), ids=F.crc32("ids"))
    return packed.withColumnRenamed("ids", "ids_crc32")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
#: A tokenizer has no SQL; the tests compare with the library's ids and with best fit piece by piece.
ORACLE_SQL = {}
