"""Mixing sources to target weights: blocks, slots, permutations, and a join by block index.

1. The words of each source stand in one sequence (documents in a pseudorandom but fixed order) and
   are packed into blocks of BLOCK words; only the last block of a source may be shorter.
2. A source's target gives the words to take: whole passes over all its blocks, then a part of one
   more pass. Each word to take lies in a slot; a slot is one block.
3. Output shards. For each source the number of its slots in every shard is drawn: one draw a slot over the
   shards, so the counts of a shard's sources are multinomial given the sources' totals, which meet the targets within a
   block. Slots are numbered shard by shard from these counts.
4. In each pass a keyed permutation of the source's block indices (Feistel rounds with cycle walking)
   maps the slot to a block, and slots are joined to the blocks' documents by (source, block). So each shard takes a
   pseudorandom set of each source's blocks. A slot's place in its shard is a draw as well; write() orders by it.

All is DataFrame functions. Offsets come from two-level prefix sums over hashed buckets, so no source,
however large, is ordered in one task.

Edge cases
* null text or one without words: size 0, taken 0, the row stays; null source: a source of its own, last.
* all sizes 0, or no rows: targets 0, nothing taken.
* repeated rows, null doc_ids: each row counts as a document; only rows equal in all columns are interchangeable.
* one source: its target is all its words. A source whose target is thrice its size gives every word three times.
* extra columns of the input, whatever their names, are left out of the result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderflow.storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block; slots in an output shard on average; hashed buckets of a source's documents.
BLOCK, SHARD_SLOTS, BUCKETS = 64, 65_536, 1024
WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3
SEED = 20240229
_ROUNDS = 4


def _print(docs: DataFrame) -> Column:
    """A hash of a row's columns; null differs from empty, and maps count by their JSON."""
    cells = [F.to_json(docs[f.name]) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema]
    return F.xxhash64(*cells, F.concat(*[docs[c].isNull().cast("int").cast("string") for c in docs.columns]))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, print (of all columns), size, spot (a pseudorandom place in the source's order), bucket.

    Rows that agree in all columns are interchangeable, so no other identity is needed.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # The order follows what a mix reads, so that columns beside it change nothing.
    spot = F.xxhash64("doc_id", F.xxhash64("text", "source"), F.lit(SEED))
    kept = docs.select("doc_id", "source", _print(docs).alias("print"), size.alias("size"), spot.alias("spot"))
    return kept.withColumn("bucket", F.pmod("spot", F.lit(BUCKETS)).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, nr, source_size, target: a fill by weight in which no target exceeds most x its source's size.

    Sources are full in the order of cap / weight; a source is full if the level at which all later ones
    share what is left reaches its own ratio. That is one ordered pass over the sources (not the documents).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nr", F.lit(len(weights))) + 1).cast("int"))
    caps = by_source.withColumn("nr", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    filling = Window.orderBy("ratio", "nr")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    leveled = caps.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", left / F.sum("weight").over(after))
    marked = leveled.withColumn("full", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct("ratio", "nr", "level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * final["level"]))
    return marked.select("source", "nr", "source_size", target.alias("target"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with nr, source_size, target and start, the number of words before the document in its source."""
    s = sources.withColumnRenamed("source", "named")
    known = sizes.join(s, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    per_bucket = known.groupBy("nr", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("nr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("nr", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("nr", "bucket").orderBy("spot", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    begun = known.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return begun.join(bases, ["nr", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def _half_rounds(left, right, a, b, key):
    """Four half rounds of an additive Feistel network: a bijection of the a x b grid."""
    draw = lambda x, i: F.xxhash64(x, key, F.lit(i))
    left = F.pmod(left + F.pmod(draw(right, 0), a), a)
    right = F.pmod(right + F.pmod(draw(left, 1), b), b)
    left = F.pmod(left + F.pmod(draw(right, 2), a), a)
    right = F.pmod(right + F.pmod(draw(left, 3), b), b)
    return left * b + right


def permuted(slots: DataFrame) -> DataFrame:
    """slots (k, blocks, key) with block: where the permutation of 0 .. blocks - 1 named by key sends k.

    The grid is a = ceil(sqrt(blocks)) by b = ceil(blocks / a), so fewer than a of its cells lie beyond
    the last block. A cell beyond it is sent on until it falls below: at most a steps, hence always
    within 16 for up to 256 blocks; above, a chance of at most 16 ** -16 an index is left.
    """
    cell = lambda x: _half_rounds(F.floor(x / F.col("b")).cast("long"), F.pmod(x, F.col("b")), F.col("a"), F.col("b"), F.col("key"))
    grid = slots.withColumn("a", F.ceil(F.sqrt(F.col("blocks").cast("double"))).cast("long")).withColumn("b", F.ceil(F.col("blocks") / F.col("a")).cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.col("cell"), lambda x, _: F.when(x < F.col("blocks"), x).otherwise(cell(x)))
    return grid.withColumn("cell", cell(F.col("k"))).withColumn("block", F.when(F.col("cell") < F.col("blocks"), F.col("cell")).otherwise(walk)).drop("a", "b", "cell")


def planned(sources: DataFrame, block: int = BLOCK, shard_slots: int | None = None) -> DataFrame:
    """nr, source_size, blocks, whole (passes over all blocks), rest (words of one more), slots, shards (of all sources together)."""
    q, size = F.round("target").cast("long"), F.col("source_size")
    return (
        sources.where("source_size > 0 and target >= 0.5")
        .select("nr", size, F.ceil(size / block).cast("long").alias("blocks"), F.floor(q / size).cast("long").alias("whole"), F.pmod(q, size).alias("rest"))
        .withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")).where("slots > 0")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(0))) / (shard_slots or SHARD_SLOTS))).cast("long"))
    )


def shard_counts(plan: DataFrame) -> DataFrame:
    """plan with shard, count (slots of the source in the shard) and first (slots of the source in earlier shards), for each source and shard that has any.

    A shard is drawn for every slot and counted before the shuffle: what is shuffled and ordered is a row a source and shard.
    """
    # Two steps, so that no array holds more than 65,536 slots and a hot source spreads over the tasks.
    chunks = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / 65536).cast("long"))).alias("chunk")).repartition("nr", "chunk")
    first = F.col("chunk") * 65536
    slots = chunks.select("*", F.explode(F.sequence(first, F.least(first + 65535, F.col("slots") - 1))).alias("slot"))
    shard = F.pmod(F.xxhash64("nr", "slot", F.lit(SEED + 1)), F.col("shards"))
    counts = slots.groupBy(*plan.columns, shard.alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    earlier = Window.partitionBy("nr").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0)))


def drawn(sources: DataFrame, block: int = BLOCK, shard_slots: int | None = None) -> DataFrame:
    """nr, turn (pass over the source), k, shard, place (its order there), block, upto (words taken of the block, from its start)."""
    filled = shard_counts(planned(sources, block, shard_slots)).repartition("nr", "shard")
    slots = filled.select("*", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("slot"))
    told = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("k", F.pmod("slot", F.col("blocks"))).withColumn("key", F.xxhash64("nr", "turn", F.lit(SEED)))
    upto = F.when(F.col("turn") < F.col("whole"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("k") * block))
    place = F.xxhash64("nr", "slot", F.lit(SEED + 2))
    return permuted(told).select("nr", "turn", "k", "shard", place.alias("place"), "block", upto.cast("long").alias("upto"))


def pieces(documents: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each part of a placed document that a slot takes, and one without shard for each that no slot does.

    Of a document's words, those from ``low`` to before ``high`` (counted in the document) fall to the slot.
    """
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    parts = documents.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block).cast("long"), last))).alias("block"))
    # The planner takes the exploded slots for as small as the sources they come from and would broadcast them.
    met = parts.join(drawn(sources, block).hint("merge"), ["nr", "block"], "left")
    at = F.col("block") * block - F.col("start")
    low, high = F.greatest(at, F.lit(0)), F.least(at + F.col("upto"), F.col("size"))
    return met.withColumn("low", low).withColumn("high", F.when(F.col("upto").isNull(), F.col("low")).otherwise(F.greatest(low, high)))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (output shards that take words of it): one row for each document."""
    sizes = written(sized(docs), "mix-sizes")
    sources = targets(sizes)
    found = pieces(placed(sizes, sources), sources)
    key = ["doc_id", "print", "nr", "start", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0)).cast("long")
    used = F.size(F.collect_set(F.when(F.col("high") > F.col("low"), F.col("shard")))).cast("long")
    return found.groupBy(*key).agg(taken.alias("taken"), used.alias("shards"), F.count(F.when(F.col("size") == 0, 1)).alias("empties")).select(
        "doc_id", "size", "source_size", "target", "taken", "shards", F.explode(F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.col("empties")).cast("int"))).alias("_")
    ).drop("_")


def _mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, with __at: shard and place of the first slot that takes words of the document in the pass."""
    sizes = written(sized(docs), "mix-sizes")
    sources = targets(sizes)
    took = pieces(placed(sizes, sources), sources).where("high > low")
    rows = took.groupBy("doc_id", "print", "nr", "start", "size", "turn").agg(
        F.sum(F.col("high") - F.col("low")).alias("n"), F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"), F.min(F.struct("low", "shard", "place")).alias("at")
    ).select("doc_id", "print", F.when(F.col("n") < F.col("size"), F.col("ranges")).alias("__ranges"), F.struct("at.shard", "at.place").alias("__at"))
    # Plain keys, with the null ids in the print, let one exchange of the texts serve both the repeats and the join.
    key, mark = F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull()
    rows = rows.select(key.alias("__id"), F.xxhash64("print", mark).alias("__print"), "__ranges", "__at")
    texts = docs.withColumns({"__id": key, "__print": F.xxhash64(_print(docs), mark)})
    # Rows equal in all columns are one here; the rows of the plan bring each back.
    texts = texts.dropDuplicates(["__id", "__print"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = lambda w: F.transform("__ranges", lambda r: F.array_join(F.slice(w, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")), " "))
    # A lambda's body is evaluated for each element: the words are bound once, not split again for each range.
    slices = F.flatten(F.transform(F.array(words), cut))
    text = F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(F.array_join(slices, " "))
    met = texts.join(rows, ["__id", "__print"])
    out = met.select(*[text.alias(c) if c == "text" else texts[c] for c in docs.columns], "__at")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass that takes words of it, with those words as its text.

    A pass that takes a whole document leaves its text untouched.
    """
    return _mixed(docs).drop("__at")


def write(docs: DataFrame, path: str) -> None:
    """Writes mixed(docs) as Parquet, a folder ``shard=N`` for each output shard, rows by their place in it."""
    rows = _mixed(docs).select(*docs.columns, F.col("__at.shard").alias("shard"), F.col("__at.place").alias("__place"))
    rows.repartition("shard").sortWithinPartitions("shard", "__place").drop("__place").write.partitionBy("shard").parquet(path)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {}
