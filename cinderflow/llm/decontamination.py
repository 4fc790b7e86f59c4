"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: words without punctuation in lower case, with numbers, units after
numbers, numbers with a unit attached, and names (capitalised words inside a sentence; a run is one name)
replaced by typed placeholders. Windows of WINDOW template tokens of benchmark and documents meet by an
equi-join on their hashes. Matches of a document and an item at one offset are checked for consistent slots:
the same placeholder value of the item must stand for one value of the document, and the reverse. So a question with other
numbers or names is caught, and text that only looks alike is not. An item leaks if consistent matches
cover LEAST_SHARE of its windows.

A capitalised word that opens a sentence may be a name or not, so every text is taken in three forms that only meet their
like: such words plain, such words names (which doesn't depend on where sentences begin), and all tokens literal, without
placeholders. A match in the literal form must cover the whole item, or LEAST_SHARE of an item that has no other window.

Before the join, documents' windows pass a bit table of the benchmark's hashes (BITS_EACH bits a window, MOST_BITS at most),
so almost only real matches are shuffled. The benchmark's windows are broadcast only up to
BROADCAST_WINDOWS rows; beyond that both sides are shuffled, a window that many documents hold in SALTS parts.

Edge cases
* null or empty text, or one without letters and digits: no window, clean. Items like that never match.
* items shorter than WINDOW: one window of their length, at least SHORTEST tokens; shorter ones are not judged.
* a window needs PLAIN tokens that are no placeholders (all but one where it is shorter than that); literal ones have none.
* repeated rows, null ids: every row is judged by itself. Empty tables: everything is clean, or an empty result.
* a passage repeated often in a document counts once for each of the item's windows.
* extra columns are left out of contaminated() and kept by clean().
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm import textkernel as K
from cinderflow.storage import settled, without, written

WINDOW, SHORTEST, PLAIN, LEAST_SHARE = 8, 4, 4, 0.3
BITS_EACH, LEAST_BITS, MOST_BITS, BROADCAST_WINDOWS, SALTS = 64, 1 << 20, 1 << 28, 200_000, 16
FORMS = OPENERS_PLAIN, OPENERS_NAMES, LITERAL = 0, 1, 2
#: Units of measure, money and time, in lower case.
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs pound pounds ounce ounces oz ton tons tonne tonnes ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years percent dollar dollars usd euro euros eur cent cents degree degrees celsius fahrenheit volt volts watt watts kw kwh mph kmh hz khz mhz ghz kb mb gb tb"
_UNITS = np.array(sorted(set(K.hash_text(UNITS))), np.uint64)
_NUMBER, _UNIT, _MEASURE, _NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1))
_ALNUM, _DIGIT, _CAPITAL, _END = (np.zeros(256, bool) for _ in range(4))
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_CAPITAL[65:91] = True
_END[list(b".!?:\n")] = True


def templates(data: np.ndarray, offsets: np.ndarray):
    """For each of FORMS: document, template hash, slot value (0 for plain words) of every template token."""
    keep = _ALNUM[data] | K._SPACE[data]
    origin = np.flatnonzero(keep)
    bare = data[keep]
    edges = np.searchsorted(origin, offsets)
    w = K.words(bare, edges)
    if not len(w.hash):
        z = np.zeros(0, np.uint64)
        yield from [(z.astype(np.int64), z, z)] * len(FORMS)
        return
    counted = lambda table: (t := np.concatenate([[0], np.cumsum(table[bare], dtype=np.int64)]))[w.end] - t[w.start]
    digits, capitals, size = counted(_DIGIT), counted(_CAPITAL), w.end - w.start
    first = bare[w.start]
    second = bare[np.minimum(w.start + 1, len(bare) - 1)]
    capital = _CAPITAL[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (size > 1))
    ends = np.concatenate([[0], np.cumsum(_END[data], dtype=np.int64)])
    begin, stop = origin[w.start], origin[w.end - 1] + 1
    opens = np.ones(len(w.hash), bool)
    opens[1:] = (w.doc[1:] != w.doc[:-1]) | (ends[begin[1:]] > ends[stop[:-1]])
    number = digits == size
    measure = (digits > 0) & ~number
    unit = np.isin(w.hash, _UNITS)
    unit[1:] &= number[:-1] & (w.doc[1:] == w.doc[:-1])
    unit[:1] = False
    names = capital & ~measure & (size > 1) & (capitals < np.maximum(size, 2))
    for name in (names & ~opens, names):
        token, slot = w.hash.copy(), np.zeros(len(w.hash), np.uint64)
        for kind, mark in ((number, _NUMBER), (unit, _UNIT), (measure, _MEASURE), (name, _NAME)):
            token[kind], slot[kind] = mark, w.hash[kind]
        # The later words of a name add to its value and go.
        follows = np.zeros(len(name), bool)
        follows[1:] = name[1:] & name[:-1] & (w.doc[1:] == w.doc[:-1]) & ~opens[1:]
        if follows.any():
            heads = np.cumsum(~follows) - 1
            whole = np.zeros(int(heads[-1]) + 1, np.uint64)
            np.add.at(whole, heads, K.mix(slot))
            slot = np.where(name, whole[heads], slot)
        stay = ~follows
        yield w.doc[stay].astype(np.int64), token[stay], slot[stay]
    yield w.doc.astype(np.int64), w.hash, np.zeros(len(w.hash), np.uint64)


def windows(data: np.ndarray, offsets: np.ndarray, lengths: list[list[int]], whole_if_short: bool = False):
    """For each of FORMS: document, place, hash, start and length of template windows of its lengths, and the slots of all
    tokens; for items: of WINDOW, or of the whole if shorter."""
    n = len(offsets) - 1
    for form, (doc, token, slot) in zip(FORMS, templates(data, offsets), strict=True):
        sizes = np.bincount(doc, minlength=n)
        first = np.cumsum(sizes) - sizes
        plain = np.concatenate([[0], np.cumsum(slot == 0)])
        out = []
        for k in lengths[form]:
            m = len(token) - k + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(k + (form << 8)))
            for i in range(k):
                h += token[i : i + m] * K._PLACES[i]
            fit = (doc[:m] == doc[k - 1 :]) & (plain[k : k + m] - plain[:m] >= min(PLAIN, k - 1))
            if whole_if_short:
                fit &= (sizes[doc[:m]] == k) if k < WINDOW else True
            at = np.flatnonzero(fit)
            out.append((doc[at], at - first[doc[at]], K.mix(h[at]), at, np.full(len(at), k)))
        if out:
            yield form, *(np.concatenate(x) for x in zip(*out, strict=True)), slot


_HIT = "array<struct<h:long,place:int,slots:array<long>>>"


def _hits(lengths: list[list[int]], bits: np.ndarray):
    """For every document: its windows that may be the benchmark's."""
    mask = np.uint64(8 * len(bits) - 1)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.int64()))]))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            data, offsets = K.flat(b.column("text"))
            for i, j in K.parts(offsets):
                found = [[] for _ in range(j - i)]
                for _, doc, place, h, at, size, slot in windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths):
                    cell = h & mask
                    for k in np.flatnonzero(bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1):
                        s = slot[at[k] : at[k] + size[k]]
                        found[doc[k]].append({"h": int(h[k].view(np.int64)), "place": int(place[k]), "slots": s.view(np.int64).tolist()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(found, kind)], ["row", "doc_id", "hits"]
                )
                row += j - i

    return run


def _items(batches):
    """Windows of benchmark items."""
    for b in batches:
        data, offsets = K.flat(b.column("text"))
        ids = b.column("item_id").cast(pa.int64())
        judged = np.zeros(len(offsets) - 1, bool)
        for form, doc, place, h, at, size, slot in windows(data, offsets, [list(range(SHORTEST, WINDOW + 1))] * len(FORMS), True):
            count = np.bincount(doc, minlength=len(offsets) - 1)
            whole = judged[doc] & (form == LITERAL)
            judged[doc] = True
            slots = [slot[a : a + k].view(np.int64).tolist() for a, k in zip(at, size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), pa.array(np.full(len(doc), form, np.int32)), pa.array(whole), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array(count[doc].astype(np.int32)), pa.array(size.astype(np.int32))],
                ["item_id", "form", "whole", "h", "item_place", "item_slots", "windows", "size"],
            )


def contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, contaminated, items (ids of leaked items, ascending), n_windows (benchmark windows matched, of each item in its best form): a row for each of docs."""
    asked = benchmark.select("item_id", "text").mapInArrow(
        _items, "item_id long, form int, whole boolean, h long, item_place int, item_slots array<long>, windows int, size int"
    )
    asked = written(asked, "benchmark-windows")
    windows_ = asked.count()
    bits = 1 << (min(MOST_BITS, max(LEAST_BITS, BITS_EACH * windows_)) - 1).bit_length()
    # Words of 64 bits that have any: no more than the benchmark has windows, 4 million (64 MB) at most; the table itself is 32 MB at most.
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = asked.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("v")).toArrow()
    table = np.zeros(-(-bits // 64), "<i8")
    table[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    seen = asked.select("form", "size").distinct().collect()
    lengths = [sorted(r["size"] for r in seen if r["form"] == form) for form in FORMS]
    read = settled(docs.select("doc_id", "text"), "decontamination-docs")
    rows = read.mapInArrow(K.trimmed(_hits(lengths, table.view(np.uint8))), f"row long, doc_id long, hits {_HIT}")
    rows = written(rows, "hits")
    # Only documents with hits are joined and grouped.
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    if windows_ <= BROADCAST_WINDOWS:
        hits = hits.join(F.broadcast(asked), "h")
    else:
        parts = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(parts, ["h", "_part"]).drop("_part")
    # Slots that are no placeholders are 0 on both sides.
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d"))), lambda x: x["i"] != 0)
    at = hits.groupBy("row", "item_id", "form", "whole", "windows", (F.col("place") - F.col("item_place")).alias("offset")).agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs")
    )
    apart = lambda k: F.size(F.array_distinct(F.transform("pairs", lambda x: x[k])))
    sound = (apart("i") == F.size("pairs")) & (apart("d") == F.size("pairs"))
    by_form = at.groupBy("row", "item_id", "form", "whole", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.when(sound, F.col("places")))))).alias("n"))
    share = F.when(F.col("whole"), 1.0).otherwise(least_share)
    by_item = by_form.groupBy("row", "item_id").agg(F.max(F.col("n") >= F.greatest(F.lit(1.0), F.col("windows") * share)).alias("reached"), F.max("n").alias("n"))
    leaked = F.array_sort(F.collect_set(F.when(F.col("reached"), F.col("item_id")))).alias("items")
    told = by_item.where("item_id is not null").groupBy("row").agg(leaked, F.sum("n").alias("n_windows"))
    out = rows.select("row", "doc_id").join(told, "row", "left").select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    return without(docs, contaminated(docs, benchmark).where("contaminated").select("doc_id"), "doc_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE_SQL = {}
