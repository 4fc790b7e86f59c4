"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank by frequency in the corpus, so the common ones take one byte. Four ids
share a control byte (two bits each: length - 1); the data bytes stand apart from the control bytes, so
a reader turns control bytes into lengths by one table lookup and gathers all values with numpy.

Files (below ``<path>/blocks``): blocks, each followed by a line feed. A block holds documents of one shard,
in ascending doc_id order:

    magic b"CFTB", then little-endian: shard u32, number in the shard u32, documents u32, control bytes u64,
    data bytes u64; then for each document: doc_id i64, is it null u8, ids u32; control bytes; data bytes.

``<path>/ranks`` is one such file of one block: magic b"CFTR", count u32, the ids by rank as u32.

Shards are ranges of doc_id (then of length and checksum, so that one id may hold many rows), so ascending shard, block and place is ascending doc_id over the whole corpus.
Writing goes through Spark's own file writers (any file system Spark can reach, task commit and retry
included); every block is a few megabytes, so no task holds a shard.

Words (by ASCII white space) do not influence one another in the tokenizers this is for (they drop white
space and never merge over it), so each batch's distinct words are encoded once and texts are put
together from them.

Edge cases
* null or empty text: only the end id. No rows: no blocks, an empty result.
* null doc_id: before all others. Repeated doc_ids: in the order of their length and their ids' checksum; rows stay apart.
* blocks are arbitrary bytes that go through the text writer as strings: Spark writes a string's bytes as they are. The tests
  read the exact bytes back.
* very long text: encoded by slices of its words; a block holds at least one document.
* extra columns, whatever their names, are left out.
"""

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderflow.llm.textkernel import trimmed
from cinderflow.storage import fresh_path, sized, written

END_ID = 2
#: Bytes of input for a shard: their number follows the data, so a task's share doesn't; beyond MOST_SHARDS (1.6 TB) shards grow
#: instead, as each meets every map task in the exchange. A task streams its shard, so its memory doesn't grow.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 100_000
#: Text bytes encoded at a time, and bytes after which a block ends.
SLICE_BYTES, BLOCK_BYTES, BLOCKS_PER_FILE = 8 << 20, 4 << 20, 4
#: Distinct words given to the tokenizer in one call.
AT_A_TIME = 4000
_HEADER = struct.Struct("<4sIIIQQ")
#: For every control byte: the lengths of its four values.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])


#: Bytes that a word may end with without bearing on the letters before (ASCII punctuation but the apostrophe).
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_SIMPLE = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _letters_only(path: str):
    """The library's model behind a plain split, for words of letters that need no other normalising; None if the
    tokenizer is not of the kind whose steps leave lower-case Latin letters alone (byte-level over NFC and lower case)."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Split

    whole = _tokenizer(path)
    # The steps' own descriptions: the tokenizer as JSON would hold its vocabulary once more.
    steps, before = repr(whole.normalizer), repr(whole.pre_tokenizer)
    plain = re.fullmatch(r"Sequence\(normalizers=\[NFC\(\), Replace\(.*\), Lowercase\(\)\]\)", steps) and re.fullmatch(r"Sequence\(pretokenizers=\[Split\(.*\), ByteLevel\(add_prefix_space=False.*\)\]\)", before)
    if not plain or whole.post_processor:
        return None
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = Split(" ", "removed")
    return bare


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own byte, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def gather(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[at[k]:at[k + 1]] for k in which, one after another, and where each begins."""
    lengths = np.diff(at)[which]
    ends = np.cumsum(lengths)
    # Places fit in four bytes: a slice is a few megabytes, a single text two gigabytes at most.
    place = np.repeat((at[:-1][which] - (ends - lengths)).astype(np.int32), lengths)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place], np.concatenate([[0], ends])


def _one_by_one(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    tokenizer = _tokenizer(path)
    ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for i in range(0, len(found), AT_A_TIME):
        each = [x.ids for x in tokenizer.encode_batch_fast(found[i : i + AT_A_TIME], add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids.append(np.fromiter((i for x in each for i in x), np.uint32, int(lengths[-1].sum())))
    return np.concatenate(ids), np.cumsum(np.concatenate(lengths))


def _letters(bare, spelt: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of letters, and where each word's begin; so many at a time, as the library keeps far more than ids of each token."""
    ids, at, base = [np.zeros(0, np.uint32)], [], 0
    for i in range(0, len(spelt), AT_A_TIME):
        part = spelt[i : i + AT_A_TIME]
        got = bare.encode(" ".join(part), add_special_tokens=False)
        ids.append(np.array(got.ids, np.uint32))
        at.append(base + np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part))))
        base += len(ids[-1])
    return np.concatenate(ids), np.concatenate([*at, [base]]).astype(np.int64)


def encode_distinct(path: str, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all given words one after another, and where each word's ids begin (and the last end).

    A word of Latin letters, perhaps with punctuation at its end, is the ids of its lower-cased letters and those of
    the punctuation: the tokenizer cuts between the two. Its letters go to the model without the other steps.
    """
    bare = _letters_only(path)
    if bare is None:
        return _one_by_one(path, found.to_pylist())
    stems = pc.utf8_rtrim(found, characters=_TAIL)
    simple = pc.match_substring_regex(stems, _SIMPLE).to_numpy(zero_copy_only=False)
    quick = pa.array(simple)
    lows = pc.utf8_lower(stems.filter(quick)).dictionary_encode()
    letters = lows.dictionary.to_pylist()
    table = _byte_letters()
    spelt = [x if x.isascii() else x.encode().decode("latin-1").translate(table) for x in letters]
    stem_ids, stem_at = _letters(bare, spelt)
    tails = pc.replace_substring_regex(found.filter(quick), r"^\p{L}+", "").dictionary_encode()
    others = found.filter(pc.invert(quick)).to_pylist()
    more_ids, more_at = _one_by_one(path, [*tails.dictionary.to_pylist(), *others])
    # every word is two runs: letters then punctuation, or an empty one then the whole word
    ids = np.concatenate([stem_ids, more_ids])
    at = np.concatenate([stem_at, more_at[1:] + stem_at[-1]])
    runs = np.empty((len(found), 2), np.int64)
    empty = len(at) - 1
    at = np.append(at, at[-1])
    runs[simple, 0] = lows.indices.to_numpy(zero_copy_only=False)
    runs[simple, 1] = len(spelt) + tails.indices.to_numpy(zero_copy_only=False)
    runs[~simple, 0] = empty
    runs[~simple, 1] = len(spelt) + len(tails.dictionary) + np.arange(len(others))
    flat, starts = gather(ids, at, runs.ravel())
    return flat, starts[::2]


def _worded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For texts: word number of every word, where each text's words begin, and the distinct words."""
    lists = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    # white space at the ends of a text gives an empty word, which has no ids
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary


def _slices(column: pa.Array):
    """The column by pieces of about SLICE_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield i, column.slice(i, j - i)
        i = j


def encode_column(path: str, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with its end id, and where each text's ids begin."""
    which, first, found = _worded(column)
    flat, word_at = gather(*encode_distinct(path, found), which)
    ends = word_at[first[1:]]
    return np.insert(flat, ends, end_id), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def _bits(ranks: np.ndarray) -> np.ndarray:
    return (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    codes = _bits(ranks)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), as_bytes[np.arange(4) <= codes[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of a block's documents, one after another; counts: ids of each document."""
    groups = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1)
    ends = np.cumsum(groups * 4)
    # places behind a document's last id, in its last control byte, hold no value
    pad = groups * 4 - counts
    real = np.ones(len(lengths), bool)
    for k in (1, 2, 3):
        real[ends[pad >= k] - k] = False
    lengths = lengths[real].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    padded = np.append(data, np.zeros(3, np.uint8))
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _together(batches):
    """Batches put together to about SLICE_BYTES, as more texts have fewer distinct words each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokenized(path: str):
    """doc_id and the ids of each text: two bytes an id, four where two don't hold the document's largest."""

    def run(batches):
        for batch in _together(batches):
            for i, column in _slices(batch.column("text")):
                flat, starts = encode_column(path, column)
                small = flat.astype("<u2")
                wide = np.add.reduceat(flat > 0xFFFF, starts[:-1]) > 0
                raw = [flat[a:b].astype("<u4").tobytes() if w else small[a:b].tobytes() for a, b, w in zip(starts[:-1], starts[1:], wide, strict=True)]
                doc_id = batch.column("doc_id").slice(i, len(column)).cast(pa.int64())
                crc = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(starts).astype(np.int32)), crc, pa.array(raw, pa.binary())], ["doc_id", "n", "crc", "ids"])

    return run


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        held = [_ids(n, x) for n, x in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
        n = np.bincount(np.concatenate(held), minlength=len(total))
        total = np.concatenate([total, np.zeros(max(0, len(n) - len(total)), np.int64)])
        total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])


def block(shard: int, number: int, held: list[tuple]) -> pa.RecordBatch:
    """One block of documents (id, ids, control, data)."""
    docs = np.zeros(len(held), _DOC)
    docs["id"] = [x[0] or 0 for x in held]
    docs["null"] = [x[0] is None for x in held]
    docs["n"] = [x[1] for x in held]
    control, data = b"".join(x[2] for x in held), b"".join(x[3] for x in held)
    whole = _HEADER.pack(b"CFTB", shard, number, len(held), len(control), len(data)) + docs.tobytes() + control + data
    return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["block"])


def _blocks(ids_by_rank: np.ndarray):
    """Blocks of a shard's rows, which come in their order; the shard is the task's partition."""
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)

    def run(batches):
        from pyspark import TaskContext

        shard, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                held.append((doc_id, n, *pack(rank_of[_ids(n, ids)])))
                size += len(held[-1][2]) + len(held[-1][3])
                if size > BLOCK_BYTES:
                    yield block(shard, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(shard, number, held)

    return run


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the ids of docs (doc_id, text) below path."""
    spark = docs.sparkSession
    docs, size = sized(docs.select("doc_id", "text"), "token-docs")
    # Tokenized once: the ids are counted and encoded from a table in the shared folder.
    rows = written(docs.mapInArrow(trimmed(_tokenized(tokenizer)), "doc_id long, n int, crc long, ids binary"), "ids", compression="zstd")
    counts = rows.select("n", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most as many rows as the vocabulary has ids.
    ranked = [x["id"] for x in counts.orderBy(F.desc("n"), "id").collect()]
    table = struct.pack("<4sI", b"CFTR", len(ranked)) + np.array(ranked, "<u4").tobytes()
    spark.createDataFrame([(table,)], "block binary").coalesce(1).select(F.col("block").cast("string")).write.text(f"{path}/ranks")

    # Shards are ranges of doc_id, then of length and checksum: one id, or null, may hold many rows and still be split.
    shards = max(8, size // max(SHARD_BYTES, size // MOST_SHARDS))
    order = [F.asc_nulls_first("doc_id"), F.asc("n"), F.asc("crc")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = ordered.select("doc_id", "n", "ids").mapInArrow(trimmed(_blocks(np.array(ranked, np.int64))), "block binary").select(F.col("block").cast("string"))
    blocks.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{path}/blocks")


def parse(content: bytes):
    """Yields shard, number, documents' array, control and data of each block of a file."""
    at = 0
    while at < len(content):
        magic, shard, number, n, control, data = _HEADER.unpack_from(content, at)
        if magic != b"CFTB":
            raise ValueError("not a block of token ids")
        at += _HEADER.size
        docs = np.frombuffer(content, _DOC, n, at)
        at += docs.nbytes
        yield shard, number, docs, np.frombuffer(content, np.uint8, control, at), np.frombuffer(content, np.uint8, data, at + control)
        at += control + data + 1


def _decode(ids_by_rank: np.ndarray):
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for shard, number, docs, control, data in parse(content.as_buffer().to_pybytes()):
                    counts = docs["n"].astype(np.int64)
                    ids = ids_by_rank[unpack(control, data, counts)].astype("<u4")
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(docs), shard, np.int32)), pa.array(np.full(len(docs), number, np.int32)),
                            pa.array(docs["id"], mask=docs["null"] == 1), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64()),
                        ],
                        ["shard", "number", "doc_id", "begin", "n_tokens", "ids_crc32"],
                    )

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents written below path."""
    ranks = spark.read.format("binaryFile").load(f"{path}/ranks").select("content").first()["content"]
    ids_by_rank = np.frombuffer(ranks, "<u4", struct.unpack_from("<4sI", ranks)[1], 8)
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    rows = written(files.mapInArrow(_decode(ids_by_rank), "shard int, number int, doc_id long, begin long, n_tokens long, ids_crc32 long"), "token-rows")
    # Ids before a block: those of earlier shards (one row each) and of earlier blocks of its own shard.
    blocks = rows.groupBy("shard", "number").agg(F.sum("n_tokens").alias("n"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before(Window.orderBy("shard"))), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(before(Window.partitionBy("shard").orderBy("number"))), F.lit(0))
    bases = blocks.select("shard", "number", inner.alias("inner")).join(shards, "shard").select("shard", "number", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(bases, ["shard", "number"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(docs.sparkSession, "token-ids")
    write(docs, path, str(tokenizer))
    return read(docs.sparkSession, path)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_ids": op8_token_ids}
ORACLE_SQL = {}
