"""LM scoring by Brown class-based n-grams: classes by exchange, class transitions, word emissions.

P(text) is the product over its tokens (the words, then one end) of
P(class | class before) * P(word | class). Learning uses the training documents only; all counts are of the whole corpus.

1. Every text becomes numbers of its chunk's distinct words, once; all later passes read these.
2. Every word is counted. Words of LEAST_COUNT occurrences or more are clustered, into a number of classes that grows with
   theirs (classes_for); rarer ones, and unknown words, fall into SHAPES classes by shape (Latin letters only or not, ending in
   a letter or not).
3. Start: the SEEDS most frequent words are clustered by exchange on their bigram counts.
4. Exchange sweeps over the whole clustered vocabulary, dealt by word: of every word it is counted how often each class
   stands before and after it, and the word moves to the class that raises the likelihood of the class bigrams most. The
   class bigrams are those at the beginning of the sweep (words move side by side), less the word's own. The first sweep places words by
   the seeds' classes; in later ones all words move, seeds too. Contexts are all neighbours and the ends of texts: the classes
   of the TOP most frequent words are held by every task, rare words have their shape's, and the other clustered words
   are asked for: the words beside one go to its bucket, where its class is known, and from there, as counts of
   contexts, to their own buckets. What TOP is changes the bytes shuffled, not the result.
5. Rare words' classes and counts are looked up by a shuffle of each chunk's distinct words; then each text is a sequence of
   classes, over which transitions are counted and texts are scored.

All smoothing is additive by ADD. Word identity is a 64-bit hash.

Edge cases
* null or empty text: only the end token. Null doc_id: a training row. Repeated rows: counted and scored each.
* no training rows: every count is 0; base and model scores are those of the smoothing alone.
* a word without a context: a class by the remainder of its hash, as good as any. Ties of gain: the lowest class.
* no rows: an empty result. A very long text is a chunk of its own. Extra columns are left out.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm import textkernel as K
from cinderflow.llm.jaccard_join import _pack, _unpack
from cinderflow.storage import scratch, sized, written

TOP, SEEDS, LEAST_COUNT, SEED_SWEEPS, SWEEPS, ADD = 65_536, 1024, 10, 4, 2, 0.5
SHAPES = 4
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 60_000, 8 << 20, 64
#: Bits of a table that tells clustered words from most others: for each word, and the most.
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Distinct words, or words with a context, held by a counting task before they are sent on.
HELD_WORDS = 1_500_000


def classes_for(words: int) -> int:
    """Number of classes of so many clustered words."""
    return max(8, round(2 * words ** (1 / 3)))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _shape(data: np.ndarray, w: K.Words) -> np.ndarray:
    """0..3: whether a word has bytes beyond ASCII (2), and whether it ends in other than a letter or such a byte (1)."""
    wide = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int64)])
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 0x80)
    return ((wide[w.end] > wide[w.start]) * 2 + ~letter).astype(np.int64)


_CODED = "chunk long, ids binary, nulls binary, outs binary, firsts binary, words binary, codes binary"


def _codes(words: int) -> str:
    """The type of numbers of so many words."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _coded(batches):
    """Chunks of documents: their distinct words (the two low bits of a hash give way to the shape) and the texts as numbers of them."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for b in batches:
        data, offsets = K.flat(b.column("text"))
        for i, j in K.parts(offsets, CHUNK_BYTES):
            for a in range(i, j, CHUNK_DOCS):
                e = min(j, a + CHUNK_DOCS)
                d = data[offsets[a] : offsets[e]]
                w = K.words(d, offsets[a : e + 1] - offsets[a])
                words, codes = np.unique(w.hash & ~np.uint64(3) | _shape(d, w).astype(np.uint64), return_inverse=True)
                ids = b.column("doc_id").slice(a, e - a).cast(pa.int64())
                out = b.column("held_out").slice(a, e - a).to_numpy(zero_copy_only=False)
                parts = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), out.astype(bool), w.firsts().astype(np.int64), words, codes.astype(_codes(len(words)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [x.split()[0] for x in _CODED.split(", ")])
                chunk += 1


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    null: np.ndarray
    out: np.ndarray
    first: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    def __post_init__(self):
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.learnt = ~self.out[self.doc]

    def steps(self) -> np.ndarray:
        """Places of training words that stand before another, different word of their document."""
        return np.flatnonzero((self.doc[1:] == self.doc[:-1]) & self.learnt[1:] & (self.codes[1:] != self.codes[:-1]))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first and of the last words of training documents that have any."""
        some = (np.diff(self.first) > 0) & ~self.out
        return self.first[:-1][some], self.first[1:][some] - 1


def _chunk(row: dict) -> Chunk:
    kinds = ("<i8", "?", "?", "<i8", "<u8", _codes(len(row["words"]) // 8))
    return Chunk(row["chunk"], *(np.frombuffer(row[c], k) for c, k in zip(("ids", "nulls", "outs", "firsts", "words", "codes"), kinds, strict=True)))


def _chunks(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield _chunk({c: b.column(c)[r].as_py() for c in b.schema.names})


def _counted(batches):
    """Distinct training words with their counts, merged as they come."""
    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for c in _chunks(batches):
        n = np.bincount(c.codes[c.learnt], minlength=len(c.words))
        both, which = np.unique(np.concatenate([held, c.words[n > 0]]), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([counts, n[n > 0]]), minlength=len(both)).astype(np.int64)
        held = both
        if len(held) > HELD_WORDS:
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["word", "n"])
            held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["word", "n"])


def _places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of words in the sorted array known; len(known) where not in it."""
    at = np.searchsorted(known, words)
    return np.where(np.append(known, 0)[at] == words, at, len(known)) if len(known) else np.zeros(len(words), np.int64)


def _matrix(rows: DataFrame, shape: tuple[int, int], count) -> np.ndarray:
    """The sum over all rows of matrices of a fixed shape. count(batches) gives flat indices to count, batch by batch.

    With each come the weights to count by, or None. Tasks send the cells that are not 0, which are summed natively; the driver
    gets as many as the matrix has, at most.
    """
    size = shape[0] * shape[1]

    def run(batches):
        total = np.zeros(size, np.int64)
        for flat, weights in count(batches):
            total += np.bincount(flat, weights, size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = rows.mapInArrow(K.trimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(shape)


def _xlogx(x):
    x = np.maximum(x, 0)
    return x * np.log(np.maximum(x, 1e-300))


class Bigrams:
    """Counts of class bigrams (from, to), with what gains() asks of them again and again. A word can join the first k classes: by default all but
    the last, which is the end of a text."""

    def __init__(self, n: np.ndarray, k: int | None = None):
        self.k = len(n) - 1 if k is None else k
        self.n = n.astype(float)
        self.logs = _xlogx(self.n)
        self.a, self.b, self.d = self.n[: self.k].sum(1), self.n[:, : self.k].sum(0), np.diag(self.n)[: self.k].copy()

    def gains(self, after: np.ndarray, before: np.ndarray, own: int) -> np.ndarray:
        """By how much the log likelihood grows, up to a constant, if a word joins each of the first k classes. after, before: how often each
        class follows and precedes the word; own: the class that the counts have the word in, or -1. Only cells that the word has a share in are looked at."""
        k, n = self.k, self.n
        x, y = np.flatnonzero(after), np.flatnonzero(before)
        right, left = after.sum(), before.sum()
        rows, columns = n[:k][:, x], n[y][:, :k].T
        row_logs, column_logs = self.logs[:k][:, x], self.logs[y][:, :k].T  # copies, like those of n
        a, b, d = self.a, self.b, self.d
        if own >= 0:
            rows[own] -= after[x]
            rows[:, x == own] -= before[:k, None]
            columns[own] -= before[y]
            columns[:, y == own] -= after[:k, None]
            for logs, cells, at in ((row_logs, rows, x == own), (column_logs, columns, y == own)):  # only these cells have changed
                logs[own], logs[:, at] = _xlogx(cells[own]), _xlogx(cells[:, at])
            a, b, d = a.copy(), b.copy(), d.copy()
            a[own] -= right
            b[own] -= left
            d[own] -= after[own] + before[own]
        else:
            a, b = a + before[:k], b + after[:k]
        rows += after[x]
        columns += before[y]
        out = (rows * np.log(rows) - row_logs).sum(1) + (columns * np.log(columns) - column_logs).sum(1)  # no cell is below the word's own share
        # A class's own cell takes both shares at once.
        both = np.flatnonzero((after[:k] > 0) & (before[:k] > 0))
        if len(both):
            e, p, q = d[both], after[both], before[both]
            out[both] += _xlogx(e + p + q) + _xlogx(e) - _xlogx(e + p) - _xlogx(e + q)
        return out - (_xlogx(a + right) - _xlogx(a)) - (_xlogx(b + left) - _xlogx(b))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """Class of each word, by sequential exchange: words come in by frequency, the first ones each to a class of its own, the others to the
    class that gives the class bigrams so far the highest likelihood; then all move likewise until none does, for so many sweeps at most."""
    m = len(bigrams)
    bigrams, cls, n = bigrams * (1.0 - np.eye(m)), np.full(m, -1), np.zeros((classes + 1, classes + 1))
    for sweep in range(sweeps + 1):
        moved = 0
        for w in range(m):
            k, there = cls[w], cls >= 0
            after, before = np.bincount(cls[there], bigrams[w][there], classes + 1), np.bincount(cls[there], bigrams[:, w][there], classes + 1)
            if k >= 0:
                n[k] -= after
                n[:, k] -= before
            if not sweep and w < classes:
                best = w
            else:
                gain = Bigrams(n).gains(after, before, -1)
                best = int(np.argmax(gain)) if k < 0 or gain.max() > gain[k] + 1e-9 else k
            moved += best != k
            cls[w] = best
            n[best] += after
            n[:, best] += before
        if moved <= m // 200:
            break
    return cls


def _bit_table(words: DataFrame, n: int) -> np.ndarray:
    """Bits (packed) at the places of n words. Its 64-bit cells are put together where the words are; the driver gets MOST_BITS / 64 of them at most."""
    bits = max(64, 1 << (min(MOST_BITS, max(1, BITS_EACH * n)) - 1).bit_length())
    place = F.shiftright("word", 2).bitwiseAND(F.lit(bits - 1))
    cells = words.select(F.shiftright(place, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return table.view(np.uint8)


def _in_table(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    place = (words >> np.uint64(2)) & np.uint64(8 * len(table) - 1)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays, each of its own length."""
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def _unblob(body: bytes, *kinds: str) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(body, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out


#: Kinds of blobs by bucket: words that a chunk asks for, words with what is known of them, words with their contexts, and neighbours with the words beside them.
ASKED, TOLD, NEAR, BESIDE = range(4)
_BLOBS = "bucket int, chunk long, part int, body binary"


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(8)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _slices(bucket: np.ndarray, buckets: int):
    """bucket and slice of the order by bucket, in which what is equal keeps its order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), order[edges[k] : edges[k + 1]]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def _near(words: np.ndarray, top: np.ndarray, cls: np.ndarray, classes: int, table: np.ndarray, placed: bool) -> np.ndarray:
    """The class of each word as far as a task can tell, else -1: of top words, and once all clustered words are placed that of the shape of words that the table lacks."""
    at = _places(words, top)
    near = np.append(cls, -1)[at].astype(np.int64)
    if placed:
        rare = (at == len(top)) & ~_in_table(table, words)
        near[rare] = classes + (words[rare] & np.uint64(SHAPES - 1)).astype(np.int64)
    return near


def _contexts(top: np.ndarray, cls: np.ndarray, classes: int, table: np.ndarray, placed: bool, buckets: int):
    """Words and their contexts that a task can tell, by bucket: contexts 0 .. end are the class after the word (classes, shapes, the end), the next
    end + 1 the class before. Most words that table doesn't have are left out."""
    end = classes + SHAPES
    width = 2 * (end + 1)

    def run(batches):
        held, size = [], 0
        for c in _chunks(batches):
            near = _near(c.words, top, cls, classes, table, placed)[c.codes]
            codes = c.codes.astype(np.int64)
            i = c.steps()
            first, last = c.ends()
            wanted = _in_table(table, c.words)[c.codes]
            x, y = i[(near[i + 1] >= 0) & wanted[i]], i[(near[i] >= 0) & wanted[i + 1]]
            first, last = first[wanted[first]], last[wanted[last]]
            key = np.concatenate([codes[x] * width + near[x + 1], codes[y + 1] * width + end + 1 + near[y], codes[last] * width + end, codes[first] * width + 2 * end + 1])
            key, n = np.unique(key, return_counts=True)
            held.append((c.words[key // width], (key % width).astype(np.int32), n))
            size += len(key)
            if size > HELD_WORDS:
                yield _batch(_merged(held, buckets))
                held, size = [], 0
        yield _batch(_merged(held, buckets))

    return run


def _merged(held: list[tuple], buckets: int) -> list[tuple]:
    """Words with their contexts and counts, merged, as blobs by bucket."""
    if not held:
        return []
    word, context, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((context, word))
    word, context, n = word[order], context[order], n[order]
    begin = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]))) if len(word) else np.zeros(0, np.int64)
    word, context, n = word[begin], context[begin].astype("<u2"), (np.add.reduceat(n, begin) if len(begin) else n).astype("<u4")
    out = []
    for k, s in _slices(_bucket_of(word, buckets), buckets):
        at, lens = _runs(word[s])
        out.append((k, -1, NEAR, _blob(word[s][at], lens.astype("<u4"), context[s], n[s])))
    return out


def _beside(top: np.ndarray, cls: np.ndarray, classes: int, table: np.ndarray, buckets: int):
    """Neighbours whose class a task can't tell, by bucket, with the words beside them: numbers of words (top words, then the blob's own), whether the
    neighbour stands before (1) or after them, and how often."""

    def run(batches):
        for c in _chunks(batches):
            asked = (_near(c.words, top, cls, classes, table, True) < 0)[c.codes]
            wanted = _in_table(table, c.words)[c.codes]
            codes, v, i = c.codes.astype(np.int64), len(c.words), c.steps()
            x, y = i[asked[i + 1] & wanted[i]], i[asked[i] & wanted[i + 1]]
            key, n = np.unique(np.concatenate([(codes[x + 1] * v + codes[x]) * 2, (codes[y] * v + codes[y + 1]) * 2 + 1]), return_counts=True)
            of, word, before = key // 2 // max(v, 1), key // 2 % max(v, 1), (key & 1).astype(np.uint8)
            number, rows = _places(c.words, top), []
            for k, s in _slices(_bucket_of(c.words[of], buckets), buckets):
                at, lens = _runs(of[s])
                numbers = number[word[s]]
                other = numbers == len(top)
                own, which = np.unique(word[s][other], return_inverse=True)
                numbers[other] += which
                rows.append((k, c.number, BESIDE, _blob(c.words[of[s][at]], lens.astype("<u4"), numbers.astype("<u4"), before[s], n[s].astype("<u4"), c.words[own])))
            yield _batch(rows)

    return run


def _vocabulary(buckets: int):
    """The clustered words by bucket, with count, whether they are top words, and class (-1: none yet)."""

    def run(batches):
        for b in batches:
            words, n, hot, cls = (b.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "hot", "cls"))
            words = words.view(np.uint64)
            yield _batch([(k, -1, TOLD, _pack(words[s], n[s], hot[s].astype(bool), cls[s].astype(np.int32))) for k, s in _slices(_bucket_of(words, buckets), buckets)])

    return run


def _told(table) -> tuple[np.ndarray, ...]:
    """A bucket's clustered words in ascending order: word, n, hot, cls."""
    parts = [_unpack(x, "<u8", "<i8", "?", "<i4") for p, x in zip(table["part"].to_pylist(), table["body"].to_pylist(), strict=True) if p == TOLD]
    words, n, hot, cls = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in ("<u8", "<i8", "?", "<i4"))
    order = np.argsort(words)
    return words[order], n[order], hot[order], cls[order]


def _classed(top: np.ndarray, classes: int, buckets: int):
    """In the bucket of the neighbours: the words beside them, with the neighbour's class as context, to their own buckets."""

    def run(table):
        words, _, _, cls = _told(table)
        held = []
        for part, body in zip(table["part"].to_pylist(), table["body"].to_pylist(), strict=True):
            if part == BESIDE:
                of, lens, numbers, before, n, own = _unblob(body, "<u8", "<u4", "<u4", "u1", "<u4", "<u8")
                at = _places(of, words)
                context = np.where(at < len(words), np.append(cls, 0)[at], classes + (of & np.uint64(SHAPES - 1)).astype(np.int32))
                word, hot = np.zeros(len(numbers), np.uint64), numbers < len(top)
                word[hot], word[~hot] = top[numbers[hot]], own[numbers[~hot].astype(np.int64) - len(top)]
                held.append((word, (np.repeat(context, lens) + before.astype(np.int32) * (classes + SHAPES + 1)).astype(np.int32), n.astype(np.int64)))
        return pa.Table.from_batches([_batch(_merged(held, buckets))])

    return run


_BUCKET = "words binary, n binary, hot binary, cls binary, lens binary, contexts binary, counts binary"


def _met(table):
    """A bucket's clustered words and, one after another, each word's contexts and their counts."""
    words, n, hot, cls = _told(table)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, body in zip(table["part"].to_pylist(), table["body"].to_pylist(), strict=True):
        if part == NEAR:
            word, lens, context, count = _unblob(body, "<u8", "<u4", "<u2", "<u4")
            at = np.repeat(_places(word, words), lens)
            known = at < len(words)
            keys.append(at[known] << 16 | context[known])
            counts.append(count[known].astype(np.int64))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin, _ = _runs(key)
    count = np.add.reduceat(count[order], begin) if len(begin) else count
    key = key[begin]
    arrays = words, n, hot, cls, np.bincount(key >> 16, minlength=len(words)).astype("<u4"), (key & 0xFFFF).astype("<u2"), count.astype("<i8")
    names = [x.split()[0] for x in _BUCKET.split(", ")]
    return pa.table({c: pa.array([x.tobytes()] if len(words) else [], pa.binary()) for c, x in zip(names, arrays, strict=True)})


def _buckets(batches):
    """Of each row of _BUCKET: words, n, hot, cls, lens, contexts, counts."""
    for b in batches:
        for r in range(b.num_rows):
            yield tuple(np.frombuffer(x[r].as_py(), k) for x, k in zip(b.columns, ("<u8", "<i8", "?", "<i4", "<u4", "<u2", "<i8"), strict=True))


def contexts(coded: DataFrame, vocabulary: DataFrame, top: np.ndarray, cls: np.ndarray, classes: int, table: np.ndarray, placed: bool, buckets: int) -> DataFrame:
    """The clustered words with all their contexts, a row (_BUCKET) a bucket. While words aren't placed yet, contexts are those of placed top words and ends."""
    told = vocabulary.mapInArrow(_vocabulary(buckets), _BLOBS)
    near = coded.mapInArrow(K.trimmed(_contexts(top, cls, classes, table, placed, buckets)), _BLOBS)
    if placed:
        asked = coded.mapInArrow(K.trimmed(_beside(top, cls, classes, table, buckets)), _BLOBS).unionByName(told)
        near = near.unionByName(asked.groupBy("bucket").applyInArrow(_classed(top, classes, buckets), _BLOBS))
    return written(near.unionByName(told).groupBy("bucket").applyInArrow(_met, _BUCKET), "contexts")


def class_bigrams(known: DataFrame, classes: int) -> np.ndarray:
    """Counts of the bigrams of classes, shapes and the end, of which at least one is a class."""
    end = classes + SHAPES

    def cells(batches):
        for _, _, _, cls, lens, contexts_, counts in _buckets(batches):
            of = np.repeat(cls, lens).astype(np.int64)
            yield (of * (2 * (end + 1)) + contexts_)[of >= 0], counts[of >= 0]

    every = _matrix(known, (classes, 2 * (end + 1)), cells)
    out = np.zeros((end + 1, end + 1))
    out[:classes] = every[:, : end + 1]
    out[classes:, :classes] = every[:, end + 1 :].T[classes:]
    return out


def _moves(n: np.ndarray, classes: int, first: bool):
    """The class of each word after a sweep, under the class bigrams n. In the first sweep only words without a class take one."""
    half = classes + SHAPES + 1

    def run(batches):
        now = Bigrams(n, classes)
        for words, times, hot, cls, lens, contexts_, counts in _buckets(batches):
            words, to, new = words.view(np.int64), np.cumsum(lens, dtype=np.int64), []
            for word, k, a, e in zip(words.tolist(), cls.tolist(), (to - lens).tolist(), to.tolist(), strict=True):
                if k >= 0 and first:
                    new.append(k)
                elif a == e:
                    new.append(word % classes if k < 0 else k)
                else:
                    near = np.zeros(2 * half)
                    near[contexts_[a:e]] = counts[a:e]
                    gain = now.gains(near[:half], near[half:], k)
                    best = int(np.argmax(gain))
                    new.append(best if k < 0 or gain[best] > gain[k] + 1e-9 else k)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times), pa.array(hot), pa.array(new, pa.int32())], ["word", "n", "hot", "cls"])

    return run


@dataclass
class Model:
    """classes, the top words (sorted) with counts and classes, words (word, n, cls: all of the training words), log10 emission
    totals by class (classes, then shapes), training texts, tokens N and distinct tokens V."""

    classes: int
    top: np.ndarray
    top_n: np.ndarray
    top_cls: np.ndarray
    words: DataFrame
    total: np.ndarray
    texts: int
    N: int
    V: int

    @property
    def end(self) -> int:
        return self.classes + SHAPES


def frequent(counts: DataFrame, most: int):
    """Whether a word is one of about the `most` most frequent, never more: whole bins of the logarithm of counts, and part of the next bin by hash."""
    level = F.floor(F.log("n") * 64).cast("int")
    seen = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # some thousands of bins at most
    room, taken = most, F.lit(False)
    for at, words in seen:
        if words > room:
            share = max(0.0, room - 5 * room**0.5) / words
            return taken | ((level == at) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
        room, taken = room - words, level >= at
    return taken


def _top(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The top words in ascending order, their counts and classes (-1: none yet)."""
    got = vocabulary.where("hot").select("word", "n", F.coalesce("cls", F.lit(-1)).alias("cls")).toArrow()  # TOP rows at most
    word = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], got["n"].to_numpy()[order], got["cls"].to_numpy()[order]


def buckets_for(size: int) -> int:
    """Number of buckets of words for so many bytes of files."""
    return max(LEAST_BUCKETS, min(1 << 20, size // BUCKET_BYTES))


def learn(coded: DataFrame, texts: int, size: int = 0) -> Model:
    """The model of the training documents of coded, of which there are `texts`; size: bytes of the files of all documents."""
    counts = written(coded.mapInArrow(K.trimmed(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") >= LEAST_COUNT).alias("clustered")).first()
    clustered = counts.where(F.col("n") >= LEAST_COUNT)
    classes = classes_for(tokens["clustered"])
    vocabulary = clustered.select("word", "n", frequent(clustered, TOP).alias("hot"), F.lit(None).cast("int").alias("cls"))
    top, n, cls = _top(vocabulary)
    by_count = np.sort(np.lexsort((top, -n))[:SEEDS])
    seeds, m = top[by_count], len(by_count)

    def pairs(batches):
        for c in _chunks(batches):
            at = _places(c.words, seeds)[c.codes]
            i = c.steps()
            i = i[(at[i] < m) & (at[i + 1] < m)]
            yield at[i] * m + at[i + 1], None

    if m:
        bigrams, by_rank = _matrix(coded, (m, m), pairs), np.argsort(-n[by_count], kind="stable")
        cls[by_count[by_rank]] = exchange(bigrams[np.ix_(by_rank, by_rank)], classes)
        told = list(zip(seeds.view(np.int64).tolist(), cls[by_count].tolist(), strict=True))  # SEEDS rows at most
        started = F.broadcast(counts.sparkSession.createDataFrame(told, "word long, started int"))
        vocabulary = vocabulary.join(started, "word", "left").select("word", "n", "hot", F.coalesce("started", F.lit(-1)).alias("cls"))
        table = _bit_table(clustered, tokens["clustered"])
        for sweep in range(SWEEPS):
            with scratch(counts.sparkSession) as own:  # only the sweep reads its contexts
                known = contexts(coded, vocabulary, top, cls, classes, table, sweep > 0, buckets_for(size))
                now = class_bigrams(known, classes)
                vocabulary = written(known.mapInArrow(K.trimmed(_moves(now, classes, sweep == 0)), "word long, n long, hot boolean, cls int"), "classes")
                own.keep()
            top, n, cls = _top(vocabulary)
    vocabulary = vocabulary.select("word", "n", "cls")
    shape = F.col("word").bitwiseAND(F.lit(SHAPES - 1)).cast("int") + classes
    whole = written(counts.where(F.col("n") < LEAST_COUNT).select("word", "n", shape.alias("cls")).unionByName(vocabulary), "words")
    total = np.zeros(classes + SHAPES)
    for r in whole.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total[r["cls"]] = r["n"] + ADD * r["v"]
    total[classes:] += ADD  # one unknown word of each shape
    return Model(classes, top, n, cls, whole, np.log10(np.maximum(total, 1e-300)), texts, int(tokens["n"]) + texts, int(tokens["v"]) + (texts > 0))


def _batch(rows) -> pa.RecordBatch:
    b, c, p, x = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(x, pa.binary())], ["bucket", "chunk", "part", "body"])


def _asks(top: np.ndarray, buckets: int):
    """Each chunk's distinct words beyond the top ones, by bucket."""

    def run(batches):
        for c in _chunks(batches):
            at = np.flatnonzero(_places(c.words, top) == len(top)).astype(np.uint32)
            yield _batch([(k, c.number, ASKED, _pack(c.words[at[s]], at[s])) for k, s in _slices(_bucket_of(c.words[at], buckets), buckets)])

    return run


def _known(buckets: int):
    """The training words by bucket."""

    def run(batches):
        for b in batches:
            words, n, cls = b.column("word").to_numpy().view(np.uint64), b.column("n").to_numpy(), b.column("cls").to_numpy()
            yield _batch([(k, -1, TOLD, _pack(words[s], n[s], cls[s].astype(np.int32))) for k, s in _slices(_bucket_of(words, buckets), buckets)])

    return run


def _answers(classes: int):
    """A bucket's words looked up; for each chunk that asked: number of the word in the chunk, count and class."""

    def run(table):
        words, n, cls = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        asked = []
        for chunk, part, body in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), table["body"].to_pylist(), strict=True):
            if part == TOLD:
                for into, x in zip((words, n, cls), _unpack(body, "<u8", "<i8", "<i4"), strict=True):
                    into.append(x)
            else:
                asked.append((chunk, *_unpack(body, "<u8", "<u4")))
        words, n, cls = np.concatenate(words), np.concatenate(n), np.concatenate(cls)
        order = np.argsort(words)
        words, n, cls = words[order], np.append(n[order], 0), np.append(cls[order], 0)
        out = []
        for chunk, word, number in asked:
            at = _places(word, words)
            shape = classes + (word & np.uint64(SHAPES - 1)).astype(np.int32)
            out.append((chunk, _pack(number, n[at], np.where(at < len(words), cls[at], shape).astype(np.int32))))
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "body": pa.array([x for _, x in out], pa.binary())})

    return run


_TOLD = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, classes binary"


def _resolved(model: dict):
    """Chunks and their answers to documents: sums of log counts and emissions, and the sequence of classes."""
    top, top_n, top_cls, total = (model[k] for k in ("top", "top_n", "top_cls", "total"))

    def run(left, right):
        c = _chunk({k: left[k][0].as_py() for k in left.column_names})
        at = _places(c.words, top)
        n, cls = np.append(top_n, 0)[at], np.append(top_cls, 0)[at].astype(np.int32)
        for body in right["body"].to_pylist():
            number, count, of = _unpack(body, "<u4", "<i8", "<i4")
            n[number], cls[number] = count, of
        docs = len(c.ids)
        seen = np.log10(n + 0.5)
        by_doc = lambda x: np.bincount(c.doc, x[c.codes], docs)
        base, emitted, known = by_doc(seen), by_doc(np.log10(n + ADD) - total[cls]), by_doc(n > 0)
        sequence = cls[c.codes].astype("<u2")
        return pa.table(
            {
                "doc_id": pa.array(c.ids, mask=c.null), "held_out": c.out, "n_tokens": np.diff(c.first) + 1, "n_known": known.astype(np.int64) + model["ended"],
                "base": base, "emitted": emitted, "classes": pa.array([sequence[a:b].tobytes() for a, b in zip(c.first[:-1], c.first[1:], strict=True)], pa.binary()),
            }
        )

    return run


def _sequences(batches, end: int):
    """Flat classes of a batch's texts, each between two ends."""
    for b in batches:
        found = b.column("classes").to_pylist()
        edge = np.array([end], "<u2")
        yield b, np.concatenate([edge, *(y for x in found for y in (np.frombuffer(x, "<u2"), edge))]).astype(np.int64), np.array([len(x) // 2 + 1 for x in found], np.int64)


def resolved(coded: DataFrame, model: Model, size: int) -> DataFrame:
    """Every document as what _TOLD names."""
    buckets = buckets_for(size)
    asked = coded.mapInArrow(K.trimmed(_asks(model.top, buckets)), _BLOBS).unionByName(model.words.mapInArrow(_known(buckets), _BLOBS))
    answers = asked.groupBy("bucket").applyInArrow(_answers(model.classes), "chunk long, body binary")
    plain = {"top": model.top, "top_n": model.top_n, "top_cls": model.top_cls, "total": model.total, "ended": int(model.texts > 0)}
    return written(coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_resolved(plain), _TOLD), "class-sequences")


def transitions(rows: DataFrame, end: int) -> np.ndarray:
    """log10 P(class | class before) over the training documents of rows."""

    def steps(batches):
        for _, c, _ in _sequences(batches, end):
            yield c[:-1] * (end + 1) + c[1:], None

    moves = _matrix(rows.where("not held_out").select("classes"), (end + 1, end + 1), steps) + ADD
    return np.log10(moves / moves.sum(1, keepdims=True))


def coded(rows: DataFrame) -> DataFrame:
    """Coded texts of rows (doc_id, text), which come straight from files."""
    return written(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(K.trimmed(_coded), _CODED), "coded", compression="zstd")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    docs, size = sized(docs.select("doc_id", "text"), "lm-docs")
    rows = coded(docs)
    model = learn(rows, docs.where(~held_out(F.col("doc_id"))).count(), size)
    told = resolved(rows, model, size)
    end = model.end
    moves = transitions(told, end)
    end_seen, all_, n_train = np.log10(model.texts + 0.5), np.log10(model.N + 0.5 * (model.V + 1)), model.N

    def run(batches):
        for b, c, sizes in _sequences(batches, end):
            step = np.concatenate([[0.0], np.cumsum(moves[c[:-1], c[1:]])])
            at = np.concatenate([[0], np.cumsum(sizes)])
            path = step[at[1:]] - step[at[:-1]]
            tokens = b.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), b.column("n_known"), pa.array(np.full(b.num_rows, n_train, np.int64)),
                    pa.array(b.column("base").to_numpy() + end_seen - tokens * all_), pa.array(b.column("emitted").to_numpy() + path),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return told.mapInArrow(K.trimmed(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_class_lm": op6_class_lm}
ORACLE_SQL = {}
