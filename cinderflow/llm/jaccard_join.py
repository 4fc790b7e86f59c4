"""N-gram Jaccard join by set-relation skipping: which documents share 80 % of their 5-word shingles.

Sets with the same shingles form a class and are one set from then on. Of the other sets the join finds
links as follows; all steps are exact.

1. Index. Shingle hashes are dealt to buckets by hash range, in blobs. A bucket counts how many documents
   hold each shingle; shingles of one document only can't be shared and go no further. Every set gets its
   shared shingles back, ordered rarest first.
2. Prefixes. A set of n shingles can only link where at least 4n/5 are shared; others end here. Two linked
   sets share one of their first n - ceil(4n/5) + 1 shingles in that order, so only these are listed.
3. Leaders. In each list the set with the smallest share of unshared shingles leads; a set joins the group of
   the leader it meets most often. Each leader's answers are computed against its members. A member is then kept as
   what its own answers differ by: its tokens that the leader lacks, and the leader's that it lacks (its delta).
4. Derived answers. Two members share |leader| - lost(a) - lost(b) + |delta(a) and delta(b)| shingles, so a member's answers
   follow from its leader's and from the deltas alone; a block's deltas are swept once for each set. join() does this for all
   pairs of a group, as it counts links. kept(), which needs components only, does it for members that don't link with
   their leader; all others are tied to the leader, so there a group costs as much as it has members.
5. Skipping in index lists. A list is cut into blocks by group and size, with the best position of each;
   two blocks of different groups are skipped if even the best position leaves too few shingles, or the sizes
   differ too much. What is left gives pairs of groups to compare, by their whole sets.
6. Links become components by large-star and small-star rounds.

Counting every link of a group of k different sets takes k * k / 2 sums of numbers (deltas are a few shingles each, BLOCK sets at a
time), spread over (k / BLOCK) ** 2 tasks; exact copies are one set. No pair is ever a row.

Groups are compared in blocks of about BLOCK sets, so a group of any size is spread over tasks. A
shingle that HOT documents of one chunk hold is announced instead of listed, so no bucket gathers the
postings of a shingle that a third of all documents hold; such shingles come last in the order.
Hashes have 56 bits; two different shingles of one bucket share one with a chance of 2 ** -56.

Edge cases
* null or empty text, or one without words: 0 shingles, its own component (its doc_id), linked with nothing.
* 1 to 4 words: the sequence is the one shingle.
* repeated rows: each returned; rows of one class share the component. Null doc_id: its component is the
  smallest id it is linked with, null if there is none.
* no rows: an empty result. Very long texts: chunks of their own; a text must fit in an executor's memory.
* extra columns, whatever their names, are left out of join() and kept by kept().
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.llm import textkernel as K
from cinderflow.llm.components import components, salted
from cinderflow.storage import settled, sized, without, written

WIDTH = 5
#: Bytes of text and documents of a chunk; input bytes of a bucket, and the fewest buckets.
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 60_000, 2 << 20, 256
HOT, MANY, BLOCK = 32, 255, 1024
_FEW = np.uint64(0xA24BAED4963EE407)
_NOTICE = 0xFFFF
#: doc_ids lie below; a class of null ids gets a number above.
_UNNAMED = 1 << 62


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, in the order of documents and hashes."""
    w = K.words(data, offsets)
    at, g = w.grams(WIDTH)
    doc = w.doc[at].astype(np.int64)
    first = w.firsts()
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        total = n[short].astype(np.uint64) * _FEW
        for i in range(WIDTH - 1):
            has = n[short] > i
            total[has] += w.hash[first[short[has]] + i] * K._PLACES[i]
        doc, g = np.concatenate([doc, short]), np.concatenate([g, K.mix(total)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[new], g[new]


def _chunks(offsets: np.ndarray):
    for i, j in K.parts(offsets, CHUNK_BYTES):
        for a in range(i, j, CHUNK_DOCS):
            yield a, min(j, a + CHUNK_DOCS)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out


_ROWS = "bucket int, chunk long, part int, body binary"
DOCS, HELD, SEEN = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, c, p, x = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(x, pa.binary())], ["bucket", "chunk", "part", "body"])


def _index(bits: int):
    """Chunks of documents to blobs by bucket: 48 bits of each hash and the document's number in the chunk."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            known, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            data, offsets = K.flat(b.column("text"))
            for i, j in _chunks(offsets):
                doc, g = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(doc, minlength=j - i)
                cls = np.zeros(j - i, np.uint64)
                np.add.at(cls, doc, K.mix(g ^ _FEW))
                cls = K.mix(cls + n.astype(np.uint64))
                # What doesn't go through a bucket goes by a number of the chunk's own.
                away = -1 - ((chunk >> 32) * 4099 + (chunk & 0xFFFFFFFF)) % (1 << 30)
                rows = [(away, chunk, DOCS, _pack(known[i:j], null[i:j], n.astype(np.int32), cls))]
                order = np.argsort(g, kind="stable")
                token, doc = g[order] >> np.uint64(8), doc[order].astype(np.uint16)
                begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
                size = np.diff(np.append(begin, len(token)))
                hot = np.repeat(size >= HOT, size)
                if hot.any():
                    rows.append((away, chunk, HELD, _pack(token[hot], doc[hot])))
                    told = begin[size >= HOT]
                    token, doc = np.concatenate([token[~hot], token[told]]), np.concatenate([doc[~hot], np.full(len(told), _NOTICE, np.uint16)])
                    order = np.argsort(token, kind="stable")
                    token, doc = token[order], doc[order]
                bucket = (token >> np.uint64(56 - bits)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                low, high = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32), (token >> np.uint64(32)).astype("<u4") & np.uint32(0xFFFFFF)
                for k in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[k], edges[k + 1])
                    rows.append((int(k), chunk, SEEN, _pack(low[s], high[s].astype(np.uint16), doc[s])))
                    # the bits above the 48 are the bucket's
                yield _rows(rows)
                chunk += 1

    return run


def _shared(bits: int):
    """Of a bucket's shingles, those of two documents or more, back to their chunks."""

    def run(key, table):
        bucket = key[0].as_py()
        if bucket < 0:
            return table.select(["chunk", "part", "body"])
        chunk, token, doc = [], [], []
        for c, body in zip(table["chunk"].to_pylist(), table["body"].to_pylist(), strict=True):
            low, high, d = _unpack(body, "<u4", "<u2", "<u2")
            token.append(high.astype(np.uint64) << np.uint64(32) | low)
            chunk.append(np.full(len(d), c, np.int64))
            doc.append(d)
        token, chunk, doc = np.concatenate(token), np.concatenate(chunk), np.concatenate(doc)
        _, which, count = np.unique(token, return_inverse=True, return_counts=True)
        told = np.zeros(len(count), bool)
        told[which[doc == _NOTICE]] = True
        df = np.where(told, MANY, np.minimum(count, MANY))[which].astype(np.uint8)
        back = (df > 1) & (doc != _NOTICE)
        token, chunk, doc, df = token[back], chunk[back], doc[back], df[back]
        top = np.uint64(bucket) << np.uint64(56 - bits)
        token = token & np.uint64((1 << min(48, 56 - bits)) - 1) | top if bits >= 8 else token
        order = np.argsort(chunk, kind="stable")
        ends = np.flatnonzero(np.append(chunk[order][1:] != chunk[order][:-1], True)) + 1 if len(order) else []
        rows, a = [], 0
        for e in ends:
            o = order[a:e]
            rows.append((0, int(chunk[o[0]]), SEEN, _pack(token[o], doc[o], df[o])))
            a = e
        return pa.Table.from_batches([_rows(rows)]).select(["chunk", "part", "body"])

    return run


_SETS = "doc_id long, n long, cls long, shared long, tokens binary"


def _gathered(table: pa.Table) -> pa.Table:
    """A chunk's documents with their shared shingles, rarest first, where enough are shared to link."""
    ids = null = n = cls = None
    token, doc, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
    for part, body in zip(table["part"].to_pylist(), table["body"].to_pylist(), strict=True):
        if part == DOCS:
            ids, null, n, cls = _unpack(body, "<i8", "?", "<i4", "<u8")
        else:
            t, d, *f = _unpack(body, "<u8", "<u2", *["u1"] * (part == SEEN))
            token.append(t)
            doc.append(d)
            df.append(f[0] if f else np.full(len(t), MANY, np.uint8))
    token, doc, df = np.concatenate(token), np.concatenate(doc), np.concatenate(df)
    shared = np.bincount(doc, minlength=len(n))
    enough = (n > 0) & (5 * shared >= 4 * n)
    keep = enough[doc]
    token, doc, df = token[keep], doc[keep], df[keep]
    order = np.lexsort((token, df, doc))
    token, doc = token[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    blobs = [token[a:b].tobytes() if k else None for a, b, k in zip(edges[:-1], edges[1:], enough, strict=True)]
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=null), "n": n.astype(np.int64), "cls": pa.array(cls.view(np.int64), mask=n == 0),
            "shared": shared.astype(np.int64), "tokens": pa.array(blobs, pa.binary()),
        }
    )


def _bits(size: int) -> int:
    """Bucket numbers have so many bits: a bucket holds about BUCKET_BYTES of text up to 2 TB in all, and in proportion more beyond."""
    return min(20, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)).bit_length() - (1 if size <= LEAST_BUCKETS * BUCKET_BYTES else 0))


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, shared, tokens: every row of docs; tokens only where it may link with another document."""
    docs, size = sized(docs.select("doc_id", "text"), "join-docs")
    bits = _bits(size)
    blobs = docs.mapInArrow(K.trimmed(_index(bits)), _ROWS)
    back = blobs.groupBy("bucket").applyInArrow(_shared(bits), "chunk long, part int, body binary")
    return back.groupBy("chunk").applyInArrow(_gathered, _SETS)


def _postings(batches):
    """Prefix entries of each class: token, place, and the share of unshared shingles."""
    for b in batches:
        out = [], [], [], [], []
        for cls, n, body in zip(b.column("cls").to_pylist(), b.column("n").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            token = np.frombuffer(body, np.int64)
            alone = n - len(token)
            k = max(0, n - -(-4 * n // 5) + 1 - alone)
            k = min(k, len(token))
            for o, x in zip(out, (token[:k], np.full(k, cls), np.full(k, n), alone + np.arange(k), np.full(k, alone / n)), strict=True):
                o.append(x)
        empty = np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(o) if o else empty.astype(t), t2) for o, t, t2 in zip(out, ("i8", "i8", "i8", "i8", "f8"), (pa.int64(),) * 4 + (pa.float64(),), strict=True)],
            ["token", "cls", "n", "place", "alone"],
        )


class _Block:
    """The sets of a unit, each whole or as its delta, for counting what one set shares with all of them."""

    def __init__(self, table: pa.Table):
        self.cls, keep = np.unique(table["cls"].to_numpy(), return_index=True)
        self.side, self.n, self.node, self.copies, self.base, self.lost = (table[c].to_numpy()[keep] for c in ("side", "n", "node", "copies", "base", "lost"))
        self.token = [np.frombuffer(x, np.int64) for x in table["tokens"].take(pa.array(keep)).to_pylist()]
        self.size = np.array([len(x) for x in self.token], np.int64)
        _, self.code = np.unique(np.concatenate(self.token), return_inverse=True)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self._mark = np.zeros(self.code.max(initial=0) + 1, bool)

    def marked(self, x: int) -> np.ndarray:
        """Which of all sets' tokens set x has."""
        own = self.code[self.start[x] : self.end[x]]
        self._mark[own] = True
        has = self._mark[self.code]
        self._mark[own] = False
        return has

    def partners(self, x: int) -> np.ndarray:
        """Which sets link with set x (itself left out)."""
        total = np.concatenate([[0], np.cumsum(self.marked(x))])
        inter = self.base - self.lost[x] - self.lost + total[self.end] - total[self.start]
        hit = 9 * inter >= 4 * (self.n + self.n[x])
        hit[x] = False
        return hit


def _led(table: pa.Table) -> pa.Table:
    """The leader's (side 0) answers on a block of its members, and each member as its delta. Linked ones are tied to the least node among them."""
    unit = _Block(table)
    lead = int(np.flatnonzero(unit.side == 0)[0])
    linked = unit.partners(lead)
    linked[lead] = True
    least = unit.node[linked].min()
    own, in_lead, tokens = unit.code[unit.start[lead] : unit.end[lead]], unit.marked(lead), unit.token[lead]
    deltas, lost = [], []
    for x in range(len(unit.cls)):
        s = slice(unit.start[x], unit.end[x])
        unit._mark[unit.code[s]] = True
        away = tokens[~unit._mark[own]]
        unit._mark[unit.code[s]] = False
        deltas.append(np.concatenate([away, unit.token[x][~in_lead[s]]]).tobytes())
        lost.append(len(away))
    return pa.table(
        {
            "cls": unit.cls, "group": np.full(len(unit.cls), unit.cls[lead]), "a": unit.node, "b": np.full(len(unit.cls), least), "linked": linked,
            "base": np.full(len(unit.cls), len(own)), "lost": np.array(lost, np.int64), "delta": pa.array(deltas, pa.binary()),
        }
    )


_FOUND = "cls long, links long, a long, b long"


def _compare(table: pa.Table) -> pa.Table:
    """Links across the two sides (1 and 2) of a unit, a set of side 0 being on both: how many documents each set links
    with there, and each linked set tied to its component's least node.

    Within a group (g1 = g2) only the sets of side 1 are counted, as each is on that side of one unit with every block.
    """
    unit = _Block(table)
    within = table["g1"][0].as_py() == table["g2"][0].as_py()
    few, many = (1, 2) if within or (unit.side == 1).sum() <= (unit.side == 2).sum() else (2, 1)
    other = np.isin(unit.side, (many, 0))
    least, links = unit.node.copy(), np.zeros(len(unit.cls), np.int64)
    for x in np.flatnonzero(np.isin(unit.side, (few, 0))):
        hit = unit.partners(x) & other
        if not hit.any():
            continue
        links[x] += unit.copies[hit].sum()
        if not within:
            links[hit] += unit.copies[x]
        hit[x] = True
        met = np.unique(least[hit])
        if len(met) > 1:
            least[np.isin(least, met)] = met[0]
    tied = least != unit.node
    return pa.table({"cls": unit.cls, "links": links, "a": pa.array(unit.node, mask=~tied), "b": pa.array(least, mask=~tied)})


def class_links(classes: DataFrame, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Of classes (cls, n, copies, tokens, node): a, b, links between nodes, as many as give the components of all links; and
    cls, links, how many documents of other classes each links with (all of them only if counted)."""
    posted = classes.mapInArrow(_postings, "token long, cls long, n long, place long, alone double")
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("alone", "cls")).alias("lead")).where("held > 1")
    postings = written(posted.join(lists, "token").select("token", "cls", "n", "place", F.col("lead.cls").alias("lead")), "postings")

    votes = postings.where("cls <> lead").groupBy("cls", "lead").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("cls").agg(F.max_by("lead", F.struct("votes", "lead")).alias("group"))
    everyone = postings.select("cls").distinct().join(chosen, "cls", "left").select("cls", F.coalesce("group", "cls").alias("group"))
    member = written(everyone, "members")
    sizes = member.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = salted(member, sizes, "group", "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    # Members with their group's leader: every member once, the leader once a block.
    spread = lambda df, blocks, name: df.select("*", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias(name))
    none = F.lit(0).cast("long")
    bodies = classes.select("cls", "n", "copies", "node", "tokens", none.alias("base"), none.alias("lost"))
    followers = placed.where("cls <> group")
    tails = followers.select("cls", F.lit(1).alias("side"), "group", "block")
    # A leader may itself belong to another group: it is looked up by the group's name, not among the members.
    heads = followers.select(F.col("group").alias("cls"), F.lit(0).alias("side"), "group", "block").distinct()
    whole = tails.join(bodies, "cls").unionByName(heads.join(bodies, "cls"))
    known = written(whole.groupBy("group", "block").applyInArrow(_led, "cls long, group long, a long, b long, linked boolean, base long, lost long, delta binary"), "led")

    # Within a group: rows against all blocks of it. Rows are all sets if links are counted, else those that don't link with their leader.
    leaders = known.where("cls = group").groupBy("cls", "group").agg(F.first("base").alias("base"), F.first("lost").alias("lost"), F.first("delta").alias("delta"), F.lit(True).alias("linked"))
    told = known.where("cls <> group").select("cls", "group", "base", "lost", "delta", "linked").unionByName(leaders)
    inside = placed.join(told, ["cls", "group"])
    row = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("strays")).cast("int")
    if counted:
        inside = inside.withColumn("strays", F.col("blocks")).withColumn("row", F.col("block"))
    else:
        astray = inside.where("not linked").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("strays"))
        inside = salted(inside, astray, "group", "cls").withColumn("row", F.when(~F.col("linked"), row))
    lone = spread(inside.where("row is not null"), "blocks", "b2").select("cls", F.lit(1).alias("side"), "group", F.col("row").alias("b1"), "b2")
    rest = spread(inside, "strays", "b1").select("cls", F.lit(2).alias("side"), "group", "b1", F.col("block").alias("b2"))
    # A set that meets its own block is on both sides of that unit.
    within = lone.unionByName(rest).groupBy("cls", "group", "b1", "b2").agg(F.when(F.count(F.lit(1)) > 1, 0).otherwise(F.min("side")).alias("side"))
    deltas = told.join(classes.select("cls", "n", "copies", "node"), "cls").withColumnRenamed("delta", "tokens")
    within = within.join(deltas, ["cls", "group"]).select("cls", "side", F.col("group").alias("g1"), F.col("group").alias("g2"), "b1", "b2", "n", "copies", "node", "tokens", "base", "lost")

    # Blocks of lists by group and size, with the best position: pairs of groups that may hold a link.
    step = F.floor(F.log("n") / F.log(F.lit(1.25)))
    cut = postings.join(member, "cls").groupBy("token", "group", step.alias("step")).agg(F.max(F.col("n") - F.col("place")).alias("rest"), F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = cut.alias("x"), cut.alias("y")
    reach = (9 * F.least("x.rest", "y.rest") >= 4 * (F.col("x.low") + F.col("y.low"))) & (5 * F.col("x.high") >= 4 * F.col("y.low")) & (5 * F.col("y.high") >= 4 * F.col("x.low"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.group") < F.col("y.group")) & reach).select(F.col("x.group").alias("g1"), F.col("y.group").alias("g2")).distinct()
    met = written(met, "group-pairs")
    both = met.join(sizes.select(F.col("group").alias("g1"), F.col("blocks").alias("n1")), "g1").join(sizes.select(F.col("group").alias("g2"), F.col("blocks").alias("n2")), "g2")
    first = both.join(placed.select(F.col("group").alias("g1"), "cls", F.col("block").alias("b1")), "g1").select("cls", F.lit(1).alias("side"), "g1", "g2", "b1", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b2"))
    second = both.join(placed.select(F.col("group").alias("g2"), "cls", F.col("block").alias("b2")), "g2").select("cls", F.lit(2).alias("side"), "g1", "g2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("b1"), "b2")

    across = first.unionByName(second).join(bodies, "cls").select(*within.columns)
    found = written(within.unionByName(across).groupBy("g1", "g2", "b1", "b2").applyInArrow(_compare, _FOUND), "compared")
    ties = known.where("linked").select("a", "b").unionByName(found.where("a is not null").select("a", "b"))
    return ties, found.groupBy("cls").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, and, if counted, n_links (other rows that link with the row): one row for each row of docs."""
    found = written(sets(settled(docs.select("doc_id", "text"), "join-docs")), "sets")
    # A class goes by its smallest doc_id, so the least node of a component is its id; classes of null ids come after all ids.
    unnamed = F.lit(_UNNAMED) + F.pmod("cls", F.lit(1 << 61))
    alike = found.where("tokens is not null").groupBy("cls").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"), F.coalesce(F.min("doc_id"), unnamed).alias("node"))
    classes = written(alike, "classes")
    ties, counts = class_links(classes, counted)
    # One row a class: a class that is in no such row has one document, linked with nothing.
    named = classes.select("cls", "node", "copies").join(components(ties), "node", "left").select("cls", "copies", F.coalesce("label", "node").alias("least"))
    if counted:
        named = named.join(counts, "cls", "left").select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    rows = found.select("doc_id", "n", "cls").join(named, "cls", "left")
    least = F.when(F.col("least") < _UNNAMED, F.col("least")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), *([F.coalesce("links", F.lit(0)).alias("n_links")] if counted else []))
    return out


def kept(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; rows of one doc_id stay or go together. Null ids stay."""
    return without(docs, join(docs.select("doc_id", "text"), counted=False).where("doc_id <> component_id").select("doc_id"), "doc_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM documents),
s AS (
  SELECT doc_id, rn, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT rn, unnest(sh) AS x FROM s),
p AS (SELECT a.rn AS a, b.rn AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rn <> b.rn GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.rn = a JOIN s y ON y.rn = b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
r(n, m) AS (SELECT rn, rn FROM s UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
least_id AS (SELECT n, min(doc_id) AS component_id FROM r JOIN s ON s.rn = r.m GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, (SELECT count(*) FROM l WHERE l.a = s.rn) AS n_links FROM s JOIN least_id ON n = s.rn"""
}
