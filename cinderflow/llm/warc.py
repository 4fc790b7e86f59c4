"""WARC archives, and an external merge of their indexes into globally ordered capture histories.

Writing: a record for each page, made by DataFrame functions and written by Spark's text writer with the records'
own end (two line ends) as separator, gzip-compressed: files that any WARC reader takes. Of pages with equal
payloads of LEAST_PAYLOAD bytes or more, the one with the smallest page_id is a response; the others are revisits without payload
that refer to it.

Reading: every archive is parsed by the lengths its headers give; digests of payloads are computed anew and
held against the headers. Its captures, sorted by URL key, time and page, are one run; the runs are written, as an archive's index is.

Merge: the runs' captures are dealt to key ranges (URL key, time, page, then run and place in it, so even one URL or repeated
captures with a third of all rows fall into many ranges); Spark samples the written runs for the bounds. The number of ranges
follows that of the captures, so a range's share doesn't. In each range a loser tree merges the slices of all runs. Ascending range and place is then the order of
the whole history.

Edge cases
* null html: an empty payload, a response. Null URL: no target header, an empty URL key; line ends in URLs are written as %0A, %0D.
* null page_id: sorts after all others; refers_to of others can be null only if all ids of the payload are.
* repeated rows: those that tie for the smallest page_id are all responses.
* no rows: no records, an empty result. Very long pages: records of any length; a file holds at most RECORDS_PER_FILE.
* the capture time is 2024-01-01 plus page_id seconds (modulo a year), as pages have none.
* extra columns, whatever their names, are left out.
"""

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.storage import fresh_path, written

LEAST_PAYLOAD, RECORDS_PER_FILE = 100, 4096
#: Captures of a range on average, and of a batch given back.
RANGE_PAGES, BATCH = 4096, 1000
_CAPTURE = "url_key string, time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def _time(page_id):
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """The text of each page's record, without the line ends that close it."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("n"), F.sha2(body, 256).alias("digest"))
    # One row a payload; counting and the minimum are partial before the shuffle.
    repeated = read.where(F.col("n") >= LEAST_PAYLOAD).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first")).where("copies > 1").select("digest", "first")
    met = read.join(repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ((F.col("first") != F.col("page_id")) | F.col("page_id").isNull())
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    page = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    return met.select(
        F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page(F.col("page_id")), F.lit(">"))),
            F.coalesce(line("WARC-Target-URI", url), none), line("WARC-Date", _time(F.col("page_id"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("X-Payload-Length", F.col("n").cast("string")),
            F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), page(F.col("first")), F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(none),
            F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))), F.lit("\r\n"), F.when(revisit, none).otherwise(F.col("html")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str) -> None:
    made = records(pages)
    made.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(stream):
    """Headers (names in lower case) and payload of each record of an uncompressed stream."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            headers[name.lower().decode()] = value.strip().decode()
        payload = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield headers, payload


def url_key(url: str) -> str:
    """Labels of the host from the right, then the path: URLs of a site stand together."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != "<urn:page:null>" else None


def _order(row) -> tuple:
    """URL key, time, page (none last)."""
    return row[0], row[1], row[2] is None, row[2] or 0


def captures(content: bytes) -> list[tuple]:
    """The captures of one archive, sorted: a run."""
    found = []
    for h, payload in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't have its digest")
        n = len(payload) if h["warc-type"] == "response" else int(h["x-payload-length"])
        found.append((url_key(h.get("warc-target-uri", "")), h["warc-date"], _page(h["warc-record-id"]), n, digest, h["warc-type"], _page(h.get("warc-refers-to"))))
    return sorted(found, key=_order)


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * self.k
        self.keys = [_order(r[0]) if r else None for r in runs]
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        """Runs i up from its leaf; while the tree is built, the first to come to a node waits there."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.k and self.keys[w := self.loser[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = _order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node, winner = (w + self.k) // 2, w
            while node > 0:
                if self._beats(self.loser[node], winner):
                    self.loser[node], winner = winner, self.loser[node]
                node //= 2
            self.loser[0] = winner


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _batches(names: list[str], lead: list[tuple[str, pa.Array]], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([*(x for _, x in lead), *columns], [*(n for n, _ in lead), *names])


def _runs(batches):
    """Each archive to a sorted run."""
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            found = captures(content.as_buffer().to_pybytes())
            if found:
                yield _batches(_NAMES, [("run", pa.array([path] * len(found))), ("ordinal", pa.array(range(len(found)), pa.int64()))], found)


def _merged(batches):
    """A range's slices of runs, which come run by run, merged; place is the order in the range, the range the task's partition."""
    from pyspark import TaskContext

    runs: dict[str, list] = {}
    for b in batches:
        for name, *row in zip(*(b.column(n).to_pylist() for n in ("run", *_NAMES)), strict=True):
            runs.setdefault(name, []).append(tuple(row))
    number, place, held = TaskContext.get().partitionId(), 0, []
    lead = lambda: [("range", pa.array([number] * len(held), pa.int32())), ("place", pa.array(range(place, place + len(held)), pa.int64()))]
    for row in LoserTree(list(runs.values())):
        held.append(row)
        if len(held) == BATCH:
            yield _batches(_NAMES, lead(), held)
            place, held = place + len(held), []
    if held:
        yield _batches(_NAMES, lead(), held)


def history(spark: SparkSession, path: str) -> DataFrame:
    """range, place and the captures of all archives below path; ascending (range, place) is their global order."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = written(archives.mapInArrow(_runs, f"run string, ordinal long, {_CAPTURE}"), "warc-runs")
    ranges = max(1, -(-runs.count() // RANGE_PAGES))
    dealt = runs.repartitionByRange(ranges, "url_key", "time", F.asc_nulls_last("page_id"), "run", "ordinal").sortWithinPartitions("run", "ordinal")
    return dealt.select("run", *_NAMES).mapInArrow(_merged, f"range int, place long, {_CAPTURE}")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives, reads them back and merges their indexes."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return history(pages.sparkSession, path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
}
