"""WARC archives with revisit records, and their capture index by external merge.

Writing: the first capture of a payload is a response record, later ones are revisit records without a body that refer to
it. Archives go out through Spark's own writer, several records to a file, to any file system that Spark knows.

Reading: each archive is read and parsed by one task, by content length, and gives a run of index entries sorted by URL
key and timestamp. The key space is cut at sampled keys; every run is cut there too, so that a part holds one sorted piece
per run. Each part merges its pieces with a loser tree. Parts in order, the histories are globally sorted.

Nulls and ties: a null page is an empty payload, a null URL an empty key, a null id is kept and never the smallest if the
payload has another. Rows that agree in id and payload are records of the same type, one each. An empty table gives an
empty result. Only page_id, url and html are read. A payload of any length is one record; it must fit in a task, as the
row that brought it did.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlens.session import scratch_path

LEAST_PAYLOAD = 100  # bytes; smaller payloads are stored again rather than referred to
RECORDS_PER_ARCHIVE = 2000
ENTRIES_PER_PART = 200_000  # index entries that one merge handles
EPOCH = 1_704_067_200  # pages carry no time of capture: it is this second plus the page id
END = "\r\n\r\n"
LAST_KEY = "\U0010ffff"


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes, refers_to): one row per page id and payload; refers_to is set where an earlier page has it.

    Only digests are shuffled. Copies are folded before they meet, so a payload that a third of all pages share costs one
    row per task.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")).distinct()
    first = narrow.where(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Most payloads occur once and need no partner; the others bring few distinct digests, which AQE splits if one is hot.
    joined = narrow.join(first, "digest", "left")
    return joined.select(
        "page_id", "digest", "bytes", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to")
    )


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of one WARC record per row of ``pages``, without the closing blank lines."""
    decided = decide(pages).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "bytes", "refers_to")
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    full = full.join(decided, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Target-URI", clean_url),
        _field("WARC-Date", when),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _field("WARC-Refers-To", _record_id(F.col("refers_to"))),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return full.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Gzipped archives under ``path``; record ends are the line ends of the text writer."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", per_archive).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels in reverse, then the rest: pages of a site, and sites of a domain, are neighbours."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.IGNORECASE)
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    labels = ",".join(reversed(name.removeprefix("www.").split(".")))
    return labels + (f":{port}" if port not in ("", "80", "443") else "") + ")/" + path.partition("#")[0]


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, block, offset in the unpacked archive) of each record, by content length."""
    data = gzip.decompress(content)
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
        end = head + 4 + int(fields["Content-Length"])
        yield fields, data[head + 4 : end], at
        at = end + len(END)


ENTRY = (
    "url_key string, captured string, page_id long, archive string, offset long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string"
)
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _entry(fields: dict[str, str], block: bytes, offset: int, archive: str) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].partition(":")[2]
    else:
        length, digest = len(body), hashlib.sha256(body).hexdigest()
    return (
        url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), archive, offset, fields["WARC-Type"],
        _page(fields["WARC-Refers-To"]) if revisit else None, length, digest,
    )


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, entries): the index entries of each archive, sorted by URL key, timestamp and page."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                archive = name.rpartition("/")[2]
                entries = sorted((_entry(*record, archive) for record in parse_archive(content.as_py())), key=_order)
                columns = list(zip(*entries)) or [()] * len(FIELDS)
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                # Rows leave in order: a run is a stretch of consecutive seq numbers.
                yield pa.record_batch(
                    [pa.array([archive] * len(entries), pa.string()), pa.array(range(len(entries)), pa.int64()),
                     *[pa.array(c, t) for c, t in zip(columns, types)]], names=["run", "seq", *FIELDS])

    return archives.mapInArrow(work, "run string, seq long, " + ENTRY)


class LoserTree:
    """The least head of k sorted streams; taking it costs one comparison per level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.k = len(streams)
        self.heads = [next(s, None) for s in streams]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        """Carry a stream from its leaf to the root, leaving the loser of each match behind."""
        node = (winner + self.k) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.streams[winner], None)
            self._play(winner)


def merge(indexed: DataFrame, per_part: int = ENTRIES_PER_PART) -> DataFrame:
    """All entries of ``runs`` with part and slot; ordered by (part, slot) they are the capture histories in order.

    A part takes a range of (URL key, timestamp, page), so a URL with very many captures is cut by time.
    """
    parts = max(1, -(-indexed.count() // per_part))
    # Range partitioning samples the keys; inside a part the pieces of the runs stay in their own order.
    keyed = indexed.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for run, *entry in zip(*(batch.column(c).to_pylist() for c in ["run", *FIELDS])):
                pieces.setdefault(run, []).append((_order(tuple(entry)), tuple(entry)))
        part = TaskContext.get().partitionId()
        merged = (entry for _, entry in LoserTree([iter(p) for p in pieces.values()]))
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        block: list[tuple] = []

        def flush(first: int) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*block), types)]
            slots = pa.array(range(first, first + len(block)), pa.int64())
            return pa.record_batch([*columns, pa.array([part] * len(block), pa.int32()), slots], names=[*FIELDS, "part", "slot"])

        done = 0
        for entry in merged:
            block.append(entry)
            if len(block) == 10_000:
                yield flush(done)
                done += len(block)
                block = []
        if block:
            yield flush(done)

    return keyed.mapInArrow(work, ENTRY + ", part int, slot long")


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their index; see ``merge`` for the columns."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return merge(runs(spark, path))
