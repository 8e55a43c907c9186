"""WARC archives of pages, and a merged index of their captures.

Writing goes through Spark's own writer, as each record is text that ends in a line feed: any file system that Spark
can reach will do. A file is one gzip stream with a bounded number of records, sorted by URL without scheme and id: a run.
Reading parses whole records by their lengths, so payloads may contain anything, record headers too. The index of all
runs is dealt into ranges of (URL key, time, id), and each range's runs are
sorted again by that key in memory (whole range) and merged with a loser tree; a
URL captured very often is spread over several ranges.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotatlas.llm.common import shuffle_partitions

#: Payloads of fewer bytes are never stored as revisits.
LEAST_BYTES = 1000
#: Records in one file.
RUN_RECORDS = 500
#: Parts into which the copies of one payload are dealt when they look up the page that keeps it.
PARTS = 16
#: Pages have no time of their own: capture n is n seconds after this one.
FIRST_CAPTURE = "2024-01-01 00:00:00"
#: Seconds a capture lies from the first one at most, so that every date has a year of four digits. Ids beyond share the last date.
LAST = 60_000_000_000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url_key", T.StringType()), T.StructField("captured_at", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("archive", T.StringType()), T.StructField("record_offset", T.LongType()), T.StructField("record_length", T.LongType())])


def classified(pages: DataFrame) -> DataFrame:
    """`page_id, url, html, refers_to`: null for pages stored as responses, else the largest id with the same payload.

    Null payloads are empty. Rows that repeat the id of a response are responses too.
    """
    whole = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = whole.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= LEAST_BYTES)
    kept = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = keys.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int"))
    revisits = dealt.join(kept, ["digest", "size", "part"]).where(F.col("page_id") < F.col("refers_to"))
    revisits = revisits.select(F.col("page_id").alias("copy"), F.col("digest").alias("of"), "refers_to").distinct()
    same = (F.col("page_id") == F.col("copy")) & (F.sha1("html") == F.col("of"))
    return whole.join(revisits, same, "left").select("page_id", "url", "html", "refers_to")


def record(page_id: Column, url: Column, html: Column, refers_to: Column) -> Column:
    """A whole record but for its last line feed."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(refers_to.isNull(), html).otherwise(F.lit("")))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + F.coalesce(F.greatest(F.least(page_id, F.lit(LAST)), F.lit(-LAST)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    link = F.when(refers_to.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(f">{CRLF}WARC-Profile: {PROFILE}{CRLF}")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(refers_to.isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Date: "), when,
        F.lit(f"{CRLF}WARC-Target-URI: "), safe, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.sha1(html), F.lit(CRLF), link,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF * 2), block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str) -> None:
    """Archive every page below a path, in sorted runs of bounded size."""
    made = classified(pages)
    text = record(F.col("page_id"), F.col("url"), F.col("html"), F.col("refers_to"))
    key = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), "^[a-z]+://", "")
    rows = made.select(key.alias("key"), "page_id", text.alias("value")).sortWithinPartitions("key", "page_id")
    rows.select("value").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RUN_RECORDS).text(path)


def url_key(url: str) -> str:
    """Host turned round, then path and query, all lower case: pages of a host and its subdomains stand together."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    turned = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{turned}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def captures(archive: str, content: bytes) -> Iterator[tuple]:
    """Records of one archive, in the order of CAPTURE. Broken framing or a wrong digest is an error."""
    data = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 2
        head = {k.strip().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(data, data.index(b"\r\n", at) + 2, head_end)}
        start = head_end + 2
        end = start + int(head[b"content-length"])
        if data[end:end + 4] != b"\r\n\r\n" or not data.startswith(b"WARC/", at):
            raise ValueError(f"{archive}: broken record at {at}")
        http_end = data.index(b"\r\n\r\n", start) + 4
        http = {k.strip().lower(): v for k, v in _HEADER.findall(data, start, http_end)}
        digest = head[b"warc-payload-digest"].removeprefix("sha1:")
        size = int(http[b"content-length"])
        if head[b"warc-type"] == "response" and (end - http_end != size or hashlib.sha1(data[http_end:end]).hexdigest() != digest):
            raise ValueError(f"{archive}: payload at {at} differs from its digest")
        of = re.search(r"urn:page:(-?\d+)", head.get(b"warc-refers-to", ""))
        page = re.search(r"urn:page:(-?\d+)", head[b"warc-record-id"])
        yield (int(page[1]) if page else None, url_key(head[b"warc-target-uri"]), head[b"warc-date"], head[b"warc-type"],
               int(of[1]) if of else None, size, digest, archive, at, end + 4 - at)
        at = end + 4


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list[tuple]], key: Callable[[tuple], tuple]):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.heads = [self._take(k) for k in range(len(runs))]
        self.losers = [-1] * len(runs)
        for k in range(len(runs)):
            self._play(k)

    def _take(self, k: int):
        row = next(self.runs[k], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        """Run a goes before run b; spent runs lose, ties go by number of the run."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) <= (y[0], b))

    def _play(self, k: int) -> None:
        node = (k + len(self.losers)) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = k
                return
            if self._beats(self.losers[node], k):
                self.losers[node], k = k, self.losers[node]
            node //= 2
        self.losers[0] = k

    def __iter__(self) -> Iterator[tuple]:
        while self.losers and self.heads[self.losers[0]] is not None:
            k = self.losers[0]
            yield self.heads[k][1]
            self.heads[k] = self._take(k)
            self._play(k)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema, held = to_arrow_schema(CAPTURE), []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All captures in the archives below a path. A task holds one archive at a time."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name, content in zip(batch.column("path"), batch.column("content")):
                    yield from captures(name.as_py().rpartition("/")[2], content.as_py())
        yield from _batches(rows())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, CAPTURE)


def merge_index(runs: DataFrame) -> DataFrame:
    """Captures in global order of (url_key, captured_at, page_id): partitions are ranges, each merged from its runs."""
    def order(row: tuple) -> tuple:
        return row[1], row[2], -1 if row[0] is None else row[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                by_run.setdefault(row[7], []).append(row)
        yield from _batches(iter(LoserTree([sorted(r, key=order) for r in by_run.values()], order)))

    dealt = runs.repartitionByRange(shuffle_partitions(runs.sparkSession), "url_key", "captured_at", "page_id")
    return dealt.mapInArrow(merge, CAPTURE)


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (`page_id, url, html`) as archives below a new path, read them back, and give their merged index.

    An empty table gives an empty index. Other columns of the pages are left out.
    """
    write(pages, path)
    return merge_index(read(pages.sparkSession, path))
