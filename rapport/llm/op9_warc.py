"""WARC archives of pages: written, read back, and their index merged into one globally ordered history.

Writing: a page whose payload (UTF-8, 100 bytes or more) equals that of a page with a smaller id becomes a ``revisit`` of
the page with the smallest id; all others are ``response``. Records are values of a text table whose line separator is
the end of a WARC record, so Spark's own writer makes the archives, on any store.

Reading: a task parses whole archive files by their content lengths, hashes the payloads and gives an index entry per
record. The entries of one file, in order of URL key and time, are a locally sorted run.

Merging: entries are dealt by range of (URL key, time, record), each task merges its slices of all runs with a loser tree,
and the tasks' results follow one another in order. A URL with most captures is spread by its times.

Defined results: null html is an empty payload (digest of no bytes, response); a null URL has no target line and the key
''; rows that repeat a page id are written each, and as responses if theirs is the smallest id; a null id is always a
response and no page's original; control characters and spaces in URLs are percent-encoded. Payloads are whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rapport.llm.shared import col, shared_folder, staged, table

LEAST_BYTES = 100
#: Records in an archive file at most, and duplicated payloads whose originals are broadcast at most.
FILE_RECORDS, BROADCAST_ORIGINALS = 5_000, 100_000
END = "\r\n\r\n"
ENTRY = ("page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
         "url_key string, captured string, run string, seq bigint, at bigint, length bigint, intact boolean")


def originals(pages: DataFrame) -> DataFrame:
    """digest, original: of payloads that more than one page has."""
    narrow = pages.where("page_id IS NOT NULL").where(F.octet_length("payload") >= LEAST_BYTES)
    return (narrow.groupBy(F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
            .agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original"))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, payload, captured), without the separator at its end."""
    first = staged(originals(pages), "warc-originals")
    few = first.count() <= BROADCAST_ORIGINALS
    tagged = pages.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).join(
        F.broadcast(first) if few else first, "digest", "left")
    revisit = F.coalesce((F.octet_length("payload") >= LEAST_BYTES) & (F.col("page_id") > F.col("original")), F.lit(False))
    url = F.col("url")
    for plain, code in ((r"\r", "%0D"), (r"\n", "%0A"), (r"\t", "%09"), (" ", "%20")):
        url = F.regexp_replace(url, plain, code)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record_id = lambda key: F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.coalesce(line("WARC-Record-ID", record_id(F.col("page_id")))), line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", record_id(F.col("original"))), line("X-Payload-Length", size)))
        .otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    return tagged.select(F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)
                         .alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: pages of a site lie together. Fragments do not count."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


_FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parsed(path: str, data: memoryview) -> list[tuple]:
    """The index run of one archive: entries in order of URL key, time and record."""
    out, at = [], 0
    whole = bytes(data) if not isinstance(data, bytes) else data
    while at < len(whole):
        split = whole.index(b"\r\n\r\n", at) + 4
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(whole, at, split)}
        size = int(fields["content-length"])
        stop = split + size
        page = _PAGE.fullmatch(fields.get("warc-record-id", ""))
        refers = _PAGE.fullmatch(fields.get("warc-refers-to", ""))
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "revisit":
            length, found = int(fields["x-payload-length"]), digest
        else:
            body = whole.index(b"\r\n\r\n", split) + 4
            length, found = stop - body, hashlib.sha256(memoryview(whole)[body:stop]).hexdigest()
        out.append((int(page[1]) if page else None, fields["warc-type"], int(refers[1]) if refers else None, length, found,
                    url_key(fields.get("warc-target-uri", "")) if "warc-target-uri" in fields else "",
                    fields.get("warc-date", ""), path, at, stop - at, found == digest))
        at = stop + len(END)
    out.sort(key=lambda e: (e[5], e[6], e[0] is not None, e[0] or 0, e[8]))
    return [(*e[:8], i, *e[8:]) for i, e in enumerate(out)]


_NAMES = [part.split()[0] for part in ENTRY.split(", ")]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[part.split()[1]]) for column, part in zip(zip(*entries), ENTRY.split(", "))], _NAMES)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of all archives in a folder; those of one file are one sorted run (``run``, ``seq``)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                entries = parsed(path, content.as_buffer().to_pybytes())
                if entries:
                    yield _batch(entries)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(read, ENTRY)


class LoserTree:
    """Merges sorted iterators: each step replays one path from the last winner's leaf, comparing with the losers kept there."""

    def __init__(self, iterators: list[Iterator]):
        self.inputs = iterators
        self.heads = [next(it, None) for it in iterators]
        self.n = max(len(iterators), 1)
        self.losers = [-1] * self.n
        self.winner = -1
        for leaf in range(len(iterators)):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """An exhausted input comes last; equal heads keep the order of the inputs."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int) -> None:
        node, contender = (leaf + self.n) // 2, leaf
        while node:
            kept = self.losers[node]
            if kept < 0:                    # while the tree fills, the first to come waits here
                self.losers[node] = contender
                return
            if self._before(kept, contender):
                self.losers[node], contender = contender, kept
            node //= 2
        self.winner = contender

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.heads[leaf][1]
            self.heads[leaf] = next(self.inputs[leaf], None)
            self._replay(leaf)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index: its slices of all runs, which come one after the other, become one sorted run."""
    slices: dict[str, list[tuple]] = {}
    at = {name: i for i, name in enumerate(_NAMES)}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for entry in zip(*columns):
            key = (entry[at["url_key"]], entry[at["captured"]], entry[0] is not None, entry[0] or 0)
            slices.setdefault(entry[at["run"]], []).append((key, entry))
    pending = []
    for entry in LoserTree([iter(part) for _, part in sorted(slices.items())]):
        pending.append(entry)
        if len(pending) == 10_000:
            yield _batch(pending)
            pending = []
    if pending:
        yield _batch(pending)


def merged(entries: DataFrame) -> DataFrame:
    """All runs as one table in order of URL key, time and record: partition after partition, row after row."""
    dealt = entries.repartitionByRange("url_key", "captured", F.col("page_id").asc_nulls_first())
    return dealt.sortWithinPartitions("run", "seq").mapInArrow(_merge, ENTRY)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", captured=None,
             folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` and return the merged index of what was read back.

    ``captured``: a column with the capture time in ISO form; without one, times follow the ids, a second each
    (modulo 10 ** 9).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if captured is None:
        captured = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(col(key), F.lit(0)), F.lit(10 ** 9))),
                                 "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ready = pages.select(col(key).cast("bigint").alias("page_id"), col(url).alias("url"),
                         F.coalesce(col(html), F.lit("")).alias("payload"), captured.alias("captured"))
    write_archives(ready, folder)
    return merged(staged(runs(spark, folder), "warc-runs"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    history = archived(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "intact")


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS g, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > original THEN original END AS refers_to,
  lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.')), ',') || ')'
    || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
       ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END
    || regexp_extract(url, '^[^?#]*(\?[^#]+)?', 1)) AS url_key, true AS intact
FROM d LEFT JOIN f ON g = payload_digest"""
