"""WARC archives of pages and their globally ordered capture index.

Archives: every page becomes a record (WARC/1.1 with an HTTP head, files compressed by gzip). Of records with equal payloads of at
least min_payload bytes the one with the smallest page_id is the response and the others revisit it. Spark's text writer lays the
archives down in the shared folder (each record ends with CRLF CRLF, the last of which is the writer's line separator), so the job
needs no file access of its own on executors. Spark's text reader reads them back as a stream, cut at the version line; records
are put together again by Content-Length, so a payload may hold that line, and a task holds one record at a time however large an
archive is. The writer makes one gzip member a file: offsets in the index are those of the uncompressed archive.

Index: each archive gives runs of captures sorted by (URL key, timestamp, page_id), RUN_ROWS long at most. Runs are cut by ranges of
that key and of the record's place, which is unique, so a URL with very many captures spreads over several ranges; each range merges
its k runs with a loser tree. The result is globally ordered: ranges by their number, captures by their position in the range.

The pages have no capture time, so the record's date counts page_id seconds from 2000-01-01.

Defined cases: a null html counts as empty; a null url is written as an empty target; a null page_id is kept (dated at the
epoch): it revisits an equal page that has an id, or else is a response; rows that repeat the response's page_id and payload
are responses too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, short_batches, table, text_bytes, written

EPOCH = dt.datetime(2000, 1, 1)
#: Records that one archive takes at most, and captures that one range of the index merges on average.
ARCHIVE_RECORDS = 10_000
RANGE_ROWS = 200_000
#: Captures that are sorted in memory at once.
RUN_ROWS = 50_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, no scheme, port, www or fragment, lower case, sorted query."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.IGNORECASE).partition("#")[0]
    host, slash, path = rest.partition("/")
    host, mark, query = host.partition("?") if not slash else (host, "", "")
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", host.rpartition("@")[2].lower()))
    path, mark2, query2 = path.partition("?")
    query = "&".join(sorted((query or query2).lower().split("&"))) if mark or mark2 else ""
    return ",".join(reversed(host.split("."))) + ")/" + path.rstrip("/").lower() + ("?" + query if query else "")


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so that each output replays one path of log2(k) matches."""

    def __init__(self, runs: list[list], key: Callable = lambda x: x):
        self.runs, self.key = [r for r in runs if r], key
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and self.heads[a] is not None
        return self.heads[a] < self.heads[b] or (self.heads[a] == self.heads[b] and a < b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:  # while the tree is built, the first to arrive waits
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[(w := self.losers[0])] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


VERSION = "WARC/1.1\r\n"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    date = (EPOCH + dt.timedelta(seconds=min(max(page_id or 0, 0), 10**11))).isoformat() + "Z"
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {quote(url or '', safe='-_.~:/?#[]@!$&()*+,;=%' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION.encode() + "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.partition(": ")[::2] for line in head.decode().split("\r\n"))


def parse_archive(parts: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of each record of an archive that comes cut at every VERSION line (the first part is empty); holds one
    record at a time."""
    parts, at, missing = iter(parts), 0, 0
    pending: list[bytes] = []
    if next(parts, b""):
        raise ValueError("no record at 0")
    for part in parts:
        if not pending:
            head, end, _ = part.partition(b"\r\n\r\n")
            if not end:
                raise ValueError(f"the record at {at} has no end")
            header = _fields(head)
            missing = len(head) + int(header["Content-Length"]) + 8
        missing -= len(part) + (len(VERSION) if pending else 0)
        pending.append(part)
        if missing > 0:  # a version line in the payload
            continue
        data = VERSION.encode().join(pending)
        if missing or not data.endswith(b"\r\n\r\n"):
            raise ValueError(f"the record at {at} has another length")
        yield at, header, data[len(head) + 4 : -4]
        at += len(VERSION) + len(data)
        pending = []
    if pending:
        raise ValueError(f"the record at {at} has no end")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "first"))
        out = [_record(i, u, t, payload_digest(t), None if f is None or f == i else f) for i, u, t, f in zip(ids, urls, text_bytes(batch, "html"), firsts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Writes the archives below path, one or more for each task."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1("html"))
    # Only digests are gathered, summed up before they are shuffled. The join is one that Spark can split where many pages are equal.
    # It is written first, so that Spark knows its size: where it is small it goes to the pages, else both are shuffled.
    equal = own.where(F.octet_length("html") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first")
    equal = written(equal)
    short_batches(pages.sparkSession)
    dealt = own.join(equal, "sha", "left").select("page_id", "url", "html", "first")
    dealt.mapInArrow(_records, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


_CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
_COLUMNS = [x.split()[0] for x in _CAPTURE.split(", ")]


def _order(capture: tuple) -> tuple:
    """By URL key, time and page, then by the record's place."""
    return capture[0], capture[1], -1 if capture[2] is None else capture[2], capture[7], capture[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive as sorted runs; digests of responses are computed anew and compared."""

    def parts() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column("path").to_pylist(), text_bytes(batch, "value"), strict=True)

    for path, own in groupby(parts(), key=lambda x: x[0]):
        run, first = [], 0
        for at, h, block in parse_archive(x[1] for x in own):
            head, _, body = block.partition(b"\r\n\r\n")
            number, refers = (re.fullmatch(r"<urn:page:(-?\d*)>", h.get(k, "<urn:page:>"))[1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(_fields(head)["Content-Length"])
            if h["WARC-Type"] == "response" and (payload_digest(body) != digest or len(body) != size):
                raise ValueError(f"{path}, {at}: the payload differs from its digest")
            run.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], int(number) if number else None, size, digest, h["WARC-Type"], int(refers) if refers else None, path, at))
            if len(run) == RUN_ROWS:
                yield from _run_rows(run, first)
                run, first = [], first + len(run)
        yield from _run_rows(run, first)


def _run_rows(run: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
    run.sort(key=_order)
    for lo in range(0, len(run), 5000):
        part = run[lo : lo + 5000]
        columns = [*zip(*part, strict=True), [first] * len(part), range(first + lo, first + lo + len(part))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_SCHEMA.types, strict=True)], schema=_RUN_SCHEMA)


_TYPES = {"string": pa.string(), "long": pa.int64()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in _CAPTURE.split(", ")]
_RUN_SCHEMA = pa.schema([*_FIELDS, ("run", pa.int64()), ("seq", pa.int64())])
_INDEX_SCHEMA = pa.schema([*_FIELDS, ("place", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of runs that fell in this range."""
    runs: dict[tuple[str, int], list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*_COLUMNS, "run", "seq"]), strict=True):
            runs.setdefault((row[7], row[-2]), []).append(row)
    for run in runs.values():
        run.sort(key=lambda r: r[-1])  # a shuffle may deliver a run's blocks in any order; seq is the run's own order
    out: list[tuple] = []
    for place, row in enumerate(LoserTree([runs[k] for k in sorted(runs)], _order)):
        out.append((*row[:-2], place))
        if len(out) == 5000:
            yield _block(out)
            out = []
    if out:
        yield _block(out)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_SCHEMA.types, strict=True)], schema=_INDEX_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path, as sorted runs of each archive: run is the number of a run's first record, seq a
    capture's place."""
    short_batches(spark)
    files = spark.read.option("lineSep", VERSION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return files.mapInArrow(_runs, f"{_CAPTURE}, run long, seq long")


def capture_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered index: by range_no, then place."""
    ranges = max(1, -(-captures.count() // range_rows))
    short_batches(captures.sparkSession, 5000)
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "record_offset")
    return dealt.mapInArrow(_merge, f"{_CAPTURE}, place long").withColumn("range_no", F.spark_partition_id())


def archive_and_index(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes the archives, reads them back and merges their captures."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, min_payload)
    return capture_index(written(read_captures(pages.sparkSession, path)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_and_index(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest's base32 is spelt out, since DuckDB has none: hex digits to bits, five bits to a letter.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY sha1(html)) AS first_id FROM p
),
b AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', hex[i]) - 1), 4)), 'string_agg', '') AS bits FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
