"""WARC archives with an external index merge.

Pages are written as WARC/1.1 records: text files whose record separator is the format's own CRLF CRLF, which
is what Spark's text writer puts after each record. Of equal payloads of at least REVISIT_BYTES one is the
response, the others are revisits of it. Reading parses whole files by Content-Length. Each task sorts the index
entries of its files into runs of at most RUN_ROWS, which are written to the shared folder. Splitters sampled from
the runs cut them into ranges of about RANGE_ROWS entries; the runs' pieces of a range are merged by a loser tree by
(URL key, timestamp, page), which gives capture histories in global order. A run's place and number break ties, so
that captures that agree in all three can be split as well. A task holds one range; the driver holds at most
SAMPLE_ROWS sampled keys (beyond SAMPLE_ROWS / SAMPLE ranges, ranges grow instead).

Defined cases: a null html is an empty payload; a null url is written without target and sorts first; a null
page_id stays null and is never referred to unless no other page has the payload; rows that repeat a page_id
with the same payload are each what that page is; an empty table gives an empty result. Control characters and
white space in URLs are percent-encoded in the archive.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, hand_back, materialise, maybe_broadcast, partitions, remove, shared_path, table_path

#: Smaller payloads are always stored.
REVISIT_BYTES = 1000
#: Payload bytes of a file on average, and the most it can have; bound what a reader holds. Pages of more than
#: LARGE_BYTES have files of their own, so they don't decide how many records the others' files hold.
FILE_BYTES = 8_000_000
FILE_BOUND = 128_000_000
LARGE_BYTES = 4_000_000
#: Entries of a run, which a task sorts at once, and of a range, which a task merges at once.
RUN_ROWS = 50_000
RANGE_ROWS = 20_000
#: Index keys sampled per range for the splitters and in all, and the longest prefix of a key among them.
SAMPLE = 40
SAMPLE_ROWS = 1_000_000
KEY_CHARS = 200
#: Pages without a capture time get this one plus their id in seconds.
EPOCH = "2020-01-01T00:00:00Z"

_ENTRY = ["urlkey", "stamp", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_ENTRY_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_ENTRY_DDL = "urlkey string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_END = b"\r\n\r\n"


def records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, url, html, n, sha1, refers_to, stamp of what is to be written, and the table of payloads held twice."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary"))})
    rows = rows.withColumn("stamp", F.date_format(F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(secs=F.coalesce("page_id", F.lit(0)).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.select("page_id", F.octet_length("html").cast("long").alias("n"), F.sha1(F.col("html").cast("binary")).alias("sha1")).where(F.col("n") >= REVISIT_BYTES)
    first = slim.groupBy("n", "sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = materialise(first, "responses")  # so that a payload held by very many pages can be split in the join
    rows = rows.join(maybe_broadcast(first, first.count(), 80), ["n", "sha1"], "left")
    return rows.withColumn("refers_to", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))).drop("response"), first


def _as_text(rows: DataFrame) -> DataFrame:
    """One string per record: headers, block; the separator is the writer's."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace("url", "%(?![0-9A-Fa-f]{2})", "%25")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code else url
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), "stamp",
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(""), F.lit("\r\nWARC-Payload-Digest: sha1:"), "sha1",
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    return rows.select(head.alias("value"))


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write WARC files of about FILE_BYTES and return their folder."""
    spark = pages.sparkSession
    bound_batches(spark)
    path = path or shared_path(spark, "warc")
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    common = F.when(size <= LARGE_BYTES, size)
    total, largest, count, pages_in_all = pages.agg(F.sum(common), F.max(common), F.count(common), F.count("*")).first()
    # files are cut by a number of records, so pages are written by the tasks that read them, without a shuffle
    per_file = max(1, min(FILE_BYTES * count // max(1, total or 0), FILE_BOUND // max(1, largest or 0)))
    rows, first = records(pages)
    written = lambda part, n, mode: _as_text(part).write.mode(mode).option("maxRecordsPerFile", n).option("lineSep", "\r\n\r\n").text(path)
    written(rows.where(F.col("n") <= LARGE_BYTES), per_file, "error")
    if count < pages_in_all:
        written(rows.where(F.col("n") > LARGE_BYTES), 1, "append")
    remove(spark, table_path(first))
    return path


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then the path: neighbours in the order are neighbours on the web."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}"


def parse(content: bytes) -> Iterator[dict]:
    """Entries of one archive file; every response's payload is checked against its digest."""
    at = 0
    while at < len(content):
        stop = content.index(_END, at)
        lines = content[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not at a record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        body = content.index(_END, begin) + 4
        n = int(content[begin:body].rsplit(b"Content-Length: ", 1)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (end - body != n or hashlib.sha1(memoryview(content)[body:end]).hexdigest() != digest):
            raise ValueError("a payload differs from its digest")
        if content[end : end + 4] != _END:
            raise ValueError("a record does not end where it should")
        page, other = head["WARC-Record-ID"][10:-1], head.get("WARC-Refers-To", "")[10:-1]
        url = head.get("WARC-Target-URI")
        yield {"urlkey": url_key(url), "stamp": head["WARC-Date"], "page_id": None if page == "none" else int(page), "url": url, "payload_bytes": n, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(other) if other else None}
        at = end + 4


def _keys(columns: list[list]) -> list[tuple]:
    """Merge keys of rows given by their columns: URL key, timestamp, page (none first), run, place in it."""
    return [(url, stamp, page is not None, page or 0, run, nth) for url, stamp, page, run, nth in zip(*columns)]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = list(parse(content.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(_ENTRY, _ENTRY_TYPES)], _ENTRY)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archive files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_indexed, _ENTRY_DDL)


_KEY = ["urlkey", "stamp", "page_id", "run", "nth"]
_RUN_DDL = "run long, nth long, " + _ENTRY_DDL


def _sorted_runs(run_rows: int):
    """Sorted runs of a task's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks()
            order = pc.sort_indices(table, [(c, "ascending") for c in _KEY[:3]], null_placement="at_start")
            table, n = table.take(order), table.num_rows
            held, number = [], number + 1
            yield from pa.table({"run": pa.array([number] * n, pa.int64()), "nth": pa.array(range(n), pa.int64())} | {c: table.column(c) for c in _ENTRY}).to_batches(5000)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, run_rows - sum(b.num_rows for b in held))
                held.append(some)
                at += some.num_rows
                if sum(b.num_rows for b in held) >= run_rows:
                    yield from close()
                    hand_back()
        if held:
            yield from close()

    return run


def _cut(splitters: list[tuple]):
    """The range of each row of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys([batch.column(c).to_pylist() for c in _KEY])
            ranges = pa.array([bisect.bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, *batch.columns], ["range", *batch.schema.names])

    return run


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so each pop replays one path of log2 k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.size = runs, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.losers = [0] * self.size
        winner = [0] * (2 * self.size)
        for i in range(2 * self.size - 1, 0, -1):
            if i >= self.size:
                winner[i] = i - self.size
            else:
                a, b = winner[2 * i], winner[2 * i + 1]
                winner[i], self.losers[i] = (b, a) if self._less(b, a) else (a, b)
        self.top = winner[1]

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[0] < y[0])

    def __iter__(self):
        while (item := self.head[self.top]) is not None:
            yield item
            i = self.top
            self.head[i] = next(self.runs[i], None)
            node = (i + self.size) // 2
            while node:
                if self._less(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.top = i


def _merged_range(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Merge the runs of one range; rows come by run and by their places in it."""
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = _keys([table.column(c).to_pylist() for c in _KEY])
    starts = [i for i, k in enumerate(keys) if i == 0 or k[4] != keys[i - 1][4]]
    runs = [((keys[i], i) for i in range(low, high)) for low, high in zip(starts, [*starts[1:], len(keys)])]
    merged = table.take(pa.array([i for _, i in LoserTree(runs)], pa.int64())).combine_chunks()
    n = table.num_rows
    columns = [merged.column(c).chunk(0) for c in _ENTRY]
    return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()), *columns], ["range", "place", *_ENTRY])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges come one after the other; one is held."""
    number, held = None, []
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and ranges[low] != number:
                yield _merged_range(number, held)
                hand_back()
                held = []
            number = int(ranges[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield _merged_range(number, held)


def merge_index(entries: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Entries in global order: range, then place in it."""
    spark = entries.sparkSession
    runs = materialise(entries.mapInArrow(_sorted_runs(run_rows), _RUN_DDL), "index-runs")
    count = runs.count()
    # enough ranges to bound a task, and as many as there are tasks where they are few
    ranges = max(1, min(max(-(-count // range_rows), min(partitions(spark), count // 1000)), SAMPLE_ROWS // SAMPLE))
    splitters = []
    if ranges > 1:
        share = min(count, SAMPLE * ranges)
        drawn = F.pmod(F.xxhash64("run", "nth"), F.lit(count)) < share
        keys = sorted(_keys(list(zip(*(tuple(r) for r in runs.where(drawn).select(F.substring("urlkey", 1, KEY_CHARS), *_KEY[1:]).collect())))))  # about ``share``
        splitters = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    cut = runs.mapInArrow(_cut(splitters), "range int, " + _RUN_DDL).repartitionById(len(splitters) + 1, "range").sortWithinPartitions("range", "run", "nth")
    return cut.mapInArrow(_merged, "range int, place long, " + _ENTRY_DDL)


def capture_histories(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back and merge their index; the archives go when the process ends."""
    spark = pages.sparkSession
    return merge_index(read_archives(spark, write_archives(pages)))
