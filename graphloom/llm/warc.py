"""Operator 5, WARC archives with an index from an external merge.

Archives are written by Spark's own text writer, one record a row, so they commit like any job and reach any file system
Spark knows; a record is header, HTTP head and payload, with a blank line after it. Of equal payloads one is a response
and the others are revisit records that refer to it. Reading goes by Content-Length and checks every payload against its
digest. The captures of an archive form a run, sorted by URL key, time and id; runs are dealt to key ranges of bounded
size and each range merges its runs with a loser tree, so partitions in order are the global capture history. Record ids
are unique in a writing, repeated rows and null ids included; page ids travel in fields of their own.

Defined results: null html is an empty payload; null ids and URLs are written as empty; a URL's control characters and
blanks are percent-encoded, each by its own code; rows that share both payload and smallest id are all responses, and their
revisits name the page but no record; a null id is never chosen
while another id has the payload; an empty table gives an empty index. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import pinned, removed, shared_dir, spread, table

#: Digits of conv() in base 32 and of RFC 4648.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads that occur more than once are looked up by broadcast while there are at most so many (about 100 bytes each).
BROADCAST_COPIES = 100_000
#: Payloads above LARGE are kept apart; no archive exceeds ARCHIVE_BYTES unless one record does.
LARGE, ARCHIVE_BYTES = 1 << 20, 1 << 30
#: Captures of a key range that one task merges (some hundred bytes each).
RANGE_ROWS = 100_000
ENTRY = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four times ten hex digits are eight base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row per row of pages, with ``value``: the record as text, without the last line end of its closing blank line, and ``size``, its payload's bytes."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("size", F.octet_length("payload").cast("long"))
    each = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("k"))
    ids = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "k")
    copies = pinned(each.groupBy("digest").agg(F.min(ids).alias("first"), F.sum("k").alias("n")).filter("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.k").alias("firsts"), F.lit(True).alias("shared")))
    known = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else spread(copies)
    both = rows.join(known, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= least_bytes)
    crlf = "\r\n"

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def uid(c: str, *more: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), text(c), F.lit(":"), F.col("digest"), *more, F.lit(">"))

    # A payload's only first record has the plain id, which its revisits name; other rows of a shared payload are numbered.
    plain = F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("firsts") == 1))
    own = F.when(plain, uid("page_id")).otherwise(uid("page_id", F.lit(":"), F.monotonically_increasing_id().cast("string")))
    odd = F.coalesce("url", F.lit(""))
    for code in (*range(0x21), 0x7F):
        odd = F.replace(odd, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    safe = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), odd).otherwise(F.coalesce("url", F.lit("")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=UTF-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf * 2))
    block = F.when(again, head).otherwise(F.concat(head, F.col("payload")))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % F.lit(100_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.when(F.col("firsts") == 1, F.concat(F.lit(f"{crlf}WARC-Refers-To: "), uid("first"))).otherwise(F.lit(""))
    value = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "), own, F.lit(f"{crlf}WARC-Target-URI: "), safe, F.lit(f"{crlf}WARC-Date: "), date,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{crlf}X-Page-Id: "), text("page_id"),
        F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), refers, F.lit(f"{crlf}X-Refers-To-Page-Id: "), text("first"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf * 2), block, F.lit(crlf),
    )
    return both.select("page_id", "size", value.alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 1000, **columns: str) -> None:
    """WARC files below path, of at most records_per_file records and ARCHIVE_BYTES: payloads above LARGE get files of their own, with as many records as always fit."""
    made = records(pages, **columns)
    longest = made.agg(F.max("size")).first()[0] or 0
    parts = [("small", F.col("size") <= LARGE, records_per_file)]
    if longest > LARGE:
        parts.append(("large", F.col("size") > LARGE, max(1, min(records_per_file, ARCHIVE_BYTES // (longest + LARGE)))))
    for name, part, most in parts:
        made.filter(part).select("value").write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def url_key(url: str) -> str:
    """Host labels from the right, then path and query in lower case."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def parsed(name: str, data: bytes) -> list[tuple]:
    """The captures of an archive, as rows of ENTRY."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at} of {name}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        body = data.index(b"\r\n\r\n", start) + 4
        http = dict(x.decode().lower().split(": ", 1) for x in data[start : body - 4].split(b"\r\n")[1:])
        kind, digest, n = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        if kind == "response":
            payload = data[body : start + size]
            if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload at byte {at} of {name} differs from its digest")
        page, first = head["x-page-id"], head.get("x-refers-to-page-id", "")
        when = "".join(c for c in head["warc-date"] if c.isdigit())
        out.append((url_key(head["warc-target-uri"]), when, int(page) if page else None, head["warc-target-uri"], kind, int(first) if first else None, n, digest, name, at, start + size + 4 - at))
        at = start + size + 4
    return out


def order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[9]


def rows_of(entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), schema)], schema=schema)


def arrow_entry() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ENTRY.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path; an archive's rows are a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_entry()
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                if found := sorted(parsed(name.as_py().rpartition("/")[2], data.as_py()), key=order):
                    yield rows_of(found, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(read, ENTRY)


class LoserTree:
    """k sorted runs, merged: an inner node holds the loser of its match, the winner is at the top; a step replays one path."""

    def __init__(self, runs: list[list], key: Callable = order) -> None:
        self.runs, self.at, self.k, self.key = runs, [0] * len(runs), max(1, len(runs)), key
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * self.k
        for run in range(len(runs)):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[run := self.tree[0]] is not None:
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            self._play(run)


def merged_index(captures: DataFrame) -> DataFrame:
    """captures in global order of (url_key, captured, page_id): key ranges of about RANGE_ROWS rows, and within each a merge of the archives' runs.

    Ranges are cut by (url_key, captured, page_id, archive, offset), which no two captures share, so one URL's history may
    span ranges and no task holds more than its range.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        runs: dict[str, list[tuple]] = {}
        cols = (whole.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "offset"))
        for i, (key, when, page, archive, at) in enumerate(zip(*cols)):
            runs.setdefault(archive, []).append((key, when, page is not None, page or 0, archive, at, i))
        for run in runs.values():
            if any(a > b for a, b in zip(run, run[1:])):
                run.sort()  # blocks of a run may come out of turn
        merged = [x[-1] for x in LoserTree(list(runs.values()), key=lambda x: x)]
        for at in range(0, len(merged), 8192):
            yield from whole.take(pa.array(merged[at : at + 8192])).to_batches()

    n = max(1, -(-captures.count() // RANGE_ROWS))
    return captures.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "offset").mapInArrow(merge, ENTRY)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = pinned(read_archives(spark, path))
    removed(spark, path)
    return merged_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
