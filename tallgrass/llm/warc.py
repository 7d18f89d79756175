"""WARC archives of pages, and their globally ordered capture index.

Writing: every page becomes one WARC record. Of pages with equal payloads that
with the smallest page_id is a response, the others are revisits of it. The
records are written by Spark's text writer, whose line separator is the end of
a WARC record, so that lost tasks leave no half archives.

Reading: each archive is parsed in one stream and yields locally sorted runs
of captures. Runs are cut at splitters, taken from a bounded sample of keys,
into ranges of the global order (URL key, timestamp, page_id); the segments of
a range, one from each run, are merged by a loser tree.

Defined results: a null payload is empty; a null URL leaves out the target URI
and has the key ''; a null page_id is named `null` and never referred to: of
equal payloads without any page_id all are responses; rows of one page_id and
payload are all responses; line breaks in URLs are percent-encoded.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, smallest, stored

END = "\r\n\r\n"
#: Captures in a run that is sorted in memory, and about as many in a range of the merge.
RUN, RANGE = 50_000, 2_000
SAMPLE = 16_384
#: Bytes of payload in an archive, on average at most, as a task reads an archive whole; and records.
ARCHIVE, RECORDS = 128 << 20, 20_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
CAPTURE = "urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
_FIELDS = [f.split()[0] for f in CAPTURE.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in (f.split() for f in CAPTURE.split(", "))])


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: five bytes are eight digits."""
    digest = F.sha1(text)
    part = lambda n: F.lpad(F.conv(F.substring(digest, 10 * n + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme, www., fragment and case don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One column, value: a WARC record without its end. pages: page_id, url, html and date (WARC-Date). Payloads under `least` bytes are always responses."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "date", payload.alias("html"), F.octet_length(payload).alias("n"), base32_sha1(payload).alias("digest"))
    shared = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 AND first IS NOT NULL")
    # Stored, both sides of the join are plain shuffles, of which Spark splits the hot payload's.
    rows = rows.join(stored(shared.drop("times"), "firsts"), ["digest", "n"], "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(_HTTP), F.col("n"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return rows.select(F.concat(head, F.lit(END), block).alias("value"))


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of all pages, gzipped, in a new folder."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    most = max(1, min(RECORDS, int(ARCHIVE / mean)))
    records(pages, least).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked archive, header fields by lower-case name, block) of each record; gzip members may follow one another."""
    packed, offset = raw[:2] == b"\x1f\x8b", 0
    held = bytearray()
    undo = zlib.decompressobj(31) if packed else None
    at = 0
    while at < len(raw) or held:
        fed = at < len(raw)
        if fed:
            piece = raw[at : at + (1 << 20)]
            at += len(piece)
            while undo is not None and piece:
                held += undo.decompress(piece)
                piece = undo.unused_data
                if undo.eof:
                    undo = zlib.decompressobj(31)
            held += piece
        start = 0
        while (stop := held.find(b"\r\n\r\n", start)) >= 0:
            lines = held[start:stop].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            block = stop + 4
            end = block + int(fields.get("content-length", 0))
            if end + 4 > len(held):
                break
            yield offset + start, fields, bytes(held[block:end])
            start = end + 4
        if not fed and not start:
            raise ValueError(f"{len(held)} bytes after the last whole record")
        del held[:start]
        offset += start


def _page_id(name: str | None) -> int | None:
    found = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def capture(archive: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row of CAPTURE; a response's payload is held against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = len(payload)
    if fields["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    elif b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{archive}: the payload at {offset} differs from its digest")
    date = fields.get("warc-date", "")
    return url_key(fields.get("warc-target-uri")), date, _page_id(fields.get("warc-record-id")), size, digest, fields["warc-type"], _page_id(fields.get("warc-refers-to")), archive, offset


def order_of(row: tuple) -> tuple:
    """Place of a capture in the global order; a null page_id goes first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7:]


class LoserTree:
    """Merges sorted runs: inner nodes keep the losers of a tournament, so that the next row replays one path only."""

    def __init__(self, runs: list[Iterable[tuple]], key=order_of):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.heads = [self._next(i) for i in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        for i in reversed(range(len(runs))):
            self._replay(i)

    def _next(self, run: int):
        row = next(self.runs[run], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        """-1 beats all while the tree is built; a run that ended loses to all."""
        if a < 0 or b < 0:
            return a < b
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, run: int) -> None:
        winner, node = run, (run + len(self.runs)) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[run := self.losers[0]]) is not None:
            yield head[1]
            self.heads[run] = self._next(run)
            self._replay(run)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def _runs(splitters: list[tuple]):
    """Archives to segments of sorted runs: (range, run, segment as an Arrow stream)."""

    def cut(run: str, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=order_of)
        keys = [order_of(r) for r in rows]
        edges = [0, *(bisect_left(keys, s) for s in splitters), len(rows)]
        out = []
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(_table(rows[a:b]))
                out.append((n, run, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["range", "run", "segment"])

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, n = [], 0
                archive = path.rpartition("/")[2]
                for offset, fields, block in parse_warc(raw.as_py()):
                    rows.append(capture(archive, offset, fields, block))
                    if len(rows) >= RUN:
                        yield cut(f"{archive}#{n}", rows)
                        rows, n = [], n + 1
                if rows:
                    yield cut(f"{archive}#{n}", rows)

    return run


def _merge(key, table):
    """The captures of one range in order, with their place in it."""
    runs = [pa.ipc.open_stream(x).read_all() for x in table.sort_by("run").column("segment").to_pylist()]
    rows = list(LoserTree([list(zip(*(c.to_pylist() for c in t.columns), strict=True)) for t in runs]))
    merged = _table(rows)
    return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), *merged.columns], names=["range", "place", *_FIELDS])


def splitters_of(pages: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 places in the global order, evenly spaced in a sample of SAMPLE pages of the smallest hashes; beyond SAMPLE ranges, all of the sample."""
    sample = smallest(pages.select("url", "date", "page_id"), F.xxhash64("page_id", "url"), SAMPLE, "page_id", "url").collect()
    keys = sorted((url_key(r.url), r.date or "", r.page_id is not None, r.page_id or 0, ()) for r in sample)
    ranges = min(ranges, len(keys))
    return sorted({keys[len(keys) * n // ranges] for n in range(1, ranges)}) if keys else []


def capture_histories(spark: SparkSession, path: str, splitters: list[tuple]) -> DataFrame:
    """All captures in the archives under path: CAPTURE with range and place. By (range, place) they are in global order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    segments = files.mapInArrow(_runs(splitters), "range int, run string, segment binary")
    return segments.groupBy("range").applyInArrow(_merge, f"range int, place long, {CAPTURE}")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) written as archives into the shared folder and read back as capture histories.

    Without a column date, a page was captured page_id seconds into 2024.
    """
    spark = pages.sparkSession
    date = F.col("date") if "date" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select("page_id", "url", "html", date.alias("date"))
    ranges = max(1, pages.count() // RANGE)
    path = new_path(spark, "warc")
    write_warc(rows, path, least)
    return capture_histories(spark, path, splitters_of(rows, ranges))


#: DuckDB SQL for the digest of round_trip(pages).
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM q
"""
