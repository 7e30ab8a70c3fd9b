"""WARC archives of pages, read back into one globally ordered index of captures.

Method: every page becomes a WARC 1.1 record; a repeated payload becomes a revisit record that refers to the first
capture. Records are written by Spark as gzip-compressed archives and read back as streams. Each archive's index is
sorted on its own (a run); ranges of (url key, time, record) are dealt out, and in each range a loser tree merges the
runs' sorted pieces, so that the whole index is in order.

Archives are bounded by `archive_records`; an index range holds about `range_rows` rows. Defined cases: null html is an
empty payload; payloads shorter than `min_bytes` are always responses; among equal payloads the least id is the
response (rows of the same least id all are), a row with a null id refers to it like any other and is a response only
if no id is there; a null capture time is dated 1970-01-01; line breaks in urls are dropped; an empty table gives an
empty index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm.common import pick, remove_at_end, stored
from freshet.session import scratch_dir

BREAK = b"\r\n\r\n"
#: The date of captures whose time is not known.
NO_TIME = "1970-01-01 00:00:00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("url_key string, captured string, page_id string, url string, payload_bytes bigint, payload_digest string,"
          " record_type string, refers_to string, archive string, record bigint")
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(digest, value): one WARC record without its final blank line per page (id, url, html, captured)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("id", "url", "captured", body.alias("html"), F.sha2(body, 256).alias("digest"),
                         F.octet_length(body).alias("size"))
    firsts = known.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("d")).agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = known.join(firsts, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    kept = F.when(again, F.lit("")).otherwise(F.col("html"))
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit("\r\nWARC-Date: "), F.date_format(
            F.coalesce("captured", F.lit(NO_TIME).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), F.translate(F.coalesce(F.col("url"), F.lit("")), "\r\n", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(head) + F.octet_length(kept)).cast("string"), F.lit("\r\n\r\n"), head, kept)
    return rows.select(value.alias("value"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 100,
                   archive_records: int = 20_000) -> None:
    """Write pages (id, url, html, captured) as WARC archives; Spark's committer leaves whole files only."""
    records(pages, min_bytes).write.option("lineSep", BREAK.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", archive_records).text(folder)


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) if host else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def index_entry(head: bytes, block: bytes, archive: str, number: int) -> tuple:
    """The index row of a record; a payload that does not fit its digest fails."""
    warc = fields(head)
    http, _, payload = block.partition(BREAK)
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    if warc["warc-type"] == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {number} in {archive}")
    else:
        size = int(fields(http)["content-length"])
    name = lambda key: warc.get(key, "").removeprefix("<urn:page:").removesuffix(">")
    url = warc["warc-target-uri"]
    return (url_key(url), warc["warc-date"], name("warc-record-id"), url, size, digest, warc["warc-type"],
            name("warc-refers-to") or None, archive, number)


class Reader:
    """Finds records in an archive that comes in pieces, each followed by a blank line; holds one record at most."""

    def __init__(self, archive: str) -> None:
        self.archive, self.number = archive, 0
        self.head: bytes | None = None
        self.need = 0
        self.parts: list[bytes] = []
        self.size = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        data = piece + BREAK
        while data:
            if self.head is None:
                # Pieces end at blank lines, so a header is a piece of its own (a payload's own breaks may precede it).
                self.parts.append(data)
                whole = b"".join(self.parts).lstrip(b"\r\n")
                head, found, data = whole.partition(BREAK)
                if not found:
                    self.parts = [whole]
                    return
                self.head, self.parts, self.size = head, [], 0
                self.need = int(fields(head)["content-length"])
            take = data[:self.need - self.size]
            self.parts.append(take)
            self.size += len(take)
            data = data[len(take):]
            if self.size < self.need:
                return
            yield index_entry(self.head, b"".join(self.parts), self.archive, self.number)
            self.number += 1
            self.head, self.parts = None, []
            data = data.lstrip(b"\r\n")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One index row per record. A compressed archive is read by one task as a stream."""
    pieces = spark.read.option("lineSep", BREAK.decode()).text(folder).select(
        F.col("value").cast("binary").alias("value"), F.input_file_name().alias("archive"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None
        for part in parts:
            rows = []
            for value, archive in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if reader is None or reader.archive != archive:
                    reader = Reader(archive)
                rows += reader.feed(value)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if n in ("payload_bytes", "record") else pa.string())
                     for n, c in zip(NAMES, zip(*rows))], names=NAMES)
        if reader is not None and reader.head is not None:
            raise ValueError(f"{reader.archive} ends inside a record")

    return pieces.mapInArrow(batches, FIELDS)


class LoserTree:
    """Merges sorted lists: inner nodes remember losers, so each row costs one comparison per level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _key(self, run: int):
        if run < 0 or run >= len(self.runs) or self.at[run] >= len(self.runs[run]):
            return None
        return self.runs[run][self.at[run]]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator[tuple]:
        while (row := self._key(self.winner)) is not None:
            yield row
            run = self.winner
            self.at[run] += 1
            node = (run + self.size) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merged_index(index: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """The index in order of (url_key, captured, page_id), with its place; every range is merged from sorted runs."""
    order = ["url_key", "captured", "page_id", "archive", "record"]
    runs = stored(index.sortWithinPartitions("archive", *order[:3]), "runs")
    n = runs.count()
    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("archive", *order[:3], "record")
    at = [NAMES.index(c) for c in order]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list[tuple]] = {}
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                lists.setdefault(row[NAMES.index("archive")], []).append((tuple(row[i] or "" if i != at[4] else row[i] for i in at), row))
        place = TaskContext.get().partitionId() << 33
        rows, held = [], 0
        for held, (_, row) in enumerate(LoserTree(list(lists.values())), 1):
            rows.append((*row, place + held))
            if len(rows) == 10_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if n in ("payload_bytes", "record", "place") else pa.string() for n in (*NAMES, "place")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*NAMES, "place"])

    return dealt.mapInArrow(batches, FIELDS + ", place bigint")


def capture_history(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
                    captured: str | None = None, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Write the pages' archives to a folder (a scratch one by default) and give their merged index.

    Without a capture time, pages are dated one second after the other by their numeric ids.
    """
    if folder is None:
        folder = scratch_dir(spark, "warc")
        remove_at_end(spark, folder)
    plain = pick(pages, id=page_id, url=url, html=page, **({"captured": captured} if captured else {}))
    if not captured:
        second = F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.lit(3_000_000_000))
        plain = plain.withColumn("captured", F.timestamp_seconds(F.lit(1_704_067_200) + second))
    write_archives(spark, plain, folder, min_bytes)
    return merged_index(read_index(spark, folder))
