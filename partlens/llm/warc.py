"""WARC archives: writing with revisit records, reading, and an external merge of their index.

Each page becomes one record; its archive is a text file whose line end is the blank lines that end a WARC record, so
Spark's own writer (any file system, gzip, commit protocol) makes it. Of records with equal payloads of DEDUP_BYTES or
more, that with the smallest page_id is the response and the others are revisits without payload.

Reading an archive walks its records by Content-Length and yields index entries in file order. Entries are dealt to
ranges of (URL key, timestamp, page_id), which splits hosts of any size; within a range each archive's part is a sorted
run, and the runs meet in a loser tree, k at a time with log2(k) comparisons an entry: the ranges one after the
other are the globally ordered capture history.

Defined cases: null html: an empty payload; null url: an empty key; bad dates of capture can't occur, as
captures are timed by page_id where the table has no timestamp; repeated page_ids are records like any other; a page
without an id is timed as 0 and comes after all others with its payload; a payload longer than an archive is an archive of its own, of
2 GB at most; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import fresh_path, materialize, tidy

DEDUP_BYTES = 100
ARCHIVE_BYTES, RANGE_ENTRIES = 64 << 20, 200_000
#: So many payloads at most are known to all tasks.
HOT_DIGESTS = 10_000
END = b"\r\n\r\n"
_ENTRY = "url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload_offset long, archive string"


def url_key(url: str) -> F.Column:
    """The host's labels in reverse order, then path and query: com,example,www)/path?query."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """WARC 1.1 files of all rows (page_id, url, html) under ``path``."""
    src = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    total = src.agg(F.sum("bytes")).first()[0] or 0
    # archives of about ARCHIVE_BYTES before compression
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), total // ARCHIVE_BYTES)
    # digests of one row need no entry; the rest are aggregated before they move
    copies = src.where(F.col("bytes") >= DEDUP_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("size")).where("n > 1")
    # payloads whose copies would overfill an archive, HOT_DIGESTS at most since their bytes are a part of the total
    heavy = F.col("n") * F.col("size") > max(ARCHIVE_BYTES // 4, total // HOT_DIGESTS)
    hot = F.broadcast(copies.where(heavy).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
    firsts = copies.where(~heavy).select(F.col("digest").alias("dealt"), "first")
    # copies of these, and payloads that have no first, are dealt by page; all other rows by the digest that the join needs anyway
    src = src.join(hot, "digest", "left")
    src = src.withColumn("dealt", F.when(F.col("hot") | (F.col("bytes") < DEDUP_BYTES), F.concat_ws(" ", "digest", F.xxhash64("page_id", "url"))).otherwise(F.col("digest"))).repartition(n, "dealt")
    both = src.join(firsts, "dealt", "left").withColumn("first", F.coalesce("hot_first", "first"))
    # a page without an id comes after those with one
    again = F.coalesce((F.col("bytes") >= DEDUP_BYTES) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))), F.lit(False))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    ts = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: "), ts,
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nX-URL-Key: "), url_key("url"),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    both.select("page_id", head.alias("value")).select("value").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


_FIELD = re.compile(rb"([^\r\n:]+):[ ]?([^\r\n]*)\r\n")


def records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], int, int]]:
    """(header fields, payload begin, payload end) of the records of an archive."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        fields = dict(_FIELD.findall(data[at : end + 2]))
        begin = end + len(END)
        stop = begin + int(fields[b"Content-Length"])
        yield fields, begin, stop
        at = stop + len(END)


def inflate(raw: bytes) -> bytes:
    """All members of a gzip file; archives often have one for each record."""
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw) + member.flush())
        raw = member.unused_data
    return b"".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = re.compile(rb"\d+")
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = inflate(content.as_py()) if path.endswith(".gz") else content.as_py()
            rows = []
            for f, begin, stop in records(data):
                kind, digest = f[b"WARC-Type"].decode(), f[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                if kind == "response":
                    found = hashlib.sha256(memoryview(data)[begin:stop]).hexdigest()
                    if found != digest:
                        raise ValueError(f"{path}: a payload differs from its digest")
                size = int(f[b"X-Payload-Length"]) if kind == "revisit" else stop - begin
                ref = number.search(f.get(b"WARC-Refers-To", b""))
                rows.append((f[b"X-URL-Key"].decode(), f[b"WARC-Date"].decode(), int(own[0]) if (own := number.search(f[b"WARC-Record-ID"])) else None, f[b"WARC-Target-URI"].decode(), kind, size, digest, int(ref[0]) if ref else None, begin, path))
            rows.sort(key=_order)  # the archive's run
            yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in _ENTRY.split(", ")), r, strict=True)) for r in rows], schema=_schema())


def _order(row: tuple) -> tuple:
    """By URL key, time and page, without an id first, as Spark orders nulls."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _ENTRY.split(", ")])


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[Any]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), i, x)

    def _less(self, a: int, b: int) -> bool:
        """An ended run loses against all others, an empty place wins while the tree is built."""
        if a < 0 or b < 0:
            return a < b
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (top := self.heads[i := self.tree[0]]) is not None:
            yield top[2]
            self.heads[i] = self._next(i)
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a range, by archive and in order -> one ordered run."""
    got = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
    if got is None or not got.num_rows:
        return
    cols = {c: got.column(c).to_pylist() for c in ("archive", "url_key", "ts", "page_id")}
    runs: dict[str, list[int]] = {}
    for i, a in enumerate(cols["archive"]):
        runs.setdefault(a, []).append(i)
    key = lambda i: _order((cols["url_key"][i], cols["ts"][i], cols["page_id"][i]))
    order = pa.array(list(LoserTree([iter(r) for r in runs.values()], key)), pa.int64())
    yield from got.take(order).to_batches(max_chunksize=8192)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The capture history of all archives under ``path``: index entries in global order of URL key and time."""
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("path", "content")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = materialize(spark, files.repartition(n, "path").mapInArrow(tidy(_read), _ENTRY), "warc-runs")
    # ranges of about RANGE_ENTRIES, so that one fits in a task whatever the size of all
    n = max(n, entries.count() // RANGE_ENTRIES)
    dealt = entries.repartitionByRange(n, "url_key", "ts", "page_id").sortWithinPartitions("archive", "url_key", "ts", "page_id")
    return dealt.mapInArrow(tidy(_merge), _ENTRY)


def capture_history(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives to shared storage and read them back."""
    path = fresh_path(spark, "warc")
    write_archives(spark, pages, path)
    return read_archives(spark, path)
