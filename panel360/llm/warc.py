"""WARC archives: writing with revisit records, reading back, and one capture index over all files.

Writing. Every row becomes a record, response or revisit, whose block is an HTTP response. Of rows
with equal payloads (by SHA-256) of at least `min_bytes` bytes those with the smallest id are
responses and the others revisits of it, which carry headers only; smaller payloads are always
responses. Spark's text writer puts the records down, the record terminator being its line
separator, so archives land on any file system that Spark writes to; each file is one gzip stream
of at most `records_per_file` records, and offsets are those in the unzipped file.

Reading. Each archive is read as one stream by Content-Length, so nothing in a payload can end a
record early. A response's digest is computed again from its payload.

Index. The captures of each archive are a run, sorted by URL key and time. Captures are range
partitioned by key, time and place, so that one URL may fill several partitions; in each, the runs
are merged by a loser tree. The partitions in order are the capture histories of all URLs.

Defined results: null payload is empty; a null or empty URL is left out of the record and read back
as null; control characters and blanks in a URL are percent-encoded; rows with null id are
responses; repeated rows of the smallest id are each responses; equal keys and times are ordered by
file and offset; an empty table gives archives without records. Other columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator, Sequence
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions.arrow import map_arrow

RECORDS_PER_FILE = 4000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_ENDING = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are eight times four base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean_url(url: Column) -> Column:
    cleaned = url
    for code in [*range(0x21), 0x7F]:
        cleaned = F.replace(cleaned, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), cleaned).otherwise(url)


def _record_id(key: Column) -> Column:
    return F.when(key.isNull(), "<urn:capture>").otherwise(
        F.concat(F.lit("<urn:capture:"), F.url_encode(key.cast("string")), F.lit(">")))


def records(pages: DataFrame, key: str, url: str, payload: str, captured_at: Column,
            min_bytes: int = 0) -> DataFrame:
    """One row per record: `record`, its bytes as text, without the terminator."""
    rows = pages.select(
        F.col(key).alias("key"), _clean_url(F.col(url).cast("string")).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
        F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    rows = rows.withColumn("equal", F.sha2("payload", 256))
    first = (rows.where(F.col("key").isNotNull() & (F.octet_length("payload") >= min_bytes))
             .groupBy("equal").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("equal", "first"))
    rows = rows.join(first, "equal", "left")
    again = F.col("first") < F.col("key")
    block = F.concat(F.lit(_HTTP), F.octet_length("payload").cast("string"), F.lit(_ENDING),
                     F.when(again, "").otherwise(F.col("payload").cast("string")))
    rows = rows.select("*", F.coalesce(again, F.lit(False)).alias("again"), block.alias("block"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("key"))),
        F.concat(F.lit("WARC-Date: "), F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        F.when(F.length("url") > 0, F.concat(F.lit("WARC-Target-URI: "), "url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.when(F.col("again"), F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"))]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(_ENDING), "block").alias("record"))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    (records.write.option("lineSep", _ENDING).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: one URL's captures stand together
    and so do those of one host."""
    try:
        parts = urlsplit((url or "").lower())
        host, rest = parts.netloc.rpartition("@")[2], parts.path or "/"
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + rest + (f"?{parts.query}" if parts.query else "")


def parse_archive(file: str, data: bytes) -> Iterator[dict]:
    """The records of one gzip-compressed archive, in file order."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    offset = 0
    while first := stream.readline():
        size, fields = len(first), {}
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at {offset}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        ending = stream.read(4)
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(h.lower().split(b": ", 1) for h in head.split(b"\r\n")[1:] if b": " in h)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if made != digest:
                raise ValueError(f"{file}: payload at {offset} differs from its digest")
        url = fields.get("warc-target-uri")
        size += len(line) + len(block) + len(ending)
        yield {"url_key": url_key(url), "date": fields["warc-date"], "file": file, "offset": offset,
               "length": size, "record_type": kind, "url": url,
               "key": _key(fields["warc-record-id"]), "payload_digest": digest,
               "payload_bytes": int(http[b"content-length"]),
               "refers_to": _key(fields.get("warc-refers-to", ""))}
        offset += size


def _key(record_id: str) -> str | None:
    marked = record_id.removeprefix("<urn:capture:").removesuffix(">")
    return unquote_plus(marked) if record_id.startswith("<urn:capture:") else None


_CAPTURE = ("url_key string, date string, file string, offset long, length long, "
            "record_type string, url string, key string, payload_digest string, "
            "payload_bytes long, refers_to string")
_ORDER = ["url_key", "date", "offset"]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive below `path`, sorted within each archive: the local runs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string())
                            for f in _CAPTURE.split(", ")])
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                name = file.as_py().rpartition("/")[2]
                rows = sorted(parse_archive(name, data.as_py()),
                              key=lambda r: (r["url_key"], r["date"], r["offset"]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(files, run, _CAPTURE)


class LoserTree:
    """k sorted runs as one. Inner nodes hold the run that lost there, the top the run that won; after
    the winner's row is taken only its path to the top is played again."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.tree = [-1] * max(1, len(runs))
        for run in range(len(runs)):
            self._play(run, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (
            (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b))

    def _play(self, run: int, building: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            other = self.tree[node]
            if other < 0 and building:
                self.tree[node] = run  # waits for the winner of the other side
                return
            if self._beats(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of each row, in order."""
        while self.runs and self.at[winner := self.tree[0]] < len(self.runs[winner]):
            yield winner, self.at[winner]
            self.at[winner] += 1
            self._play(winner)


def merge_runs(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in global order, with `part` and `place` to keep it: within a part, rows are
    ordered by place, and every row of a part comes before those of the next."""
    ranges = [F.col(c) for c in (*_ORDER[:2], "file", "offset")]
    dealt = captures.repartitionByRange(*([partitions] if partitions else []), *ranges)
    runs = dealt.sortWithinPartitions("file", *_ORDER).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*runs.schema.fields, T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(*(table.column(c).to_pylist() for c in (*_ORDER[:2], "file", "offset"))))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i][2] != keys[i - 1][2])]
        tree = LoserTree([keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)])])
        order = pa.array([starts[r] + i for r, i in tree], pa.int64())
        merged = table.take(order).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    return map_arrow(runs, run, schema)
