"""WARC: a writer that Spark's text sink carries, and a salvage reader for damaged archives.

Writing: a record per row. Records end with two line ends, which is the sink's line separator, so every part file is an
archive, on any store that Spark writes to. Of records with equal payloads of REVISIT_BYTES or more the one with the
least id is the response; the others are revisits that refer to it. Equal payloads are counted by digest, combined
before the shuffle; only the digests that repeat are joined back.

Files are bounded by bytes: rows are written by classes of payload size, each with as many records to a file as
FILE_BYTES holds of the class's largest.

Reading: each file is read by one task, from the first byte to the last, plain or in gzip members of one or more records.
A record is checked: version line, header fields, length, the two line ends after it, and the digest of its payload.
After a failed check the reader searches for the next version line or gzip member after the start of what failed, resumes
there, and reports the bytes between as a quarantined gap with the reason. What a damaged member still unpacks to is
searched in the same way. Members are unpacked in steps and the next places of both marks are remembered, so time grows
with the file's length however much of it is damaged. A line in a payload that looks like a version line is never taken
for one while records are intact, since their lengths are followed. A revisit is checked against the responses of the id
that it refers to: where none has its digest and length, it is quarantined.

Edge cases: null html is an empty payload; a null id is written as such and read as null; rows that repeat the response's
id are responses too; control characters in a URL are replaced by spaces; an empty table writes no records and gives an
empty result; columns with other names are not used.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, shared_dir, stored

REVISIT_BYTES = 100
#: Bytes of payload in a part file at most, if it has several records; a file is what a reading task holds at once.
FILE_BYTES = 1 << 28
#: Payloads of at most so many bytes make the smallest class, each next class goes as far as 16 times that.
SMALL_BYTES = 1 << 16
#: Digests of payloads that repeat are broadcast up to so many (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: Bytes that are unpacked at once.
_STEP = 1 << 16
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = REVISIT_BYTES, level=None) -> DataFrame:
    """A column `value` with the WARC record of every row of pages (page_id, url, html), less its two last line ends, and
    `level`, the value of an expression over pages."""
    rows = pages.select((F.lit(None) if level is None else level).alias("level"), "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    repeated = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = stored(repeated, "repeated")
    few = repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    told = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull()))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.concat(F.lit(_HTTP), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    fields = [
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", urn("page_id")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("X-Payload-Length", F.col("size").cast("string")),
        ("WARC-Refers-To", F.when(F.col("revisit"), urn("first"))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields))
    return told.select("level", F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Writes the records of pages (page_id, url, html) as part files of WARC below path, which is not there yet."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    level = F.greatest(F.ceil(F.log(size / SMALL_BYTES) / math.log(16)), F.lit(0)).cast("int")
    present = sorted(r[0] for r in pages.select(F.coalesce(level, F.lit(0)).alias("level")).distinct().collect())  # eight at most
    told = records(pages, level=level, **options)
    for k in present or [0]:
        writer = told.filter(F.coalesce("level", F.lit(0)) == k).select("value").write.mode("append" if k != (present or [0])[0] else "error")
        writer.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // (SMALL_BYTES * 16**k))).text(path)


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record at a place; ValueError with what is wrong."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    stop = data.find(_END, version.end() - 2)
    if stop < 0:
        raise ValueError("header has no end")
    fields = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line has no colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", length):
        raise ValueError("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if end > len(data):
        raise ValueError("content is cut off")
    if data[end : end + 4] != _END:
        raise ValueError("no line ends after the content")
    payload = data[begin:end]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(_END)[2]
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("payload digest differs")
    return fields, payload, end + 4


class _Marks:
    """The next version line or gzip member of an archive; each is searched for once however often it is asked for."""

    def __init__(self, data: bytes):
        self.data, self.line, self.member = data, -1, -1

    def after(self, at: int) -> int:
        if self.line < at:
            found = _VERSION.search(self.data, at)
            self.line = found.start() if found else len(self.data)
        if self.member < at:
            found = self.data.find(_MEMBER, at)
            self.member = found if found >= 0 else len(self.data)
        return min(self.line, self.member)


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place unpacks to, where it ends, and what is wrong with it."""
    unzip, parts, view = zlib.decompressobj(31), [], memoryview(data)
    for i in range(at, len(data), _STEP):
        try:
            parts.append(unzip.decompress(view[i : i + _STEP]))
        except zlib.error:
            return b"".join(parts), at, "member can't be unpacked"
        if unzip.eof:
            return b"".join(parts), min(i + _STEP, len(data)) - len(unzip.unused_data), None
    return b"".join(parts), at, "member is cut off"


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(start, end, header fields, payload, None) of every sound record of an archive, and (start, end, None, None, reason)
    of every gap, in order; starts and ends are places in the file and cover it. Of a gzip member, the first sound record
    spans the whole; further ones, and all of a damaged member, have no width, as gaps within it."""
    at, marks = 0, _Marks(data)
    while at < len(data):
        if data.startswith(_MEMBER, at):
            plain, end, wrong = _unpacked(data, at)
            inner = list(salvage(plain)) if not plain.startswith(_MEMBER) else []
            if not wrong and not any(r[2] for r in inner):
                wrong, inner = "member holds no record", []
            where = (at, at) if wrong else (at, end)
            for _, _, fields, payload, reason in sorted(inner, key=lambda r: r[2] is None) if not wrong else inner:
                if fields or not wrong:
                    yield *where, fields, payload, reason
                    where = (where[1], where[1])
            if wrong:
                end = marks.after(at + 1)
                yield at, end, None, None, wrong
        else:
            try:
                fields, payload, end = _record(data, at)
            except ValueError as e:
                end = marks.after(at + 1)
                yield at, end, None, None, str(e)
            else:
                yield at, end, fields, payload, None
        at = end


_FOUND = "file string, start long, end long, record_type string, record_id string, refers_to string, uri string, digest string, length long, payload binary, quarantined string"


def _salvaged(batches, payloads: bool):
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for start, end, fields, payload, reason in salvage(content.as_py()):
                if reason:
                    if rows and rows[-1][-1] and rows[-1][2] == start:  # one gap until the next sound record
                        rows[-1] = (file, rows[-1][1], end, *rows[-1][3:])
                    else:
                        rows.append((file, start, end, *[None] * 7, reason))
                    continue
                full = hashlib.sha256(payload).hexdigest() if fields.get("warc-type") != "revisit" else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                size = len(payload) if fields.get("warc-type") != "revisit" else int(fields.get("x-payload-length", "0"))
                rows.append((file, start, end, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), full, size, payload if payloads else None, None))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each sound record of the archives below path, and one for each gap (quarantined tells why)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda b: _salvaged(b, payloads), _FOUND)


def checked_revisits(found: DataFrame) -> DataFrame:
    """The rows of `read_warc` with the revisits quarantined that agree with no response of the id that they refer to.
    found is read several times: a stored table, or archives that are read again."""
    names = found.columns
    revisit = F.col("quarantined").isNull() & (F.col("record_type") == "revisit")
    sound = found.filter(F.col("quarantined").isNull() & (F.col("record_type") == "response"))
    known = sound.select(F.col("record_id").alias("refers_to"), "digest", "length").distinct().withColumn("_known", F.lit(True))
    told = found.filter(revisit).join(known, ["refers_to", "digest", "length"], "left")
    told = told.withColumn("quarantined", F.when(F.col("_known").isNull(), "revisit agrees with no response")).select(names)
    return found.filter(~F.coalesce(revisit, F.lit(False))).unionByName(told)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(documents(spark, sf_dir, "pages"), path)
    found = checked_revisits(stored(read_warc(spark, path, payloads=False), "found")).filter("quarantined IS NULL")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM f
"""
