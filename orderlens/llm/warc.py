"""WARC archives in which a payload is stored once.

Headers are shuffled by payload digest, records whose payload another record has become revisits of it, and archives are written with fresh headers. Spark's text
writer writes the records, with the record separator for a line's end: archives are committed as any table is, lie wherever Spark can write, and a lost executor costs a
task. That writer compresses a file as one stream and puts nothing before its records, so there is no member for each record and no warcinfo. Spark's text reader reads
them back as a stream, cut at record separators (which payloads may hold as well); each record's Content-Length says where it ends, so no task holds more than a record
and a batch of lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, release, text_of

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload string"


def resolve(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 1000) -> DataFrame:
    """Each page with payload_digest (bare SHA-1), payload_bytes, record_type and refers_to.

    Of pages whose payloads are equal and have `least` bytes or more, that with the largest key is the response and the others revisit it. Smaller payloads are all
    responses. A null payload is empty; a null key is never chosen before another; equal rows with the chosen key are all responses.
    """
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), text_of(payload).alias("payload"))
    raw = F.encode("payload", "UTF-8")
    rows = rows.select("*", F.sha1(raw).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    large = F.when(F.col("payload_bytes") >= least, F.col("payload_digest"))
    headers = rows.select(large.alias("large"), "page_id").where("large is not null")
    groups = cut(headers.groupBy("large").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1"))
    joined = attach(rows.withColumn("large", large), groups, "large", "n", max(1, rows.count()), ["page_id", "payload_digest"])
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def record(date: str) -> Column:
    """A record of resolve()'s row, without the separator that follows it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit(EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.col("record_type"), F.lit(f"{EOL}WARC-Record-ID: "), urn("page_id"), F.lit(f"{EOL}WARC-Date: {date}{EOL}"), F.coalesce(uri, F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(f"{EOL}X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), urn("refers_to"))).otherwise(F.lit("")),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL * 2),
    )
    return F.concat(head, block)


#: Bytes of records that an archive has in the mean, before compression.
ARCHIVE = 256 << 20


def write(resolved: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", per_file: int | None = None, size: int = ARCHIVE) -> None:
    """Archives (.gz) under path of about `size` bytes, by the mean length of the records (of at most per_file records each, if that is given)."""
    rows = resolved.select(record(date).alias("value"))
    if per_file is None:
        mean = resolved.agg(F.avg(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0))).first()[0]
        per_file = max(1, int(size / ((mean or 0) + 500)))
    rows.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class Reader:
    """The records of a stream of bytes, in order; what breaks the format raises."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.held, self.fields, self.need = 0, None, 0

    def feed(self, part: bytes) -> Iterator[dict]:
        """The records that end with this part; parts end with a record separator."""
        self.parts.append(part)
        self.held += len(part)
        if self.fields is None:  # a header ends with the first empty line, as parts do
            head, self.parts, self.held = b"".join(self.parts), [], 0
            if not head.startswith(b"WARC/1."):
                raise ValueError(f"no record begins with {head[:40]!r}")
            self.fields = {}
            for line in head.decode().split(EOL)[1:]:
                name, _, value = line.partition(":")
                if name:
                    self.fields[name.lower()] = value.strip()
            self.need = int(self.fields["content-length"]) + 4
            return
        if self.held < self.need:
            return
        raw, fields, need = b"".join(self.parts), self.fields, self.need
        if raw[need - 4 : need] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} has another length than it says")
        self.parts, self.held, self.fields = [], 0, None
        yield fields | {"payload": raw[: need - 4].partition(b"\r\n\r\n")[2]}
        if raw[need:] not in (b"", b"\r\n\r\n"):  # the end of a payload was taken for the begin of the separator; at a file's end only the separator that was added here is left
            yield from self.feed(raw[need:])

    def end(self) -> None:
        if self.fields is not None or self.parts:
            raise ValueError("the last record is cut short")


def number(urn: str | None) -> int | None:
    part = (urn or "").strip("<>").rpartition(":")[2]
    return int(part) if part not in ("", "null") else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; a revisit's payload is null, its digest and length are those of the payload that it revisits. A response's digest is computed anew and must be the recorded one."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in SCHEMA.split(", ")])

    def row(r: dict) -> dict:
        revisit, digest = r["warc-type"] == "revisit", r["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
            raise ValueError(f"record {r['warc-record-id']} has another payload than recorded")
        length = int(r["x-payload-length"]) if revisit else len(r["payload"])
        return dict(zip(names, (number(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], digest, length, number(r.get("warc-refers-to")), None if revisit else r["payload"].decode()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = Reader(), [], 0
        for batch in batches:
            for line in batch.column(0):
                for r in reader.feed(line.as_py() + b"\r\n\r\n"):
                    rows.append(row(r))
                    held += len(r["payload"])
                    if len(rows) == 256 or held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        reader.end()
        yield pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        release()

    return spark.read.option("lineSep", EOL * 2).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def with_payloads(found: DataFrame) -> DataFrame:
    """read()'s rows in which revisits have the payload of the response that they refer to (null if that is not among the rows).

    Revisits, which hold no payload, meet the responses by page and digest; of a response with very many revisits only the revisits are many, which are split by Spark's
    skew join. Of equal responses with one page_id any is taken, as their payload is the same.
    """
    revisits = found.where("record_type = 'revisit'").drop("payload")
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    originals = found.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.first("payload").alias("payload"))
    filled = revisits.join(originals, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return found.where("record_type = 'response'").unionByName(filled.select(*found.columns))
