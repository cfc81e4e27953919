"""WARC archives: write, read back, and resolve revisits.

Records are written by Spark's own text sink with the record separator as line separator, so archives
go to any file system Spark knows and a lost executor's output is never half there.  Archives are read
whole (their size is bounded by the writer) and cut by Content-Length.
"""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dropped, hot_keys, remove_shared, shared_dir, spread_join, written

#: Bytes aimed at in one archive file, before compression, and those of a record besides its payload.
ARCHIVE_BYTES, HEAD_BYTES = 16 << 20, 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id {}, uri string, record_type string, payload_digest string, payload_bytes long, refers_to {}, payload binary"
PAYLOAD = ["payload_digest", "payload_bytes"]
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of 20 bits, each four letters."""
    digest, letters = F.sha1(payload), F.array(*[F.lit(c) for c in _B32])
    out = []
    for i in range(8):
        group = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.element_at(letters, F.shiftright(group, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records (page_id, uri, record_type, payload_digest, payload_bytes, refers_to, payload) with fresh headers.

    A revisit has headers only; the length of the payload it stands for is kept in an extension field.
    """
    clean = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), own, F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.when(F.length(clean) > 0, F.concat(F.lit("WARC-Target-URI: "), clean)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("X-Full-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit("\r\n\r\n").cast("binary"), body)
    records.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_archive(content: bytes):
    """Yields (headers, payload) of each record of an archive, by Content-Length."""
    data, at = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


#: Arrow types of ids that are numbers; ids of other types are kept as text.
NUMBERS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def read_archives(spark: SparkSession, path: str, payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """The records of archives; without payload only headers leave the reader."""

    def number(text):
        value = text.removeprefix("<urn:page:").removesuffix(">") if text else "null"
        return None if value == "null" else int(value) if id_type in NUMBERS else value

    schema = RECORDS.format(id_type, id_type)
    kind = NUMBERS.get(id_type, pa.string())

    def parse(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, body in parse_archive(content.as_py()):
                    revisit = head["warc-type"] == "revisit"
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-full-payload-length"]) if revisit else len(body), number(head.get("warc-refers-to")), body if payload else None))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (kind, pa.string(), pa.string(), pa.string(), pa.int64(), kind, pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, schema)


def response_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A response record for each page row."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    kind = dict(pages.dtypes)[id_col]
    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("uri"), F.lit("response").alias("record_type"), base32_sha1(payload).alias("payload_digest"),
        F.length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast(kind).alias("refers_to"), payload.alias("payload"),
    )


def repeated_payloads(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_digest, payload_bytes, original), written: the smallest id of each payload of at least min_bytes that several records have."""
    first = headers.where(F.col("payload_bytes") >= min_bytes).groupBy(*PAYLOAD).agg(F.min("page_id").alias("original"), F.count("*").alias("records"))
    return written(first.where("records > 1 and original is not null").drop("records"), "originals")


def resolve_revisits(records: DataFrame, originals: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Records of a repeated payload become its response (those with the smallest id) or revisits of it; all others are responses.

    Records meet their payload's original by digest and length, so ids may repeat or be null: a record with a null id revisits
    like others, where all ids of a payload are null there is nothing to refer to and all are responses, and of rows that repeat
    the smallest id all are.  Incoming revisits point to the payload's new response.  Records of a hot payload are dealt out.
    """
    joined = spread_join(records, originals, PAYLOAD, hot, "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("original"))).drop("original")


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0, id_type: str = "bigint") -> None:
    """Reads archives, resolves revisits and writes deduplicated archives with fresh headers.  Only headers are grouped."""
    headers = written(read_archives(spark, source, payload=False, id_type=id_type).select("page_id", *PAYLOAD), "headers")
    originals, hot = repeated_payloads(headers, min_bytes), hot_keys(headers, PAYLOAD)
    records = read_archives(spark, source, id_type=id_type)
    write_archives(resolve_revisits(records, originals, hot).select(*records.columns), target)
    dropped(headers, originals)


def archive_pages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as archives, deduplicates those, reads them back; returns the header fields of every record.

    Null html is an empty payload, a null id a record without one (never referred to), repeated rows and ids give as many
    records, each judged by its own payload.  Ids that are no integers must be texts without control characters.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = response_records(pages, id_col, url_col, html_col)
    total = records.agg(F.sum(F.col("payload_bytes") + HEAD_BYTES)).first()[0] or 0
    write_archives(records.repartition(max(1, -(-total // ARCHIVE_BYTES)), F.xxhash64("page_id", "uri")), f"{root}/raw")
    deduplicate_archives(spark, f"{root}/raw", f"{root}/deduplicated", min_bytes, kind)
    remove_shared(spark, f"{root}/raw")
    out = read_archives(spark, f"{root}/deduplicated", payload=False, id_type=kind)
    return out.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
