"""WARC archives stored by content: payload bytes once per digest, record headers apart.

``write_archive`` makes two tables below a path: ``headers`` holds the exact header block of each
record (text files whose separator is the empty line that ends a WARC header), ``payloads`` holds
each distinct payload once, by verified SHA-256. ``read_archive`` joins them back to records;
``export_warc`` writes plain ``.warc`` text, ``parse_warc`` reads such bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.session import delete_at_end, new_folder

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BLANK = "\r\n\r\n"
#: Payloads of at least so many bytes are stored once; smaller ones are all responses.
MIN_REVISIT = 0


def base32_of_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each 5 hex digits are 4 base-32 digits in another alphabet."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))


def _field(value: Column) -> Column:
    """A header value: line breaks, which would end it, are percent-encoded; null is empty."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, content, header): each row's header block and the SHA-256 that names its payload.

    Of records with the same payload (``min_revisit`` bytes or more) the largest page_id is the
    response, the others are revisits of it; rows that repeat that page_id are responses too.
    """
    payload = _payload(html)
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.unhex(F.sha2(payload, 256)).alias("content"),
        base32_of_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"),
    )
    first = rows.where(F.col("size") >= min_revisit).groupBy("content").agg(F.max(F.struct("page_id", "url")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(first, "content", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), _field(c), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _field(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("_first.page_id")))),
        F.when(again, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _field(F.col("_first.url")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Content: sha256:"), F.lower(F.hex("content"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0).cast("long")).otherwise(F.col("size"))),
    ]
    return rows.select("page_id", "content", F.concat_ws("\r\n", *lines).alias("header"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> str:
    """Write the archive below ``path``; each payload's bytes are stored once.

    Rows of one digest and one payload are one stored row (combined before they are shuffled); then
    the stored digests are counted, and a digest with two payloads stops the job, so that nothing
    is ever merged by digest alone.
    """
    spark, payload = pages.sparkSession, _payload(html)
    stored = pages.select(F.unhex(F.sha2(payload, 256)).alias("content"), payload.alias("payload")).distinct()
    stored.write.parquet(f"{path}/payloads")
    twice = spark.read.parquet(f"{path}/payloads").groupBy("content").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("one digest names two payloads")
    headers = record_headers(pages, page_id, url, html, min_revisit=min_revisit)
    headers.select("header").write.option("lineSep", _BLANK).text(f"{path}/headers")
    return path


def _value(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){re.escape(name)}: ([^\r]*)", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Each record's header and its fields; content is the SHA-256 that names the payload."""
    headers = spark.read.option("lineSep", _BLANK).text(f"{path}/headers").withColumnRenamed("value", "header")
    strip = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    return headers.select(
        "header",
        F.nullif(strip(_value("WARC-Record-ID")), F.lit("")).alias("page_id"),
        _value("WARC-Target-URI").alias("url"),
        _value("WARC-Type").alias("record_type"),
        F.nullif(strip(_value("WARC-Refers-To")), F.lit("")).alias("refers_to"),
        _value("WARC-Payload-Digest").alias("digest"),
        F.unhex(F.regexp_extract(_value("X-Content"), "sha256:(.*)", 1)).alias("content"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id (string), header, payload (binary), each record's own fields.

    Headers meet payloads by digest; a header without its payload keeps a null payload.
    """
    return read_headers(spark, path).join(spark.read.parquet(f"{path}/payloads"), "content", "left")


def export_warc(records: DataFrame, path: str) -> str:
    """Write ``read_archive`` records as plain WARC files (header, blank line, block, blank line)."""
    block = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload").cast("string"))
    records.select(F.concat("header", F.lit(_BLANK), block)).write.option("lineSep", _BLANK).text(path)
    return path


def parse_warc(data: bytes):
    """(headers, block) of each record in WARC bytes; blocks are cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    delete_at_end(spark, path)
    # What the query reports of a payload is taken from its stored bytes, once, before the join.
    payload = F.col("payload")
    facts = spark.read.parquet(f"{path}/payloads").select("content", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_of_sha1(payload).alias("payload_digest"))
    return read_headers(spark, path).join(facts, "content", "left").select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


_HEX = "('0x' || substr(d, {}, 5))::BIGINT"
_DIGITS = " || ".join(f"substr('{_B32}', 1 + ((({_HEX.format(5 * i + 1)}) >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE = {
    "op8_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM g
"""
}
