"""Content-addressed WARC archive: payload bytes once, record headers apart, records again by a join.

An archive is two Parquet tables in the shared folder. `payloads` holds each distinct payload once under its SHA-256, which
is computed from the bytes that are stored and checked again whenever they are read. `headers` holds, for every record, its exact
WARC and HTTP header blocks and the address of its payload. Of equal payloads (of at least min_bytes) the row with the largest page
id is the response, the others are revisits that name it; smaller payloads are all responses.
The response of a payload is found by a map-side maximum over digests, and payloads are reduced map-side before they move,
so thousands of copies cost one row per task. All of it is DataFrame expressions.

Defined cases: a null payload is empty; a null page id counts as the least and is written as an empty id; rows that repeat
the largest page id are all responses; CR and LF in a URL are percent-encoded, a null URL is empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import quoted, shared_dir

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, CONV = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass(frozen=True)
class Archive:
    path: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits of the digest, five hex digits, are four characters."""
    h = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), CONV, BASE32)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws(CRLF, *parts, F.lit(""), F.lit(""))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = DATE, path: str | None = None) -> Archive:
    """A WARC record for every row of pages. The payload is UTF-8 of a string column, or a binary column as it is. Page ids are whole numbers."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    binary = dict(pages.dtypes)[payload] == "binary"
    raw = F.coalesce(F.col(quoted(payload)), F.lit(b"").cast("binary")) if binary else F.encode(F.coalesce(F.col(quoted(payload)), F.lit("")), "UTF-8")
    target = F.replace(F.replace(F.coalesce(F.col(quoted(url)), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(quoted(page_id)).cast("bigint").alias("page_id"), target.alias("url"), raw.alias("payload"))
    rows = rows.withColumn("address", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    light = rows.select("page_id", "url", "address", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").alias("n"))
    leader = light.groupBy("address").agg(F.max("page_id").alias("leader"))
    light = light.join(leader, "address")
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("leader"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _field("Content-Length", F.col("n").cast("string")))
    common = [_field("WARC-Record-ID", record_id(F.col("page_id"))), _field("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {date}"), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), F.lit("Content-Type: application/http; msgtype=response")]
    response = _lines(F.lit("WARC/1.1"), F.lit("WARC-Type: response"), *common, _field("Content-Length", (F.octet_length("http") + F.col("n")).cast("string")))
    again = _lines(F.lit("WARC/1.1"), F.lit("WARC-Type: revisit"), F.lit(f"WARC-Profile: {PROFILE}"), _field("WARC-Refers-To", record_id(F.col("leader"))), *common, _field("Content-Length", F.octet_length("http").cast("string")))
    light.withColumn("http", http).select("address", F.when(revisit, again).otherwise(response).alias("header"), "http").write.parquet(f"{path}/headers")
    return Archive(path)


def _checked() -> Column:
    return F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")))


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """header, http, payload of every record; payloads are verified and a record without one is an error."""
    headers = spark.read.schema("address binary, header string, http string").parquet(f"{archive.path}/headers")
    payloads = spark.read.schema("address binary, payload binary").parquet(f"{archive.path}/payloads").select("address", _checked().alias("payload"))
    joined = headers.join(payloads, "address", "left")
    missing = F.raise_error(F.lit("the payload of a record is missing")).cast("binary")
    return joined.select("header", "http", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(missing).alias("payload"))


def is_revisit(header: str = "header") -> Column:
    return F.contains(F.col(header), F.lit("\r\nWARC-Type: revisit\r\n"))


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Each original record, byte for byte: header block, HTTP block, the payload of responses, two line ends."""
    body = F.when(is_revisit(), F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return read(spark, archive).select(F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def report(spark: SparkSession, archive: Archive) -> DataFrame:
    """What the records say of themselves, read back; the digest in the header is checked against the payload's bytes."""
    value = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.regexp_extract("head", rf"\r\n{name}: <urn:page:(-?\d+)>\r\n", 1).try_cast("bigint")
    cut = F.locate("\r\n\r\n", F.decode("record", "ISO-8859-1"))
    df = records(spark, archive).withColumn("head", F.concat(F.decode(F.substring(F.col("record"), F.lit(1), cut.cast("int")), "UTF-8"), F.lit("\n")))
    digest = F.replace(value("WARC-Payload-Digest"), F.lit("sha1:"), F.lit(""))
    kind = value("WARC-Type")
    good = F.when(digest == base32_sha1(F.col("payload")), digest).otherwise(F.raise_error(F.lit("a payload does not have the digest in its header")))
    return df.select(number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), good.alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", number("WARC-Refers-To")).alias("refers_to"))
