"""A content-addressed web archive: payloads once by strong digest, exact record headers apart from them.

An archive is a folder of two tables. payloads has each distinct payload once, under its address (SHA-256);
headers has a row for each record with the exact bytes of its WARC and HTTP headers and the address of its
payload. A record is rebuilt by joining the two, byte for byte, and what is told of it is parsed from these
bytes; that a payload still has the digest it is stored under is verified whenever it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm.common import cut, scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables have no capture times.
WARC_DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: every five hex digits are four letters of five bits."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 1 + 5 * group, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column, row: Column) -> Column:
    """The id of a page and the number of its row in the archive, so that rows that repeat an id have record ids of their own."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def _joined(records: DataFrame, per_address: DataFrame) -> DataFrame:
    """records beside what per_address has once for each address. The reversed address, for which no
    partitioning is known, lets adaptive execution split an address that very many records share."""
    left = records.withColumn("_a", F.reverse("address"))
    right = per_address.withColumn("_a", F.reverse("address")).drop("address")
    return left.join(right.hint("shuffle_merge"), "_a").drop("_a")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Writes the archive of pages to the new folder path.

    Payloads are the UTF-8 bytes of payload_col, null being empty. Of records with equal payloads of at
    least least_bytes bytes, that with the largest id is a response and the others are revisits of it
    (of rows that repeat that id, one is the response); smaller ones are all responses. A null id is
    smaller than any; a null url is an empty target, and line ends in one are percent-encoded, as a header
    can't hold them. Ids are integers. Other columns are not read.
    """
    scan = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))
    index = cut(
        scan.select(
            "page_id", "url", "address", F.monotonically_increasing_id().alias("row"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("digest"),
        )
    )
    first = F.max(F.struct("page_id", (-F.col("row")).alias("order")))
    best = cut(index.groupBy("address").agg(first.alias("best")))
    decided = cut(
        _joined(index, best)
        .withColumn("is_response", (F.col("payload_bytes") < least_bytes) | (F.col("row") == -F.col("best.order")))
    )
    eol = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(eol + eol))
    lines = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(F.col("is_response"), "response").otherwise("revisit"),
        F.lit(f"{eol}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row")),
        F.lit(f"{eol}WARC-Date: {WARC_DATE}{eol}WARC-Target-URI: "), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("is_response"), "").otherwise(F.concat(F.lit(f"{eol}WARC-Profile: {PROFILE}{eol}WARC-Refers-To: "), _record_id(F.col("best.page_id"), -F.col("best.order")))),
        F.lit(f"{eol}Content-Type: application/http;msgtype=response{eol}Content-Length: "),
        (F.octet_length("http") + F.when(F.col("is_response"), F.col("payload_bytes")).otherwise(0)).cast("string"),
        F.lit(eol + eol),
    )
    headers = decided.withColumn("http", http).select("page_id", "row", lines.alias("warc_header"), F.col("http").alias("http_header"), "address")
    headers.write.parquet(f"{path}/headers")

    # grouped by the bytes themselves, within each task first: a payload of very many pages leaves each but once
    stored = scan.groupBy("payload").agg(F.lit(1).alias("one")).select(F.sha2("payload", 256).alias("address"), "payload")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    if not addresses_differ(pages.sparkSession, path):
        raise ValueError("two payloads have one address")


def addresses_differ(spark: SparkSession, path: str) -> bool:
    """Whether each address is that of one stored payload."""
    return spark.read.parquet(f"{path}/payloads").groupBy("address").count().filter("count > 1").isEmpty()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload, payload_bytes, payload_digest) of the stored bytes, which are verified as they are read."""
    stored = spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(
        F.raise_error(F.concat(F.lit("a stored payload does not have the digest "), F.col("address")))
    )
    return stored.select(verified.alias("address"), "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records and what they say."""
    return spark.read.parquet(f"{path}/headers").select(
        "page_id", "address", "warc_header", "http_header",
        F.regexp_extract("warc_header", r"\nWARC-Type: ([a-z]+)\r", 1).alias("record_type"),
        F.nullif(F.regexp_extract("warc_header", r"\nWARC-Refers-To: <urn:page:(-?\d+):\d+>\r", 1), F.lit("")).cast("bigint").alias("refers_to"),
        F.regexp_extract("warc_header", r"\nWARC-Target-URI: ([^\r]*)\r", 1).alias("target"),
        F.regexp_extract("warc_header", r"\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r", 1).alias("stated"),
    )


def _record(body: Column) -> Column:
    return F.concat(F.encode("warc_header", "UTF-8"), F.encode("http_header", "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, rebuilt: page_id, record_type, refers_to (the id of the response that a
    revisit refers to), target, payload (of revisits too), payload_bytes, payload_digest (bare base32 SHA-1,
    of the stored bytes), warc_header, http_header and record (the exact bytes of the record).

    A payload whose bytes don't have the digest they are stored under, or the one its record's header
    states, raises an error. What is not selected is not read: without payload and record, only digests
    of the payloads meet the headers in the join.
    """
    digest = F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("a payload does not have the digest of its record, "), F.col("stated")))
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return _joined(_heads(spark, path), _stored(spark, path)).select(
        "page_id", "record_type", "refers_to", "target", "payload", "payload_bytes", digest.alias("payload_digest"), "warc_header", "http_header", _record(body),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the exact bytes of each record. Only responses meet their payloads; a revisit's block has none."""
    heads = _heads(spark, path)
    responses = _joined(heads.filter("record_type = 'response'"), _stored(spark, path)).select(_record(F.col("payload")))
    return responses.unionByName(heads.filter("record_type <> 'response'").select(_record(F.encode(F.lit(""), "UTF-8"))))


def parse(records: DataFrame) -> DataFrame:
    """What the bytes of each record (column record) say: page_id (of its record id), record_type, refers_to, target,
    payload_bytes (the length that its HTTP header states), payload_digest (as stated) and payload (null for
    revisits, whose blocks have none). A response raises an error if its payload has another length or digest."""
    end = "\r\n\r\n"

    def before_end(data: Column) -> Column:
        return F.substring_index(data.cast("string"), end, 1)

    def after(data: Column, head: Column) -> Column:
        return F.substring(data, F.octet_length(head) + len(end) + 1, F.octet_length(data))

    def field(head: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"\n{pattern}(?:\r|$)", 1), F.lit(""))

    heads = records.select("record", before_end(F.col("record")).alias("head"))
    length = field("head", r"Content-Length: (\d+)").cast("int")
    blocks = heads.select("head", F.substring(after(F.col("record"), F.col("head")), F.lit(1), length).alias("block"))
    blocks = blocks.select("head", "block", before_end(F.col("block")).alias("http"), field("head", "WARC-Type: ([a-z]+)").alias("record_type"))
    parsed = blocks.select(
        field("head", r"WARC-Record-ID: <urn:page:(-?\d+):\d+>").cast("bigint").alias("page_id"),
        "record_type",
        field("head", r"WARC-Refers-To: <urn:page:(-?\d+):\d+>").cast("bigint").alias("refers_to"),
        F.coalesce(field("head", r"WARC-Target-URI: ([^\r]*)"), F.lit("")).alias("target"),
        field("http", r"Content-Length: (\d+)").cast("bigint").alias("payload_bytes"),
        field("head", "WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("stated"),
        F.when(F.col("record_type") == "response", after(F.col("block"), F.col("http"))).alias("payload"),
    )
    parsed = parsed.withColumn("found", base32_of_hex(F.sha1("payload")))
    right = F.col("payload").isNull() | ((F.octet_length("payload") == F.col("payload_bytes")) & (F.col("found") == F.col("stated")))
    digest = F.when(right, F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("a record does not hold the payload it states: "), F.col("stated"))))
    return parsed.select("page_id", "record_type", "refers_to", "target", "payload_bytes", digest.alias("payload_digest"), "payload")


def digests(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages to the shared checkpoint folder, rebuilds its records, and gives the digest columns
    as parsed from their bytes."""
    spark = pages.sparkSession
    write(pages, path := scratch(spark, "warc"))
    return parse(records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), best AS (
  SELECT html, max(page_id) AS best FROM p GROUP BY html
), hexed AS (
  SELECT page_id, best, html, sha1(html) AS h FROM p JOIN best USING (html)
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM hexed
"""
