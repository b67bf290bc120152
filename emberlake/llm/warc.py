"""Content-addressed web archive.

A record is an exact header block, an exact payload and the two line ends after it. The
archive keeps every payload once, under its SHA-256, in one table and every header block
byte for byte in another; a join on the digest gives the original records back. Every
payload is hashed again when it is read and must have the digest and the length its header
states; a mismatch stops the job.

Payloads of at least ``REVISIT_BYTES`` bytes that occur again become revisit records: a
header without payload that names the first page. Null html is an empty payload, empty
payloads are responses. Repeated rows are separate records (equal ids: one of them is the
response); a null id sorts last. An empty table gives an empty archive.

Per-digest facts are aggregated map-side, and joins on the digest read narrow rows that the
engine can split where one payload holds a large share of all pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.common import text_bytes
from emberlake.session import checkpoint_root

REVISIT_BYTES = 100
END = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _headers(page, kind, url, digest, length, refers_to):
    """Header block of a record, ending with the empty line."""
    def field(name, value):
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))

    def uri(p):
        return F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("-")), F.lit(">"))

    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit(VERSION + END), field("WARC-Type", kind), field("WARC-Record-ID", uri(page)), field("WARC-Target-URI", clean),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", uri(refers_to)))).otherwise(F.lit("")),
        field("X-Payload-Length", length), field("Content-Length", F.when(kind == "revisit", F.lit(0).cast("long")).otherwise(length)), F.lit(END),
    )


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write ``payloads`` (digest, payload) and ``headers`` (page_id, digest, header) below ``root``."""
    # Read by position in the select only: other columns may have any name.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_bytes(body_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{root}/payloads")

    # Equal rows are counted, so a page crawled any number of times is one row here.
    narrow = rows.groupBy("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("copies"))
    first = narrow.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")).alias("first"))
    marked = narrow.join(first, "digest")
    leads = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    records = marked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn(
        "kind", F.when((F.col("length") < REVISIT_BYTES) | (leads & (F.col("copy") == 1)), "response").otherwise("revisit")
    )
    header = _headers(F.col("page_id"), F.col("kind"), F.col("url"), F.col("digest"), F.col("length"), F.col("first.page_id"))
    records.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, digest, header, payload, record): every record with its exact bytes.

    ``payload`` is the full payload, also where the record is a revisit and carries none.
    """
    headers = spark.read.parquet(f"{root}/headers")
    payloads = spark.read.parquet(f"{root}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("digest"))).cast("binary")))
    held = F.when(F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(checked, "digest").withColumn("record", F.concat("header", held, F.lit((END + END).encode())))


def parse_records(records: DataFrame) -> DataFrame:
    """Type, digest, length and reference of each record as its header states them, held against its bytes."""
    head = F.decode("header", "UTF-8")

    def field(name):
        return F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    kind = records.schema["page_id"].dataType
    refers = F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1)
    out = records.select(
        "page_id", field("WARC-Type").alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"), field("Content-Length").cast("long").alias("content_bytes"),
        F.when(~refers.isin("", "-"), refers.cast(kind)).alias("refers_to"),
        F.octet_length("payload").alias("_full"), (F.octet_length("record") - F.octet_length("header") - 4).alias("_held"),
    )
    sound = (F.col("_full") == F.col("payload_bytes")) & (F.col("_held") == F.col("content_bytes"))
    kept = F.when(sound, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record does not have the length its header states")).cast("long"))
    return out.withColumn("payload_bytes", kept).drop("_full", "_held")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{checkpoint_root(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return parse_records(read_records(spark, root)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH bodies AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
ranked AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest,
    row_number() OVER (PARTITION BY sha256(payload) ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth,
    first_value(page_id) OVER (PARTITION BY sha256(payload) ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_page
  FROM bodies)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_page END AS refers_to
FROM ranked
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}
