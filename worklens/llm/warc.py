"""WARC archives without repeated payloads: revisit records are resolved by payload digest.

Headers (id, digest, length) are shuffled by digest; of payloads of at least ``LEAST`` bytes that are
equal, the record with the largest id is the response and the others become revisit records, which
keep headers only. Archives are written with fresh headers through Spark's text sink: a row
is one record and the line separator is the record's closing blank lines, so any file system
that Spark writes to will do. A file holds at most ``FILE_RECORDS`` records. Read back, a record is
found by its Content-Length, never by looking for separators, and the digest is taken of the bytes
in the archive; revisits are joined to their responses by the digest that they carry.

Edge cases: a null html is an empty payload and a response, as every payload below the limit. A null id is smaller
than any other; rows with the response's id and payload are responses too. Null addresses are left out;
signs that would break a header are percent-encoded. Records at a common digest may be any
share of the table: their join can be split. An empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import ship, stage, table
from worklens.storage import shared_dir

ship(__name__)

LEAST = 1000
FILE_RECORDS = 2000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed value: the date every record is given, as the tables name none.
DATE = "2024-01-01T00:00:00Z"
_READ = "page_id string, record_type string, digest string, payload_bytes long, refers_to string"


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """The repeated payloads among (page_id, digest, size): digest, response."""
    return (headers.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
            .where("n > 1").select("digest", "response"))


def _record_id(*parts: str | Column) -> Column:
    h = F.md5(F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The text of one record per page (without the closing blank lines)."""
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.sha1(body)).withColumn("size", F.octet_length(body))
    known = rows.join(resolve(rows.select("page_id", "digest", "size"), least), "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", _record_id("page_id", "digest")), F.lit(f"WARC-Date: {DATE}"),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), line("WARC-Refers-To", F.when(revisit, _record_id("response", "digest"))),
        F.lit("Content-Type: application/http; msgtype=response"), line("X-Page-Id", F.col("page_id")),
        line("Content-Length", F.octet_length(block)))
    return known.select(F.concat(head, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, least: int = LEAST) -> str:
    """Write deduplicated archives into the shared folder; returns their path."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/worklens/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    (records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path))
    return path


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = {"": lines[0]} | dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out = [[] for _ in range(5)]
            for headers, block in parsed(zlib.decompress(content.as_py(), 31)):
                revisit = headers["WARC-Type"] == "revisit"
                payload = block[block.index(b"\r\n\r\n") + 4:]
                row = (headers.get("X-Page-Id"), headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
                       None if revisit else len(payload), headers.get("WARC-Refers-To"))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             names=["page_id", "record_type", "digest", "payload_bytes", "refers_to"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, digest, payload_bytes and refers_to (a record id) of every record; a revisit's size is null."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read_files, _READ)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = stage(read_archives(spark, write_archives(pages)).withColumn("page_id", F.col("page_id").cast("long")))
    revisits = read.where("record_type = 'revisit'")
    # a repeated response record is one target
    targets = (read.where("record_type = 'response'").join(revisits.select("digest").distinct(), "digest", "left_semi")
               .groupBy("digest").agg(F.max("page_id").alias("target"), F.max("payload_bytes").alias("size")))
    joined = revisits.join(targets, "digest", "left").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("target").alias("refers_to"))
    return joined.union(read.where("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")))


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
r as (select *, max(page_id) over (partition by payload_digest) as response, count(*) over (partition by payload_digest) as n from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {LEAST} and n > 1 and response is not null and page_id is distinct from response then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST} and n > 1 and response is not null and page_id is distinct from response then response end::bigint as refers_to from r"""
