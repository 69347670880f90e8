"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records through joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import new_path

END = "\r\n\r\n"


def write_archive(pages: DataFrame, path: str | None = None, *, min_revisit: int = 1000) -> str:
    """Write ``pages(page_id, url, html)`` below ``path`` as ``blobs`` and ``headers``; returns the path.

    ``blobs`` holds each payload once by SHA-256: all payloads of a digest are compared byte by byte (their
    smallest and largest must be equal) before one is stored. Of records with equal payloads of ``min_revisit`` bytes
    or more the largest page_id is the response, others revisit it; smaller ones are all responses. A null html is an
    empty payload, a null url has no target line, a null page_id an empty record id and never is the one revisited unless all are null; rows
    that repeat the largest page_id are all responses. Line ends in a url are percent-encoded. No pages give an empty archive.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("sha256", F.sha2("payload", 256))
    one = src.groupBy("sha256").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"), F.max("page_id").alias("holder"))
    same = F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), F.col("sha256"))).cast("binary"))
    one.select("sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), "holder", same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/blobs")
    blobs = spark.read.parquet(f"{path}/blobs").select("sha256", "sha1", "n", "holder")
    rec = src.select("page_id", "url", "sha256").join(blobs, "sha256")
    revisit = (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"), F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("holder").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")), F.lit(END), http)
    rec.select(F.encode(head, "UTF-8").alias("header"), "sha256", (~revisit).alias("has_payload")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, full_bytes, full_sha1)``: each original record's exact bytes, and the length and SHA-1 of the payload it stands for.

    Payloads are read back and digested once each. Records that carry a payload join with it; revisits only join with its length and
    digest, so a payload that many pages share does not travel to each of them. An archive without pages gives no rows; repeated pages
    give repeated records; a payload may be empty.
    """
    blobs = spark.read.parquet(f"{path}/blobs").select("sha256", "payload", F.octet_length("payload").cast("long").alias("full_bytes"), F.sha1("payload").alias("full_sha1"))
    heads = spark.read.parquet(f"{path}/headers")
    end = F.lit(END.encode())
    whole = heads.where("has_payload").join(blobs, "sha256").select(F.concat("header", "payload", end).alias("record"), "full_bytes", "full_sha1")
    bare = heads.where("not has_payload").join(blobs.drop("payload"), "sha256").select(F.concat("header", end).alias("record"), "full_bytes", "full_sha1")
    return whole.union(bare)


def parse_records(records: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, refers_to, declared, payload_bytes, payload_digest)`` parsed from the records' bytes.

    Header lines end at CR LF and nowhere else, so no character of a url starts another line. A response's length and digest are those of
    the bytes it carries; a revisit's those of the payload it stands for. A record without a line has null there.
    """
    text = F.col("record").cast("string")
    line = lambda name: F.regexp_extract("head", rf"\r\n{name}: ((?s:.*?))(?:\r\n|\z)", 1)
    field = lambda name: F.nullif(line(name), F.lit(""))
    page = lambda name: F.regexp_extract(line(name), r"^<urn:page:(-?\d+)>\z", 1).try_cast("long")
    r = records.select("record", "full_bytes", "full_sha1", F.substring_index(text, END, 1).alias("head"), F.substring_index(F.substring_index(text, END, 2), END, -1).alias("http"))
    n = line("Content-Length").try_cast("int") - F.octet_length("http") - 4
    r = r.withColumn("carried", F.col("record").substr(F.octet_length("head") + F.octet_length("http") + 9, n)).withColumn("kind", field("WARC-Type"))
    own = F.col("kind") == "response"
    return r.select(page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), F.col("kind").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
                    F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("declared"), F.when(own, F.octet_length("carried").cast("long")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
                    F.when(own, F.sha1("carried")).otherwise(F.col("full_sha1")).alias("payload_digest"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM m
"""
