"""Content-addressed web archive (operator 3).

``write_archive`` stores every distinct payload once, under its SHA-256, in
``payloads`` and one row per record with its exact WARC and HTTP header
bytes in ``headers``.  ``read_archive`` checks the stored bytes against their
address, parses the headers and joins the two; ``reconstruct`` joins the
bytes themselves and returns whole WARC records.  Everything is DataFrame
work: digests are grouped with partial aggregation, only the distinct
payloads are shuffled, and joins on a digest that a third of all records
share are ordinary shuffle joins that AQE can split.

Defined cases: a null payload is empty; a null url gives an empty target
URI; payloads under ``min_revisit_bytes`` are always responses (their bytes
are still stored once); of larger equal payloads the record with the largest
id is the response, the others are revisits that refer to it; rows repeated
with that largest id are all responses; a null id is below every other id;
an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import new_path, save_table

MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    return (pages.select(F.col(id_col).cast("long").alias("record"),
                         F.coalesce(F.col(url_col), F.lit("")).alias("uri"), payload.alias("payload"))
            .withColumn("address", F.sha2("payload", 256)))


def _urn(record: Column) -> Column:
    h = F.sha1(F.concat(F.lit("record:"), F.coalesce(record.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z",
                  min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Archive ``pages`` under ``path`` (shared storage); returns ``path``."""
    spark = pages.sparkSession
    rec = _records(pages, id_col, url_col, payload_col)
    facts = rec.select("record", "uri", "address", F.sha1("payload").alias("sha1"),
                       F.octet_length("payload").cast("long").alias("bytes"))
    groups = facts.groupBy("address").agg(
        F.max("record").alias("owner"),
        F.assert_true((F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes")),
                      "two payloads share a SHA-256").alias("checked"))
    # The assertion's column must be read, or it is pruned away.
    typed = facts.join(groups.where(F.col("checked").isNull()).drop("checked"), "address")
    is_response = (F.col("bytes") < min_revisit_bytes) | F.col("record").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    lines = [F.lit("WARC/1.1"),
             F.concat(F.lit("WARC-Type: "), F.when(is_response, "response").otherwise("revisit")),
             F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("record"))),
             F.lit(f"WARC-Date: {date}"),
             # A target URI is one line of the header, whatever the table holds.
             F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]+", "%0A")),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))]
    revisit = F.concat_ws(CRLF, F.lit(f"WARC-Profile: {PROFILE}"),
                          F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("owner"))))
    block = F.octet_length("http") + F.when(is_response, F.col("bytes")).otherwise(0)
    head = F.concat(F.concat_ws(CRLF, *lines, F.when(~is_response, revisit),
                                F.concat(F.lit("Content-Length: "), block.cast("string"))), F.lit(CRLF * 2))
    (typed.withColumn("http", http)
     .select("record", "address", F.encode(head, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))
    # Only the owners' payloads move: the id side is joined first, by id.
    owners = groups.select(F.coalesce(F.col("owner"), F.lit(-1)).alias("o"), F.col("owner").isNull().alias("n"), "address")
    owned = (rec.withColumns({"o": F.coalesce(F.col("record"), F.lit(-1)), "n": F.col("record").isNull()})
             .join(owners, ["o", "n", "address"], "left_semi"))
    # One owner per address: dropping repeated owner rows by the join's keys needs no further shuffle.
    (owned.dropDuplicates(["o", "n", "address"]).select("address", "payload")
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    return path


def _store(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with their facts; reading fails when stored bytes do not
    have the digest they are filed under."""
    p = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("address"), "stored payload is damaged")
    return p.where(sound.isNull())


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("warc_header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("record long, address string, warc_header binary, http_header binary")
            .parquet(f"{path}/headers")
            .withColumns({"record_type": _field("WARC-Type"), "uri": _field("WARC-Target-URI"),
                          "record_urn": _field("WARC-Record-ID"), "refers_urn": _field("WARC-Refers-To"),
                          "header_sha1": F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")}))


def _linked(spark: SparkSession, path: str) -> DataFrame:
    """The headers with ``refers_to``, the record that a revisit's
    WARC-Refers-To names; reading fails when the archive lacks it."""
    heads = _headers(spark, path)
    responses, revisits = heads.where("record_type = 'response'"), heads.where("record_type = 'revisit'")
    # Stored, so a response that very many revisits name is a plain shuffle key, which AQE splits.
    targets = save_table(responses.select(F.col("record_urn").alias("refers_urn"), F.col("record").alias("refers_to"), F.lit(True).alias("found")).distinct(), "targets")
    known = F.assert_true(F.coalesce(F.col("found"), F.lit(False)), "a revisit refers to a record that is not here")
    revisits = revisits.join(targets, "refers_urn", "left").where(known.isNull())
    cols = ["record", "address", "uri", "record_type", "header_sha1", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*cols).union(revisits.select(*cols))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: (record, uri, record_type, refers_to, payload_bytes,
    payload_digest), the last two computed from the verified stored bytes."""
    facts = _store(spark, path).select("address", F.sha1("payload").alias("payload_digest"),
                                       F.octet_length("payload").cast("long").alias("payload_bytes"))
    ok = F.assert_true(F.col("payload_digest") == F.col("header_sha1"), "header and payload digests differ")
    return (_linked(spark, path).join(facts, "address").where(ok.isNull())
            .select("record", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record, record_type, payload, warc_record): the exact bytes of each WARC
    record; ``payload`` is the full one for revisits too."""
    tail = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return (_headers(spark, path).join(_store(spark, path), "address")
            .select("record", "record_type", "payload",
                    F.concat("warc_header", "http_header", body, tail).alias("warc_record")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lowrank.llm.common import read_table

    path = write_archive(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archive(spark, path).select(
        F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes
  FROM pages
), g AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes, sha1(p.h) AS payload_digest, p.uri,
       CASE WHEN payload_bytes < 1000 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN g USING (h)
"""
