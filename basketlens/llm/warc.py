"""Content-addressed WARC archive.

`write_archive` stores every distinct payload once under its SHA-256 digest
(`payloads`) and, apart from it, the exact header block of every record
(`headers`). `read_archive` parses the header blocks and checks each stored
payload against both of its digests and its length; `reconstruct` joins the two
tables back to whole records, byte for byte.

Rules: of the records with equal payloads of at least `min_revisit` bytes, the
one with the largest page_id is the response and the others revisit it; smaller
payloads are always responses (and still stored once).

Cases: a null payload is an empty one. Rows that repeat with the largest page_id
of their payload are all responses. A null page_id is smaller than any other;
where all page_ids of a payload are null, all are responses. CR and LF in a url are
percent-encoded in the header; a null url has no header line. Columns other than
the three named ones are ignored. An empty input gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CRLF = "\r\n"
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _records(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload().alias("payload"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of pages(page_id, url, html) below `folder`."""
    spark = pages.sparkSession
    records = _records(pages).withColumn("digest", F.sha2("payload", 256))
    # One row for each digest. The rank limit also runs before the shuffle, so
    # a payload with very many copies travels once for each input task.
    newest = Window.partitionBy("digest").orderBy(F.desc_nulls_last("page_id"))
    (
        records.select("digest", "page_id", "payload")
        .withColumn("nth", F.row_number().over(newest))
        .filter("nth = 1")
        .select(
            "digest",
            F.sha1("payload").alias("sha1"),
            F.octet_length("payload").cast("long").alias("n_bytes"),
            F.col("page_id").alias("response_id"),
            "payload",
        )
        .write.parquet(f"{folder}/payloads")
    )
    store = spark.read.parquet(f"{folder}/payloads").select("digest", "sha1", "n_bytes", "response_id")
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("response_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(CRLF),
    )
    (
        records.select("page_id", "url", "digest")
        .join(store, "digest")
        .select(F.encode(head, "UTF-8").alias("header"), "digest")
        .write.parquet(f"{folder}/headers")
    )


def _field(name: str, pattern: str) -> Column:
    # (?d): only LF ends a line. Our own fields stand before the url.
    found = F.regexp_extract(F.decode("header", "UTF-8"), f"(?md)^{name}: {pattern}", 1)
    return F.when(found != "", found)


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Digests and lengths computed from the stored bytes; a payload that
    does not match what it is stored under raises an error."""
    store = spark.read.parquet(f"{folder}/payloads")
    good = (
        (F.sha2("payload", 256) == F.col("digest"))
        & (F.sha1("payload") == F.col("sha1"))
        & (F.octet_length("payload") == F.col("n_bytes"))
    )
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    return store.select(
        F.when(good, F.col("digest")).otherwise(bad).alias("digest"), "sha1", "n_bytes", "payload"
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, from its header block and its verified payload."""
    store = verified_payloads(spark, folder).drop("payload")
    return (
        spark.read.parquet(f"{folder}/headers")
        .join(store, "digest", "left")
        .select(
            _field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
            F.coalesce("n_bytes", F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("long")).alias("payload_bytes"),
            F.col("sha1").alias("payload_digest"),
            _field("WARC-Type", r"(\w+)").alias("record_type"),
            _field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
            _field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        )
    )


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """The whole records: (page_id, record bytes, payload bytes).

    `record` is the exact record as it stands in a WARC file (a revisit has no
    block of its own); `payload` is the full payload for either type.
    """
    store = verified_payloads(spark, folder).select("digest", "payload")
    end = F.lit(bytearray(b"\r\n\r\n"))
    block = F.when(_field("WARC-Type", r"(\w+)") == "response", F.col("payload")).otherwise(F.lit(bytearray()))
    return (
        spark.read.parquet(f"{folder}/headers")
        .join(store, "digest")
        .select(
            _field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
            F.concat(F.col("header"), block, end).alias("record"),
            "payload",
        )
    )
