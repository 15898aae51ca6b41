"""A content-addressed WARC archive: payloads once by digest, record headers apart."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
#: Payloads shorter than this are never answered by a revisit record.
REVISIT_BYTES = 100
REVISIT_HEAD = "WARC/1.1\r\nWARC-Type: revisit\r\n"


def _record_id(page: Column, unique: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), unique, F.lit(">"))


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _page_of(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?md)^{name}: <urn:x-page:([^:>]*):", 1)


def _header(date: str, url: Column, digest: Column, n: Column, record: Column, refers: Column) -> Column:
    """The exact header block of a record; line breaks in an address are percent-encoded."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = refers.isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), refers)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(n).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """Writes path/payloads (digest, payload), each distinct payload once, and path/headers, one row a page.

    Of equal payloads of REVISIT_BYTES and more the smallest id is a response and the others revisit
    it; rows that repeat the smallest id are responses too, and each record's own id is unique all
    the same. A null payload is empty; a null id sorts last. date is the records' WARC-Date (UTC),
    by default the time of writing. Extra columns are ignored.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    light = rows.select("page_id", "url", "digest", F.octet_length("html").alias("n"), _record_id(F.col("page_id"), F.uuid()).alias("record"))
    light = common.staged(light, "warc-rows")
    first = F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record")))
    copied = light.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copied = common.staged(copied.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.record").alias("first_record"), F.lit(True).alias("copied")), "warc-copied")
    copied = common.sized(copied, 260)
    refers = F.when(F.col("copied") & (F.col("n") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_record"))
    heads = light.join(copied, "digest", "left").select("page_id", "digest", _header(date, F.col("url"), F.col("digest"), F.col("n"), F.col("record"), refers).alias("header"))
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")
    noted = rows.join(copied, "digest", "left")
    once = noted.where("copied is null").select("digest", F.col("html").cast("binary").alias("payload"))
    first = noted.where("copied and page_id <=> first_id").select("digest", F.col("html").cast("binary").alias("payload")).dropDuplicates(["digest"])
    once.union(first).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (header, digest, record): the original records, joined from headers and payloads.

    A response's record is header, payload and two line ends; a revisit's has no block. A response
    whose payload is not stored raises.
    """
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    end = F.lit(CRLF + CRLF).cast("binary")
    full = heads.where(~F.col("header").startswith(REVISIT_HEAD)).join(payloads, "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload is stored for digest "), F.col("digest"))).cast("binary")
    full = full.withColumn("payload", F.coalesce("payload", lost))
    bare = heads.where(F.col("header").startswith(REVISIT_HEAD))
    return full.select("digest", F.concat(F.col("header").cast("binary"), "payload", end).alias("record")).unionByName(
        bare.select("digest", F.concat(F.col("header").cast("binary"), end).alias("record"))
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Rows (digest, payload_bytes): of each stored payload whose bytes have the digest that names it."""
    p = spark.read.parquet(f"{path}/payloads")
    return p.where(F.sha2("payload", 256) == F.col("digest")).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))


def parsed(records: DataFrame) -> DataFrame:
    """Rows (page, record_type, declared, refers, n) from whole records; a damaged record raises.

    A record is damaged if its block lacks the declared length or, in a response, the declared digest.
    """
    # read as Latin-1 a character is a byte, so the place found is one in bytes
    cut = F.instr(F.decode(F.col("record"), "ISO-8859-1"), CRLF + CRLF)
    split = records.select("record", cut.alias("cut")).select(
        F.expr("substring(record, 1, cut + 1)").cast("string").alias("header"),
        F.expr("substring(record, cut + 4, octet_length(record) - cut - 7)").alias("block"),
    )
    out = split.select(
        "header",
        _field(F.col("header"), "WARC-Type").alias("record_type"),
        F.regexp_extract("header", r"(?md)^WARC-Payload-Digest: sha256:([0-9a-f]*)", 1).alias("declared"),
        _field(F.col("header"), "Content-Length").cast("long").alias("length"),
        F.octet_length("block").alias("n"),
        F.sha2("block", 256).alias("got"),
    )
    ok = (F.col("n") == F.col("length")) & ((F.col("record_type") == "revisit") | (F.col("got") == F.col("declared")))
    n = F.when(F.coalesce(ok, F.lit(False)), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.coalesce(F.left("header", F.lit(300)), F.lit("?")))).cast("int"))
    return out.select(_page_of(F.col("header"), "WARC-Record-ID").alias("page"), "record_type", "declared", _page_of(F.col("header"), "WARC-Refers-To").alias("refers"), n.alias("n"))


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, reads it back, and returns per page what its record says.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to). A record that fails its
    own length or digest, a response whose payload is lost, or a revisit whose payload is not stored
    under a right digest, raises. An empty table gives an empty result.
    """
    path = path or common.work_dir(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_report(pages.sparkSession, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """What the archive at path says of each page; see archive_report."""
    seen = parsed(read_records(spark, path))
    number = lambda c: F.nullif(F.nullif(F.col(c), F.lit("null")), F.lit("")).cast("long")
    seen = seen.select(number("page").alias("page_id"), "record_type", F.col("declared").alias("payload_digest"), number("refers").alias("refers_to"), "n")
    whole = seen.where("record_type = 'response'").withColumn("payload_bytes", F.col("n").cast("long"))
    revisit = seen.where("record_type = 'revisit'").join(verified_payloads(spark, path).withColumnRenamed("digest", "payload_digest"), "payload_digest", "left")
    lost = F.raise_error(F.concat(F.lit("no right payload for digest "), F.col("payload_digest"))).cast("long")
    revisit = revisit.withColumn("payload_bytes", F.when(F.col("payload_bytes").isNotNull() & (F.col("n") == 0), F.col("payload_bytes")).otherwise(lost))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*names).unionByName(revisit.select(*names))
