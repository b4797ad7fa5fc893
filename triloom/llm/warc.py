"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialise, new_path

_HEX32, _BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five digits are 20 bits are four letters."""
    parts = [F.lpad(F.lower(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row as two tables under path: ``payloads`` (digest, payload) and ``headers`` (id, header, head, digest).

    The payload is the body in UTF-8; a null body is empty. Of the records with equal payloads of at least min_bytes bytes the
    one with the largest id is a response, the others are revisits that refer to it; shorter payloads are all responses. A
    payload is stored once under its SHA-256, taken together with SHA-1 and length; readers verify it. ``header`` holds a
    record's WARC header and ``head`` the HTTP header before the payload, both byte for byte.

    Rows that repeat id and payload are one record each but share what they say; a null id is smaller than any other; a null
    URL leaves its field out; line breaks in a URL become spaces; other columns are not read; an empty table gives empty ones.

    Hashes are grouped with map-side combining, and a payload that a third of the rows share meets them by join_groups(). The
    bodies are not shuffled unless the list of rows whose payload is stored elsewhere is too large to broadcast.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    whole = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    hashed = whole.withColumn("digest", F.sha2("payload", 256))
    rows = hashed.select("id", "url", "digest", base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    rows = materialise(rows, "warc-rows")
    groups = rows.groupBy("digest", "sha1", "bytes").agg(F.max("id").alias("first_id"), F.max_by("url", "id").alias("first_url"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups.where((F.col("copies") > 1) & (F.col("bytes") >= min_bytes)), "warc-groups")
    typed = join_groups(rows, groups, ["digest", "sha1", "bytes"], "copies")
    typed = typed.withColumn("revisit", F.col("copies").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")))
    head = F.lit(HTTP_HEAD)
    length = F.octet_length(head) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    only = lambda c: F.when(F.col("revisit"), c)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", clean(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", only(F.lit(PROFILE))),
        _field("WARC-Refers-To", only(_record_id(F.col("first_id")))),
        _field("WARC-Refers-To-Target-URI", only(clean(F.col("first_url")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    typed.select("id", header.cast("binary").alias("header"), head.cast("binary").alias("head"), "digest", "copies").write.parquet(f"{path}/headers")
    written = rows.sparkSession.read.parquet(f"{path}/headers")
    elsewhere = written.where(_type() == "revisit").select("id", "digest")
    repeated = written.where(_type() == "response").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    elsewhere, repeated = materialise(elsewhere, "warc-elsewhere").alias("e"), materialise(repeated, "warc-repeated")
    here = hashed.select("id", "digest", "payload").alias("h")
    here = here.join(elsewhere, F.col("h.id").eqNullSafe(F.col("e.id")) & (F.col("h.digest") == F.col("e.digest")), "left_anti").select("digest", "payload")
    once = here.join(repeated, "digest", "left_anti").unionByName(here.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.max("payload").alias("payload")))
    once.write.parquet(f"{path}/payloads")


def _text(column: str = "header") -> Column:
    return F.col(column).cast("string")


def _type() -> Column:
    return F.regexp_extract(_text(), r"\r\nWARC-Type: (\w+)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt: id, record_type, refers_to, header, head, digest, payload, record (its exact bytes), and of the full payload, a
    revisit's included, payload_bytes and payload_digest.

    Each stored payload is verified against the digest it is filed under, each record against the digest and the Content-Length in its own
    header; a mismatch fails the job. Only responses carry payload bytes (one row each per digest unless rows repeat); revisits get
    length and digest of the payload they refer to.

    Payloads are hashed and measured where they are read; those small facts meet all headers by join_groups(), and only then the
    headers of responses meet the payloads themselves, in the one shuffle of them.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    facts = payloads.select("digest", F.octet_length(sound).cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    facts = materialise(facts, "warc-facts").join(headers.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")), "digest")
    page = lambda field: F.expr(f"try_cast(regexp_extract(cast(header as string), '\\r\\n{field}: <urn:page:(-?[0-9]+)>\\r\\n', 1) as long)")
    parsed = join_groups(headers.select("header", "head", "digest"), materialise(facts, "warc-uses"), ["digest"], "uses", "inner").select(
        page("WARC-Record-ID").alias("id"), _type().alias("record_type"), page("WARC-Refers-To").alias("refers_to"), "header", "head", "digest", "payload_bytes", "payload_digest",
        F.regexp_extract(_text(), r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1).alias("stated"), F.regexp_extract(_text(), r"\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("length"),
    )
    agreed = F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload does not match its record's digest")))
    parsed = parsed.withColumn("payload_digest", agreed).drop("stated")
    responses = parsed.where("record_type = 'response'").join(payloads, "digest")
    revisits = parsed.where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    block = F.concat("head", F.coalesce("payload", F.lit(b"")))
    whole = F.when(F.octet_length(block) == F.col("length"), F.concat("header", block, F.lit(b"\r\n\r\n"))).otherwise(F.raise_error(F.lit("record does not match its Content-Length")))
    columns = ["id", "record_type", "refers_to", "header", "head", "digest", "payload"]
    return responses.unionByName(revisits).select(*columns, whole.alias("record"), "payload_bytes", "payload_digest")


def archive(pages: DataFrame, **options) -> DataFrame:
    """write_archive() to a new scratch folder, then read_archive()."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path)
