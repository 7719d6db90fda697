"""Content-addressed WARC archive: payload bytes are stored once by a verified SHA-256, record headers apart, and records come back by joins.

Page rows become WARC/1.1 records. Of the records with byte-equal payloads the one with the largest page_id is a ``response``; the
others are ``revisit`` records that refer to it. Payloads shorter than ``min_revisit_bytes`` are always ``response`` records.

Nulls: a null html is an empty payload, a null url an empty target; a null page_id is kept and never the largest of a group that has
an id. Rows that repeat a page_id are records of their own, each with its own record id: all of them are responses if the id is the largest. An
empty table gives empty archives. Columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import materialize, shared_dir

CRLF = "\r\n"
#: Fixed value: the profile of revisits with an identical payload in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    """headers: one row per record (page_id, record_type, refers_to_id, header, sha256; holds marks one record of each digest); payloads: one row per distinct payload (sha256, payload)."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, each eight digits."""
    digest = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(part(i) for i in range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(kind: Column, record: Column, url: Column, length: Column, digest: Column, refers: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x["page_id"].cast("string"), F.lit("null")), F.lit(":"), x["row"].cast("string"), F.lit(">"))
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", urn(record)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(refers)))).otherwise(""), line("Content-Length", length.cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write headers and payloads as tables of the shared folder; ``date`` is the records' date, as pages has none.

    One shuffle of digests finds each payload's record, its holder (partial sums take up hot payloads before it); the payload bytes themselves
    move once, copies already dropped. Holders and payloads, one row per digest each, are bucketed alike, so that joining them moves no payload;
    all other records stand in a plain table, whose joins adaptive execution may split. A digest is verified: all rows that share a SHA-256
    must agree in length and SHA-1.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    record = F.struct("page_id", F.monotonically_increasing_id().alias("row"))
    keyed = rows.select(record.alias("record"), "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"))
    keyed = materialize(keyed, "warc-keyed")  # rows keep their numbers from here on
    # the largest page_id, and the last row of those; nulls are smallest
    holder = F.max(F.struct("record.page_id", "record.row", "url")).alias("holder")
    holders = keyed.groupBy("sha256").agg(holder, F.min("payload_bytes").alias("lo"), F.max("payload_bytes").alias("hi"), F.min("sha1").alias("sha1_lo"), F.max("sha1").alias("sha1_hi"))
    sound = (F.col("lo") == F.col("hi")) & (F.col("sha1_lo") == F.col("sha1_hi"))
    holders = holders.withColumn("holder", F.when(F.assert_true(sound, F.lit("two payloads share a SHA-256")).isNull(), F.col("holder")))
    held = F.col("holder")
    columns = ["page_id", "record_type", "refers_to_id", "sha256", "header"]
    first = holders.select(
        held["page_id"].alias("page_id"), held["row"].alias("row"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to_id"), "sha256",
        _header(F.lit("response"), held, held["url"], F.col("lo"), F.col("sha1_lo"), held, date).alias("header"),
    )
    first, plain = _bucketed(first, "warc_holders")
    known = plain.select("sha256", F.struct("page_id", "row").alias("holder"))
    response = (F.col("payload_bytes") < min_revisit_bytes) | held["page_id"].isNull() | F.col("record.page_id").eqNullSafe(held["page_id"])
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    others = keyed.join(known, "sha256").where(F.col("record.row") != held["row"]).select(
        F.col("record.page_id").alias("page_id"), kind.alias("record_type"), F.when(kind == "revisit", held["page_id"]).alias("refers_to_id"), "sha256",
        _header(kind, F.col("record"), F.col("url"), F.when(kind == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")), F.col("sha1"), held, date).alias("header"),
    )
    others = materialize(others, "warc-others")
    # equal digests are equal payloads, so each is kept once by an aggregate that drops copies before it shuffles
    store, _ = _bucketed(rows.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload")), "warc_payloads")
    headers = first.select(*columns, F.lit(True).alias("holds")).unionByName(others.select(*columns, F.lit(False).alias("holds")))
    return Archive(headers, store)


def _bucketed(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """df as a table of the shared folder, bucketed by digest like its partner, so that joining them again moves no payload; and the same rows as plain files.

    Spark writes buckets only into tables of the catalog. The table's entry goes as soon as it is read, its files stay.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "sha256").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, spark.read.schema(table.schema).parquet(path)


def read_archive(archive: Archive) -> DataFrame:
    """Original records: headers joined with their payloads. A payload that does not have the digest under which it is kept, or is missing, raises."""
    held = archive.payloads.select(F.col("sha256").alias("held"), "payload")
    sound = F.col("held").isNotNull() & (F.sha2("payload", 256) == F.col("held"))
    checked = F.when(F.assert_true(sound, F.lit("a payload is missing, or differs from its digest")).isNull(), F.col("payload"))
    return archive.headers.join(held, F.col("sha256") == F.col("held"), "left").withColumn("payload", checked).drop("held")


def replay_records(archive: Archive) -> DataFrame:
    """record_page, record_type, refers_to, payload_bytes and payload_digest of every record, read back from the archive.

    The record that holds a payload is rebuilt from header and payload, and what it declares must be what it holds. The other records of that digest,
    revisits without a block of their own and responses, take length and digest of the rebuilt one, which their headers must declare too; so a payload
    with very many copies is rebuilt once and not per copy.
    """
    whole = record_fields(read_archive(Archive(archive.headers.where("holds"), archive.payloads)))
    record = F.concat(F.encode("header", "UTF-8"), F.col("payload"))
    block = F.substring(record, F.octet_length("header") + 1, F.col("declared_bytes").cast("int"))
    whole = whole.withColumn("block", block).select("record_page", "declared_digest", "declared_bytes", "sha256", F.octet_length("block").cast("long").alias("payload_bytes"), base32_sha1(F.col("block")).alias("payload_digest"))
    sound = (F.col("declared_digest") == F.col("payload_digest")) & (F.col("declared_bytes") == F.col("payload_bytes"))
    digest = F.when(F.assert_true(sound, F.lit("a record differs from its header")).isNull(), F.col("payload_digest"))
    whole = materialize(whole.select("record_page", "sha256", "payload_bytes", digest.alias("payload_digest")), "warc-read")
    others = record_fields(archive.headers.where("NOT holds")).join(whole.drop("record_page"), "sha256", "left")
    sound = (F.col("declared_digest") == F.col("payload_digest")) & ((F.col("record_type") == "revisit") | (F.col("declared_bytes") == F.col("payload_bytes")))
    digest = F.when(F.assert_true(F.coalesce(sound, F.lit(False)), F.lit("a record differs from the payload of its digest")).isNull(), F.col("payload_digest"))
    columns = ["record_page", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    holders = whole.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return holders.select(*columns).unionByName(others.withColumn("payload_digest", digest).select(*columns))


def record_fields(records: DataFrame) -> DataFrame:
    """The records with the fields of their headers: record_page, record_type, target, declared_digest, declared_bytes, refers_to."""
    field = lambda name, pattern=r"[^\r]*": F.regexp_extract("header", rf"\r\n{name}: ({pattern})\r\n", 1)
    page = lambda name: F.regexp_extract("header", rf"\r\n{name}: <urn:page:(-?\d+):\d+>", 1)
    to_id = lambda c: F.when(c != "", c.cast("long"))
    return records.drop("record_type").select(
        "*", to_id(page("WARC-Record-ID")).alias("record_page"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"), field("Content-Length").cast("long").alias("declared_bytes"), to_id(page("WARC-Refers-To")).alias("refers_to"),
    )


def export_warc_text(records: DataFrame, path: str) -> None:
    """Write records as gzip-compressed WARC files: header, block, and two line ends after each record."""
    block = F.when(F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
