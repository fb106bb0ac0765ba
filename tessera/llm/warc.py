"""A content-addressed WARC archive.

Two tables in a folder: ``payloads`` keeps the bytes of each distinct payload
once, under its SHA-256 digest and length; ``records`` keeps the exact header
bytes of every record.  A join on the digest gives back the original records.
On reading, payloads are digested again and must match their key.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch, stored

#: Payloads of fewer bytes are kept for every record and never revisited.
LEAST_BYTES = 0
_URN = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_header(page_id, url: str | None, size: int, sha1: str, refers_to, kind: str) -> bytes:
    """Header bytes of a WARC 1.1 record, up to and with the empty line; a revisit has an empty block."""
    url = " ".join((url or "").split()) or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def parse_header(header: bytes) -> dict[str, str]:
    """Fields of header bytes, by lower-case name; the first line is `version`."""
    first, *lines = header.decode().rstrip("\r\n").split("\r\n")
    return {"version": first} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _digested(pages: DataFrame) -> DataFrame:
    """(page_id, url, size, sha1, digest) from (page_id, url, payload)."""

    def fn(batch):
        payload = [p or b"" for p in batch.column("payload").to_pylist()]
        cols = [batch.column("page_id"), batch.column("url"), pa.array(list(map(len, payload)), pa.int64()), pa.array(list(map(sha1_base32, payload))), pa.array([hashlib.sha256(p).digest() for p in payload], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "size", "sha1", "digest"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages, fn, f"page_id {kind}, url string, size long, sha1 string, digest binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Writes the two tables for pages; payload: the html in UTF-8, null as empty.

    Of records with equal payloads of at least `least_bytes` bytes the one
    with the smallest id holds the payload and the others revisit it.  Rows
    that repeat an id with its payload give one record each, of one kind;
    their payload is stored once.  A row without an id is never chosen while
    one with an id has the payload; where none has, it is a response.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("payload"))
    meta = stored(_digested(rows), "warc-meta")
    first = stored(meta.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("holder")), "warc-first")
    key = [meta.digest == first.digest, meta["size"] == first["size"]]
    told = meta.join(first, key, "left").select("page_id", "url", meta["size"], "sha1", meta.digest, F.when(F.col("holder") != F.col("page_id"), F.col("holder")).when(F.col("page_id").isNull(), F.col("holder")).alias("refers_to"))

    def fn(batch):
        cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "size", "sha1", "refers_to")]
        kinds = ["response" if r is None else "revisit" for r in cols[4]]
        heads = [record_header(*x) for x in zip(*cols, kinds)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(heads, pa.binary()), batch.column("digest"), batch.column("size")], ["page_id", "header", "digest", "size"])

    kind = rows.schema["page_id"].dataType.simpleString()
    map_arrow(told, fn, f"page_id {kind}, header binary, digest binary, size long").write.option("compression", "zstd").parquet(f"{path}/records")

    # The holders' payloads; the digest is taken again beside the bytes, and only ids and digests cross to find the others.
    revisits = stored(told.where("refers_to is not null and page_id is not null").select("page_id", "digest").distinct(), "warc-revisits")
    held = rows.select("page_id", F.coalesce("payload", F.lit(b"")).alias("payload"))
    held = held.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    held = held.join(revisits, ["page_id", "digest"], "left_anti")
    again = stored(told.where("refers_to is null or page_id is null").groupBy("digest", "size").count().where("count > 1").select("digest", "size"), "warc-again")
    if not again.isEmpty():  # small payloads, repeated rows and rows without an id: keep one
        mark = again.withColumn("again", F.lit(True))
        held = held.join(mark, ["digest", "size"], "left")
        once = held.where("again").dropDuplicates(["digest", "size"])
        held = held.where("again is null").unionByName(once)
    held.select("digest", "size", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload_bytes, payload_digest, payload) of the stored payloads; a payload that no longer matches its key raises."""
    own = spark.read.parquet(f"{path}/payloads")
    same = (F.sha2("payload", 256) == F.lower(F.hex("digest"))) & (F.octet_length("payload") == F.col("size"))
    checked = own.select(F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")).alias("digest"), F.col("size").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "payload")
    return checked


def base32(hexed):
    """Upper-case base32 of a hexadecimal column of 40 digits: five hexadecimal digits are four of base 32."""
    out = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, joined to their payloads.

    (page_id, header, payload, payload_bytes, payload_digest, record_type,
    refers_to, record): payload_* are of the full payload, also for a revisit;
    record is the exact record (header, block, two line ends).  Columns that
    are not asked for are not read or moved.
    """
    heads = spark.read.parquet(f"{path}/records")
    held = verified_payloads(spark, path).withColumnRenamed("digest", "held_digest")
    field = lambda name: F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)", 1)
    there = F.when(F.col("held_digest").isNull(), F.raise_error(F.lit("a record's payload is missing")).cast("long")).otherwise(F.col("payload_bytes"))
    refers = F.nullif(F.regexp_extract(field("WARC-Refers-To"), rf"<{_URN}(.*)>", 1), F.lit(""))
    out = None
    for kind, block in (("response", F.col("payload")), ("revisit", F.lit(b""))):  # apart, as a revisit's record needs no payload's bytes
        own = heads.where(field("WARC-Type") == kind)
        rows = own.join(held, (own.digest == held.held_digest) & (own["size"] == held.payload_bytes), "left")
        rows = rows.select("page_id", "header", "payload", there.alias("payload_bytes"), "payload_digest", F.lit(kind).alias("record_type"), refers.alias("refers_to"), F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes an archive of pages (by default in the shared folder), reads it back and returns one row a page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to,
    record_sha256): the last is of the exact record, put together again from
    its header and its payload.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc-archive")
    write_archive(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    return records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.sha2("record", 256).alias("record_sha256"))
