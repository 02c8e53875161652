"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. Equal payloads are found by SHA-1: the row with the smallest page_id is the response, all others become revisit
records without a payload. A record is one text value, the record's end mark is the writer's line separator, so archives are
made inside the JVM, uncompressed and therefore splittable, on any file system that Spark writes to.

Reading. Tasks read byte ranges of the archives, cut at every occurrence of the magic, be it a record's first line or bytes
inside a payload. Every piece is a candidate record: its offset comes from prefix sums over the pieces' lengths, and its
headers, if they parse, give the offset of its successor. Neighbours whose offsets agree join into runs; pointer jumping over
the runs, which doubles the distance in every round, marks what is reachable from the file's start. Only reachable candidates
are records; a magic inside a payload is never reached. The payload of a record that holds such bytes is put together from
its pieces, with the cut-out magic between them.

Defined results: null html is an empty payload; an empty table gives empty archives and an empty result; rows that repeat a
page_id with the same payload are one page written twice, both responses; a null page_id can't be a response that others
refer to unless all its payload's rows have null ids; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, scratch_path, stash

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records of one archive file; narrow rows of as many candidates are ordered by one task.
RECORDS_PER_FILE = 20_000
#: Rows of repeated payloads that may be broadcast (digest and id: about 60 bytes a row).
BROADCAST_ROWS = 100_000
MIN_PAYLOAD = 0
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, by four groups of 40 bits."""
    hexed = F.sha1(payload)
    groups = [F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long") for k in range(4)]
    letters = [F.substring(F.lit(_ALPHABET), F.shiftright(g, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for g in groups for k in range(8)]
    return F.concat(*letters)


def records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, payload, digest and refers_to (null for responses) of every page."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    large = F.octet_length("payload") >= min_payload
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first_id")
    firsts, _ = stash(firsts, "repeated")
    out = rows.join(maybe_broadcast(firsts, BROADCAST_ROWS), (F.col("digest") == F.col("d")) & large, "left")
    return out.select("page_id", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Archives under path, one file per task and RECORDS_PER_FILE records."""
    r = records(pages, min_payload)
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"),
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.octet_length("payload").cast("string")), F.lit(END),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    r.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece between two occurrences of the magic, in reading order within (file, block)."""
    raw = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("piece"))


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every occurrence of the magic: file, offset, its successor's offset by its own headers (null if they don't parse),
    the parsed fields, and the payload's digest where the piece is the whole record."""
    p = _pieces(spark, path)
    p = p.withColumn("size", F.octet_length("piece").cast("long")).withColumn("cut", F.when(F.contains("piece", F.lit(END).cast("binary")), F.octet_length(F.substring_index(F.col("piece").cast("string"), END, 1)) + 1).otherwise(0))
    head = F.decode(F.substring(F.col("piece"), F.lit(1), F.greatest(F.col("cut") - 1, F.lit(0))), "ISO-8859-1")
    p = p.withColumn("head", F.when(F.col("cut") > 0, head))
    p = p.withColumn("content", _header(F.col("head"), "Content-Length").try_cast("long"))
    body_at = F.col("cut") + 3  # bytes of the piece before the payload
    total = F.lit(len(MAGIC)) + body_at + F.col("content") + F.lit(len(END))
    whole = F.col("size") == body_at + F.col("content") + F.lit(len(END))
    payload = F.substring(F.col("piece"), body_at + 1, F.col("content").cast("int"))
    return p.select(
        "file", "block", "seq", "size", F.when((F.col("cut") > 0) & (F.col("content") >= 0), total).alias("total"), body_at.cast("long").alias("body_at"), "content",
        _header(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract(_header(F.col("head"), "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(_header(F.col("head"), "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_header(F.col("head"), "WARC-Payload-Digest"), r"sha1:(\S+)", 1).alias("said_digest"),
        _header(F.col("head"), "X-Payload-Length").try_cast("long").alias("said_bytes"),
        F.when(whole, base32_sha1(payload)).alias("digest"),
    )


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches.

    A run is a stretch of candidates each of which is its forerunner's successor. A run has one way out, so jumping over runs
    is enough, and the rounds are the logarithm of the number of runs that a chain visits."""
    spark = found.sparkSession
    order = Window.partitionBy("file").orderBy("off")
    after, before = F.lead("off").over(order), F.lag("succ").over(order)
    runs = found.withColumn("starts", F.when(before.eqNullSafe(F.col("off")), 0).otherwise(1)).withColumn("after", after)
    runs = runs.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked, marked_path = stash(runs.drop("starts", "after"), "runs")
    exits = marked.groupBy("file", "run").agg(F.max_by("succ", "off").alias("exit"), F.min("off").alias("start"))
    landing = marked.select("file", F.col("off").alias("exit"), F.col("run").alias("next"))
    # Each run: the run that its way out leads to, and where it is entered; only jumps that land on a candidate count.
    links, path = stash(exits.join(landing, ["file", "exit"], "left").select("file", "run", "next", F.col("exit").alias("enters"), F.when(F.col("start") == 0, F.lit(0).cast("long")).alias("entry")), "jumps")
    old = []
    while links.where("next IS NOT NULL").limit(1).count():
        here, there = links.alias("a"), links.alias("b")
        told = here.where("a.entry IS NOT NULL AND a.next IS NOT NULL").select("file", F.col("next").alias("run"), F.col("enters").alias("told"))
        jumped = here.join(there, (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.run")), "left").select("a.file", "a.run", F.col("b.next").alias("next"), F.when(F.col("b.next").isNotNull(), F.col("b.enters")).alias("enters"), "a.entry")
        out, new = stash(jumped.join(told, ["file", "run"], "left").select("file", "run", "next", "enters", F.coalesce("entry", "told").alias("entry")), "jumps")
        old.append(path)
        links, path = out, new
        discard(spark, old.pop())
    entries = links.where("entry IS NOT NULL").select("file", "run", "entry")
    return marked.join(entries, ["file", "run"]).where("off >= entry AND succ IS NOT NULL").drop("run", "entry")


def located(found: DataFrame) -> DataFrame:
    """Candidates with their offsets: lengths summed in reading order, first over the blocks of a file, then within a block.

    What precedes the first magic of a file is no candidate and is dropped here."""
    unit = F.col("size") + F.lit(len(MAGIC))
    order = Window.partitionBy("file").orderBy("block", "seq")
    at = F.sum(unit).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = found.withColumn("off", at - F.lit(len(MAGIC))).where("off IS NOT NULL")
    return df.withColumn("succ", F.col("off") + F.col("total"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to, file, off.

    A response's digest is that of the bytes read. A revisit's is the one that its record names."""
    found, _ = stash(candidates(spark, path), "candidates")
    kept, _ = stash(reachable(located(found)), "reachable")
    split = kept.where("digest IS NULL")
    if split.limit(1).count():
        kept = kept.join(_joined(spark, path, found, split), ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")
    revisit = F.col("record_type") == "revisit"
    return kept.select(
        "page_id", F.when(revisit, F.col("said_bytes")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to", "file", "off",
    )


def _joined(spark: SparkSession, path: str, found: DataFrame, split: DataFrame) -> DataFrame:
    """Digests of payloads that hold the magic: the pieces from each such record to its successor, read once more.

    The second reading plans the same blocks of the same files, so the order within a block agrees with the first."""
    at = located(found).select("file", "block", "seq", "off")
    starts = split.select("file", F.col("off").alias("start"), "succ", "body_at", "content")
    order = Window.partitionBy("file").orderBy("off", F.col("start").desc_nulls_last())
    # The owner of a piece is the last reachable start at or before it; only pieces before its successor are its own.
    both = at.withColumn("start", F.lit(None).cast("long")).join(split.select("file").distinct(), "file", "left_semi").unionByName(starts.select("file", F.col("start").alias("off"), "start"), allowMissingColumns=True)
    owned = both.withColumn("owner", F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("seq IS NOT NULL AND owner IS NOT NULL").select("file", "block", "seq", "off", F.col("owner").alias("start"))
    owned = owned.join(starts, ["file", "start"]).where("off < succ")
    raw = _pieces(spark, path).join(owned, ["file", "block", "seq"])
    glued = raw.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("off", F.hex("piece").alias("x")))).alias("parts"), F.first("body_at").alias("body_at"), F.first("content").alias("content"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda x: x["x"]), MAGIC.encode().hex().upper()))
    payload = F.substring(whole, F.col("body_at").cast("int") + 1, F.col("content").cast("int"))
    return glued.select("file", F.col("start").alias("off"), base32_sha1(payload).alias("joined"))


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, min_payload)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
  substr('{_ALPHABET}', CAST(((CAST('0x' || substr(x, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM m
"""
