"""WARC archives: deduplicated writing, and reading by boundary-chain verification.

Writing: of rows with equal payloads of at least ``LEAST`` bytes, that with the
largest id becomes a response record and the others refer to it. Spark's text
writer puts the records into the shared folder, ``RECORDS`` to a file at most.

Reading: Spark's text reader cuts the files at every magic string, wherever
splits fall. Each cut is a candidate record that names its successor (its
offset + header + Content-Length + closing blank lines). Pointer jumping from
the start of each file keeps the reachable candidates only, so a magic string
inside a payload is never taken for a record, however much it looks like one.

Defined cases: a null payload is empty; a null URL has no URI field, line breaks
in a URL are percent-encoded; a null id is the smallest and reads back as null;
of rows that share the largest id of a group all are responses; an empty table
writes no records and reads back none; other columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.session import scratch_path, settle

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
LEAST = 1000
RECORDS = 2000  # per file
DATE = "2024-01-01T00:00:00Z"


def marked(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """(id, url, payload, digest, original): original is the id a row revisits, null for responses."""
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    )
    rows = rows.select("*", F.sha1(F.encode("payload", "utf-8")).alias("digest"))
    large = F.octet_length("payload") >= least
    several = (
        rows.filter(large)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("newest"))
        .filter("copies > 1")
        .select("digest", "newest")
    )
    # written first: its size is then known, and Spark need not shuffle the payloads where it is small
    joined = rows.join(settle(several), "digest", "left")
    older = large & F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    return joined.select("id", "url", "payload", "digest", F.when(older, F.col("newest")).alias("original"))


def record(rows: DataFrame) -> DataFrame:
    """value: the text of one record per row, without the closing blank lines."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    again = F.col("original").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(
        F.concat(
            F.lit(f"{MAGIC}WARC-Type: "),
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: "),
            urn(F.col("id")),
            F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
            F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("original")))).otherwise(F.lit("\r\n")),
            F.lit("Content-Length: "),
            F.octet_length(body).cast("string"),
            F.lit(BREAK),
            body,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    rows = record(marked(pages, key, url, payload))
    rows.write.option("lineSep", BREAK).option("maxRecordsPerFile", RECORDS).text(path)


def field(header: Column, name: str, value: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), header, F.lit("\r\n")), f"\r\n{name}: {value}\r\n", 1)
    return F.when(found != "", found)


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, slot, value): the texts between magic strings, in file order by (block, slot)."""
    text = spark.read.option("lineSep", MAGIC).schema("value string").text(path)
    return text.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("slot"),
        "value",
    )


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``at``, the byte where the magic string before each cut starts; the text before the first has none.

    A window holds one file, which ``RECORDS`` bounds.
    """
    order = Window.partitionBy("file").orderBy("block", "slot")
    before = F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("at", before - len(MAGIC)).filter("at is not null")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    header = F.substring_index("value", BREAK, 1)
    rows = cuts(spark, path).select(
        "file", "block", "slot", "value", F.octet_length("value").alias("size"),
        F.when(F.instr("value", BREAK) > 0, header).alias("header"),
    )
    head = F.octet_length("header") + len(BREAK)
    rows = rows.select("*", head.alias("head"), field(F.col("header"), "Content-Length", "(\\d{1,18})").cast("long").alias("length"))
    whole = F.col("size") >= F.col("head") + F.col("length")
    body = F.expr("substring(encode(value, 'utf-8'), head + 1, cast(length as int))")
    return placed(
        rows.select(
            "file", "block", "slot", "size", "head", "length",
            field(F.col("header"), "WARC-Type", "(\\w+)").alias("kind"),
            field(F.col("header"), "WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("long").alias("id"),
            field(F.col("header"), "WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("long").alias("original"),
            F.when(whole, F.sha1(body)).alias("digest"),
        )
    ).withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("length") + len(BREAK))


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain from the start of each file; a round doubles the jumps."""
    nodes = found.select("file", "at")
    jump = settle(
        found.filter("next is not null")
        .select("file", "at", "next")
        .join(nodes.withColumnRenamed("at", "next"), ["file", "next"], "left_semi")
        .select("file", "at", "next")
    )
    known = nodes.filter("at = 0")
    while True:
        step = jump.join(known, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = settle(known.unionByName(step))
        twice = jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"])
        jump = settle(twice.select("file", "at", F.col("then").alias("next")))
        if jump.isEmpty():
            return known


def joined_payloads(spark: SparkSession, path: str, torn: DataFrame, known: DataFrame) -> DataFrame:
    """(file, at, digest) of records whose payload holds magic strings: their cuts put together again.

    Only the files that hold such records are read again; their list is written
    first, so that its size is known before any payload is shuffled.
    """
    files = settle(torn.select("file").distinct())
    if files.isEmpty():
        return torn.select("file", "at", F.lit(None).cast("string").alias("mended"))
    rows = placed(
        cuts(spark, path).join(files, "file", "left_semi").withColumn("size", F.octet_length("value"))
    ).join(known.withColumn("own", F.lit(True)), ["file", "at"], "left")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("record", F.last(F.when(F.col("own"), F.col("at")), ignorenulls=True).over(upto))
    rows = rows.join(torn.select("file", F.col("at").alias("record")), ["file", "record"], "left_semi")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    text = rows.groupBy("file", F.col("record").alias("at")).agg(F.array_join(parts, MAGIC).alias("value"))
    body = F.expr("substring(encode(value, 'utf-8'), head + 1, cast(length as int))")
    return text.join(torn.select("file", "at", "head", "length"), ["file", "at"]).select(
        "file", "at", F.sha1(body).alias("mended")
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, original, bytes, digest) per record; a revisit has those of the payload it refers to."""
    found = settle(candidates(spark, path))
    known = reachable(found)
    records = settle(found.join(known, ["file", "at"]))
    torn = records.filter("digest is null and length is not null")
    mended = joined_payloads(spark, path, torn, known)
    rows = records.join(mended, ["file", "at"], "left").select(
        "id", "kind", "original", F.col("length").alias("bytes"), F.coalesce("digest", "mended").alias("digest")
    )
    first = rows.filter("kind = 'response'")
    again = rows.filter("kind = 'revisit'").select("id", "kind", "original")
    wanted = again.select(F.col("original").alias("id")).distinct()
    originals = first.join(wanted, "id", "left_semi").groupBy("id").agg(
        F.max(F.struct("bytes", "digest")).alias("full")
    )
    resolved = again.join(originals.withColumnRenamed("id", "original"), "original", "left")
    return first.unionByName(
        resolved.select("id", "kind", "original", F.col("full.bytes").alias("bytes"), F.col("full.digest").alias("digest"))
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new folder in the shared one and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
