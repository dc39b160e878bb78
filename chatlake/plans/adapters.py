"""Adapters from the driver's test tables to the chat data model.

The test data holds no chat exports, so messages, contacts and memories are
derived from the given tables with plain projections (no sampling, no
subsets): every row of the source table becomes a row of the adapter.

* ``msgs_events``: ``events`` as one owner's messages; thread = ``user_id``,
  order = ``event_id``, ``click`` rows are the owner (``Me``).
* ``msgs_conv``: ``conversations`` as threads; ``assistant`` is ``Me``.
* ``phone_docs``: ``documents`` with ``+1 (ddd) ddd-dddd`` numbers flattened
  to contiguous digits, as chat exports hold them.
* ``contacts_fx``: numbers ending in an even digit get the customer name
  keyed by their last two digits, so some numbers stay unresolved.
* ``mems``: ``embeddings`` as memories with a level from ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_OWNER = "events"
CONV_OWNER = "convs"
REPLY_VALUE = 100.0  # events with a larger value are marked as replies
PHONE_DISPLAY_RE = r"\+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{4})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msgs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msgs_of(table(spark, sf_dir, "events"))


def msgs_of(events: DataFrame) -> DataFrame:
    """``events`` rows, of a table or a stream, as messages."""
    return events.select(
        F.lit(EVENTS_OWNER).alias("owner_id"),
        F.col("user_id").cast("string").alias("thread_id"),
        F.col("event_id").alias("seq"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_type") == "click", F.lit("Me")).otherwise(F.col("event_type")).alias("speaker"),
        F.concat_ws(" ", F.col("event_type"), F.format_string("%.2f", F.col("value"))).alias("content"),
        (F.col("value") > REPLY_VALUE).alias("is_reply"),
        F.when(F.col("value") > REPLY_VALUE,
               F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("reply_info"),
        F.lit("events").alias("source"),
    )


def msgs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    ts = F.timestamp_seconds(F.unix_seconds(base) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(
        F.lit(CONV_OWNER).alias("owner_id"),
        F.col("conv_id").cast("string").alias("thread_id"),
        F.col("turn").alias("seq"),
        ts.alias("ts"),
        F.when(F.col("role") == "assistant", F.lit("Me")).otherwise(F.col("role")).alias("speaker"),
        F.col("text").alias("content"),
        F.lit(False).alias("is_reply"),
        F.lit(None).cast("string").alias("reply_info"),
        F.lit("conversations").alias("source"),
    )


def msgs_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``, ten to a thread and close in time, with texts altered by id so that every filter meets some."""
    c, k, th = F.col("conv_id"), F.col("turn"), F.floor(F.col("conv_id") / 10)
    mine, short = F.col("role") == "assistant", F.substring("text", 1, 40)
    pieces, face = F.lit("a <|msg|> " * 21), "\U0001F600"
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    content = F.when((th % 6 == 0) & (c % 10 == 9) & (k == 2), F.concat(F.lit("gamepigeon MESSAGE: "), "text")) \
        .when((th % 6 == 1) & (c % 10 == 8) & (k == 2), F.concat(pieces, short)) \
        .when((th % 6 == 4) & (c % 10 == 5), F.col("text")) \
        .when((th % 6 == 5) & (c % 10 == 9) & mine, F.concat(F.lit("see "), pieces, F.lit("b"))) \
        .when(mine & (c % 10 == 2), "ok fine") \
        .when(mine & (c % 10 == 1), "\u3000".join([face] * 3)) \
        .when(mine & (c % 10 == 3), F.concat(F.lit("see WWW.x.com "), short)) \
        .when(mine & (c % 10 == 4), "dog " * 16 + "and cat") \
        .otherwise(short)
    return table(spark, sf_dir, "conversations").select(
        F.lit("mixed").alias("owner_id"), th.cast("string").alias("thread_id"), (c * 100 + k).alias("seq"),
        F.timestamp_seconds(F.unix_seconds(base) + c * 3600 + k * 60).alias("ts"),
        F.when(mine, "Me").when((th % 6 == 2) & (c % 10 == 5), "guest").when((th % 6 == 2) & (c % 10 == 6), "third").otherwise(F.col("role")).alias("speaker"),
        content.alias("content"), F.lit(False).alias("is_reply"), F.lit(None).cast("string").alias("reply_info"), F.lit("conversations").alias("source"))


def phone_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(EVENTS_OWNER).alias("owner_id"),
        F.col("doc_id"),
        F.regexp_replace("text", PHONE_DISPLAY_RE, "+1$1$2$3").alias("text"),
    )


def contacts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts for the phone numbers found in ``documents``.

    A number whose last digit is even gets the name of the customer whose
    key equals its last two digits; the others stay unresolved.
    """
    d = table(spark, sf_dir, "documents")
    found = d.select(F.explode(F.regexp_extract_all("text", F.lit(PHONE_DISPLAY_RE), 0)).alias("p")) \
        .select(F.regexp_replace("p", "[^0-9]", "").alias("digits")).distinct()
    even = found.filter(F.substring("digits", -1, 1).cast("int") % 2 == 0) \
        .withColumn("k", F.substring("digits", -2, 2).cast("long"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return (even.join(cust, "k")
            .select(F.lit(EVENTS_OWNER).alias("owner_id"), F.col("digits").alias("phone"), "name"))


def mems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories: one per embedding vector."""
    e = table(spark, sf_dir, "embeddings")
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("vec_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type"), F.col("value"))
    level = F.when(F.col("label") == 0, 3).when(F.col("label") <= 3, 2).otherwise(1)
    kind = F.when(F.col("label") == 0, "top").when(F.col("label") <= 1, "combined") \
        .when(F.col("label") <= 3, "inferred").otherwise("original")
    j = e.join(ev, "vec_id", "left")
    return j.select(
        F.lit(EVENTS_OWNER).alias("owner_id"),
        F.col("vec_id").alias("mem_id"),
        level.cast("int").alias("level"),
        kind.alias("kind"),
        F.concat_ws(" ", F.coalesce(F.col("event_type"), F.lit("memory")),
                    F.format_string("%.2f", F.coalesce(F.col("value"), F.lit(0.0))),
                    F.concat(F.lit("label"), F.col("label").cast("string"))).alias("attribute"),
        # Label 9 carries a free-text period, as extracted memories sometimes do.
        F.when(F.col("label") == 9, F.lit("Summer 2023"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts_text"),
        F.col("ts"),
        F.col("embedding"),
        F.col("label"),
    )
