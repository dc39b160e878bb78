"""Chat export sources (S01-S05, S11, S12, S16) and record assembly.

Text exports are read as lines with ``spark.read.text``; the line order of a
file is ``(_metadata.file_block_start, position inside the split)``, which
survives Spark cutting a big file into many splits.  Record assembly then
works on ``(thread_id, line_no, value)`` with windows over each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.text import py_strip
from chatlake.operators.deal import staged

# Fixed values of the text-export format.
EXPORT_TS_RE = r"[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2} [AP]M"
EXPORT_TS_FORMAT = "MMM d, yyyy h:mm:ss a"
REPLY_LINE = "This message responded to an earlier message."
SYSTEM_PREFIXES = ["This message", "Tapbacks:", "/Users/", "Edited to"]


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _thread_of(path: Column, root: str) -> Column:
    """File path below ``root`` without extension: files of one name in two folders are two threads."""
    below = F.substring_index(path, root.rstrip("/") + "/", -1)
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(below, r"\.[^./]*$", ""), r"\+", "%2B"))


def _owner_of(path: Column, root: str, owner_id: str | None) -> Column:
    """``owner_id``, or where it is None the first folder of ``path`` below ``root`` (of ``name=value`` the value)."""
    if owner_id is not None:
        return F.lit(owner_id)
    first = F.substring_index(F.substring_index(path, root.rstrip("/") + "/", -1), "/", 1)
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(first, r"^[^=]*=", ""), r"\+", "%2B"))


def _parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


#: Bytes of an export file that one task may rank.
WHOLE_FILE = 1 << 22

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders listed by some tasks a core: with Spark's own number, 10,000, each folder of an owner gets a task."""
    own = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, own)


def read_text_lines(spark: SparkSession, path: str, glob: str = "*.txt", owner_id: str | None = "me") -> DataFrame:
    """Lines of every export file with a dense per-file line number.

    With ``owner_id`` None the exports of many owners are read at once, a folder
    below ``path`` for each.

    Returns ``(owner_id, thread_id, file_path, line_no, value)``; ``thread_id``
    is the file name without extension.  A big file is read as many splits;
    numbering never puts a whole big file in one task: rows are ranked inside
    their split, and each split is offset by the line counts of the earlier
    splits of the file (a small per-split table, for which big files are read
    twice).  Files up to ``WHOLE_FILE`` bytes are read once and ranked as a whole.
    """
    with _few_listing_tasks(spark):
        df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    size = F.col("_metadata.file_size")
    small, big = (df.filter(cond).select("value", F.col("_metadata.file_path").alias("file_path"),
                                         F.col("_metadata.file_block_start").alias("_blk"),
                                         F.monotonically_increasing_id().alias("_mid")) for cond in (size <= WHOLE_FILE, size > WHOLE_FILE))
    whole = W.partitionBy("file_path").orderBy("_blk", "_mid")
    d = small.withColumn("line_no", F.row_number().over(whole)).unionByName(dense_numbers(big, ["file_path"], "_blk", ["_mid"], "line_no"))
    return d.select(_owner_of(F.col("file_path"), path, owner_id).alias("owner_id"), _thread_of(F.col("file_path"), path).alias("thread_id"),
                    "file_path", F.col("line_no").cast("long"), "value")


def dense_numbers(df: DataFrame, key: list[str], chunk: str, order: list[str], out: str) -> DataFrame:
    """1-based dense numbers per ``key`` in ``(chunk, *order)`` order.

    Rows are ranked inside each ``(key, chunk)`` and offset by the row counts
    of the earlier chunks of the key (a small per-chunk table, read off each
    chunk's last row), so a key holding a large share of the rows is numbered
    by many tasks.
    """
    wl = W.partitionBy(*key, chunk).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(wl)).withColumn("_last", F.lead(F.lit(True)).over(wl).isNull())
    ws = W.partitionBy(*key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    per = ranked.filter("_last").select(*key, chunk, "_rn").withColumn("_off", F.coalesce(F.sum("_rn").over(ws), F.lit(0))).drop("_rn")
    return ranked.join(per, [*key, chunk]).withColumn(out, F.col("_off") + F.col("_rn")).drop("_off", "_rn", "_last")


LINE_BUCKET = 1 << 16   # lines per scan bucket in record assembly


def _with_halo(lv: DataFrame, n: int, n_prev: int = 0, bucket: int | None = None) -> DataFrame:
    """Lines with their bucket ``_lb``; a bucket also gets the ``n`` lines after it and the ``n_prev`` before it (``_own`` false)."""
    bucket = bucket or LINE_BUCKET
    at, pos = F.floor(F.col("line_no") / bucket), F.col("line_no") % bucket
    also = [F.when(pos < n, at - 1), F.when(pos >= bucket - n_prev, at + 1)]
    own = lv.withColumn("_home", at).withColumn("_lb", F.explode(F.array_compact(F.array(at, *also))))
    return own.withColumn("_own", F.col("_lb") == F.col("_home")).drop("_home")


def _next_lines(lv: DataFrame, key: list[str], n: int, col: str = "v", n_prev: int = 0) -> DataFrame:
    """Add ``_next1.._next{n}`` (and ``_prev1.._prev{n_prev}``) of ``col``
    without whole-file windows.

    Lines are bucketed by their dense ``line_no``; each bucket also gets the
    few lines next to it, so one window per bucket sees all neighbours.
    """
    w = W.partitionBy(*key, "_lb").orderBy("line_no")
    cols = [F.lead(col, k).over(w).alias(f"_next{k}") for k in range(1, n + 1)] + \
           [F.lag(col, k).over(w).alias(f"_prev{k}") for k in range(1, n_prev + 1)]
    return _with_halo(lv, n, n_prev).select("*", *cols).filter("_own").drop("_own")


def parse_export_ts(c: Column) -> Column:
    """``MMM d, yyyy  h:mm:ss a`` with any run of spaces, as a timestamp."""
    norm = F.regexp_replace(c, r"\s+", " ")
    return F.try_to_timestamp(norm, F.lit(EXPORT_TS_FORMAT))


def assemble_records(lines: DataFrame, source: str = "imessage") -> DataFrame:
    """Records of the text export as ``messages`` rows.

    ``lines``: ``(owner_id, thread_id, line_no, value)``.  A stripped line
    that starts with a timestamp opens a record unless it is the sender or
    content line of the record before; the next line is the sender and the
    one after it the content (only that first content line counts); a record
    missing its content line at the end of the file is dropped.  A following
    ``This message responded ...`` line flags a reply.  System and
    attachment records are dropped before sessionising.

    Timestamp lines closer than 3 lines to each other form small clusters;
    inside a cluster the greedy rule is a fold over the sorted positions.
    """
    key = ["owner_id", "thread_id"]
    lv = lines.select(*key, "line_no", py_strip(F.col("value")).alias("v"))
    lv = _next_lines(lv, key, 3, "v", n_prev=2)
    is_ts = lambda c: F.coalesce(F.col(c).rlike(f"^({EXPORT_TS_RE})"), F.lit(False))
    start = ~is_ts("_prev1") & ~is_ts("_prev2")
    stamped = lv.withColumn("ts_txt", F.regexp_extract("v", f"^({EXPORT_TS_RE})", 1)).filter(F.col("ts_txt") != "") \
        .select(*key, "_lb", "line_no", "ts_txt", F.col("_next1").alias("sender"), F.col("_next2").alias("content"), F.col("_next3").alias("after"),
                (start & ~is_ts("_next1") & ~is_ts("_next2")).alias("_alone"), F.when(start, F.col("line_no")).alias("_cs"))
    stamped = staged(stamped)  # read three times
    # A lone timestamp line starts a record.  Lines of longer clusters (rare)
    # go through the greedy fold: a cluster starts where no timestamp line is
    # 1 or 2 lines earlier; each line belongs to the latest start at or before
    # it (running max per line bucket, carried across buckets by a small table).
    rec = ["line_no", "ts_txt", "sender", "content", "after"]
    single = stamped.filter("_alone").select(*key, *rec)
    wb = W.partitionBy(*key, "_lb").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    t2 = stamped.filter(~F.col("_alone")).withColumn("_cl", F.max("_cs").over(wb))
    carry = t2.groupBy(*key, "_lb").agg(F.max("_cs").alias("_bmax"))
    wc = W.partitionBy(*key).orderBy("_lb").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.withColumn("_carry", F.max("_bmax").over(wc)).drop("_bmax")
    t2 = t2.join(carry, [*key, "_lb"], "left").withColumn("_cl", F.coalesce("_cl", "_carry"))
    lines_of = F.array_sort(F.collect_list(F.struct(*rec)))
    fold = F.aggregate(
        lines_of, F.struct(F.lit(-10).cast("long").alias("last"), F.array().cast("array<long>").alias("starts")),
        lambda acc, p: F.when(p["line_no"] - acc["last"] >= 3,
                              F.struct(p["line_no"].alias("last"), F.concat(acc["starts"], F.array(p["line_no"])).alias("starts")))
                        .otherwise(acc),
        lambda acc: acc["starts"])
    starts = t2.groupBy(*key, "_cl").agg(fold.alias("s"), lines_of.alias("_rows")) \
        .select(*key, F.inline(F.filter("_rows", lambda x: F.array_contains(F.col("s"), x["line_no"]))))
    rec = single.unionByName(starts).filter(F.col("content").isNotNull())
    is_reply = F.coalesce(F.col("after") == REPLY_LINE, F.lit(False))
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system = system | F.col("content").startswith(p)
    return rec.filter(~system).select(
        *key, F.col("line_no").alias("seq"),
        parse_export_ts(F.col("ts_txt")).alias("ts"),
        F.col("sender").alias("speaker"), "content",
        is_reply.alias("is_reply"),
        F.when(is_reply, F.lit(REPLY_LINE)).alias("reply_info"),
        F.lit(source).alias("source"))


# --------------------------------------------------------------------------
# Messenger
# --------------------------------------------------------------------------

MESSENGER_SCHEMA = T.StructType([
    T.StructField("participants", T.ArrayType(T.StringType())),
    T.StructField("threadName", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.LongType()),
        T.StructField("senderName", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("reactions", T.ArrayType(T.StructType([
            T.StructField("reaction", T.StringType()), T.StructField("actor", T.StringType())]))),
    ]))),
])
MESSENGER_TEXT_TYPES = ["text", "link", "placeholder"]
MESSENGER_SKIP_TYPES = ["media"]


def read_messenger(spark: SparkSession, path: str, glob: str = "*.json", owner_id: str | None = "me") -> DataFrame:
    """One row per Messenger thread file (explicit schema, no inference); ``owner_id`` as in ``read_text_lines``."""
    with _few_listing_tasks(spark):
        threads = spark.read.schema(MESSENGER_SCHEMA).option("multiLine", "true") \
            .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    return (threads.withColumn("file_path", F.col("_metadata.file_path"))
            .withColumn("owner_id", _owner_of(F.col("file_path"), path, owner_id))
            .withColumn("thread_id", _thread_of(F.col("file_path"), path)))


def messenger_messages(threads: DataFrame, me: str, owner_id: str = "me") -> DataFrame:
    """One-to-one threads with the owner as ``messages`` rows.

    Threads with more than two participants or without ``me`` are skipped;
    ``me`` becomes ``Me``; text, link and placeholder messages are kept,
    media dropped, any other type raises.  Threads are keyed by file, so
    equal thread names never overwrite each other.  Timestamps are cut to
    whole seconds; reactions are kept as text lines in ``reactions``.
    """
    t = threads.filter((F.size("participants") <= 2) & F.array_contains("participants", me))
    owner = F.col("owner_id") if "owner_id" in threads.columns else F.lit(owner_id)
    m = t.select(owner.alias("owner_id"), "thread_id", F.posexplode("messages").alias("pos", "msg"))
    m = m.filter(~F.col("msg.type").isin(MESSENGER_SKIP_TYPES))
    checked = F.when(F.col("msg.type").isin(MESSENGER_TEXT_TYPES), F.col("msg.text")).otherwise(
        F.raise_error(F.concat(F.lit("Unknown message type: "), F.col("msg.type"))))
    reactions = F.array_join(F.transform(F.coalesce(F.col("msg.reactions"), F.array()),
                                         lambda r: F.concat(r["reaction"], F.lit(" by "), r["actor"])), "\n")
    return m.select(
        "owner_id", "thread_id", F.col("pos").cast("long").alias("seq"),
        F.date_trunc("second", F.timestamp_millis(F.col("msg.timestamp"))).alias("ts"),
        F.when(F.col("msg.senderName") == me, F.lit("Me")).otherwise(F.col("msg.senderName")).alias("speaker"),
        checked.alias("content"), F.lit(False).alias("is_reply"),
        F.lit(None).cast("string").alias("reply_info"), F.lit("messenger").alias("source"),
        F.when(F.size(F.coalesce(F.col("msg.reactions"), F.array())) > 0, reactions).alias("reactions"))


def participant_frequency(threads: DataFrame) -> DataFrame:
    """How many threads each participant is in; ``rank`` 1 is the least frequent, ties by name."""
    n = threads.select(F.explode("participants").alias("participant")).groupBy("participant").agg(F.count(F.lit(1)).alias("n_threads"))
    # Dense numbers in the order of (count, name), counted per count, so that no task ranks all names.
    return dense_numbers(n.withColumn("_all", F.lit(0)), ["_all"], "n_threads", ["participant"], "rank") \
        .select("participant", "n_threads", F.col("rank").cast("long"))


def require_participant(threads: DataFrame, me: str) -> None:
    """An error that names some participants, the least frequent first, if ``me`` is in no thread."""
    if threads.filter(F.array_contains("participants", me)).limit(1).count() == 0:
        known = [r.participant for r in participant_frequency(threads).orderBy("n_threads", "participant").limit(100).collect()]
        raise ValueError(f"{me!r} is in no thread; participants: {', '.join(known)}")


# --------------------------------------------------------------------------
# Discord (S03, N08)
# --------------------------------------------------------------------------

DISCORD_SCHEMA = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("author", T.StructType([T.StructField("global_name", T.StringType()),
                                          T.StructField("username", T.StringType())])),
])


def read_discord(spark: SparkSession, path: str, glob: str = "*_page_*.json", owner_id: str | None = "me") -> DataFrame:
    """Every ``*_page_*.json`` page; the pages of a folder form one thread; ``owner_id`` as in ``read_text_lines``."""
    with _few_listing_tasks(spark):
        pages = spark.read.schema(DISCORD_SCHEMA).option("multiLine", "true") \
            .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    return (pages.withColumn("file_path", F.col("_metadata.file_path"))
            .withColumn("owner_id", _owner_of(F.col("file_path"), path, owner_id))
            .withColumn("_mid", F.monotonically_increasing_id()))


def discord_messages(pages: DataFrame, owner_id: str = "me") -> DataFrame:
    """Non-blank ``type == 0`` messages ordered by their raw timestamp text."""
    d = pages.filter((py_strip(F.coalesce(F.col("content"), F.lit(""))) != "") & (F.col("type") == 0))
    d = d.withColumn("thread_id", _parent_dir(F.col("file_path")))
    if "owner_id" not in d.columns:
        d = d.withColumn("owner_id", F.lit(owner_id))
    # Order = raw timestamp text; numbered in chunks of its date prefix (a
    # prefix of the sort key keeps the order), so a busy channel is not one task.
    d = dense_numbers(d.withColumn("_day", F.substring("timestamp", 1, 10)), ["owner_id", "thread_id"], "_day",
                      ["timestamp", "file_path", "_mid"], "seq")
    speaker = F.when(F.coalesce(F.col("author.global_name"), F.lit("")) != "", F.col("author.global_name")) \
        .otherwise(F.col("author.username"))
    return d.select(
        "owner_id", "thread_id", F.col("seq").cast("long"),
        F.to_timestamp(F.col("timestamp")).alias("ts"), speaker.alias("speaker"),
        py_strip(F.col("content")).alias("content"), F.lit(False).alias("is_reply"),
        F.lit(None).cast("string").alias("reply_info"), F.lit("discord").alias("source"))


# --------------------------------------------------------------------------
# Contacts (S04, S05, N09)
# --------------------------------------------------------------------------

def vcard_contacts(lines: DataFrame, any_item_tel: bool = True) -> DataFrame:
    """``(owner_id, phone_norm, name)`` from vCard lines.

    ``FN:`` names carry forward to later ``TEL`` lines of the same card (a
    card ends at ``END:VCARD``); numbers keep their digits and need at least
    10; a number seen twice keeps the last name.  ``any_item_tel`` accepts
    ``itemN.TEL`` (otherwise only ``item1.TEL``).
    """
    key = ["owner_id", "thread_id"]
    v = lines.select(*key, "line_no", py_strip(F.col("value")).alias("v"),
                     F.floor(F.col("line_no") / LINE_BUCKET).alias("_lb"))
    v = v.withColumn("_end", (F.col("v") == "END:VCARD").cast("long"))
    # Card number = END lines before the line: running count inside the line
    # bucket plus the counts of earlier buckets (small table).
    wb = W.partitionBy(*key, "_lb").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    v = v.withColumn("_local", F.coalesce(F.sum("_end").over(wb), F.lit(0)))
    tot = v.groupBy(*key, "_lb").agg(F.sum("_end").alias("_bn"))
    wt = W.partitionBy(*key).orderBy("_lb").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.withColumn("_carry", F.coalesce(F.sum("_bn").over(wt), F.lit(0))).drop("_bn")
    v = v.join(tot, [*key, "_lb"]).withColumn("_card", F.col("_carry") + F.col("_local"))
    v = v.withColumn("_fn", F.when(F.col("v").startswith("FN:"), py_strip(F.expr("substring(v, 4)"))))
    wc = W.partitionBy("owner_id", "thread_id", "_card").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    v = v.withColumn("name", F.last("_fn", ignorenulls=True).over(wc))
    tel = F.col("v").rlike(r"^(item[0-9]+\.)?TEL" if any_item_tel else r"^(item1\.)?TEL")
    c = v.filter(tel & ~F.col("v").startswith("FN:")).withColumn(
        "phone_norm", F.regexp_replace(py_strip(F.element_at(F.split("v", ":"), -1)), "[^0-9]", ""))
    c = c.filter((F.coalesce(F.col("name"), F.lit("")) != "") & (F.length("phone_norm") >= 10))
    wl = W.partitionBy("owner_id", "phone_norm").orderBy(F.col("thread_id").desc(), F.col("line_no").desc())
    return c.withColumn("_r", F.row_number().over(wl)).filter("_r = 1").select("owner_id", "phone_norm", "name")


def read_contacts_json(spark: SparkSession, path: str, owner_id: str | None = "me") -> DataFrame:
    """Contact dictionaries ``{phone: name}`` -> contacts rows; ``owner_id`` as in ``read_text_lines``.  A corrupt file raises an error."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True) \
        .select("value", _owner_of(F.col("_metadata.file_path"), path, owner_id).alias("owner_id"))
    return raw.select("owner_id", F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("phone", "name"))


def write_contacts_json(contacts: DataFrame, path: str) -> None:
    """One JSON object per owner ``{phone: name}`` (JSON lines)."""
    contacts.groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("phone_norm", "name")))
                                     .alias("contacts")).write.mode("overwrite").json(path)


# --------------------------------------------------------------------------
# Metadata (S12), pasted transcripts (S16, N16), memory bank
# --------------------------------------------------------------------------

def parse_metadata(texts: DataFrame) -> DataFrame:
    """``name: description`` entries separated by ``---``.

    ``texts``: ``(owner_id, value)``.  Entries without a colon, or with an
    empty name or description, are skipped; only the first colon splits.
    """
    e = texts.select("owner_id", F.explode(F.split("value", "---")).alias("entry")) \
        .select("owner_id", py_strip(F.col("entry")).alias("e"))
    e = e.filter((F.col("e") != "") & F.col("e").contains(":"))
    parts = F.split("e", ":", 2)
    return e.select("owner_id", py_strip(parts[0]).alias("name"), py_strip(parts[1]).alias("description")) \
        .filter((F.col("name") != "") & (F.col("description") != ""))


def read_metadata(spark: SparkSession, path: str, owner_id: str | None = "me") -> DataFrame:
    """Read metadata text files (one owner per file); ``owner_id`` as in ``read_text_lines``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True) \
        .select(_owner_of(F.col("_metadata.file_path"), path, owner_id).alias("owner_id"), "value")
    return parse_metadata(raw)


def split_transcripts(transcripts: DataFrame, admin_name: str) -> DataFrame:
    """Pasted ``<|>``-separated transcripts -> header fields and messages.

    ``transcripts``: ``(transcript_id, text)``.  The conversation begins with
    the first part that holds both brackets.  Parts before it that hold ``:``
    are header fields (``key: value``).  From there on, every part that holds
    ``: `` is a message; the admin's name before it becomes ``Me``, ``key`` is
    the speaker without the bracketed time.  Other parts are skipped.  A text
    without brackets is header and conversation at once, so a part may give a
    row of each kind.  ``line`` is the row as the prompt shows it.
    """
    p = transcripts.select("transcript_id", F.split("text", r"<\|>").alias("parts"))
    first = F.array_position(F.transform("parts", lambda x: x.contains("[") & x.contains("]")), True) - 1
    p = p.withColumn("_first", first).select("transcript_id", "_first", F.posexplode("parts").alias("pos", "part"))
    bracketed = F.col("_first") >= 0
    hdr = p.filter((~bracketed | (F.col("pos") < F.col("_first"))) & F.col("part").contains(":")) \
        .select("transcript_id", "pos", F.lit("header").alias("kind"), py_strip(F.substring_index("part", ":", 1)).alias("key"),
                py_strip(F.expr("substring(part, instr(part, ':') + 1)")).alias("value"), py_strip(F.col("part")).alias("line"))
    said = p.filter((~bracketed | (F.col("pos") >= F.col("_first"))) & F.col("part").contains(": "))
    head = F.substring_index("part", ": ", 1)
    head = F.replace(head, F.lit(admin_name), F.lit("Me")) if admin_name else head
    said = said.withColumn("head", head).withColumn("value", py_strip(F.expr("substring(part, instr(part, ': ') + 2)")))
    msgs = said.select("transcript_id", "pos", F.lit("message").alias("kind"),
                       py_strip(F.regexp_replace("head", r"^\s*\[[^\]]*\]", "")).alias("key"), "value", F.concat("head", F.lit(": "), "value").alias("line"))
    return hdr.unionByName(msgs)


# Texts around a pasted topic and conversation.
TOPIC_MESSAGE = ("Here is a conversation topic that you can begin conversation about with people. Make sure to respond to current "
                 "conversation, and only use this as a guideline if there hasn't been any conversation yets. [BEGIN TOPIC METADATA]\n"
                 "{metadata}\n[END TOPIC METADATA].")
CURRENT_MESSAGE = "Current conversation:\n{conversation}\n[{now}] Me: "


def transcript_messages(transcripts: DataFrame, admin_name: str, now: str) -> DataFrame:
    """``(transcript_id, system_message, user_message)`` of each transcript; ``now`` stamps the reply that is asked for."""
    rows = split_transcripts(transcripts, admin_name)

    def joined(kind: str) -> Column:
        own = F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "line")))
        return F.array_join(F.transform(F.array_sort(own), lambda x: x["line"]), "\n")

    text = transcripts.select("transcript_id").join(rows.groupBy("transcript_id").agg(joined("header").alias("h"), joined("message").alias("c")), "transcript_id", "left")

    def around(template: str, field: str, column: str) -> Column:
        before, after = template.replace("{now}", now).split("{" + field + "}")
        return F.concat(F.lit(before), F.coalesce(F.col(column), F.lit("")), F.lit(after))

    return text.select("transcript_id", around(TOPIC_MESSAGE, "metadata", "h").alias("system_message"), around(CURRENT_MESSAGE, "conversation", "c").alias("user_message"))


#: Entries differ in their keys, also by case only, so they are read as maps; nested values are JSON text.
MEMORY_ENTRIES = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
MEMORY_BANK_SCHEMA = T.StructType([T.StructField(name, MEMORY_ENTRIES) for name in (
    "original_attributes", "combined_attributes", "inferred_attributes", "top_memories")])


def read_memory_bank(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Memory banks with an explicit schema (one row per bank); see ``normalize_bank``.

    One bank a file, whose owner is the file's name, or with ``lines`` one bank a line that names its
    ``owner_id``.  A corrupt bank raises an error.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if lines:
        return reader.schema(T.StructType([T.StructField("owner_id", T.StringType()), *MEMORY_BANK_SCHEMA.fields])).json(path)
    return reader.schema(MEMORY_BANK_SCHEMA).option("multiLine", "true").json(path) \
        .withColumn("owner_id", _file_stem(F.col("_metadata.file_path")))


def write_memory_bank(entries: DataFrame, path: str) -> None:
    """One JSON line per owner with the four lists of a bank.

    ``entries``: ``(owner_id, kind, pos, entry)``, kind original, combined, inferred or top, entry a JSON object.
    """
    lists = ["original_attributes", "combined_attributes", "inferred_attributes", "top_memories"]
    of = lambda kind: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("pos", "entry")))), lambda x: x["entry"]), ","), F.lit("]"))
    name = F.regexp_extract(F.to_json(F.struct("owner_id")), r"(?s)^\{(.*)\}$", 1)
    body = [F.concat(F.lit(f', "{column}": '), of(kind)) for column, kind in zip(lists, ["original", "combined", "inferred", "top"])]
    rows = entries.groupBy("owner_id").agg(*[b.alias(c) for b, c in zip(body, lists)])
    rows.select(F.concat(F.lit("{"), name, *lists, F.lit("}")).alias("value")).write.mode("overwrite").text(path)


