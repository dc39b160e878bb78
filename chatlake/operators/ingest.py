"""Normalisation and contact resolution (N10-N18) on line and message tables.

Nothing here modifies a source: filters return the kept rows (or a status
per thread), and contact resolution returns rewritten text as a new column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from chatlake.functions.text import py_strip
from chatlake.operators.deal import SENT_ROWS, join_dealt, staged
from chatlake.sources.exports import EXPORT_TS_RE, LINE_BUCKET, _next_lines, dense_numbers

# Phone patterns of the pipeline ([0-9] where Python had \d).
CONTACT_PHONE_RE = r"(?:\+1|1)?[2-9][0-9]{9}"
UNMATCHED_PHONE_RE = r"^(?:\+[0-9]{1,2})?[2-9][0-9]{9}"
CENSUS_PHONE_RE = r"^(?:(?:\+1)?[2-9][0-9]{9}|\+[0-9]{11})"
THREAD_COUNT_TS_RE = r"[A-Za-z0-9_]{3}\s+[0-9]{1,2},\s+[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s+[AP]M"
UNMATCHED_MIN_COUNT = 50
THREAD_MIN_MESSAGES = 20


def phone_basic(c: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(c, "[^0-9]", "")


def phone_advanced(c: Column) -> Column:
    """Digits only, leading ``1`` of an 11-digit number removed."""
    d = phone_basic(c)
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def normalize_contacts(contacts: DataFrame, order: str | None = None) -> DataFrame:
    """Contact dictionary keyed by the advanced form.

    Of several entries of one number the last in column ``order`` wins; without one, and among equals,
    the one whose written number, then name, is greatest.
    """
    c = contacts.select("owner_id", phone_advanced(F.col("phone")).alias("phone_norm"), "name",
                        F.struct((F.col(order) if order else F.lit(0)).alias("o"), "phone", "name").alias("_o"))
    return c.groupBy("owner_id", "phone_norm").agg(F.max_by("name", "_o").alias("name"))


def resolve_phones(texts: DataFrame, contacts: DataFrame, key_cols: list[str], text_col: str = "text",
                   pattern: str = CONTACT_PHONE_RE) -> DataFrame:
    """Replace every phone number in the text by the contact's name.

    Numbers are found with the unanchored pattern, normalised (N11) and
    looked up; unknown numbers stay as they are.  Extract -> join -> rebuild:
    the text is cut into the pieces between matches, the matches are joined
    to ``contacts`` (``owner_id, phone_norm, name``; an ordinary join, so the
    contact table may be of any size) and the pieces are zipped back.
    Texts without a number skip the join entirely.
    """
    t = texts.withColumn("_m", F.regexp_extract_all(F.col(text_col), F.lit(f"({pattern})"), 1))
    plain = t.filter(F.size("_m") == 0).withColumn("resolved", F.col(text_col)).drop("_m")
    hit = t.filter(F.size("_m") > 0)
    ex = hit.select(*key_cols, "owner_id", F.posexplode("_m").alias("_i", "_raw")) \
        .withColumn("phone_norm", phone_advanced(F.col("_raw")))
    ex = ex.join(contacts.select("owner_id", "phone_norm", "name"), ["owner_id", "phone_norm"], "left") \
        .withColumn("_rep", F.coalesce("name", "_raw"))
    reps = ex.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_rep"))), lambda x: x["_rep"]).alias("_reps"))
    j = hit.join(reps, key_cols, "left").withColumn("_pieces", F.split(F.col(text_col), pattern, -1))
    rebuilt = F.concat(
        F.array_join(F.zip_with("_pieces", F.concat("_reps", F.array(F.lit(""))),
                                lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), ""))
    resolved = j.withColumn("resolved", rebuilt).drop("_m", "_reps", "_pieces")
    return plain.unionByName(resolved)


def unmatched_numbers(lines: DataFrame, min_count: int = UNMATCHED_MIN_COUNT) -> DataFrame:
    """Sender lines (after a timestamp line) that still start with a number.

    Counts the whole stripped sender line, keeps those seen ``min_count``
    times or more; most frequent first when ordered by ``n desc``.
    """
    s = lines.select("owner_id", "thread_id", "line_no", py_strip(F.col("value")).alias("v"))
    s = _next_lines(s, ["owner_id", "thread_id"], 1).withColumnRenamed("_next1", "_next") \
        .filter(F.col("v").rlike("^" + EXPORT_TS_RE) & F.col("_next").rlike(UNMATCHED_PHONE_RE))
    return s.groupBy("owner_id", F.col("_next").alias("phone")).agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") >= min_count)


def thread_quality(lines: DataFrame, min_messages: int = THREAD_MIN_MESSAGES) -> DataFrame:
    """Per thread, message count, ``Me`` presence and the keep decision.

    The count is the number of non-blank pieces of the file between
    timestamp matches (the text before the first one counts when not
    blank); ``has_me`` is a line that is exactly ``Me`` and is not the
    file's last line.  A thread is kept when it has more than
    ``min_messages`` messages and ``has_me``.
    """
    key = ["owner_id", "thread_id"]
    lv = lines.select(*key, "line_no", "value", F.regexp_count("value", F.lit(THREAD_COUNT_TS_RE)).alias("_k"),
                      F.floor(F.col("line_no") / LINE_BUCKET).alias("_lb"))
    # Matches before each line: running sum inside the line bucket plus the
    # totals of earlier buckets (small table), never a whole-file window.
    wb = W.partitionBy(*key, "_lb").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    lv = lv.withColumn("_local", F.coalesce(F.sum("_k").over(wb), F.lit(0)))
    tot = lv.groupBy(*key, "_lb").agg(F.sum("_k").alias("_bk"))
    wt = W.partitionBy(*key).orderBy("_lb").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.withColumn("_carry", F.coalesce(F.sum("_bk").over(wt), F.lit(0))).drop("_bk")
    lv = lv.join(tot, [*key, "_lb"]).withColumn("_before", F.col("_carry") + F.col("_local"))
    seg = lv.select(*key, "_before", F.posexplode(F.split("value", THREAD_COUNT_TS_RE, -1)).alias("_j", "_s"))
    seg = seg.withColumn("_piece", F.col("_before") + F.col("_j"))
    pieces = seg.filter(py_strip(F.col("_s")) != "").groupBy(*key).agg(F.count_distinct("_piece").alias("n_messages"))
    last = lines.groupBy(*key).agg(F.max("line_no").alias("_maxl"))
    me_lines = lines.filter(F.col("value") == "Me").select(*key, "line_no")
    me = last.join(me_lines, key, "left").groupBy(*key).agg(
        F.coalesce(F.bool_or(F.col("line_no") < F.col("_maxl")), F.lit(False)).alias("has_me"))
    r = me.join(pieces, key, "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return r.withColumn("keep", (F.col("n_messages") > min_messages) & F.col("has_me"))


def filter_threads(lines: DataFrame, min_messages: int = THREAD_MIN_MESSAGES) -> DataFrame:
    """Lines of the kept threads (left semi join; sources untouched)."""
    keep = thread_quality(lines, min_messages).filter("keep").select("owner_id", "thread_id")
    return lines.join(keep, ["owner_id", "thread_id"], "left_semi")


def speaker_census(lines: DataFrame) -> DataFrame:
    """Distinct speakers by category (phone / name / Me).

    A file is cut at every timestamp match; the first non-blank line of each
    piece, also of the piece before the first timestamp, is a speaker, except
    ``Tapbacks:`` and ``Find My:*``.  One row per category with the count and
    the sorted names.

    A piece that begins with blank lines takes its speaker from the next line
    that has text: lines are scanned backwards inside line buckets, and each
    bucket's first text is carried to the buckets before it by a small table.
    """
    key = ["owner_id", "thread_id"]
    lv = lines.select(*key, "line_no", F.split("value", EXPORT_TS_RE, -1).alias("_s"), F.floor(F.col("line_no") / LINE_BUCKET).alias("_lb"))
    lv = lv.withColumn("_s", F.transform("_s", py_strip))
    # What an unfinished piece meets in this line: its text, or (an empty text) the end of the piece.
    met = F.when(F.col("_s")[0] != "", F.col("_s")[0]).when(F.size("_s") > 1, F.lit(""))
    lv = lv.withColumn("_met", met)
    own = W.partitionBy(*key, "_lb").orderBy("line_no")
    lv = lv.withColumn("_next", F.first("_met", ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing))) \
        .withColumn("_head", F.col("_met").isNotNull() & (F.count("_met").over(own.rowsBetween(W.unboundedPreceding, 0)) == 1))
    lv = staged(lv.filter((F.size("_s") > 1) | F.col("_head")))  # lines with a timestamp, and the first text of each bucket
    wb = W.partitionBy(*key).orderBy("_lb")
    # Every bucket with a timestamp has a head: a line with one ends a piece, or has text.
    heads = lv.filter("_head").select(*key, "_lb", "_met", F.lead("_met").over(wb).alias("_later"), F.lag("_lb").over(wb).isNull().alias("_start"))
    tail = F.col("_s")[F.size("_s") - 1]
    stamped = lv.filter(F.size("_s") > 1).join(heads.select(*key, "_lb", "_later"), [*key, "_lb"])
    opened = F.when(tail != "", tail).otherwise(F.coalesce("_next", "_later"))
    inner = F.slice("_s", 2, F.greatest(F.size("_s") - 2, F.lit(0)))
    found = stamped.select("owner_id", F.explode(F.concat(inner, F.array(opened))).alias("speaker")) \
        .unionByName(heads.filter("_start").select("owner_id", F.col("_met").alias("speaker")))
    s = found.filter(F.col("speaker").isNotNull() & (F.col("speaker") != "") & (F.col("speaker") != "Tapbacks:")
                     & ~F.col("speaker").startswith("Find My:")).distinct()
    cat = F.when(F.col("speaker").rlike(CENSUS_PHONE_RE), "phone") \
        .when(F.col("speaker") == "Me", "me").otherwise("name")
    return s.groupBy("owner_id", cat.alias("category")).agg(
        F.count(F.lit(1)).alias("n_speakers"), F.array_join(F.array_sort(F.collect_list("speaker")), ", ")
        .alias("speakers"))


def apply_corrections(contacts: DataFrame, corrections: DataFrame, overwrite: bool = False) -> DataFrame:
    """Add hand-entered names; existing numbers are kept unless ``overwrite``.

    Numbers are compared, and returned, in the advanced form on both sides.  Of several entries of one
    side the one whose written number, then name, is greatest counts; corrections with a blank name are
    skipped, as an empty answer is.
    """
    def side(df: DataFrame, phone: str, rank: int) -> DataFrame:
        return df.select("owner_id", phone_advanced(F.col(phone)).alias("phone_norm"), py_strip(F.col("name")).alias("name"),
                         F.struct(F.lit(rank).alias("r"), F.col(phone).alias("p"), "name").alias("_o"))

    fixes = side(corrections, "phone", int(overwrite)).filter(F.col("name") != "")
    both = side(contacts, "phone_norm", int(not overwrite)).unionByName(fixes)
    return both.groupBy("owner_id", "phone_norm").agg(F.max_by("name", "_o").alias("name"))


def thread_sizes(lines: DataFrame) -> DataFrame:
    """``(owner_id, thread_id, n_bytes)`` of exports as lines: UTF-8 bytes with line ends."""
    return lines.groupBy("owner_id", "thread_id").agg(F.sum(F.octet_length("value") + 1).alias("n_bytes"))


def merge_exports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Choose one export per thread from two exports.

    ``a``/``b``: ``(owner_id, thread_id, n_bytes)`` (file sizes).  A thread
    in one export only is taken from it; a common thread is taken from the
    larger file, ties going to ``b``.  Returns the decision per thread with
    a ``status`` for the merge report (A06).
    """
    x = a.select("owner_id", "thread_id", F.col("n_bytes").alias("bytes_a"))
    y = b.select("owner_id", "thread_id", F.col("n_bytes").alias("bytes_b"))
    j = x.join(y, ["owner_id", "thread_id"], "full")
    take = F.when(F.col("bytes_b").isNull(), "a").when(F.col("bytes_a").isNull(), "b") \
        .when(F.col("bytes_a") > F.col("bytes_b"), "a").otherwise("b")
    status = F.when(F.col("bytes_b").isNull(), "only_a").when(F.col("bytes_a").isNull(), "only_b") \
        .otherwise(F.concat(F.lit("common_"), take))
    return j.select("owner_id", "thread_id", "bytes_a", "bytes_b", take.alias("take"), status.alias("status"))


def merge_threads(a: DataFrame, b: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """The lines ``(owner_id, thread_id, line_no, value)`` of both exports merged, each thread from one of them.

    ``export`` says which (``a`` or ``b``).  A thread is carried over whole; the lines of a giant one
    are dealt into shares where the decisions are too many to be sent to all tasks.
    """
    keys = ["owner_id", "thread_id"]
    take = staged(merge_exports(thread_sizes(a), thread_sizes(b)).select(*keys, F.col("take").alias("export")))
    both = a.select(*keys, "line_no", "value", F.lit("a").alias("export")).unionByName(b.select(*keys, "line_no", "value", F.lit("b").alias("export")))
    return join_dealt(both, take, [*keys, "export"], "line_no", most=most).select(*keys, "line_no", "value", "export")


def export_lines(msgs: DataFrame, export_ts: Column | None = None) -> DataFrame:
    """Render ``messages`` as text-export lines (the inverse of N01).

    Each message becomes a timestamp line, a sender line, a content line,
    the reply line when it is a reply, and a blank line.  ``line_no`` is
    dense per thread in message (``seq``) order.
    """
    ts = export_ts if export_ts is not None else F.date_format("ts", "MMM d, yyyy  h:mm:ss a")
    parts = F.filter(F.array(ts, F.col("speaker"), F.col("content"),
                             F.when(F.col("is_reply"), F.lit("This message responded to an earlier message.")),
                             F.lit("")), lambda x: x.isNotNull())
    x = msgs.select("owner_id", "thread_id", F.posexplode(parts).alias("_k", "value"), "seq") \
        .withColumn("_chunk", F.floor(F.col("seq") / (1 << 16)))
    return dense_numbers(x, ["owner_id", "thread_id"], "_chunk", ["seq", "_k"], "line_no") \
        .select("owner_id", "thread_id", F.col("line_no").cast("long"), "value")
