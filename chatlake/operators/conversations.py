"""Conversation construction: sessionise, merge turns, stores.

Sessionising and turn merging are ordered scans over each thread.  A thread
may be huge (one chat can hold a large share of all messages), so the scan is
two-level: rows are cut into ``seq`` buckets, each bucket is scanned with a
window partitioned by ``(owner, thread, bucket)``, and only one summary row
per bucket crosses buckets.  No task ever holds a whole thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from chatlake.functions.text import MSG_DELIM, STORE_BANNED_WORDS, contains_any_ci, py_strip
from chatlake.operators.deal import staged
from chatlake.operators.substring import substring_join

THREAD = ["owner_id", "thread_id"]
CONV = ["owner_id", "thread_id", "conv_no"]
DEFAULT_BUCKET = 1 << 20  # seq values per scan bucket


def _gap_us(hours: float) -> int:
    return int(round(hours * 3600 * 1_000_000))


def _over_gap(ts: Column, prev: Column, gap_us: int) -> Column:
    return F.coalesce((F.unix_micros(ts) - F.unix_micros(prev)) > F.lit(gap_us), F.lit(False))


def scan_threads(msgs: DataFrame, max_gap_hours: float = 6.0,
                 bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """C01 + island numbering in one pass.

    Adds ``conv_no`` (0-based per thread; a new conversation starts when the
    gap to the previous kept message is strictly above ``max_gap_hours``, in
    ``seq`` order, so negative gaps never split) and ``turn_idx`` (0-based
    run of one speaker inside the conversation), plus ``_bucket``.
    """
    gap = _gap_us(max_gap_hours)
    m = msgs.withColumn("_bucket", F.floor(F.col("seq") / F.lit(bucket_size)))
    keys = THREAD + ["_bucket"]
    wl = W.partitionBy(*keys).orderBy("seq")
    run = wl.rowsBetween(W.unboundedPreceding, W.currentRow)

    m = m.select("*", F.lag("seq").over(wl).isNull().alias("_lfirst"),
                 F.lead("seq").over(wl).isNull().alias("_llast"),
                 F.lag("ts").over(wl).alias("_pts"), F.lag("speaker").over(wl).alias("_pspk"))
    m = m.withColumn("_cf", ~F.col("_lfirst") & _over_gap(F.col("ts"), F.col("_pts"), gap)) \
        .withColumn("_if", F.col("_cf") | (~F.col("_lfirst") & ~F.col("_pspk").eqNullSafe(F.col("speaker"))))
    m = m.select("*", F.sum(F.col("_cf").cast("long")).over(run).alias("_cc"),
                 F.sum(F.col("_if").cast("long")).over(run).alias("_ic"))
    m = m.withColumn("_lcs", F.max(F.when(F.col("_cf"), F.col("_ic"))).over(run)).drop("_pts", "_pspk")

    # One summary row per bucket, read off the bucket's first and last rows
    # (filters on the scan output: no aggregation, no shuffle).
    first = m.filter("_lfirst").select(*keys, F.col("ts").alias("first_ts"), F.col("speaker").alias("first_spk"))
    last = m.filter("_llast").select(*keys, F.col("ts").alias("last_ts"), F.col("speaker").alias("last_spk"),
                                     F.col("_cc").alias("n_cf"), F.col("_ic").alias("n_if"),
                                     F.col("_lcs").alias("last_cs"))
    s = first.join(last, keys)
    ws = W.partitionBy(*THREAD).orderBy("_bucket")
    before = ws.rowsBetween(W.unboundedPreceding, -1)
    has_prev = F.lag("_bucket").over(ws).isNotNull()
    s = (s.withColumn("f_cf", ~has_prev | _over_gap(F.col("first_ts"), F.lag("last_ts").over(ws), gap))
          .withColumn("f_if", F.col("f_cf") | ~F.lag("last_spk").over(ws).eqNullSafe(F.col("first_spk"))))
    s = (s.withColumn("b_c", F.col("n_cf") + F.col("f_cf").cast("long"))
          .withColumn("b_i", F.col("n_if") + F.col("f_if").cast("long")))
    s = (s.withColumn("c_base", F.coalesce(F.sum("b_c").over(before), F.lit(0)))
          .withColumn("i_base", F.coalesce(F.sum("b_i").over(before), F.lit(0))))
    # Global island counter of the last conversation start inside the bucket.
    s = s.withColumn(
        "b_cs",
        F.when(F.col("last_cs").isNotNull(), F.col("i_base") + F.col("f_if").cast("long") + F.col("last_cs"))
         .when(F.col("f_cf"), F.col("i_base") + 1),
    )
    s = s.withColumn("carry_cs", F.max("b_cs").over(before))
    s = s.select(*keys, "f_cf", "f_if", "c_base", "i_base", "carry_cs")

    j = m.join(s, keys, "inner")
    g_isl = F.col("i_base") + F.col("f_if").cast("long") + F.col("_ic")
    g_conv = F.col("c_base") + F.col("f_cf").cast("long") + F.col("_cc")
    g_cs = F.coalesce(
        F.when(F.col("_lcs").isNotNull(), F.col("i_base") + F.col("f_if").cast("long") + F.col("_lcs")),
        F.when(F.col("f_cf"), F.col("i_base") + 1),
        F.col("carry_cs"),
    )
    return (j.withColumn("conv_no", (g_conv - 1).cast("int"))
             .withColumn("turn_idx", (g_isl - g_cs).cast("int"))
             .drop("_lfirst", "_llast", "_cf", "_if", "_cc", "_ic", "_lcs", "f_cf", "f_if", "c_base", "i_base",
                   "carry_cs"))


def sessionize(msgs: DataFrame, max_gap_hours: float = 6.0,
               bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """Messages with their 0-based conversation number per thread."""
    return scan_threads(msgs, max_gap_hours, bucket_size).drop("_bucket", "turn_idx")


def _ordered_join(items: Column, delim: str) -> Column:
    """Join ``content`` of an array of (order key, content) structs in key order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["c"]), delim)


def merge_turns(msgs: DataFrame, max_gap_hours: float = 6.0, turn_ts: str = "last",
                delimiter: str = MSG_DELIM, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """Sessionise, then merge consecutive messages of one speaker.

    ``turn_ts='last'``: timestamp of the last message, ``is_reply`` if any
    message replies, ``reply_info`` of the last replying message (C02).
    ``turn_ts='first'``: timestamp and reply fields of the first message (C02b).
    The merge is pre-aggregated inside each scan bucket (no shuffle: the scan
    is already partitioned by bucket), then the few pieces of a turn that
    span buckets are merged after one shuffle.
    """
    first = turn_ts == "first"
    s = scan_threads(msgs, max_gap_hours, bucket_size)
    part_keys = CONV + ["turn_idx", "_bucket"]
    pick = F.min_by if first else F.max_by
    p = s.groupBy(*part_keys).agg(
        _ordered_join(F.collect_list(F.struct(F.col("seq").alias("k"), F.col("content").alias("c"))), delimiter).alias("c"),
        F.min("seq").alias("k"),
        pick("ts", "seq").alias("ts"),
        F.first("speaker").alias("speaker"),
        (F.min_by("is_reply", "seq") if first else F.bool_or("is_reply")).alias("is_reply"),
        (F.min_by("reply_info", "seq") if first
         else F.max_by("reply_info", F.when(F.col("is_reply"), F.col("seq")))).alias("reply_info"),
        F.max(F.when(F.col("is_reply"), F.col("seq"))).alias("rk"),
        F.count(F.lit(1)).alias("n_msgs"),
    )
    t = p.groupBy(*CONV, "turn_idx").agg(
        _ordered_join(F.collect_list(F.struct("k", "c")), delimiter).alias("content"),
        (F.min_by("ts", "k") if first else F.max_by("ts", "k")).alias("ts"),
        F.first("speaker").alias("speaker"),
        (F.min_by("is_reply", "k") if first else F.bool_or("is_reply")).alias("is_reply"),
        (F.min_by("reply_info", "k") if first else F.max_by("reply_info", "rk")).alias("reply_info"),
        F.sum("n_msgs").cast("int").alias("n_msgs"),
    )
    return t.select("owner_id", "thread_id", "conv_no", "turn_idx", "ts", "speaker", "content",
                    "is_reply", "reply_info", "n_msgs")


def conversation_summary(turns: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """``convs`` table: one row per conversation (partial aggregation)."""
    banned = STORE_BANNED_WORDS if banned is None else banned
    return turns.groupBy(*CONV).agg(
        F.count(F.lit(1)).cast("int").alias("n_turns"),
        F.max_by("ts", "turn_idx").alias("last_ts"),
        F.count_distinct("speaker").cast("int").alias("n_speakers"),
        F.bool_or(F.col("speaker") == "Me").alias("has_me"),
        F.bool_or(contains_any_ci(F.col("content"), banned)).alias("has_banned"),
    )


# Fixed values: (conversations, least turns, most turns) of the stores that the pipeline and the notebooks make.
STORE_PRESETS = {"retrieval": (1000, 15, 75), "memory": (8000, 5, 500), "notebook_retrieval": (500, 15, 75), "notebook_memory": (6000, 5, 300)}


def conversation_store(turns: DataFrame, num: int | None = 1000, min_turns: int | None = 15,
                       max_turns: int | None = 75, banned: list[str] | None = None) -> DataFrame:
    """Newest conversations within turn bounds and without banned words.

    Returns one row per kept conversation with its ``store_rank`` (1 = most
    recent last turn).  ``row_number() <= num`` per owner is planned as a
    per-partition limit before the shuffle, so only ``num`` rows per task move.
    """
    c = conversation_summary(turns, banned)
    cond = ~F.col("has_banned")
    if min_turns is not None:
        cond = cond & (F.col("n_turns") >= min_turns)
    if max_turns is not None:
        cond = cond & (F.col("n_turns") <= max_turns)
    c = c.filter(cond)
    w = W.partitionBy("owner_id").orderBy(F.col("last_ts").desc_nulls_last(), "thread_id", "conv_no")
    c = c.withColumn("store_rank", F.row_number().over(w))
    if num is not None:
        c = c.filter(F.col("store_rank") <= num)
    return c


def store_turns(turns: DataFrame, store: DataFrame) -> DataFrame:
    """Turns of the conversations kept by :func:`conversation_store`."""
    return turns.join(store.select(*CONV, "store_rank"), CONV, "inner")


def partner_index(turns: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One-to-one conversations (two speakers, one is ``Me``) by partner key.

    The key is the partner's name, lower-cased and stripped; conversations of a partner with an empty
    name are left out.  With ``store`` (see :func:`conversation_store`) only its conversations count,
    and their ``store_rank`` comes along.
    """
    order = []
    if store is not None:
        turns, order = store_turns(turns, store), [F.min("store_rank").alias("store_rank")]
    c = turns.groupBy(*CONV).agg(F.collect_set("speaker").alias("spk"), *order)
    c = c.filter((F.size("spk") == 2) & F.array_contains("spk", "Me"))
    partner = F.element_at(F.array_except("spk", F.array(F.lit("Me"))), 1)
    return c.withColumn("partner", partner).filter(F.col("partner") != "") \
        .select(*CONV, py_strip(F.lower("partner")).alias("partner_key"), *(["store_rank"] if order else []))


def _draw(seed: int, of: Column, n: Column) -> Column:
    """A number below ``n`` that (seed, of) gives: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), of.cast("string"))), 1, 8), 16, 10).cast("long") % n


def partner_lookup(index: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """Pick one conversation per query name, repeatably.

    ``index`` is a :func:`partner_index` of a store; ``names`` has ``(owner_id, query_id, name)``.  The
    name is lower-cased and stripped; the first partner in store order whose key contains it wins (so a
    blank name takes the first partner of all), and one of that partner's conversations is drawn.  A name
    that no key contains, or a null one, draws a partner uniformly, then one of its conversations.  Draws
    are ranks from a seeded hash, fetched by equi-joins; ranks count inside one owner's store, whose size
    is a parameter.  An owner without one-to-one conversations gives no row.
    """
    key = ["owner_id", "partner_key"]
    by_rank = W.partitionBy("owner_id").orderBy("first_rank")
    partners = index.groupBy(*key).agg(F.min("store_rank").alias("first_rank"), F.count("*").alias("n_conv")) \
        .withColumn("pidx", F.row_number().over(by_rank) - 1)
    partners = staged(partners)
    n_part = partners.groupBy("owner_id").agg(F.count("*").alias("n_part"))
    q = names.select("owner_id", "query_id", py_strip(F.lower("name")).alias("name"))
    found = substring_join(partners, q.select("owner_id", "query_id", F.col("name").alias("_name")), "partner_key", "_name", on=["owner_id"]) \
        .groupBy("owner_id", "query_id").agg(F.min("pidx").alias("hit"))
    pidx = F.when(F.col("name") == "", F.lit(0)).otherwise(F.col("hit"))
    chosen = q.join(n_part, "owner_id").join(found, ["owner_id", "query_id"], "left").select(
        "owner_id", "query_id", F.coalesce(pidx, _draw(seed, F.col("query_id"), F.col("n_part"))).alias("pidx"),
        pidx.isNotNull().alias("matched")).join(partners, ["owner_id", "pidx"])
    ranked = index.withColumn("cidx", F.row_number().over(W.partitionBy(*key).orderBy("store_rank")) - 1)
    pick = chosen.withColumn("cidx", _draw(seed + 1, F.col("query_id"), F.col("n_conv")))
    return pick.join(ranked, [*key, "cidx"]).select("owner_id", "query_id", "partner_key", "matched", "thread_id", "conv_no", "store_rank")


def render_lines(turns: DataFrame) -> Column:
    """``[ts] speaker: content`` (C06 line form)."""
    return F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
                    F.col("speaker"), F.lit(": "), F.col("content"))


def render_transcripts(turns: DataFrame, style: str = "plain") -> DataFrame:
    """One transcript per conversation, lines in turn order.

    ``style='plain'`` gives ``ts speaker: content`` lines (example store view);
    ``style='bracket'`` gives ``[ts] speaker: content`` (prompt view).
    """
    if style == "bracket":
        line = render_lines(turns)
    else:
        line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                           F.concat(F.col("speaker"), F.lit(": "), F.col("content")))
    t = turns.select(*CONV, "turn_idx", line.alias("line"))
    return t.groupBy(*CONV).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "line"))),
                                 lambda x: x["line"]), "\n").alias("transcript"),
        F.count(F.lit(1)).cast("int").alias("n_turns"),
    )


def unmerge_turns(turns: DataFrame, delimiter: str = MSG_DELIM) -> DataFrame:
    """Split merged turns back into trimmed messages."""
    pat = "".join("\\" + ch if ch in "\\.^$|?*+()[]{}" else ch for ch in delimiter)
    return (turns.select(*CONV, "turn_idx", "speaker",
                         F.posexplode(F.split("content", pat, -1)).alias("part_idx", "message"))
            .withColumn("message", py_strip(F.col("message"))))
