"""Training examples: targets, quality filters, rendering.

The prompt of an example holds every earlier turn of its conversation, so
rendering all prompts first is quadratic in conversation length.  Every
input-side filter instead decomposes over turns (a banned string, a long
message or a speaker name lies inside one rendered turn line), so per-turn
features are computed once and combined with running windows; only the
examples that survive all filters are rendered, and a survivor has at most
35 timestamps in its prompt, which bounds its history.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.deal import staged
from chatlake.operators.substring import substring_join

CONV = ["owner_id", "thread_id", "conv_no"]
EX_KEY = CONV + ["turn_idx"]

# Prompt texts of the example formatter.
SYSTEM_PROMPT = ("You are a human being named {}. You are not an AI. Respond as yourself. "
                 "Now you may begin the conversation.")
METADATA_HEADER = ("Here is the information about the people (note that not everyone in the "
                   "conversation is necessarily included, only the people that are most relevant. "
                   "This is my reflections in Febuary 2024.")
PREVIOUS_HEADER = "Previous conversations:\n"
CURRENT_HEADER = "Current conversation:\n"
PRIOR_SEPARATOR = "\n---\n"

# Reject reasons in the order the filters run (first failing one is kept).
REASONS = [
    "filtered_strings", "too_short", "too_many_consecutive_msgs_input",
    "too_many_consecutive_msgs_output", "contains_url", "excessive_repetition",
    "too_many_speakers", "emoji_only", "too_many_messages", "long_messages_input",
    "long_messages_output", "too_little_messages_input",
]


@dataclass(frozen=True)
class FilterConfig:
    banned: tuple[str, ...] = tuple(tx.EXAMPLE_BANNED_STRINGS)
    min_output_words: int = 2        # reject when output words <= this
    max_delims: int = 20             # reject when a line has more delimiters
    url_patterns: tuple[str, ...] = tuple(tx.URL_PATTERNS)
    max_repeats: int = 15
    stop_words: tuple[str, ...] = field(default_factory=lambda: tuple(tx.STOP_WORDS))
    max_speakers: int = 1
    max_timestamps: int = 35
    max_words: int = 50
    min_timestamps: int = 3          # reject when prompt timestamps <= this
    enabled: tuple[str, ...] = tuple(REASONS)   # the others never reject


# Pipeline preset and the notebook preset (one banned string, > 7 stamps).
DEFAULT_FILTERS = FilterConfig()
NOTEBOOK_FILTERS = FilterConfig(banned=("GamePigeon message:",), min_timestamps=7)

# The documented dataset levels, each with the filters of the ones before it.
_LEVEL_45K = ("filtered_strings", "contains_url", "excessive_repetition")
_LEVEL_25K = _LEVEL_45K + ("too_many_speakers", "emoji_only", "too_many_messages", "long_messages_input", "long_messages_output",
                           "too_little_messages_input")
LEVELS = {
    "60k": FilterConfig(banned=("GamePigeon message:",), enabled=()),
    "45k": FilterConfig(banned=("GamePigeon message:",), enabled=_LEVEL_45K),
    "25k": FilterConfig(banned=("GamePigeon message:",), enabled=_LEVEL_25K, max_timestamps=30, min_timestamps=1),
    "15k": FilterConfig(banned=("GamePigeon message:",), enabled=_LEVEL_25K, max_timestamps=30, min_timestamps=7),
}


def eligible_targets(turns: DataFrame) -> DataFrame:
    """Owner turns that are not blank, not only a delimiter, not replies."""
    s = tx.py_strip(F.col("content"))
    return turns.filter((F.col("speaker") == "Me") & (s != "") & (s != tx.MSG_DELIM)
                        & ~F.coalesce(F.col("is_reply"), F.lit(False)))


def _line(ts: Column, speaker: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
                    speaker, F.lit(": "), content)


def turn_features(turns: DataFrame, cfg: FilterConfig = DEFAULT_FILTERS) -> DataFrame:
    """Per-turn prompt features of the rendered line ``[ts] speaker: content``."""
    line = _line(F.col("ts"), F.col("speaker"), F.col("content"))
    spk = F.filter(tx.line_speakers(line), lambda s: s != "Me")
    return turns.select(
        "*",
        tx.contains_any_ci(line, list(cfg.banned)).alias("f_ban"),
        tx.max_delims_per_line(line).alias("f_delim"),
        F.array_min(spk).alias("f_spk_lo"),
        F.array_max(spk).alias("f_spk_hi"),
        tx.count_ts_brackets(line).alias("f_ts"),
        tx.max_piece_words(line).alias("f_words"),
    )


def _prior_features(feat: DataFrame, buffer: int) -> DataFrame:
    """T02 features of the ``buffer`` conversations before each conversation.

    The last turn of a prior conversation is followed by ``---`` (and, for
    the conversation right before the target one, ``Current conversation:``);
    those words join that turn's last message piece, so both variants of the
    last turn's word feature are computed.
    """
    line = _line(F.col("ts"), F.col("speaker"), F.col("content"))
    last_idx = feat.groupBy(*CONV).agg(F.max("turn_idx").alias("_mx"))
    f = feat.join(last_idx, CONV).withColumn("_is_last", F.col("turn_idx") == F.col("_mx"))
    f = (f.withColumn("_w_mid", F.when(F.col("_is_last"), tx.max_piece_words(F.concat(line, F.lit(PRIOR_SEPARATOR))))
                      .otherwise(F.col("f_words")))
          .withColumn("_w_end", F.when(F.col("_is_last"), tx.max_piece_words(
              F.concat(line, F.lit(PRIOR_SEPARATOR + CURRENT_HEADER)))).otherwise(F.col("f_words"))))
    c = f.groupBy(*CONV).agg(
        F.bool_or("f_ban").alias("c_ban"), F.max("f_delim").alias("c_delim"),
        F.min("f_spk_lo").alias("c_spk_lo"), F.max("f_spk_hi").alias("c_spk_hi"),
        F.sum("f_ts").alias("c_ts"), F.max("_w_mid").alias("c_w_mid"), F.max("_w_end").alias("c_w_end"),
    )
    # The frames look back ``buffer`` conversations only, so conversations
    # are cut into buckets and each bucket also gets the last ``buffer``
    # conversations of the bucket before it (a halo): a thread with very
    # many conversations is still spread over many tasks.
    cb = max(CONV_BUCKET, buffer + 1)
    c = c.withColumn("_cb", F.floor(F.col("conv_no") / cb)).withColumn("_halo", F.lit(False))
    halo = c.filter(F.col("conv_no") % cb >= cb - buffer).withColumn("_cb", F.col("_cb") + 1) \
        .withColumn("_halo", F.lit(True))
    c = c.unionByName(halo)
    wt = W.partitionBy("owner_id", "thread_id", "_cb").orderBy("conv_no")
    fr = wt.rowsBetween(-buffer, -1)
    return c.select(
        *CONV, "_halo",
        F.coalesce(F.bool_or("c_ban").over(fr), F.lit(False)).alias("p_ban"),
        F.max("c_delim").over(fr).alias("p_delim"),
        F.min("c_spk_lo").over(fr).alias("p_spk_lo"),
        F.max("c_spk_hi").over(fr).alias("p_spk_hi"),
        F.coalesce(F.sum("c_ts").over(fr), F.lit(0)).alias("p_ts"),
        (F.greatest(F.max("c_w_mid").over(wt.rowsBetween(-buffer, -2)), F.lag("c_w_end").over(wt)) if buffer > 1
         else F.lag("c_w_end").over(wt)).alias("p_words"),
    ).filter(~F.col("_halo")).drop("_halo")


TURN_BUCKET = 1 << 12   # turns per bucket of the running history features
CONV_BUCKET = 1 << 12   # conversations per bucket of the prior-context features

# (history column, per-turn column, aggregate) of the running prompt features.
_HISTORY = [("h_ban", "f_ban", "bool_or"), ("h_delim", "f_delim", "max"), ("h_spk_lo", "f_spk_lo", "min"),
            ("h_spk_hi", "f_spk_hi", "max"), ("h_ts", "f_ts", "sum"), ("h_words", "f_words", "max")]


def _agg(kind: str, c: Column) -> Column:
    return {"bool_or": F.bool_or, "max": F.max, "min": F.min, "sum": F.sum}[kind](c)


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "bool_or":
        return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(a, b)


def _history_features(feat: DataFrame) -> DataFrame:
    """Running features of all earlier turns of the conversation.

    Two-level so one endless conversation is not one task: a window inside
    each ``TURN_BUCKET`` of turns, plus the prefix aggregate of the earlier
    buckets from a small per-bucket table (all five aggregates are
    associative).
    """
    f = feat.withColumn("_tb", F.floor(F.col("turn_idx") / TURN_BUCKET))
    wl = W.partitionBy(*CONV, "_tb").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, -1)
    f = f.select("*", *[_agg(k, F.col(src)).over(wl).alias(f"_l_{dst}") for dst, src, k in _HISTORY])
    per = f.groupBy(*CONV, "_tb").agg(*[_agg(k, F.col(src)).alias(f"_b_{dst}") for dst, src, k in _HISTORY])
    wb = W.partitionBy(*CONV).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*CONV, "_tb", *[_agg(k, F.col(f"_b_{dst}")).over(wb).alias(f"_c_{dst}") for dst, _, k in _HISTORY])
    f = f.join(per, [*CONV, "_tb"])
    out = [_combine(k, F.col(f"_c_{dst}"), F.col(f"_l_{dst}")).alias(dst) for dst, _, k in _HISTORY]
    drop = ["_tb"] + [f"_l_{d}" for d, _, _ in _HISTORY] + [f"_c_{d}" for d, _, _ in _HISTORY]
    return f.select("*", *out).drop(*drop)


def _history_speakers(turns: DataFrame, buffer: int, most: int) -> DataFrame:
    """Per conversation: its first ``most + 1`` speakers besides the owner with the turn of their first line, and
    those of the ``buffer`` conversations before it.  That many are enough to tell whether there are over ``most``."""
    line = _line(F.col("ts"), F.col("speaker"), F.col("content"))
    said = turns.select(*CONV, "turn_idx", F.explode(F.filter(tx.line_speakers(line), lambda s: s != "Me")).alias("who"))
    first = said.groupBy(*CONV, "who").agg(F.min("turn_idx").alias("turn"))
    few = first.withColumn("_r", F.row_number().over(W.partitionBy(*CONV).orderBy("turn", "who"))).filter(F.col("_r") <= most + 1)
    own = few.groupBy(*CONV).agg(F.array_sort(F.collect_list(F.struct("turn", "who"))).alias("_own"))
    if not buffer:
        return own.withColumn("_prior", F.lit(None).cast("array<string>"))
    # Each conversation's speakers go to the ``buffer`` conversations after it, whether these have speakers or not.
    later = few.withColumn("conv_no", F.explode(F.sequence(F.col("conv_no") + 1, F.col("conv_no") + buffer))) \
        .groupBy(*CONV).agg(F.collect_set("who").alias("_prior"))
    return own.join(later, CONV, "full")


def example_features(turns: DataFrame, buffer: int = 0,
                     cfg: FilterConfig = DEFAULT_FILTERS) -> DataFrame:
    """One row per target turn with its ``reject_reason``.

    ``reject_reason`` is NULL for examples that pass every enabled filter.
    """
    # With prior conversations four tables are made of the features: they are worked out once, as the patterns cost most.
    feat = staged(turn_features(turns, cfg)) if buffer > 0 else turn_features(turns, cfg)
    h = _history_features(feat)
    ex = eligible_targets(h)
    if buffer > 0:
        ex = ex.join(_prior_features(feat, buffer), CONV, "left")
    else:
        ex = ex.select("*", F.lit(False).alias("p_ban"), F.lit(None).cast("int").alias("p_delim"),
                       F.lit(None).cast("string").alias("p_spk_lo"), F.lit(None).cast("string").alias("p_spk_hi"),
                       F.lit(0).alias("p_ts"), F.lit(None).cast("int").alias("p_words"))

    out = F.col("content")
    n_ts = F.col("h_ts") + F.coalesce(F.col("p_ts"), F.lit(0)) + 1   # +1: the target stub
    spk_lo = F.least("h_spk_lo", "p_spk_lo")
    spk_hi = F.greatest("h_spk_hi", "p_spk_hi")
    many = F.coalesce(spk_lo != spk_hi, F.lit(False))
    if cfg.max_speakers != 1:   # the least and the greatest speaker tell one from several, not how many
        ex = ex.join(_history_speakers(turns, buffer, cfg.max_speakers), CONV, "left")
        own = F.transform(F.filter(F.col("_own"), lambda x: x["turn"] < F.col("turn_idx")), lambda x: x["who"])
        known = F.array_union(F.coalesce(own, F.array()), F.coalesce("_prior", F.array()))
        many = F.size(known) > cfg.max_speakers
    in_delim = F.coalesce(F.greatest("h_delim", "p_delim"), F.lit(0))
    in_words = F.coalesce(F.greatest("h_words", "p_words"), F.lit(0))
    checks = [
        ("filtered_strings", F.col("h_ban") | F.coalesce(F.col("p_ban"), F.lit(False))
         | tx.contains_any_ci(out, list(cfg.banned))),
        ("too_short", tx.n_words(out) <= cfg.min_output_words),
        ("too_many_consecutive_msgs_input", in_delim > cfg.max_delims),
        ("too_many_consecutive_msgs_output", tx.max_delims_per_line(out) > cfg.max_delims),
        ("contains_url", tx.contains_any_ci(out, list(cfg.url_patterns))),
        ("excessive_repetition", tx.max_word_repeat(out, list(cfg.stop_words)) > cfg.max_repeats),
        ("too_many_speakers", many),
        ("emoji_only", tx.is_emoji_only(out)),
        ("too_many_messages", n_ts > cfg.max_timestamps),
        ("long_messages_input", in_words > cfg.max_words),
        ("long_messages_output", F.coalesce(tx.max_piece_words(out), F.lit(0)) > cfg.max_words),
        ("too_little_messages_input", n_ts <= cfg.min_timestamps),
    ]
    reason = F.lit(None).cast("string")
    for name, cond in reversed(checks):
        if name in cfg.enabled:
            reason = F.when(cond, F.lit(name)).otherwise(reason)
    return ex.select(*EX_KEY, "ts", F.col("content").alias("output"), reason.alias("reject_reason"))


def prompt_counts(features: DataFrame, turns: DataFrame, counter) -> DataFrame:
    """``features`` with ``input_tokens`` and ``output_tokens``, without rendering any prompt.

    ``counter`` maps a text column to a number that adds up over lines (a count of word pieces, say, of
    which none spans a line end).  A prompt's count is then its header's, its earlier lines' and its
    stub's: a running sum inside turn buckets, with a small table that carries it on.  (No prior
    conversations and no metadata; a tokenizer that does not add up needs rendered prompts.)
    """
    line = turns.select(*CONV, "turn_idx", counter(_line(F.col("ts"), F.col("speaker"), F.col("content"))).alias("_n"),
                        F.floor(F.col("turn_idx") / TURN_BUCKET).alias("_tb"))
    inside = W.partitionBy(*CONV, "_tb").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("_so_far", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    earlier = W.partitionBy(*CONV).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    carry = line.groupBy(*CONV, "_tb").agg(F.sum("_n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    line = line.join(carry.drop("_all"), [*CONV, "_tb"]).select(*CONV, "turn_idx", (F.col("_before") + F.col("_so_far")).alias("_history"))
    stub = counter(F.concat(F.lit(CURRENT_HEADER + "["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] Me: ")))
    return features.join(line, EX_KEY).withColumn("input_tokens", F.col("_history") + stub) \
        .withColumn("output_tokens", counter(F.col("output"))).drop("_history")


def filter_stats(features: DataFrame) -> DataFrame:
    """Examples removed per reason in the fixed order (zero counts kept)."""
    reasons = features.sparkSession.createDataFrame(
        [(i, r) for i, r in enumerate(REASONS)], "ord int, reject_reason string")
    counts = features.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason") \
        .agg(F.count(F.lit(1)).alias("n"))
    return (reasons.join(F.broadcast(counts), "reject_reason", "left")
            .select("ord", "reject_reason", F.coalesce("n", F.lit(0)).cast("long").alias("removed")))


def metadata_strings(turns: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Per thread, ``name: description`` lines of the thread's speakers.

    ``metadata`` has ``(owner_id, name, description)``; lines are sorted by
    name.  Threads without any known speaker get an empty string.
    """
    if metadata is None:
        return turns.select("owner_id", "thread_id").distinct().withColumn("metadata", F.lit(""))
    spk = turns.select("owner_id", "thread_id", F.col("speaker").alias("name")).distinct()
    hits = spk.join(metadata, ["owner_id", "name"], "inner")
    per = hits.groupBy("owner_id", "thread_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "description"))),
                                 lambda x: F.concat(x["name"], F.lit(": "), x["description"])), "\n").alias("lines"))
    threads = turns.select("owner_id", "thread_id").distinct()
    return threads.join(per, ["owner_id", "thread_id"], "left").select(
        "owner_id", "thread_id",
        F.when(F.col("lines").isNull(), F.lit("")).otherwise(
            F.concat(F.lit(METADATA_HEADER + "\n"), F.col("lines"))).alias("metadata"))


def render_examples(features: DataFrame, turns: DataFrame, persona: str = "Me", buffer: int = 0,
                    metadata: DataFrame | None = None, survivors_only: bool = True) -> DataFrame:
    """Render instruction / input / output for examples.

    History turns are fetched by an equi-join on generated turn numbers
    (at most the survivor's own turn count), never a join over a whole
    conversation.  With ``buffer > 0`` the transcripts of the previous
    ``buffer`` conversations of the thread are prepended.
    """
    ex = features.filter(F.col("reject_reason").isNull()) if survivors_only else features
    if buffer > 0:  # read three times: for the history, for the prior conversations and for the rows themselves
        ex = staged(ex)
    line = _line(F.col("ts"), F.col("speaker"), F.col("content"))
    tl = turns.select(*CONV, F.col("turn_idx").alias("h_idx"), line.alias("line"))
    want = ex.select(*EX_KEY, F.explode(F.sequence(F.lit(0), F.col("turn_idx") - 1)).alias("h_idx")) \
        .filter(F.col("turn_idx") > 0)
    hist = want.join(tl, CONV + ["h_idx"], "inner").groupBy(*EX_KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h_idx", "line"))),
                                 lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("history"))
    r = ex.join(hist, EX_KEY, "left")
    prior = F.lit("")
    if buffer > 0:
        convs = ex.select("owner_id", "thread_id", F.explode(
            F.sequence(F.greatest(F.col("conv_no") - buffer, F.lit(0)), F.col("conv_no") - 1)).alias("p_no"),
            F.col("conv_no")).filter(F.col("conv_no") > 0).distinct()
        need = convs.select("owner_id", "thread_id", F.col("p_no").alias("conv_no")).distinct()
        ptxt = turns.join(need, CONV, "left_semi").select(*CONV, "turn_idx", line.alias("line")) \
            .groupBy(*CONV).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "line"))),
                                                         lambda x: x["line"]), "\n").alias("ctext"))
        blocks = convs.join(ptxt.withColumnRenamed("conv_no", "p_no"), ["owner_id", "thread_id", "p_no"]) \
            .groupBy(*CONV).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_no", "ctext"))),
                                                         lambda x: F.concat(x["ctext"], F.lit(PRIOR_SEPARATOR))), "")
                                .alias("prior"))
        r = r.join(blocks, CONV, "left")
        prior = F.when(F.col("prior").isNull(), F.lit("")).otherwise(F.concat(F.lit(PREVIOUS_HEADER), F.col("prior")))
    md = metadata_strings(turns, metadata) if metadata is not None else None
    if md is not None:
        r = r.join(md, ["owner_id", "thread_id"], "left")
        meta = F.coalesce(F.col("metadata"), F.lit(""))
    else:
        meta = F.lit("")
    ts_txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return r.select(
        *EX_KEY, "ts",
        F.concat(F.lit(SYSTEM_PROMPT.format(persona)), meta, F.lit("\n")).alias("instruction"),
        F.concat(prior, F.lit(CURRENT_HEADER), F.coalesce(F.col("history"), F.lit("")),
                 F.lit("["), ts_txt, F.lit("] Me: ")).alias("input"),
        "output", "reject_reason",
    )


def build_examples(turns: DataFrame, persona: str = "Me", buffer: int = 0,
                   cfg: FilterConfig = DEFAULT_FILTERS, metadata: DataFrame | None = None) -> DataFrame:
    """Filtered, rendered training examples (the ``examples`` table)."""
    return render_examples(example_features(turns, buffer, cfg), turns, persona, buffer, metadata)


# --------------------------------------------------------------------------
# T25-T27
# --------------------------------------------------------------------------

# Chat templates of the training script.
CHAT_TEMPLATES = {
    "default": "{instruction}{input}{output}",
    "llama": ("<|start_header_id|>system<|end_header_id|>\n\n{instruction}<|eot_id|>\n"
              "<|start_header_id|>user<|end_header_id|>\n\n{input}<|eot_id|>\n"
              "<|start_header_id|>assistant<|end_header_id|>\n\n{output}<|eot_id|>"),
    "qwen": ("<|im_start|>system\n{instruction}<|im_end|>\n<|im_start|>user\n{input}<|im_end|>\n"
             "<|im_start|>assistant\n{output}<|im_end|>"),
}


def _template_parts(template: str) -> list[tuple[str, str]]:
    """Split a ``{field}`` template into (literal, field) pairs."""
    import re as _re
    parts = []
    pos = 0
    for m in _re.finditer(r"\{(instruction|input|output)\}", template):
        parts.append((template[pos:m.start()], m.group(1)))
        pos = m.end()
    parts.append((template[pos:], ""))
    return parts


def chat_template(examples: DataFrame, name: str = "default", custom: str | None = None) -> DataFrame:
    """Render examples with a named (or custom) chat template.

    Adds ``text`` (full rendering), ``prompt_text`` (everything before the
    output field) and ``empty_text`` (the rendering of an empty output), used
    for masking in T26.
    """
    template = custom if name == "custom" else CHAT_TEMPLATES[name]
    pieces, prompt_pieces, empty_pieces, seen_output = [], [], [], False
    for lit, fld in _template_parts(template):
        pieces.append(F.lit(lit))
        empty_pieces.append(F.lit(lit))
        if not seen_output:
            prompt_pieces.append(F.lit(lit))
        if fld:
            pieces.append(F.coalesce(F.col(fld), F.lit("")))
            if fld != "output":
                empty_pieces.append(F.coalesce(F.col(fld), F.lit("")))
            if fld == "output":
                seen_output = True
            elif not seen_output:
                prompt_pieces.append(F.coalesce(F.col(fld), F.lit("")))
    return examples.select("*", F.concat(*pieces).alias("text"), F.concat(*prompt_pieces).alias("prompt_text"),
                           F.concat(*empty_pieces).alias("empty_text"))


def word_tokens(c: Column) -> Column:
    """Default tokenizer: word pieces (runs of word characters or single symbols)."""
    return F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), 1)


def sft_spans(templated: DataFrame, max_seq_length: int = 2048, tokenize=word_tokens) -> DataFrame:
    """Token sequence truncated to ``max_seq_length``, prompt tokens masked.

    ``tokenize`` maps a text column to an array of tokens (the default is a
    JVM-side word-piece split; a user tokenizer can be a pandas UDF).
    ``labels`` is ``-100`` on prompt positions and the position index
    elsewhere (token ids are the user's tokenizer's business).
    """
    toks = tokenize(F.col("text"))
    plen = F.size(tokenize(F.col("prompt_text")))
    return templated.select(
        "*",
        F.slice(toks, 1, max_seq_length).alias("tokens"),
        F.least(plen, F.lit(max_seq_length)).alias("prompt_len"),
    ).withColumn("labels", F.transform("tokens", lambda t, i: F.when(i < F.col("prompt_len"), F.lit(-100))
                                       .otherwise(i))) \
     .withColumn("n_tokens", F.size("tokens")) \
     .withColumn("n_label_tokens", F.size(F.filter("labels", lambda x: x != -100)))


def piece_ids(c: Column, pattern: str) -> Column:
    """Default token ids without a tokenizer: word pieces of ``pattern``, each by the first 28 bits of its MD5."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int"))


def supervised_ids(templated: DataFrame, ids=piece_ids, max_seq_length: int = 2048, **how) -> DataFrame:
    """``input_ids``, ``prompt_length`` and ``labels`` of templated examples, all JVM-side.

    ``ids`` maps a text column to its token ids.  The prompt's length is that of the template with an empty
    output; both are cut to ``max_seq_length``, and the labels of the prompt's positions are -100.
    """
    cut = lambda c: F.slice(ids(c, **how), 1, max_seq_length)
    rows = templated.withColumn("input_ids", cut(F.col("text"))).withColumn("prompt_length", F.size(cut(F.col("empty_text"))))
    label = F.transform("input_ids", lambda t, i: F.when(i < F.col("prompt_length"), F.lit(-100)).otherwise(t))
    return rows.withColumn("labels", label)


def supervised_ids_with(templated: DataFrame, make_encoder, max_seq_length: int = 2048, joint: bool = False) -> DataFrame:
    """T26 with the user's tokenizer: as :func:`supervised_ids`, in Arrow batches.

    ``make_encoder()`` is called once a task and gives a function from a list of texts to ``(ids, starts)``
    of each: token ids and the character at which each token begins.  With ``joint`` the prompt's length is
    measured on the joint text, as the tokens that begin before the output does; a token that runs across
    the edge counts as prompt.
    """
    from pyspark.sql import types as T

    fields = [T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("prompt_length", T.IntegerType()),
              T.StructField("labels", T.ArrayType(T.IntegerType()))]

    def run(batches):
        import bisect

        import pyarrow as pa

        encode = make_encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = encode(texts)
            if joint:
                edge = [len(p or "") for p in batch.column("prompt_text").to_pylist()]
                length = [bisect.bisect_left(list(starts), e) for (_, starts), e in zip(found, edge)]
            else:
                length = [len(ids) for ids, _ in encode([t or "" for t in batch.column("empty_text").to_pylist()])]
            rows = [list(ids)[:max_seq_length] for ids, _ in found]
            length = [min(n, max_seq_length) for n in length]
            labels = [[-100] * min(n, len(ids)) + ids[n:] for ids, n in zip(rows, length)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array(length, pa.int32()), pa.array(labels, kind)],
                                             [*batch.schema.names, "input_ids", "prompt_length", "labels"])

    return templated.mapInArrow(run, T.StructType([*templated.schema.fields, *fields]))


def phrase_search(texts: DataFrame, phrases: DataFrame, key_cols: list[str],
                  fields: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Which phrases occur (case-insensitive substring) in which texts.

    One row per (text row, phrase, field) with the last 100 characters of the
    field as context.  Both sides may be large: they meet through an index on
    each phrase's rarest gram (:func:`chatlake.operators.substring.substring_join`).
    """
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")
    rows = texts.select(*key_cols, one).select(*key_cols, "f.field", F.expr("right(f.text, 100)").alias("context"),
                                               F.lower("f.text").alias("_low"))
    wanted = phrases.select(F.col("phrase_id").cast("long").alias("phrase_id"), "phrase", F.lower("phrase").alias("_phrase"))
    return substring_join(rows, wanted, "_low", "_phrase").select("phrase_id", *key_cols, "field", "context", "phrase")


def phrase_counts(hits: DataFrame) -> DataFrame:
    """T27 summary: hits per phrase (input and output hits both count)."""
    return hits.groupBy("phrase_id", "phrase").agg(F.count(F.lit(1)).alias("n_hits"))
