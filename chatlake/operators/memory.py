"""Memory bank: request tables, response parsers, linking, unification and
timeline (M01-M19).

Model calls are the user's job: ``build_*_requests`` produce a ``requests``
table (one prompt per batch) and ``parse_*`` read a ``responses`` table
``(owner_id, stage, batch_no, text)``.  Parsers are line state machines
rewritten as window/aggregate rules over exploded lines (records are the
runs of lines between ``Attribute:`` lines), so every response is parsed
in parallel and no response text goes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions.text import py_strip
from chatlake.operators.deal import sized, staged
from chatlake.prompts import COMBINE_PROMPT, EVENT_PROMPT, EXTRACT_PROMPT
from chatlake.sources.exports import dense_numbers

# Batch sizes, counts and prompt texts of the memory pipeline.
EXTRACT_BATCH = 20
COMBINE_BATCH = 25
EVENT_CHUNK = 100
TOP_MEMORIES = 25
KIND_LABEL = {"original": "Original Attribute", "combined": "Combined Attribute", "inferred": "Inferred Attribute"}
KIND_ORDER = {"original": 0, "combined": 1, "inferred": 2}
TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
CONV_NUM_RE = r"conversation\s+([0-9]+)"
ATTR_REF_RE = r"Attribute\s+([0-9]+)"
TS_IN_CITATION_RE = r"Timestamp:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)"
DATE_IN_CITATION_RE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"

RESP = ["owner_id", "stage", "batch_no"]


def _split_template(template: str, **kw) -> list:
    """Template -> list of literal strings and column placeholders, in order."""
    import re as _re
    out, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        out.append(F.lit(template[pos:m.start()]))
        v = kw[m.group(1)]
        out.append(v if isinstance(v, Column) else F.lit(str(v)))
        pos = m.end()
    out.append(F.lit(template[pos:]))
    return out


# --------------------------------------------------------------------------
# Batches of conversations and the extraction requests
# --------------------------------------------------------------------------

def pack_batches(store: DataFrame, batch_size: int = EXTRACT_BATCH) -> DataFrame:
    """``store_rank`` (1 = newest) -> ``batch_no`` (0-based) and ``slot`` (1-based)."""
    return store.withColumn("batch_no", F.floor((F.col("store_rank") - 1) / batch_size).cast("long")) \
        .withColumn("slot", ((F.col("store_rank") - 1) % batch_size + 1).cast("int"))


def conversation_blocks(turns: DataFrame, batches: DataFrame) -> DataFrame:
    """``CONVERSATION n START:`` ... ``CONVERSATION n END`` per conversation."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("speaker"), F.lit(": "),
                    F.col("content"), F.lit("\n"))
    t = turns.join(batches.select("owner_id", "thread_id", "conv_no", "batch_no", "slot"),
                   ["owner_id", "thread_id", "conv_no"])
    return t.groupBy("owner_id", "batch_no", "slot", "thread_id", "conv_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("l")))),
                                 lambda x: x["l"]), "").alias("body")) \
        .withColumn("block", F.concat(F.lit("CONVERSATION "), F.col("slot").cast("string"), F.lit(" START:\n"),
                                      F.col("body"), F.lit("CONVERSATION "), F.col("slot").cast("string"),
                                      F.lit(" END\n")))


def build_extract_requests(turns: DataFrame, batches: DataFrame, person: str,
                           template: str = EXTRACT_PROMPT) -> DataFrame:
    """One extraction prompt per batch of (at most 20) conversations.

    ``template`` may use ``{n}``, ``{person}`` and ``{convs}``.
    """
    b = conversation_blocks(turns, batches)
    g = b.groupBy("owner_id", "batch_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "block"))), lambda x: x["block"]),
                     "\n").alias("convs"),
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "thread_id", "conv_no"))),
                    lambda x: F.concat(x["thread_id"], F.lit("#"), x["conv_no"].cast("string"))).alias("members"))
    prompt = F.concat(*_split_template(template, n=F.col("n").cast("string"), person=person,
                                       convs=F.col("convs")))
    return g.select("owner_id", F.lit("extract").alias("stage"), "batch_no", prompt.alias("prompt"), "members")


# --------------------------------------------------------------------------
# Response parsers
# --------------------------------------------------------------------------

def _lines(responses: DataFrame) -> DataFrame:
    """Non-blank stripped lines with bullets removed, in order."""
    ln = responses.select(*RESP, F.posexplode(F.split(py_strip(F.col("text")), "\n")).alias("pos", "raw"))
    ln = ln.withColumn("raw", py_strip(F.col("raw"))).filter(F.col("raw") != "")
    line = F.when(F.col("raw").startswith("- ") | F.col("raw").startswith("• "),
                  F.expr("substring(raw, 3)")).otherwise(F.col("raw"))
    return ln.withColumn("line", line).withColumn("low", F.lower("line"))


def _field(prefix: str) -> Column:
    return py_strip(F.expr(f"substring(line, {len(prefix) + 1})"))


def parse_attributes(responses: DataFrame) -> DataFrame:
    """``Attribute:`` / ``Citation:`` / ``Timestamp:`` records.

    A record starts at an attribute line.  It closes at a timestamp line
    once it has a citation; later citation/timestamp lines of the same run
    are ignored.  An unclosed record ends at the next attribute line (its
    missing fields stay NULL) or at the end of the text (missing citation
    and timestamp become empty strings).  Lines before the first attribute
    are ignored.  Returns ``(owner_id, stage, batch_no, rec, attribute,
    citation, timestamp, conversation_number)`` with ``rec`` 1-based.
    """
    ln = _lines(responses)
    kind = F.when(F.col("low").startswith("attribute:"), "A").when(F.col("low").startswith("citation:"), "C") \
        .when(F.col("low").startswith("timestamp:"), "T")
    ln = ln.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    wr = W.partitionBy(*RESP).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ln = ln.withColumn("rec", F.sum((F.col("kind") == "A").cast("long")).over(wr)).filter(F.col("rec") > 0)
    ln = ln.withColumn("val", F.when(F.col("kind") == "A", _field("attribute:"))
                       .when(F.col("kind") == "C", _field("citation:")).otherwise(_field("timestamp:")))
    wg = W.partitionBy(*RESP, "rec")
    ln = ln.withColumn("_c1", F.min(F.when(F.col("kind") == "C", F.col("pos"))).over(wg))
    ln = ln.withColumn("_close", F.min(F.when((F.col("kind") == "T") & (F.col("pos") > F.col("_c1")),
                                              F.col("pos"))).over(wg))
    live = F.col("_close").isNull() | (F.col("pos") <= F.col("_close"))
    g = ln.filter(live).groupBy(*RESP, "rec").agg(
        F.max(F.when(F.col("kind") == "A", F.col("val"))).alias("attribute"),
        F.max_by(F.col("val"), F.when(F.col("kind") == "C", F.col("pos"))).alias("citation"),
        F.max_by(F.col("val"), F.when(F.col("kind") == "T", F.col("pos"))).alias("timestamp"),
        F.first("_close", ignorenulls=True).alias("_close"))
    last = F.max("rec").over(W.partitionBy(*RESP)) == F.col("rec")
    open_last = F.col("_close").isNull() & last
    g = g.withColumn("citation", F.when(open_last, F.coalesce("citation", F.lit(""))).otherwise(F.col("citation"))) \
        .withColumn("timestamp", F.when(open_last, F.coalesce("timestamp", F.lit(""))).otherwise(F.col("timestamp")))
    num = F.regexp_extract(F.lower("citation"), CONV_NUM_RE, 1)
    g = g.withColumn("conversation_number", F.when(num != "", num.try_cast("int")))
    return g.select(*RESP, "rec", "attribute", "citation", "timestamp", "conversation_number")


def parse_combined(responses: DataFrame) -> DataFrame:
    """``COMBINED`` / ``INFERRED`` sections of ``Attribute:`` + ``Based on:``.

    A header is any line containing the section name (case-insensitive).  A
    record closes at its first ``Based on:`` line and goes to the section
    current there; an unclosed record ends at the next attribute line (and
    goes to the section current at that line) or at the end of the text
    (section current at the end, ``based_on`` = '').  Records outside any
    section are dropped.
    """
    ln = _lines(responses)
    up = F.upper("raw")
    sec = F.when(up.contains("COMBINED ATTRIBUTES"), "combined").when(up.contains("INFERRED ATTRIBUTES"), "inferred")
    ln = ln.withColumn("hdr", sec)
    kind = F.when(F.col("hdr").isNotNull(), "H").when(F.col("low").startswith("attribute:"), "A") \
        .when(F.col("low").startswith("based on:"), "B")
    ln = ln.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    wr = W.partitionBy(*RESP).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ln = ln.withColumn("section", F.last("hdr", ignorenulls=True).over(wr)) \
        .withColumn("rec", F.sum((F.col("kind") == "A").cast("long")).over(wr))
    # The section at the end, from the same sorted lines: a table of its own would parse every response again.
    ln = ln.withColumn("final_section", F.last("hdr", ignorenulls=True).over(wr.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    body = ln.filter((F.col("rec") > 0) & (F.col("kind") != "H")).dropna(subset=RESP)
    body = body.withColumn("val", F.when(F.col("kind") == "A", _field("attribute:")).otherwise(_field("based on:")))
    g = body.groupBy(*RESP, "rec").agg(
        F.first("final_section").alias("final_section"),
        F.max(F.when(F.col("kind") == "A", F.col("val"))).alias("attribute"),
        F.min_by(F.col("val"), F.when(F.col("kind") == "B", F.col("pos"))).alias("based_on"),
        F.min_by(F.col("section"), F.when(F.col("kind") == "B", F.col("pos"))).alias("close_section"),
        F.max(F.when(F.col("kind") == "A", F.col("section"))).alias("a_section"))
    wn = W.partitionBy(*RESP).orderBy("rec")
    g = g.withColumn("next_a_section", F.lead("a_section").over(wn)) \
        .withColumn("is_last", F.lead("rec").over(wn).isNull())
    section = F.when(F.col("based_on").isNotNull(), F.col("close_section")) \
        .when(F.col("is_last"), F.col("final_section")).otherwise(F.col("next_a_section"))
    based_on = F.when(F.col("based_on").isNull() & F.col("is_last"), F.lit("")).otherwise(F.col("based_on"))
    return g.select(*RESP, "rec", section.alias("kind"), "attribute", based_on.alias("based_on")) \
        .filter(F.col("kind").isNotNull())


# --------------------------------------------------------------------------
# Linking and combine batches
# --------------------------------------------------------------------------

def link_conversations(attrs: DataFrame, batches: DataFrame) -> DataFrame:
    """The cited conversation (1-based number inside the batch) or NULL."""
    b = batches.select("owner_id", "batch_no", F.col("slot").alias("conversation_number"), "thread_id", "conv_no")
    return attrs.join(b, ["owner_id", "batch_no", "conversation_number"], "left")


def pack_attributes(attrs: DataFrame, order_cols: list[str], batch_size: int = COMBINE_BATCH) -> DataFrame:
    """Consecutive batches of ``batch_size`` attributes per owner.

    Positions come from per-group counts and prefix sums (a small table),
    not from one window over all attributes of an owner.
    """
    lead_col, rest = order_cols[0], order_cols[1:]
    counts = attrs.groupBy("owner_id", lead_col).agg(F.count(F.lit(1)).alias("_n"))
    wc = W.partitionBy("owner_id").orderBy(lead_col).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
    wi = W.partitionBy("owner_id", lead_col).orderBy(*rest)
    a = attrs.join(counts.select("owner_id", lead_col, "_off"), ["owner_id", lead_col]) \
        .withColumn("seq_no", F.col("_off") + F.row_number().over(wi) - 1).drop("_off")
    return a.withColumn("cbatch", F.floor(F.col("seq_no") / batch_size).cast("long")) \
        .withColumn("cslot", (F.col("seq_no") % batch_size + 1).cast("int"))


def nearest_timestamp(packed: DataFrame) -> DataFrame:
    """A blank timestamp borrows from the nearest neighbour in its batch.

    Distance d = 0, 1, ... is tried forward first, then backward, and the
    search stops as soon as either side leaves the batch.
    """
    ts = F.when(py_strip(F.coalesce(F.col("timestamp"), F.lit(""))) != "", F.col("timestamp"))
    p = packed.withColumn("_ts", ts)
    w = W.partitionBy("owner_id", "cbatch").orderBy("cslot")
    p = p.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("owner_id", "cbatch")))
    p = p.withColumn("_fp", F.first(F.when(F.col("_ts").isNotNull(), F.col("cslot")), ignorenulls=True)
                     .over(w.rowsBetween(0, W.unboundedFollowing)))
    p = p.withColumn("_bp", F.last(F.when(F.col("_ts").isNotNull(), F.col("cslot")), ignorenulls=True)
                     .over(w.rowsBetween(W.unboundedPreceding, 0)))
    p = p.withColumn("_fv", F.first("_ts", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    p = p.withColumn("_bv", F.last("_ts", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lim = F.least(F.col("cslot") - 1, F.col("_n") - F.col("cslot"))
    df_, db_ = F.col("_fp") - F.col("cslot"), F.col("cslot") - F.col("_bp")
    fwd_ok = F.col("_fp").isNotNull() & (df_ <= lim)
    bwd_ok = F.col("_bp").isNotNull() & (db_ <= lim)
    borrowed = F.when(fwd_ok & (~bwd_ok | (df_ <= db_)), F.col("_fv")).when(bwd_ok, F.col("_bv")).otherwise(F.lit(""))
    return p.withColumn("prompt_ts", borrowed).drop("_ts", "_n", "_fp", "_bp", "_fv", "_bv")


def build_combine_requests(packed_ts: DataFrame, person: str, template: str = COMBINE_PROMPT) -> DataFrame:
    """One combine prompt per batch of 25 attributes.

    ``template`` may use ``{person}`` and ``{attrs}``.
    """
    line = F.concat(F.lit("Attribute "), F.col("cslot").cast("string"), F.lit(": "), F.col("attribute"),
                    F.lit(" (Citation: "), F.coalesce("citation", F.lit("")), F.lit(", Timestamp: "),
                    F.col("prompt_ts"), F.lit(")"))
    g = packed_ts.groupBy("owner_id", "cbatch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cslot", line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("attrs"))
    prompt = F.concat(*_split_template(template, person=person, attrs=F.col("attrs")))
    return g.select("owner_id", F.lit("combine").alias("stage"), F.col("cbatch").alias("batch_no"),
                    prompt.alias("prompt"))


def resolve_sources(combined: DataFrame, packed: DataFrame) -> DataFrame:
    """``Attribute N`` references -> source attributes of the same batch.

    Numbers outside the batch are dropped; repeated references are kept.
    ``packed`` is the attribute batch table (``cbatch``, ``cslot``).
    """
    refs = combined.select(*RESP, "rec", "kind",
                           F.posexplode(F.regexp_extract_all(F.coalesce("based_on", F.lit("")),
                                                             F.lit(ATTR_REF_RE), 1)).alias("ord", "n"))
    refs = refs.withColumn("cslot", F.col("n").try_cast("int"))   # out of range: no such attribute
    src = packed.select("owner_id", F.col("cbatch").alias("batch_no"), "cslot",
                        F.col("seq_no").alias("source_seq"))
    return refs.join(src, ["owner_id", "batch_no", "cslot"], "inner").drop("n")


# --------------------------------------------------------------------------
# Unify, event-memory chunks, top memories, bank
# --------------------------------------------------------------------------

def unify_memories(original: DataFrame, combined: DataFrame) -> DataFrame:
    """One list of original, combined and inferred attributes.

    ``id`` is the running position in that order (1-based) computed from
    per-kind counts; ``citation`` of combined/inferred rows is ``based_on``.
    """
    o = original.select("owner_id", F.lit("original").alias("kind"), F.col("batch_no").alias("k1"),
                        F.col("seq_no").alias("k2"), "attribute", F.coalesce("citation", F.lit("")).alias("citation"))
    c = combined.select("owner_id", "kind", F.col("batch_no").alias("k1"), F.col("rec").alias("k2"),
                        "attribute", F.coalesce("based_on", F.lit("")).alias("citation"))
    u = o.unionByName(c).withColumn("kind_ord", F.when(F.col("kind") == "original", 0)
                                    .when(F.col("kind") == "combined", 1).otherwise(2))
    # Offsets per (kind, response batch) from a count table, plus a rank
    # inside the batch: no window spans all memories of an owner.
    counts = u.groupBy("owner_id", "kind_ord", "k1").agg(F.count(F.lit(1)).alias("_n"))
    wc = W.partitionBy("owner_id").orderBy("kind_ord", "k1").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
    wi = W.partitionBy("owner_id", "kind_ord", "k1").orderBy("k2")
    return u.join(counts.select("owner_id", "kind_ord", "k1", "_off"), ["owner_id", "kind_ord", "k1"]) \
        .withColumn("id", F.col("_off") + F.row_number().over(wi)) \
        .withColumn("type", F.when(F.col("kind") == "original", KIND_LABEL["original"])
                    .when(F.col("kind") == "combined", KIND_LABEL["combined"]).otherwise(KIND_LABEL["inferred"])) \
        .drop("_off", "k1", "k2")


def build_event_requests(unified: DataFrame, person: str, chunk_size: int = EVENT_CHUNK,
                         template: str = EVENT_PROMPT) -> DataFrame:
    """Chunks of 100 unified attributes as an indented JSON list in the prompt.

    ``template`` may use ``{person}``, ``{chunk}``, ``{total}`` and ``{json}``.
    """
    u = unified.withColumn("chunk", F.floor((F.col("id") - 1) / chunk_size).cast("long"))

    def jstr(c):  # JSON literal of one value
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    item = F.concat(F.lit('  {\n    "type": '), jstr(F.col("type")),
                    F.lit(',\n    "id": '), F.col("id").cast("string"),
                    F.lit(',\n    "content": '), jstr(F.coalesce(F.col("attribute"), F.lit(""))),
                    F.lit(',\n    "citation": '), jstr(F.coalesce(F.col("citation"), F.lit(""))),
                    F.lit("\n  }"))
    total = u.groupBy("owner_id").agg(F.max("chunk").alias("_last"))
    g = u.groupBy("owner_id", "chunk").agg(
        F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("j")))),
                                                        lambda x: x["j"]), ",\n"), F.lit("\n]")).alias("json"))
    g = g.join(total, "owner_id")
    prompt = F.concat(*_split_template(template, person=person, chunk=(F.col("chunk") + 1).cast("string"),
                                       total=(F.col("_last") + 1).cast("string"), json=F.col("json")))
    return g.select("owner_id", F.lit("events").alias("stage"), F.col("chunk").alias("batch_no"),
                    prompt.alias("prompt"))


EVENT_ITEM = T.ArrayType(T.StructType([
    T.StructField("attribute", T.StringType()), T.StructField("citation", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("time_period", T.StringType())]))


def parse_event_memories(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON array between the first ``[`` and the last ``]`` of each response.

    Returns ``(memories, rejects)``; a response without an array or with
    broken JSON goes to ``rejects`` (the studied code skips it).
    """
    arr = F.regexp_extract("text", r"(?s)(\[.*\])", 1)
    p = responses.withColumn("_j", F.when(arr != "", F.from_json(arr, EVENT_ITEM)))
    ok = p.filter(F.col("_j").isNotNull())
    rejects = p.filter(F.col("_j").isNull()).select(*RESP, "text")
    mem = ok.select(*RESP, F.posexplode("_j").alias("pos", "m")).select(
        *RESP, "pos", "m.attribute", "m.citation", "m.timestamp", "m.time_period")
    return mem, rejects


def top_memories(events: DataFrame, n: int = TOP_MEMORIES, by_time_period: bool = False) -> DataFrame:
    """First ``n`` event memories per owner.

    The studied code sorts on ``time_period`` (missing = ``Unknown``), a key
    the responses do not carry, so the order is arrival order; that is the
    default.  ``by_time_period=True`` applies the sort key.
    """
    keys = [F.coalesce("time_period", F.lit("Unknown"))] if by_time_period else []
    w = W.partitionBy("owner_id").orderBy(*keys, "batch_no", "pos")
    return events.withColumn("top_rank", F.row_number().over(w)).filter(F.col("top_rank") <= n)


def record_id(batch: Column, rec: Column) -> Column:
    """A response's record as one number: up to 2^24 records in each of 2^36 responses."""
    return batch.cast("long") * (1 << 24) + rec


def combined_id(batch: Column, rec: Column) -> Column:
    """``mem_id`` of a combined or inferred memory: apart from original ids (below 2^60) and top ids (from 2^62)."""
    return F.lit(1 << 61) + record_id(batch, rec)


def assemble_bank(original: DataFrame, combined: DataFrame, top: DataFrame) -> DataFrame:
    """The ``memories`` table (levels 1/2/3) with stable ``mem_id``."""
    o = original.select("owner_id", (F.col("seq_no") + 1).alias("mem_id"), F.lit(1).alias("level"),
                        F.lit("original").alias("kind"), "attribute", "citation",
                        F.col("timestamp").alias("ts_text"))
    c = combined.select("owner_id", combined_id(F.col("batch_no"), F.col("rec")).alias("mem_id"),
                        F.lit(2).alias("level"), "kind", "attribute", F.col("based_on").alias("citation"),
                        F.lit(None).cast("string").alias("ts_text"))
    t = top.select("owner_id", (F.lit(1 << 62) + F.col("top_rank")).alias("mem_id"), F.lit(3).alias("level"),
                   F.lit("top").alias("kind"), "attribute", "citation", F.col("timestamp").alias("ts_text"))
    return o.unionByName(c).unionByName(t).withColumn("level", F.col("level").cast("int"))


# --------------------------------------------------------------------------
# Normalisation, timestamps, timeline
# --------------------------------------------------------------------------

def normalize_bank(bank_rows: DataFrame) -> DataFrame:
    """One row per entry of a bank read by ``read_memory_bank``, with its keys unified.

    ``Timestamp``/``timestamp`` and ``citation``/``citations`` are one column each (the first
    spelling wins where both exist); ``level`` is 1 for original entries, 2 for combined and
    inferred ones, 3 for top memories.  Other keys stay in ``entry``.
    """
    kinds = [("original_attributes", "original", 1), ("combined_attributes", "combined", 2),
             ("inferred_attributes", "inferred", 2), ("top_memories", "top", 3)]
    rows = [bank_rows.select("owner_id", F.lit(kind).alias("kind"), F.lit(level).alias("level"),
                             F.posexplode(name).alias("pos", "entry")) for name, kind, level in kinds]
    every = reduce(DataFrame.unionByName, rows)

    def key(*names):
        return F.coalesce(*[F.try_element_at("entry", F.lit(n)) for n in names])

    return every.select("owner_id", "kind", "level", "pos", key("attribute").alias("attribute"),
                        key("timestamp", "Timestamp").alias("ts_text"),
                        key("citation", "citations").alias("citation_text"),
                        key("conversation_number").try_cast("int").alias("conversation_number"),
                        key("conversation_content").alias("conversation_content"), "entry")


def _citation_time(text: Column) -> Column:
    """The time that a citation names: ``Timestamp: ...``, or else any date."""
    explicit, date = F.regexp_extract(text, TS_IN_CITATION_RE, 1), F.regexp_extract(text, DATE_IN_CITATION_RE, 0)
    return F.when(explicit != "", explicit).when(date != "", date)


def bank_view(entries: DataFrame, hierarchical: bool = True, observation: Observation | None = None) -> DataFrame:
    """The memories that a search module works on, from ``normalize_bank`` rows.

    The flat view has the combined and inferred entries only; the hierarchical one has three levels.  An
    entry below level 3 without a timestamp key takes the first ``timestamp`` of its source attributes, or
    else the time that its citations name, in their order, or an empty text.  Citations default to ``[]``.
    ``observation`` counts, in the pass that reads the rows: ``kept``, ``dropped`` (level not in the view)
    and ``undated`` (no time found).
    """
    in_view = F.lit(True) if hierarchical else F.col("level") == 2
    said = F.try_element_at("entry", F.lit("source_attributes"))
    sources = F.from_json(said, "array<map<string,string>>")
    dated = F.filter(F.transform(sources, lambda x: F.try_element_at(x, F.lit("timestamp"))), lambda x: x.isNotNull())
    listed = F.when(F.col("citation_text").startswith("["), F.from_json("citation_text", "array<string>"))
    named = F.filter(F.transform(F.coalesce(listed, F.array("citation_text")), _citation_time), lambda x: x.isNotNull())
    found = F.coalesce(F.try_element_at(dated, F.lit(1)), F.try_element_at(named, F.lit(1)), F.lit(""))
    rows = entries.withColumn("_in", in_view).withColumn(
        "timestamp", F.when(F.col("ts_text").isNotNull() | (F.col("level") == 3), F.col("ts_text")).otherwise(found))
    if observation is not None:
        undated = F.col("_in") & (F.col("level") < 3) & F.col("ts_text").isNull() & (F.col("timestamp") == "")
        rows = rows.observe(observation, F.count_if("_in").alias("kept"), F.count_if(~F.col("_in")).alias("dropped"),
                            F.count_if(undated).alias("undated"))
    return rows.filter("_in").select("owner_id", "kind", "level", "pos", "attribute", "timestamp",
                                     F.coalesce("citation_text", F.lit("[]")).alias("citations"))


def parse_ts_text(c: Column) -> Column:
    """Timestamp from ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd HH:mm`` text."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TS_FORMATS])


def recover_timestamps(memories: DataFrame, sources: DataFrame) -> DataFrame:
    """A missing timestamp comes from the first source attribute that
    has one, else from ``Timestamp: ...`` in the citation, else from any
    date in the citation."""
    first_src = sources.filter(F.col("source_ts").isNotNull()).groupBy("owner_id", "mem_id") \
        .agg(F.min_by("source_ts", "ord").alias("_src_ts"))
    m = memories.join(first_src, ["owner_id", "mem_id"], "left")
    cit = F.coalesce(F.col("citation"), F.lit(""))
    from_ts = F.regexp_extract(cit, TS_IN_CITATION_RE, 1)
    from_date = F.regexp_extract(cit, DATE_IN_CITATION_RE, 0)
    rec = F.coalesce(F.col("_src_ts"), F.when(from_ts != "", from_ts), F.when(from_date != "", from_date), F.lit(""))
    return m.withColumn("recovered_ts", F.when(F.col("ts_text").isNotNull() & (F.col("ts_text") != ""),
                                               F.col("ts_text")).otherwise(rec)).drop("_src_ts")


UNDATED_DAY = "0001-01-01"
#: Memories without a time are ranked in runs of 2^12 ids of original ones, and of 2^10 responses of the others (see ``combined_id``).
ID_RUN, RESPONSE_RUN = 12, 34


def timeline(memories: DataFrame, sources: DataFrame, keep_undated: bool = False, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Timeline timestamp, conversation flag, newest-first index, day.

    A memory with a timestamp text is placed by it, or, if the text is no
    time, at the very end (``tl_ts`` null, day ``0001-01-01``).  One without a text takes
    the earliest parsable timestamp among its sources; if there is none it is
    dropped, or placed at the end too with ``keep_undated``.  Equal times keep
    the order original, combined, inferred, ``mem_id``.  A memory has a
    conversation if it or one of its sources is linked to one.
    """
    src_t = sources.groupBy("owner_id", "mem_id").agg(F.min(parse_ts_text(F.col("source_ts"))).alias("_st"),
                                                      F.bool_or(F.col("source_has_conv")).alias("_sc"))
    m = memories.filter(F.col("level").isin(*levels)).join(src_t, ["owner_id", "mem_id"], "left")
    own = F.col("ts_text").isNotNull()
    m = m.withColumn("tl_ts", F.when(own, parse_ts_text(F.col("ts_text"))).otherwise(F.col("_st"))) \
        .withColumn("has_conversation", F.coalesce(F.col("has_conv"), F.lit(False)) | F.coalesce(F.col("_sc"), F.lit(False)))
    if not keep_undated:
        m = m.filter(own | F.col("tl_ts").isNotNull())
    m = m.withColumn("day", F.coalesce(F.date_format("tl_ts", "yyyy-MM-dd"), F.lit(UNDATED_DAY)))
    # Newest-first index: counted per hour, and per run of ids at the end, so that neither an owner nor a busy day is ranked in one task.
    order = F.when(F.col("kind") == "original", 0).when(F.col("kind") == "combined", 1).when(F.col("kind") == "inferred", 2).otherwise(3)
    hour, undated = F.coalesce(-F.floor(F.unix_seconds("tl_ts") / 3600), F.lit(1 << 60)), F.col("tl_ts").isNull()
    run = F.when(F.col("_kind") == 0, F.shiftright("mem_id", ID_RUN)).otherwise(F.shiftright("mem_id", RESPONSE_RUN))
    m = m.withColumn("_late", -F.unix_micros("tl_ts")).withColumn("_kind", order) \
        .withColumn("_chunk", F.struct(hour.alias("hour"), F.when(undated, F.col("_kind")).alias("kind"), F.when(undated, run).alias("run")))
    m = dense_numbers(m, ["owner_id"], "_chunk", ["_late", "_kind", "mem_id"], "_n")
    return m.withColumn("tl_index", F.col("_n") - 1).drop("_st", "_sc", "_chunk", "_late", "_kind", "_n")


#: Memories, next to each other in the timeline, whose texts are joined at once: a row of :func:`timeline_days` is made of such pieces.
DAY_BLOCK = 256
#: Bytes of text that a value of Spark can hold, less the other columns of its row.
LARGEST_TEXT = (1 << 31) - (1 << 16)


def _joined_pieces(names: list[str], sep: str):
    """mapInArrow body over pieces ``(owner_id, day, _n, _text)`` sorted by key and place: a row a key, its text grown piece by piece."""
    import pyarrow as pa

    def run(batches):
        key, n, text, begun = None, 0, bytearray(), False

        def row(schema):
            # The text's own memory is sent: a copy would be as large again.
            ends = pa.array([0, len(text)], pa.int32()).buffers()[1]
            whole = pa.StringArray.from_buffers(1, ends, pa.py_buffer(text))
            keys = [pa.array([v], schema.field(c).type) for c, v in zip(names, key)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([n], pa.int64()), whole], [*names, "n_memories", "attributes"])

        for batch in batches:
            for *at, more, piece in zip(*[batch.column(c).to_pylist() for c in (*names, "_n")], batch.column("_text")):
                if at != key:
                    if key is not None:
                        yield row(batch.schema)
                    key, n, text, begun = at, 0, bytearray(), False
                n += more
                if piece.is_valid:
                    if begun:
                        text += sep.encode()
                    text += piece.as_buffer()
                    begun = True
                    if len(text) > LARGEST_TEXT:
                        raise ValueError(f"{at}: the text is too long for one value; timeline() has its memories as rows")
            schema = batch.schema
        if key is not None:
            yield row(schema)

    return run


def timeline_days(tl: DataFrame) -> DataFrame:
    """Memories grouped by day (newest first inside the day), one text a day; :func:`timeline` has them as rows.

    A day may hold a large part of all memories (the undated ones share one).  Short stretches of the
    timeline are joined first, by all tasks; the task of a day then sorts these pieces, on disk where they
    don't fit, and adds them to the day's text one by one, so that it holds that text and no memory's row.
    """
    key, sep = ["owner_id", "day"], " | "
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tl_index", "attribute"))), lambda x: x["attribute"]), sep)
    pieces = tl.groupBy(*key, F.floor(F.col("tl_index") / DAY_BLOCK).alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.when(F.count("attribute") > 0, joined).alias("_text"))  # null: no text, not an empty one
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "_block")
    kinds = ", ".join(f"{c} {tl.schema[c].dataType.simpleString()}" for c in key)
    return pieces.select(*key, "_n", "_text").mapInArrow(_joined_pieces(key, sep), f"{kinds}, n_memories long, attributes string")


def drill_through(memory_keys: DataFrame, sources: DataFrame, memory_convs: DataFrame,
                  turns: DataFrame) -> DataFrame:
    """The conversation turns behind memories.

    A memory with a conversation of its own shows that one; the others show
    the conversations of their sources, in the order ``ord`` of the references
    (a source named twice is shown twice).  ``sources``: ``(owner_id, mem_id,
    ord, source_mem_id)``; ``ord`` and ``source_mem_id`` are null for own conversations.
    """
    own = memory_keys.select("owner_id", "mem_id").join(memory_convs, ["owner_id", "mem_id"]) \
        .select("owner_id", "mem_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("long").alias("source_mem_id"), "thread_id", "conv_no")
    via = memory_keys.select("owner_id", "mem_id").join(memory_convs.select("owner_id", "mem_id").distinct(), ["owner_id", "mem_id"], "left_anti") \
        .join(sources.select("owner_id", "mem_id", "ord", "source_mem_id"), ["owner_id", "mem_id"]) \
        .join(memory_convs.withColumnRenamed("mem_id", "source_mem_id"), ["owner_id", "source_mem_id"]) \
        .select("owner_id", "mem_id", F.col("ord").cast("int").alias("ord"), "source_mem_id", "thread_id", "conv_no")
    return own.unionByName(via).join(turns, ["owner_id", "thread_id", "conv_no"])
