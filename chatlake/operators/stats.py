"""Token statistics.

Token counts are a column expression: the default is a JVM-side word-piece
count (runs of letters/digits, or single symbols), so statistics stay inside
whole-stage code.  A user tokenizer (for example a BPE encoder that is
available offline) plugs in as an Arrow-batched pandas UDF via
:func:`pandas_token_counter`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import WS

TOKEN_RE = f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS}]"
MEASURES = ["input_tokens", "output_tokens", "combined_tokens"]
N_BINS = 50
TOKEN_LIMIT = 100_000


def word_piece_count(c: Column) -> Column:
    """A01 default: number of word pieces in the text (0 for NULL)."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_RE)), F.lit(0)).cast("long")


def pandas_token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """A01 hook: wrap ``encode(text) -> tokens`` as a vectorised counter."""
    import pandas as pd

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: 0 if t is None else len(encode(t))).astype("int64")

    return _count


def token_counts(examples: DataFrame, counter=word_piece_count) -> DataFrame:
    """Input / output / combined token counts per example."""
    return (examples.withColumn("input_tokens", counter(F.col("input")))
            .withColumn("output_tokens", counter(F.col("output")))
            .withColumn("combined_tokens", F.col("input_tokens") + F.col("output_tokens")))


def _long_form(counts: DataFrame) -> DataFrame:
    stack = ", ".join(f"'{m}', {m}" for m in MEASURES)
    return counts.select("dataset", F.expr(f"stack({len(MEASURES)}, {stack}) AS (measure, n)"))


def token_stats(counts: DataFrame, exact: bool = True) -> DataFrame:
    """Per dataset and measure: total, mean, median, max, min, p95, std.

    Percentiles interpolate linearly (numpy's default); the standard
    deviation is the population one.  ``exact=False`` switches the two
    percentiles to the mergeable sketch ``percentile_approx`` for very large
    datasets; the exact form keeps a value -> count map, which stays small
    for token counts.
    """
    lf = _long_form(counts)
    if exact:
        med, p95 = F.median("n"), F.percentile(F.col("n"), 0.95)
    else:
        med = F.percentile_approx("n", 0.5, 10000).cast("double")
        p95 = F.percentile_approx("n", 0.95, 10000).cast("double")
    return lf.groupBy("dataset", "measure").agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.sum("n").alias("total"),
        F.avg("n").alias("mean"),
        med.cast("double").alias("median"),
        F.max("n").alias("max"),
        F.min("n").alias("min"),
        p95.cast("double").alias("p95"),
        F.stddev_pop("n").alias("std_dev"),
    )


def token_histogram(counts: DataFrame, bins: int = N_BINS) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed).

    All ``bins`` bins are returned, empty ones with 0.  A constant measure
    uses the range ``[v - 0.5, v + 0.5]`` like numpy.
    """
    lf = _long_form(counts)
    rng = lf.groupBy("dataset", "measure").agg(F.min("n").alias("lo"), F.max("n").alias("hi")) \
        .withColumn("lo_e", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))) \
        .withColumn("hi_e", F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")))
    j = lf.join(rng, ["dataset", "measure"])
    b = F.floor((F.col("n") - F.col("lo_e")) * bins / (F.col("hi_e") - F.col("lo_e")))
    j = j.withColumn("bin", F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int"))
    cnt = j.groupBy("dataset", "measure", "bin").agg(F.count(F.lit(1)).alias("n_examples"))
    allb = rng.select("dataset", "measure", "lo_e", "hi_e",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi_e") - F.col("lo_e")) / bins
    return allb.join(cnt, ["dataset", "measure", "bin"], "left").select(
        "dataset", "measure", "bin",
        (F.col("lo_e") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo_e") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"))


def token_summary(counts: DataFrame) -> DataFrame:
    """One line per dataset ordered by size, plus a ``TOTAL`` line."""
    r = counts.rollup("dataset").agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.sum("combined_tokens").alias("total_tokens"),
        F.avg("input_tokens").alias("avg_input"),
        F.avg("output_tokens").alias("avg_output"),
        F.grouping_id().alias("_g"),
    )
    r = r.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("dataset")).alias("dataset"),
                 "num_examples", "total_tokens",
                 F.when(F.col("_g") == 1, F.lit(None)).otherwise(F.col("avg_input")).alias("avg_input"),
                 F.when(F.col("_g") == 1, F.lit(None)).otherwise(F.col("avg_output")).alias("avg_output"),
                 "_g")
    # Report order: datasets by size, TOTAL last (one row per dataset).
    return r.orderBy("_g", "num_examples", "dataset").drop("_g")


def conversation_tokens(turns: DataFrame, limit: int = TOKEN_LIMIT, counter=word_piece_count) -> DataFrame:
    """Tokens per conversation of ``ts speaker: content`` lines, over-limit flag."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("speaker"),
                    F.lit(": "), F.col("content"))
    t = turns.select("owner_id", "thread_id", "conv_no", counter(line).alias("n"))
    return t.groupBy("owner_id", "thread_id", "conv_no").agg(F.sum("n").alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > limit)


def corpus_tokens(per_conversation: DataFrame) -> DataFrame:
    """Conversations, tokens and conversations over the limit per owner, and of all (``owner_id`` null).

    ``per_conversation``: :func:`conversation_tokens`; its rows over the limit are the warnings.
    """
    return per_conversation.rollup("owner_id").agg(
        F.count("*").alias("n_conversations"), F.sum("n_tokens").alias("total_tokens"), F.max("n_tokens").alias("longest"),
        F.count_if("over_limit").alias("n_over_limit"))


def over_limit(per_conversation: DataFrame) -> DataFrame:
    """The conversations over the limit."""
    return per_conversation.filter("over_limit").drop("over_limit")


def status_counts(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Rows per status (kept / dropped / taken ...)."""
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
