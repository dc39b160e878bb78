"""Dataset subsets: time-spaced greedy sample, tail-N, ladder, validation,
duplication and prompt/completion projection (T17-T24).

The time-spaced subset is a greedy walk: newest row first, then repeatedly
the newest row at least ``gap`` older than the last pick.  On the distinct
timestamps this is a chain ``t -> next(t) = max{t' <= t - gap}`` started at
the newest timestamp.  It is computed in one way for groups of any size:

1. Time is cut into buckets of width ``gap``.  A bucket holds one pick at
   most, so the first ``size`` picks lie in the newest ``2 * size`` buckets
   that hold rows; these are put together into spans of about ``SPAN_NODES``
   timestamps.
2. Each span is summed up in its own task: for every timestamp at which the
   walk can come in, how many picks it makes there and where it leaves.
   Walks that come together have one entry.
3. A walk over the summaries of a group, newest first, jumps over a span in
   one step and says where each span is entered.
4. Each span then walks from its own entry.

All ladder specs run together (the spec is part of every key).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from chatlake.operators.deal import join_dealt, sized, staged
from chatlake.sources.exports import dense_numbers


@dataclass(frozen=True)
class SubsetSpec:
    name: str
    size: int
    gap_hours: float | None  # None: the newest ``size`` rows (tail-N)


# The subset ladder, duplication factors and validation spec.
LADDER = [
    SubsetSpec("B25", 25, 24), SubsetSpec("B50", 50, 12), SubsetSpec("B100", 100, 12),
    SubsetSpec("B250", 250, 4), SubsetSpec("B500", 500, 2), SubsetSpec("B1k", 1000, 1),
    SubsetSpec("B2k", 2000, None), SubsetSpec("B4k", 4000, None), SubsetSpec("B8k", 8000, None),
]
DUPLICATION = {"B25": 4, "B50": 2, "B100": 2, "B250": 1, "B500": 1, "B1k": 1,
               "B2k": 1, "B4k": 1, "B8k": 1}
VALIDATION = SubsetSpec("validation", 200, 1)


SPAN_NODES = 1 << 20   # timestamps that a span holds, about: whole buckets, one at least


def span_steps(asc, gap: int):
    """For each timestamp of a span, ascending, as a pick: how many picks follow it there, itself included, and
    the latest time that the next pick, outside of the span, can have."""
    import numpy as np

    nxt = np.searchsorted(asc, asc - gap, side="right") - 1
    here = np.arange(len(asc))
    last, count, jump = here.copy(), np.ones(len(asc), np.int64), nxt.copy()
    while (jump >= 0).any():  # doubled steps: from each pick to the last one of its walk
        some = jump >= 0
        to = jump[some]
        count[some] += count[to]
        last[some] = last[to]
        jump[some] = jump[to]
    return count, asc[last] - gap


def _pack_span(keys: list[str]):
    """One row for each span: its timestamps, and the entries at which walks part."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        asc = np.sort(table["t"].to_numpy())
        gap = table["gap_us"][0].as_py()
        count, leaves = span_steps(asc, gap)
        # A walk comes in at the newest bucket, or, where nothing there is old enough, at the newest timestamp below it.
        first = int(np.searchsorted(asc, asc[-1] // gap * gap))
        enter = np.arange(max(first - 1, 0), len(asc))
        parts = np.append(True, (np.diff(count[enter]) != 0) | (np.diff(leaves[enter]) != 0))
        at = enter[parts]
        low = asc[at].tolist()
        if enter[0] == 0:
            low[0] = asc[0].item()
        out = {k: table[k].slice(0, 1) for k in keys}
        return pa.table(out | {"sb": table["sb"].slice(0, 1), "gap_us": table["gap_us"].slice(0, 1), "size": table["size"].slice(0, 1), "nodes": pa.array([asc.tobytes()], pa.binary()),
                               "low": pa.array([low], pa.list_(pa.int64())), "n": pa.array([count[at].tolist()], pa.list_(pa.int64())),
                               "leaves": pa.array([leaves[at].tolist()], pa.list_(pa.int64()))})

    return run


def _jump_spans(keys: list[str]):
    """mapInArrow body over summaries sorted by key and span: where each span is entered, and after how many picks."""

    def run(batches: Iterator):
        import bisect

        import pyarrow as pa

        group, until, done = None, None, 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (*keys, "size", "low", "n", "leaves")}
            entry, pos = [], []
            for i in range(batch.num_rows):
                now = tuple(cols[k][i] for k in keys)
                if now != group:
                    group, until, done = now, None, 0   # the walk begins at the newest timestamp
                low = cols["low"][i]
                at = len(low) - 1 if until is None else bisect.bisect_right(low, until) - 1
                inside = done < cols["size"][i] and at >= 0
                entry.append(until if until is not None else (1 << 63) - 1)
                pos.append(done if inside else None)
                if inside:
                    until, done = cols["leaves"][i][at], done + cols["n"][i][at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("sb"), pa.array(entry, pa.int64()), pa.array(pos, pa.int64())],
                                             [*keys, "sb", "entry", "start"])

    return run


def _walk_spans(keys: list[str]):
    """mapInArrow body over spans with their entry: the picks of each."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, t, pos = [], [], []
            for i, (nodes, gap, size, until, done) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("nodes", "gap_us", "size", "entry", "start")])):
                asc = np.frombuffer(nodes, dtype=np.int64)
                at = int(np.searchsorted(asc, until, side="right")) - 1
                while at >= 0 and done < size:
                    row.append(i)
                    t.append(int(asc[at]))
                    pos.append(done)
                    done, at = done + 1, int(np.searchsorted(asc, asc[at] - gap, side="right")) - 1
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(took) for k in keys], pa.array(t, pa.int64()), pa.array(pos, pa.int32())], [*keys, "t", "pos"])

    return run


def greedy_picks(nodes: DataFrame, keys: list[str], span_nodes: int | None = None) -> DataFrame:
    """``(keys, t, pos)`` of the greedy walk over the distinct timestamps ``nodes`` ``(keys, gap_us, size, t)`` of each key."""
    span_nodes = span_nodes or SPAN_NODES
    kinds = ", ".join(f"`{k}` {nodes.schema[k].dataType.simpleString()}" for k in keys)
    nodes = nodes.withColumn("b", F.floor(F.col("t") / F.col("gap_us")))
    newest = W.partitionBy(*keys).orderBy(F.col("b").desc())
    spans = nodes.groupBy(*keys, "size", "b").agg(F.count("*").alias("n")) \
        .withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= 2 * F.col("size")) \
        .withColumn("sb", F.floor((F.sum("n").over(newest.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")) / span_nodes)) \
        .select(*keys, "b", "sb")
    dealt = join_dealt(nodes, staged(spans), [*keys, "b"], "t").select(*keys, "sb", "gap_us", "size", "t")
    packed = staged(dealt.groupBy(*keys, "sb").applyInArrow(
        _pack_span(keys), f"{kinds}, sb long, gap_us long, size int, nodes binary, low array<long>, n array<long>, leaves array<long>"))
    summary = packed.select(*keys, "sb", "size", "low", "n", "leaves").repartition(*keys).sortWithinPartitions(*keys, "sb")
    entries = staged(summary.mapInArrow(_jump_spans(keys), f"{kinds}, sb long, entry long, start long").filter("start is not null"))
    return packed.select(*keys, "sb", "gap_us", "size", "nodes").join(sized(entries), [*keys, "sb"]) \
        .mapInArrow(_walk_spans(keys), f"{kinds}, t long, pos int")


def spaced_subsets(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   specs: list[SubsetSpec], ts_col: str = "ts") -> DataFrame:
    """Subsets per group for every spec, skipping too-small groups.

    Spaced specs pick greedily then fill with the newest unpicked rows;
    tail specs take the newest ``size`` rows.  Ties on the timestamp are
    broken by ``order_cols`` (the first row in that order represents the
    timestamp).  Adds ``subset_name``, ``picked`` and ``pos`` (ascending
    time order inside the subset).  Rows travel whole, so pass key columns
    and join the rest to the result.
    """
    names = df.columns
    keys = ["subset_name", *group_cols]
    rows = df.select(F.struct(*names).alias("row"), *group_cols, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t"),
                     F.struct(*order_cols).alias("rk"))
    most = max(s.size for s in specs)
    # The newest rows, and with them how many a group has (up to the largest size).
    late = W.partitionBy(*group_cols).orderBy(F.col("t").desc_nulls_last(), F.col("rk").desc())
    top = rows.withColumn("r", F.row_number().over(late)).filter(F.col("r") <= most)
    top = staged(top.withColumn("_n", F.count("*").over(W.partitionBy(*group_cols))))
    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("subset_name"), F.lit(s.size).alias("size"), F.lit(int(round(s.gap_hours * 3600e6)) if s.gap_hours else None)
                                        .cast("long").alias("gap_us")) for s in specs])).alias("s")
    wanted = top.filter("r = 1").select(*group_cols, "_n", F.col("t").alias("_newest"), each).select(*group_cols, "_n", "_newest", "s.*") \
        .filter(F.col("_n") >= F.col("size")).drop("_n")
    wanted = staged(wanted)
    tails = top.join(sized(wanted.filter("gap_us is null")), group_cols).filter(F.col("r") <= F.col("size")) \
        .select(*keys, "row", "t", "rk", F.lit(False).alias("picked"))
    spaced = [s.size for s in specs if s.gap_hours]
    if spaced:
        stamps = staged(rows.filter("t is not null").groupBy(*group_cols, "t").agg(F.min(F.struct("rk", "row")).alias("first")))
        gaps = sized(wanted.filter("gap_us is not null"))
        nodes = stamps.join(gaps, group_cols).filter((F.col("t") > 0) | (F.col("t") == F.col("_newest"))).select(*keys, "gap_us", "size", "t")
        picks = staged(greedy_picks(nodes, keys))
        reps = stamps.join(sized(picks.select(*keys, "t")), [*group_cols, "t"]) \
            .select(*keys, "first.row", "t", "first.rk", F.lit(True).alias("picked"))
        # Short walks are filled with the newest rows not picked: these are among the newest ``size``.
        new = W.partitionBy(*group_cols).orderBy(F.col("t").desc_nulls_last(), "rk")
        fill = staged(rows.withColumn("r", F.row_number().over(new)).filter(F.col("r") <= max(spaced)))
        taken = picks.groupBy(*keys).agg(F.count("*").alias("n_picked"))
        fill = fill.join(gaps, group_cols).filter(F.col("r") <= F.col("size")).join(sized(staged(taken)), keys).filter(F.col("n_picked") < F.col("size"))
        stamp = stamps.join(sized(picks.select(*keys, "t")), [*group_cols, "t"]).select(*keys, F.col("first.rk").alias("rk"), F.lit(True).alias("_p"))
        fill = fill.join(sized(staged(stamp)), [*keys, "rk"], "left").filter(F.col("_p").isNull())
        left = W.partitionBy(*keys).orderBy("r")
        fill = fill.withColumn("_f", F.row_number().over(left)).filter(F.col("_f") <= F.col("size") - F.col("n_picked")) \
            .select(*keys, "row", "t", "rk", F.lit(False).alias("picked"))
        tails = tails.unionByName(reps).unionByName(fill)
    in_time = W.partitionBy(*keys).orderBy("t", "rk")
    out = tails.withColumn("pos", F.row_number().over(in_time) - 1)
    return out.select(*[F.col(f"row.{c}").alias(c) for c in names], "subset_name", "picked", "pos")


def tail_subset(df: DataFrame, group_cols: list[str], order_cols: list[str], size: int,
                ts_col: str = "ts") -> DataFrame:
    """Newest ``size`` rows per group (``row_number() <= size``)."""
    w = W.partitionBy(*group_cols).orderBy(F.col(ts_col).desc(), *[F.col(c).desc() for c in order_cols])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r")


def validation_split(df: DataFrame, subsets: DataFrame, group_cols: list[str], order_cols: list[str],
                     spec: SubsetSpec = VALIDATION, ts_col: str = "ts") -> DataFrame:
    """Rows whose timestamp is in no subset, spaced; all of them if fewer."""
    used = staged(subsets.select(*group_cols, ts_col).distinct())  # at most the subsets' sizes a group
    left = staged(df.join(sized(used), [*group_cols, ts_col], "left_anti"))
    small = sized(staged(left.groupBy(*group_cols).agg(F.count("*").alias("_n")).filter(F.col("_n") < spec.size).drop("_n")))
    picked = spaced_subsets(left, group_cols, order_cols, [spec], ts_col)
    rest = left.join(small, group_cols, "left_semi").withColumn("subset_name", F.lit(spec.name)).withColumn("picked", F.lit(False)) \
        .withColumn("pos", F.row_number().over(W.partitionBy(*group_cols).orderBy(ts_col, *order_cols)) - 1)  # fewer than ``size``
    return picked.unionByName(rest)


def dataset_rows(examples: DataFrame, specs: list[SubsetSpec] | None = None, validation: SubsetSpec = VALIDATION) -> DataFrame:
    """T17-T22 end to end: every set of a dataset run, as rows ``(subset_name, pos, *examples)``.

    ``full`` holds all examples by time, then come the subsets of ``specs`` and the validation rows, whose
    timestamps are in no subset; ``pos`` is the place in the set, by time, ties in key order.
    """
    specs = LADDER if specs is None else specs
    key = ["thread_id", "conv_no", "turn_idx"]
    examples = staged(examples)
    light = examples.select("owner_id", *key, "ts")
    ladder = staged(spaced_subsets(light, ["owner_id"], key, specs))
    valid = validation_split(light, ladder, ["owner_id"], key, validation)
    day = light.withColumn("_day", F.date_format("ts", "yyyyMMdd"))
    full = dense_numbers(day, ["owner_id"], "_day", ["ts", *key], "_n").withColumn("pos", (F.col("_n") - 1).cast("int")) \
        .withColumn("subset_name", F.lit("full"))
    cols = ["subset_name", "pos", "owner_id", *key]
    chosen = full.select(*cols).unionByName(ladder.select(*cols)).unionByName(valid.select(*cols))
    return chosen.join(examples, ["owner_id", *key])


def duplicate_rows(subsets: DataFrame, factors: dict[str, int] | None = None) -> DataFrame:
    """Repeat each subset row by its subset's factor (``copy`` = 1..f)."""
    factors = DUPLICATION if factors is None else factors
    fdf = subsets.sparkSession.createDataFrame(list(factors.items()), "subset_name string, factor int")
    j = subsets.join(F.broadcast(fdf), "subset_name", "left").withColumn("factor", F.coalesce("factor", F.lit(1)))
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("factor")))).drop("factor")


def prompt_completion(examples: DataFrame) -> DataFrame:
    """The ``{prompt, completion}`` projection."""
    return examples.select(F.col("input").alias("prompt"), F.col("output").alias("completion"))
