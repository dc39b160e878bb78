"""Streams against the batch forms: several batches, rows out of order, late rows, empty streams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators import conversations as conv
from chatlake.streaming import sessions as stm

MSG = "owner_id string, thread_id string, seq long, ts timestamp, speaker string, content string, is_reply boolean, reply_info string"


def messages(n=160, seed=3):
    r = random.Random(seed)
    out = []
    for t in range(4):
        clock = 1_700_000_000
        for k in range(n // (1 + 3 * (t > 0))):  # one thread holds most rows
            clock += r.choice([0, 30, 3600, 6 * 3600, 6 * 3600 + 1, 9 * 3600])
            reply = r.random() < 0.2
            out.append(("o", f"t{t}", 1000 * t + k, clock, r.choice(["Me", "Al", "Bo"]), r.choice([f"m{k}", "", None]), reply, f"r{k}" if reply else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, MSG.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).select(*[c.split()[0] for c in MSG.split(", ")])


def streamed(spark, folder, batches):
    seen = set()
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        for path in set(glob.glob(f"{folder}/*.parquet")) - seen:  # read in this order, one file a batch
            os.utime(path, (1_700_000_000 + 10 * k,) * 2)
            seen.add(path)
    return spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).parquet(folder)


CLOCK = [("x", "clock", 10**9, 1_900_000_000, "clock", "", False, None)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_turns_of_many_batches_equal_the_batch_form(spark, tmpdir_path, shuffled):
    rows = sorted(messages(), key=lambda m: (m[3], m[2]))
    r = random.Random(5)
    if shuffled:  # out of order by less than the watermark
        rows.sort(key=lambda m: m[3] + r.randint(0, 2 * 3600))
    cuts = [rows[k:k + 70] for k in range(0, len(rows), 70)]
    stream = streamed(spark, f"{tmpdir_path}/in", [*cuts, CLOCK])
    got = stm.append_to_files(stm.stream_turns(stream, watermark="3 hours"), "turns")
    want = conv.merge_turns(frame(spark, rows))
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0


def test_open_turns_wait_and_late_rows_go(spark, tmpdir_path):
    one = [("o", "t", 1, 1000, "Me", "a", False, None), ("o", "t", 2, 1010, "Me", "b", True, "r"), ("o", "t", 3, 200_000, "Al", "c", False, None)]
    late = [("o", "t", 0, 500, "Zed", "late", False, None), ("o", "t", 4, 200_001, "Al", "d", False, None)]
    # Spark drops what the watermark of the batch before had passed, so a second row of the clock comes first.
    stream = streamed(spark, f"{tmpdir_path}/in", [one, CLOCK, CLOCK, late])
    rows = stm.append_to_files(stm.stream_turns(stream, watermark="1 hour"), "turns").collect()
    assert sorted((r.conv_no, r.turn_idx, r.speaker, r.content, r.is_reply, r.reply_info, r.n_msgs) for r in rows) == [
        (0, 0, "Me", "a<|msg|>b", True, "r", 2), (1, 0, "Al", "c", False, None, 1)]  # the last message came after the clock
    empty = streamed(spark, f"{tmpdir_path}/none", [[]])
    assert stm.append_to_files(stm.stream_turns(empty), "turns").count() == 0


def test_sessions_append_and_counts_update(spark, tmpdir_path):
    rows = sorted(messages(), key=lambda m: (m[3], m[2]))
    cuts = [rows[k:k + 90] for k in range(0, len(rows), 90)]
    stream = streamed(spark, f"{tmpdir_path}/in", [*cuts, CLOCK])
    got = stm.append_to_files(stm.stream_sessions(stream), "sessions").select("thread_id", "n_msgs", "first_ts", "last_ts")
    want = conv.sessionize(frame(spark, rows)).groupBy("thread_id", "conv_no").agg(F.count("*").alias("n_msgs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("conv_no")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    reasons = streamed(spark, f"{tmpdir_path}/in2", cuts).select("ts", F.when(F.col("speaker") != "Me", F.col("speaker")).alias("reject_reason"))
    out = f"{tmpdir_path}/out"
    counts = stm.update_files(stm.reject_counts(reasons, watermark="30 days"), "counts", ["w", "reject_reason"], out)
    want = frame(spark, rows).filter("speaker <> 'Me'").groupBy(F.window("ts", "1 day").alias("w"), F.col("speaker").alias("reject_reason")).agg(F.count("*").alias("n"))
    assert counts.exceptAll(want).count() == 0 and counts.count() == want.count()
    # Several batches updated the same keys, and only the latest counts.
    assert spark.read.parquet(out).count() > counts.count()
    none = streamed(spark, f"{tmpdir_path}/none", [[]]).select("ts", F.col("speaker").alias("reject_reason"))
    assert stm.update_files(stm.reject_counts(none), "counts", ["w", "reject_reason"]).count() == 0


def test_turns_of_many_threads_share_few_states(spark, tmpdir_path):
    rows = [(f"o{t % 3}", f"t{t}", 100 * t + k, 1_700_000_000 + 60 * k, "Me" if k % 3 else "Al", f'm"{k}\n', k == 2, "r" if k == 2 else None)
            for t in range(60) for k in range(7)]
    stream = streamed(spark, f"{tmpdir_path}/in", [rows[::2], rows[1::2], CLOCK, CLOCK])
    name = "turns_of_many"
    q = (stm.stream_turns(stream, watermark="3 hours", shards=8).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got, want = spark.table(name), conv.merge_turns(frame(spark, rows))
    assert got.count() == want.count() == 60 * 5 and got.exceptAll(want).count() == 0
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 8  # before: a state a thread
