"""Structured Streaming forms (ST1-ST3) and turn merging on a stream.

* ST1: conversations on arriving messages with ``session_window`` and a
  watermark.  A gap of exactly ``max_gap`` keeps the session open, a larger
  one splits it, as in the batch rule; rows later than the watermark are
  dropped (the batch form never drops).
* C02: turns on arriving messages, by keyed state that holds the open turn,
  the conversation's number and the messages that the watermark has not passed;
  threads share a state by a hash.
* ST2: contact resolution on a stream, one micro-batch at a time through
  ``foreachBatch`` with the batch operator (the contact table is static).
* ST3: running reject counts per day and reason in update mode.

Results go to files: appended rows through the file sink, whose log makes a
repeated batch harmless, and updated rows into one folder a batch, of which
the latest per key counts.  Stream checkpoints and results live under the
cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatlake.functions.text import MSG_DELIM
from chatlake.session import ensure_checkpoint_dir


def _folder(spark: SparkSession, kind: str, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{name}-{uuid.uuid4().hex}"


def stream_sessions(msgs: DataFrame, max_gap: str = "6 hours", watermark: str = "6 hours") -> DataFrame:
    """ST1: one row per (owner, thread, session) on a streaming ``messages`` frame."""
    return (msgs.withWatermark("ts", watermark)
            .groupBy("owner_id", "thread_id", F.session_window("ts", max_gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_msgs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


TURN = ("owner_id string, thread_id string, conv_no int, turn_idx int, us long, speaker string, content string, "
        "is_reply boolean, reply_info string, n_msgs int")
#: What a message has, in the order in which it waits.
MESSAGE = ["us", "seq", "speaker", "content", "is_reply", "reply_info"]
#: Groups of threads that share a state.
SHARDS = 4096


class _Thread:
    """The open turn of one thread; ``add`` returns the turn that a message closes."""

    def __init__(self, key: tuple, kept: list | None = None):
        self.key = key
        (self.conv_no, self.turn_idx, self.last_us, self.speaker, self.content, self.is_reply, self.reply_info,
         self.n_msgs, self.waiting) = kept or (-1, 0, 0, None, None, False, None, 0, [])

    def close(self) -> tuple:
        turn = (*self.key, self.conv_no, self.turn_idx, self.last_us, self.speaker, self.content or "", self.is_reply,
                self.reply_info, self.n_msgs)
        self.content, self.is_reply, self.reply_info, self.n_msgs = None, False, None, 0
        return turn

    def add(self, message: list, gap_us: int) -> list[tuple]:
        us, _, speaker, content, is_reply, reply_info = message
        split = self.conv_no < 0 or us - self.last_us > gap_us
        other = split or speaker != self.speaker
        done = [self.close()] if other and self.n_msgs else []
        if split:
            self.conv_no, self.turn_idx = self.conv_no + 1, 0
        elif other:
            self.turn_idx += 1
        parts = [c for c in (self.content, content) if c is not None]
        self.content = MSG_DELIM.join(parts) if parts else None
        self.last_us, self.speaker, self.n_msgs = us, speaker, self.n_msgs + 1
        if is_reply:
            self.is_reply, self.reply_info = True, reply_info
        return done

    def advance(self, passed: int, gap_us: int) -> list[tuple]:
        """The turns that are closed once all messages before ``passed`` are known."""
        ready = sorted((m for m in self.waiting if m[0] < passed), key=lambda m: (m[0], m[1]))
        self.waiting = [m for m in self.waiting if m[0] >= passed]
        out = [turn for m in ready for turn in self.add(m, gap_us)]
        if self.n_msgs and self.last_us + gap_us < passed:
            out.append(self.close())
        return out

    def wake(self, gap_us: int) -> list[int]:
        """Times that the watermark must pass for something to happen."""
        return [m[0] for m in self.waiting] + ([self.last_us + gap_us] if self.n_msgs else [])

    def state(self) -> tuple:
        return (*self.key, self.conv_no, self.turn_idx, self.last_us, self.speaker, self.content, self.is_reply, self.reply_info,
                self.n_msgs, self.waiting)


def stream_turns(msgs: DataFrame, max_gap_hours: float = 6.0, watermark: str = "6 hours", shards: int = SHARDS) -> DataFrame:
    """C01/C02 on a streaming ``messages`` frame: merged turns, each once, when it is closed.

    Messages of a thread count in the order of ``(ts, seq)``, whatever order they arrive in: each waits in
    the thread's state until the watermark has passed it.  Where ``ts`` never falls as ``seq`` rises, and
    no row is later than the watermark (later ones are dropped), the turns are those of the batch form.
    A turn closes with the next message of another speaker or conversation, or when the watermark has
    passed the gap after its last message; then only the thread's counters stay in its state.

    Spark hands each group to Python in frames of its own, at some milliseconds a group and batch, so
    threads are grouped by a hash into ``shards`` states.  A state is read and written as a whole.
    """
    import pandas as pd

    gap_us = int(round(max_gap_hours * 3_600_000_000))
    names = [c.split()[0] for c in TURN.split(", ")]

    def step(key: tuple, frames, state: GroupState):
        threads = {(owner, thread): _Thread((owner, thread), kept) for owner, thread, *kept in json.loads(state.get[0])} if state.exists else {}
        for pdf in frames:
            for m in json.loads(f"[{','.join(pdf['message'])}]"):
                of = m["owner_id"], m["thread_id"]
                if of not in threads:
                    threads[of] = _Thread(of)
                threads[of].waiting.append([m[name] for name in MESSAGE])
        passed = state.getCurrentWatermarkMs() * 1000
        out = [turns for thread in threads.values() if (turns := thread.advance(passed, gap_us))]
        wake = [us for thread in threads.values() for us in thread.wake(gap_us)]
        state.update((json.dumps([thread.state() for thread in threads.values()]),))
        if wake:
            state.setTimeoutTimestamp(max(min(wake) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"turns": [json.dumps([dict(zip(names, turn)) for turn in turns]) for turns in out]})

    owner, thread = F.col("owner_id").cast("string").alias("owner_id"), F.col("thread_id").cast("string").alias("thread_id")
    message = F.struct(owner, thread, F.unix_micros("ts").alias("us"), "seq", "speaker", "content",
                       F.coalesce("is_reply", F.lit(False)).alias("is_reply"), "reply_info")
    rows = msgs.withWatermark("ts", watermark).select(F.pmod(F.xxhash64(owner, thread), F.lit(shards)).alias("shard"), "ts",
                                                      F.to_json(message, {"ignoreNullFields": "false"}).alias("message"))
    turns = rows.groupBy("shard").applyInPandasWithState(step, "turns string", "threads string", "append", GroupStateTimeout.EventTimeTimeout)
    row = ", ".join(f"{name}: {kind}" for name, kind in map(str.split, TURN.split(", ")))
    turns = turns.select(F.inline(F.from_json("turns", f"array<struct<{row}>>")))
    return turns.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")


def reject_counts(features: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """ST3: rejected examples per event-time window and reason."""
    return (features.filter(F.col("reject_reason").isNotNull()).withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "reject_reason").agg(F.count(F.lit(1)).alias("n")))


def append_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` over everything available in append mode into a Parquet table, and read that."""
    spark = stream.sparkSession
    out = _folder(spark, "tables", name)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", _folder(spark, "streams", name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def update_files(stream: DataFrame, name: str, keys: list[str], out: str | None = None) -> DataFrame:
    """Run ``stream`` over everything available in update mode, and return the latest row of each key.

    Every batch replaces its own folder ``batch=N`` of ``out``, so a replayed batch adds nothing.
    """
    spark = stream.sparkSession
    out = out or _folder(spark, "tables", name)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = (stream.writeStream.outputMode("update").foreachBatch(each)
         .option("checkpointLocation", _folder(spark, "streams", name)).trigger(availableNow=True).start())
    q.awaitTermination()
    # A stream without data has no batch: its table is empty, not missing.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def resolve_stream(texts: DataFrame, contacts: DataFrame, key_cols: list[str], out_path: str,
                   text_col: str = "text") -> DataFrame:
    """ST2: resolve phone numbers on a stream; each micro-batch runs the
    batch operator against the static contact table and replaces
    its own folder ``batch=N`` of ``out_path``, so a replayed batch adds nothing.
    Returns the rows of ``out_path``."""
    from chatlake.operators.ingest import resolve_phones

    def each(batch: DataFrame, epoch: int) -> None:
        resolve_phones(batch, contacts, key_cols, text_col).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    spark = texts.sparkSession
    q = (texts.writeStream.foreachBatch(each).option("checkpointLocation", _folder(spark, "streams", "resolve"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # A stream without data has no batch: its table is empty, not missing.
    schema = texts.schema.add("resolved", "string")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_path}/batch=-1")
    return spark.read.schema(schema).parquet(out_path)
