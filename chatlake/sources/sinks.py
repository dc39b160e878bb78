"""Sinks (S06-S10, S13-S15): Parquet/JSON writers and stage tables.

Writers never overwrite sources; paths are folders written by Spark
(``mode='overwrite'`` only replaces the target folder).  Ordering for
export files is kept as a column (``pos``) rather than relying on file order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.subsets import duplicate_rows


TURN = ("owner_id string, thread_id string, conv_no int, turn_idx int, ts timestamp, speaker string, content string, "
        "is_reply boolean, reply_info string, n_msgs int")
MESSAGES = "array<struct<content: string, speaker: string, timestamp: string, is_reply: boolean, reply_info: string, n_msgs: int>>"
STAMP = "yyyy-MM-dd HH:mm:ss"


def write_turns(turns: DataFrame, path: str) -> None:
    """The ``turns`` table, partitioned by owner."""
    turns.write.mode("overwrite").partitionBy("owner_id").parquet(path)


def _conversations(turns: DataFrame, *more: str) -> DataFrame:
    """One row per conversation with its messages in order."""
    msg = F.struct("content", "speaker", F.date_format("ts", STAMP).alias("timestamp"), "is_reply", "reply_info", "n_msgs")
    return turns.groupBy("owner_id", "thread_id", "conv_no", *more).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", msg.alias("m")))), lambda x: x["m"]).alias("messages"))


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt into ranges of ``order`` and sorted: the files of a folder, by name, hold them in that order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_conversations_json(turns: DataFrame, path: str) -> None:
    """One JSON line per conversation holding its messages in order; files by owner, in thread order."""
    rows = _in_order(_conversations(turns), ["owner_id", "thread_id", "conv_no"])
    rows.write.mode("overwrite").partitionBy("owner_id").json(path)


def read_conversations_json(spark: SparkSession, path: str) -> DataFrame:
    """``turns`` from the conversation files, with ``store_rank`` where a store was written.

    Corrupt lines raise an error.
    """
    raw = spark.read.schema(f"owner_id string, thread_id string, conv_no int, store_rank int, messages {MESSAGES}") \
        .option("mode", "FAILFAST").json(path)
    m = raw.select("owner_id", "thread_id", "conv_no", "store_rank", F.posexplode("messages").alias("turn_idx", "m"))
    return m.select("owner_id", "thread_id", "conv_no", "turn_idx", F.to_timestamp("m.timestamp", STAMP).alias("ts"), "m.speaker", "m.content",
                    "m.is_reply", "m.reply_info", "m.n_msgs", "store_rank")


def write_store(turns: DataFrame, store: DataFrame, path: str) -> None:
    """The conversations of a store (see ``conversation_store``) as JSON lines, the newest first."""
    rows = _conversations(turns.join(store.select("owner_id", "thread_id", "conv_no", "store_rank"), ["owner_id", "thread_id", "conv_no"]), "store_rank")
    _in_order(rows, ["owner_id", "store_rank"]).write.mode("overwrite").partitionBy("owner_id").json(path)


EXAMPLE = "instruction string, input string, output string, timestamp string"


def write_dataset(rows: DataFrame, path: str) -> None:
    """Sets of examples as JSON lines, a folder for each owner and set, in the order of ``pos``.

    ``rows``: ``(subset_name, pos, ...)`` as from ``dataset_rows``; plain examples are written as the set
    ``full`` in key order.
    """
    if "subset_name" not in rows.columns:
        rows = rows.withColumn("subset_name", F.lit("full")).withColumn("pos", F.lit(None).cast("int"))
    key = ["thread_id", "conv_no", "turn_idx"]
    rows = rows.select("owner_id", "subset_name", "pos", *key, "instruction", "input", "output", F.date_format("ts", STAMP).alias("timestamp"))
    _in_order(rows, ["owner_id", "subset_name", "pos", *key]).write.mode("overwrite").partitionBy("owner_id", "subset_name").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_dataset`` wrote; corrupt lines raise an error."""
    return spark.read.schema(f"owner_id string, subset_name string, pos int, thread_id string, conv_no int, turn_idx int, {EXAMPLE}") \
        .option("mode", "FAILFAST").json(path)


def write_prompt_completion(subsets: DataFrame, path: str, factors: dict[str, int] | None = None) -> None:
    """S09 + T23: ``{prompt, completion}`` lines per set in the order of ``pos``, rows repeated by factor."""
    d = duplicate_rows(subsets, factors)
    owner = ["owner_id"] if "owner_id" in d.columns else []
    d = d.select(*owner, "subset_name", "pos", "copy", F.col("input").alias("prompt"), F.col("output").alias("completion"))
    _in_order(d, [*owner, "subset_name", "copy", "pos"]).write.mode("overwrite").partitionBy(*owner, "subset_name").json(path)


def read_prompt_completion(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``write_prompt_completion`` wrote for sets with an owner; corrupt lines raise an error."""
    return spark.read.schema("owner_id string, subset_name string, pos int, copy int, prompt string, completion string") \
        .option("mode", "FAILFAST").json(path)


def write_stats(stats: DataFrame, path: str, fmt: str = "json") -> None:
    """Statistics tables as JSON or CSV (header)."""
    w = stats.coalesce(1).write.mode("overwrite")   # a handful of rows per dataset
    (w.option("header", "true").csv(path) if fmt == "csv" else w.json(path))


def _written(spark: SparkSession, path: str) -> bool:
    """Whether Spark has finished writing the folder; any error in looking is raised."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def refresh_embedding_cache(spark: SparkSession, memories: DataFrame, cache_path: str, encoder, model: str) -> DataFrame:
    """S14 + R01: embed memories missing from the cache and append them.

    The cache is a Parquet table keyed by ``(owner_id, mem_id, model)``; only
    the left-anti remainder is encoded.
    """
    from chatlake.operators.retrieval import embed_missing

    if _written(spark, cache_path):
        cache = spark.read.parquet(cache_path)
    else:  # first run: no cache yet
        cache = spark.createDataFrame([], "owner_id string, mem_id long, model string, embedding array<float>")
    new = embed_missing(memories, cache, encoder, model)
    new.write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path)


def stage_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a stage's table if it was written before, else build and write it."""
    if not _written(spark, path):   # absent, or left by a run that was cut off
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
