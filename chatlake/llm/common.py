"""Helpers shared by the operators: staged tables, Arrow text slices, word hashes, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is handled in slices of about this many bytes, so a task's memory does not depend on the batch size.
SLICE_BYTES = 2 << 20

#: ASCII white space, the separators of words in the contracts: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the folder that ``spark.checkpoint.dir`` names and read it back.

    This cuts the lineage: a lost executor costs the tasks of one stage, not the work before it.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    path = f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what this process has freed: Spark keeps its Python workers, and they would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose tasks give their memory back, before and after: a worker serves many steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes) // limit).astype(np.int64)
        edges = np.flatnonzero(np.diff(run)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of one non-zero kind, none across two texts."""
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    first = at[:-1]
    edge[first[first < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    some = kind[start] != 0
    start, end = start[some], end[some]
    return start, end, np.searchsorted(at, start, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; equal bytes give equal hashes wherever they stand."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-white bytes, A-Z lowered) and the first word of each row, with the total last."""
    data, at = utf8(column)
    start, end, row = runs((~WHITE[data]).astype(np.uint8), at)
    return span_hashes(LOWER[data] if lower else data, start, end), np.searchsorted(row, np.arange(len(at)))


class HashIndex:
    """Place of each of many distinct uint64 keys, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.missing = len(keys)
        self.keys = np.append(keys, np.uint64(0))
        #: Tables of slots: each holds what the ones before it had no free slot for.
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left, bits, factor = np.arange(len(keys)), max(12, len(keys).bit_length() + 3), 0x9E3779B97F4A7C15
        while len(left) or not self.tables:
            slot = ((keys[left] * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
            slots = np.full(1 << bits, len(keys), np.int32)
            slots[slot] = left
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), slots))
            left = left[slots[slot] != left]
            bits, factor = max(12, bits - 3), (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; ``missing`` for others."""
        factor, shift, slots = self.tables[0]
        place = slots[((keys * factor) >> shift).view(np.int64)]
        miss = np.flatnonzero((self.keys[place] != keys) & (place != self.missing))
        for factor, shift, slots in self.tables[1:]:
            place[miss] = slots[((keys[miss] * factor) >> shift).view(np.int64)]
            miss = miss[(self.keys[place[miss]] != keys[miss]) & (place[miss] != self.missing)]
        place[miss] = self.missing
        return place


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over values[at[i]:at[i+1]] for each i; ``empty`` where there are none."""
    out = np.full((len(at) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = ufunc.reduceat(values, at[some], axis=0)
    return out


#: Keys with many rows that are sent to all tasks.
SENT_KEYS = 200_000


def in_cells(postings: DataFrame, key: str, of: str, limit: int) -> DataFrame:
    """``postings`` with a column ``cell``, partitioned and sorted by (key, cell).

    Keys are counted by an aggregate first, so a key with a third of all rows is dealt out before any shuffle
    of its rows.  Every two rows of a key meet in a cell, and no cell has more than about ``limit`` rows: a larger
    group is split into blocks by a hash of column ``of``, and each pair of blocks is a cell.
    """
    names = postings.columns
    large = staged(postings.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit), "large")
    # Keys with more than ``limit`` rows are at most as many as rows / limit; beyond SENT_KEYS they are joined by a shuffle.
    known = postings.join(F.broadcast(large) if large.count() <= SENT_KEYS else large, key, "left")
    small = known.filter("n is null").withColumn("cell", F.lit(0).cast("long")).select(*names, "cell").repartition(key)
    split = known.filter("n is not null").withColumn("blocks", F.ceil(F.col("n") / F.lit(limit // 2)).cast("long")) \
        .withColumn("block", F.pmod(F.xxhash64(of), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")) \
        .select(*names, "cell").repartition(key, "cell")
    return small.sortWithinPartitions(key, "cell").unionByName(split.sortWithinPartitions(key, "cell"))


def cell_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (key, cell) of more than one row, from batches sorted by both."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        a, b = (now.column(c).to_numpy() for c in (key, "cell"))
        edge = np.append(0, np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1)
        for k in np.flatnonzero(np.diff(edge) > 1):
            yield now.slice(edge[k], edge[k + 1] - edge[k])
        rest = now.slice(edge[-1])  # the last group may go on in the next batch
    if rest is not None and rest.num_rows > 1:
        yield rest


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); root is the least node of its component.

    Alternates two steps over the edge table until it is made of stars only: each node links its
    larger neighbours, then its smaller ones, to the least node that it knows.  Each step is an
    aggregate and an equi-join (skewed centres are split by AQE); each round ends in a staged table.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(least.select("a", F.col("m").alias("b")).unionByName(kept).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
