"""Substring join: which phrases occur in which texts, through an index on each phrase's rarest gram.

A gram is a run of ``GRAM`` bytes of UTF-8 (a shorter phrase is its own gram), as an integer, so equal
grams are equal bytes.  One pass over the texts counts the grams that phrases have; each phrase then
goes by the gram that the fewest texts hold; a second pass keeps the texts that hold a chosen gram,
and only these meet phrases, by an equi-join on the gram, dealt into shares.  ``contains`` decides.
Tasks know the wanted grams by a bit table of fixed size, whatever the number of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.deal import staged

#: Bytes of a gram: at most 8, the size of an integer.
GRAM = 8
#: Bits of the table that tasks get: 512 KB, never more.
TABLE_BITS = 22
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 1 << 20
#: Shares that the texts of each gram are dealt into, so that a gram of a third of all texts has no task to itself.
SHARES = 16

_GRAMS = "array<struct<size: int, gram: long>>"


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bytes from each place of the texts' bytes on, as integers, and where each text begins; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data),), np.dtype("<u8"), padded.data, 0, (1,)).copy(), at - at[0]


def _cut(value: np.ndarray, size: int) -> np.ndarray:
    return value if size == 8 else value & np.uint64((1 << (8 * size)) - 1)


def _bit(size: int, gram: np.ndarray) -> np.ndarray:
    mix = (gram + np.uint64(size * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    return (mix >> np.uint64(64 - TABLE_BITS)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(size) // SLICE_BYTES
        edge = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def phrase_grams(phrases: DataFrame) -> DataFrame:
    """(pid, size, gram) of the distinct grams of each row of ``phrases`` (pid, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            value, at = windows(batch.column(1))
            length = np.diff(at)
            row = np.repeat(np.arange(len(length)), length)
            size = np.minimum(length, GRAM)
            own = np.flatnonzero(at[row + 1] - np.arange(len(value)) >= size[row])
            gram = value[own] & (~np.uint64(0) >> (8 * (8 - size[row[own]])).astype(np.uint64))
            found = np.unique(np.stack([row[own], size[row[own]], gram.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[0])), pa.array(found[1].astype(np.int32)), pa.array(found[2])], ["pid", "size", "gram"])

    return phrases.select("pid", "phrase").mapInArrow(run, "pid long, size int, gram long")


def _bit_table(grams: DataFrame) -> tuple[bytes, list[int]]:
    """Bits of all (size, gram) rows, packed, and the sizes that occur: at most 2^TABLE_BITS bits reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for batch in batches:
            size, gram = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(size):
                place = _bit(int(k), gram[size == k].view(np.uint64))
                np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].astype(np.int32))], ["at", "bits"])

    found = grams.select("size", "gram").mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes(), sorted(r[0] for r in grams.select("size").distinct().collect())


def _bits(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool)


def _held(column: pa.Array, table: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Distinct (row, size, gram) of the texts' grams that the table has, as columns sorted by row."""
    value, at = windows(column)
    found = [np.zeros((3, 0), np.int64)]
    for size in sizes:
        gram = _cut(value, size)
        place = np.flatnonzero(table[_bit(size, gram)])
        row = np.searchsorted(at, place, side="right") - 1
        inside = place + size <= at[row + 1]
        kinds, kind = np.unique(gram[place[inside]], return_inverse=True)
        key = np.unique(row[inside] * max(len(kinds), 1) + kind)
        found.append(np.stack([key // max(len(kinds), 1), np.full(len(key), size), kinds[key % max(len(kinds), 1)].view(np.int64)]))
    both = np.concatenate(found, axis=1)
    return both[:, np.argsort(both[0], kind="stable")]


def substring_join(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, on: list[str] | None = None) -> DataFrame:
    """Rows of ``texts`` with the rows of ``phrases`` whose ``phrase`` their ``text`` contains.

    Both columns must be in the case that is to be compared.  Columns: all of ``texts``, then those of
    ``phrases`` that are not in ``on``; columns in ``on`` must be equal (null equals null).  Null and empty
    phrases and null texts match nothing; repeated rows match each.
    """
    on = on or []
    names, own = texts.columns, [c for c in phrases.columns if c not in on]
    clash = set(own) & set(names)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    dictionary = staged(phrases.filter(F.length(phrase) > 0).select(F.monotonically_increasing_id().alias("pid"), F.col(phrase).alias("phrase"), F.struct(*own).alias("own"), F.struct(F.lit(0).alias("_"), *on).alias("on")))
    grams = staged(phrase_grams(dictionary))
    table, sizes = _bit_table(grams)
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(sent.value)
        for batch in _slices(batches, 0):
            _, size, gram = _held(batch.column(0), bits, sizes)
            for k in np.unique(size):
                kind, n = np.unique(gram[size == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), k, np.int32)), pa.array(kind), pa.array(n)], ["size", "gram", "n"])

    counts = texts.select(text).mapInArrow(count, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    # A phrase with a gram that no text has occurs nowhere; the others go by their rarest gram.
    rarest = grams.join(counts, ["size", "gram"], "left").groupBy("pid") \
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram")).alias("g")).filter("g.n > 0")
    chosen = staged(rarest.select("pid", "g.size", "g.gram").join(dictionary, "pid"))
    table, wanted = _bit_table(chosen)
    marked = spark.sparkContext.broadcast(table)
    at = names.index(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("size", pa.int32()), ("gram", pa.int64())]))
        bits = _bits(marked.value)
        for batch in _slices(batches, at):
            row, size, gram = _held(batch.column(at), bits, wanted)
            rows, begin = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)),
                                             pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(gram)], ["size", "gram"]))
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists.cast(kind)], [*names, "__grams"])

    hit = texts.select(*names).mapInArrow(hold, ", ".join([*fields, f"__grams {_GRAMS}"])) \
        .select(F.monotonically_increasing_id().alias("__row"), F.struct(*names).alias("__text"), "__grams")
    hit = staged(hit)
    postings = hit.select("__row", F.explode("__grams").alias("g"), *([F.struct(F.lit(0).alias("_"), *[F.col(f"__text.{c}") for c in on]).alias("on")])) \
        .select("__row", "g.size", "g.gram", "on", F.pmod(F.xxhash64("__row"), F.lit(SHARES)).alias("share"))
    dealt = chosen.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    same = [F.col(f"p.on.{c}").eqNullSafe(F.col(f"d.on.{c}")) for c in on]
    condition = (F.col("p.size") == F.col("d.size")) & (F.col("p.gram") == F.col("d.gram")) & (F.col("p.share") == F.col("d.share"))
    for s in same:
        condition = condition & s
    pairs = postings.alias("p").join(dealt.alias("d"), condition).select("p.__row", "d.phrase", "d.own")
    out = pairs.join(hit.select("__row", "__text"), "__row").filter(F.contains(F.col(f"__text.{text}"), F.col("phrase")))
    return out.select("__text.*", *[F.col(f"own.{c}").alias(c) for c in own])
