"""Operator 9: benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words: its hash ignores the words at the masked-out places, so a
passage with substituted words still shares seeds with its source.  The masks below leave at least
one seed untouched whichever two of WINDOW words are substituted.  Seeds of the documents are
tested against a bit table of the benchmark's seeds in place; the stretches around hits, joined to
the benchmark by exact seed hash, are verified word by word on their diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER, mapped, mixed, runs, slices, span_hashes, staged, utf8

WINDOW = 13
SUBSTITUTIONS = 2
#: Benchmark texts of fewer words say nothing about a document that holds them.
LEAST_WORDS = 5
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 5, 8, 9), (0, 1, 3, 6, 8, 9, 10))

#: Bits of the benchmark's table, whatever its rows (2 MB).  A fuller table lets more stretches through to the exact join.
FILTER_BITS = 24

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = 1
_FACTOR = mixed(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and bytes from 128 on; A-Z lowered), their rows, and where each row's begin."""
    data, at = utf8(column)
    start, end, row = runs(_WORD[data], at)
    return span_hashes(LOWER[data], start, end), row, np.searchsorted(row, np.arange(len(at)))


def seeds(words: np.ndarray, row: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at each place where the mask fits in one row, and the places."""
    span = mask[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(row[:n] == row[span - 1:])
    total = np.full(len(place), salt, np.uint64)
    for k, offset in enumerate(mask):
        total += words[place + offset] * _FACTOR[k]
    return mixed(total), place


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(salt, mask): the spaced ones, and for each length under WINDOW among the benchmark's texts one without gaps."""
    return [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in short)]


def benchmark_words(benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(item_id, words) of every row with at least ``least`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, _, at = words_of(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "words"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, words array<long>") \
        .filter(F.size("words") >= max(least, 1)).distinct().withColumn("item", F.xxhash64("item_id", "words"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, place) of all seeds: the spaced ones of texts of WINDOW words or more, whole shorter texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                own = np.array(words, np.int64).view(np.uint64)
                masks = _masks([])[:len(MASKS)] if len(own) >= WINDOW else _masks([len(own)])[len(MASKS):]
                for salt, mask in masks:
                    seed, place = seeds(own, np.zeros(len(own), np.int64), mask, salt)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array([item] * len(seed), pa.int64()), pa.array(place)], ["seed", "item", "place"])

    return items.select("item", "words").mapInArrow(run, "seed long, item long, place long")


def _filter_table(known: DataFrame) -> np.ndarray:
    """Bit table of the seeds' leading bits: at most 2 ** FILTER_BITS bits come to the driver, in chunks of 4 KB."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1  # Spark numbers bits from one
    rows = known.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("k")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    table = np.zeros((1 << FILTER_BITS) // 8 + 8192, np.uint8)
    for r in rows:
        first = (r.k - 1) * 4096
        table[first:first + 4096] |= np.frombuffer(r.bits, np.uint8)
    return table


def stretches(docs: DataFrame, table: np.ndarray, short: list[int]) -> DataFrame:
    """(doc_id, mark, words, hits): the words around runs of seeds that the bit table knows; hits: seed and its place in words."""
    held = docs.sparkSession.sparkContext.broadcast(table)
    masks = _masks(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches):
            words, row, at = words_of(batch.column("text"))
            found = []
            for salt, mask in masks:
                seed, place = seeds(words, row, mask, salt)
                slot = (seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                found.append((seed[hit], place[hit]))
            seed, place = (np.concatenate(x) for x in zip(*found))
            if not len(seed):
                continue
            order = np.argsort(place, kind="stable")
            seed, place = seed[order], place[order]
            own = row[place]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] - place[:-1] > 2 * WINDOW)))
            last = np.append(new[1:], len(place)) - 1
            of = own[new]
            begin = np.maximum(place[new] - WINDOW, at[of])
            end = np.minimum(place[last] + 2 * WINDOW, at[of + 1])
            length = end - begin
            edge = np.append(0, np.cumsum(length))
            inside = np.arange(edge[-1]) - np.repeat(edge[:-1] - begin, length)
            offset = place - np.repeat(begin, last + 1 - new)
            hits = pa.ListArray.from_arrays(pa.array(np.append(new, len(place)).astype(np.int32)),
                                            pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(offset)], ["seed", "offset"]))
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(words[inside].view(np.int64)))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("mark").take(take), lists, hits], ["doc_id", "mark", "words", "hits"])

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), run,
                  "doc_id long, mark long, words array<long>, hits array<struct<seed:long,offset:long>>")


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(words equal, words spanned) by the windows on one diagonal with at most SUBSTITUTIONS unequal words; shorter items must fit whole.

    ``shift``: the place in text of the item's first word.
    """
    size = min(WINDOW, len(item))
    allowed = SUBSTITUTIONS if len(item) >= WINDOW else 0
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi - lo < size:
        return 0, 0
    same = text[lo + shift:hi + shift] == item[lo:hi]
    total = np.append(0, np.cumsum(same))
    good = np.flatnonzero(total[size:] - total[:-size] >= size - allowed)
    if not len(good):
        return 0, 0
    cover = np.zeros(len(same) + 1, np.int64)
    np.add.at(cover, good, 1)
    np.add.at(cover, good + size, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return int((same & inside).sum()), int(inside.sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, mark, n_equal, n_span, n_item): documents that hold a passage of a benchmark text.

    A passage is a window of 13 words with at most 2 substituted, or the whole of a shorter text of
    ``least`` words or more; n_equal and n_span count the equal and the covered words of the best
    diagonal (most equal words, then most covered), n_item the item's.  Words are compared by 64-bit
    hashes.  mark is xxhash64(text).  Null, empty and wordless texts, here or in the benchmark, match
    nothing; equal rows give one row; an empty table on either side gives an empty table.
    """
    items = staged(benchmark_words(benchmark, least), "items")
    known = staged(benchmark_seeds(items), "seeds")
    short = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words") < WINDOW).distinct().collect())  # 12 lengths at most
    found = staged(stretches(docs, _filter_table(known), short).withColumn("stretch", F.xxhash64("doc_id", "mark", "words")), "stretches")
    met = found.select("stretch", F.explode("hits").alias("hit")).select("stretch", "hit.seed", "hit.offset") \
        .join(known, "seed").select("stretch", "item", (F.col("offset") - F.col("place")).alias("shift")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = [overlap(np.array(t, np.int64), np.array(i, np.int64), s) for t, i, s in
                       zip(part.column("text").to_pylist(), part.column("words").to_pylist(), part.column("shift").to_pylist())]
                equal, span = (pa.array(x, pa.int64()) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "mark", "item_id", "n_item")), equal, span],
                                                 ["doc_id", "mark", "item_id", "n_item", "n_equal", "n_span"])

    text = found.select("doc_id", "mark", "stretch", F.col("words").alias("text")).dropDuplicates(["stretch"])
    rows = met.join(text, "stretch").join(items, "item") \
        .select("doc_id", "mark", "item_id", F.size("words").cast("long").alias("n_item"), "text", "words", "shift") \
        .mapInArrow(verify, "doc_id long, mark long, item_id long, n_item long, n_equal long, n_span long").filter("n_span > 0")
    return rows.groupBy("doc_id", "item_id", "mark").agg(F.max(F.struct("n_equal", "n_span", "n_item")).alias("best")).select("doc_id", "item_id", "mark", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a passage of a benchmark text (see ``contaminated``).

    Rows with a null or empty text stay, repeated rows go or stay together, an empty table stays empty.
    """
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]
    at_id, at_text = inner[names.index("doc_id")], inner[names.index("text")]
    plain = docs.toDF(*inner)
    bad = contaminated(plain.select(F.col(at_id).alias("doc_id"), F.col(at_text).alias("text")), benchmark, least).select("doc_id", "mark").distinct()
    fits = plain[at_id].eqNullSafe(bad["doc_id"]) & (F.xxhash64(plain[at_text]) == bad["mark"])
    return plain.join(bad, fits, "left_anti").toDF(*names)
