"""Operator 3: MinHash document fingerprints.

Each of PERMUTATIONS universal hash functions (multiply, add, keep the upper half) ranks the five-word
shingles of a text; the least rank's low 16 bits are one place of its fingerprint, and the share of
equal places estimates the Jaccard similarity of two texts' shingle sets.  Near-duplicates meet in
equal bands of the fingerprint; candidates are verified by the exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import cell_groups, in_cells, mixed, segment_reduce, slices, staged, word_hashes

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32  # of four places: texts of similarity 0.8 share one with a chance of 1 - 4e-8

_FACTOR = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_A = mixed(np.arange(1000, 1000 + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(2000, 2000 + PERMUTATIONS, dtype=np.uint64))
_NONE = np.uint16(0xFFFF)

#: Fingerprints of one band value compared in one task; larger groups are split into pairs of blocks.
CELL = 1024


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SHINGLE-word shingles of each text (the whole text if it has fewer words), and where each text's begin."""
    words, at = word_hashes(column)
    count = np.diff(at)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    edge = np.append(0, np.cumsum(n))
    place = np.arange(edge[-1]) + np.repeat(at[:-1] - edge[:-1], n)
    left = np.repeat(count, n)  # words of a short text are its only ones
    total = np.zeros(len(place), np.uint64)
    for k in range(SHINGLE):
        inside = left > k
        total[inside] += words[place[inside] + k] * _FACTOR[k]
    return mixed(total), edge


def signatures(column: pa.Array) -> np.ndarray:
    """uint16 [texts, PERMUTATIONS]; texts without words have 0xFFFF everywhere."""
    hashes, at = shingles(column)
    x = hashes >> np.uint64(32)
    out = np.empty((len(at) - 1, PERMUTATIONS), np.uint16)
    for k in range(PERMUTATIONS):
        rank = (x * _A[k] + _B[k]) >> np.uint64(32)
        out[:, k] = segment_reduce(np.minimum, rank, at, np.uint64(0xFFFF)).astype(np.uint16)
    return out


def as_bytes(signature: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in signature.astype(">u2")]


RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half (code points, rounded down) replaced by as many first ones of ``following``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    own, changed, ahead = (signatures(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).digest() for e in edited], pa.binary()),
         pa.array(as_bytes(own), pa.binary()), pa.array(as_bytes(changed), pa.binary()), pa.array((own == changed).mean(axis=1)), pa.array((own == ahead).mean(axis=1))],
        [f.split()[0] for f in RESULT.split(", ")])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edit with the next document, and their likenesses (see ``edited_text``).

    Documents follow one another by descending doc_id, then by a hash of the text; null ids go last
    and the first document follows the last.  Equal rows follow one another.  Null texts are empty;
    an empty table gives an empty table.

    Rows are range-partitioned and sorted once.  A task handles all its rows but the last, whose
    follower begins a later partition: first and last rows of the partitions meet in a second step.
    """
    place = (F.col("doc_id").desc_nulls_last(), "mark", "salt")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("salt"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None

        def end(which: str, row: tuple) -> pa.RecordBatch:
            extra = [pa.nulls(1, pa.int64() if n == "n_chars" else pa.float64() if n.startswith("near") else pa.binary()) for n in names[1:]]
            return pa.RecordBatch.from_arrays([pa.array([which]), pa.array([part], pa.int32()), pa.array([row[1]], pa.string()), pa.array([row[0]], pa.int64()), *extra],
                                              ["kind", "part", "text", *names])

        for batch in slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            if first is None:
                first = (ids[0], texts[0])
                yield end("first", first)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1])
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], texts[1:])
                blank = [pa.array(["row"] * done.num_rows), pa.array([part] * done.num_rows, pa.int32()), pa.nulls(done.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays([*blank, *done.columns], ["kind", "part", "text", *names])
        if last is not None:
            yield end("last", last)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _rows(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist())

    made = staged(rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
                  .mapInArrow(run, "kind string, part int, text string, " + RESULT), "fingerprints")
    firsts = made.filter("kind = 'first'").select("part", F.col("text").alias("following"))
    after = Window.orderBy("part")  # one row for each partition, without texts
    parts = firsts.select("part", F.lead("part").over(after).alias("next"), F.min("part").over(Window.partitionBy()).alias("least")) \
        .select(F.col("part").alias("of"), F.coalesce("next", "least").alias("next"))
    lasts = made.filter("kind = 'last'").select("doc_id", "text", "part")
    tails = lasts.join(parts, lasts.part == parts.of).select("doc_id", "text", "next") \
        .join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following").mapInArrow(finish, RESULT)
    return made.filter("kind = 'row'").select(*names).unionByName(tails) \
        .withColumns({n: F.lower(F.hex(n)) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) of every row, and links (a, b, jaccard) between classes, a < b.

    A class holds the rows whose texts have the same shingles; its id is a hash of them (null, empty
    and wordless texts are one class).  Links are pairs of classes that share a band and whose exact
    Jaccard similarity is at least ``threshold``; a pair is judged in its first common band only.
    """
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingles(batch.column("text"))
            signature = signatures(batch.column("text"))
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
            classes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array([r.tobytes() for r in signature], pa.binary())],
                                             ["doc_id", "class_id", "shingles", "signature"])

    rows = staged(docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, class_id long, shingles array<long>, signature binary"), "minhash")
    classes = rows.filter("size(shingles) > 0").select("class_id", "signature").distinct()
    width = 2 * PERMUTATIONS // BANDS
    bands = classes.select("class_id", "signature", F.posexplode(F.array(*[F.substring("signature", 1 + k * width, width) for k in range(BANDS)])).alias("band", "value")) \
        .select(F.xxhash64("band", "value").alias("key"), "band", "class_id", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cell_groups(batches, "key"):
            ids, band = group.column("class_id").to_numpy(), group.column("band")[0].as_py()
            places = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(ids), BANDS, -1)
            for i in range(len(ids) - 1):
                same = places[i + 1:] == places[i]
                whole = same.all(axis=2)
                near = np.flatnonzero((whole.argmax(axis=1) == band) & whole[:, band] & (same.mean(axis=(1, 2)) >= threshold - 0.25)) + i + 1
                if len(near):
                    a, b = np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = in_cells(bands, "key", "class_id", CELL).mapInArrow(compare, "a long, b long").filter("a < b").distinct()
    sets = rows.groupBy("class_id").agg(F.min("shingles").alias("shingles"))
    common = F.size(F.array_intersect("left", "right"))
    linked = met.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("left")), "a") \
        .join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("right")), "b") \
        .withColumn("common", common).withColumn("jaccard", F.col("common") / (F.size("left") + F.size("right") - F.col("common"))) \
        .filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")
    return rows.select("doc_id", "class_id"), linked
