"""Operator 10: SimHash near-duplicates through an inverted index of positional bytes.

Fingerprints that differ in at most d bits differ in at most d of their 8 bytes, so they share at
least 8 - d bytes by position.  Postings of single bytes would pair nearly all fingerprints, so the
index is kept on groups of 8 - d positional bytes: every pair that can reach the guaranteed minimum
meets in a posting.  There its shared bytes are tallied, pairs below the minimum are left out, the
bits of the rest are compared, and only enough links to connect the posting are kept.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.llm.common import cell_groups, components, in_cells, mapped, segment_reduce, slices, staged

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42

#: Fingerprints of one posting compared in one task; larger postings are split into pairs of blocks.
CELL = 1024


def fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    """SimHash of each text as int64: a bit is 1 if set in over half of the shingles' XXH64.

    Shingles are ``words`` lower-cased (A-Z) words joined by spaces, repeats included; a text of
    fewer words is one shingle; a text of none (null, empty, white space) has fingerprint zero.
    """
    hashes: list[int] = []
    at = [0]
    digest = xxhash.xxh64_intdigest
    for text in texts:
        parts = WORD.findall((text or "").encode().lower())
        if parts:
            joined = b" ".join(parts)
            ends = np.cumsum([len(p) + 1 for p in parts])
            begins = np.append(0, ends[:-1])
            n = max(1, len(parts) - words + 1)
            stops = (ends[words - 1:] if len(parts) >= words else ends[-1:]) - 1
            hashes += [digest(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), stops.tolist())]
        at.append(len(hashes))
    at = np.array(at)
    out = np.zeros(len(texts), np.uint64)
    values = np.array(hashes, dtype=np.uint64)
    for lo in range(0, len(texts), 64):  # bits are unpacked for a few texts at a time
        edge = at[lo:lo + 65]
        bits = np.unpackbits(values[edge[0]:edge[-1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = segment_reduce(np.add, bits.astype(np.int32), edge - edge[0], 0)
        out[lo:lo + 64] = np.packbits(2 * count > np.diff(edge)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, words: int, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a last column ``name`` (long); all columns are kept."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = pa.array(fingerprints(batch.column("text").to_pylist(), words))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, name])

    return mapped(docs, run, schema)


def _bytes(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)


def _forest(fp: np.ndarray, positions: tuple[int, ...], bits: int) -> Iterator[tuple[int, int]]:
    """Links that connect the fingerprints of one posting whose bits differ in ``bits`` places or fewer.

    A pair is judged only in the first posting that it shares: the one of its first common bytes.
    """
    least = len(positions)
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    parts = _bytes(fp)
    for i in range(len(fp) - 1):
        same = parts[i + 1:] == parts[i]
        tally = same.sum(axis=1)
        first = same[:, :positions[-1] + 1].sum(axis=1) == least
        near = np.flatnonzero((tally >= least) & first)
        if len(near):
            near = near[np.bitwise_count((fp[i + 1 + near] ^ fp[i]).view(np.uint64)) <= bits] + i + 1  # signed: it would count bits of |x|
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield int(fp[i]), int(fp[j])


def links(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b) between distinct fingerprints (column ``fp``, one row each) that suffice to connect all within ``bits`` bits."""
    least = 8 - bits
    groups = list(itertools.combinations(range(8), least))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 4096):
                own = fp[lo:lo + 4096]
                parts = _bytes(own).astype(np.int64)
                for g, positions in enumerate(groups):
                    key = np.full(len(own), g, np.int64)
                    for p in positions:
                        key = key << 8 | parts[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cell_groups(batches, "key"):
            positions = groups[group.column("key")[0].as_py() >> (8 * least)]
            found = list(_forest(group.column("fp").to_numpy(), positions, bits))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    # Each fingerprint makes dozens of postings: dealt out first, as a few files of short rows hold them all.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = mapped(prints.select("fp").repartition(parts, "fp"), post, "key long, fp long")
    return mapped(in_cells(postings, "key", "fp", CELL), compare, "a long, b long")


def groups_of(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of every distinct value of column ``fp``; root names its component."""
    distinct = staged(prints.select("fp").distinct(), "prints")
    linked = components(links(distinct, bits))
    return distinct.join(linked, distinct.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row; component_id is the least doc_id reachable by links.

    Texts without words (null, empty) have fingerprint zero and link like any other.  A repeated
    doc_id keeps all its rows.  Null doc_ids are carried, and no component is named by one unless
    all of its are null.  An empty table gives an empty table; other columns are not read.
    """
    prints = staged(with_fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = staged(groups_of(prints, bits).join(least, "fp"), "groups")
    named = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of = group.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of the least doc_id (ties: the least row as JSON).

    All columns are returned, of any type; rows are compared by ``text`` alone.  Null ids go last; an empty
    table stays empty.
    """
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # columns of any name, clashing ones too
    at_id, at_text = inner[names.index("doc_id")], inner[names.index("text")]
    plain = docs.toDF(*inner)
    marked = with_fingerprints(plain.withColumnRenamed(at_text, "text"), words).withColumnRenamed("text", at_text)
    marked = staged(marked.withColumn("place", F.monotonically_increasing_id()), "marked")
    prints = marked.select(F.col(at_id).alias("id"), "fp", "place")
    per = prints.groupBy("fp").agg(F.min("id").alias("least"))
    group = staged(groups_of(prints, bits).join(per, "fp"), "groups")
    named = group.groupBy("root").agg(F.min("least").alias("keep"))
    keep = group.join(named, "root").select("fp", "root", "keep")
    chosen = staged(prints.join(keep, "fp").filter(F.col("id").eqNullSafe(F.col("keep"))).select("root", "place"), "chosen")
    count = chosen.groupBy("root").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    # Rows of one id in one component: compared as JSON, which every type of column has.
    ties = chosen.join(count.filter("n > 1").select("root"), "root").join(marked, "place") \
        .groupBy("root").agg(F.min(F.struct(F.to_json(F.struct(*inner)).alias("row"), "place")).alias("least")).select("least.place")
    places = count.filter("n = 1").select("place").unionByName(ties)
    return marked.join(places, "place", "left_semi").select(*inner).toDF(*names)
