"""Operator 11: product codes of vectors by dual-tree Lloyd.

Vectors are cut into parts, and each part position has a small codebook.  Blocks of parts are sorted
into binary trees once; a node keeps the box, the sum and the number of its parts.  In each round a
second tree, over the codebook's entries, meets them: for a pair of nodes the least and greatest
distance between their boxes bound all distances below, and pairs that cannot hold a nearest entry go.
A node that is left with one entry gives it its cached sum as a whole; leaves that stay undecided
compare distances of their parts in integers.  Tasks add up sums and counts, Spark adds the tasks'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import staged
from chatlake.llm.vectors import common_width, matrix, narrow, unpacked, usable

#: Vectors of a block, which has one tree for each part position.
BLOCK_ROWS = 4096
#: Parts of a leaf, about.
LEAF_ROWS = 16
#: Labels that are sent out at most; more are joined by a shuffle.
LABELS_SENT = 100_000
#: Shares that each label's rows are dealt into by that shuffle.
LABEL_SHARES = 32


def levels_of(rows: int, leaf: int) -> int:
    """Levels below the root of a tree whose leaves have at most ``leaf`` rows."""
    return max(0, (-(-rows // leaf) - 1).bit_length())


def edges(rows: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: node i's halves are nodes 2i and 2i + 1 of the next level."""
    return (np.arange((1 << level) + 1) * rows) >> level


def sorted_order(x: np.ndarray, levels: int) -> np.ndarray:
    """An order of the rows that makes every node's rows neighbours: halves along the widest axis of each node."""
    order = np.arange(len(x))
    for level in range(levels):
        at, now = edges(len(x), level), x[order]
        wide = (np.maximum.reduceat(now, at[:-1]) - np.minimum.reduceat(now, at[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(at))
        order = order[np.lexsort((now[np.arange(len(x)), wide[node]], node))]
    return order


@dataclass
class Tree:
    """Rows in tree order, and for each level where its nodes begin, their boxes and their sums."""

    rows: np.ndarray
    at: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, rows: np.ndarray, levels: int) -> Tree:
        rows = rows.astype(np.int64)
        at = [edges(len(rows), k) for k in range(levels + 1)]
        low, high, sums = ([f.reduceat(rows, at[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
        for _ in range(levels):  # a node from its halves
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            sums.append(sums[-1][::2] + sums[-1][1::2])
        return cls(rows, at, low[::-1], high[::-1], sums[::-1])

    @property
    def levels(self) -> int:
        return len(self.at) - 1


@dataclass
class Assignment:
    """The entry of each row (in tree order), and each entry's sum and number of rows."""

    entry: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    whole: int  # rows that a node took along as a whole


def groups(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal nodes begin, and how long they are."""
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    return begin, np.diff(np.append(begin, len(node)))


def assign(tree: Tree, entries: np.ndarray) -> Assignment:
    """The nearest entry of each row, ties to the lower index, by walking down both trees together."""
    size = len(entries)
    depth = levels_of(size, 1)
    order = sorted_order(entries, depth)
    own = Tree.over(entries[order], depth)  # its lowest nodes have one entry, or none
    out = Assignment(np.zeros(len(tree.rows), np.int64), np.zeros(entries.shape, np.int64), np.zeros(size, np.int64), 0)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, sorted
    level = below = 0
    while True:
        single = below == depth
        low, high, near, far = tree.low[level][node], tree.high[level][node], own.low[below][other], own.high[below][other]
        if single:
            near = far = own.rows[own.at[below][other]]
        gap, reach = np.maximum(np.maximum(near - high, low - far), 0), np.maximum(high - near, far - low)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        begin, length = groups(node)
        bound = np.repeat(np.minimum.reduceat(most, begin), length)
        keep = least <= bound  # beyond it, some entry is nearer to every row of the node
        if single:
            # Against an entry of the least bound: |x - e|^2 - |x - rival|^2 at its least over the box.
            place = np.flatnonzero(most == bound)
            rival = np.repeat(place[np.searchsorted(place, begin)], length)
            step = near - near[rival]
            keep &= ((near * near) - (near[rival] * near[rival]) - 2 * np.where(step > 0, high, low) * step).sum(axis=1) <= 0
        node, other = node[keep], other[keep]
        if single:
            begin, length = groups(node)
            alone = begin[length == 1]
            nodes, entry = node[alone], order[own.at[below][other[alone]]]
            first, last = tree.at[level][nodes], tree.at[level][nodes + 1]
            np.add.at(out.sums, entry, tree.sums[level][nodes])
            np.add.at(out.counts, entry, last - first)
            out.entry[spans(first, last)] = np.repeat(entry, last - first)
            out.whole += int((last - first).sum())
            left = np.repeat(length > 1, length)
            node, other = node[left], other[left]
            if not len(node):
                return out
            if level == tree.levels:
                break
        if level < tree.levels:
            node, other, level = np.repeat(node, 2) * 2 + np.tile([0, 1], len(node)), np.repeat(other, 2), level + 1
        if not single:
            node, other, below = np.repeat(node, 2), np.repeat(other, 2) * 2 + np.tile([0, 1], len(other)), below + 1
            some = own.at[below][other] < own.at[below][other + 1]
            node, other = node[some], other[some]
        turn = np.lexsort((other, node))
        node, other = node[turn], other[turn]
    # Undecided leaves: each of their rows against the entries that are left, in integers.
    first, last = tree.at[level][node], tree.at[level][node + 1]
    row, entry = spans(first, last), np.repeat(order[own.at[below][other]], last - first)
    gap = tree.rows[row] - entries[entry]
    turn = np.lexsort((entry, (gap * gap).sum(axis=1), row))
    row, entry = row[turn], entry[turn]
    begin, _ = groups(row)
    row, entry = row[begin], entry[begin]
    out.entry[row] = entry
    np.add.at(out.sums, entry, tree.rows[row])
    out.counts += np.bincount(entry, minlength=size)
    return out


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1, and so on."""
    length = last - first
    return np.repeat(first - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())


def block_trees(data: list, rows: int, part_width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Tree and order of each part position of a staged block."""
    for part in data:
        order = np.frombuffer(part["order"], dtype=np.uint16).astype(np.int64)
        yield Tree.over(unpacked(part["rows"], part_width, rows), levels_of(rows, LEAF_ROWS)), order


def stage_blocks(rows: DataFrame, parts: int, part_width: int) -> DataFrame:
    """Table of blocks: ids, labels and, for each part position, its rows in tree order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(a, BLOCK_ROWS)
                x = matrix(batch.column(1))
                if float(np.abs(x.astype(np.float64)).max()) ** 2 * part_width >= 2.0 ** 60:
                    raise ValueError("components are too large for exact squared distances in 64 bits")
                levels, cut = levels_of(len(x), LEAF_ROWS), []
                for p in range(parts):
                    part = np.ascontiguousarray(x[:, p * part_width:(p + 1) * part_width])
                    order = sorted_order(part, levels)
                    cut.append({"order": order.astype(np.uint16).tobytes(), "rows": narrow(part[order]).tobytes()})
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(2).to_pylist()], pa.list_(batch.schema.field(2).type)),
                                                  pa.array([cut], pa.list_(pa.struct([("order", pa.binary()), ("rows", pa.binary())])))], ["ids", "labels", "parts"])

    kind = rows.schema["label"].dataType.simpleString()
    return staged(rows.select("vec_id", "x", "label").mapInArrow(run, f"ids array<long>, labels array<{kind}>, parts array<struct<order: binary, rows: binary>>"), "codes")


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books (part, entry, component) after one round: entries become the floored means of their parts."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, size, width + 1), np.int64)
        for batch in batches:
            for ids, cut in zip(batch.column("ids"), batch.column("parts").to_pylist()):
                for p, (tree, _) in enumerate(block_trees(cut, len(ids), width)):
                    found = assign(tree, books[p])
                    total[p, :, :width] += found.sums
                    total[p, :, width] += found.counts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total.ravel()[some])], ["at", "v"])

    sums = blocks.select("ids", "parts").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(parts * size * (width + 1), np.int64)
    total[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    total = total.reshape(parts, size, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each row, by its nearest entries."""
    parts, size, width = books.shape
    kind = blocks.schema["labels"].dataType.elementType
    digits = np.frombuffer("".join(f"{k:02x}" for k in range(size)).encode(), dtype=np.uint8).reshape(size, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, cut in enumerate(batch.column("parts").to_pylist()):
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                entry, error = np.zeros((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
                for p, (tree, order) in enumerate(block_trees(cut, len(ids), width)):
                    found = assign(tree, books[p]).entry
                    gap = tree.rows - books[p][found]
                    entry[order, p] = found
                    error[order] += (gap * gap).sum(axis=1)
                at = np.arange(len(ids) + 1, dtype=np.int32) * (2 * parts)
                code = pa.StringArray.from_buffers(len(ids), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(digits[entry])))
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {kind.simpleString()}, code string, error long")


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable row.

    ``table``: (vec_id, embedding, label).  The codebooks start as the parts of the first ``entries``
    rows by vec_id; rows of equal ids follow by their integers, rows without an id come last, and a
    table of fewer rows has smaller codebooks.  Rows whose vector is null, empty, holds null or
    non-finite components, or has another length than most rows have, go; an empty table gives an
    empty one; repeated rows stay repeated; other columns are not read.  ``label_error`` adds up the
    errors of equal labels, nulls together.  A length that ``parts`` does not divide, over 256 entries,
    or components whose squares would not fit 64 bits (65,536 and more at 8 components a part) are an error.
    """
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows = usable(table, scale, "label")
    width = common_width(rows)
    if not width:
        return table.sparkSession.createDataFrame([], schema)
    if width % parts or not 0 < entries <= 256:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts, or {entries} entries don't fit two hex digits")
    rows = rows.filter(F.size("x") == width)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks = stage_blocks(rows, parts, width // parts)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = staged(assigned(blocks, books), "coded")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def with_label_errors(coded: DataFrame, sent: int = LABELS_SENT, shares: int = LABEL_SHARES) -> DataFrame:
    """``coded`` with the sum of ``error`` over all rows of the same label.

    Up to ``sent`` labels are sent to all tasks; more meet the rows by a join, where every label's
    rows are dealt into ``shares`` shares, so that a label of a third of all rows has no task to itself.
    """
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    if sums.count() <= sent:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    dealt = coded.withColumn("share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(shares)))
    sums = sums.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return dealt.join(sums.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("share") == F.col("part"))).drop("of", "share", "part")
