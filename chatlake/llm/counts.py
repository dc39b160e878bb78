"""Operator 4: token counts that follow edits.

A text is cut before each run of white space that follows something else; no pre-token of a byte-level
BPE pattern crosses such a cut, so the pieces' token counts add up to the text's.  The pieces stand in
the leaves of a segment tree whose nodes sum characters and tokens.  An edit finds its leaves from the
root, cuts and counts only them and the leaf on either side (a run of white space may now join its
neighbour there), and updates the sums above them.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import slices

#: Unicode's white space, as the pattern's \s has it.
_SPACE = "\t-\r \x85\xa0  -     　"
PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

#: Pieces in a leaf when it is made, and the most that it may grow to before the tree is built anew.
LEAF, LEAF_MOST = 8, 32
#: Pieces whose counts a Python worker remembers.
REMEMBERED = 300_000


class Counter:
    """Token counts of pieces under one vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(pieces))
            encode = self.encoding.encode_ordinary
            known.update((p, len(encode(p))) for p in new)
        return [known[p] for p in pieces]


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class TokenTree:
    """Segment tree of one text: node 1 is the root, node k has children 2k and 2k + 1, leaves begin at ``width``."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.encoded = counter, 0
        self._build(PIECES.findall(text))

    def _build(self, pieces: list[str]) -> None:
        counts = self.counter.count(pieces)
        self.leaves = [pieces[k:k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k] = sum(map(len, leaf))
            self.tokens[self.width + k] = sum(counts[k * LEAF:(k + 1) * LEAF])
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join([p for leaf in self.leaves for p in leaf])

    def leaf_of(self, position: int) -> tuple[int, int]:
        """The leaf with that character (the last one with characters, if it is the end), and the position of the leaf's first."""
        node, begin = 1, 0
        position = min(position, self.n_chars - 1)
        while node < self.width:
            node *= 2
            if position - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``position`` on by ``insert``; both are cut to the text."""
        position = max(0, min(position, self.n_chars))
        delete = max(0, min(delete, self.n_chars - position))
        if not self.n_chars:
            self.encoded += len(insert)
            self._build(PIECES.findall(insert))
            return
        (first, begin), (last, _) = self.leaf_of(position), self.leaf_of(position + max(delete, 1) - 1)
        before = first - 1
        while before >= 0 and not self.leaves[before]:
            before -= 1
        if before >= 0:
            first, begin = before, begin - self.chars[self.width + before]
        after = last + 1
        while after < len(self.leaves) and not self.leaves[after]:
            after += 1
        last = min(after, len(self.leaves) - 1)
        old = "".join([p for leaf in self.leaves[first:last + 1] for p in leaf])
        at = position - begin
        new = old[:at] + insert + old[at + delete:]
        self.encoded += len(new)
        pieces = PIECES.findall(new)
        slots = last - first + 1
        if len(pieces) > slots * LEAF_MOST:
            self._build([p for leaf in self.leaves[:first] for p in leaf] + pieces + [p for leaf in self.leaves[last + 1:] for p in leaf])
            return
        counts = self.counter.count(pieces)
        share = -(-len(pieces) // slots)
        touched = set()
        for k in range(slots):
            own = slice(k * share, (k + 1) * share)
            node = self.width + first + k
            self.leaves[first + k] = pieces[own]
            self.chars[node], self.tokens[node] = sum(map(len, pieces[own])), sum(counts[own])
            touched.add(node >> 1)
        while touched and 0 not in touched:
            for node in touched:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            touched = {node >> 1 for node in touched}


def count_edits(docs: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_chars_counted) of every row of ``docs``.

    ``edits`` (doc_id, seq, position, n_delete, insert) apply to a document one after another by seq
    (ties by position, n_delete, insert), each to the text that the one before left, in characters.
    n_chars_counted: characters of the regions cut and counted anew by edits.  Null texts are empty,
    null positions and numbers 0, null inserts empty.  Of rows with one doc_id the edits go to the one
    with the least text hash; edits of unknown or null ids do nothing.  An empty table gives an empty one.

    Documents and edits meet in one shuffle and are read in order, so neither a text's edits nor a
    partition's documents are held together.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = docs.select("doc_id", F.lit(0).alias("kind"), F.xxhash64("text").alias("seq"), none("long").alias("position"), none("long").alias("n_delete"), "text")
    changes = edits.filter("doc_id is not null").select("doc_id", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("position").cast("long").alias("position"),
                                                        F.col("n_delete").cast("long").alias("n_delete"), F.col("insert").alias("text"))
    salt = F.when(F.col("doc_id").isNull(), F.col("seq")).otherwise(F.lit(0))  # null ids have no edits: they may go anywhere
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_counted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, pattern)
        tree: TokenTree | None = None
        of, before, applied = None, 0, 0

        def row() -> tuple:
            return of, before, applied, tree.n_tokens, tree.n_chars, tree.encoded

        done: list[tuple] = []
        for batch in slices(batches):
            for doc_id, kind, position, n_delete, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "position", "n_delete", "text"))):
                if kind == 0:
                    if tree is not None and (of is None or doc_id != of):
                        done.append(row())
                        tree = None
                    if tree is not None:  # another row of the same id
                        n = sum(counts.count(PIECES.findall(text or "")))
                        done.append((doc_id, n, 0, n, len(text or ""), 0))
                    else:
                        tree = TokenTree(counts, text or "")
                        of, before, applied = doc_id, tree.n_tokens, 0
                elif tree is not None and doc_id == of:
                    tree.edit(position or 0, n_delete or 0, text or "")
                    applied += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names)
                done.clear()
        if tree is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in row()], names)

    met = rows.unionByName(changes).repartition(F.col("doc_id"), salt).sortWithinPartitions("doc_id", "kind", "seq", "position", "n_delete", "text")
    return met.select("doc_id", "kind", "position", "n_delete", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
