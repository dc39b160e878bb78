"""Operator 8: quality grades by ordinal cumulative-link regression over hashed text.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all thresholds; x marks the
hashed runs of letters, digits and signs that a text contains, and bins of a few shares.  The fit
uses a bounded sample of graded rows; the score of a text needs only the weights.  The cut for
keeping a text is chosen on graded rows that the fit has not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER, WHITE, mapped, mixed, runs, slices, span_hashes, utf8

#: Feature space: hashed runs below, bins of shares in the last places.
FEATURE_BITS = 20
#: Graded rows that the fit uses, taken by the order of a hash of their id.
SAMPLE_ROWS = 8000
#: Features of one text that the fit uses at most, those of the least hashes; scores use all.
SAMPLE_FEATURES = 20_000
#: Features in fewer sampled rows than this have weight zero.
LEAST_ROWS = 8
#: A text is kept if P(grade >= top grade) is at least this, where the held-out rows are too few to choose a cut.
KEEP_TAIL = 0.3
#: Held-out rows: one in so many, as many more than the fit uses.
FOLDS = 5
#: Share of held-out rows of the top grade that a chosen cut must keep.
CLEAN_KEPT = 0.99
#: Held-out rows of the top grade and of all others together that it takes to choose a cut.
LEAST_HELD = 50

_KIND = np.full(256, 3, np.uint8)
_KIND[WHITE] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_BINS = 16


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, ascending, and where each text's begin."""
    data, at = utf8(column)
    rows = len(at) - 1
    kind = _KIND[data]
    start, end, row = runs(kind, at)
    word = (span_hashes(LOWER[data], start, end) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    size = np.maximum(np.diff(at), 1)
    caps = (data >= 65) & (data < 91)
    shares = []
    for mask in (caps, kind == 3, kind == 2, kind == 0):
        total = np.append(0, np.cumsum(mask))
        shares.append((total[at[1:]] - total[at[:-1]]) / size)
    shares.append(np.minimum(np.bincount(row, minlength=rows) / size, 1))
    letters = kind[start] == 1
    again = np.zeros(len(word), dtype=bool)  # a word that stood one or two runs before in the same text
    for back in (1, 2):
        again[back:] |= letters[back:] & (word[back:] == word[:-back]) & (row[back:] == row[:-back])
    shares.append(np.bincount(row[again], minlength=rows) / np.maximum(np.bincount(row[letters], minlength=rows), 1))
    some = np.diff(at) > 0
    base = (1 << FEATURE_BITS) + np.arange(len(shares)) * _BINS
    bins = np.stack([b + np.minimum((s * 4 * _BINS).astype(np.int64), _BINS - 1) for b, s in zip(base, shares)])[:, some]
    key = np.concatenate([row << 32 | word, (np.flatnonzero(some) << 32 | bins).ravel()])
    key = np.unique(key)
    return (key & 0xFFFFFFFF).astype(np.int32), np.searchsorted(key >> 32, np.arange(rows + 1))


def few_features(feature: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``most`` features of each text at most: those of the least hashes of their numbers."""
    rows = [feature[a:b] for a, b in zip(at, at[1:])]
    rows = [r if len(r) <= most else np.sort(r[np.argsort(mixed(r.astype(np.uint64)))[:most]]) for r in rows]
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.cumsum([0, *map(len, rows)])


WIDTH = (1 << FEATURE_BITS) + 6 * _BINS


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per feature
    thresholds: np.ndarray  # ascending, one less than grades
    keep_tail: float = KEEP_TAIL  # least P(top grade) of a text that is kept

    def at_most(self, column: pa.Array) -> np.ndarray:
        """P(grade <= k) of each text (rows) for all but the top grade (columns)."""
        return self.at_most_of(*features(column))

    def at_most_of(self, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same from the texts' features."""
        total = np.append(0.0, np.cumsum(self.weights[feature], dtype=np.float64))
        return 1 / (1 + np.exp(np.clip((total[at[1:]] - total[at[:-1]])[:, None] - self.thresholds, -60, 60)))


def fit_ordinal(feature: np.ndarray, at: np.ndarray, grade: np.ndarray, grades: int, steps: int = 250, ridge: float = 3e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge by full-batch Adam with falling steps; grades are 0 .. grades - 1.

    The ridge is weak enough that a word that only a few dozen rows of one grade have still decides a text.
    Without rows, or with one grade only, the weights are zero and the thresholds follow the counts.
    """
    count = np.bincount(grade, minlength=grades) + 1.0
    share = np.cumsum(count)[:-1] / count.sum()
    thresholds = np.log(share / (1 - share))
    weights = np.zeros(WIDTH, np.float32)
    used, column = np.unique(feature, return_inverse=True)
    often = np.bincount(column, minlength=len(used)) >= LEAST_ROWS
    if len(grade) and often.any() and len(np.unique(grade)) > 1:
        row = np.repeat(np.arange(len(grade)), np.diff(at))[often[column]]
        column = (np.cumsum(often) - 1)[column[often[column]]]
        n, rows = int(often.sum()), len(grade)
        x = np.append(np.zeros(n), thresholds)
        moment, spread = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, steps + 1):
            edge = np.concatenate([[-np.inf], np.sort(x[n:]), [np.inf]])
            score = np.bincount(row, weights=x[column], minlength=rows)
            upper, lower = (1 / (1 + np.exp(-np.clip(e - score, -40, 40))) for e in (edge[grade + 1], edge[grade]))
            upper[grade == grades - 1], lower[grade == 0] = 1, 0
            p = np.maximum(upper - lower, 1e-9)
            slope = np.append(np.bincount(column, weights=(1 - upper - lower)[row], minlength=n) / rows + ridge * x[:n], np.zeros(grades - 1))
            np.add.at(slope, n + grade[grade < grades - 1], -(upper * (1 - upper) / p)[grade < grades - 1] / rows)
            np.add.at(slope, n + grade[grade > 0] - 1, (lower * (1 - lower) / p)[grade > 0] / rows)
            moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
            x -= 0.2 * (1 - (t - 1) / steps) * (moment / (1 - 0.9 ** t)) / (np.sqrt(spread / (1 - 0.99 ** t)) + 1e-8)
        weights[used[often]], thresholds = x[:n], np.sort(x[n:])
    return OrdinalModel(weights, thresholds)


def choose_cut(tail: np.ndarray, top: np.ndarray) -> float:
    """The largest cut that keeps CLEAN_KEPT of the held-out rows of the top grade (``top``), given P(top grade) of all held-out rows.

    KEEP_TAIL if there are under LEAST_HELD rows of the top grade or of the others.
    """
    if min(top.sum(), (~top).sum()) < LEAST_HELD:
        return KEEP_TAIL
    return float(np.sort(tail[top])[int((1 - CLEAN_KEPT) * top.sum())])


def label_grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor text; 1: toxic but well written; 2: neither.  Null where quality is null."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality).isNotNull(), F.when(F.col(toxic) == 1, 1).otherwise(2))


def train(docs: DataFrame, graded: DataFrame, grades: int = 3, rows: int = SAMPLE_ROWS, features_each: int = SAMPLE_FEATURES) -> OrdinalModel:
    """Fit on at most ``rows`` rows of ``graded`` (doc_id, grade) that have a text, besides the held-out ones; null grades and ids don't count.

    Ids may repeat on both sides: the bound holds for the rows after the join, and each brings
    ``features_each`` features at most.  A fold by crc32 of the id is held out, and the cut is chosen on it.  Where it is too small for that,
    its rows are fitted with the others.
    """
    known = graded.select("doc_id", F.col("grade").cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    most = rows * FOLDS // (FOLDS - 1)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)  # so many short rows at most: small enough to send out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            feature, at = few_features(*features(batch.column("text")), features_each)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), lists], ["doc_id", "grade", "features"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    found = mapped(found, run, "doc_id long, grade int, features array<int>") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade", F.xxhash64("features")).limit(most).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = found.column("features").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    feature, grade = lists.values.to_numpy(), found.column("grade").to_numpy().astype(np.int64)
    held = np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in found.column("doc_id").to_pylist()], dtype=bool)
    top = grade == grades - 1
    if min((held & top).sum(), (held & ~top).sum()) < LEAST_HELD:
        return fit_ordinal(feature, at, grade, grades)
    of = np.repeat(held, np.diff(at))  # of each feature's row
    part = lambda rows: (feature[of == rows], np.append(0, np.cumsum(np.diff(at)[held == rows])))
    model = fit_ordinal(*part(False), grade[~held], grades)
    model.keep_tail = choose_cut(1 - model.at_most_of(*part(True))[:, -1], top[held])
    return model


def grade_documents(docs: DataFrame, model: OrdinalModel, keep_tail: float | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, keep) of every row; tail_prob is P(top grade).  The cut is the model's, if not given.

    Null and empty texts have no features and get the grade of the thresholds alone.  Repeated rows
    stay repeated; an empty table gives an empty table; other columns are not read.
    """
    keep_tail = model.keep_tail if keep_tail is None else keep_tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            below = model.at_most(batch.column("text"))
            tail = 1 - below[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((1 - below).sum(axis=1)), pa.array(tail), pa.array(tail >= keep_tail)],
                                             ["doc_id", "expected_grade", "tail_prob", "keep"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, expected_grade double, tail_prob double, keep boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, keep_tail: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model keeps: with the model's cut, if none is given.

    A null or empty text has the score of the thresholds alone; repeated rows are judged alike; an empty table stays empty.
    """
    keep_tail = model.keep_tail if keep_tail is None else keep_tail
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            keep = [1 - model.at_most(part.column(0))[:, -1] >= keep_tail for part in slices([text])]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return mapped(docs, run, docs.schema)
