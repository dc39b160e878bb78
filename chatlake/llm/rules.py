"""Operator 12: quality rules learned by gradient-boosted trees over document statistics.

Statistics are exact counts over whole texts.  Trees are grown on histograms with monotonic
constraints on chosen statistics, and flattened into arrays of nodes that score many texts at once.
Fixed base rules come first; the trees judge what passes them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import WHITE, runs, slices, utf8

#: Labelled rows that the fit sees at most, taken by the order of a hash of their id.
SAMPLE_ROWS = 20_000
#: Held-out rows: one in so many.
FOLDS = 5
#: Share of the held-out good rows that the cut must keep, and the cut where these are under LEAST_HELD.
GOOD_KEPT = 0.995
LEAST_HELD = 50
CUT = 0.3

#: Base rules: least words, and most percent of words in repeated windows of WINDOW words.
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see, and which way each may move the score: 1 only up with it, -1 only down, 0 free.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "digits": 0, "signs": 0,
            "distinct_words": 0, "wordless": -1, "line_words": 0, "beyond_ascii": 0, "word_twice_running": -1}


def spans_as_values(data: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same number for equal spans (of ``length`` bytes, in order, the bytes of ``inside``), by their bytes."""
    at = np.append(0, np.cumsum(length)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number for each key, and the keys by number."""
    encoded = pa.array(key).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False)


def repeated_words(word: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` words (a power of two) that its text holds twice or more."""
    out = np.zeros(len(word), bool)
    if len(word) < window:
        return out
    name, size = word, 1
    while size < window:  # windows of twice the length: pairs of numbers, numbered anew
        name, _ = numbered(name[:-size] * (int(name.max()) + 1) + name[size:])
        size *= 2
    at = np.flatnonzero(row[:len(name)] == row[window - 1:])
    if len(at):
        key, _ = numbered(row[at] * (int(name.max()) + 1) + name[at])
        at = at[np.bincount(key)[key] > 1]
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        out = np.cumsum(step[:-1]) > 0
    return out


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (rows x 5, integers) and FEATURES (rows x 13, doubles) of each text; null texts have no words."""
    data, at = utf8(column)
    rows = len(at) - 1
    white = WHITE[data]
    start, end, row = runs((~white).astype(np.uint8), at)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[at[1:]] - total[at[:-1]]

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=rows)

    first_byte = (data & 0xC0) != 0x80
    words = np.bincount(row, minlength=rows)
    chars, symbols = of_bytes(first_byte & ~white), of_bytes(_SYMBOL[data])
    word = spans_as_values(data, ~white, end - start)
    again = of_words(repeated_words(word, row))
    line_start, line_end, line_row = runs((data != 10).astype(np.uint8), at)
    visible = np.append(0, np.cumsum(~white))
    line = spans_as_values(data, data != 10, line_end - line_start)
    filled = visible[line_end] > visible[line_start]
    line, line_row = line[filled], line_row[filled]
    lines = np.bincount(line_row, minlength=rows)
    _, kinds = numbered(line_row * (len(filled) + 1) + line)
    dup_lines = lines - np.bincount(kinds // (len(filled) + 1), minlength=rows)

    _, kinds = numbered(row * (len(word) + 1) + word)
    distinct = np.bincount(kinds // (len(word) + 1), minlength=rows)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    capital, digit = (data >= 65) & (data < 91), (data >= 48) & (data < 58)
    letters = np.append(0, np.cumsum(capital | (data >= 97) & (data < 123) | (data >= 128)))
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    shares = [np.log1p(words), chars / n, symbols / n, dup_lines / np.maximum(lines, 1), again / n, of_bytes(capital) / c, of_bytes(digit) / c,
              of_bytes(_SIGN[data]) / c, distinct / n, of_words(letters[end] == letters[start]) / n, words / np.maximum(lines, 1),
              of_bytes((data >= 128) & first_byte) / c, of_words(same) / n]
    return np.stack([words, chars, symbols, dup_lines, again], axis=1).astype(np.int64), np.stack(shares, axis=1).astype(np.float64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Trees:
    """All trees' nodes in one row of arrays; a leaf is its own child.  The score is P(good)."""

    feature: np.ndarray
    threshold: np.ndarray  # values up to it go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of leaves, in log odds
    roots: np.ndarray
    depth: int
    base: float
    cut: float = CUT

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return total + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each row of features."""
        parts = [self.log_odds(x[a:a + 4096]) for a in range(0, len(x), 4096)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -60, 60))) if parts else np.zeros(0)


def fit_trees(x: np.ndarray, good: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Boosting of the logistic loss by trees of histogram splits.

    ``monotone`` has 1, -1 or 0 for each feature.  A split on a constrained feature must order its
    halves' values, and their middle bounds all values below either half, so the score can't move the
    wrong way.  Without rows, or with one class only, there are no trees and the score is the class's share.
    """
    n, width = x.shape
    share = (good.sum() + 1) / (n + 2)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))

    def add() -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    if n and 0 < good.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(width)]
        place = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        odds = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-odds))
            slope, bend = p - good, p * (1 - p)
            roots.append(add())
            open_nodes = {roots[-1]: (np.arange(n), -np.inf, np.inf)}
            for level in range(depth + 1):
                below = {}
                for k, (rows, low, high) in open_nodes.items():
                    nodes["value"][k] = float(np.clip(-slope[rows].sum() / (bend[rows].sum() + ridge), low, high)) * rate
                    found = best_split(place[rows], slope[rows], bend[rows], monotone, low, high, bins, least, ridge) if level < depth else None
                    if found is None:
                        odds[rows] += nodes["value"][k]
                        continue
                    f, b, middle = found
                    left, right = add(), add()
                    nodes["feature"][k], nodes["threshold"][k], nodes["left"][k], nodes["right"][k] = f, float(cuts[f][b]), left, right
                    goes = place[rows, f] <= b
                    down, up = (low, middle), (middle, high)
                    first, second = (down, up) if monotone[f] > 0 else (up, down) if monotone[f] < 0 else ((low, high), (low, high))
                    below[left], below[right] = (rows[goes], *first), (rows[~goes], *second)
                open_nodes = below
    kinds = {"feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return Trees(*[np.array(nodes[k], kinds[k]) for k in kinds], np.array(roots, np.int64), depth, base)


def best_split(place: np.ndarray, slope: np.ndarray, bend: np.ndarray, monotone: np.ndarray, low: float, high: float,
               bins: int, least: int, ridge: float) -> tuple[int, int, float] | None:
    """(feature, last bin that goes left, middle of the halves' values) of the greatest gain; None where no split gains."""
    rows, width = place.shape
    if rows < 2 * least:
        return None
    key = (place + np.arange(width) * bins).ravel()
    total = [np.cumsum(np.bincount(key, weights=w, minlength=width * bins).reshape(width, bins), axis=1)[:, :-1]
             for w in (np.repeat(slope, width), np.repeat(bend, width), np.ones(rows * width))]
    g, h, m = total
    whole_g, whole_h = slope.sum(), bend.sum()
    one, other = (np.clip(-a / (b + ridge), low, high) for a, b in ((g, h), (whole_g - g, whole_h - h)))
    # The loss that a half's value saves, with the value as bounded.
    saved = lambda v, a, b: -(a * v + (b + ridge) * v * v / 2)
    parent = np.clip(-whole_g / (whole_h + ridge), low, high)
    gain = saved(one, g, h) + saved(other, whole_g - g, whole_h - h) - saved(parent, whole_g, whole_h)
    wrong = monotone[:, None] * (other - one) < 0
    gain[wrong | (m < least) | (rows - m < least)] = -np.inf
    f, b = divmod(int(gain.argmax()), bins - 1)
    return (f, b, float((one[f, b] + other[f, b]) / 2)) if gain[f, b] > 1e-9 else None


def choose_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The largest cut up to one half that keeps GOOD_KEPT of the held-out good rows; CUT with under LEAST_HELD of them."""
    if good.sum() < LEAST_HELD:
        return CUT
    return float(min(0.5, np.sort(score[good])[int((1 - GOOD_KEPT) * good.sum())]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled rows ``(doc_id, good)`` that pass the base rules; null ids and labels don't count.

    A fold by crc32 of the id is held out, and the cut is chosen on it.  Labels and documents may
    repeat ids: the bound holds for the rows that are fitted, after the join.
    """
    sample = labels.filter("doc_id is not null and good is not null").select("doc_id", F.col("good").cast("int").alias("good")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(rows)  # short rows, so many at most: small enough to send out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, x = statistics(batch.column("text"))
            some = np.flatnonzero(~base_failed(counts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), batch.column("good").take(pa.array(some)), lists], ["doc_id", "good", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text") \
        .mapInArrow(run, "doc_id long, good int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "good", "x").limit(rows).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    good = found.column("good").to_numpy().astype(bool)
    held = np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in found.column("doc_id").to_pylist()], dtype=bool)
    model = fit_trees(x[~held], good[~held], np.array(list(FEATURES.values())))
    if not len(model.roots):
        model.cut = 0.0  # nothing to learn from: what passes the base rules stays
    else:
        model.cut = choose_cut(model.score(x[held]), good[held])
    return model


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """SCHEMA's columns for every row of ``docs`` (doc_id, text); ``score`` is P(good), ``kept`` asks for the model's cut.

    Words are runs of non-white bytes (ASCII white space).  A null text has no words and fails the
    base rules, as an empty one does.  Repeated rows stay repeated, null ids stay, an empty table
    gives an empty one, other columns are not read.  A text is counted whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, x = statistics(batch.column("text"))
            failed, score = base_failed(counts), model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in counts.T.copy()], pa.array(failed), pa.array(~failed & (score >= model.cut)), pa.array(score)],
                                             [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_ruled(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns, that the base rules and the model keep; otherwise as ``judge``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            keep = [~base_failed(c) & (model.score(x) >= model.cut) for c, x in (statistics(p.column(0)) for p in slices([text]))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
