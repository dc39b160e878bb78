"""Operator 5: language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 with frozen counts.  A byte that its context
has not seen costs the context's escape and is predicted by the next shorter one, down to equal
shares of all 256 bytes; a text's code length in a language is the exact sum of these costs.  The
cost depends on four bytes only, so the trees of all languages are unrolled into one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import give_back, mapped, segment_reduce, slices, staged, utf8

#: Documents of each language whose whole texts the trees are built from, in the order of a hash of their id.
SAMPLE_DOCS = 1000
#: Contexts of three bytes seen less often (all languages together) are left to shorter contexts.
LEAST_SEEN = 4
#: Contexts whose costs are worked out at once.
COST_ROWS = 4096
#: Bytes of text coded at once where bounds are learned or applied: each takes about 50 bytes.
CODED_BYTES = 512 << 10
#: Each text begins as if after this many newlines.
ORDER = 3

UNKNOWN = "und"

#: One in so many sampled documents is held out to learn what a letter of its language costs.
HELD_FOLDS = 5
#: A text is too far from a language if a letter costs more than this many times the quantile of its held-out documents.
RATE_QUANTILE, RATE_MARGIN = 0.95, 2.25
#: Languages with fewer held-out documents take the quantile of all languages' ones.
LEAST_HELD = 20
#: Bits that a text has free: a few letters alone tell nothing.
FREE_BITS = 20.0

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER newlines, and where each begins."""
    return utf8(pc.binary_join_element_wise("\n" * ORDER, pc.fill_null(column, "").cast(pa.string()), ""))


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end in each byte of each text, as one number, and where each text's begin."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    wide = data.astype(np.uint32)
    value = wide.copy()
    for k in range(1, ORDER + 1):
        value[k:] |= wide[:-k] << np.uint32(8 * k)
    own = np.ones(len(data), dtype=bool)
    for k in range(ORDER):
        own[at[:-1] + k] = False
    return value[own], at - ORDER * np.arange(len(at))


@dataclass
class PPM:
    """``symbol`` maps bytes to columns (last: unseen); ``context`` maps three columns to a row; ``cost`` has bits by row, column, language.

    ``bound`` has the most bits a letter of a text in each language; None if not learned.
    """

    languages: list[str]
    symbol: np.ndarray
    context: np.ndarray
    cost: np.ndarray
    bound: np.ndarray | None = None

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each byte (rows) in each language (columns), the windows, and where each text's begin."""
        data, at = padded(column)
        value, at = windows(data, at)
        n = self.cost.shape[1]
        part = [self.symbol[(value >> np.uint32(8 * k)) & np.uint32(255)] for k in range(ORDER + 1)]
        row = self.context[(part[3] * n + part[2]) * n + part[1]]
        return self.cost.reshape(-1, len(self.languages))[row.astype(np.int64) * n + part[0]], value, at

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each text (rows) in each language (columns)."""
        bits, _, at = self.coded(column)
        return segment_reduce(np.add, bits.astype(np.float64), at, 0.0)


def letter_rates(bits: np.ndarray, value: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Bits a byte of letters, FREE_BITS left out, of each text in its language ``of`` (a column), from what ``coded`` gives.

    Digits, signs and what follows a digit don't count: keys, numbers and addresses are in no language.
    """
    use = _LETTER[value & np.uint32(255)]
    for k in range(1, ORDER + 1):
        use &= ~_DIGIT[(value >> np.uint32(8 * k)) & np.uint32(255)]
    total = np.zeros(len(of))
    for k in np.unique(of):  # one column at a time: memory
        own = segment_reduce(np.add, np.where(use, bits[:, k], 0).astype(np.float64), at, 0.0)
        total[of == k] = own[of == k]
    count = segment_reduce(np.add, use.astype(np.int64), at, 0)
    return np.maximum(total - FREE_BITS, 0) / np.maximum(count, 1)


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> PPM:
    """The table of all languages from each one's windows and how often they were seen."""
    seen = np.zeros(256, dtype=bool)
    for value, _ in counts:
        for k in range(ORDER + 1):
            seen[(value >> np.uint32(8 * k)) & np.uint32(255)] = True
    symbol = np.full(256, seen.sum(), np.int32)
    symbol[seen] = np.arange(seen.sum())
    n = int(seen.sum()) + 1
    spread = [[symbol[(value >> np.uint32(8 * k)) & np.uint32(255)].astype(np.int64) for k in range(ORDER + 1)] for value, _ in counts]
    context_of = [(p[3] * n + p[2]) * n + p[1] for p in spread]
    total = np.zeros(n ** 3, np.int64)
    for where, (_, times) in zip(context_of, counts):
        np.add.at(total, where, times)
    known = np.flatnonzero(total >= LEAST_SEEN)
    pairs = n * n  # rows: first each pair of bytes, for contexts cut to two, then the known contexts of three
    context = (np.arange(n ** 3) % pairs).astype(np.int32)
    context[known] = pairs + np.arange(len(known))
    cost = np.empty((pairs + len(known), n, len(languages)), np.float32)
    for at, (p, (_, times)) in enumerate(zip(spread, counts)):
        below = np.full((1, n), 8.0)
        for order in range(ORDER):  # all contexts of this order, from those of the order before
            table = np.zeros((n ** order, n))
            where = sum((p[k] * n ** (k - 1) for k in range(1, order + 1)), np.zeros(len(times), np.int64))
            np.add.at(table, (where, p[0]), times)
            below = _costs(table, below, np.arange(len(table)) % len(below))
        cost[:pairs, :, at] = below
        table = np.zeros((len(known), n))
        own = context[context_of[at]] - pairs
        np.add.at(table, (own[own >= 0], p[0][own >= 0]), times[own >= 0])
        cost[pairs:, :, at] = _costs(table, below, known % pairs)
    return PPM(languages, symbol, context, cost)


def _costs(table: np.ndarray, below: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bits of each byte in each context: its share where seen, else the escape's share and the shorter context's bits.

    A context seen t times with d different bytes escapes with d / (t + d); one never seen escapes for free.
    ``shorter`` is each context's row in ``below``.  The counts in ``table`` are replaced, some rows at a time: memory.
    """
    for at in range(0, len(table), COST_ROWS):
        part = table[at:at + COST_ROWS]
        times, kinds = part.sum(axis=1, keepdims=True), (part > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(times + kinds, 1)
        escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
        part[:] = np.where(part > 0, -np.log2(np.maximum(part, 1) / whole), escape + below[shorter[at:at + COST_ROWS]])
    return table


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, bounded: bool = False) -> PPM:
    """Trees from (doc_id, text, lang): for each lang the whole texts of at most ``sample`` documents.

    Rows with null lang, text or doc_id are not used.  Without any, there are no languages and every prediction is und.
    ``bounded`` learns ``bound`` as well: trees of all but a fold of the same documents, measured on that fold.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    # The least hashes of each language: counted by their first byte, and where the sample ends in it by their
    # second, so that only 1 / 65,536 of a language is ranked and no task sorts one.
    ranked = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")) \
        .withColumn("first", F.shiftright("h", 56)).withColumn("second", F.shiftright("h", 48))

    def reached(rows: DataFrame, part: str, start: Column) -> DataFrame:
        """(lang, part, before, n) of the parts in which the sample has room: at most 256 of a language are counted."""
        so_far = Window.partitionBy("lang").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
        return rows.groupBy("lang", part).agg(F.count("*").alias("n"), F.max(start).alias("start")) \
            .withColumn("before", F.col("start") + F.sum("n").over(so_far) - F.col("n")).filter(F.col("before") < sample).drop("start")

    firsts = reached(ranked, "first", F.lit(0))
    ranked = ranked.join(firsts, ["lang", "first"])
    whole = (F.col("before") + F.col("n") <= sample)
    edge = ranked.filter(~whole).withColumnRenamed("before", "start").drop("n")
    edge = edge.join(reached(edge, "second", F.col("start")), ["lang", "second"])
    last = Window.partitionBy("lang", "second").orderBy("h", "doc_id")
    edge = edge.withColumn("k", F.row_number().over(last)).filter(F.col("before") + F.col("k") <= sample)
    ranked = ranked.filter(whole).select("doc_id", "lang").unionByName(edge.select("doc_id", "lang"))
    chosen = ranked.select(F.col("doc_id").alias("id"), F.col("lang").alias("of")).distinct()
    picked = known.join(chosen, (known.doc_id == chosen.id) & (known.lang == chosen.of), "left_semi")
    if bounded:
        picked = staged(picked.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_FOLDS)) == 0), "languages")
        rates = _rates(picked.filter("held"), _trees(picked.filter("not held")))  # before the other trees: one model at a time
        give_back()
    model = _trees(picked)
    if bounded:
        model.bound = _bounds(model.languages, *rates)
    give_back()  # the driver goes on
    return model


def _rates(held: DataFrame, model: PPM) -> tuple[np.ndarray, np.ndarray]:
    """Languages of the ``held`` texts that the model has, and the bits a letter of each text in its own."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: k for k, name in enumerate(sent.value.languages)}
        for batch in slices(batches, limit=CODED_BYTES):
            place = np.array([at.get(name, -1) for name in batch.column("lang").to_pylist()])
            if (place >= 0).any():
                rate = letter_rates(*sent.value.coded(batch.column("text")), place)
                yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(place >= 0)), pa.array(rate[place >= 0])], ["lang", "rate"])

    found = mapped(held, run, "lang string, rate double").toArrow()
    sent.destroy()  # else every Python worker keeps these trees besides the ones that are used
    return np.array(found.column("lang").to_pylist(), dtype=object), found.column("rate").to_numpy()


def _bounds(languages: list[str], lang: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Most bits a letter of a text in each language, from the rates of held-out texts in their own; without any such text, no limit."""
    own = [rate[lang == name] for name in languages]
    return np.array([RATE_MARGIN * np.quantile(x if len(x) >= LEAST_HELD else rate, RATE_QUANTILE) if len(rate) else np.inf for x in own])


def _trees(picked: DataFrame) -> PPM:
    """Trees of all texts of each lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang in pc.unique(batch.column("lang")):
                data, at = padded(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
                value, times = np.unique(windows(data, at)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(times)],
                                                 ["lang", "value", "times"])

    found = mapped(picked, run, "lang string, value long, times long").groupBy("lang", "value").agg(F.sum("times").alias("times")).toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    value, times = found.column("value").to_numpy().astype(np.uint32), found.column("times").to_numpy()
    languages = sorted(set(lang))
    counts = []
    for name in languages:
        own = lang == name
        order = np.argsort(value[own])
        counts.append((value[own][order], times[own][order]))
    return build(languages, counts)


def predictions(column: pa.Array, model: PPM, bounded: bool = False) -> tuple[list[str], np.ndarray]:
    """Language of the shortest code of each text, and its share of the weights 2 ** -length; und with 0 for texts without letters.

    With ``bounded``, und with 0 also for texts whose letters cost more than the language's bound.
    """
    texts = column.to_pylist()
    has_letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    each, value, at = model.coded(column)
    bits = segment_reduce(np.add, each.astype(np.float64), at, 0.0)
    best = bits.argmin(axis=1)
    if bounded:
        has_letter &= letter_rates(each, value, at, best) <= model.bound[best]
    share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter)], np.where(has_letter, share, 0.0)


def identify(docs: DataFrame, model: PPM) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from ``text`` alone.

    score is the posterior of lang_pred with equal priors (0 for und: null, empty, no letter).  Ties
    go to the first language by name.  Repeated rows stay repeated; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was built from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = predictions(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: PPM, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with score ``least_score`` or more and is within its bound.

    The score only compares the learned languages; the bound, which ``train`` learns if ``bounded``, keeps out texts in none of them.
    """
    if model.bound is None:
        raise ValueError("the model has no bounds; train it with bounded=True")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in slices([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])], limit=CODED_BYTES):
                lang, score = predictions(part.column(0), held.value, bounded=True)
                keep += [x != UNKNOWN and s >= least_score for x, s in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
