"""Operator 7: LM scores from all segmentations of a text into subwords.

The pieces of an existing vocabulary span a lattice over the bytes of each word; the probability of
a word is the sum over all its segmentations of the product of its pieces' unigram probabilities, by
forward recursion in log space.  The vocabulary's scores order the pieces; their probabilities start
from that order and are re-estimated on the training words by expected counts over all
segmentations.  A text is its words, each with its leading space, and an end.

Words are unbounded in number, so they stay in tables: texts are cut into blocks of bounded size with
a dictionary each, dictionary rows meet the corpus counts by an equi-join on the word (one row for
a block and word, so no word is hot), and go back to their block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import HashIndex, segment_reduce, slices, span_hashes, staged

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Weight of the vocabulary's own order, in training pieces.
PRIOR_PIECES = 2_000.0
#: Rounds of re-estimation.
ROUNDS = 2
#: Longer words, in bytes, are worked through by stretches.
LONG_BYTES = 1024
#: Bytes of words in one lattice pass.
PASS_BYTES = 200_000

ZSTD = pa.Codec("zstd", compression_level=1)


class Pieces:
    """The pieces of a vocabulary that a word can be made of: a space at its beginning or none, and all single bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        text: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).replace("▁", " ")
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and " " not in piece[1:]:
                text[piece.encode()] = model.get_score(i)
        least = min(text.values(), default=0.0)
        for b in range(256):  # byte fallback: bytes that are no piece, after all pieces
            text.setdefault(bytes([b]), least - 1 - b)
        self.text = sorted(text, key=lambda p: (-text[p], p))
        rank = np.arange(len(self.text))
        self.prior = 1 / (rank + 10.0)
        self.prior /= self.prior.sum()
        ends = np.cumsum([len(p) for p in self.text])
        data = np.frombuffer(b"".join(self.text), np.uint8)
        self.index = HashIndex(span_hashes(data, np.append(0, ends[:-1]), ends))
        self.lengths = sorted({len(p) for p in self.text})


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All pieces of some words, the words in the order of falling length."""

    def __init__(self, known: Pieces, words: list[bytes]):
        length = np.array([len(w) + 1 for w in words], np.int64)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        data = np.frombuffer(b"".join([b" " + words[k] for k in self.order]), np.uint8)
        self.known, self.begin = known, np.append(0, np.cumsum(self.length))[:-1]
        stop = np.repeat(self.begin + self.length, self.length)
        place = np.arange(len(data))
        #: piece[k, e]: the piece of lengths[k] bytes whose last byte is e, or ``missing``.
        self.piece = np.full((len(known.lengths), len(data)), known.index.missing, np.int32)
        for k, n in enumerate(known.lengths):
            start = place[place + n <= stop]
            if len(start):
                self.piece[k, start + n - 1] = known.index.find(span_hashes(data, start, start + n))
        self.longest = int(self.length[0]) if len(words) else 0

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """alpha[e + word]: log probability of all segmentations of the bytes up to e of each word; one more place than bytes for each."""
        alpha = np.full(self.piece.shape[1] + len(self.length), -np.inf)
        shifted = self.begin + np.arange(len(self.begin))
        alpha[shifted] = 0.0
        weight = np.append(logs, -np.inf)
        for r in range(self.longest):
            n = int(np.searchsorted(-self.length, -r))  # words longer than r
            used = [k for k, m in enumerate(self.known.lengths) if m <= r + 1]
            ways = np.stack([alpha[shifted[:n] + r + 1 - self.known.lengths[k]] + weight[self.piece[k, self.begin[:n] + r]] for k in used])
            alpha[shifted[:n] + r + 1] = _log_sum(ways)
        return alpha

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of each word, in the given order."""
        alpha = self.forward(logs)
        out = np.empty(len(self.length))
        out[self.order] = alpha[self.begin + np.arange(len(self.begin)) + self.length]
        return out

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in ``times`` copies of each word."""
        alpha = self.forward(logs)
        shifted = self.begin + np.arange(len(self.begin))
        total = alpha[shifted + self.length]
        beta = np.full_like(alpha, -np.inf)
        beta[shifted + self.length] = 0.0
        weight = np.append(logs, -np.inf)
        count = np.zeros(len(logs) + 1)
        times = times[self.order]
        for r in range(self.longest - 1, -1, -1):
            n = int(np.searchsorted(-self.length, -r))
            ways = []
            for k, m in enumerate(self.known.lengths):
                own = int(np.searchsorted(-self.length, -(r + m - 1)))  # words with a byte at r + m - 1
                if not own:
                    continue
                piece = self.piece[k, self.begin[:own] + r + m - 1]
                way = weight[piece] + beta[shifted[:own] + r + m]
                share = np.exp(np.minimum(alpha[shifted[:own] + r] + way - total[:own], 0))
                count += np.bincount(piece, weights=share * times[:own], minlength=len(count))
                ways.append(np.append(way, np.full(n - own, -np.inf)))
            beta[shifted[:n] + r] = _log_sum(np.stack(ways))
        return count[:-1]


class LongWord:
    """One word of any length, by stretches: a step of the recursion works on all stretches of a run at once.

    The recursion at a byte needs the values of the last bytes only, as many as the longest piece has.  So
    each stretch is first run from every one of these alone, which tells how it maps what comes in to what
    goes out; the maps are applied one after another; then all stretches run again from what really comes in.
    """

    def __init__(self, known: Pieces, word: bytes, stretch: int = 256, run: int = 1 << 16):
        self.known, self.stretch, self.run = known, stretch, run
        self.data = np.frombuffer(b" " + word, np.uint8)
        self.back = known.lengths[-1]

    def _pieces(self, start: np.ndarray, size: int) -> np.ndarray:
        """The piece of ``size`` bytes at each of the places, which follow one another upwards or downwards, or ``missing``."""
        out = np.full(len(start), self.known.index.missing, np.int64)
        some = np.flatnonzero((start >= 0) & (start + size <= len(self.data)))
        if len(some):
            low = int(start[some].min())
            near = self.data[low:int(start[some].max()) + size]
            out[some] = self.known.index.find(span_hashes(near, start[some] - low, start[some] - low + size))
        return out

    def _recursion(self, weight: np.ndarray, backward: bool) -> np.ndarray:
        """Log probability of all segmentations up to each place (or from it on), the first (last) place included."""
        size, back = len(self.data), self.back
        out = np.empty(size + 1)
        out[0] = 0.0
        state = np.full(back, -np.inf)  # of the last places, the latest first
        state[0] = 0.0
        for low in range(0, size, self.run):
            place = np.arange(low, min(low + self.run, size))
            count = -(-len(place) // self.stretch)
            ways = np.full((len(self.known.lengths), count * self.stretch), -np.inf)
            for k, n in enumerate(self.known.lengths):
                ways[k, :len(place)] = weight[self._pieces(size - 1 - place if backward else place - n + 1, n)]
            ways = ways.reshape(len(ways), count, self.stretch)
            maps = self._run(ways, np.where(np.eye(back, dtype=bool), 0.0, -np.inf)[None].repeat(count, axis=0))[..., :-back - 1:-1]
            entry = np.empty((count, 1, back))
            for s in range(count):
                entry[s, 0] = state
                state = _log_sum(state[:, None] + maps[s])
            inside = self._run(ways, entry)[:, 0, back:].ravel()[:len(place)]
            out[low + 1:low + 1 + len(place)] = inside
        return out[::-1] if backward else out

    def _run(self, ways: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Values of each stretch for each of its entries, after the entry's own ones (the earliest first)."""
        value = np.full((*entry.shape[:2], self.back + self.stretch), -np.inf)
        value[..., :self.back] = entry[..., ::-1]
        for r in range(self.stretch):
            value[..., self.back + r] = _log_sum(np.stack([value[..., self.back + r - n] + ways[k, :, r, None] for k, n in enumerate(self.known.lengths)]))
        return value

    def total(self, logs: np.ndarray) -> float:
        """Log probability of the word."""
        return float(self._recursion(np.append(logs, -np.inf), False)[-1])

    def expected(self, logs: np.ndarray, times: float) -> np.ndarray:
        """Expected number of each piece in ``times`` copies of the word."""
        weight = np.append(logs, -np.inf)
        alpha, beta = self._recursion(weight, False), self._recursion(weight, True)
        count = np.zeros(len(weight))
        for low in range(0, len(self.data), self.run):
            start = np.arange(low, min(low + self.run, len(self.data)))
            for n in self.known.lengths:
                own = start[start + n <= len(self.data)]
                piece = self._pieces(own, n)
                share = np.exp(np.minimum(alpha[own] + weight[piece] + beta[own + n] - alpha[-1], 0))
                count += np.bincount(piece, weights=share * times, minlength=len(count))
        return count[:-1]


def totals(known: Pieces, words: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Log probability of each word."""
    out, short = np.empty(len(words)), [k for k, w in enumerate(words) if len(w) <= LONG_BYTES]
    for k in set(range(len(words))).difference(short):
        out[k] = LongWord(known, words[k]).total(logs)
    few = [words[k] for k in short]
    if few:
        out[short] = np.concatenate([Lattice(known, few[part]).totals(logs) for part in passes(few)])
    return out


def expected(known: Pieces, words: list[bytes], logs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected number of each piece in ``times`` copies of each word."""
    total, short = np.zeros(len(logs)), [k for k, w in enumerate(words) if len(w) <= LONG_BYTES]
    for k in set(range(len(words))).difference(short):
        total += LongWord(known, words[k]).expected(logs, times[k])
    few = [words[k] for k in short]
    for part in passes(few):
        total += Lattice(known, few[part]).expected(logs, times[short][part])
    return total


def _log_sum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(ways - top).sum(axis=0))


def passes(words: list[bytes]) -> Iterator[slice]:
    """Runs of words with about PASS_BYTES bytes."""
    run = np.cumsum([len(w) + 1 for w in words]) // PASS_BYTES
    edge = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(words)]
    return (slice(a, b) for a, b in zip(edge, edge[1:]) if b > a)


def pack(codes: np.ndarray) -> bytes:
    """The codes of a text: all lowest bytes, then all second bytes and so on, compressed."""
    return ZSTD.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpack(data: bytes, words: int) -> np.ndarray:
    planes = np.frombuffer(ZSTD.decompress(data, decompressed_size=4 * words), np.uint8).reshape(4, words)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, train: Column) -> DataFrame:
    """Rows of two kinds: documents (block, doc_id, train, words, codes) and dictionary entries (block, code, word, times in training texts).

    codes: see ``pack``.

    Words are what stands between white space (0x20, 0x09-0x0D), A-Z lowered; ``train`` says which rows are training texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        code: dict[bytes, int] = {}  # in the order of first use, so that frequent words have small codes
        ids, learned, codes = [], [], []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            own = TaskContext.get().partitionId() << 32 | number
            at = np.cumsum([0, *map(len, codes)])
            flat = np.concatenate(codes)
            times = np.bincount(flat[np.repeat(np.array(learned, bool), np.diff(at))], minlength=len(code))
            for lo in range(0, len(codes), 256):
                some = codes[lo:lo + 256]
                rows = len(some)
                yield _typed(rows, block=pa.array([own] * rows, pa.int64()), doc_id=pa.array(ids[lo:lo + rows], pa.int64()), train=pa.array(learned[lo:lo + rows], pa.bool_()),
                             words=pa.array([len(x) for x in some], pa.int64()), codes=pa.array(map(pack, some), pa.binary()))
            words = list(code)
            for lo in range(0, len(words), 20_000):
                some = words[lo:lo + 20_000]
                yield _typed(len(some), block=pa.array([own] * len(some), pa.int64()), word=pa.array(some, pa.binary()),
                             code=pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), times=pa.array(times[lo:lo + len(some)]))
            number, size = number + 1, 0
            for kept in (code, ids, learned, codes):
                kept.clear()

        for batch in slices(batches):
            texts = [(t or "").encode().lower().split() for t in batch.column("text").to_pylist()]
            for w in dict.fromkeys(chain.from_iterable(texts)):
                code.setdefault(w, len(code))
            codes += [np.fromiter(map(code.__getitem__, t), np.int32, len(t)) for t in texts]
            ids += batch.column("doc_id").to_pylist()
            learned += batch.column("train").to_pylist()
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from block()
        if codes:
            yield from block()

    return docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")) \
        .mapInArrow(run, ", ".join(f"{n} {SQL_TYPES.get(n)}" for n in SQL_TYPES))


SQL_TYPES = {"block": "long", "doc_id": "long", "train": "boolean", "words": "long", "codes": "binary", "word": "binary", "code": "int", "times": "long"}
_ARROW = {"block": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "words": pa.int64(), "codes": pa.binary(), "word": pa.binary(), "code": pa.int32(), "times": pa.int64()}


def _typed(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, t)) for n, t in _ARROW.items()], list(_ARROW))


def estimate(counts: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probability of each piece, and of the end, from (word, c) and the number of training texts.

    Each round counts the pieces as the one before expects them; the first starts from the vocabulary's order.
    """
    prior = pieces(path).prior
    whole = PRIOR_PIECES + ends + 1
    logs = np.log(PRIOR_PIECES * prior / whole)
    for _ in range(rounds):
        weight = PRIOR_PIECES * prior
        for r in expected_pieces(counts, path, logs).collect():  # one row a piece
            weight[r.piece] += r.n
        whole = weight.sum() + ends + 1
        logs = np.log(weight / whole)
    return logs, float(np.log((ends + 1) / whole))


def expected_pieces(counts: DataFrame, path: str, logs: np.ndarray) -> DataFrame:
    """(piece, n): how often each piece is expected in all segmentations of the training words."""
    held = counts.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        total = np.zeros(len(known.text))
        for batch in batches:
            words, times = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64)
            total += expected(known, words, held.value, times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    return counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, train: Column, path: str) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    base_score: sum over words and the end of log10((c + 1) / (N + V + 1)), c the token's count in
    training texts, N all and V the distinct ones (the end is one).  score: log10 probability of the
    text in the lattice model.  Null and empty texts have the end only.  Repeated rows stay repeated;
    an empty table gives an empty table; without training texts the pieces keep the vocabulary's order.
    """
    made = staged(blocks(docs, train), "blocks", compression="zstd")
    texts, entries = made.filter("code is null"), made.filter("code is not null").select(F.col("block").alias("home"), "code", "word", "times")
    counts = staged(entries.groupBy("word").agg(F.sum("times").alias("c")), "counts")
    ends = texts.filter("train").count()
    n, v = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    logs, end = estimate(counts, path, ends)
    held = docs.sparkSession.sparkContext.broadcast(logs)  # one number a piece

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            words = batch.column("word").to_pylist()
            if words:
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(totals(known, words, held.value))], ["word", "c", "lattice"])

    whole = n + v + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        order = right.column("code").to_numpy()
        c, lattice = np.zeros(size), np.zeros(size)
        c[order], lattice[order] = right.column("c").to_numpy(), right.column("lattice").to_numpy()
        words = left.column("words").to_numpy()
        at = np.append(0, np.cumsum(words))
        flat = np.concatenate([np.zeros(0, np.int64), *map(unpack, left.column("codes").to_pylist(), words.tolist())])
        base = segment_reduce(np.add, np.log10((c + 1) / whole)[flat], at, 0.0) + np.log10((ends + 1) / whole)
        text = (segment_reduce(np.add, lattice[flat], at, 0.0) + end) / np.log(10)
        seen = segment_reduce(np.add, (c > 0).astype(np.int64)[flat], at, 0) + (ends > 0)
        rows = len(at) - 1
        return pa.Table.from_arrays([left.column("doc_id"), left.column("train"), pa.array(np.diff(at) + 1), pa.array(seen), pa.array([n] * rows, pa.int64()), pa.array(base), pa.array(text)],
                                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    valued = entries.select("home", "code", "word").join(counts.mapInArrow(weigh, "word binary, c long, lattice double"), "word").select("home", "code", "c", "lattice")
    return texts.select("block", "doc_id", "train", "words", "codes").groupBy("block").cogroup(valued.groupBy("home")) \
        .applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
