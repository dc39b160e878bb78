"""Operator 1: BPE encoding and decoding with forced boundaries.

A byte pair that no vocabulary token contains can never be merged across, so a text is cut at each
such pair and the fragments are encoded on their own and concatenated.  White space is in no token:
it cuts a text into chunks, whose results are kept in a bounded table; the chunks not yet known are
cut further by the pair table and all their fragments are merged together in numpy, one lowest rank
per fragment and pass.

The vocabulary is any ``tokenizers`` file with a BPE model over byte-level symbols, an end-of-word
suffix and no decoder: lower case, white space dropped, ids decoded as tokens joined by spaces.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from chatlake.llm.common import WHITE, HashIndex, mapped, slices, utf8

#: Bytes of text whose distinct chunks ``arrays`` encodes together.
ARRAYS_BYTES = 8 << 20
#: The same in ``encode_documents``, which also holds the ids as lists and the decoded texts: a task's Python takes about 110 MB for 1 MB, 340 for 8.
ENCODED_BYTES = 1 << 20
#: Words whose ids ``arrays`` keeps from one call to the next: they are indexed again in each call.
REMEMBERED_WORDS = 400_000
#: Chunks remembered by a Python worker in each of two generations.
REMEMBERED = 200_000

#: Characters whose normal form is their lower case, and the pre-tokens among them.  Fixed values of the vocabulary file.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PLAIN_CLASS = np.full(256, 3, np.uint8)  # other signs; letters, single digits and the separator follow
PLAIN_CLASS[97:123] = PLAIN_CLASS[128:] = 1
PLAIN_CLASS[48:58] = 2
PLAIN_CLASS[32] = 0

#: str.split() also cuts at these four, which are no white space to the vocabulary's patterns.
SEPARATORS = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile("[^\t-\r ]+")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in (vocab | self.special).items()}
        self.ids_text = [str(i) for i in range(max(self.token) + 1)]
        self.tokens_text = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        symbols = byte_symbols()
        self.symbol_byte = symbols
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for char, b in symbols.items():
            self.inner[b], self.final[b] = vocab[char], vocab[char + suffix]
        #: mergeable[a * 256 + b]: some token has byte b right after byte a.
        self.mergeable = np.zeros(1 << 16, dtype=bool)
        for token in vocab:
            of = [symbols[c] for c in token.removesuffix(suffix)]
            self.mergeable[[a * 256 + b for a, b in zip(of, of[1:])]] = True
        self.size = max(vocab.values()) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        keys = left * self.size + right
        self.made, self.no_rank = np.append(made, 0).astype(np.int32), len(keys)
        self.pairs = HashIndex(keys.view(np.uint64))
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    # -- chunks ---------------------------------------------------------------------------------

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk: the fragments of all chunks are merged at once."""
        plain = [k for k, c in enumerate(chunks) if PLAIN.fullmatch(c) and "<|" not in c]
        out: list[list[int]] = [[]] * len(chunks)
        for k, ids in zip(plain, self.encode_plain([chunks[k] for k in plain])):
            out[k] = ids
        if len(plain) < len(chunks):
            known = set(plain)
            for k in range(len(chunks)):
                if k not in known:
                    out[k] = self.encode_any(chunks[k])
        return out

    def encode_plain(self, chunks: list[str]) -> list[list[int]]:
        flat, at = self.encode_plain_flat(" ".join(chunks), len(chunks))
        ids, at = flat.tolist(), at.tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def encode_plain_flat(self, joined: str, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks, joined by spaces, of PLAIN characters (no apostrophe, so no contraction): pre-tokens are runs of letters or other signs, and digits."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data = np.frombuffer(joined.lower().encode(), np.uint8)
        kind = PLAIN_CLASS[data]
        start = np.ones(len(data), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = kind != 0
        chunk = np.cumsum(~inside)[inside]
        return self.encode_bytes(data[inside], start[inside], chunk, chunks)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (binary, none empty) one after another, and where each begins."""
        data, at = utf8(words)
        led = np.append(False, data[:-1] == 0xC3)
        sign = data < 128
        good = np.where(sign, (data > 32) & (data != 39) & (data < 127), (data == 0xC3) | (led & (data < 0xC0) & (data != 0x97) & (data != 0xB7)))
        good[:-1] &= (data[:-1] != 60) | (data[1:] != 124)  # "<|" may open a special token
        plain = np.logical_and.reduceat(good, at[:-1])
        size = np.diff(at)
        inside = np.repeat(plain, size)
        begin = np.cumsum(size[plain])[:-1]
        flat, ends = self.encode_plain_flat(np.insert(data[inside], begin, 32).tobytes().decode(), int(plain.sum()))
        if plain.all():
            return flat.astype(np.uint32), ends
        other = [np.array(self.encode_any(w.decode()), np.uint32) for w in words.filter(pa.array(~plain)).to_pylist()]
        size[plain], size[~plain] = np.diff(ends), [len(x) for x in other]
        out = np.empty(int(size.sum()), np.uint32)
        own = np.repeat(plain, size)
        out[own], out[~own] = flat, np.concatenate(other)
        return out, np.append(0, np.cumsum(size))

    def encode_any(self, chunk: str) -> list[int]:
        """Any chunk: special tokens that it spells out, then the library's normal form and pre-tokens."""
        out: list[int] = []
        for part in self.special_re.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                pieces = [[self.symbol_byte[c] for c in p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
                data = np.array([b for p in pieces for b in p], np.uint8)
                start = np.zeros(len(data), dtype=bool)
                start[np.cumsum([0, *map(len, pieces)])[:-1]] = True
                out += self.encode_bytes(data, start, np.zeros(len(data), np.int64), 1)[0].tolist()
        return out

    def encode_bytes(self, data: np.ndarray, start: np.ndarray, chunk: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and where each begins; start: the first bytes of pre-tokens, chunk: of each byte."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(chunks + 1, np.int64)
        data = data.astype(np.int32)
        last = np.append(start[1:], True)
        symbol = np.where(last, self.final[data], self.inner[data])
        cut = start.copy()
        cut[1:] |= ~self.mergeable[data[:-1] * 256 + data[1:]]
        ids, of = self.merge(symbol, np.cumsum(cut, dtype=np.int32) - 1)
        return ids, np.searchsorted(chunk[cut][of], np.arange(chunks + 1))

    def merge(self, symbol: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the lowest-ranked pair of every fragment, again and again; ids and their fragments, in order."""
        none, done_symbol, done_fragment = self.no_rank, [], []
        while len(symbol):
            first = np.empty(len(symbol), dtype=bool)
            first[0] = True
            np.not_equal(fragment[1:], fragment[:-1], out=first[1:])
            begin = np.flatnonzero(first)
            rank = np.full(len(symbol), none, np.int32)
            inside = np.flatnonzero(~first) - 1
            rank[inside] = self.pairs.find((symbol[inside].astype(np.int64) * self.size + symbol[inside + 1]).view(np.uint64))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(symbol)))
            go = least < none
            if not go.all():
                stay = np.repeat(~go, length)
                done_symbol.append(symbol[stay])
                done_fragment.append(fragment[stay])
                keep = ~stay
                symbol, fragment, rank = symbol[keep], fragment[keep], rank[keep]
                least, length = least[go], length[go]
                if not len(symbol):
                    break
            join = rank == np.repeat(least, length)
            if (join[1:] & join[:-1]).any():  # a run of one symbol: every other pair, from the left
                start = join.copy()
                start[1:] &= ~join[:-1]
                since = np.arange(len(join)) - np.maximum.accumulate(np.where(start, np.arange(len(join)), 0))
                join &= since % 2 == 0
            symbol = np.where(join, self.made[rank], symbol)
            keep = np.ones(len(symbol), dtype=bool)
            keep[1:] = ~join[:-1]
            symbol, fragment = symbol[keep], fragment[keep]
        if not done_symbol:
            return symbol, fragment
        symbol, fragment = np.concatenate(done_symbol), np.concatenate(done_fragment)
        order = np.argsort(fragment, kind="stable")
        return symbol[order], fragment[order]

    # -- texts ----------------------------------------------------------------------------------

    def texts(self, texts: list[str | None], result: Callable[[list[int]], tuple], kind: str) -> Iterator[list]:
        """For each text the list of ``result(ids)`` of its chunks; ``kind`` names what result makes."""
        if getattr(self, "kind", kind) != kind:
            self.new, self.old = {}, {}
        self.kind = kind
        split = [CHUNKS.findall(t) if SEPARATORS.search(t) else t.split() for t in (t or "" for t in texts)]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        unknown = []
        for chunk in set().union(*split):
            if chunk not in self.new:
                if chunk in self.old:
                    self.new[chunk] = self.old[chunk]
                else:
                    unknown.append(chunk)
        for chunk, ids in zip(unknown, self.encode_chunks(unknown)):
            self.new[chunk] = result(ids)
        return (list(map(self.new.__getitem__, chunks)) for chunks in split)

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words known so far, where each one's begin, and which of them each of ``words`` is.

        Words that the last calls had are not encoded again; beyond REMEMBERED_WORDS only those of this call stay.
        """
        known, flat, at = getattr(self, "held", (words.slice(0, 0), np.zeros(0, np.uint32), np.zeros(1, np.int64)))
        place = pc.index_in(words, value_set=known)
        new = words.filter(place.is_null())
        ids, ends = self.encode_words(new)
        out = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        out[out < 0] = len(known) + np.arange(len(new))
        known, flat, at = pa.concat_arrays([known, new]), np.concatenate([flat, ids.astype(np.uint32)]), np.append(at, at[-1] + ends[1:])
        if len(known) > REMEMBERED_WORDS:
            lo, size = at[out], np.diff(at)[out]
            known, at, out = words, np.append(0, np.cumsum(size)), np.arange(len(words))
            flat = flat[np.arange(at[-1]) + np.repeat(lo - at[:-1], size)]
        self.held = known, flat, at
        return flat, at, out

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after another, and where each text's begin (nulls are empty).

        White space cuts the bytes into chunks; each distinct one is encoded once, without a Python object.
        """
        data, at = utf8(texts)
        solid = ~WHITE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        first = at[:-1][at[:-1] < len(data)]
        begin[first] = solid[first]  # a text's first byte begins a chunk after any byte
        last = solid.copy()
        last[:-1] &= ~solid[1:] | begin[1:]
        begin = np.flatnonzero(begin)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        place = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - begin))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(place), pa.py_buffer(data[solid])]).dictionary_encode()
        held, held_at, place = self.remembered(chunks.dictionary)
        code = place[chunks.indices.to_numpy()]
        lo, size = held_at[code], np.diff(held_at)[code]
        ends = np.append(0, np.cumsum(size))
        ids = held[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)]
        return ids, ends[np.searchsorted(begin, at)]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in next(self.texts([text], tuple, "ids")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces; ids that are not in the vocabulary give nothing."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def as_texts(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.ids_text[i] for i in ids]), " ".join([self.tokens_text[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, with ``decoded`` also (text) decoded from the ids; no other column of ``docs`` is read.

    A null or empty text, or one of white space only, has no ids, and decodes to an empty text.  Repeated
    rows stay repeated; an empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, limit=ENCODED_BYTES):
            flat, at = bpe.arrays(batch.column("text"))
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
            back = [pa.array([bpe.decode(flat[a:b].tolist()) for a, b in zip(at, at[1:])], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *back], ["doc_id", "ids", *["text"] * decoded])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the tokens joined by spaces.

    Null or empty ids give an empty text, ids that are not in the vocabulary nothing.  Repeated rows stay
    repeated, null doc_ids stay; an empty table gives an empty table; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids, digest both.

    Digests are lowercase hex of the decimal ids joined by one space, and of the decoded text in
    UTF-8.  Decoding joins tokens by spaces, so the texts of the chunks join the same way.  Null and
    empty texts: no tokens, both digests of the empty string.  Repeated rows stay repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches):
            n, ids, decoded = [], [], []
            for chunks in bpe.texts(batch.column("text").to_pylist(), bpe.as_texts, "texts"):
                chunks = [c for c in chunks if c[0]]
                n.append(sum([c[0] for c in chunks]))
                ids.append(hashlib.sha256(" ".join([c[1] for c in chunks]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([c[2] for c in chunks]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
