"""Operator 6: token ids in files, by a context-mixing range coder.

Ids are cut into blocks of BLOCK ids; each block starts from an empty model, carries a checksum and
can be read alone.  Each id has a guess: what last followed the same two ids (order 2), or else the
same id (order 1).  One binary choice says whether the guess is right; its probability mixes the
block's hits with those of its context.  An id that was not guessed is coded by the adaptive counts of the
block's ids (order 0), which also say how likely a new one is; new ids follow in equal shares.
Counts are brought up to date at fixed places (``STEPS``), so that between these many blocks are
coded in step, one numpy lane each, with tables that stand still.

Blocks are rows (file, block, n_tokens, payload) of a table that Spark writes: its commit protocol
leaves whole files only, also when executors are lost.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.bpe import ARRAYS_BYTES, encoder
from chatlake.llm.common import slices, staged

BLOCK = 4096
LANES = 2048
#: Places of ids in lanes that the coder looks up at a time, 2 bytes each.
PLACES = 1 << 26
#: Places in a block at which its counts are brought up to date; later ones follow every 512 ids.
STEPS = (24, 64, 144, 288, 512, 768, 1024)
MAGIC = b"CMR2"
#: magic, ids, bits of the largest id, documents or parts of them, 24-bit words, crc32 of what follows.
HEADER = struct.Struct("<4sIBIII")
#: id of the document (0 if it has none), 1: its first ids are here, 2: its id is null; ids here.
PART = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("count", "<u4")])

#: Places that remember what followed two ids, and one.
_SLOTS2, _SLOTS1 = 1024, 512
#: Contexts of the binary choice: a guess of order 1 or none, one of order 2; each after a miss and after a hit.
_ROWS = 4
#: Shares of the binary choice, and of the ids of a block, as powers of two.
_CHOICE, _SHARE = 12, 12
#: Different ids of a block that are counted; what comes later stays new each time.
_KNOWN = 3000
#: The width of a lane's interval is at least 2 ** 32 and under 2 ** 56; words have 24 bits.
_LEAST = np.uint64(1 << 32)
_24, _32 = np.uint64(24), np.uint64(32)
_0, _2, _SPAN = np.uint64(0), np.int64(2), np.int32(0xFFFF)
_BELOW = np.uint64((1 << 32) - 1)


class _Model:
    """Adaptive state of many blocks; ``n`` lanes are active at a time, the first ones."""

    def __init__(self, lanes: int, guessing: bool):
        self.lane = np.arange(lanes)
        self.base_row = self.lane * _ROWS
        if guessing:  # step by step; ``_choices`` has those of whole blocks
            self.base2, self.base1 = self.lane * _SLOTS2, self.lane * _SLOTS1
            self.after2, self.after1 = np.full(lanes * _SLOTS2, -1, np.int32), np.full(lanes * _SLOTS1, -1, np.int32)
            self.back1, self.back2, self.row = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), self.base_row.copy()
        self.tries, self.hits = np.zeros(lanes * _ROWS, np.int64), np.zeros(lanes * _ROWS, np.int64)
        #: The ids of each lane so far in the order of their first count, their counts, and how many they are.
        self.ids, self.count = np.zeros((lanes, 64), np.int32), np.zeros((lanes, 64), np.int32)
        self.known = np.zeros(lanes, np.int64)
        self.freeze()

    def freeze(self) -> None:
        """Tables from the counts: the shares of a hit by row, and where the shares of each id begin in its lane."""
        tries, hits = self.tries.reshape(-1, _ROWS), self.hits.reshape(-1, _ROWS)
        share = ((hits.sum(axis=1, keepdims=True) + 4 * hits + 1) << _CHOICE) // (tries.sum(axis=1, keepdims=True) + 4 * tries + 24)
        self.share = np.minimum(np.maximum(share, 8), (1 << _CHOICE) - 64).ravel().astype(np.uint64)
        width = int(self.known.max()) if len(self.known) else 0
        count = self.count[:, :width]
        scale = ((1 << _SHARE) - self.known - 1) / np.maximum(count.sum(axis=1) + self.known, 1)
        part = np.zeros((len(self.lane), width + 1), np.int32)
        np.multiply(count, scale[:, None], out=part[:, :width], casting="unsafe")  # down to whole shares
        part[:, :width] += np.arange(width) < self.known[:, None]
        #: For each id where its shares begin and, from bit 16 on, how many they are; a new id has what is left.
        self.stride = width + 1
        begin = np.zeros_like(part)
        np.cumsum(part[:, :-1], axis=1, out=begin[:, 1:])
        part[self.lane, self.known] = (1 << _SHARE) - begin[:, -1]
        self.part = part
        self.range = (begin | part << 16).ravel()
        self.base_id = self.lane * self.stride

    def slots(self) -> np.ndarray:
        """For each lane and share, which of its ids has it (``known``: a new one)."""
        return np.repeat(np.broadcast_to(np.arange(self.stride, dtype=np.int16), self.part.shape).ravel(), self.part.ravel())

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The guess of each lane (-1: none) and its row."""
        one = self.back1[:n]
        self.at2 = self.base2[:n] + ((self.back2[:n] * 0x9E3B + one * 0x3C6F >> 3) & (_SLOTS2 - 1))
        self.at1 = self.base1[:n] + (one & (_SLOTS1 - 1))
        two, first = self.after2.take(self.at2), self.after1.take(self.at1)
        has = two >= 0
        guess = np.where(has, two, first)
        return guess, self.row[:n] + has * _2

    def take(self, n: int, ids: np.ndarray, hit: np.ndarray) -> None:
        self.after2[self.at2] = ids
        self.after1[self.at1] = ids
        self.back2[:n] = self.back1[:n]
        self.back1[:n] = ids
        np.add(self.base_row[:n], hit, out=self.row[:n])

    def learn(self, rows: np.ndarray, seen: np.ndarray, lanes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count choices (2 * row + hit), ids by their place (base_id + place), and new ids (by lane): the latter's lanes, ids and places."""
        both = np.bincount(rows, minlength=2 * len(self.tries)).reshape(-1, 2)
        self.tries += both.sum(axis=1)
        self.hits += both[:, 1]
        counted = np.bincount(seen, minlength=len(self.lane) * self.stride).reshape(-1, self.stride)
        self.count[:, :self.stride - 1] += counted[:, :-1].astype(np.int32)
        key, times = np.unique(lanes << 32 | fresh.view(np.uint32).astype(np.int64), return_counts=True)
        lane, new = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        if len(key):
            begin = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
            size = np.diff(np.append(begin, len(lane)))
            place = self.known[lane] + np.arange(len(lane)) - np.repeat(begin, size)
            some = place < _KNOWN
            lane, new, times, place = lane[some], new[some], times[some], place[some]
            if int(place.max(initial=0)) >= self.ids.shape[1]:
                more = max(int(place.max()) + 1, 2 * self.ids.shape[1]) - self.ids.shape[1]
                self.ids, self.count = (np.pad(x, ((0, 0), (0, more))) for x in (self.ids, self.count))
            self.ids[lane, place], self.count[lane, place] = new, times
            np.add.at(self.known, lane, 1)
        else:
            place = lane
        self.freeze()
        return lane, new, place


def _chunks(size: int) -> Iterator[tuple[int, int]]:
    edge = [0, *(s for s in (*STEPS, *range(1536, size, 512)) if s < size), size]
    return zip(edge, edge[1:])


def _parts(bits: int) -> list[int]:
    """How many bits of a new id follow at a time."""
    return [bits] if bits <= 16 else [bits - 16, 16]


def _after(ids: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each id of each lane (rows) the one that stood at the last place before with the same slot (uint32), or -1."""
    bits = max(1, ids.shape[1].bit_length())
    kind = np.uint32 if bits + 10 <= 32 else np.uint64
    key = np.sort(slot.astype(kind) << kind(bits) | np.arange(ids.shape[1], dtype=kind), axis=1)
    place = (key & kind((1 << bits) - 1)).astype(np.int64) + np.arange(len(ids))[:, None] * ids.shape[1]
    key >>= kind(bits)
    there = ids.ravel().take(place)
    there[:, 1:] = np.where(key[:, 1:] == key[:, :-1], there[:, :-1], np.int32(-1))
    there[:, 0] = -1
    out = np.empty(ids.size, np.int32)
    out[place.ravel()] = there.ravel()
    return out.reshape(ids.shape)


def _choices(ids: np.ndarray) -> np.ndarray:
    """For each id of each lane (rows) what ``_Model.predict`` would say: 2 * row within the lane, and 1 if the guess is right."""
    out = np.empty(ids.shape, np.uint8)
    for lo in range(0, len(ids), 32):  # bounded work memory, in the cache
        own = ids[lo:lo + 32]
        low = own.astype(np.uint16)  # slots depend on the low bits alone
        one, two = np.zeros_like(low), np.zeros_like(low)
        one[:, 1:], two[:, 2:] = low[:, :-1], low[:, :-2]
        second = _after(own, (two * np.uint16(0x9E3B) + one * np.uint16(0x3C6F) >> np.uint16(3)) & np.uint16(_SLOTS2 - 1))
        has = second >= 0
        guess = np.where(has, second, _after(own, one & np.uint16(_SLOTS1 - 1)))
        hit = (guess == own) & (guess >= 0)  # ids of 32 bits, negative here, are never guessed
        choice = hit.astype(np.uint8)
        choice += has.view(np.uint8) << np.uint8(2)
        choice[:, 1:] += hit[:, :-1].view(np.uint8) << np.uint8(1)
        out[lo:lo + 32] = choice
    return out


def _encode_lanes(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """24-bit words of each block; no block is longer than the one before it."""
    lanes, length = len(ids), np.array([len(x) for x in ids])
    rows = np.zeros((lanes, int(length.max())), np.int32)
    for k, x in enumerate(ids):
        rows[k, :len(x)] = np.asarray(x, np.uint32).view(np.int32)
    wide = np.ascontiguousarray(rows.T)
    # Ids by number: in tables by id where these are small.  Ids of 32 bits are held as signed ones throughout.
    kinds = np.flatnonzero(np.bincount(wide.ravel())) if bits <= 20 else np.unique(wide)
    number = np.zeros(int(kinds[-1]) + 1 if bits <= 20 else 0, np.int32)
    if bits <= 20:
        number[kinds] = np.arange(len(kinds), dtype=np.int32)
    numbered = number.take if bits <= 20 else kinds.searchsorted
    if lanes > 1 and lanes * len(kinds) > PLACES:  # blocks do not depend on one another
        return _encode_lanes(ids[:lanes // 2], bits) + _encode_lanes(ids[lanes // 2:], bits)
    #: The place of each id (by its number) in each lane, or -1.
    place_of = np.full(lanes * len(kinds), -1, np.int16)
    model, base = _Model(lanes, guessing=False), np.arange(lanes) * len(kinds)
    choices = np.ascontiguousarray(_choices(rows).T)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 56) - 1, np.uint64)
    out_lane, out_word = [], []

    def shift(some: np.ndarray) -> None:
        out_lane.append(some.astype(np.uint16 if lanes <= 1 << 16 else np.int64))
        out_word.append((low[some] >> _32).astype(np.uint32))  # bit 24: a carry into the words before
        low[some] = (low[some] & _BELOW) << _24
        width[some] <<= _24

    for a, b in _chunks(len(wide)):
        now = wide[a:b]
        place = place_of.take(base + numbered(now))
        fresh = place < 0
        index = np.where(fresh, model.known, place) + model.base_id
        span = model.range.take(index)
        choice = choices[a:b]
        hit = (choice & np.uint8(1)).view(bool)
        share = model.share.take(model.base_row + (choice >> np.uint8(1)))
        begin, part = (span & _SPAN).astype(np.uint64), (span >> 16).astype(np.uint64)
        rows, missed = 2 * model.base_row + choice, ~hit
        full = b <= length[-1]
        if not full:
            alive = np.arange(a, b)[:, None] < length
            rows, missed = rows[alive], missed & alive
        when, new = np.nonzero(missed & fresh)
        fresh_now, edge = now[when, new], np.searchsorted(when, np.arange(b - a + 1))
        for t in range(b - a):
            n = lanes if full else int(np.searchsorted(-length, -(a + t)))
            cut = width[:n] >> np.uint64(_CHOICE)
            cut *= share[t, :n]
            unit = width[:n] - cut
            unit >>= np.uint64(_SHARE)
            up = unit * begin[t, :n]
            up += cut
            unit *= part[t, :n]
            low[:n] += np.where(hit[t, :n], _0, up)
            width[:n] = np.where(hit[t, :n], cut, unit)
            some = np.flatnonzero(width[:n] < _LEAST)
            if len(some):
                shift(some)
            if edge[t] < edge[t + 1]:
                some, own = new[edge[t]:edge[t + 1]], fresh_now[edge[t]:edge[t + 1]].view(np.uint32).astype(np.uint64)
                left = bits
                for size in _parts(bits):
                    left -= size
                    width[some] >>= np.uint64(size)
                    low[some] += width[some] * ((own >> np.uint64(left)) & np.uint64((1 << size) - 1))
                    small = some[width[some] < _LEAST]
                    if len(small):
                        shift(small)
        where, which, put = model.learn(rows.ravel(), index[missed > fresh], new, fresh_now)
        place_of[base[where] + numbered(which)] = put
    for _ in range(3):
        shift(np.arange(lanes))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane, kind="stable")
    lane, word = lane[order], word[order]
    while (carry := word >> np.uint32(24)).any():
        word = (word & np.uint32(0xFFFFFF)) + np.append(carry[1:], np.uint32(0))  # never out of a lane's first word
    return np.split(word, np.searchsorted(lane, np.arange(1, lanes)))


def _decode_lanes(streams: list[np.ndarray], length: np.ndarray, bits: int) -> list[np.ndarray]:
    """Ids of each block from the bytes of its words; ``length`` must not rise."""
    lanes = len(streams)
    model = _Model(lanes, guessing=True)
    at = np.cumsum([0] + [len(x) + 12 for x in streams])[:-1]
    data = np.concatenate([y for x in streams for y in (x, np.zeros(12, np.uint8))] + [np.zeros(2, np.uint8)]).astype(np.uint32)
    three = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:])  # the 24 bits from each byte on
    word = lambda some: three.take(some).astype(np.uint64)
    code = word(at) << _32 | word(at + 3) << np.uint64(8) | word(at + 6) >> np.uint64(16)
    at += 7
    width = np.full(lanes, (1 << 56) - 1, np.uint64)
    wide = np.zeros((int(length.max()), lanes), np.int32)

    def shift(some: np.ndarray) -> None:
        code[some] = code[some] << _24 | word(at[some])
        at[some] += 3
        width[some] <<= _24

    last = np.uint64((1 << _SHARE) - 1)
    for a, b in _chunks(len(wide)):
        slots, base_slot = model.slots(), model.lane << _SHARE
        held, base_held = model.ids.ravel(), model.lane * model.ids.shape[1]
        rows, places = np.zeros((b - a, lanes), np.int32), np.zeros((b - a, lanes), np.int16)
        for t in range(b - a):
            n = int(np.searchsorted(-length, -(a + t))) if a + t >= length[-1] else lanes
            guess, row = model.predict(n)
            cut = (width[:n] >> np.uint64(_CHOICE)) * model.share.take(row)
            hit = code[:n] < cut
            unit = (width[:n] - cut) >> np.uint64(_SHARE)
            other = code[:n] - cut  # of a hit: not used
            place = slots.take(base_slot[:n] + np.minimum(other // unit, last).view(np.int64))
            span = model.range.take(model.base_id[:n] + place)
            now = np.where(hit, guess, held.take(base_held[:n] + place, mode="clip"))
            code[:n] = np.where(hit, code[:n], other - unit * (span & _SPAN).astype(np.uint64))
            width[:n] = np.where(hit, cut, unit * (span >> 16).astype(np.uint64))
            some = np.flatnonzero(width[:n] < _LEAST)
            if len(some):
                shift(some)
            some = np.flatnonzero((place == model.known[:n]) > hit)
            if len(some):
                value = np.zeros(len(some), np.uint64)
                for part in _parts(bits):
                    width[some] >>= np.uint64(part)
                    got = np.minimum(code[some] // width[some], np.uint64((1 << part) - 1))
                    code[some] -= width[some] * got
                    value = value << np.uint64(part) | got
                    small = some[width[some] < _LEAST]
                    if len(small):
                        shift(small)
                now[some] = value.astype(np.uint32).view(np.int32)
            wide[a + t, :n] = now
            rows[t, :n], places[t, :n] = 2 * row + hit, place
            model.take(n, now, hit)
        missed = rows & 1 == 0
        if b > length[-1]:
            alive = np.arange(a, b)[:, None] < length
            rows, missed = rows[alive], missed & alive
        fresh = missed & (places == model.known)
        model.learn(rows.ravel(), (model.base_id + places)[missed > fresh], np.nonzero(fresh)[1], wide[a:b][fresh])
    rows = np.ascontiguousarray(wide.T).view(np.uint32)
    return [rows[k, :n] for k, n in enumerate(length)]


def encode_blocks(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Payload of each block from its parts (PART) and ids; only the last may be shorter than the others."""
    bits = max([1, *(int(ids.max()).bit_length() for _, ids in blocks if len(ids))])
    words = _encode_lanes([ids for _, ids in blocks], bits)
    out = []
    for (parts, ids), word in zip(blocks, words):
        body = parts.tobytes() + word.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
        out.append(HEADER.pack(MAGIC, len(ids), bits, len(parts), len(word), zlib.crc32(body)) + body)
    return out


def decode_blocks(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts and ids of each block; a block that is not whole or not as written raises ValueError."""
    read: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for p in payloads:
        if len(p) < HEADER.size:
            raise ValueError("block is cut")
        magic, n, bits, parts, words, crc = HEADER.unpack_from(p)
        body = p[HEADER.size:]
        if magic != MAGIC or len(body) != parts * PART.itemsize + 3 * words or zlib.crc32(body) != crc:
            raise ValueError("block is damaged")
        read.append((n, bits, np.frombuffer(body, PART, parts), np.frombuffer(body, np.uint8, offset=parts * PART.itemsize)))
    out: list[tuple[np.ndarray, np.ndarray]] = [(r[2], np.zeros(0, np.uint32)) for r in read]
    for bits in {r[1] for r in read}:
        own = sorted((k for k, r in enumerate(read) if r[1] == bits), key=lambda k: -read[k][0])
        for k, ids in zip(own, _decode_lanes([read[k][3] for k in own], np.array([read[k][0] for k in own]), bits)):
            out[k] = (read[k][2], ids)
    return out


def write_documents(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """The table (file, block, n_tokens, payload) of all texts' ids, each text's followed by ``end_id``.

    Files and the documents in them ascend by doc_id (null ids first; ties by a hash of the text).
    Null and empty texts have the end only.  Repeated rows stay repeated; an empty table has no blocks.
    """
    place = (F.col("doc_id").asc_nulls_first(), "mark", "salt")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file, block = encoder(path), TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def cut(last: bool) -> tuple[pa.RecordBatch, bool]:
            """All full blocks of what waits, and the rest if nothing follows; whether a document goes on in the next block."""
            nonlocal waiting, size, block
            ids = np.concatenate([x for _, x in waiting])
            ends = np.cumsum([len(x) for _, x in waiting])
            stop = len(ids) if last else len(ids) // block_ids * block_ids
            made = []
            for lo in range(0, stop, block_ids):
                hi = min(lo + block_ids, stop)
                some = range(int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left")) + 1)
                begins = [ends[k] - len(waiting[k][1]) for k in some]
                made.append((np.array([(waiting[k][0] or 0, (1 if b >= lo and not (k == 0 and opened) else 0) | (2 if waiting[k][0] is None else 0), min(ends[k], hi) - max(b, lo))
                                       for k, b in zip(some, begins)], PART), ids[lo:hi]))
            payloads = encode_blocks(made)
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(made), pa.int32()), pa.array(range(block, block + len(made)), pa.int32()),
                                              pa.array([len(x) for _, x in made], pa.int64()), pa.array(payloads, pa.binary())], ["file", "block", "n_tokens", "payload"])
            block += len(made)
            k = int(np.searchsorted(ends, stop, side="right"))
            rest = waiting[k:]
            inside = bool(rest) and ends[k] - len(rest[0][1]) < stop
            if inside:
                rest[0] = (rest[0][0], ids[stop:ends[k]])
            waiting, size = rest, len(ids) - stop
            return out, inside

        opened = False  # the first that waits has begun in an earlier block
        for batch in slices(batches, limit=ARRAYS_BYTES):
            ids, at = bpe.arrays(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:]):
                waiting.append((doc_id, np.append(ids[a:b], np.uint32(end_id))))
                size += int(b - a) + 1
            while size >= lanes * block_ids:
                made, opened = cut(False)
                yield made
        if size:
            yield cut(True)[0]

    made = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text") \
        .mapInArrow(run, "file int, block int, n_tokens long, payload binary")
    return staged(made, "tokens")


def read_documents(files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document, from a table of blocks.

    start counts the ids of all documents before it.  ids are little-endian uint32 (binary);
    ids_crc32 is the unsigned crc32 of that.
    """
    sizes = sorted((r.file, r.n) for r in files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # one row a file
    start = dict(zip([f for f, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    held = files.sparkSession.sparkContext.broadcast(start)
    last = "ids_crc32 long" if digest else "ids binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, now = None, 0, None  # now: the open document
        done: list[tuple] = []
        payloads: list[tuple[int, bytes]] = []

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2], now[3] if digest else b"".join(now[3])))

        def decoded() -> Iterator[pa.RecordBatch]:
            nonlocal file, at, now
            for (of, _), (parts, ids) in zip(payloads, decode_blocks([p for _, p in payloads])):
                if of != file:
                    close()
                    file, at, now = of, held.value[of], None
                lo = 0
                for doc_id, flags, count in parts.tolist():
                    raw = ids[lo:lo + count].astype("<u4").tobytes()
                    lo += count
                    if flags & 1:
                        close()
                        now = [None if flags & 2 else doc_id, at, 0, 0 if digest else []]
                    now[2] += count
                    now[3] = zlib.crc32(raw, now[3]) if digest else [*now[3], raw]
                    at += count
            payloads.clear()
            yield from flush()

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["doc_id", "start", "n_tokens", last.split()[0]])
                done.clear()

        for batch in batches:
            for of, p in zip(batch.column("file").to_pylist(), batch.column("payload").to_pylist()):
                payloads.append((of, p))
                if len(payloads) == LANES:
                    yield from decoded()
        if payloads:
            yield from decoded()
        close()
        yield from flush()

    return files.select("file", "block", "payload").repartition("file").sortWithinPartitions("file", "block").select("file", "payload") \
        .mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
