"""Range coder of token ids that mixes contexts of no, one and two ids before.

A block of ids is cut into lanes, which are coded side by side: each step codes
the next id of every lane from one model, then the model learns all of them.  So
a block of a million ids needs some hundred array operations for each of 128
steps.  Every block starts from an empty model and carries checksums of its ids
and of its bytes, so blocks can be read, checked and lost one by one.

Before each id stand a candidate for order 2 (what came after the two ids
before) and two for order 1 (after the one before), each with its sightings. How
often each candidate, or none, was right where sightings were like these is
learned too: that mixes the orders, and is what is coded first.  An id that is no
candidate is coded by order 0, the counts of all ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, STEPS = 1 << 21, 8192, 256
#: Rows of the candidates' tables for two ids and for one, as powers of two.
ROWS_TWO, ROWS_ONE = 17, 15
#: Totals of the mixture and of order 0 as powers of two; bits of the coder's state and what its width may not fall below.
MIXTURE, TOTAL, LEAST = 14, 20, np.uint64(1 << 32)
MASK, WORD = np.uint64((1 << 48) - 1), np.uint64(16)
#: A candidate is its id and one, in so many bits, and its sightings above them.
ID_BITS, MOST = 24, 255
IDS, SEEN_ONCE, TWICE, FULL = (np.uint32(x) for x in ((1 << ID_BITS) - 1, 1 << ID_BITS, 2 << ID_BITS, MOST << ID_BITS))
#: Classes of sightings: 8 of an order's first candidate, 4 of order 1's second.
KINDS = 8 * 8 * 4
#: Magic, bytes that follow, ids, vocabulary, checksum of the ids and of all the rest.
HEADER = struct.Struct("<4sIIIII")
MAGIC = b"TIDB"


class CodecError(ValueError):
    """A block that isn't what was written."""


class Model:
    """What both sides know after the same ids."""

    def __init__(self, vocabulary: int):
        self.n = vocabulary
        self.two, self.one = np.zeros(1 << ROWS_TWO, np.uint32), np.zeros(1 << ROWS_ONE, np.uint64)
        self.counts, self.seen, self.fresh = np.zeros(vocabulary, np.int64), 0, 0
        self.right = np.full((KINDS, 4), 1, np.int64)
        self.late: list[tuple[np.ndarray, np.ndarray]] = []
        self.refresh()

    def refresh(self) -> None:
        """Ends of the candidates' shares by kind and starts of all ids, from what was seen; nothing has less than one part."""
        if self.late:
            ids, kinds = (np.concatenate(x) for x in zip(*self.late, strict=True))
            self.counts += np.bincount(ids, minlength=self.n)
            self.right += np.bincount(kinds, minlength=KINDS * 4).reshape(KINDS, 4)
            self.late = []
        mixture = np.zeros((KINDS, 5), np.uint32)
        np.cumsum(1 + self.right * ((1 << MIXTURE) - 4) // self.right.sum(1, keepdims=True), 1, out=mixture[:, 1:])
        mixture[:, 4] = 1 << MIXTURE
        self.mixture, self.bounds = mixture.ravel(), [np.ascontiguousarray(mixture[:, i]) for i in (1, 2, 3)]
        parts = 1 + self.counts * ((1 << TOTAL) - self.n) // max(1, self.seen)
        self.starts, self.fresh = np.zeros(self.n + 1, np.uint32), self.seen
        np.cumsum(parts, out=self.starts[1:])
        self.starts[-1] = 1 << TOTAL
        self.upto = None

    def find(self, parts: np.ndarray) -> np.ndarray:
        """Ids to which parts of order 0 belong: mostly the last one that starts in or before their stretch of 64 parts, else searched for."""
        if self.upto is None:
            self.upto = np.cumsum(np.bincount(self.starts[:-1] >> np.uint32(6), minlength=1 << TOTAL - 6)) - 1
        found = self.upto.take(parts >> np.uint32(6))
        late = np.flatnonzero(self.starts.take(found) > parts)
        found[late] = np.searchsorted(self.starts[:-1], parts.take(late), "right") - 1
        return found

    def look(self, before: np.ndarray, last: np.ndarray) -> None:
        """Candidates (ids and one) of each lane, and the kind of their sightings."""
        self.at1 = ((last * np.uint32(0x9E3779B1)) >> np.uint32(32 - ROWS_ONE)).astype(np.intp)
        self.at2 = (((last * np.uint32(0x85EBCA6B)) ^ (before * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - ROWS_TWO)).astype(np.intp)
        pair = self.one.take(self.at1, mode="clip").view(np.uint32)
        self.rows = [self.two.take(self.at2, mode="clip"), pair[0::2], pair[1::2]]
        self.candidates = [r & IDS for r in self.rows]
        sightings = [r >> np.uint32(ID_BITS) for r in self.rows]
        self.kind = np.minimum(sightings[0], np.uint32(7)) * np.uint32(32) + np.minimum(sightings[1], np.uint32(7)) * np.uint32(4) + np.minimum(sightings[2], np.uint32(3))

    def share(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of what was chosen."""
        at = self.kind * np.uint32(5) + choice
        return self.mixture.take(at, mode="clip"), self.mixture.take(at + np.uint32(1), mode="clip")

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        """Lanes' ids and which candidate (3: none) they were.  Of lanes with one row the last one writes, on both sides alike."""
        self.late.append((ids, self.kind * np.uint32(4) + choice))
        self.seen += len(ids)
        named = ids + np.uint32(1)
        two, first, second = self.rows
        known = named | SEEN_ONCE
        # What order 2 had gives way when it has been seen once, else it is trusted less.
        same = self.candidates[0] == named
        self.two[self.at2] = np.where(same, two + (two < FULL) * SEEN_ONCE, np.where(two < TWICE, known, two - (two >> np.uint32(ID_BITS + 1) << np.uint32(ID_BITS))))
        is_first, is_second = self.candidates[1] == named, self.candidates[2] == named
        first = first + (is_first & (first < FULL)) * SEEN_ONCE
        # A new id takes the second place; what was seen more often comes first.
        second = np.where(is_first | is_second, second + (is_second & (second < FULL)) * SEEN_ONCE, known)
        pair = np.empty(2 * len(ids), np.uint32)
        np.maximum(first, second, out=pair[0::2])
        np.minimum(first, second, out=pair[1::2])
        self.one[self.at1] = pair.view(np.uint64)
        if self.seen - self.fresh >= min(self.fresh >> 3, 1 << 16):
            self.refresh()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and the steps of each; all but the last lanes are full."""
    lanes = min(LANES, max(1, -(-n // STEPS)))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _active(n: int, steps: int, t: int) -> int:
    return (n - 1 - t) // steps + 1


def _crc(n: int, vocabulary: int, crc_ids: int, payload: bytes) -> int:
    return zlib.crc32(payload, zlib.crc32(struct.pack("<III", n, vocabulary, crc_ids)))


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of 1 to BLOCK ids below ``vocabulary``."""
    n = len(ids)
    lanes, steps = _shape(n)
    x = np.zeros(lanes * steps, np.uint32)
    x[:n] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, MASK, np.uint64)
    row = 3 * steps + 4
    out, at = np.zeros(lanes * row, np.uint16), np.arange(lanes) * row

    def emit(lane: np.ndarray) -> None:
        own = low.take(lane)
        to = at.take(lane)
        out[to] = own >> np.uint64(32)
        at[lane] = to + 1
        low[lane] = (own << WORD) & MASK

    def carry(lane: np.ndarray) -> None:
        low[lane] &= MASK
        back = at[lane] - 1
        while len(back):
            out[back] += np.uint16(1)
            back = back[out[back] == 0] - 1

    def narrow(lane, start: np.ndarray, end: np.ndarray, total: int) -> None:
        r = wide[lane] >> np.uint64(total)
        low[lane] += r * start
        own = r * (end - start)
        wide[lane] = own
        if len(over := np.flatnonzero(low > MASK)):
            carry(over)
        few = np.flatnonzero(own < LEAST) if isinstance(lane, slice) else lane[own < LEAST]
        while len(few):
            emit(few)
            own = wide.take(few) << WORD
            wide[few] = own
            few = few[own < LEAST]

    model = Model(vocabulary)
    before, last = np.full(lanes, vocabulary, np.uint32), np.full(lanes, vocabulary, np.uint32)
    for t in range(steps):
        a = _active(n, steps, t)
        now, last, before = x[t, :a], last[:a], before[:a]
        model.look(before, last)
        named = now + np.uint32(1)
        by_two, first, second = (c == named for c in model.candidates)
        choice = ((~by_two).view(np.uint8) * (3 - 2 * first.view(np.uint8) - second)).astype(np.uint32)
        narrow(slice(0, a), *model.share(choice), MIXTURE)
        none = np.flatnonzero(choice == 3)
        rest = now.take(none)
        narrow(none, model.starts.take(rest), model.starts.take(rest + np.uint32(1)), TOTAL)
        model.learn(now, choice)
        before, last = last, now
    low += LEAST - np.uint64(1)  # one word tells any number of the last interval, for it is as wide as LEAST
    if len(over := np.flatnonzero(low > MASK)):
        carry(over)
    emit(np.arange(lanes))
    at -= np.arange(lanes) * row
    out = out.reshape(lanes, row)
    words = out[np.arange(out.shape[1]) < at[:, None]]
    body = zlib.compress(np.diff(at, prepend=0).astype("<i4").tobytes(), 1)
    payload = struct.pack("<I", len(body)) + body + words.astype("<u2").tobytes()
    crc_ids = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    return HEADER.pack(MAGIC, len(payload), n, vocabulary, crc_ids, _crc(n, vocabulary, crc_ids, payload)) + payload


def decode(block: bytes) -> np.ndarray:
    """Ids of a block; one that was changed or cut short raises."""
    if len(block) < HEADER.size:
        raise CodecError("a block ends in its header")
    magic, size, n, vocabulary, crc_ids, crc_all = HEADER.unpack_from(block)
    payload = block[HEADER.size : HEADER.size + size]
    if magic != MAGIC or len(payload) != size or _crc(n, vocabulary, crc_ids, payload) != crc_all or not 0 < n <= BLOCK or not 0 < vocabulary < 1 << TOTAL:
        raise CodecError("a block's bytes aren't those that were written")
    lanes, steps = _shape(n)
    (at_words,) = struct.unpack_from("<I", payload)
    lengths = np.cumsum(np.frombuffer(zlib.decompress(payload[4 : 4 + at_words]), "<i4"))
    words = np.zeros((lanes, int(lengths.max()) + 8), np.uint16)
    words[np.arange(words.shape[1]) < lengths[:, None]] = np.frombuffer(payload, "<u2", offset=4 + at_words)
    code = (words[:, 0].astype(np.uint64) << np.uint64(32)) | (words[:, 1].astype(np.uint64) << WORD) | words[:, 2]
    wide, at, words, row = np.full(lanes, MASK, np.uint64), np.full(lanes, 3, np.intp), words.ravel(), words.shape[1]
    at += np.arange(lanes) * row
    most, lane_numbers = np.arange(1, lanes + 1) * row - 1, np.arange(lanes)
    out, ones = np.zeros((steps, lanes), np.uint32), np.ones(lanes, np.uint32)

    def narrow(lane, r: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        code[lane] -= r * start
        own = r * (end - start)
        wide[lane] = own
        few = np.flatnonzero(own < LEAST) if isinstance(lane, slice) else lane[own < LEAST]
        while len(few):
            own, to = wide.take(few) << WORD, at.take(few)
            wide[few] = own
            code[few] = (code.take(few) << WORD) | words.take(to)
            at[few] = np.minimum(to + 1, most.take(few))
            few = few[own < LEAST]

    model = Model(vocabulary)
    before, last = np.full(lanes, vocabulary, np.uint32), np.full(lanes, vocabulary, np.uint32)
    for t in range(steps):
        a = _active(n, steps, t)
        last, before = last[:a], before[:a]
        model.look(before, last)
        r = wide[:a] >> np.uint64(MIXTURE)
        v = (code[:a] // r).astype(np.uint32)
        choice = sum((v >= bound.take(model.kind, mode="clip")).view(np.uint8) for bound in model.bounds).astype(np.uint32)
        narrow(slice(0, a), r, *model.share(choice))
        now = np.concatenate([*model.candidates, ones[:a]]).take(choice * np.uint32(a) + lane_numbers[:a]) - np.uint32(1)
        if len(none := np.flatnonzero(choice == 3)):
            r = wide.take(none) >> np.uint64(TOTAL)
            found = model.find(np.minimum(code.take(none) // r, np.uint64((1 << TOTAL) - 1)).astype(np.uint32))
            now[none] = found
            narrow(none, r, model.starts.take(found), model.starts.take(found + 1))
        if now.max() >= vocabulary:
            raise CodecError("a block's ids aren't those that were written")
        out[t, :a] = now
        model.learn(now, choice)
        before, last = last, now
    ids = np.ascontiguousarray(out.T).ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise CodecError("a block's ids aren't those that were written")
    return ids
