"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that share nothing, so that one block can be decoded
alone and many blocks advance side by side: every step of the model codes one id
of each block, with numpy over the blocks ("lanes"). Queries code by ``block_coder``,
which gives the same bytes; this coder needs no JVM.

The model of a block predicts an id from order 2, 1 and 0:

* order 2 and order 1: hashed tables from the last two ids and from the last id
  to the id that followed, each with a trust of 0 to 3, changed at every id. The last
  id chooses a line of both tables, so one fetch from memory serves both orders;
* order 0: adaptive frequencies of the id's bytes.

They are mixed by adaptive weights chosen by both trusts: it is coded which
order's prediction holds, and under order 0 the bytes themselves. An interval of
bytes lies inside that of its order, so the order and two bytes are one interval,
and one step of the coder. Weights and frequencies are counted at every id and
taken over at the steps of ``rebuilds``, often at first. The coder keeps 64 bits of
``low`` and puts out 16 at a time; a carry is added to what has been put out.

A block is ``MAGIC, n_ids, n_words, crc32 of the ids as little-endian unsigned
32-bit integers`` and its words of 16 bits. Decoding checks the sum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLB3"
HEAD = struct.Struct("<4sIII")
SLOT_BITS = 10  # of an order's table
SHARE_BITS = 3  # of them, the place inside of a line that both orders share
LINE = 16  # entries of 4 bytes that come into a processor's cache together
EMPTY = -4  # a table's entry is its id times 4 and the trust
MIX_BITS, BYTE_BITS = 12, 11  # totals of weights and of byte frequencies
PAIR_BITS = 2 * BYTE_BITS
STEPS = 32  # that the encoder prepares at once, at most
LIMIT = 1 << 12  # counts of a lane's bytes before they are halved
U = np.uint64
LEAST, WORD = U(1 << 48), U(16)  # a range below is widened by a word
START = np.uint32(0xFFFF)  # packed intervals: size times 65536 and start


def rebuilds(t: int) -> bool:
    """After step ``t`` the counts become the model."""
    return t % 512 == 0 or t in (16, 64, 192)


class Seen:
    """Places counted since the last rebuild."""

    def __init__(self):
        self.places, self.n = np.zeros(0, np.int32), 0

    def add(self, places: np.ndarray) -> None:
        end = self.n + len(places)
        if end > len(self.places):
            self.places = np.append(self.places[: self.n], np.zeros(max(2 * len(places), self.n // 2), np.int32))
        self.places[self.n : end] = places
        self.n = end

    def counts(self, size: int) -> np.ndarray:
        """How often each place below ``size`` was seen; ``size`` itself is where those go that don't count."""
        found = np.bincount(self.places[: self.n], minlength=size)[:size]
        self.n = 0
        return found


class Lanes:
    """What all lanes have learned; the same calls in the same order when encoding and decoding."""

    def __init__(self, n: int, pairs: int, inverse: bool = False):
        self.n, self.pairs, self.inverse = n, pairs, inverse
        size = 2 * n << SLOT_BITS
        table = np.full(size + LINE, EMPTY, np.int32)
        skip = -table.ctypes.data % (4 * LINE) // 4
        self.table = table[skip : skip + size]  # lines begin where the cache has them begin
        lane = np.arange(n, dtype=np.uint32)
        self.base, self.lane16, self.lane256, self.lane_inverse = (lane << np.uint32(k) for k in (SLOT_BITS + 1, 4, 8, BYTE_BITS))
        self.hashed = np.zeros(n, np.uint32)  # of the last id
        self.places = np.stack([self.base, self.base | np.uint32(1 << SHARE_BITS)])  # in the table, of the last id and of the last two
        self.kinds = np.ones((n * 16, 3), np.int64)
        self.bytes = [np.ones((n, 256), np.int32) for _ in range(2 * pairs)]
        self.seen = [Seen() for _ in range(1 + 2 * pairs)]
        self.rebuild(True)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        """Places in the table before each of these steps (a row of ids a step), and what the next step begins with."""
        w, n = ids.shape
        hashed = np.empty((w + 1, n), np.uint32)
        hashed[0] = self.hashed[:n]
        np.multiply(ids, np.uint32(0x9E3779B1), out=hashed[1:], casting="unsafe")
        found = np.empty((w + 1, 2, n), np.uint32)
        found[0] = self.places[:, :n]
        self._places(hashed[1:], hashed[:-1], n, found[1:, 0], found[1:, 1])
        self.hashed[:n], self.places[:, :n] = hashed[-1], found[-1]
        return found[:-1].astype(np.int64)

    def _places(self, hashed, before, n: int, one, two) -> None:
        mixed = (hashed ^ (before >> np.uint32(5))) * np.uint32(0x85EBCA6B)
        line = (hashed >> np.uint32(32 - SLOT_BITS + SHARE_BITS)) * np.uint32(LINE)
        line |= self.base[:n]
        np.bitwise_or(line, hashed >> np.uint32(32 - SLOT_BITS) & np.uint32((1 << SHARE_BITS) - 1), out=one)
        np.bitwise_or(line, mixed >> np.uint32(32 - SHARE_BITS) | np.uint32(1 << SHARE_BITS), out=two)

    def learn(self, slots, entries, trust, ids4, right) -> None:
        """Entries of both orders after ids of which four times is ``ids4``."""
        # by arithmetic, which is faster than a choice: right ones are trusted more, of others those of little trust give way and the rest are trusted less
        less = entries - np.int32(1)
        new = np.minimum(trust, np.int32(2))
        new *= right
        new += ids4 + np.int32(1)
        new -= less
        new *= right | (trust <= 1)
        new += less
        self.table.put(slots, new, mode="clip")

    def move(self, n: int, ids: np.ndarray) -> None:
        """The context is now these ids."""
        hashed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
        self._places(hashed, self.hashed[:n], n, self.places[0, :n], self.places[1, :n])
        self.hashed[:n] = hashed

    def rebuild(self, first_time: bool = False) -> None:
        if self.seen[0].n:
            self.kinds += self.seen[0].counts(self.kinds.size).reshape(self.kinds.shape)
        total = 1 << MIX_BITS
        share = 1 + self.kinds * (total - 3) // self.kinds.sum(1, keepdims=True)
        share[:, 2] = total - share[:, 0] - share[:, 1]
        first, second = share[:, 0], share[:, 0] + share[:, 1]
        self.mix = (share << 16 | np.column_stack([np.zeros_like(first), first, second])).astype(np.uint32).ravel()
        self.edges = (second << 16 | first).astype(np.uint32)
        self.shares = []  # of each byte; for decoding, of each place in the bytes' intervals, with the byte that has it
        for counts, seen in zip(self.bytes, self.seen[1:]):
            alike = counts[:1] if first_time else counts  # at first all lanes have the same
            if seen.n:
                counts += seen.counts(counts.size).reshape(counts.shape).astype(np.int32)
                counts[counts.sum(1, dtype=np.int32) > LIMIT] >>= 1
            share = alike * np.int32((1 << BYTE_BITS) - 256)
            share //= np.maximum(alike.sum(1, keepdims=True, dtype=np.int32), 1)
            share += 1
            share[:, 255] += (1 << BYTE_BITS) - share.sum(1, dtype=np.int32)
            ends = np.cumsum(share, axis=1, dtype=np.int32)
            ends -= share
            if self.inverse:
                ends |= share << np.int32(BYTE_BITS)
                ends |= np.arange(256, dtype=np.int32) << np.int32(2 * BYTE_BITS)
                found = np.repeat(ends.view(np.uint32).ravel(), share.ravel())
            else:
                ends |= share << np.int32(16)
                found = ends.view(np.uint32).ravel()
            self.shares.append(np.tile(found, self.n) if first_time else found)


class Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
        self.out, self.at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)
        self.base = np.arange(lanes, dtype=np.int64) * room

    def put(self, low, width, start, size, bits: int, lanes=None) -> None:
        """Codes the interval of ``size`` from ``start`` of ``1 << bits`` into ``low`` and ``width``, the states of ``lanes`` (of the first ones, if None)."""
        width >>= U(bits)
        start = start * width
        low += start
        width *= size
        over = np.flatnonzero(low < start)
        if len(over):
            who = over if lanes is None else lanes[over]
            back = self.at[who] - 1
            while len(who):
                self.out[who, back] += 1
                ripple = self.out[who, back] == 0
                who, back = who[ripple], back[ripple] - 1
        out = self.out.reshape(-1)
        if lanes is None:  # the next word of every lane, kept where the lane moves on
            n = len(low)
            out[self.base[:n] + self.at[:n]] = low >> U(48)
            short = width < LEAST
            self.at[:n] += short
            by = short.astype(U) << U(4)
            low <<= by
            width <<= by
        full = np.flatnonzero(width < LEAST)
        while len(full):
            who = full if lanes is None else lanes[full]
            own, wide = low[full], width[full] << WORD
            out[self.base[who] + self.at[who]] = own >> U(48)
            self.at[who] += 1
            low[full], width[full] = own << WORD, wide
            full = full[wide < LEAST]

    def grow(self, words: int) -> None:
        """Room for so many words more in each lane."""
        if self.at.max() + words >= self.out.shape[1]:
            self.out = np.pad(self.out, ((0, 0), (0, self.out.shape[1] + words)))
            self.base = np.arange(len(self.out), dtype=np.int64) * self.out.shape[1]

    def words(self) -> list[np.ndarray]:
        tail = np.column_stack([self.low >> U(k) & U(0xFFFF) for k in (48, 32, 16, 0)]).astype(np.uint16)
        return [np.append(self.out[k, :n], tail[k]) for k, n in enumerate(self.at)]


class Decoder:
    def __init__(self, words: list[np.ndarray]):
        lanes, most = len(words), max(4, *map(len, words)) + 1
        matrix = np.zeros((lanes, most), np.uint16)
        for k, w in enumerate(words):
            matrix[k, : len(w)] = w
        first = matrix[:, :4].astype(U)
        self.value = first[:, 0] << U(48) | first[:, 1] << U(32) | first[:, 2] << U(16) | first[:, 3]
        self.words, self.range = matrix.ravel(), np.full(lanes, (1 << 64) - 1, U)
        self.at = np.arange(lanes, dtype=np.int64) * most + 4  # a damaged block may run on into others

    def widen(self, value, width, lanes=None) -> None:
        """Takes in words until no ``width`` is short."""
        if lanes is None:
            n = len(value)
            short = width < LEAST
            by = short.astype(U) << U(4)
            value <<= by
            value |= self.words.take(self.at[:n], mode="clip") * short
            width <<= by
            self.at[:n] += short
        full = np.flatnonzero(width < LEAST)
        while len(full):
            who = full if lanes is None else lanes[full]
            wide = width[full] << WORD
            value[full] = value[full] << WORD | self.words.take(self.at[who], mode="clip")
            self.at[who] += 1
            width[full] = wide
            full = full[wide < LEAST]


def _pair(model: Lanes, k: int, pair: np.ndarray):
    """Start and size of two bytes of every lane among ``1 << PAIR_BITS``, and their places."""
    base = model.lane256[: pair.shape[1]]
    first, second = base + (pair >> np.uint32(8)), base + (pair & np.uint32(255))
    a, b = model.shares[2 * k].take(first, mode="clip"), model.shares[2 * k + 1].take(second, mode="clip")
    high = a >> np.uint32(16)
    return ((a & START) << np.uint32(BYTE_BITS)) + high * (b & START), high * (b >> np.uint32(16)), first, second


def _encode_steps(model: Lanes, coder: Encoder, ids: np.ndarray) -> None:
    """Codes a row of ids a step, of steps between which the counts stay. What hangs on the ids alone is done for all steps at once."""
    w, n = ids.shape
    slots, ids4 = model.slots(ids), ids << np.int32(2)
    entries, right = np.empty((w, 2, n), np.int32), np.empty((w, 2, n), bool)
    for t in range(w):
        own = model.table.take(slots[t], out=entries[t], mode="clip")
        np.equal(own >> np.int32(2), ids[t], out=right[t])
        model.learn(slots[t], own, own & np.int32(3), ids4[t], right[t])
    trust = entries & np.int32(3)
    kind = np.where(right[:, 1], np.uint32(0), np.uint32(2) - right[:, 0])
    place = (model.lane16[:n] + (trust[:, 1] * np.int32(4) + trust[:, 0]).view(np.uint32)) * np.uint32(3) + kind
    model.seen[0].add(place.ravel())
    mix, rest = model.mix.take(place, mode="clip"), kind == 2
    start, size, pairs = (mix & START).astype(U) << U(PAIR_BITS), (mix >> np.uint32(16)).astype(U), []
    for k in range(model.pairs):
        inner, share, *places = _pair(model, k, ids.view(np.uint32) >> np.uint32(16 * (model.pairs - 1 - k)) & np.uint32(0xFFFF))
        for seen, x in zip(model.seen[1 + 2 * k :], places):
            seen.add(x[rest])
        if k:
            pairs.append((inner, share))
        else:
            start += size * (inner * rest)
            size *= np.where(rest, share, np.uint32(1 << PAIR_BITS))
    low, width = coder.low[:n], coder.range[:n]
    for t in range(w):
        coder.put(low, width, start[t], size[t], MIX_BITS + PAIR_BITS)
        for inner, share in pairs:
            lanes = np.flatnonzero(rest[t])
            l, r = low[lanes], width[lanes]
            coder.put(l, r, inner[t, lanes].astype(U), share[t, lanes].astype(U), PAIR_BITS, lanes)
            low[lanes], width[lanes] = l, r


def _decode_step(model: Lanes, coder: Decoder, n: int) -> np.ndarray:
    slots = model.places[:, :n].astype(np.int64)
    entries = model.table.take(slots, mode="clip")
    trust = entries & np.int32(3)
    at = model.lane16[:n] + (trust[1] * np.int32(4) + trust[0]).view(np.uint32)
    value, width = coder.value[:n], coder.range[:n]
    width >>= U(MIX_BITS + PAIR_BITS)
    unit = width << U(PAIR_BITS)
    edges = model.edges.take(at, mode="clip")
    rest = value >= unit * (edges >> np.uint32(16))
    kind = (value >= unit * (edges & START)).view(np.uint8) + rest.view(np.uint8)
    place = at * np.uint32(3) + kind
    model.seen[0].add(place)
    mix = model.mix.take(place, mode="clip")
    value -= unit * (mix & START)
    width *= mix >> np.uint32(16)
    # two bytes are looked up in every lane and taken in those of ``rest``, which most are
    pair, start, size, places = _look_pair(model, 0, model.lane256[:n], model.lane_inverse[:n], value // width)
    for k, (seen, x) in enumerate(zip(model.seen[1:], places)):
        seen.add(np.where(rest, x, np.uint32(model.bytes[k].size)))
    value -= width * (start * rest)
    size -= np.uint32(1 << PAIR_BITS)
    size *= rest
    size += np.uint32(1 << PAIR_BITS)
    width *= size
    coder.widen(value, width)
    ids = pair
    for k in range(1, model.pairs):
        lanes = np.flatnonzero(rest)
        v, w = value[lanes], width[lanes] >> U(PAIR_BITS)
        pair, start, size, places = _look_pair(model, k, model.lane256[lanes], model.lane_inverse[lanes], v // w)
        for seen, x in zip(model.seen[1 + 2 * k :], places):
            seen.add(x)
        v -= w * start
        w *= size
        coder.widen(v, w, lanes)
        value[lanes], width[lanes] = v, w
        ids[lanes] = ids[lanes] << np.int32(16) | pair
    known = entries >> np.int32(2)
    ids -= known[1]
    ids *= rest
    ids += known[1]
    np.copyto(ids, known[0], where=kind == 1)
    model.learn(slots, entries, trust, ids << np.int32(2), known == ids)
    model.move(n, ids)
    return ids


def _look_pair(model: Lanes, k: int, base: np.ndarray, inside: np.ndarray, sought: np.ndarray):
    """Two bytes in whose interval ``sought`` lies, its start and size among ``1 << PAIR_BITS``, and the bytes' places."""
    sought = np.minimum(sought, U((1 << PAIR_BITS) - 1)).astype(np.uint32)
    field = np.uint32((1 << BYTE_BITS) - 1)
    a = model.shares[2 * k].take(inside + (sought >> np.uint32(BYTE_BITS)), mode="clip")
    one, high, start = a >> np.uint32(2 * BYTE_BITS), a >> np.uint32(BYTE_BITS) & field, (a & field) << np.uint32(BYTE_BITS)
    b = model.shares[2 * k + 1].take(inside + (sought - start) // high, mode="clip")
    two = b >> np.uint32(2 * BYTE_BITS)
    return (one << np.uint32(8) | two).view(np.int32), start + high * (b & field), high * (b >> np.uint32(BYTE_BITS) & field), (base + one, base + two)


def _active(size: list[int]) -> list[int]:
    """How many lanes, the longest first, are longer than t."""
    return np.searchsorted(-np.array(size), -np.arange(size[0]), "left").tolist()


def encode_blocks(blocks: list[np.ndarray], id_bits: int = 16) -> list[bytes]:
    """Each block of ids as bytes; a block may be empty."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    size = [len(blocks[k]) for k in order]
    ids = np.zeros((size[0], len(blocks)), np.int32)
    for lane, k in enumerate(order):
        ids[: size[lane], lane] = blocks[k]
    model, coder = Lanes(len(blocks), -(-id_bits // 16)), Encoder(len(blocks), size[0] + 16)
    t, active = 0, _active(size)
    while t < len(active):
        if t and rebuilds(t):
            model.rebuild()
        end = t + 1
        while end < len(active) and active[end] == active[t] and end % STEPS and not rebuilds(end):
            end += 1
        coder.grow((end - t) * 3 * model.pairs + 8)
        _encode_steps(model, coder, ids[t:end, : active[t]])
        t = end
    out: list[bytes] = [b""] * len(blocks)
    for k, words in zip(order, coder.words()):
        out[k] = HEAD.pack(MAGIC, len(blocks[k]), len(words), zlib.crc32(np.asarray(blocks[k]).astype("<u4").tobytes())) + words.astype("<u2").tobytes()
    return out


def decode_blocks(blobs: list[bytes], id_bits: int = 16) -> list[np.ndarray]:
    """The ids of each block; raises ``ValueError`` on a block that is damaged."""
    if not blobs:
        return []
    if any(len(b) < HEAD.size for b in blobs):
        raise ValueError("not a whole block of token ids")
    heads = [HEAD.unpack_from(b) for b in blobs]
    for (magic, _, n_words, _), b in zip(heads, blobs):
        if magic != MAGIC or len(b) != HEAD.size + 2 * n_words:
            raise ValueError("not a whole block of token ids")
    order = sorted(range(len(blobs)), key=lambda k: -heads[k][1])
    size = [heads[k][1] for k in order]
    model, coder = Lanes(len(blobs), -(-id_bits // 16), True), Decoder([np.frombuffer(blobs[k], "<u2", offset=HEAD.size) for k in order])
    ids = np.zeros((size[0], len(blobs)), np.int32)
    for t, n in enumerate(_active(size)):
        if t and rebuilds(t):
            model.rebuild()
        ids[t, :n] = _decode_step(model, coder, n)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(blobs)
    for lane, k in enumerate(order):
        found = ids[: size[lane], lane].astype("<u4")
        if zlib.crc32(found.tobytes()) != heads[k][3]:
            raise ValueError("the checksum of a block of token ids is wrong")
        out[k] = found
    return out
