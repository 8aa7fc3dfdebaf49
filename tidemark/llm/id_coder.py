"""An adaptive context-mixing range coder for token ids, in blocks that are coded side by side.

A block starts from the same fixed state as every other, so each can be decoded by itself; numpy steps
through up to `LANES` blocks at once. Three models predict the next id: the ids that last followed the two
ids before it (order 2) and the one before it (order 1), each with a confidence, and the segment's counts
(order 0, told in its header, so that blocks can be short and many are coded at a step). Their mixture drives one arithmetic coding step an id: the interval is cut into the
order-2 id's share, the order-1 id's share and, over the rest, the order-0 distribution. The shares adapt after
every id, apart for each pair of confidences. All arithmetic is on integers, so every machine decodes alike.

A segment is: header, its alphabet (the distinct ids, in order, which the blocks' models number from zero) and their shares, words and
checksum (crc32 of the ids as little-endian 32-bit integers) of each block, and the blocks' 32-bit words. Decoding checks the
alphabet's checksum and each block's.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEAD = b"TMID", "<4sIQIIII"  # magic, version, ids, block length, distinct ids, bytes and checksum of the packed alphabet
LANES, LEAST, MOST = 2048, 1024, 1024
SLOTS = 9  # bits of each block's table of contexts
SHARE = 12  # bits of the mixture's shares
WORD = np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)


def block_length(n: int) -> int:
    """Longer blocks code better; shorter ones keep enough of them side by side."""
    return max(1, min(n, max(LEAST, min(MOST, -(-n // LANES)))))


def shares(counts: np.ndarray) -> np.ndarray:
    """Each id's part of the order-0 distribution, at least one, as whole numbers that add up to a power of two."""
    whole = 1 << max(18, (len(counts) - 1).bit_length() + 1)
    out = 1 + (counts * ((whole - len(counts)) / max(counts.sum(), 1))).astype(np.int64)
    if len(out):
        out[np.argmax(out)] += whole - out.sum()
    return out


class Mixer:
    """The models of `lanes` blocks after the same number of ids; `sizes` are the ids' shares of order 0."""

    def __init__(self, lanes: int, sizes: np.ndarray):
        self.n = lanes
        if len(sizes) > 1 << 18:
            raise ValueError("at most 262,144 distinct ids are coded in a segment")
        self.size = sizes.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bits = max(18, (len(sizes) - 1).bit_length() + 1)
        self.total = np.uint64(SHARE + self.bits)
        lane = np.arange(lanes, dtype=np.int64)
        self.slots = np.zeros((2 * lanes) << SLOTS, np.int32)  # id * 16 + confidence, order 2 then order 1
        self.base = np.concatenate([lane, lane + lanes]) << SLOTS
        confidence = np.arange(16)
        first = np.repeat(64 + 3600 * confidence // (confidence + 3), 32).astype(np.int16)
        self.two = np.tile(first, lanes)
        self.one = np.tile(np.repeat(64 + 3600 * confidence // (confidence + 3), 2).astype(np.int16), 16 * lanes)
        self.pair = lane << 9

    def contexts(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Slots of the ids `before` and `last` (any shape that ends in the lanes), order 2 then order 1."""
        h = np.concatenate([(before * 0x2F0B4C47 + last * 0x6A09E667) >> 7, last * 0x5BD1E995 >> 7], axis=-1)
        return (h ^ (h >> SLOTS)) & ((1 << SLOTS) - 1) | self.base

    def predict(self, slots: np.ndarray):
        """Upper ends of the order-2 and order-1 shares, of 4096."""
        n = self.n
        self.at, self.have = slots, self.slots.take(slots)
        self.sure, self.said = self.have & 15, self.have >> 4
        self.case = self.pair + (self.sure[:n] << 5 | self.sure[n:] << 1 | (self.said[:n] == self.said[n:]))
        self.share2, self.share1 = self.two.take(self.case).astype(np.int32), self.one.take(self.case).astype(np.int32)
        self.upper2 = self.share2
        self.upper1 = self.share2 + ((4096 - self.share2) * self.share1 >> SHARE)

    def interval(self, ids: np.ndarray):
        """Start and size of the ids' part of the whole, 1 << total; what the models learn of them is taken in."""
        n, both = self.n, np.concatenate([ids, ids], dtype=np.int32, casting="same_kind")
        hit = self.said == both
        hit2 = hit[:n]
        hit1 = hit[n:] & ~hit2
        part2, part1 = self.upper2.astype(np.int64) << self.bits, self.upper1.astype(np.int64) << self.bits
        rest = 4096 - self.upper1
        start = np.where(hit2, 0, np.where(hit1, part2, part1 + self.start.take(ids) * rest))
        size = np.where(hit2, part2, np.where(hit1, part1 - part2, self.size.take(ids) * rest))
        self.slots[self.at] = np.where(hit, self.have + (self.sure < 15), np.where(self.sure > 0, self.have - self.sure + (self.sure >> 1), both << 4 | 1))
        self.two[self.case] = self.share2 + ((np.where(hit2, 3968, 64) - self.share2) >> 5)
        self.one[self.case] = np.where(hit2, self.share1, self.share1 + ((np.where(hit1, 4032, 64) - self.share1) >> 5))
        return start.view(np.uint64), size.view(np.uint64)


def _encode(ids: np.ndarray, vocabulary: int, sizes: np.ndarray | None = None) -> list[np.ndarray]:
    """The 32-bit words of blocks of ids (step, lane); order 0 is even where no shares are given."""
    steps, lanes = ids.shape
    m = Mixer(lanes, shares(np.ones(vocabulary, np.int64)) if sizes is None else sizes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, at = np.zeros((lanes, 2 * steps // 3 + 64), np.uint64), np.zeros(lanes, np.int64)
    before = np.zeros((steps + 2, lanes), np.int32)
    before[2:] = ids
    for t in range(steps):
        pair = before[t : t + 3].astype(np.int64)
        m.predict(m.contexts(pair[0], pair[1]))
        start, size = m.interval(pair[2])
        unit = width >> m.total
        moved = low + unit * start
        over = np.flatnonzero(moved < low)
        if len(over):
            out[over, at[over] - 1] += np.uint64(1)
        low, width = moved, unit * size
        full = np.flatnonzero(width <= LOW32)
        if len(full):
            if at.max() > out.shape[1] - 4:
                out = np.pad(out, ((0, 0), (0, steps // 3 + 64)))
            out[full, at[full]] = low[full] >> WORD
            at[full] += 1
            low[full] <<= WORD
            width[full] <<= WORD
    for word in (low >> WORD, low & LOW32):
        out[np.arange(lanes), at] = word
        at += 1
    while (carry := out >> WORD).any():
        out &= LOW32
        out[:, :-1] += carry[:, 1:]
    return [out[i, : at[i]].astype("<u4") for i in range(lanes)]


def _decode(words: list[np.ndarray], steps: int, sizes: np.ndarray) -> np.ndarray:
    """Blocks of ids (step, lane)."""
    lanes = len(words)
    m = Mixer(lanes, sizes)
    named = np.repeat(np.arange(len(sizes), dtype=np.int32), m.size)
    size = max(len(w) for w in words) + 2
    read = np.zeros((lanes, size), np.uint64)
    for i, w in enumerate(words):
        read[i, : len(w)] = w
    code, width, at = read[:, 0] << WORD | read[:, 1], np.full(lanes, 2**64 - 1, np.uint64), np.full(lanes, 2)
    ids = np.zeros((steps + 2, lanes), np.int64)
    top = np.uint64((1 << int(m.total)) - 1)
    for t in range(steps):
        m.predict(m.contexts(ids[t], ids[t + 1]))
        unit = width >> m.total
        value = np.minimum(code // unit, top).view(np.int64)
        share = value >> m.bits
        rest = np.maximum(value - (m.upper1.astype(np.int64) << m.bits), 0) // (4096 - m.upper1)
        found = named.take(rest, mode="clip")  # beyond it in damaged blocks only; their checksum will tell
        x = np.where(share < m.upper2, m.said[:lanes], np.where(share < m.upper1, m.said[lanes:], found))
        start, part = m.interval(x)
        code, width = code - unit * start, unit * part
        full = np.flatnonzero(width <= LOW32)
        if len(full):
            code[full] = code[full] << WORD | read[full, np.minimum(at[full], size - 1)]
            at[full] += 1
            width[full] <<= WORD
        ids[t + 2] = x
    return ids[2:]


def encode(ids: np.ndarray) -> bytes:
    """A segment of any number of ids below 2 ** 32, at most 262,144 of them distinct."""
    if len(ids) and ids.max() < 1 << 20:
        seen = np.bincount(ids) > 0
        alphabet, places = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    else:
        alphabet, places = np.unique(ids, return_inverse=True)
    length = block_length(len(ids))
    blocks = -(-len(ids) // length)
    full = np.zeros(blocks * length, np.int32)  # the last block is filled up with the least id
    full[: len(ids)] = places
    full = full.reshape(blocks, length)
    sizes = shares(np.bincount(places, minlength=len(alphabet)))
    words = [w for i in range(0, blocks, LANES) for w in _encode(np.ascontiguousarray(full[i : i + LANES].T), len(alphabet), sizes)]
    alphabet = alphabet.astype("<u4")
    told = np.array([(len(w), zlib.crc32(alphabet[f].tobytes())) for w, f in zip(words, full)], "<u4").reshape(-1, 2)
    packed = zlib.compress(np.concatenate([np.diff(alphabet, prepend=alphabet[:1] * 0), sizes]).astype("<u4").tobytes())
    head = struct.pack(HEAD, MAGIC, 3, len(ids), length, len(alphabet), len(packed), zlib.crc32(packed))
    return head + packed + told.tobytes() + b"".join(w.tobytes() for w in words)


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment, as unsigned 32-bit integers; ValueError where it isn't whole."""
    head = struct.calcsize(HEAD)
    if len(segment) < head:
        raise ValueError("not a segment of coded ids")
    magic, version, n, length, distinct, size, crc = struct.unpack_from(HEAD, segment)
    if (magic, version) != (MAGIC, 3):
        raise ValueError("not a segment of coded ids")
    blocks = -(-n // length)
    if len(segment) < head + size + 8 * blocks or zlib.crc32(segment[head : head + size]) != crc:
        raise ValueError("a segment is cut off or its alphabet's checksum is wrong")
    told = np.frombuffer(zlib.decompress(segment[head : head + size]), "<u4")
    alphabet, sizes = np.cumsum(told[:distinct], dtype="<u4"), told[distinct:]
    head += size
    told = np.frombuffer(segment, "<u4", 2 * blocks, head).reshape(-1, 2).astype(np.int64)
    ends = (head + 8 * blocks + 4 * np.cumsum(told[:, 0])).tolist()
    if len(segment) != (ends[-1] if blocks else head):
        raise ValueError("a segment is cut off")
    words = [np.frombuffer(segment, "<u4", int(k), e - 4 * int(k)) for (k, _), e in zip(told, ends)]
    out = np.zeros((blocks, length), "<u4")
    for i in range(0, blocks, LANES):
        out[i : i + LANES] = alphabet[_decode(words[i : i + LANES], length, sizes).T]
    for block, (_, crc) in zip(out, told):
        if zlib.crc32(block.tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    return out.reshape(-1)[:n]
