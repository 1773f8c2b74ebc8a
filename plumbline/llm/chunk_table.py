"""ids of white-space chunks in arrays: many chunks are looked up at once.

A block of text is one run of bytes. Its chunks are found by comparing
neighbouring bytes; a chunk of at most ``WIDE`` bytes is three numbers and its
length, and their mix leads to its place in an open-addressed table. What is
found there is compared with the chunk itself, so two chunks with the same mix
are noticed, and the block that holds them is left to the library. Chunks that
the table lacks are encoded, each once, and entered; longer ones are not found
again in later blocks. When there are more than ``entries``, the half of them
that occurred most often stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Entries of a worker's table, about 90 bytes each, and bytes of a block.
ENTRIES, BLOCK = 400_000, 1_000_000
#: Bytes of the longest chunk in the table.
WIDE = 24
#: ids for each entry that the table may hold before it is made smaller.
IDS = 12

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes other than small letters of ASCII.
_OTHER = np.ones(256, np.int32)
_OTHER[97:123] = 0
_SPACE = re.compile(rb"[\t-\r ]")
#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each key, never 0."""
    h = keys[0] * _MIX[0]
    h ^= h >> np.uint64(32)
    h = (h ^ keys[1]) * _MIX[1]
    h ^= h >> np.uint64(29)
    h = (h ^ keys[2] ^ sizes.astype(np.uint64) << np.uint64(56)) * _MIX[2]
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


class Collision(Exception):
    """Two different chunks have the same mix."""


class Places:
    """An open-addressed table from numbers above 0, which should be evenly spread, to other numbers."""

    def __init__(self, size: int):
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.slots, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def find(self, hashes: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(hashes), missing, np.int64)
        at = (hashes >> self.shift).astype(np.int64)
        rows, last = None, len(self.slots) - 1
        while len(at):
            there = self.slots[at]
            same = there == (hashes if rows is None else hashes[rows])
            hit = np.flatnonzero(same)
            out[hit if rows is None else rows[hit]] = self.values[at[hit]]
            on = np.flatnonzero(~same & (there > 0))
            rows, at = on if rows is None else rows[on], at[on] + 1 & last
        return out

    def enter(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Put different numbers, none of which is in the table, into free places."""
        at, rows = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        last = len(self.slots) - 1
        while len(rows):
            free = np.flatnonzero(self.slots[at] == 0)
            self.slots[at[free]] = hashes[rows[free]]
            won = self.slots[at] == hashes[rows]
            self.values[at[won]] = values[rows[won]]
            rows, at = rows[~won], at[~won] + 1 & last


#: Where the pre-tokens are: the bytes, where each starts and how long it is. Their ids: how many each has, and all of them.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class ChunkTable:
    """``split`` gives a chunk's pre-tokens, of which one of small letters alone has one."""

    def __init__(self, split: Callable[[str], list[str]], encode: Encode, entries: int | None = None):
        self.split, self.encode, self.entries = split, encode, entries or ENTRIES
        self.places = Places(1 << 10)
        self.n, self.end = 0, 0
        self.hashes, self.lengths, self.hits, self.counts = (np.zeros(0, t) for t in (np.uint64, np.uint8, np.int64, np.int64))
        self.keys, self.starts, self.ids = np.zeros((3, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _append(self, hashes, keys, lengths, counts, ids) -> np.ndarray:
        """New entries; a hash of 0 is an entry that is not to be found."""
        new = np.arange(self.n, self.n + len(hashes))
        begin = self.end + np.cumsum(counts) - counts
        for name, more in (("hashes", hashes), ("lengths", lengths), ("hits", np.zeros(len(new), np.int64)), ("counts", counts), ("starts", begin)):
            setattr(self, name, _put(getattr(self, name), self.n, more))
        self.keys = _put(self.keys, self.n, keys)
        self.ids = _put(self.ids, self.end, ids)
        self.n, self.end = self.n + len(new), self.end + len(ids)
        entered = new[hashes > 0]
        if 2 * self.n > len(self.places.slots):
            self.places = Places(1 << (4 * self.n).bit_length())
            entered = np.flatnonzero(self.hashes[: self.n])
        self.places.enter(self.hashes[entered], entered)
        return new

    def _shrink(self) -> None:
        """Keep the entries that occurred most often, half of what may be held at most; older occurrences count less and less."""
        kept = np.flatnonzero(self.hashes[: self.n])
        if len(kept) > self.entries // 2:
            kept = np.sort(kept[np.argpartition(-self.hits[kept], self.entries // 2)[: self.entries // 2]])
        ids, counts = self._gather(kept), self.counts[kept]
        if len(ids) > self.entries * IDS // 2:
            kept, ids, counts = kept[:0], ids[:0], counts[:0]
        old = self.hashes[kept], self.keys[:, kept], self.lengths[kept], self.hits[kept] >> 1
        self.places = Places(len(self.places.slots))
        self.n, self.end = 0, 0
        self._append(*old[:3], counts, ids)
        self.hits[: self.n] = old[3]

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of these entries, one after another."""
        counts = self.counts[entries]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[entries] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def _entries(self, data: bytes, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of the bytes start, and their entries; ``whole``: each is one pre-token."""
        raw = np.frombuffer(data + bytes(WIDE), np.uint8)
        solid = np.zeros(len(data) + 2, bool)
        np.logical_not(_BLANK[raw[: len(data)]], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        begin, stop = edges[::2], edges[1::2]
        lengths = stop - begin
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        keys = np.stack([eight[begin + 8 * j] & _LOW[np.clip(lengths - 8 * j, 0, 8)] if j else eight[begin] & _LOW[np.minimum(lengths, 8)] for j in range(3)])
        hashes = mixed(keys, lengths)
        found = self.places.find(hashes, -1)
        known = found >= 0
        long = lengths > WIDE
        found[long] = -1
        known &= ~long
        self._check(keys, lengths, known, found)
        lacking = np.flatnonzero(~known & ~long)
        if len(lacking):
            different, first, which = np.unique(hashes[lacking], return_index=True, return_inverse=True)
            one = lacking[first]
            found[lacking] = self._add(data, raw, begin[one], lengths[one], different, keys[:, one], whole)[which]
            self._check(keys, lengths, lacking, found)
        if long.any():
            number: dict[bytes, int] = {}
            at = np.flatnonzero(long)
            which = [number.setdefault(data[a:b], len(number)) for a, b in zip(begin[at].tolist(), stop[at].tolist())]
            one = at[np.unique(which, return_index=True)[1]]
            none = np.zeros((4, len(one)), np.uint64)
            found[at] = self._add(data, raw, begin[one], lengths[one], none[3], none[:3], whole)[which]
        self.hits[: self.n] += np.bincount(found, minlength=self.n)
        return begin, found

    def _check(self, keys, lengths, rows, found) -> None:
        entries = found[rows]
        same = self.lengths[entries] == lengths[rows]
        for j in range(3):
            same &= self.keys[j, entries] == keys[j, rows]
        if not same.all():
            raise Collision

    def _add(self, data: bytes, raw, begin, lengths, hashes, keys, whole: bool) -> np.ndarray:
        """New entries of different chunks; a chunk of one pre-token has that pre-token's entry."""
        if whole:
            return self._append(hashes, keys, np.where(hashes > 0, lengths, 0).astype(np.uint8), *self.encode(raw, begin, lengths))
        new = np.empty(len(begin), np.int64)
        others = np.concatenate([[0], np.cumsum(_OTHER[raw])])
        plain = others[begin + lengths] == others[begin]
        new[plain] = self._add(data, raw, begin[plain], lengths[plain], hashes[plain], keys[:, plain], True)
        begin, lengths, hashes, keys = begin[~plain], lengths[~plain], hashes[~plain], keys[:, ~plain]
        if not len(begin):
            return new
        parts = [self.split(data[a:b].decode()) for a, b in zip(begin.tolist(), (begin + lengths).tolist())]
        _, found = self._entries(" ".join([w for p in parts for w in p]).encode(), True)
        per = np.array([len(p) for p in parts])
        ends, sums = np.cumsum(per), np.concatenate([[0], np.cumsum(self.counts[found])])
        made, several = found[ends - per], per > 1
        counts, ids = (sums[ends] - sums[ends - per])[several], self._gather(found[np.repeat(several, per)])
        widths = np.where(hashes > 0, lengths, 0)[several].astype(np.uint8)
        made[several] = self._append(hashes[several], keys[:, several], widths, counts, ids)
        new[~plain] = made
        return new

    def ids_of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; white space is that of ``_BLANK`` alone."""
        if len(texts) == 1:
            yield b"".join(ids for block in blocks(texts[0]) for ids in self._ids_of([block]))
        else:
            yield from self._ids_of(texts)

    def _ids_of(self, texts: list[bytes]) -> Iterator[bytes]:
        if self.n > self.entries or self.end > IDS * self.entries:
            self._shrink()
        begin, found = self._entries(b" ".join(texts), False)
        flat = self._gather(found).tobytes()
        chunks = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
        sums = np.concatenate([[0], np.cumsum(self.counts[found])])
        ends = (4 * sums[chunks]).tolist()
        for a, b in zip([0, *ends], ends):
            yield flat[a:b]


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``more`` from place n on along the last axis, in an array that grows by half."""
    need = n + more.shape[-1]
    if need > held.shape[-1]:
        grown = np.zeros((*held.shape[:-1], max(need, held.shape[-1] * 3 // 2)), held.dtype)
        grown[..., :n] = held[..., :n]
        held = grown
    held[..., n:need] = more
    return held


def blocks(data: bytes) -> Iterator[bytes]:
    """Cut at white space, the first one after BLOCK bytes."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + BLOCK)
        end = space.end() if space else len(data)
        yield data[at:end]
        at = end
