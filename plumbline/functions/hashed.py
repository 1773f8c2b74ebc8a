"""MD5 of a text and a running number, for many at once: what a bootstrap's draws are made of."""

from __future__ import annotations

from math import floor, sin

import numpy as np

#: Hashes that are made at once: their words are what a core's cache holds, and a call of numpy costs as much as some thousands.
CHUNK = 32_768
_START = [np.array([[x]], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SINES = np.array([floor(abs(sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_LEFT = [np.array(_TURNS[i // 16][i % 4], np.uint32) for i in range(64)]  # numpy is fastest with flat arrays and numbers
_RIGHT = [32 - x for x in _LEFT]


def _block(state: list[np.ndarray], fixed: np.ndarray, varying: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The state after a block: a row for each text of ``fixed`` words, a column for each number of the ``varying`` ones, which are added."""
    rows, columns = len(fixed), max(state[0].shape[1], *(len(v) for v in varying.values()), 1)
    plus = (fixed[:, _WORDS] + _SINES).T[:, :, None].copy()
    # steps before the first word that varies are the same for every number
    alike = min(varying) if varying and state[0].shape[1] == 1 else 0
    now = _steps([np.broadcast_to(s, (rows, s.shape[1])).copy() for s in state], plus, {}, range(alike))
    flat = rows == 1
    shape = columns if flat else (rows, columns)
    now = [np.broadcast_to(x.ravel() if flat else x, shape).copy() for x in now]
    now = _steps(now, [np.array(x[0, 0]) for x in plus] if flat else plus, varying, range(alike, 64))
    return [x.reshape(rows, columns) + s for x, s in zip(now, state)]


def _steps(state: list[np.ndarray], plus, varying: dict[int, np.ndarray], steps: range) -> list[np.ndarray]:
    """Some of the 64 steps of a block, in place."""
    a, b, c, d = state
    f = np.empty_like(a)
    add, xor, both, either, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
    for i in steps:
        if i < 16:
            xor(c, d, f), both(f, b, f), xor(f, d, f)
        elif i < 32:
            xor(b, c, f), both(f, d, f), xor(f, c, f)
        elif i < 48:
            xor(b, c, f), xor(f, d, f)
        else:
            np.invert(d, f), either(f, b, f), xor(f, c, f)
        add(a, plus[i], a)
        if _WORDS[i] in varying:
            add(a, varying[_WORDS[i]], a)
        add(a, f, a), left(a, _LEFT[i], f), right(a, _RIGHT[i], a), either(a, f, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def _digit_words(size: int, first: int, last: int) -> dict[int, np.ndarray]:
    """The words that hold the digits of the numbers from first to ``last`` - 1, all of the same length, behind ``size`` bytes."""
    rest, words = np.arange(first, last, dtype=np.uint64), {}
    for place in range(size + len(str(first)) - 1, size - 1, -1):
        above = rest // np.uint64(10)
        byte = (rest - above * np.uint64(10) + np.uint64(48)).astype(np.uint32) << np.uint32(8 * (place % 4))
        words[place // 4] = words[place // 4] | byte if place // 4 in words else byte
        rest = above
    return words


def _leading(texts: list[bytes], digits: int, words: dict[int, np.ndarray]) -> np.ndarray:
    filled = len(texts[0]) + digits
    blocks = (filled + 8) // 64 + 1
    end = b"\x80" + bytes(64 * blocks - filled - 9) + (8 * filled).to_bytes(8, "little")
    fixed = np.frombuffer(b"".join(t + bytes(digits) + end for t in texts), "<u4").reshape(len(texts), -1)
    state = _START
    for k in range(0, 16 * blocks, 16):
        state = _block(state, fixed[:, k : k + 16], {w - k: v for w, v in words.items() if k <= w < k + 16})
    return (state[0].byteswap().astype(np.uint64) << np.uint64(16)) | (state[1].byteswap() >> np.uint32(16))


def leading_48_bits(texts: list[bytes], first: int, last: int) -> np.ndarray:
    """The first 48 bits of the MD5 of each text with each number from ``first`` to ``last`` - 1 in decimal behind it: a row for each text."""
    out = np.empty((len(texts), last - first), np.uint64)
    sizes = np.array([len(t) for t in texts])
    for size in np.unique(sizes).tolist():
        rows, at = np.flatnonzero(sizes == size), first
        while at < last:
            end = min(last, at + CHUNK, 10 ** len(str(at)))
            words = _digit_words(size, at, end)
            step = max(1, CHUNK // (end - at))
            for i in range(0, len(rows), step):
                out[rows[i : i + step], at - first : end - first] = _leading([texts[r] for r in rows[i : i + step]], len(str(at)), words)
            at = end
    return out
