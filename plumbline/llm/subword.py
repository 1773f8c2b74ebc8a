"""Exact encoding with a word-end BPE file, white-space chunk by chunk.

No pre-token of such a file spans white space, so the ids of a text are those
of its chunks, one after another, and a chunk's ids can be kept. Which texts
may be split this way is decided from their characters alone: code points below
U+0300, whose case, composition and category agree in Python and in the
library, without the separators U+001C to U+001F and without ``<|``, which may
begin a special token. Every other text goes through the library as a whole, and
so does every text if the file's normaliser, pre-tokens or model are not those
that are written out here.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from plumbline.llm.chunk_table import BLOCK, ChunkTable, Collision, Places

#: Entries in each of the two generations of a worker's cache, about 170 bytes each; longer keys than LONG characters are not kept.
CACHE_ENTRIES, LONG = 300_000, 64


def _class(*initials: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] in initials)


_SPACE = "\\t-\\r \\x85\\xa0"
_L, _N = _class("L"), _class("N")
#: The pre-token pattern of the file, with its classes spelled out below U+0300.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
_FAR = "".join(chr(c) for c in range(0x300) if max(chr(c).lower()) >= "\u0300")
_ODD = re.compile(f"[\\x1c-\\x1f{_FAR}\\u0300-\\U0010ffff]|<\\|")
#: No rank, and no id.
_NONE, _NOTHING = (1 << 31) - 1, (1 << 31) - 1
#: Bytes of the pre-tokens that are encoded together; longer ones go through the library.
WIDTHS = (4, 8, 12, 16, 24, 40, 64)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of ids, another one for every pair."""
    return ((left << 32 | right) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


#: How a byte-level file writes bytes: the printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: How a file has to normalise and split for its texts to be split here.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _as_written_here(file: dict) -> bool:
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in file.get("added_tokens", ()))
    same = (file.get("normalizer") or {}).get("normalizers") == _NORMAL and split.get("pretokenizers") == _SPLIT
    letters = plain and bool(model.get("end_of_word_suffix")) and all(chr(c) + e in model["vocab"] for c in _LETTER.values() for e in ("", model["end_of_word_suffix"]))
    return model.get("type") == "BPE" and special and same and letters and not file.get("truncation") and not file.get("padding")


class Encoder:
    """ids of texts, and of pre-tokens, of one ``tokenizers`` file.

    ``splits`` tells whether texts of this file may be split at white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.splits = _as_written_here(file)
        if not self.splits:
            return
        model = file["model"]
        self.vocabulary = ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        #: pairs of ids -> their rank, and the id that replaces each pair
        self.pairs = Places(1 << (4 * len(model["merges"])).bit_length())
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        # a pair that stands twice has its later rank, as in a table that is written in order
        _, last = np.unique((left << 32 | right)[::-1], return_index=True)
        ranks = np.sort(len(pairs) - 1 - last)
        self.pairs.enter(_pair(left[ranks], right[ranks]), ranks)
        self.merged = np.array([ids[x + y] for x, y in pairs], np.int64)
        self.table = ChunkTable(pre_tokens, self.pre_token_ids)
        self._inner, self._last = (np.array([ids[chr(_LETTER[b]) + end] for b in range(256)], np.int64) for end in ("", self.end))

    def plain(self, text: str) -> str | None:
        return plain_text(text) if self.splits else None

    def pre_token_ids(self, raw: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the pre-tokens has that stand at these places among the bytes, and all their ids."""
        counts, made = np.zeros(len(begin), np.int64), []
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if len(rows):
                counts[rows], ids = self._merge_rows(raw, begin[rows], lengths[rows], width)
                made.append((rows, ids))
        rows = np.flatnonzero(lengths > least)
        if len(rows):
            each = [self.whole.encode(raw[a : a + n].tobytes().decode(), add_special_tokens=False).ids for a, n in zip(begin[rows].tolist(), lengths[rows].tolist())]
            counts[rows] = [len(x) for x in each]
            made.append((rows, np.array([i for x in each for i in x], "<u4")))
        out = np.empty(counts.sum(), "<u4")
        starts = np.cumsum(counts) - counts
        for rows, ids in made:
            n = counts[rows]
            out[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return counts, out

    def pre_token_many(self, words: list[str]) -> list[bytes]:
        """The ids of many pre-tokens at once, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        data = [w.encode() for w in words]
        lengths = np.array([len(w) for w in data])
        counts, ids = self.pre_token_ids(np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths, lengths)
        ends, flat = (4 * np.cumsum(counts)).tolist(), ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(_pair(left, right), _NONE)

    def _merge_rows(self, raw: np.ndarray, begin: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pair of lowest rank, the first of them, until a row has none; all rows at once.

        A row has a cell on either side of its word. A merge leaves its id in the
        left cell and nothing in the right one; ``before`` and ``after`` lead from
        a cell to its neighbours that still hold an id.
        """
        n, cells = len(begin), width + 2
        cols = np.arange(width)
        codes = raw[np.minimum(begin[:, None] + cols, len(raw) - 1)]
        grid = np.full((n, cells), _NOTHING, np.int64)
        grid[:, 1:-1] = np.where(cols < lengths[:, None], self._inner[codes], _NOTHING)
        ids, ends = grid.reshape(-1), np.arange(n) * cells + lengths
        ids[ends] = self._last[codes[np.arange(n), lengths - 1]]
        ranks = np.full((n, cells), _NONE, np.int32)
        inside = np.flatnonzero(ids[1:] != _NOTHING)  # the cell before one that holds an id
        rank = ranks.reshape(-1)
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        after, before = np.arange(1, n * cells + 1), np.arange(-1, n * cells - 1)
        live = np.arange(n)
        while len(live):
            at = live * cells + (ranks if len(live) == n else ranks[live]).argmin(1)
            best = rank[at]
            going = best < _NONE
            if not going.all():
                live, at, best = live[going], at[going], best[going]
            new, gone = self.merged[best], after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], rank[gone] = new, _NOTHING, _NONE
            after[at], before[right] = right, at
            rank[at], rank[left] = self._rank(new, ids[right]), self._rank(ids[left], new)
        held = grid != _NOTHING
        return held.sum(1), ids[held.reshape(-1)].astype("<u4")

    def ids_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        The texts go through in slices of about a million characters, so that
        what is held besides the table has a bound.
        """
        for part in slices(texts, BLOCK):
            plain = [self.plain(t) for t in part]
            data = [(p if p.isascii() else p.replace("\x85", " ").replace("\xa0", " ")).encode() for p in plain if p is not None]
            try:
                found = list(self.table.ids_of(data)) if data else []
            except Collision:
                plain, found = [None] * len(part), []
            each = iter(found)
            for text, p in zip(part, plain):
                yield self._library(text) if p is None else next(each)

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@contextmanager
def uncollected():
    """Without the search for reference cycles, of which encoding makes none and which would walk the caches again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(texts: list[str], characters: int = 2_000_000) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > characters:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def pre_tokens(chunk: str) -> list[str]:
    return [chunk] if chunk.isalpha() else _PRE.findall(chunk)


class Kept:
    """A cache of two generations. ``lacks()`` moves what is asked for again from
    the old one to the young one; ``age()`` lets the old one go once the young
    one is full. Between the two, what was asked for is in ``young``."""

    def __init__(self, entries: int | None = None):
        self.entries, self.young, self.old = entries or CACHE_ENTRIES, {}, {}

    def lacks(self, keys: set) -> set:
        missing = keys.difference(self.young)
        if self.old and missing:
            old = self.old
            self.young.update([(k, old[k]) for k in missing if k in old])
            missing = missing.difference(self.young)
        return missing

    def age(self) -> None:
        if len(self.young) >= self.entries:
            for k in [k for k in self.young if len(k) > LONG]:
                del self.young[k]
            self.old, self.young = self.young, {}


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def plain_text(text: str) -> str | None:
    """The text as the file normalises it, or None if it has to go to the library as a whole."""
    if _latin(text):  # code points below U+0100 stand composed, and so do they in lower case
        odd = "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return None if odd else text.lower()
    if _ODD.search(text):
        return None
    return unicodedata.normalize("NFC", text).lower()
