"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Items and documents are normalised alike (A-Z lower-cased, words joined by one
space). What is looked for are all windows of ``window`` consecutive item words.
Any such window holds a whole block of ``(window + 1) // 2`` words that starts at a
multiple of that number in its item, so the blocks are the automaton's keys, with a
space on either side to match whole words, and take up as much as the items
themselves, not ``window`` times that. Each text runs once through the automaton;
where a block ends, the words around it are compared with the item's, and the run
of equal words is a hit if it has a window's length. Items of fewer words are one
key each. Word numbers map to code points of the original text through
:func:`plumbline.llm.words.word_spans`.

Scale: documents are never shuffled or written; only the benchmark travels. It
is read as a stream, in parts of at most ``block_bytes`` of text, one automaton
each (about 60 bytes for each byte of text, 130 MB for a full part). With several
parts a task holds ``HELD`` bytes of texts at a time and takes them through one
automaton after another, so that a worker's memory has a bound whatever the
benchmark's size.

Defined cases: null or empty text has no words and is not contaminated; an item
without words has no windows; items that share an item_id count once; a null
item_id is reported as ``null``; repeated document rows give repeated results;
extra columns are ignored, and kept by :func:`drop_contaminated`; an empty
benchmark contaminates nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.words import split_words, word_spans

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: Bytes of texts that a task holds while they pass through several automatons.
HELD = 32 << 20
#: Contaminated: at least one word in SHARE is hit.
SHARE = 20

_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("contaminated", pa.bool_()),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]
_SCHEMA = "doc_id long, n_words long, n_hit long, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
#: The automaton that a worker used last, by what it was made from.
_built: dict[tuple[str, int], WindowIndex] = {}


class WindowIndex:
    """The automaton over the blocks of a part of the benchmark.

    Keys are the UTF-8 bytes of the normalised words, one character for each
    byte: nodes then have few children, which the automaton's library searches
    in a row.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.step = window, (window + 1) // 2
        self.items: list[tuple[str, list[bytes]]] = []
        owners: dict[str, tuple[int, list[tuple[int, int]], set[str]]] = {}
        for name, text in items:
            words = split_words(text)
            if 0 < len(words) < window:
                owners.setdefault(_joined(words), (len(words), [], set()))[2].add(name)
            elif words:
                for i in range(0, len(words) - self.step + 1, self.step):
                    part = words[i : i + self.step]
                    owners.setdefault(_joined(part), (self.step, [], set()))[1].append((len(self.items), i))
                self.items.append((name, words))
        self.automaton = ahocorasick.Automaton()
        for key, (length, blocks, names) in owners.items():
            self.automaton.add_word(key, (length, tuple(blocks), tuple(names)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """[first, last] word ranges that are hit, as they are found, and the items found."""
        ranges: list[tuple[int, int]] = []
        names: set[str] = set()
        if self.empty or not words:
            return ranges, names
        text, at, spaces = _joined(words), 0, 0
        seen: dict[tuple[int, int], int] = {}  # an item along a line of places: where the run found last ends
        for end, (length, blocks, short) in self.automaton.iter(text):
            spaces += text.count(" ", at, end)
            at = end
            first = spaces - length
            if short:
                names.update(short)
                ranges.append((first, spaces - 1))
            for item, i in blocks:
                if seen.get((item, first - i), -1) >= spaces:
                    continue
                name, own = self.items[item]
                a, b = 0, self.step
                most = min(i, first)
                while a < most and own[i - a - 1] == words[first - a - 1]:
                    a += 1
                most = min(len(own) - i, len(words) - first)
                while b < most and own[i + b] == words[first + b]:
                    b += 1
                seen[(item, first - i)] = first + b
                if a + b >= self.window:
                    names.add(name)
                    ranges.append((first - a, first + b - 1))
        return ranges, names


def _joined(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with ranges that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _parts(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in parts, read as a stream of rows; one part at least."""
    part, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary"))
    for name, text in rows.where(F.col("text").isNotNull()).distinct().toLocalIterator():
        if size and size + len(text) > block_bytes:
            yield part
            part, size = [], 0
        part.append((name, bytes(text)))
        size += len(text)
    yield part


def _scanned(docs: DataFrame, text_at: int, benchmark: DataFrame, window: int, block_bytes: int, finish: Callable, schema) -> DataFrame:
    """Every batch of ``docs`` through all automatons, then through ``finish`` with each row's words' number, ranges, items and raw text."""
    sc = docs.sparkSession.sparkContext
    shipped = [sc.broadcast(part) for part in _parts(benchmark, block_bytes)]
    token = f"{sc.applicationId}-{shipped[0]._jbroadcast.id()}-{window}"

    def scan(batches):
        def index(k: int) -> WindowIndex:
            if (token, k) not in _built:
                _built.clear()
                _built[(token, k)] = WindowIndex(shipped[k].value, window)
            return _built[(token, k)]

        def through(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [b.column(text_at).cast(pa.binary()).to_pylist() for b in held]
            found = [[(0, [], set()) for _ in t] for t in texts]
            for k in range(len(shipped)):
                each = index(k)
                for rows, raws in zip(found, texts):
                    for r, raw in enumerate(raws):
                        words = split_words(raw)
                        ranges, names = each.scan(words)
                        rows[r] = (len(words), rows[r][1] + ranges, rows[r][2] | names)
            for batch, rows, raws in zip(held, found, texts):
                yield finish(batch, [(n, merged(ranges), names) for n, ranges, names in rows], raws)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text_at).nbytes
            if size >= HELD or len(shipped) == 1:
                yield from through(held)
                held, size = [], 0
        yield from through(held)

    return docs.mapInArrow(scan, schema)


def _contaminated(n_words: int, ranges: list[tuple[int, int]]) -> tuple[int, bool]:
    n_hit = sum(b - a + 1 for a, b in ranges)
    return n_hit, n_hit > 0 and SHARE * n_hit >= n_words


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: what the benchmark's windows hit in it.

    Columns: doc_id, n_words, n_hit, contaminated, ``items``, the ids found, as
    sorted strings, and ``spans``, the hit passages as code-point [start, end) in
    the original text.
    """

    def finish(batch, found, raws):
        rows = []
        for doc_id, (n, ranges, names), raw in zip(batch.column(0).to_pylist(), found, raws):
            at = word_spans(raw) if ranges else []
            rows.append((doc_id, n, *_contaminated(n, ranges), sorted(names), [{"start": at[a][0], "end": at[b][1]} for a, b in ranges]))
        columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return _scanned(docs.select("doc_id", F.col("text").cast("binary").alias("text")), 1, benchmark, window, block_bytes, finish, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were.

    The verdict is made where the row is: the scan runs over the rows
    themselves, so nothing is joined back and repeated or null ids are safe.
    """

    def finish(batch, found, _):
        return batch.filter(pa.array([not _contaminated(n, ranges)[1] for n, ranges, _ in found], pa.bool_()))

    return _scanned(docs, docs.columns.index("text"), benchmark, window, block_bytes, finish, docs.schema)
