"""URL filters by a sort-merge range join of reversed hosts and rules.

A host's canonical key is its labels reversed, each followed by U+0000
(``www.example.com`` -> ``com.example.www.`` with U+0000 for the dot), which sorts
below every other character; where a label holds U+0000 itself it is written
with U+0001. So a rule's host and all its subdomains are one interval of the key
order. Each partition's urls are sorted by key and path where they are and merged
with the sorted rules: a sweep keeps a stack of the hosts whose interval is open,
which nest. Within a host the rules' paths are intervals of the path order, which
nest as well: each knows the one around it, so what fits is a chain from the
last path that does not sort after the url's.

Scale: urls are sorted inside their partitions and never shuffled, so a host
that has a third of all rows makes no hot task. Rules travel in blocks of at
most about ``RULE_BYTES``, whose index lives as long as a task; with several
blocks each adds to the best rule so far.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits only rules with an empty host; of rules that fit the longest ``host+path``
wins, then the longer host, then allow, in whatever blocks they are; repeated
rows give repeated results; without rules every url gets the default verdict; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULE_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_key(host: str) -> str:
    return "".join(f"{_escaped(label)}\0" for label in reversed(host.split("."))) if host else ""


def _escaped(label: str) -> str:
    return label.replace("\x01", "\x01\x02").replace("\0", "\x01\x01")


class _Node:
    """The rules of one host: sorted paths, each with its verdict and the path around it."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.verdicts = key, host, {}

    def add(self, rule: Rule) -> None:
        if self.verdicts.get(rule.path) != "allow":
            self.verdicts[rule.path] = rule.verdict

    def close(self) -> _Node:
        self.paths = sorted(self.verdicts)
        self.around: list[int] = []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(i)
        return self

    def best(self, path: str) -> str | None:
        """The longest path that the url's starts with."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.around[i]
        return self.paths[i] if i >= 0 else None


def _nodes(rules: Iterable[Rule]) -> list[_Node]:
    by_key: dict[str, _Node] = {}
    for r in rules:
        key = host_key(r.host)
        by_key.setdefault(key, _Node(key, r.host)).add(r)
    return [by_key[k].close() for k in sorted(by_key)]


def _rank(rule: str, host_length: int, verdict: str) -> tuple[int, int, bool]:
    return len(rule), host_length, verdict == "allow"


def sweep(nodes: list[_Node], urls: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, str] | None]:
    """The best rule of each (key, path), keys in rising order, the length of its host and its verdict, or None."""
    stack: list[_Node] = []
    at = 0
    for key, path in urls:
        while at < len(nodes) and nodes[at].key <= key:
            while stack and not nodes[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(nodes[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        best = None
        for node in stack:
            if (p := node.best(path)) is not None:
                found = (node.host + p, len(node.host), node.verdicts[p])
                if best is None or _rank(*found) > _rank(*best):
                    best = found
        yield best


def _blocks(stream: Iterator[Rule]) -> Iterator[list[Rule]]:
    block, size = [], 0
    for r in stream:
        block.append(r)
        size += len(r.host) + len(r.path) + 100
        if size >= RULE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    ``rules``: :class:`Rule` objects, or a table of verdict, host and path.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rows = rules.select("verdict", "host", "path").where("host is not null and path is not null").toLocalIterator()
        stream: Iterator[Rule] = (Rule(*r) for r in rows)
    else:
        stream = iter(rules)
    url = F.coalesce(F.col("url"), F.lit(""))
    found = pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("int").alias("host_length"),
        F.lit(None).cast("string").alias("verdict"),
    )
    escaped = F.replace(F.replace("host", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\0"), F.lit("\x01\x01"))
    key = F.concat_ws("\0", F.reverse(F.split(escaped, r"\.")), F.lit(""))
    found = found.withColumn("key", F.when(F.col("host") == "", "").otherwise(key)).sortWithinPartitions("key", "path")
    fields = "page_id long, host string, path string, rule string, host_length int, verdict string, key string"
    for block in _blocks(stream):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            nodes = _nodes(shipped.value)

            # one sweep over the partition: batches come in key order
            pending: list[pa.RecordBatch] = []

            def urls():
                for batch in (b for b in batches if b.num_rows):
                    pending.append(batch)
                    yield from zip(batch.column(6).to_pylist(), batch.column(2).to_pylist())

            hits: list[tuple[str, int, str] | None] = []
            for hit in sweep(nodes, urls()):
                hits.append(hit)
                if len(hits) == pending[0].num_rows:
                    yield _answer(pending.pop(0), hits)
                    hits = []

        found = found.mapInArrow(run, fields)
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _answer(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
    """The better of the rule a block found and the one an earlier block found."""
    rows = []
    for hit, *old in zip(hits, *(batch.column(k).to_pylist() for k in (3, 4, 5))):
        rows.append(tuple(old) if hit is None or old[0] is not None and _rank(*old) >= _rank(*hit) else hit)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns, batch.column(6)], names=["page_id", "host", "path", "rule", "host_length", "verdict", "key"])
