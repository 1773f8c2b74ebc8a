"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's frequent white-space chunks, most of
which are one pre-token, and of the pre-tokens they consist of: the words in one
block of bytes, their token counts in another. A first pass has every task count
the chunks of all its texts; a task keeps the ``KEPT`` most frequent at least
whenever it has seen ``SEEN`` different ones, and returns ``KEPT``. The sums'
``FREQUENT`` greatest are encoded once on the driver and broadcast; the table's
size does not grow with the corpus, and which words are in it changes the speed
alone. Tier two is each worker's own cache: what tier one lacks is encoded where
it occurs and kept, up to a bound. No pre-token of a text is shuffled.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated results; null ids stay null; an empty table gives an empty result;
extra columns are ignored; a text of any length is counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.subword import Encoder, Kept, pre_tokens, slices, uncollected

LIMIT = 2048
#: Entries of the table, those that a task returns, and different chunks that it counts at once.
FREQUENT, KEPT, SEEN = 32_768, 8_192, 200_000
#: Longer chunks than this are never in the table.
LONG = 64
_built: dict[str, "_Counter"] = {}


def frequent_chunks(docs: DataFrame, tokenizer_path: str) -> list[str]:
    """The most frequent white-space chunks of all texts, as the file normalises them."""

    def count(batches):
        encoder, seen = Encoder(tokenizer_path), Counter()
        for batch in batches:
            for part in slices([t or "" for t in batch.column(0).to_pylist()]):
                for text in part:
                    if (plain := encoder.plain(text)) is not None:
                        seen.update(plain.split())
                if len(seen) > SEEN:
                    seen = Counter(dict(seen.most_common(SEEN // 4)))
        top = [(c, n) for c, n in seen.most_common(KEPT) if len(c) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    each = docs.select("text").mapInArrow(count, "chunk string, n long")
    most = each.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(FREQUENT)
    return [r["chunk"] for r in most.collect()]


def token_table(chunks: list[str], tokenizer_path: str) -> tuple[bytes, bytes]:
    """The chunks and the pre-tokens of those that have several, one to a line, and their token counts as unsigned 16-bit integers."""
    encoder = Encoder(tokenizer_path)
    split = {c: pre_tokens(c) for c in chunks}
    words = list(dict.fromkeys(w for parts in split.values() for w in parts))
    counts = {w: len(ids) // 4 for w, ids in zip(words, encoder.pre_token_many(words))} if words else {}
    counts |= {c: sum(counts[w] for w in parts) for c, parts in split.items()}
    return "\n".join(counts).encode(), np.array(list(counts.values()), "<u2").tobytes()


def read_table(table: tuple[bytes, bytes]) -> dict[str, int]:
    words, counts = table
    return dict(zip(words.decode().split("\n"), np.frombuffer(counts, "<u2").tolist())) if counts else {}


class _Counter:
    def __init__(self, path: str, table: tuple[bytes, bytes]):
        self.encoder = Encoder(path)
        self.frequent = read_table(table)
        self.kept: Kept = Kept()

    def learn(self, chunks: set[str]) -> None:
        """Have the token counts of all these white-space chunks in the cache."""
        known, own = self.frequent, self.kept.young
        fresh = self.kept.lacks(chunks.difference(known))
        split = {c: parts for c in fresh if len(parts := pre_tokens(c)) > 1}
        words = fresh.difference(split)
        words |= self.kept.lacks({w for parts in split.values() for w in parts}.difference(known))
        many = list(words)
        own.update((w, len(ids) // 4) for w, ids in zip(many, self.encoder.pre_token_many(many)))
        own.update((c, sum([known[w] if w in known else own[w] for w in parts])) for c, parts in split.items())

    def count_many(self, texts: list[str | None]) -> list[int]:
        out, known = [], self.frequent
        for part in slices([t or "" for t in texts]):
            split = [None if (plain := self.encoder.plain(t)) is None else plain.split() for t in part]
            self.learn(set().union(*[chunks for chunks in split if chunks]))
            own = self.kept.young
            for text, chunks in zip(part, split):
                if chunks is None:
                    out.append(len(self.encoder.whole.encode(text, add_special_tokens=False).ids))
                else:
                    out.append(sum([known[c] if c in known else own[c] for c in chunks]))
            self.kept.age()
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document row."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(token_table(frequent_chunks(docs, tokenizer_path), tokenizer_path))
    token = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

    def count(batches):
        if token not in _built:
            _built.clear()
            _built[token] = _Counter(tokenizer_path, shipped.value)
        counter = _built[token]
        for batch in batches:
            with uncollected():
                n = pa.array(counter.count_many(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    return (
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
        .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
