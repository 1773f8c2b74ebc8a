"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits if and only if some variant lies
within ``radius / 2`` bits of both. So every distinct fingerprint stands for all its
variants within half the radius (2,081 for a radius of 4), equal variants meet, and
who meets is linked: all within half a radius of one variant are within the radius
of each other, so a chain through the members of a variant says what all its pairs
would. The pairs of a chain are verified on the fingerprints all the same.

The shuffle goes by variants, but a row is not one variant: it is a fingerprint, the
first bits of variants, and how many of the other bits may still be flipped. A task
makes the rest of the variants of its rows and meets them in memory. The number of
first bits follows from the number of fingerprints (9 for 230,000, which makes 46
rows of each; 20 for a billion, 211 rows), so what a task meets is bounded however
many fingerprints there are. Groups that are larger, as fingerprints of a crowd of
near copies share their first bits, are split by further bits until they are not:
when all 64 are used a group is one variant, which has no more members than a ball
has variants. A task returns a spanning forest, fewer links than it had rows.

Fingerprints are made once and written to the shared folder, equal ones are one from
the start, and documents meet their component by fingerprint; adaptive execution
splits fingerprints that many documents share.

Defined cases: a null text, or one without words, has the fingerprint zero, and is
linked like any other; with fewer words than a shingle has, the whole sequence is
one shingle; repeated rows and equal ids are documents of their own; a null id never
stands for a component unless nothing else is in it; a bit that is set in exactly
half the shingles is 0; an empty table gives an empty one; extra columns do not
matter.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.near_duplicates import components
from plumbline.llm.runtime import materialise

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Variants that a group is dealt on average, and those beyond which it is split by BITS further bits.
GROUP, MOST, BITS = 1 << 20, 1 << 22, 6
#: Shingles whose hashes are held at once.
BLOCK = 1 << 18
_PLACES = np.arange(8) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included, as 64 unsigned bits."""
    from xxhash import xxh64_intdigest

    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return 0
    text, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends, total, n = ends[k - 1 :], np.zeros(64, np.int64), len(starts)
    for i in range(0, n, BLOCK):
        shingles = map(text.__getitem__, map(slice, starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()))
        total += _set_bits(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, min(BLOCK, n - i)))
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _set_bits(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, from the lowest; many hashes are counted by the values of their bytes."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 800:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF).ravel()


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def sign(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(raw, width) for raw in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(sign, "doc_id long, fp long")


def ball(bits: int, radius: int) -> int:
    """How many variants of so many bits lie within the radius."""
    return sum(comb(bits, i) for i in range(min(bits, radius) + 1))


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in on) for r in range(min(bits, radius) + 1) for on in combinations(range(bits), r)], np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches over the links a - b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further
    return label


def met(fp: np.ndarray, left: np.ndarray, free: int, radius: int) -> np.ndarray:
    """Links of a group: ``fp`` with the flips ``left`` among the lowest ``free`` bits, all other bits of their variants being equal.

    Returned is the place of the smallest linked member of each.
    """
    low = fp & np.uint64((1 << free) - 1)
    variants, owners = [], []
    for r in np.unique(left).tolist():
        at = np.flatnonzero(left == r)
        masks = _masks(free, int(r))
        variants.append((low[at][:, None] ^ masks[None]).ravel())
        owners.append(np.repeat(at, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant, kind="stable")
    variant = variant[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    a, b = owner[order[same]], owner[order[same + 1]]
    a, b = np.divmod(np.unique(np.minimum(a, b) * len(fp) + np.maximum(a, b)), len(fp))
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return forest(len(fp), a[near], b[near])


def _expanded(rows: DataFrame, bits: int, half: int) -> DataFrame:
    """Each row once for every way to flip the next ``bits`` bits of its variants."""
    masks = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(int(m).bit_count()).alias("c")) for m in _masks(bits, half)])
    each = rows.withColumn("x", F.explode(F.filter(masks, lambda m: m["c"] <= F.col("left"))))
    next_bits = F.expr(f"shiftrightunsigned(fp, {64 - bits} - used)").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).bitwiseXOR(F.col("x.m"))
    return each.select("fp", F.shiftleft("key", bits).bitwiseOR(next_bits).alias("key"), (F.col("used") + bits).alias("used"), (F.col("left") - F.col("x.c")).alias("left"))


def _weight(half: int) -> Column:
    """The variants that a row stands for."""
    size = F.lit(1).cast("long")
    for r in range(1, half + 1):
        table = F.array(*[F.lit(ball(64 - used, r)).cast("long") for used in range(65)])
        size = F.when(F.col("left") == r, F.get(table, F.col("used"))).otherwise(size)
    return size


def near_links(distinct: DataFrame, n: int, *, radius: int = RADIUS, group: int = GROUP, most: int = MOST) -> DataFrame:
    """a, b: links of different fingerprints (column fp, each once) that connect all that are within the radius of each other."""
    if radius < 0 or radius % 2:
        raise ValueError("a ball is hashed up to half the radius, which must be even")
    half = radius // 2
    bits = min(24, max(0, -(-n * ball(64, half) // group) - 1).bit_length())
    start = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("used"), F.lit(half).alias("left"))
    rows, settled = _expanded(start, bits, half) if bits else start, []
    while True:
        rows = materialise(rows, "variants")
        sizes = rows.groupBy("used", "key").agg(F.sum(_weight(half)).alias("w"), F.count("*").alias("n"))
        hot = materialise(sizes.where(f"w > {most} and used < 64").select("used", "key"), "hot-variants")
        if not hot.limit(1).count():
            settled.append(rows)
            break
        settled.append(rows.join(hot, ["used", "key"], "left_anti"))
        deep = rows.join(hot, ["used", "key"])
        used = hot.agg(F.max("used")).first()[0]
        rows = _expanded(deep, min(BITS, 64 - used), half)

    def links(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        label = met(fp, group.column("left").to_numpy(), 64 - group.column("used")[0].as_py(), radius)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.Table.from_arrays([pa.array(fp[label[at]].view(np.int64)), pa.array(fp[at].view(np.int64))], names=["a", "b"])

    found = None
    for part in settled:
        some = part.groupBy("used", "key").applyInArrow(links, "a long, b long")
        found = some if found is None else found.union(some)
    return materialise(found, "links")


def find_similar(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, group: int = GROUP, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a
    component is named after the smallest id in it.
    """
    signed = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), distinct.count(), radius=radius, group=group, most=most)
    label = components(links)
    named = distinct.join(label.select(F.col("cls").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_fp = materialise(named.join(least, "comp").select("fp", "component_id"), "components")
    return signed.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
