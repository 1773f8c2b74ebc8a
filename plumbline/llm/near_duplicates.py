"""MinHash near-duplicates with odd sketches.

A document's set is that of its word shingles, as 64-bit hashes. ``BANDS`` bands
of ``ROWS`` MinHash samples propose documents that may be alike. The same samples
are folded into a bitmap of ``BITS`` parities, the odd sketch: the bits in which
two sketches differ number ``x``, and

    similarity ~ 1 + BITS / (4 * samples) * ln(1 - 2 * x / BITS)

which is precise where similarities are high; proposals estimated more than
``MARGIN`` (about six standard errors) below the threshold go no further. The
others are confirmed on the full sets.

Equal sets are one class from the start. In a bucket every class is compared with
its leader, the member whose buckets are fullest: in a group of near copies that
is the text they were copied from. Confirmed links make components.

What is left are links between members of a bucket of which one at least is not
in its leader's component. They are found exactly, through the members' symmetric
differences from the leader, ``dx = x ^ L``: as ``x ^ y = dx ^ dy``, two sets are
linked if and only if

    |dx & dy| >= (w(x) + w(y)) / (2 * (100 + t)),  w(x) = (100 + t) * |dx| - (100 - t) * |x|

with the threshold ``t`` in hundredths, and that is never less than one element,
since one of the two is not linked to the leader. So a prefix filter applies:
the elements of the differences are ordered rarest first among the members of a
leader, and linked pairs meet in a prefix of both, whose length follows from a
member's own ``w`` and the class of its partner's. What a whole group has in
common, with the leader or without it, is no part of the differences, or comes
last in them. Elements of one member alone only count.

Members that share an element of their prefixes are a bucket of the second kind.
Where more than ``CROSSINGS`` pairs for each entry could meet there, each such
bucket is first compared with two leaders of its own, again while that finds
links, which settles clusters inside the group with two rows an entry; then all
pairs between components that are left, and whose places in the order allow a
link, are confirmed. Only a crowd of texts
that are all just short of linked, and have no cluster among them, makes more
pairs than that. At the threshold a
link shares no band with a probability of ``(1 - t^ROWS)^BANDS``: 5e-8 at 0.80,
6e-11 at 0.85.

Joins go by bucket or class key with narrow rows, and adaptive execution splits
hot keys; nothing but the sets of documents in a proposal is carried with them.
All tables that are used again are written to the shared folder.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing; with fewer words than a shingle has, the whole sequence is one;
repeated rows and equal ids with different texts are documents of their own that
share an id; a null id never stands for a component, unless nothing else is in
it; extra columns do not matter.
"""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.runtime import materialise, unused

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, BITS, MARGIN = 32, 4, 256, 0.2
SAMPLES = BANDS * ROWS
#: Rows up to which a list of ids is broadcast.
BROADCAST_ROWS = 500_000
#: Pairs for each entry of a prefix up to which they are met without further leaders, and rounds of leaders.
CROSSINGS, ROUNDS = 4, 6
#: Classes of w: their width is a part of this of the greatest w, or of what is linked to the leader if that is more.
FINE = 22
#: Words whose hashes a task keeps at once; longer words than LONG bytes are not kept.
WORDS, LONG = 100_000, 40
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_draw = np.random.default_rng(20240607).integers(0, 1 << 63, (3, SAMPLES), dtype=np.uint64)
_A, _B, _C = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1], _draw[2] * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = [f"s{i}" for i in range(BITS // 64)]


class _WordHashes(dict):
    """Hashes of words; one for each partition, so that it ends with it."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(raw: bytes | None, width: int, hashes: _WordHashes | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = _mixed(x + h[i : i + n])
    return np.unique(x + np.uint64(k != width))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(1), out=out)
    return out


def _fold(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of rows of samples."""
    n = len(samples)
    parts = _mixed(samples * _C).reshape(n, BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        keys = _mixed(keys + parts[:, :, r])
    bit = (_mixed(samples ^ _C) >> np.uint64(56)).astype(np.int64) % BITS
    bits = np.zeros((n, BITS), np.uint8)
    np.add.at(bits, (np.arange(n)[:, None], bit), 1)
    return keys.view(np.int64), np.packbits(bits & 1, axis=1).view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n, cls, bands and sketch of every document row."""

    def sign(batches):
        import xxhash

        hashes = _WordHashes()
        for batch in batches:
            ns, cls, samples = [], [], []
            for raw in batch.column(2).to_pylist():
                s = shingle_set(raw, width, hashes)
                ns.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    samples.append(minhash(s))
            keys, sketch = _fold(np.array(samples, np.uint64).reshape(-1, SAMPLES))
            has = np.array([c is not None for c in cls], bool)
            at = np.cumsum(has) - 1
            ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            full = np.zeros((len(has), len(_SKETCH)), np.int64)
            full[has] = sketch[at[has]] if len(sketch) else 0
            columns = [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(cls, pa.binary()), bands, *[pa.array(full[:, i].copy()) for i in range(len(_SKETCH))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "cls", "bands", *_SKETCH])

    plain = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    fields = "doc_id long, row long, n long, cls binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)
    return materialise(plain.mapInArrow(sign, fields), "signatures")


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: its smallest doc_id, and a row of the table that has it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("at")
    own = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(first, *[F.first(c).alias(c) for c in ("n", "bands", *_SKETCH)])
    return materialise(own.select("cls", F.col("at.doc_id").alias("rep"), F.col("at.row").alias("row"), "n", "bands", *_SKETCH), "classes")


def _ordered(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Job:
    def __init__(self, docs: DataFrame, width: int, threshold: float):
        self.docs, self.width, self.threshold = docs, width, round(threshold * 100)
        self.most = int(BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - threshold + MARGIN) / BITS)))
        self.signed = _signatures(docs, width)
        self.classes = _classes(self.signed)

    def _plausible(self, x: str, y: str):
        """By the sketches and the sizes of two sets they may be linked."""
        differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH])
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= self.threshold * F.greatest(f"{x}.n", f"{y}.n")
        return (differ <= self.most) & sizes

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    def full_sets(self, named: DataFrame) -> DataFrame:
        """cls, items: the whole set of every class named, from one text that has it."""
        width = self.width
        needed = materialise(self.classes.join(named, "cls", "left_semi").select(F.col("rep").alias("r"), F.col("row").alias("w")), "needed")
        plain = self.docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
        texts = plain.join(self._few(needed), (F.col("row") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("r")), "left_semi")

        def sets(batches):
            import xxhash

            hashes = _WordHashes()
            for batch in batches:
                found = [shingle_set(raw, width, hashes) for raw in batch.column(0).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                values = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
                names = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["cls", "items"])

        return materialise(texts.select(F.col("text").cast("binary")).mapInArrow(sets, "cls binary, items array<long>").dropDuplicates(["cls"]), "sets")

    def _with_sets(self, pairs: DataFrame, a: str, b: str, full: DataFrame) -> DataFrame:
        """The pairs with both sets, x of a and y of b; the side with hot keys meets narrow rows."""
        left = pairs.join(full.select(F.col("cls").alias(b), F.col("items").alias("y")), b)
        return left.join(full.select(F.col("cls").alias(a), F.col("items").alias("x")), a)

    def confirmed(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """Those pairs of classes whose full sets reach the threshold."""
        both = self._with_sets(materialise(pairs, "proposed"), "a", "b", full)
        # 100 * common >= threshold * (x + y - common), with the intersection written once
        linked = (100 + self.threshold) * F.size(F.array_intersect("x", "y")) >= self.threshold * (F.size("x") + F.size("y"))
        return materialise(both.where(linked).select("a", "b"), "links")

    def links(self) -> DataFrame:
        rows = self.classes.select("cls", F.explode("bands").alias("key"))
        counts = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        shared = materialise(rows.join(counts, "key").select("key", "cls", "members"), "buckets")
        fullness = shared.groupBy("cls").agg(F.sum("members").alias("fullness"))
        leaders = shared.join(fullness, "cls").groupBy("key").agg(F.max(F.struct("fullness", "cls")).alias("m")).select("key", F.col("m.cls").alias("leader"))
        led = materialise(shared.join(leaders, "key").where("cls != leader").select("key", "cls", "leader", "members"), "led")
        facts = self.classes.select("cls", "n", *_SKETCH)
        star = led.select("cls", "leader").distinct().join(facts.alias("x"), "cls").join(facts.withColumnRenamed("cls", "leader").alias("y"), "leader")
        star = materialise(star.select("leader", "cls", F.col("x.n").alias("n"), F.col("y.n").alias("ln"), self._plausible("x", "y").alias("plausible")), "stars")
        full = self.full_sets(star.select("cls").union(star.select("leader")).distinct())
        both = self._with_sets(star, "leader", "cls", full)
        apart = F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("apart")
        around = materialise(both.select("leader", "cls", "n", "ln", "plausible", apart), "around")
        t = self.threshold
        near = around.where(f"plausible and {100 + t} * size(apart) <= {100 - t} * (n + ln)")
        label = components(near.select(F.col("leader").alias("a"), F.col("cls").alias("b")))
        return self._late(led, around, label, full, facts)

    def _named(self, rows: DataFrame, label: DataFrame) -> DataFrame:
        """rows with ``own``, the component of their class, as it is now."""
        return rows.drop("own").join(label, "cls", "left").withColumn("own", F.coalesce("comp", "cls")).drop("comp")

    def _open(self, led: DataFrame, around: DataFrame, label: DataFrame) -> DataFrame:
        """The members that may have a link which their leader has not shown, with what prefixes follow from."""
        t = self.threshold
        named = self._named(led.where("members > 2").select("key", "cls", "leader"), label)
        named = named.join(label.select(F.col("cls").alias("leader"), F.col("comp").alias("lc")), "leader", "left").withColumn("rest", F.col("own") != F.coalesce("lc", "leader"))
        named = materialise(named.select("key", "cls", "leader", "own", "rest"), "members")
        keys = named.groupBy("key").agg(F.max("rest").alias("any"), F.min("own").alias("x"), F.max("own").alias("y")).where("any and x != y").select("key")
        open_ = named.join(keys, "key", "left_semi").select("leader", "cls", "rest").distinct()
        open_ = around.join(open_, ["leader", "cls"]).withColumn("id", F.xxhash64("leader", "cls"))
        tokens = materialise(open_.select("id", "leader", F.explode("apart").alias("token")).select("id", F.xxhash64("leader", "token").alias("h")), "tokens")
        common = tokens.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
        lists = tokens.join(common, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("l"), F.sum("f").alias("weight"))
        out = open_.select("id", "cls", "rest", "n", "ln", F.size("apart").alias("s")).join(lists, "id")
        w, least = f"{100 + t} * s - {100 - t} * n", f"{100 - t} * ln"
        return materialise(out.withColumn("w", F.expr(w)).withColumn("linked", F.expr(least)).withColumn("first", F.expr("s - size(l) + 1")).drop("id", "ln"), "open")

    def _roles(self, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries of the prefixes: of the member with the smaller w by its own class, of the other by each class it may meet."""
        t = self.threshold
        two = 2 * (100 + t)
        cls_of = lambda w: f"cast(floor({FINE} * asinh(({w}) / ({FINE} * 0.5D * linked))) as int)"
        edge = f"{FINE} * 0.5D * linked * sinh(k / {FINE}.0D)"
        each = open_.select("cls", "rest", "n", "s", "w", "linked", "weight", "first", F.posexplode("l").alias("i", "e"))
        each = each.select("cls", "rest", "n", "s", "w", "linked", "weight", F.col("e.h").alias("h"), (F.col("first") + F.col("i")).alias("place"))
        less = each.where(f"place <= s + 1 - ceil((w + greatest(w, linked + 1)) / {two}.0D)").withColumn("k", F.expr(cls_of("w")))
        lowest = f"case when rest then greatest(w - {200 * (100 - t)}.0D * n / {t}, -linked) else linked + 1 end - 0.5D"
        more = each.withColumn("ks", F.expr(f"case when rest or w > linked then sequence({cls_of(lowest)}, greatest({cls_of(lowest)}, {cls_of('w')})) end"))
        more = more.withColumn("k", F.explode("ks")).where(f"place <= s + 1 - greatest(1, ceil((w + {edge}) / {two}.0D - 1e-6D))")
        return less.drop("linked"), more.drop("ks", "linked")

    def _late(self, led: DataFrame, around: DataFrame, label: DataFrame, full: DataFrame, facts: DataFrame) -> DataFrame:
        """The components once all links between members of a bucket have been found."""
        t = self.threshold
        open_ = self._open(led, around, label)
        less, more = (materialise(part, "entries") for part in self._roles(open_))
        entries = materialise(less.select("h", "cls", "weight").union(more.select("h", "cls", "weight")).distinct(), "prefixes")
        tested = None
        meet = less.groupBy("h", "k").agg(F.count("*").alias("x")).join(more.groupBy("h", "k").agg(F.count("*").alias("y")), ["h", "k"])
        crowded = (meet.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0) > CROSSINGS * entries.count()
        for number in range(ROUNDS if crowded else 0):
            named = self._named(entries, label)
            owns = named.groupBy("h", "own").agg(F.count("*").alias("c"), F.max(F.struct("weight" if not number else F.xxhash64("cls", F.lit(number)).alias("weight"), "cls")).alias("m"))
            most = owns.groupBy("h").agg(F.max(F.struct("c", "own", "m")).alias("big"), F.sum("c").alias("every")).where("every > big.c")
            most = materialise(most, "fullest")
            second = owns.join(most, "h").where("own != big.own").groupBy("h").agg(F.max(F.struct("m.weight", "m.cls", "own")).alias("m"))
            chosen = most.select("h", F.col("big.m.cls").alias("lead"), F.col("big.own").alias("lead_own")).union(second.select("h", "m.cls", "m.own"))
            pairs = named.join(chosen, "h").where("own != lead_own").select(*_ordered("cls", "lead")).distinct()
            pairs = pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs
            pairs = materialise(pairs, "second-stars")
            tested = pairs if tested is None else tested.union(pairs)
            links = self.confirmed(self._alike(pairs, facts), full)
            if not links.limit(1).count():
                break
            label = merged(label, links)
        # what the largest component of an element's members has among itself is no pair: only others meet it
        named = self._named(entries, label)
        owns = named.groupBy("h", "own").agg(F.count("*").alias("c"))
        most = owns.groupBy("h").agg(F.max(F.struct("c", "own")).alias("big"), F.sum("c").alias("every")).where("every > big.c").select("h", F.col("big.own").alias("big"))
        most = materialise(most, "fullest")
        x = self._named(more, label).join(most, "h").withColumn("side", F.explode(F.when(F.col("own") == F.col("big"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        y = self._named(less, label).join(most, "h").withColumn("side", F.col("own") == F.col("big"))
        two = 2 * (100 + t)
        met = F.expr(
            f"x.h = y.h and x.k = y.k and x.side = y.side and x.own != y.own and (x.rest or y.rest) and (x.w > y.w or x.w = y.w and x.cls > y.cls)"
            f" and 100 * least(x.n, y.n) >= {t} * greatest(x.n, y.n) and 1 + least(x.s - x.place, y.s - y.place) >= (x.w + y.w) / {two}.0D"
        )
        pairs = x.alias("x").join(y.alias("y"), met).select(*_ordered("x.cls", "y.cls")).distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs
        links = self.confirmed(self._alike(pairs, facts), full)
        return merged(label, links) if links.limit(1).count() else label

    def _alike(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Those pairs that the sketches do not rule out."""
        both = pairs.join(facts.withColumnRenamed("cls", "a").alias("x"), "a").join(facts.withColumnRenamed("cls", "b").alias("y"), "b")
        return both.where(self._plausible("x", "y")).select("a", "b")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``label`` joined where ``links`` connect them; only components are walked, not their members."""
    comp = lambda c: label.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_own"))
    own = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"))
    far = components(own.where("a != b").distinct()).select(F.col("cls").alias("old"), F.col("comp").alias("new"))
    moved = label.join(far, F.col("comp") == F.col("old"), "left").select("cls", F.coalesce("new", "comp").alias("comp"))
    fresh = far.join(label, F.col("old") == F.col("cls"), "left_anti").select(F.col("old").alias("cls"), F.col("new").alias("comp"))
    return materialise(moved.union(fresh), "labels")


def components(links: DataFrame) -> DataFrame:
    """cls, comp of every class in a link: the smallest class that it reaches.

    Each step takes the least label among the neighbours and then the label of
    the label, so the distance covered doubles.
    """
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("to")).union(links.select(F.col("b").alias("cls"), F.col("a").alias("to")))
    both = materialise(both.distinct(), "edges")
    label = materialise(both.groupBy("cls").agg(F.min("to").alias("m")).select("cls", F.least("cls", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("cls").alias("to"), "comp"), "to").groupBy("cls").agg(F.min("comp").alias("m"))
        step = label.join(near, "cls").select("cls", "comp", F.least("comp", "m").alias("new"))
        jump = label.select(F.col("cls").alias("new"), F.col("comp").alias("far"))
        done = materialise(step.join(jump, "new", "left").select("cls", "comp", F.least("new", "far").alias("new")), "labels")
        label = done.select("cls", F.col("new").alias("comp"))
        if not done.where("new != comp").limit(1).count():
            return label


def _judged(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, row (its text's hash), n_shingles, component_id, kept of every document row."""
    job = _Job(docs, shingle, threshold)
    labels = job.links()
    linked = job.classes.select("cls", "rep").join(labels, "cls")
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "comp").select("cls", "least")
    of_class = materialise(job.classes.select("cls", "rep").join(linked, "cls", "left").select("cls", F.coalesce("least", "rep").alias("component_id")), "components")
    out = job.signed.select("doc_id", "row", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "row", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def find_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document row."""
    return _judged(docs, shingle, threshold).drop("row")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each component, with its columns as they were.

    A row goes if its id and text are those of one that is not kept, so rows
    that share an id are judged apart. Kept rows with the same id and text are
    one document.
    """
    found = materialise(_judged(docs, shingle, threshold).select("doc_id", "row", "kept"), "near-duplicates")
    name, text = unused("id", docs.columns), unused("row", docs.columns)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("row").alias(text)).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(F.col(name)) & (F.xxhash64(docs["text"]) == F.col(text))
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    twice = found.where("kept").groupBy("doc_id", "row").count().where("count > 1")
    return left.dropDuplicates(["doc_id", "text"]) if twice.limit(1).count() else left
