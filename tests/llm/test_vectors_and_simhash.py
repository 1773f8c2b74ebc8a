"""Operators 11 to 13 against brute force on small tables of awkward rows."""

import random
import re
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, simhash, vectors, whitening
from plumbline.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, score long, row string, n int"


def _table(spark, rows):
    """Rows of (vec_id, embedding, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)


def _clustered(n, width, seed):
    """Random vectors around one centre a label, with ties and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, width))
    rows = [(i, np.round(centres[i % 4] + rng.normal(0, 0.7, width), 2).tolist(), i % 4) for i in range(n)]
    rows += [(n + i, rows[7 * i][1], (i + 1) % 4) for i in range(n // 10)]
    return rows


AWKWARD = [(None, [1.0] * 6, 1), (900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (902, [NAN] * 6, 0), (903, [INF] + [0.0] * 5, 0), (904, [1.0] * 6, None), (905, [1.0], 1), (906, [], 2), (950, [0.0] * 6, 3)]


def _sound(rows, width, labelled):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(c is not None and np.isfinite(c) for c in r[1]) and (not labelled or None not in (r[0], r[2]))]


def _mined(rows, scale, every):
    """Hard negatives by their definition."""
    rows = sorted({(i, label, tuple(floor(scale * c) for c in v)) for i, v, label in rows})
    out = []
    for a in (r for r in rows if r[0] % every == 0):
        score = lambda r, a=a: sum(x * y for x, y in zip(a[2], r[2]))
        ranked = sorted((r for r in rows if r != a), key=lambda r: (-score(r), r[0]))
        for p in [r for r in ranked if r[1] == a[1]][:5]:
            near = [r for r in ranked if r[1] != a[1] and 50 * score(p) <= 100 * score(r) <= 95 * score(p)]
            out += [(a[0], p[0], k + 1, r[0], score(p), score(r)) for k, r in enumerate(near[:3])]
    return sorted(out)


@pytest.mark.parametrize("cells,block", [(16, 8192), (2, 5)])
def test_hard_negatives(spark, cells, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rows = _clustered(300, 6, 1) + AWKWARD
    df = _table(spark, rows + rows[:20])  # repeated rows are one
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, cells=cells, block=block, sample=50)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == _mined(_sound(rows, 6, True), 256, 10)


def test_hard_negatives_of_few_rows(spark):
    few = [(0, [1.0, 0.0], 1), (50, [0.5, 0.5], 1), (3, [0.6, 0.1], 2), (4, [-1.0, -1.0], 2), (100, [0.0, 0.0], 5)]
    found = hard_negatives.mine(_table(spark, few), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == _mined(few, 256, 50)
    alike = [(i, [0.25, 0.25], i % 2) for i in range(40)]
    assert hard_negatives.mine(_table(spark, alike), F.col("vec_id") % 10 == 0).count() == 0  # all scores are the positive's own
    for rows in ([], [(0, None, 1)], [(0, [], 1), (50, [], 1)]):
        assert hard_negatives.mine(_table(spark, rows), F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(ValueError, match="do not fit a long"):
        hard_negatives.mine(_table(spark, [(0, [1e9, 1e9], 1), (1, [1.0, 1.0], 1)]), F.col("vec_id") == 0)


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    x, anchors = rng.integers(-300, 300, (500, 8)), rng.integers(-300, 300, (7, 8))
    cells = hard_negatives.Cells(x[:60], 8)
    cells.close(x.min(0), x.max(0))
    low, high = hard_negatives.bounded(cells.tables(anchors), cells.of(x))
    exact = anchors @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high - low) < (exact.max() - exact.min()) / 2).all()


def _whitened(x):
    """n, S and the whitening of all rows by their definition; x is a matrix of whole numbers."""
    once = np.unique(x, axis=0)
    n, total = len(once), once.sum(0)
    centred = (n * once - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - total) ** 2).sum(1), ((n * x - total) / n) @ axes / np.sqrt(np.maximum(values, 1e-300)), values


@pytest.mark.parametrize("width,components", [(6, 16), (20, 16)])
def test_whitening(spark, width, components):
    rows = _clustered(400, width, 2) + [r for r in AWKWARD if r[1] is None or len(r[1]) != 6 or width == 6]
    df = _table(spark, rows)
    found = whitening.whiten(df.select("vec_id", "embedding"), "embedding", scale=64, shift=1_000_000).collect()
    sound = _sound(rows, width, False)
    x = np.array([[floor(64 * c) + 1_000_000 for c in r[1]] for r in sound])
    n, deviation, z, values = _whitened(x)
    k = min(width, components)
    want = {(r[0], tuple(v)): (int(d), w[:k]) for r, v, d, w in zip(sound, x.tolist(), deviation, z)}
    assert len(found) == len(sound) and {r["n"] for r in found} == {n}
    by_id = defaultdict(list)
    for (i, _), v in want.items():
        by_id[i].append(v)
    sign = None
    for r in sorted(found, key=lambda r: (r["vec_id"] is None, r["vec_id"])):
        assert len(r["whitened"]) == k
        near = [(d, w) for d, w in by_id[r["vec_id"]] if d == int(r["deviation"])]
        assert near, r
        sign = np.sign(np.array(r["whitened"]) * near[0][1]) if sign is None else sign
        assert np.allclose(np.array(r["whitened"]) * sign, near[0][1], atol=1e-8)
    assert np.allclose(found[0]["explained"], (values / values.sum())[:k], rtol=1e-10)
    assert found[0]["identity_error"] < 1e-9


def test_whitening_of_degenerate_tables(spark):
    of = lambda rows: whitening.whiten(_table(spark, rows).select("vec_id", "embedding"), "embedding", scale=64)
    assert of([]).collect() == [] and of([(1, None, 0)]).collect() == []
    assert of([(i, [1.0, 2.0], 0) for i in range(9)]).collect() == []  # nothing varies
    line = of([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)]).collect()
    assert {len(r["whitened"]) for r in line} == {1} and line[0]["identity_error"] < 1e-9  # one direction varies
    # whole numbers so large that squares do not fit a long: still exact, beyond a decimal null
    rows = [(0, [0.0, 1e12], 0), (1, [2.0**40, 0.0], 0), (2, [3.0, 4.0], 0)]
    far = {r["vec_id"]: int(r["deviation"]) for r in of(rows).collect()}
    x = [[floor(64 * c) for c in v] for _, v, _ in rows]
    assert far == {i: sum((3 * v[d] - sum(r[d] for r in x)) ** 2 for d in range(2)) for i, v in enumerate(x)}
    wide = {r["vec_id"]: r["deviation"] for r in of([(i, [float(i)], 0) for i in range(40)] + [(40, [1e16], 0)]).collect()}
    assert wide[40] is None and wide[0] is not None
    with pytest.raises(Exception, match="too large for a long"):
        of([(0, [1e300], 0), (1, [1.0], 0)]).collect()


def test_moments_merge_as_if_they_were_one():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (90, 5)) + 10**9
    parts = [whitening.moments(x[a:b]) for a, b in ((0, 1), (1, 40), (40, 41), (41, 90))]
    total = None
    for p in parts:
        total = whitening.merged(total, p)
    centred = x - x.mean(0)
    assert total.n == 90 and total.sums == x.sum(0).tolist()
    assert np.allclose(total.scatter, centred.T @ centred, rtol=1e-12)


def test_query_of_whitening_has_a_row_for_each_component(spark):
    found = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001")
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    per = found.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).collect()
    assert {(r["n"], r["a"], r["b"]) for r in per} == {(16, 1, 16)}
    e = [r[1] for r in found.select("component", "explained").distinct().orderBy("component").collect()]
    assert e == sorted(e, reverse=True) and found.agg(F.max("identity_error")).first()[0] < 1e-4


rnd = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]


def _variant(text, k):
    w = text.split()
    for i in range(k):
        w[(31 * i + 7) % len(w)] = f"changed{i}"
    return " ".join(w)


BASE = " ".join(rnd.choice(WORDS) for _ in range(400))
TEXTS = [None, "", " \n\t", "a", "A", "a b c", "a b c d", "A  b\x0bc\x0cd", "é É", "x\x1cy z w", "漢字   a b c", "again " * 50, " ".join(["again"] * 50), "word " * 120_000, BASE, BASE.upper(), *[_variant(BASE, k) for k in range(1, 25)]]
TEXTS += [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(4, 30))) for _ in range(200)]
DOCS = [(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None), (None, "alone in its component for sure", None, None), (3, "a", "en", 7), (14, BASE, "en", 7)]


def _simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles] if len(words) < 50_000 else [xxhash.xxh64(shingles[0].encode(), seed=42).intdigest()]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows, radius):
    """component of every row by comparing all pairs."""
    fp = [_simhash(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[label[k]].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], f"{f:016x}", least[label[k]]) for k, (r, f) in enumerate(zip(rows, fp))), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, fp string, comp int").repartition(3)


@pytest.mark.parametrize("radius,group,most", [(4, 1 << 20, 1 << 22), (4, 1 << 12, 1 << 11), (2, 1 << 20, 1 << 5), (0, 4, 4)])
def test_simhash(spark, docs, radius, group, most):
    found = simhash.find_similar(docs, radius=radius, group=group, most=most)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == _components(DOCS, radius)


def test_simhash_of_a_crowd_and_of_nothing(spark, docs):
    assert simhash.find_similar(docs.limit(0)).collect() == []
    assert simhash.find_similar(docs.where("text is null")).collect() == [(0, "0" * 16, 0)]
    # all that differ from one in two bits, and some that are near none of them
    crowd = [0] + [(1 << i) ^ (1 << j) for i in range(24) for j in range(i)] + [(1 << 40) - 1, ((1 << 40) - 1) ^ 15, (1 << 62) - 1]
    df = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in crowd], "fp long")
    links = simhash.near_links(df, len(crowd), most=1 << 10).collect()
    label = {x: x for x in crowd}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        x, y = root(a & (1 << 64) - 1), root(b & (1 << 64) - 1)
        label[max(x, y)] = min(x, y)
    assert len({root(x) for x in crowd[:-3]}) == 1 and len({root(x) for x in crowd[-3:]}) == 2
    with pytest.raises(ValueError, match="even"):
        simhash.near_links(df, 3, radius=3)


def test_forest():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 200, (2, 120))
    label = simhash.forest(200, a, b)
    want = list(range(200))
    for x, y in zip(a, b):
        p, q = want[x], want[y]
        want = [min(p, q) if w in (p, q) else w for w in want]
    assert label.tolist() == want


def test_usable_width(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, None, 0), (4, [1.0, NAN], 0)]
    assert vectors.usable(_table(spark, rows), "embedding")[1] == 2  # as many of either: the greater
    assert vectors.usable(_table(spark, []), "embedding")[1] == 0
