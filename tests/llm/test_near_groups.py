"""Near-duplicates in crowded buckets: components against brute force, and how many rows are made on the way."""

import random

import pytest

from plumbline.llm import near_duplicates


def _shingles(text, width):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(texts, width, t):
    sets = [_shingles(x, width) for x in texts]
    comp = list(range(len(texts)))

    def top(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            c = len(x & sets[j])
            if 100 * c >= t * (len(x) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    return [top(i) for i in range(len(texts))]


def words(rnd, n):
    return ["".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(n)]


def edited(rnd, base, k, pool=None):
    out = list(base)
    for i in rnd.sample(range(len(base)), k):
        out[i] = rnd.choice(pool) if pool else words(rnd, 1)[0]
    return out


def found(spark, texts, width, t):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = near_duplicates.find_near_duplicates(docs, shingle=width, threshold=t / 100).collect()
    return [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in rows)]


@pytest.mark.parametrize("seed,width,t,crossings", [(1, 3, 85, 4), (2, 3, 85, 0), (3, 5, 80, 4)])
def test_crowds(spark, monkeypatch, seed, width, t, crossings):
    """Clusters around a shared passage, texts just short of linked, chains, and edits from a small pool."""
    monkeypatch.setattr(near_duplicates, "CROSSINGS", crossings)
    rnd = random.Random(seed)
    passage, pool = words(rnd, 70), words(rnd, 5)
    texts = []
    for size, tail in ((60, 14), (40, 18), (30, 22), (25, 9)):
        base = passage + words(rnd, tail)
        texts += [edited(rnd, base, rnd.randrange(3)) for _ in range(size)]
        texts += [edited(rnd, base, rnd.randrange(1, 5), pool) for _ in range(size)]
    texts += [edited(rnd, passage, 2 + k % 3, pool) for k in range(120)]
    texts += [passage[: 70 - k] for k in range(0, 50, 2)]
    step = list(passage)
    for _ in range(40):
        step = edited(rnd, step, 1)
        texts.append(step)
    texts = [" ".join(x) for x in texts]
    rnd.shuffle(texts)
    assert found(spark, texts, width, t) == brute(texts, width, t)


def test_large_clusters_make_linear_rows(spark, monkeypatch):
    """Two near-copy clusters of 2,000 and a crowd without a centre in the same buckets: a few rows for each member."""
    rnd = random.Random(7)
    passage = words(rnd, 80)
    a, b = passage + words(rnd, 20), passage + words(rnd, 20)
    texts = [" ".join(edited(rnd, x, 1)) for x in (a, b) for _ in range(2_000)]
    texts += [" ".join(edited(rnd, a, 2)) for _ in range(500)]
    texts += [" ".join(edited(rnd, passage, 4)) for _ in range(500)]
    made, plain = {}, near_duplicates.materialise

    def counted(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_duplicates, "materialise", counted)
    comp = found(spark, texts, 3, 85)
    assert len(set(comp[:2_000])) == 1 and len(set(comp[2_000:4_000])) == 1 and comp[0] != comp[2_000]
    n = len(texts)
    assert made["stars"] <= 32 * n and made["prefixes"] <= 16 * made["stars"] and made["second-stars"] <= 2 * made["prefixes"] and made["proposed"] <= 4 * n, made


def test_drop_keeps_rows_that_share_an_id(spark):
    """Ids that repeat with other texts are judged apart, null ids too, and clashing column names stay."""
    a, b = " ".join(words(random.Random(1), 30)), " ".join(words(random.Random(2), 30))
    rows = [(1, a, 1, 2), (2, a, 1, 2), (2, b, 3, 4), (None, a, 5, 6), (None, "something else", 7, 8), (9, b + " end", 0, 0), (9, b + " end", 0, 0), (4, None, 0, 0), (4, None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, row long")
    left = near_duplicates.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(1, a, 1, 2), (2, b, 3, 4), (None, "something else", 7, 8), (4, None, 0, 0)]))
    assert near_duplicates.drop_near_duplicates(docs.limit(0)).count() == 0
