"""Draws against hashlib, and resamples against the definition, at hand and in blocks."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashed import leading_48_bits
from plumbline.operators import inference as I


@pytest.mark.parametrize("size", [0, 1, 7, 50, 53, 54, 60, 63, 64, 121])
def test_hashes_of_many_numbers(size):
    texts = [bytes(range(32, 32 + size)), b"x" * size, b"y" * (size + 1)]
    got = leading_48_bits(texts, 8, 1203)
    for row, text in zip(got.tolist(), texts):
        assert row == [int.from_bytes(md5(text + b"%d" % k).digest()[:6], "big") for k in range(8, 1203)]


def _rows(rng):
    sizes = {"a": 90, "b": 41, "c": 1}
    return [(g, i, float(rng.integers(0, 30)), float(rng.integers(0, 9)) if g != "b" else 3.0) for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("at_hand,block,draws,meet", [(500_000, 1 << 18, 1 << 21, 256), (0, 1 << 18, 1 << 21, 256), (0, 16, 40, 7)])
def test_resamples_are_the_same_at_any_size(spark, monkeypatch, at_hand, block, draws, meet):
    """Groups with and without variance; blocks smaller than a group, parts of draws smaller than a resample."""
    for name, value in (("AT_HAND", at_hand), ("BLOCK", block), ("DRAWS", draws), ("MEET", meet)):
        monkeypatch.setattr(I, name, value)
    rows = _rows(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "group string, at long, y double, p double").repartition(3)
    found = {(r["group"], r["b"]): r for r in I.group_resamples(df, resamples=20, seed="7").collect()}
    assert len(found) == 60
    for group in "abc":
        y, p = (np.array([r[i] for r in rows if r[0] == group]) for i in (2, 3))
        for b in range(20):
            at = [int(md5(f"7|{group}|{b}|{k}".encode()).hexdigest()[:12], 16) % len(y) for k in range(len(y))]
            r, e = found[group, b], p[at] - y[at]
            flat = p[at].min() == p[at].max() or y[at].min() == y[at].max()
            assert r["PC"] == pytest.approx(0.0 if flat else np.corrcoef(p[at], y[at])[0, 1], abs=1e-9)
            assert (r["MAE"], r["RMSE"]) == pytest.approx((np.abs(e).mean(), np.sqrt((e * e).mean())))
            assert (r["p_varies"], r["y_varies"]) == (p[at].min() < p[at].max(), y[at].min() < y[at].max())


@pytest.mark.parametrize("draws", [40, 10, 5, 2])
def test_draws_are_counted_together(spark, monkeypatch, draws):
    """A resample of 90 rows in one part of several pieces, or in parts that are many or few draws for the places."""
    for name, value in (("AT_HAND", 0), ("BLOCK", 16), ("DRAWS", draws), ("MEET", 7)):
        monkeypatch.setattr(I, name, value)
    values = np.random.default_rng(6).integers(0, 9, (90, 2)).astype(float)
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values.tolist())], "at long, y double, p double")
    found = {r["b"]: r["p"] for r in I.resampled(df, ["p"], n=90, resamples=5, seed="3").collect()}
    for b in range(5):
        at = [int(md5(f"3|{b}|{k}".encode()).hexdigest()[:12], 16) % 90 for k in range(90)]
        assert found[b] == pytest.approx(np.corrcoef(values[at, 1], values[at, 0])[0, 1], abs=1e-9)


def test_counts_of_a_block_come_back():
    rng = np.random.default_rng(2)
    for at in (np.sort(rng.integers(0, 64, 64)), np.sort(rng.integers(0, 64, 3)), np.zeros(64, int)):
        dense, packed = I._packed(at, 64)
        assert I._counts(dense, packed, 64).tolist() == np.bincount(at, minlength=64).tolist()


@pytest.mark.parametrize("n,draws", [(1, 1), (600, 600), (600, 90), (1_000, 300), (129, 5_000)])
def test_unsorted_places_are_counted_by_block(n, draws):
    """Where draws are many for the places they are counted, not sorted; where one is too frequent or all are few, places are kept."""
    at = np.random.default_rng(4).integers(0, n, draws)
    found = np.zeros(-(-n // 64) * 64, int)
    for k, dense, packed in I._packed_blocks(at, n, 64):
        assert not found[64 * k : 64 * k + 64].any()
        found[64 * k : 64 * k + 64] = I._counts(dense, packed, 64)
    assert found[:n].tolist() == np.bincount(at, minlength=n).tolist() and not found[n:].any()


@pytest.mark.parametrize("n", [60_001, 300_000])
def test_a_short_last_block_is_packed_as_its_size(n):
    """Half a byte a place before compression, also where the places do not fill the last block."""
    at = np.random.default_rng(8).integers(0, n, n)
    packed = list(I._packed_blocks(at, n, 1 << 18))
    assert all(dense for _, dense, _ in packed) and sum(len(p) for *_, p in packed) < 0.26 * n
    sizes = [min(1 << 18, n - (k << 18)) for k, *_ in packed]
    assert np.concatenate([I._counts(dense, p, m) for (_, dense, p), m in zip(packed, sizes)]).tolist() == np.bincount(at, minlength=n).tolist()


def _shuffled(spark, run) -> int:
    """Bytes that the stages of a call write for others to read."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    run()
    return sum(size for stage, size in written().items() if stage not in before)


def test_what_is_shuffled_grows_as_the_rows(spark):
    """Ten times the rows, from fewer to more than were once a broadcast, are ten times the bytes."""
    value = lambda k: F.pmod(F.xxhash64("at", F.lit(k)), F.lit(50)).cast("double")
    sizes = []
    for n in (60_000, 600_000):
        df = spark.range(n).select(F.col("id").alias("at"), value(1).alias("y"), value(2).alias("a"), value(3).alias("b2"))
        sizes.append(_shuffled(spark, lambda: I.paired_bootstrap(df, n=n, resamples=12, seed="13").collect()))
    assert 0 < sizes[1] < 11 * sizes[0]


def test_a_row_without_a_value_counts_where_it_is_drawn():
    items = I._Items(np.array([[1.0, 2.0, 3.0], [1.0, np.nan, 5.0]]))
    sums = items.sums(np.array([[2, 0, 1], [1, 1, 1]]))
    assert sums[0, :8].tolist() == [3, 7, 5, 27, 11, 17, 2, 4] and np.isnan(sums[1, 1])


def test_the_gap_makes_the_draws_once(spark):
    df = spark.createDataFrame([("a", b, float(b), True) for b in range(9)] + [("b", b, 1.0, b < 8) for b in range(9)], "group string, b long, PC double, y_varies boolean")
    gap = I.subgroup_gap(df, "a", "b")
    assert "Join" not in gap._jdf.queryExecution().optimizedPlan().toString()
    assert gap.first()["lo"] == pytest.approx(-1 + 7 * 0.025)
