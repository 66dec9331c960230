"""Metric core: known answers and brute-force comparisons."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import stats
from isopleth.grid import Grid
from isopleth.operators import bootstrap, filters, regrid, skill, spectra, temporal


def test_mean_of_monthly_rmse_is_not_pooled(spark):
    rows = [(date(2000, 1, 1), 0.0), (date(2000, 1, 1), 0.0), (date(2000, 2, 1), 0.0), (date(2000, 2, 1), 4.0)]
    df = spark.createDataFrame(rows, "t date, v double").withColumn("ref", F.lit(0.0))
    months = skill.monthly_skill(df, [], "v", "ref")
    assert months.agg(F.avg("rmse")).first()[0] == pytest.approx(np.sqrt(8) / 2)


def test_harmonics_with_gaps(spark):
    rows = []
    for i in range(60):
        if (i + 1) % 7 == 0:
            continue
        t = i / 12
        y = 7 + 2 * t + 3 * np.sin(2 * np.pi * t) + 4 * np.cos(2 * np.pi * t) + 2 * np.sin(4 * np.pi * t)
        rows.append((0, date(2002 + i // 12, i % 12 + 1, 1), float(y)))
    rows += [(1, date(2002, m, 1), 1.0) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "c int, t date, v double")
    out = {r.c: r for r in temporal.harmonics(df, ["c"], "v", 24).collect()}
    assert [out[0].trend, out[0].annual, out[0].semiannual] == pytest.approx([2, 5, 2])
    assert out[1].trend is None


def test_four_trends_differ(spark):
    rows = [(0, date(2000, m, 1), v) for m, v in [(1, 0.0), (2, 1.0), (6, 2.0), (7, 3.0)]] + [(1, date(2000, 4, 1), 1.0)]
    df = spark.createDataFrame(rows, "c int, t date, v double")
    one = lambda d: {r.c: r.v for r in d.collect()}[0]
    assert one(temporal.trend_compact(df, ["v"], ["c"])) == pytest.approx(1.0)
    assert one(temporal.trend_indexed(df, ["v"], ["c"])) == pytest.approx(np.polyfit([0, 1, 3, 4], [0, 1, 2, 3], 1)[0])
    assert one(temporal.trend_calendar(df, ["v"], ["c"])) == pytest.approx(12 * np.polyfit([1, 2, 6, 7], [0, 1, 2, 3], 1)[0])


def test_paired_median_is_median_of_differences(spark):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip([0, 100, 101], [0, 1, 100]))]
    df = spark.createDataFrame(rows, "block long, a double, b double").withColumn("k", F.lit("x"))
    run = lambda: bootstrap.paired_blocks(df, ["k"], "a", "b", "block", 50, 42).first()
    first = run()
    assert first["median"] == 1.0 and first == run()


def test_replicate_medians_match_brute_force(spark):
    rng = np.random.default_rng(0)
    units = rng.integers(0, 7, 400)
    units[:150] = 3
    values = np.round(rng.standard_cauchy(400), 2)
    df = spark.createDataFrame([(int(u), float(v)) for u, v in zip(units, values)], "unit long, value double")
    idx = bootstrap.indexed_units(df, "unit")
    draws = bootstrap.multiplicities(idx, [], 25, 42)
    placed = df.join(idx, "unit").select("idx", "value")
    got = {r.replicate: r.stat for r in bootstrap.replicate_medians(placed, draws, [], bins=16).collect()}
    order = {u: i for i, u in enumerate(sorted(set(units.tolist())))}
    for b in range(25):
        sample = []
        for r in draws.where(F.col("replicate") == b).collect():
            members = values[[order[u] == r.idx for u in units.tolist()]]
            sample += list(members) * r.copies
        assert got[b] == pytest.approx(np.median(sample))


def test_one_unit_has_no_interval(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "block long, a double").withColumns({"b": F.lit(0.0), "k": F.lit(1)})
    row = bootstrap.paired_blocks(df, ["k"], "a", "b", "block", 20, 1).first()
    assert row["median"] == 2.5 and row.lower is None and row.n_blocks == 1


@pytest.mark.parametrize("bins", [2, 64, 16384])
def test_exact_quantiles_with_a_hot_group(spark, bins):
    rng = np.random.default_rng(1)
    groups = {"hot": np.round(rng.lognormal(0, 3, 3000), 1), "two": np.array([4.0, 1.0]), "one": np.array([5.0]), "flat": np.full(9, 2.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.02, "b": 1 / 3, "c": 0.5, "d": 0.975, "e": 1.0}
    for r in stats.exact_quantiles(df, ["k"], "v", probs, bins=bins).collect():
        assert [r[n] for n in probs] == pytest.approx(list(np.quantile(groups[r.k], list(probs.values()))))
    whole = stats.exact_quantiles(df, [], "v", {"m": 0.5}, bins=bins).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_ranks_ecdf_and_index_match_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(0, 2, 500), 1)
    df = spark.createDataFrame([("g", float(x)) for x in v], "k string, v double")
    ranks = {r.v: r.r for r in stats.rank_table(df, ["k"], "v", "r", bins=8).collect()}
    for x in set(v.tolist()):
        assert ranks[x] == (v < x).sum() + ((v == x).sum() + 1) / 2
    e = sorted((r.v, r.fraction) for r in stats.ecdf(df, ["k"], "v", bins=8).collect())
    assert [a for a, _ in e] == sorted(v.tolist()) and [f for _, f in e] == pytest.approx(np.arange(1, 501) / 500)
    ids = spark.createDataFrame([(int(i),) for i in [5, 900, 5, -3, 77, 10**12]], "u long")
    got = {r.u: r.idx for r in stats.dense_index(ids, "u", bins=4).collect()}
    assert got == {-3: 0, 5: 1, 77: 2, 900: 3, 10**12: 4}


def test_spearman_and_p_value(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 4.0, 3.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").withColumn("k", F.lit(1))
    row = skill.spearman_test(df, ["k"], "x", "y").first()
    assert row.rho == pytest.approx(0.8) and row.p_value == pytest.approx(0.10408803866182788, abs=1e-9)


def test_high_pass_of_a_constant_is_zero(spark):
    g = Grid(ny=20, nx=20, lat0=0.0, lon0=0.0, dlat=1.0, dlon=1.0)
    rows = [(0, iy, ix, 10.0) for iy in range(20) for ix in range(20) if ix >= 3]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, v double")
    high = [r.high for r in filters.high_pass(df, ["t"], "v", g).collect()]
    assert len(high) == 340 and max(map(abs, high)) < 1e-12


@pytest.mark.parametrize("edge", ["nearest", "reflect", "zero"])
def test_blur_matches_direct_sum(spark, edge):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(9, 8))
    g = Grid(ny=9, nx=8)
    df = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(9) for j in range(8)], "t int, iy int, ix int, v double")
    taps = filters.gaussian_taps()
    rows = filters.spread(filters.spread(df, ["t", "iy"], "ix", 8, ["v"], taps, edge), ["t", "ix"], "iy", 9, ["v"], taps, edge)
    mode = {"nearest": "edge", "reflect": "reflect", "zero": "constant"}[edge]
    padded = np.pad(a, 6, mode=mode)
    kernel = np.array([taps[abs(k)] for k in range(-6, 7)])
    want = sum(kernel[p] * kernel[q] * padded[p : p + 9, q : q + 8] for p in range(13) for q in range(13))
    for r in rows.collect():
        assert r.v == pytest.approx(want[r.iy, r.ix], abs=1e-12)


def test_sobel_matches_direct_sum(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(5, 6))
    df = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(5) for j in range(6)], "t int, iy int, ix int, v double")
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    p = np.pad(a, 1)
    for r in filters.sobel(df, ["t"], "v").collect():
        window = p[r.iy : r.iy + 3, r.ix : r.ix + 3]
        assert r.sx == pytest.approx((window * kx).sum()) and r.sy == pytest.approx((window * kx.T).sum())


def test_spectrum_matches_direct_transform(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(6, 8))
    a[2, 3] = np.nan
    rows = [("m", i, j, float(a[i, j])) for i in range(6) for j in range(8) if np.isfinite(a[i, j])] + [("few", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, iy int, ix int, v double")
    got = spectra.spectrum(df, ["k"], "v", 6, 8).collect()
    assert all(r.power is None for r in got if r.k == "few")
    good = np.isfinite(a)
    z = np.where(good, a - a[good].mean(), 0)
    total, n = np.zeros(3), np.zeros(3)
    for u in range(6):
        for v in range(8):
            fu, fv = np.fft.fftfreq(6)[u], np.fft.fftfreq(8)[v]
            wave = np.exp(-2j * np.pi * (u * np.arange(6)[:, None] / 6 + v * np.arange(8)[None, :] / 8))
            b = np.searchsorted(np.linspace(0, 0.5, 4), np.hypot(fu, fv), side="right") - 1
            if b < 3:
                total[b] += abs((z * wave).sum()) ** 2 / (48 * good.sum())
                n[b] += 1
    power = [r.power for r in sorted((r for r in got if r.k == "m"), key=lambda r: r.wavenumber)]
    assert power == pytest.approx(list(total / n))


def test_cubic_reproduces_cubics_and_needs_full_lines(spark):
    src = Grid(ny=6, nx=7, lat0=0.0, lon0=0.0, dlat=1.0, dlon=1.0)
    dst = Grid(ny=5, nx=8, lat0=-0.5, lon0=0.25, dlat=1.25, dlon=0.9)
    f = lambda y, x: x**3 - 2 * x * y + 0.5 * y**3
    df = spark.createDataFrame([(0, i, j, float(f(i, j))) for i in range(6) for j in range(7)], "t int, iy int, ix int, v double")
    out = regrid.cubic(df, ["t"], "v", src, dst).collect()
    assert len(out) == 4 * 7
    for r in out:
        assert r.v == pytest.approx(f(-0.5 + 1.25 * r.iy, 0.25 + 0.9 * r.ix))
    assert regrid.cubic(df.where("NOT (iy = 2 AND ix = 2)"), ["t"], "v", src, dst).count() == 0


def test_temporal_skill_of_identity(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(30)] + [(1, 5.0)] * 30, "c int, v double").withColumn("r", F.col("v"))
    out = {r.c: r for r in skill.temporal_skill(df, ["c"], "v", "r", 24).collect()}
    assert out[0].pcc == pytest.approx(1.0) and out[0].nse == 1.0
    assert out[1].pcc is None and out[1].nse is None
