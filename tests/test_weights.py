"""Known answers of the disagreement weights."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from isopleth.grid import Grid
from isopleth.operators import guards, weights


def series(spark, a, b):
    rows = [(0, date(2000, i + 1, 1), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "c int, t date, a double, b double")


@pytest.mark.parametrize(
    "a, b, alpha, d",
    [
        ([1, 3, -2], [1, 3, -2], 1.0, 0.0),
        ([-1, 1, -2, 2], [1, -1, 2, -2], 0.0, 1.0),
        ([0, 0, 0, 0], [0, 0, 0, 0], 0.0, 1.0),
    ],
)
def test_alpha(spark, a, b, alpha, d):
    row = weights.alpha_disagreement(series(spark, a, b), ["c"], "a", "b").first()
    assert row.alpha == pytest.approx(alpha) and row.disagreement == pytest.approx(d)


def test_leakage(spark):
    times = spark.createDataFrame([(date(2016, 12, 1),), (date(2017, 1, 1),)], "t date")
    row = guards.train_leakage(times, "t", "2016-12-01").first()
    assert row.after_cutoff == 1 and not row.ok
    assert guards.train_leakage(times.limit(0), "t", "2016-12-01").first().ok is False
    twice = times.where("t < '2017-01-01'").union(times.where("t < '2017-01-01'"))
    assert guards.train_leakage(twice, "t", "2016-12-01").first().duplicate_months == 1


def vectors(spark, prior, other):
    rows = [("prior", *prior), ("s", *other)]
    return spark.createDataFrame(rows, "field string, gx double, gy double").selectExpr(
        "field", "date'2000-01-01' AS t", "0 AS iy", "0 AS ix", "gx", "gy"
    )


@pytest.mark.parametrize("other, d", [((1.0, 0.0), 0.0), ((0.0, 0.0), 1.0)])
def test_gradient_disagreement(spark, other, d):
    v = vectors(spark, (1.0, 0.0), other)
    scales = spark.createDataFrame([("prior", 1.0), ("s", 1.0)], "field string, q double")
    assert weights.gradient_disagreement(v, scales, "field", "prior").first().d == pytest.approx(d)


def test_two_zero_vectors_agree(spark):
    v = vectors(spark, (0.0, 0.0), (0.0, 0.0))
    scales = spark.createDataFrame([("prior", 1.0), ("s", 1.0)], "field string, q double")
    assert weights.gradient_disagreement(v, scales, "field", "prior").first().d == 0.0


def test_equal_fields_have_no_gradient_disagreement(spark):
    field = [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 4.0)]
    rows = [(f, iy, ix, v) for f in ("prior", "s") for iy, ix, v in field]
    long = spark.createDataFrame(rows, "field string, iy int, ix int, value double").withColumn(
        "t", F.lit("2000-01-01").cast("date")
    )
    v = weights.gradient_vectors(long, "field", "value")
    d = weights.gradient_disagreement(v, weights.gradient_scales(v, "field"), "field", "prior").collect()
    assert [r.d for r in d] == [0.0]


def beta(spark, rows):
    df = spark.createDataFrame([(s, date(2000, m, 1), 0, 0, d) for s, m, d in rows], "s string, t date, iy int, ix int, d double")
    return weights.beta_from(df, ["iy", "ix"])


def test_beta_takes_source_medians_first(spark):
    row = beta(spark, [("a", 1, 0.2), ("a", 2, 0.4), ("b", 1, None), ("b", 2, 0.8), ("c", 1, 0.6), ("c", 2, None)]).first()
    assert row.disagreement == pytest.approx(0.5) and row.n_months == 2 and row.beta == pytest.approx(0.5)


def test_beta_skips_missing_months_and_needs_evidence(spark):
    row = beta(spark, [("a", 1, 0.2), ("a", 2, None), ("a", 3, 0.6)]).first()
    assert row.disagreement == pytest.approx(0.4) and row.n_months == 2
    land = spark.createDataFrame([(0, 0), (0, 1)], "iy int, ix int")
    out = {r.ix: r for r in weights.beta_on_land(beta(spark, [("a", 1, 0.2)]), land, ["iy", "ix"]).collect()}
    assert out[1].beta == 0.0 and out[1].n_months == 0 and out[0].beta == pytest.approx(0.8)


def test_unit_interval_fails_outside(spark):
    ok = spark.createDataFrame([(1.0000001,)], "x double")
    assert ok.select(weights.unit_interval(F.col("x"), "x").alias("y")).first().y == 1.0
    bad = spark.createDataFrame([(1.1,)], "x double")
    with pytest.raises(Exception, match="leaves"):
        bad.select(weights.unit_interval(F.col("x"), "x")).collect()


def test_banned_tokens_and_missing_keys(spark):
    df = spark.createDataFrame([("era5", "reanalysis"), ("x", "JPL mascon")], "a string, b string")
    assert [r[0] for r in df.select(guards.is_banned(F.col("a"), F.col("b"))).collect()] == [False, True]
    attrs = spark.createDataFrame([("alpha", "fit_n_months", "3")], "artefact string, key string, value string")
    assert guards.provenance_report(attrs, "1998-12-31").first().n_missing == 5


def test_optional_layers(spark):
    fine, coarse = Grid(4, 4, 0.0, 0.0, 1.0, 1.0), Grid(2, 2, 0.4, 0.4, 2.0, 2.0)
    rows = [(1, 0, 0, 0.5), (2, 0, 0, 0.1), (1, 0, 1, 0.4), (1, 1, 0, None), (2, 1, 1, 0.9), (1, 1, 1, 0.7)]
    layer = spark.createDataFrame(rows, "t int, iy int, ix int, v double")
    cells = spark.createDataFrame([(y, x) for y in range(4) for x in range(4)], "iy int, ix int")
    both = weights.land_mask(weights.optional_penalty(cells, layer, "v", coarse, fine, "p"), layer, "v", "t", coarse, fine)
    got = {(r.iy, r.ix): (r.p, r.land) for r in both.collect()}
    # Means .3, .4 and .8 of three cells; cells 0 and 3 lie outside the hull of 0.4 and 2.4.
    near = {(1, 1): (0.0, 1.0), (1, 2): (0.2, 0.0), (2, 1): (0.0, 0.0), (2, 2): (1.0, 1.0)}
    assert got.keys() == {(y, x) for y in range(4) for x in range(4)}
    assert all(got[k] == pytest.approx(near.get(k, (0.0, 0.0))) for k in got)
    none = weights.land_mask(weights.optional_penalty(cells, None, "v", coarse, fine, "p"), None, "v", "t", coarse, fine)
    assert {(r.p, r.land) for r in none.collect()} == {(0.0, 1.0)}
