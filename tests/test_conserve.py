"""Area means and projections."""

import math

import pytest
from pyspark.sql import functions as F

from isopleth.functions.geo import area_weight
from isopleth.grid import Grid
from isopleth.operators import conserve

G = Grid(ny=4, nx=4, lat0=-75.0, lon0=0.0, dlat=50.0, dlon=1.0, factor=2)


def field(spark):
    rows = [(iy, ix, float(3 * iy - ix * ix + 0.5), (iy, ix) not in {(0, 1), (3, 3)}) for iy in range(4) for ix in range(4)]
    return spark.createDataFrame(rows, "iy int, ix int, v double, valid boolean").withColumns(
        {"t": F.lit("2000-01-01").cast("date"), "w": area_weight(G.lat())}
    )


def test_block_projection_closes_and_keeps_masked_cells(spark):
    target = spark.createDataFrame([(0, 0, 10.0), (0, 1, -2.0), (1, 0, 4.0), (1, 1, 12.0)], "cy int, cx int, target double").withColumn(
        "t", F.lit("2000-01-01").cast("date")
    )
    out = conserve.project_blocks(field(spark), ["t"], "v", target, "target", G, "w", "valid").collect()
    assert max(r.error_after for r in out) <= 1e-10 and max(r.error_before for r in out) > 1
    assert all(r.projected == r.v for r in out if not r.valid)
    sums = {}
    for r in out:
        if r.valid:
            s = sums.setdefault((r.cy, r.cx), [0.0, 0.0])
            s[0] += r.projected * r.w
            s[1] += r.w
    want = {(0, 0): 10.0, (0, 1): -2.0, (1, 0): 4.0, (1, 1): 12.0}
    assert {k: pytest.approx(a / b, abs=1e-10) for k, (a, b) in sums.items()} == want


def test_zone_projection_and_decomposition_close(spark):
    df = field(spark).withColumn("zone", F.when(F.col("ix") < 3, 1).otherwise(2))
    target = spark.createDataFrame([(1, 7.0), (2, -3.0)], "zone int, target double").withColumn("t", F.lit("2000-01-01").cast("date"))
    out = conserve.project_zones(df, ["t"], "v", target, "target", "zone", "w", "valid")
    means = conserve.zone_mean(out, ["t"], "zone", ["projected"], "w", "valid").orderBy("zone").collect()
    assert [m.projected for m in means] == pytest.approx([7.0, -3.0], abs=1e-10)
    cells, zones = conserve.decompose(df, ["t"], "v", target, "target", "zone", "w", "valid")
    assert zones.agg(F.max("closure")).first()[0] < 1e-10
    assert {r.detail for r in cells.where("NOT valid").collect()} == {0.0}


def test_latitude_weights_fall_toward_the_poles(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (80.0,)], "lat double")
    w = [r[0] for r in df.select(area_weight("lat")).collect()]
    assert w[0] == 1.0 and w[0] > w[1] > w[2]


def test_area_mean(spark):
    g = Grid(ny=2, nx=2, lat0=0.0, lon0=0.0, dlat=60.0, dlon=1.0, factor=2)
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "iy int, ix int, v double").withColumns(
        {"t": F.lit(1), "w": area_weight(g.lat())}
    )
    assert conserve.block_mean(df, ["t"], ["v"], g, "w").first().v == pytest.approx(10 / 3)


def test_empty_block_rules(spark):
    df = field(spark).withColumn("v", F.when(F.col("iy") > 1, F.col("v")))
    first = lambda **k: conserve.block_mean(df, ["t"], ["v"], G, "w", "valid", **k).where("cy = 0 AND cx = 0").first()
    assert first().v is None
    assert first(empty="zero", eps=1e-12).v == 0.0
    flagged = first(empty="flag")
    assert flagged.v == 0.0 and flagged.v_valid is False


def test_blend_is_capped(spark):
    df = field(spark).withColumn("target", F.col("v") + 100.0)
    out = conserve.blend_correct(df, ["t"], "v", "target", G, blend=0.05, cap=1.0).collect()
    assert all(math.isclose(r.corrected - r.v, 0.05) for r in out)
