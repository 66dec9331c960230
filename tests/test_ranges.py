"""Range-partitioned statistics, shared folders, touched cells and rows that must not be dropped."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth import session
from isopleth.functions import stats
from isopleth.grid import Grid
from isopleth.operators import objective, zonal


def mixed_scales(spark, n=4000):
    rng = np.random.default_rng(1)
    narrow = rng.normal(300, 5, n)
    wide = rng.lognormal(6, 2, n // 4)
    rows = [("a", float(v)) for v in [*narrow, -1e6, 1e6]] + [("b", float(v)) for v in [*wide, 1e5]]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_no_range_holds_more_than_its_share(spark):
    rows, df = mixed_scales(spark)
    sizes = [r["count"] for r in stats.in_ranges(df, ["k", "v"], 40).groupBy("_b").count().collect()]
    assert max(sizes) < 0.06 * len(rows)


def test_quantiles_and_ranks_at_mixed_scales(spark):
    rows, df = mixed_scales(spark)
    got = {r.k: (r.lo, r.mid) for r in stats.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}, bins=16).collect()}
    for k in "ab":
        own = [v for key, v in rows if key == k]
        assert got[k] == pytest.approx(tuple(np.quantile(own, [0.1, 0.5])), rel=1e-12)
    ranks = {r.v: r.rank for r in stats.rank_table(df.where("k = 'a'"), ["k"], "v", "rank", bins=16).collect()}
    own = sorted(v for key, v in rows if key == "a")
    assert [ranks[v] for v in own] == [i + 1.0 for i in range(len(own))]


def test_dense_index_with_a_far_id(spark):
    ids = [*range(100, 160), 10**12]
    got = {r.u: r.idx for r in stats.dense_index(spark.createDataFrame([(i,) for i in ids], "u long"), "u", bins=8).collect()}
    assert got == {u: i for i, u in enumerate(ids)}


def fake(master, warehouse, folder=None):
    conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": folder} if folder else {})
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)


def test_local_folders_are_refused_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077", "file:/tmp/warehouse"))
    assert session.shared_folder(fake("spark://host:7077", "hdfs://name/warehouse")) == "hdfs://name/warehouse/_shared"
    assert session.shared_folder(fake("spark://host:7077", "file:/w", "file:///shared/")) == "file:///shared"
    assert session.shared_folder(fake("local[4]", "file:/w")) == "file:/w/_shared"


def test_scratch_is_removed(spark):
    path = session.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    session.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_month_with_zero_gradient_stays(spark):
    rows = [(m, y, x, float(m * x), 0.0, 1.0) for m in (0, 1) for y in range(2) for x in range(2)] + [(2, 0, 0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, value double, prior double, beta double")
    got = {r.t: r.gradient for r in objective.gradient_l1(df, ["t"], "t", "value", "prior", "beta").collect()}
    assert got == {0: 0.0, 1: pytest.approx(0.5), 2: 0.0}


def test_thin_polygon_is_touched(spark):
    grid = Grid(ny=4, nx=4, lat0=0.5, lon0=0.5, dlat=1.0, dlon=1.0, factor=2)
    corners = [(0.2, 0.1), (3.9, 0.1), (3.9, 0.2), (0.2, 0.2)]
    edges = [(1, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    df = spark.createDataFrame([tuple(map(float, e[1:])) for e in edges], "x1 double, y1 double, x2 double, y2 double").withColumn("p", F.lit(1))
    assert zonal.cells_inside(df, "p", grid).count() == 0
    got = {(r.iy, r.ix) for r in zonal.cells_touched(df, "p", grid).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (0, 3)}
