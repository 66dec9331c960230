"""Readers, sinks, units, links and provenance."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from isopleth.functions import geo, time, units
from isopleth.grid import Grid
from isopleth.operators import align, guards, stations, tiles, zonal
from isopleth.sources import provenance, readers, sinks, stores


def test_alias_resolution():
    assert readers.resolve(["Lon", "lon"], ["lon"]) == "lon"
    assert readers.resolve(["Longitude"], ["lon", "longitude"]) == "Longitude"
    assert readers.resolve(["only"], ["x"], single=True) == "only"
    with pytest.raises(KeyError):
        readers.resolve(["a", "b"], ["x"])


def test_variant_columns():
    have = ["predicted_twsa", "predicted_twsa_corrected"]
    assert readers.variant_column(have, "raw") == "predicted_twsa"
    assert readers.variant_column(have, "corrected") == "predicted_twsa_corrected"
    assert readers.variant_column(have, "projected") == "predicted_twsa"
    assert readers.variant_column(have, "auto", "corrected") == "predicted_twsa_corrected"
    assert readers.variant_column(have, "auto") == "predicted_twsa"


def test_units(spark):
    df = spark.createDataFrame([("cm",), (" kg m^-2",), ("kg/m²",), ("furlong",)], "u string")
    got = [r[0] for r in df.select(units.canonical("u", strict=False)).collect()]
    assert got == ["cm", "kg_m-2", "kg_m-2", None]
    with pytest.raises(Exception, match="furlong"):
        df.select(units.canonical("u")).collect()


def test_time_and_longitude_rules(spark):
    df = spark.createDataFrame([(-185.0, "20JAN05", "xx"), (190.0, "20XXX05", "yy")], "lon double, code string, z string")
    rows = df.select(geo.wrap_longitude("lon").alias("l"), time.step_code("code").alias("d")).collect()
    assert [r.l for r in rows] == [175.0, -170.0] and [r.d for r in rows] == [date(2020, 1, 5), None]
    g = Grid()
    pts = spark.createDataFrame([(0.0,), (-95.0,), (None,)], "v double")
    assert [r[0] for r in pts.select(g.nearest_iy("v")).collect()] == [179, 0, None]


def test_month_from_name(spark):
    df = spark.createDataFrame([("a_20150401_x.h5",), ("none",)], "n string")
    assert [r[0] for r in df.select(readers.month_from_name(F.col("n"))).collect()][0] == "2015-04"


def test_links(spark):
    html = """<a HREF='/a.nc'>x</a><a href="b.NC">y</a><a href="http://h.org/c.nc">z</a><a href="/a.nc">x</a><a href="q.txt">t</a>"""
    df = spark.createDataFrame([(1, "http://e.org/d/p.html?x=1", html)], "id int, url string, html string")
    got = [r.link for r in readers.links(df, "url", "html", suffixes=[".nc"]).orderBy("pos").collect()]
    assert got == ["http://e.org/a.nc", "http://e.org/d/b.NC", "http://h.org/c.nc"]
    names = [r[0] for r in spark.createDataFrame([("http://h/x/y.nc?q",), ("http://h/",)], "u string").select(readers.file_name(F.col("u"))).collect()]
    assert names == ["y.nc", "download.bin"]


def test_features_drop_the_unparsable(spark):
    body = """{"features":[{"id":"1","properties":{"value":"3.5","time":"2020-01-02T00:00:00Z"},"geometry":{"coordinates":[1.0,2.0]}},
    {"id":"2","properties":{"value":"bad","time":"2020-01-02T00:00:00Z"},"geometry":{"coordinates":[1.0,2.0]}},
    {"id":"3","properties":{"value":"1","time":"2020-01-02T00:00:00Z"},"geometry":{"coordinates":[]}}]}"""
    rows = readers.features(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert [(r.id, r.value, r.lat) for r in rows] == [("1", 3.5, 2.0)]


def test_exact_merge_fails_on_a_gap(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(1, 1.0)], "k int, b double")
    with pytest.raises(Exception, match="coordinates differ"):
        readers.merge_exact([(a, "a"), (b, "b")], ["k"]).collect()


def test_sink_keeps_what_exists(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.write_table(spark.range(3), path)
    assert not sinks.write_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_table(spark.range(9), path, overwrite=True)
    assert spark.read.parquet(path).count() == 9
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_table(spark.range(3), path)
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    for write in (sinks.write_table, sinks.write_report):
        with pytest.raises(Exception, match="stop"):
            write(broken, path, overwrite=True)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
        assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="stop"):
        sinks.write_table(broken, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_a_folder_without_marker_is_rewritten(spark, tmp_path):
    path = tmp_path / "out"
    spark.range(3).write.parquet(str(path))
    (path / sinks.MARKER).unlink()
    assert not sinks.exists(spark, str(path))
    assert sinks.write_table(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5


def test_a_table_may_replace_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_table(spark.range(6).withColumn("p", F.col("id") % 2), path, ["p"])
    sinks.write_table(spark.read.parquet(path).where("id > 2"), path, ["p"], overwrite=True)
    assert sorted((r.id, r.p) for r in spark.read.parquet(path).collect()) == [(3, 1), (4, 0), (5, 1)]


def _tree(root):
    """A few files in nested folders, of which one name sorts between a folder and its files."""
    for name, size in (("a/b/x y.bin", 5), ("a/c.bin", 0), ("a.bin", 3_000_000), ("a/b.bin", 7), ("z/1.bin", 11), ("é.bin", 2), (".hidden", 3)):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(i * 31 % 251 for i in range(size)))
    return sorted(p for p in root.rglob("*") if p.is_file())


@pytest.mark.parametrize("chunk", [1 << 20, 4096])
def test_manifest_hashes_files_of_any_size(spark, tmp_path, chunk):
    files = _tree(tmp_path)
    got = {(r.path, r.bytes, r.sha256) for r in provenance.file_manifest(spark, str(tmp_path), chunk=chunk).collect()}
    assert got == {(str(p.relative_to(tmp_path)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files}


def test_folder_digest_follows_the_paths(spark, tmp_path):
    want = hashlib.sha256()
    for p in _tree(tmp_path):
        want.update(str(p.relative_to(tmp_path)).encode() + str(p.stat().st_size).encode())
    files = stores.listed(spark, str(tmp_path)).select(stores.below(spark, str(tmp_path)).alias("path"), "bytes")
    assert tuple(provenance.folder_digest(files).first()) == (want.hexdigest(), 7)
    assert tuple(provenance.folder_digest(files.limit(0)).first()) == (hashlib.sha256().hexdigest(), 0)


def test_every_file_is_accounted_for(spark, tmp_path):
    good, root = tmp_path / "d" / "good.parquet", tmp_path / "d"
    spark.range(40).withColumnRenamed("id", "k").coalesce(1).write.parquet(str(tmp_path / "made"))
    root.mkdir()
    good.write_bytes(next((tmp_path / "made").glob("part-*")).read_bytes())
    (root / "cut off.parquet").write_bytes(good.read_bytes()[:-20])
    (root / "text.parquet").write_text("no columns here")
    (root / "nothing.parquet").write_bytes(b"")
    body = bytearray(good.read_bytes())
    body[10:200] = bytes(190)
    (root / "damaged.parquet").write_bytes(bytes(body))
    spark.range(0).withColumnRenamed("id", "k").coalesce(1).write.parquet(str(tmp_path / "none"))
    (root / "empty.parquet").write_bytes(next((tmp_path / "none").glob("part-*")).read_bytes())
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "other"))
    (root / "other.parquet").write_bytes(next((tmp_path / "other").glob("part-*")).read_bytes())
    got = {r.name: (r.status, r.n_rows, bool(r.reason)) for r in readers.file_report(spark, str(root), "parquet", ["k"]).collect()}
    skipped = ("skipped", None, True)
    assert got == {
        "good.parquet": ("read", 40, False),
        "empty.parquet": ("read", 0, False),
        **{n: skipped for n in ("cut off.parquet", "text.parquet", "nothing.parquet", "damaged.parquet", "other.parquet")},
    }


def test_inventory_and_equality(spark, small):
    manifest = provenance.file_manifest(spark, small, "*.parquet")
    assert manifest.count() == 14
    assert provenance.inventory_faults(manifest, manifest.where("path <> 'part.parquet'")).first().fault == "missing"
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    row = provenance.tables_equal(a, a.withColumn("v", F.lit(1.0)), ["k"], ["v"], 0.0, 1e-9).first()
    assert (row.matched, row.differing) == (2, 1)
    added = provenance.upsert(a, spark.createDataFrame([(2, 5.0, "n")], "k int, v double, note string"), "k").orderBy("k").collect()
    assert [(r.k, r.v, r.note) for r in added] == [(1, 1.0, None), (2, 5.0, "n")]


def test_axes_equal_within_a_tolerance(spark):
    left = spark.createDataFrame([(0.0, 1.0), (15.0, 2.0), (30.0, 2.0), (None, 2.0)], "lat double, lon double")
    right = spark.createDataFrame([(5e-9, 1.0), (15.0 - 9e-9, 2.0 + 5e-8), (30.0 + 2e-8, 2.0)], "lat double, lon double")
    got = {r.axis: (r.common, r.only_left, r.only_right) for r in guards.axis_mismatch(left, right, ["lat", "lon"]).collect()}
    assert got == {"lat": (2, 1, 1), "lon": (2, 0, 1)}
    with pytest.raises(Exception, match="differ along lat"):
        guards.require_same_grid(left, right, ["lat"]).collect()
    assert guards.require_same_grid(left, left, ["lat", "lon"]).count() == 2
    assert guards.axis_mismatch(left, right.limit(0), ["lat"]).first().only_left == 3


def test_zone_raster(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 1, 5), (0, 2, 5), (0, 2, 6), (1, 1, None), (1, 2, None), (1, 2, 7)], "y int, x int, z int")
    assert tuple(guards.raster_faults(rows, ["y", "x"], "z").first()) == (4, 1, 1)


def test_month_lookup_policy(spark):
    wanted = spark.createDataFrame([(date(2020, 1, 1),), (date(2020, 2, 1),)], "month date")
    released = spark.createDataFrame([(date(2020, 1, 1), 1, 5.0), (date(2020, 1, 1), 2, 6.0)], "month date, o int, v double")
    assert [r.v for r in align.month_lookup(wanted, released, "o").collect()] == [6.0]
    with pytest.raises(Exception, match="2020-02-01"):
        align.month_lookup(wanted, released, "o", "error").collect()
    assert sorted((r.month.month, r.v) for r in align.month_lookup(wanted, released, "o", "keep").collect()) == [(1, 6.0), (2, None)]
    assert [r.month for r in align.months_without_release(wanted, released).collect()] == [date(2020, 2, 1)]
    with pytest.raises(ValueError, match="policy"):
        align.month_lookup(wanted, released, "o", "skip")


def test_tiles_and_attribute_choice():
    assert tiles.tile_starts(12, 6, 4) == [0, 4, 6] and tiles.tile_starts(12, 6, 6) == [0, 6]
    assert zonal.basin_attribute(["PFAF_ID", "HYBAS_ID"], 1) == "PFAF_ID"
    assert zonal.basin_attribute(["PFAF_ID", "HYBAS_ID"], 2) == "HYBAS_ID"


def test_polygon_with_hole_and_corner(spark):
    g = Grid(ny=6, nx=6, lat0=0.5, lon0=0.5, dlat=1.0, dlon=1.0)
    outer = [(0, 0, 6, 0), (6, 0, 6, 6), (6, 6, 0, 6), (0, 6, 0, 0)]
    hole = [(2, 2, 4, 2), (4, 2, 4, 4), (4, 4, 2, 4), (2, 4, 2, 2)]
    edges = spark.createDataFrame([(1, *map(float, e)) for e in outer + hole], "p int, x1 double, y1 double, x2 double, y2 double")
    inside = {(r.iy, r.ix) for r in zonal.cells_inside(edges, "p", g).collect()}
    assert inside == {(y, x) for y in range(6) for x in range(6)} - {(2, 2), (2, 3), (3, 2), (3, 3)}


def test_half_day_mean_and_first_record(spark):
    df = spark.createDataFrame([(0.4, 0, 0.2, 0), (0.4, 1, 0.2, 0), (1.4, 0, 0.2, 3)], "a double, f int, p double, g int")
    got = [r[0] for r in df.select(stations.half_day_mean("a", "f", "p", "g")).collect()]
    assert got[0] == pytest.approx(0.3) and got[1:] == [0.2, None]
    dup = spark.createDataFrame([("x", 2, "b"), ("x", 1, "z")], "id string, o int, v string")
    assert stations.first_record(dup, "id", ["o"]).first().v == "z"
