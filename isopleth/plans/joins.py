"""Alignment, regridding, neighbours, pairs and polygons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from isopleth.functions import time
from isopleth.operators import align, conserve, neighbours, regrid, zonal
from isopleth.plans.fixtures import GRID, Fixtures
from isopleth.plans.registry import query
from isopleth.plans.skill import MONTHLY, PIXEL_SQL, _pixels, monthly_spatial
from isopleth.plans.time_series import BETA_SQL, COVER, _disagreements
from isopleth.session import pinned
from isopleth.sources import readers


@query(
    "join_align_inner",
    "t:d iy:i ix:i obs:f s3:f",
    "SELECT t, iy, ix, obs, s3 FROM fx_field WHERE obs IS NOT NULL AND s3 IS NOT NULL",
)
def align_inner(fx: Fixtures):
    return align.align_inner(fx.field_long, ["obs", "s3"], ["t", "iy", "ix"])


@query(
    "join_reindex_left",
    "t:d iy:i ix:i s3:f",
    """SELECT m.t, c.iy, c.ix, f.s3 FROM (SELECT DISTINCT iy, ix FROM fx_field WHERE s3 IS NOT NULL) c CROSS JOIN (SELECT t FROM fx_split WHERE split=0) m
 LEFT JOIN fx_field f ON f.t=m.t AND f.iy=c.iy AND f.ix=c.ix""",
)
def reindex_left(fx: Fixtures):
    source = fx.field.where("s3 IS NOT NULL").select("t", "iy", "ix", "s3")
    return align.reindex_months(source, fx.split.where("split = 0"), ["iy", "ix"])


@query(
    "join_month_policy",
    "policy:s month:d ts:d price:f",
    """WITH r AS (SELECT date_trunc('month', o_orderdate) AS month, arg_max(CAST(o_orderdate AS DATE), ROW(o_orderdate, o_totalprice)) AS ts,
 arg_max(o_totalprice, ROW(o_orderdate, o_totalprice)) AS price FROM orders GROUP BY 1),
w AS (SELECT DISTINCT t AS month FROM fx_lines UNION SELECT DISTINCT t + INTERVAL 11 YEAR FROM fx_lines)
--
SELECT 'drop' AS policy, r.* FROM r SEMI JOIN w ON w.month=r.month UNION ALL SELECT 'keep', w.month, r.ts, r.price FROM w LEFT JOIN r ON w.month=r.month
 UNION ALL SELECT 'error', r.* FROM r SEMI JOIN (SELECT t FROM fx_lines) l ON l.t=r.month
 UNION ALL SELECT 'missing', w.month, NULL, NULL FROM w ANTI JOIN r ON w.month=r.month""",
)
def month_policy(fx: Fixtures):
    """Every policy over the months of the cube and the same eleven years on; ``error`` where it cannot fail.

    The months that no release covers are a list of their own.
    """
    released = fx.table("orders").select(
        time.month_start("o_orderdate").alias("month"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
    )
    own = fx.split.select(F.col("t").alias("month"))
    wanted = own.unionByName(own.select(F.add_months("month", 132).alias("month"))).distinct()
    covered = own.join(released.select("month").distinct(), "month", "left_semi")
    looked_up = [
        align.month_lookup(months, released, "ts", policy).withColumn("policy", F.lit(policy))
        for policy, months in (("drop", wanted), ("keep", wanted), ("error", covered))
    ]
    missing = align.months_without_release(wanted, released).withColumn("policy", F.lit("missing"))
    return readers.union_files([*looked_up, missing])


@query(
    "join_static_broadcast",
    "t:d iy:i ix:i obs:f glacier:f human:f aridity:f zone_id:i",
    "SELECT t, iy, ix, obs, glacier, human, aridity, zone_id FROM fx_field JOIN fx_cells USING (iy, ix)",
)
def static_broadcast(fx: Fixtures):
    return fx.grid.attach(fx.field, fx.cells)


@query(
    "join_coarse_to_fine",
    "t:d iy:i ix:i obs:f",
    """SELECT f.t, f.iy, f.ix, c.obs FROM fx_field f JOIN (SELECT t, cy, cx, obs FROM fx_coarse) c ON c.t=f.t AND c.cy=f.iy//3 AND c.cx=f.ix//3""",
)
def coarse_to_fine(fx: Fixtures):
    return conserve.coarse_to_fine(fx.field.select("t", "iy", "ix"), fx.coarse.drop("prior"), ["t"], fx.grid)


@query(
    "join_zone_broadcast",
    "t:d iy:i ix:i obs:f",
    """WITH z AS (SELECT t, zone_id, sum(obs*w)/sum(w) AS o FROM fx_valid WHERE valid GROUP BY t, zone_id)
--
SELECT v.t, iy, ix, coalesce(o,-999) AS obs FROM fx_valid v LEFT JOIN z USING (t, zone_id)""",
)
def zone_broadcast(fx: Fixtures):
    zones = conserve.zone_mean(fx.valid, ["t"], "zone_id", ["obs"], "w", "valid")
    cells = fx.valid.select("t", "iy", "ix", "zone_id")
    return conserve.zone_to_cells(cells, zones, ["t"], "zone_id", "obs", fill=-999.0)


@query(
    "join_nearest_point",
    "site:s t:d prior:f obs:f s1:f",
    """WITH s AS (SELECT DISTINCT site, greatest(0,least(11,CAST(ceil((lat+82.5e0)/15-0.5e0) AS INT))) AS iy,
 greatest(0,least(23,CAST(ceil((lon+172.5e0)/15-0.5e0) AS INT))) AS ix FROM fx_station_raw)
--
SELECT site, t, prior, obs, s1 FROM s JOIN fx_field USING (iy, ix)""",
)
def nearest_point(fx: Fixtures):
    sites = fx.station_raw.select("site", "lat", "lon").distinct()
    return align.nearest_series(sites, fx.field, fx.grid)


def _target(fx: Fixtures):
    return TARGET


TARGET = replace(GRID, ny=10, nx=18, lat0=-90.0, lon0=-170.0, dlat=20.0, dlon=20.0)
TARGET_SQL = """tg AS (SELECT ty, tx, (-90e0+20*ty+82.5e0)/15 AS fy, (-170e0+20*tx+172.5e0)/15 AS fx FROM (SELECT unnest(range(0,10)) AS ty)
 CROSS JOIN (SELECT unnest(range(0,18)) AS tx)), ti AS (SELECT * FROM tg WHERE fy BETWEEN 0 AND 11 AND fx BETWEEN 0 AND 23)"""


@query(
    "regrid_nearest",
    "t:d iy:i ix:i obs:f prior:f",
    f"""WITH {TARGET_SQL}
--
SELECT f.t, ty AS iy, tx AS ix, obs, prior FROM ti JOIN fx_field f ON f.iy=CAST(ceil(fy-.5) AS INT) AND f.ix=CAST(ceil(fx-.5) AS INT)""",
)
def regrid_nearest(fx: Fixtures):
    return regrid.nearest(fx.field, ["t"], ["obs", "prior"], fx.grid, _target(fx))


@query(
    "regrid_bilinear",
    "t:d iy:i ix:i obs:f",
    f"""WITH {TARGET_SQL},
c AS (SELECT ty, tx, least(floor(fy),10) AS y0, least(floor(fx),22) AS x0, fy-least(floor(fy),10) AS ry, fx-least(floor(fx),22) AS rx FROM ti)
--
SELECT a.t, ty AS iy, tx AS ix, a.obs*(1-ry)*(1-rx)+b.obs*(1-ry)*rx+d.obs*ry*(1-rx)+e.obs*ry*rx AS obs FROM c
 JOIN fx_field a ON a.iy=y0 AND a.ix=x0 JOIN fx_field b ON b.t=a.t AND b.iy=y0 AND b.ix=x0+1
 JOIN fx_field d ON d.t=a.t AND d.iy=y0+1 AND d.ix=x0 JOIN fx_field e ON e.t=a.t AND e.iy=y0+1 AND e.ix=x0+1""",
)
def regrid_bilinear(fx: Fixtures):
    return regrid.bilinear(fx.field, ["t"], "obs", fx.grid, _target(fx))


def _spline_sql() -> str:
    """The rule's weights as tables: sy (ty, y, w) and sx (tx, x, w)."""
    items = []
    for name, (matrix, inside) in zip(("y", "x"), regrid.spline_weights(GRID, TARGET)):
        rows = ", ".join(f"({int(t)},{i},{float(w)!r}e0)" if "e" not in repr(float(w)) else f"({int(t)},{i},{float(w)!r})" for t, line in zip(inside, matrix) for i, w in enumerate(line))
        items.append(f"s{name}(t{name}, {name}, w) AS (VALUES {rows})")
    return ",\n".join(items)


@query(
    "regrid_cubic",
    "month:i iy:i ix:i obs:f",
    f"""WITH {_spline_sql()},
cm AS (SELECT month(t) AS month, iy, ix, avg(obs) AS v FROM fx_field GROUP BY ALL),
cx AS (SELECT month, iy, tx, sum(v*w) AS v FROM cm JOIN sx ON x=ix GROUP BY month, iy, tx HAVING count(v)=24)
--
SELECT month, ty AS iy, tx AS ix, sum(v*w) AS obs FROM cx JOIN sy ON y=iy GROUP BY month, ty, tx HAVING count(v)=12""",
)
def regrid_cubic(fx: Fixtures):
    """The calendar-month means have no gaps, which the spline needs."""
    means = fx.field.groupBy(F.month("t").alias("month"), "iy", "ix").agg(F.avg("obs").alias("obs"))
    return regrid.cubic(means, ["month"], "obs", fx.grid, _target(fx))


@query(
    "join_neighbour_diff",
    "t:d iy:i ix:i obs_dx:f obs_dy:f vector_valid:b",
    """WITH v AS (SELECT t, iy, ix, obs FROM fx_valid WHERE valid)
--
SELECT a.t, a.iy, a.ix, x.obs-a.obs AS obs_dx, y.obs-a.obs AS obs_dy, x.obs IS NOT NULL AND y.obs IS NOT NULL AS vector_valid FROM v a
 LEFT JOIN v x ON x.t=a.t AND x.iy=a.iy AND x.ix=a.ix+1 LEFT JOIN v y ON y.t=a.t AND y.iy=a.iy+1 AND y.ix=a.ix""",
)
def neighbour_diff(fx: Fixtures):
    out = neighbours.forward_difference(fx.valid, ["t"], ["obs"], F.col("valid"))
    return out.withColumn("vector_valid", F.col("obs_dx").isNotNull() & F.col("obs_dy").isNotNull())


@query(
    "join_block_pairs",
    "block:i iy_i:i ix_i:i iy_j:i ix_j:i",
    """WITH c AS (SELECT iy, ix, cy*8+cx AS block FROM fx_cells WHERE land)
--
SELECT a.block, a.iy AS iy_i, a.ix AS ix_i, b.iy AS iy_j, b.ix AS ix_j FROM c a JOIN c b ON a.block=b.block AND (a.iy<b.iy OR (a.iy=b.iy AND a.ix<b.ix))""",
)
def block_pairs(fx: Fixtures):
    cells = fx.cells.where("land").select("iy", "ix", fx.grid.block_id().alias("block"))
    return align.block_pairs(cells, "block")


INSIDE_SQL = """cand AS (SELECT poly_id, iy, ix FROM fx_polygon_edges, fx_cells WHERE ((y1<=lat AND lat<y2) OR (y2<=lat AND lat<y1))
 AND x1+(lat-y1)/(y2-y1)*(x2-x1) > lon GROUP BY poly_id, iy, ix HAVING count(*)%2=1)"""


def _touched_sql(step: float) -> str:
    """Every cell against every edge: the part of the edge in the cell's row, and whether its columns hold the cell."""
    ny, nx = int(180 / step), int(360 / step)
    return f"""cells AS (SELECT i, j, -90e0+{step}e0*i AS y, -90e0+{step}e0*(i+1) AS yy, -180e0+{step}e0*j AS x, -180e0+{step}e0*(j+1) AS xx,
 -90e0+{step}e0*(i+.5e0) AS lat, -180e0+{step}e0*(j+.5e0) AS lon FROM (SELECT unnest(range(0,{ny})) AS i) CROSS JOIN (SELECT unnest(range(0,{nx})) AS j)),
parts AS (SELECT poly_id, i, j, x, xx, CASE WHEN y1=y2 THEN x1 ELSE x1+(greatest(least(y1,y2),y)-y1)/(y2-y1)*(x2-x1) END AS a,
 CASE WHEN y1=y2 THEN x2 ELSE x1+(least(greatest(y1,y2),yy)-y1)/(y2-y1)*(x2-x1) END AS b
 FROM fx_polygon_edges, cells WHERE least(y1,y2)<yy AND greatest(y1,y2)>=y),
touched AS (SELECT DISTINCT poly_id, i, j FROM parts WHERE least(a,b)<xx AND greatest(a,b)>=x UNION
 SELECT poly_id, i, j FROM fx_polygon_edges, cells WHERE ((y1<=lat AND lat<y2) OR (y2<=lat AND lat<y1)) AND x1+(lat-y1)/(y2-y1)*(x2-x1) > lon
 GROUP BY poly_id, i, j HAVING count(*)%2=1)"""


def _inside(fx: Fixtures):
    return zonal.cells_inside(fx.polygon_edges, "poly_id", fx.grid)


@query(
    "zonal_point_in_polygon",
    "poly_id:i iy:i ix:i",
    f"WITH {INSIDE_SQL}\n--\nSELECT poly_id, iy, ix FROM cand JOIN fx_cells USING (iy, ix) WHERE land",
)
def point_in_polygon(fx: Fixtures):
    return fx.grid.attach(_inside(fx), fx.cells.where("land").select("iy", "ix"))


@query(
    "zonal_fraction",
    "iy:i ix:i fraction:f",
    f"""WITH {_touched_sql(3.75)}
--
SELECT i//4 AS iy, j//4 AS ix, count(*)/16 AS fraction FROM (SELECT DISTINCT i, j FROM touched) GROUP BY ALL""",
)
def fraction(fx: Fixtures):
    return zonal.cover_fraction(fx.polygon_edges, "poly_id", fx.grid, 4)


@query(
    "zonal_burn_attribute",
    "iy:i ix:i hybas_id:i",
    f"WITH {_touched_sql(15.0)}\n--\nSELECT i AS iy, j AS ix, arg_max(hybas_id, seq) AS hybas_id FROM touched JOIN fx_polygons USING (poly_id) WHERE hybas_id>0 GROUP BY i, j",
)
def burn_attribute(fx: Fixtures):
    name = zonal.basin_attribute([c.upper() for c in fx.polygons.columns], 2).lower()
    return zonal.burn(zonal.cells_touched(fx.polygon_edges, "poly_id", fx.grid), fx.polygons, "poly_id", "seq", name)


# Longitude and latitude of the outlets of six named basins.
OUTLETS = {
    "Amazon": (-52.0, -1.5),
    "Mississippi": (-91.0, 30.5),
    "Ganges-Brahmaputra": (90.5, 23.5),
    "Yangtze": (121.0, 31.0),
    "Nile": (31.25, 30.5),
    "Murray-Darling": (139.35, -35.55),
}
OUTLET_SQL = f"""o(outlet, px, py) AS (VALUES {", ".join(f"('{k}',{x}e0,{y}e0)" for k, (x, y) in OUTLETS.items())}),
sg AS (SELECT outlet, poly_id, px, py, x1, y1, x2, y2, greatest(0,least(1,((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)**2+(y2-y1)**2))) AS k
 FROM fx_polygon_edges, o),
di AS (SELECT outlet, poly_id, min(sqrt((x1+k*(x2-x1)-px)**2+(y1+k*(y2-y1)-py)**2)) AS d, count(*) FILTER (((y1<=py AND py<y2) OR (y2<=py AND py<y1))
 AND x1+(py-y1)/(y2-y1)*(x2-x1)>px)%2=1 AS inside FROM sg GROUP BY outlet, poly_id),
dd AS (SELECT outlet, poly_id, main_id, up_area, CASE WHEN inside THEN 0 ELSE d END AS distance FROM di JOIN fx_polygons USING (poly_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY distance>2, CASE WHEN distance<=2 THEN -up_area ELSE distance END, poly_id) AS rn FROM dd),
chosen AS (SELECT outlet, poly_id, main_id, distance, CASE WHEN distance<=2 THEN 'largest_within_reach' ELSE 'nearest' END AS method FROM rk WHERE rn=1)"""


def _chosen(fx: Fixtures):
    return zonal.outlet_basin(fx.polygon_edges, fx.polygons, "poly_id", OUTLETS, "up_area", "main_id")


@query(
    "zonal_outlet_basin",
    "outlet:s poly_id:i main_id:i distance:f method:s",
    f"WITH {OUTLET_SQL}\n--\nSELECT * FROM chosen",
)
def outlet_basin(fx: Fixtures):
    return _chosen(fx)


@query(
    "zonal_basin_summary",
    "outlet:s n_cells:i km2:g west:f east:f south:f north:f",
    f"""WITH {OUTLET_SQL},
{INSIDE_SQL},
mb AS (SELECT outlet, p.poly_id FROM chosen JOIN fx_polygons p USING (main_id)),
bo AS (SELECT outlet, min(least(x1,x2)) AS west, max(greatest(x1,x2)) AS east, min(least(y1,y2)) AS south, max(greatest(y1,y2)) AS north
 FROM mb JOIN fx_polygon_edges USING (poly_id) GROUP BY outlet),
cc AS (SELECT outlet, count(*) AS n, sum(6371.0088e0**2*radians(15)*radians(15)*cos(radians(lat))) AS km2 FROM
 (SELECT DISTINCT outlet, iy, ix FROM mb JOIN cand USING (poly_id)) JOIN fx_cells USING (iy, ix) WHERE land GROUP BY outlet)
--
SELECT outlet, coalesce(n,0) AS n_cells, coalesce(km2,0) AS km2, west, east, south, north FROM bo LEFT JOIN cc USING (outlet)""",
)
def basin_summary(fx: Fixtures):
    return zonal.basin_summary(
        _chosen(fx), fx.polygons, fx.polygon_edges, _inside(fx), fx.cells, "poly_id", "main_id", fx.grid
    )


@query(
    "join_cell_covariates",
    "iy:i ix:i lat:f lon:f beta:f aridity:f human:f glacier:f months_s1:i months_s2:i months_s3:i",
    f"""WITH {BETA_SQL},
{COVER},
cw AS (SELECT iy, ix, {", ".join(f"coalesce(max(n_months) FILTER (field='{s}'),0) AS months_{s}" for s in ("s1", "s2", "s3"))} FROM cov GROUP BY iy, ix)
--
SELECT c.iy, c.ix, lat, lon, beta, aridity, human, glacier, coalesce(months_s1,0) AS months_s1, coalesce(months_s2,0) AS months_s2,
 coalesce(months_s3,0) AS months_s3 FROM fx_cells c JOIN beta USING (iy, ix) LEFT JOIN cw USING (iy, ix) WHERE land""",
)
def cell_covariates(fx: Fixtures):
    d = pinned(_disagreements(fx))
    names = ["s1", "s2", "s3"]
    cover = d.groupBy("iy", "ix").agg(*[F.count_if(F.col("field") == s).alias(f"months_{s}") for s in names])
    from isopleth.operators.weights import beta_from, beta_on_land

    beta = beta_on_land(beta_from(d, ["iy", "ix"]), fx.cells.where("land"), ["iy", "ix"])
    land = fx.cells.where("land").join(beta.select("iy", "ix", "beta"), ["iy", "ix"])
    return land.join(cover, ["iy", "ix"], "left").fillna(0, [f"months_{s}" for s in names])


@query(
    "join_metric_merge",
    "model:s rmse:f mae:f external_pcc:f n_external:i",
    f"""WITH {PIXEL_SQL}
--
SELECT model, rmse, mae, external_pcc, n_external FROM (SELECT model, avg(rmse) AS rmse, avg(mae) AS mae FROM ({MONTHLY}) WHERE variant='corrected'
 GROUP BY model) JOIN (SELECT model, median(pcc) AS external_pcc, count(pcc) AS n_external FROM px GROUP BY model) USING (model)""",
)
def metric_merge(fx: Fixtures):
    from isopleth.operators.skill import location_summary

    coarse = monthly_spatial(fx).where("variant = 'corrected'").groupBy("model").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")
    )
    ext = location_summary(_pixels(fx), ["model"], "pcc").select(
        "model", F.col("median").alias("external_pcc"), F.col("n").alias("n_external")
    )
    return coarse.join(ext, "model")
