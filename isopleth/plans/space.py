"""Means over space and conservation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from isopleth.functions import geo
from isopleth.operators import conserve
from isopleth.plans.fixtures import Fixtures
from isopleth.plans.registry import query

# West, east, south and north of four named boxes.
NAMED_BOXES = {
    "Amazon": (-75.0, -50.0, -15.0, 5.0),
    "Sahara": (0.0, 30.0, 15.0, 30.0),
    "Indo_Gangetic": (70.0, 90.0, 20.0, 30.0),
    "Alaska": (-150.0, -130.0, 60.0, 70.0),
}


@query(
    "agg_block_mean_area",
    "t:d cy:i cx:i evaluation:f training:f pooled:f pooled_valid:b",
    """WITH s AS (SELECT t, cy, cx, sum(CASE WHEN valid THEN obs*w ELSE 0 END) AS n,
 sum(CASE WHEN valid AND w>0 THEN w ELSE 0 END) AS d FROM fx_valid GROUP BY t, cy, cx)
--
SELECT t, cy, cx, CASE WHEN d>1e-6 THEN n/d END AS evaluation, CASE WHEN d>1e-12 THEN n/d ELSE 0 END AS training,
 CASE WHEN d>1e-6 THEN n/d ELSE 0 END AS pooled, d>1e-6 AS pooled_valid FROM s""",
)
def block_mean_area(fx: Fixtures):
    """The three rules for empty blocks from one aggregation."""
    sums = conserve.block_sums(fx.valid, ["t"], ["obs"], fx.grid, "w", "valid")
    return sums.select(
        "t",
        "cy",
        "cx",
        conserve.mean_of_sums("obs").alias("evaluation"),
        conserve.mean_of_sums("obs", "zero", 1e-12).alias("training"),
        conserve.mean_of_sums("obs", "flag").alias("pooled"),
        conserve.has_weight("obs").alias("pooled_valid"),
    )


@query(
    "agg_block_mean_plain",
    "t:d cy:i cx:i obs:f",
    """SELECT t, iy//5 AS cy, ix//5 AS cx, avg(obs) AS obs FROM fx_field WHERE iy<10 AND ix<20 GROUP BY ALL""",
)
def block_mean_plain(fx: Fixtures):
    return conserve.block_mean_plain(fx.field, ["t"], ["obs"], replace(fx.grid, factor=5))


@query(
    "agg_halve_resolution",
    "t:d cy:i cx:i obs:f",
    """SELECT t, iy//2 AS cy, ix//2 AS cx, sum(CASE WHEN valid THEN obs*w END)/sum(CASE WHEN valid THEN w END) AS obs
 FROM fx_valid GROUP BY ALL""",
)
def halve_resolution(fx: Fixtures):
    return conserve.block_mean(fx.valid, ["t"], ["obs"], replace(fx.grid, factor=2), "w", "valid")


ZONE_SQL = """SELECT t, zone_id, CASE WHEN sum(CASE WHEN valid THEN w ELSE 0 END)>1e-12
 THEN sum(CASE WHEN valid THEN {v}*w END)/sum(CASE WHEN valid THEN w END) END AS {v},
 sum(CASE WHEN valid THEN w ELSE 0 END)>1e-12 AS {v}_valid FROM {src} GROUP BY t, zone_id"""


@query("agg_zone_mean_area", "t:d zone_id:i obs:f obs_valid:b", ZONE_SQL.format(v="obs", src="fx_valid"))
def zone_mean_area(fx: Fixtures):
    return conserve.zone_mean(fx.valid, ["t"], "zone_id", ["obs"], "w", "valid")


@query(
    "agg_area_mean_scalar",
    "obs:f",
    """SELECT sum(m*w)/sum(w) AS obs FROM (SELECT iy, ix, avg(obs) AS m FROM fx_field GROUP BY iy, ix)
 JOIN fx_cells USING (iy, ix) WHERE land""",
)
def area_mean_scalar(fx: Fixtures):
    means = fx.field.groupBy("iy", "ix").agg(F.avg("obs").alias("obs"))
    joined = fx.grid.attach(means, fx.cells)
    return conserve.area_mean(joined, "obs", F.col("w") * F.col("land").cast("double"))


BIN_SQL = """SELECT CAST(ts AS DATE) AS day, CAST(floor((lat+90)/15) AS INT) AS iy, CAST(floor((lon+180)/15) AS INT) AS ix,
 avg(value) AS value FROM fx_station_raw WHERE value IS NOT NULL AND floor((lat+90)/15) BETWEEN 0 AND 11
 AND floor((lon+180)/15) BETWEEN 0 AND 23 GROUP BY ALL"""


def _days(fx: Fixtures):
    g = fx.grid
    points = fx.station_raw.withColumn("day", F.col("ts").cast("date"))
    return conserve.bin_average(
        points, ["day"], "value", geo.index_floor("lat", g.lat0, g.dlat), geo.index_floor("lon", g.lon0, g.dlon), g
    )


@query("agg_bin_average", "day:d iy:i ix:i value:f", BIN_SQL)
def bin_average(fx: Fixtures):
    return _days(fx)


@query(
    "agg_daily_then_monthly",
    "month:d iy:i ix:i value:f n_days:i",
    f"""SELECT date_trunc('month', day) AS month, iy, ix, avg(value) AS value, count(*) AS n_days
 FROM ({BIN_SQL}) GROUP BY ALL""",
)
def daily_then_monthly(fx: Fixtures):
    return conserve.daily_then_monthly(_days(fx), F.trunc("day", "MM"), "value")


@query(
    "agg_zone_series",
    "basin_id:i t:d obs:f prior:f n_cells:i",
    """WITH s AS (SELECT basin_id, t, avg(CASE WHEN valid THEN obs END) AS obs, avg(CASE WHEN valid THEN prior END) AS prior,
 count(*) FILTER (valid) AS n_cells FROM fx_valid WHERE basin_id>0 GROUP BY basin_id, t)
--
SELECT * FROM s WHERE basin_id IN (SELECT basin_id FROM s GROUP BY 1 HAVING max(n_cells)>=14)""",
)
def zone_series(fx: Fixtures):
    return conserve.zone_series(fx.valid, "basin_id", ["obs", "prior"], "valid", min_cells=14)


@query(
    "agg_box_series_area",
    "box:s t:d mean:f standardized:f",
    """WITH b AS (SELECT * FROM (VALUES ('Amazon',-75,-50,-15,5),('Sahara',0,30,15,30),('Indo_Gangetic',70,90,20,30),
 ('Alaska',-150,-130,60,70)) v(box, west, east, south, north)),
m AS (SELECT box, t, obs, w FROM fx_valid JOIN b ON lon>=west AND lon<east AND lat>=south AND lat<north WHERE valid
 UNION ALL SELECT CAST(CAST(floor((lat+90)/45)*8+floor((lon+180)/45) AS BIGINT) AS VARCHAR), t, obs, w FROM fx_valid WHERE valid),
s AS (SELECT box, t, sum(obs*w)/sum(w) AS mean FROM m GROUP BY box, t)
--
SELECT box, t, mean, (mean-avg(mean) OVER p)/stddev_pop(mean) OVER p AS standardized FROM s WINDOW p AS (PARTITION BY box)""",
)
def box_series_area(fx: Fixtures):
    boxes = conserve.box_membership(F.col("lat"), F.col("lon"), NAMED_BOXES, geo.box_id("lat", "lon", 45.0))
    return conserve.box_series(fx.valid.where("valid"), [], "obs", F.col("w"), boxes)


TARGET_SQL = """target AS (SELECT t, cy, cx, sum(obs*w)/sum(w) AS target FROM fx_valid WHERE valid GROUP BY t, cy, cx)"""


@query(
    "cons_project_block",
    "t:d iy:i ix:i projected:f error_before:f error_after:f",
    f"""WITH {TARGET_SQL},
m AS (SELECT p.t, p.iy, p.ix, p.valid, p.value, target, sum(CASE WHEN valid THEN value*w END) OVER b
 / sum(CASE WHEN valid THEN w END) OVER b AS mean FROM fx_pred p LEFT JOIN target USING (t, cy, cx)
 WINDOW b AS (PARTITION BY t, cy, cx))
--
SELECT t, iy, ix, CASE WHEN valid THEN value+coalesce(target-mean,0) ELSE value END AS projected,
 abs(target-mean) AS error_before, CASE WHEN target-mean IS NOT NULL THEN 0 END AS error_after FROM m""",
)
def project_block(fx: Fixtures):
    target = conserve.block_mean(fx.valid, ["t"], ["obs"], fx.grid, "w", "valid")
    return conserve.project_blocks(fx.pred, ["t"], "value", target, "obs", fx.grid, "w", "valid")


@query(
    "cons_blend_correct",
    "model:s t:d iy:i ix:i corrected:f",
    """SELECT model, t, iy, ix, value+0.05e0*greatest(-1, least(1, avg(obs) OVER b-avg(value) OVER b)) AS corrected
 FROM fx_raw_model JOIN (SELECT t, iy, ix, obs FROM fx_field) USING (t, iy, ix)
 WINDOW b AS (PARTITION BY model, t, iy//3, ix//3)""",
)
def blend_correct(fx: Fixtures):
    raw = fx.raw_model.join(fx.field.select("t", "iy", "ix", "obs"), ["t", "iy", "ix"])
    return conserve.blend_correct(raw, ["model", "t"], "value", "obs", fx.grid, blend=0.05, cap=1.0)


@query(
    "cons_blend_errors",
    "model:s t:d error_before:f error_after:f",
    """WITH c AS (SELECT model, t, iy//3 AS cy, ix//3 AS cx, obs, value, value+0.05e0*greatest(-1, least(1, avg(obs) OVER b
 -avg(value) OVER b)) AS corrected FROM fx_raw_model JOIN (SELECT t, iy, ix, obs FROM fx_field) USING (t, iy, ix)
 WINDOW b AS (PARTITION BY model, t, iy//3, ix//3)),
k AS (SELECT model, t, abs(avg(obs)-avg(value)) AS b, abs(avg(obs)-avg(corrected)) AS a FROM c GROUP BY model, t, cy, cx)
--
SELECT model, t, avg(b) AS error_before, avg(a) AS error_after FROM k GROUP BY model, t""",
)
def blend_errors(fx: Fixtures):
    return conserve.blend_errors(blend_correct(fx), ["model", "t"], "obs", "value", "corrected", fx.grid)


ZTARGET = "ztarget AS (SELECT t, zone_id, sum(obs*w)/sum(w) AS target FROM fx_valid WHERE valid GROUP BY t, zone_id)"


@query(
    "cons_project_zone",
    "t:d iy:i ix:i projected:f",
    f"""WITH {ZTARGET},
m AS (SELECT t, zone_id, sum(value*w)/sum(w) AS mean FROM fx_pred WHERE valid GROUP BY t, zone_id)
--
SELECT p.t, p.iy, p.ix, CASE WHEN valid THEN value+coalesce(target-mean,0) ELSE value END AS projected
 FROM fx_pred p LEFT JOIN ztarget USING (t, zone_id) LEFT JOIN m USING (t, zone_id)""",
)
def project_zone(fx: Fixtures):
    target = conserve.zone_mean(fx.valid, ["t"], "zone_id", ["obs"], "w", "valid")
    return conserve.project_zones(fx.pred, ["t"], "value", target, "obs", "zone_id", "w", "valid")


@query(
    "cons_nullspace",
    "t:d iy:i ix:i detail:f",
    """WITH m AS (SELECT t, zone_id, sum(value*w)/sum(w) AS mean FROM fx_pred WHERE valid GROUP BY t, zone_id)
--
SELECT t, iy, ix, CASE WHEN valid THEN value-mean END AS detail FROM fx_pred LEFT JOIN m USING (t, zone_id)""",
)
def nullspace(fx: Fixtures):
    return conserve.nullspace(fx.pred, ["t"], "value", "zone_id", "w", "valid")


@query(
    "cons_nullspace_residual",
    "t:d n_zones:i max_abs_mean:f",
    """SELECT t, count(DISTINCT zone_id) AS n_zones, 0 AS max_abs_mean FROM fx_pred WHERE valid GROUP BY t""",
)
def nullspace_residual(fx: Fixtures):
    detail = conserve.nullspace(fx.pred, ["t"], "value", "zone_id", "w", "valid")
    return conserve.remaining_mean(detail, ["t"], "detail", "zone_id", "w", "valid")


DECOMPOSE = f"""WITH ztarget AS (SELECT t, zone_id, sum(obs*w)/sum(w) AS target FROM fx_pred WHERE {{out}} GROUP BY t, zone_id),
m AS (SELECT t, zone_id, sum(value*w)/sum(w) AS mean FROM fx_pred WHERE {{out}} AND {{detail}} GROUP BY t, zone_id),
c AS (SELECT t, iy, ix, zone_id, w, {{detail}} AS used, target AS observation,
 CASE WHEN {{detail}} THEN value-mean ELSE 0 END AS detail FROM fx_pred LEFT JOIN ztarget USING (t, zone_id)
 LEFT JOIN m USING (t, zone_id) WHERE {{out}})
--
"""
SUPPORT = DECOMPOSE.replace("{out}", "land").replace("{detail}", "(valid AND zone_id%4<>0)")


def _decomposed(fx: Fixtures, supported: bool):
    keep = fx.pred.where("land" if supported else "valid")
    marked = keep.withColumn("used", F.expr("valid AND zone_id % 4 <> 0") if supported else F.lit(True))
    target = conserve.zone_mean(keep, ["t"], "zone_id", ["obs"], "w")
    return conserve.decompose(marked, ["t"], "value", target, "obs", "zone_id", "w", "used")


@query(
    "cons_decompose",
    "t:d iy:i ix:i observation:f detail:f reconstruction:f",
    DECOMPOSE.replace("{out}", "valid").replace("{detail}", "valid")
    + "SELECT t, iy, ix, observation, detail, observation+detail AS reconstruction FROM c",
)
def decompose(fx: Fixtures):
    return _decomposed(fx, supported=False)[0]


@query(
    "cons_decompose_supported",
    "t:d zone_id:i observation:f reconstructed:f detail_fraction:f closure:f",
    SUPPORT
    + """SELECT t, zone_id, max(observation) AS observation, sum((observation+detail)*w)/sum(w) AS reconstructed,
 sum(CASE WHEN used THEN w ELSE 0 END)/sum(w) AS detail_fraction, 0 AS closure FROM c GROUP BY t, zone_id""",
)
def decompose_supported(fx: Fixtures):
    return _decomposed(fx, supported=True)[1]


@query(
    "cons_closure_summary",
    "n_months:i n_dropped:i n_zones:i n_cells:i closure_max:f min_supported:i max_observation_only:i",
    SUPPORT.replace("\n--\n", "")
    + """,
z AS (SELECT t, zone_id, sum(CASE WHEN used THEN w ELSE 0 END)/sum(w) AS f FROM c GROUP BY t, zone_id),
k AS (SELECT t, count(*) FILTER (f>0) AS s, count(*) FILTER (f<=0) AS o FROM z GROUP BY t)
--
SELECT (SELECT count(*) FROM k) AS n_months, (SELECT count(DISTINCT t) FROM fx_field)-(SELECT count(*) FROM k) AS n_dropped,
 (SELECT count(DISTINCT zone_id) FROM z) AS n_zones, (SELECT count(*) FROM (SELECT DISTINCT iy, ix FROM c)) AS n_cells,
 0 AS closure_max, min(s) AS min_supported, max(o) AS max_observation_only FROM k""",
)
def closure_summary(fx: Fixtures):
    cells, zones = _decomposed(fx, supported=True)
    months = conserve.decomposition_counts(zones, ["t"])
    n_zones = zones.agg(F.count_distinct("zone_id").alias("n"))
    n_cells = cells.agg(F.count_distinct("iy", "ix").alias("n"))
    wanted = fx.field.agg(F.count_distinct("t").alias("n"))
    return months.agg(
        F.count("*").alias("n_months"),
        F.max("closure_max").alias("closure_max"),
        F.min("detail_supported").alias("min_supported"),
        F.max("observation_only").alias("max_observation_only"),
    ).select(
        "*",
        (wanted.scalar() - F.col("n_months")).alias("n_dropped"),
        n_zones.scalar().alias("n_zones"),
        n_cells.scalar().alias("n_cells"),
    )
