"""Spatial filters, spectra and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions.stats import exact_quantiles, scalar, spearman
from isopleth.operators import filters, objective, spectra, tiles
from isopleth.plans.fixtures import Fixtures, sql_corr, sql_rank
from isopleth.plans.registry import query
from isopleth.session import pinned

TAPS = filters.gaussian_taps()
KERNEL = "k(d, wt) AS (VALUES " + ", ".join(f"({d},{TAPS[abs(d)]!r}e0)" for d in range(-6, 7)) + ")"


def _long_fields(fx: Fixtures):
    """M4, observation and prior on the common cells, one row per field."""
    m4 = fx.fine_eval.where("model = 'M4' AND variant = 'corrected'")
    return m4.withColumnRenamed("value", "M4").unpivot(["t", "iy", "ix"], ["M4", "obs", "prior"], "model", "v")


LONG_SQL = """sf AS (SELECT t, iy, ix, u.model, u.v FROM fx_fine_eval f, LATERAL (VALUES ('M4', value), ('obs', obs), ('prior', prior)) u(model, v)
 WHERE f.model='M4' AND variant='corrected')"""


def _highpass_sql(index: str, floor: str) -> str:
    x, y = index.format(i="j", n=24), index.format(i="j", n=12)
    return f"""{KERNEL},
{LONG_SQL},
px AS (SELECT model, t, s.iy, j AS ix, sum(v*wt) AS v, sum(wt) AS w FROM sf s, (SELECT unnest(range(0,24)) AS j), k WHERE s.ix={x} GROUP BY model, t, s.iy, j),
py AS (SELECT model, t, j AS iy, s.ix, sum(v*wt) AS v, sum(w*wt) AS w FROM px s, (SELECT unnest(range(0,12)) AS j), k WHERE s.iy={y} GROUP BY model, t, s.ix, j),
hp AS (SELECT model, t, iy, ix, s.v, p.v/greatest(p.w,{floor}) AS low, s.v-p.v/greatest(p.w,{floor}) AS high FROM sf s JOIN py p USING (model, t, iy, ix))"""


NEAREST = _highpass_sql("greatest(0,least({n}-1,{i}+d))", "1e-12")
REFLECT = _highpass_sql("(CASE WHEN abs({i}+d)>{n}-1 THEN 2*({n}-1)-abs({i}+d) ELSE abs({i}+d) END)", "1e-6")


def _high(fx: Fixtures):
    return filters.high_pass(_long_fields(fx), ["model", "t"], "v", fx.grid)


@query("fil_gaussian_highpass", "model:s t:d iy:i ix:i high:f", f"WITH {NEAREST}\n--\nSELECT model, t, iy, ix, high FROM hp")
def gaussian_highpass(fx: Fixtures):
    return _high(fx)


@query("fil_gaussian_reflect", "model:s t:d iy:i ix:i low:f", f"WITH {REFLECT}\n--\nSELECT model, t, iy, ix, low FROM hp")
def gaussian_reflect(fx: Fixtures):
    return filters.blur(_long_fields(fx), ["model", "t"], ["v"], fx.grid, TAPS, "reflect", 1e-6).withColumnRenamed(
        "v_low", "low"
    )


SOBEL_SQL = """sd AS (SELECT t, iy, ix, value-prior AS d FROM fx_pred WHERE valid),
so AS (SELECT a.t, a.iy, a.ix, sum(b.d*(b.ix-a.ix)*(2-abs(b.iy-a.iy)))/8 AS sx, sum(b.d*(b.iy-a.iy)*(2-abs(b.ix-a.ix)))/8 AS sy FROM sd a
 JOIN sd b ON a.t=b.t AND b.iy BETWEEN a.iy-1 AND a.iy+1 AND b.ix BETWEEN a.ix-1 AND a.ix+1 GROUP BY a.t, a.iy, a.ix)"""


@query("fil_sobel_mse", "t:d sobel:f", f"WITH {SOBEL_SQL}\n--\nSELECT t, avg(.5e0*(sx*sx+sy*sy)) AS sobel FROM so GROUP BY t")
def sobel_mse(fx: Fixtures):
    return objective.sobel_mse(fx.pred.where("valid"), ["t"], "t", "value", "prior")


RMS_SQL = f"{NEAREST},\nrm AS (SELECT model, iy, ix, sqrt(avg(high*high)) AS rms FROM hp GROUP BY model, iy, ix)"


def _rms(fx: Fixtures):
    return pinned(filters.rms_over_time(_high(fx), ["model"]))


@query(
    "fil_highpass_rms",
    "model:s mean_rms:f median_rms:f rho:f n:i",
    f"""WITH {RMS_SQL},
j AS (SELECT rm.*, aridity FROM rm JOIN fx_cells USING (iy, ix)),
r AS (SELECT *, {sql_rank("rms", "model")} AS a, {sql_rank("aridity", "model")} AS b FROM j)
--
SELECT model, avg(rms) AS mean_rms, median(rms) AS median_rms, {sql_corr("a", "b")} AS rho, count(*) AS n FROM r GROUP BY model""",
)
def highpass_rms(fx: Fixtures):
    joined = fx.grid.attach(_rms(fx), fx.cells.select("iy", "ix", "aridity"))
    return filters.rms_summary(pinned(joined), ["model"], "aridity")


@query(
    "fil_hfi_highpass",
    "iy:i ix:i hfi:f",
    f"""WITH {RMS_SQL},
wd AS (SELECT iy, ix, max(rms) FILTER (model='M4') AS m, max(rms) FILTER (model='obs') AS j, max(rms) FILTER (model='prior') AS w FROM rm GROUP BY iy, ix)
--
SELECT iy, ix, CASE WHEN abs(w*w-j*j)>1e-6*(SELECT median(w*w) FROM wd WHERE w>0) THEN (m*m-j*j)/(w*w-j*j) END AS hfi FROM wd""",
)
def hfi_highpass(fx: Fixtures):
    wide = filters.by_model(_rms(fx), ["iy", "ix"], "rms", {"M4": "m", "obs": "j", "prior": "w"})
    return filters.inherited_share(wide, "m", "j", "w")


def _spectra(fx: Fixtures):
    strata = F.array_compact(F.array(F.lit("global"), F.when(F.col("aridity") > 0.5, "arid"), F.when(F.col("aridity") <= 0.5, "moist")))
    rows = fx.grid.attach(_long_fields(fx), fx.cells.select("iy", "ix", "aridity")).withColumn("stratum", F.explode(strata))
    return spectra.spectrum(rows, ["model", "stratum", "t"], "v", fx.grid.ny, fx.grid.nx)


SPECTRUM_SQL = f"""{LONG_SQL},
sg AS (SELECT model, stratum, t, iy, ix, v FROM sf JOIN (SELECT iy, ix, aridity FROM fx_cells) c USING (iy, ix) JOIN (VALUES ('global'),('arid'),('moist')) st(stratum)
 ON stratum='global' OR (stratum='arid' AND aridity>.5e0) OR (stratum='moist' AND aridity<=.5e0)),
zm AS (SELECT model, stratum, t, iy, ix, v-avg(v) OVER g AS z, count(*) OVER g AS n FROM sg WINDOW g AS (PARTITION BY model, stratum, t)),
ax AS (SELECT model, stratum, t, iy, k, max(n) AS n, sum(z*cos(2*pi()*k*ix/24)) AS re, -sum(z*sin(2*pi()*k*ix/24)) AS im FROM zm, (SELECT unnest(range(0,24)) AS k)
 GROUP BY model, stratum, t, iy, k),
ay AS (SELECT model, stratum, t, k, u, max(n) AS n, sum(re*cos(2*pi()*u*iy/12)+im*sin(2*pi()*u*iy/12)) AS re, sum(im*cos(2*pi()*u*iy/12)-re*sin(2*pi()*u*iy/12)) AS im
 FROM ax, (SELECT unnest(range(0,12)) AS u) GROUP BY model, stratum, t, k, u),
pw AS (SELECT model, stratum, t, n, (re*re+im*im)/(288*n) AS p, floor(sqrt(4*(CASE WHEN u<6 THEN u ELSE u-12 END)**2+(CASE WHEN k<12 THEN k ELSE k-24 END)**2)/2) AS bin FROM ay),
sp AS (SELECT model, stratum, t, CASE WHEN max(n)<4 THEN (bin+1)/12 ELSE (bin+.5e0)/12 END AS wavenumber, CASE WHEN max(n)>=4 THEN avg(p) END AS power
 FROM pw WHERE bin<6 GROUP BY model, stratum, t, bin)"""


@query(
    "spc_radial_power",
    "model:s stratum:s t:d wavenumber:f power:f",
    f"WITH {SPECTRUM_SQL}\n--\nSELECT model, stratum, t, wavenumber, power FROM sp",
)
def radial_power(fx: Fixtures):
    return _spectra(fx)


@query(
    "spc_summary",
    "model:s stratum:s wavenumber:f q25:f q50:f q75:f",
    f"""WITH {SPECTRUM_SQL}
--
SELECT model, stratum, floor(wavenumber*1e9+.5e0)/1e9 AS wavenumber, quantile_cont(power,.25e0) AS q25, quantile_cont(power,.5e0) AS q50, quantile_cont(power,.75e0) AS q75
 FROM sp GROUP BY ALL""",
)
def spectral_summary(fx: Fixtures):
    return spectra.summary(_spectra(fx), ["model", "stratum"])


def _box_shares(fx: Fixtures):
    """Monthly inherited share of high-frequency energy per 4x4-cell box."""
    rows = _long_fields(fx).withColumns(
        {"by": F.floor(F.col("iy") / 4).cast("int"), "bx": F.floor(F.col("ix") / 4).cast("int")}
    ).withColumns({"y0": F.col("by") * 4, "x0": F.col("bx") * 4})
    keys = ["model", "by", "bx", "t"]
    power = spectra.spectrum(rows, keys, "v", 4, 4, "y0", "x0")
    energy = spectra.band_energy(power, keys)
    wide = pinned(filters.by_model(energy, ["by", "bx", "t"], "energy", {"M4": "m", "obs": "j", "prior": "w"}))
    middle = exact_quantiles(wide.where("w > 0"), [], "w", {"q": 0.5})
    return filters.share_with_floor(wide, F.col("m"), F.col("j"), F.col("w"), scalar(middle), "hfi")


BOX_SQL = f"""{LONG_SQL},
bz AS (SELECT model, iy//4 AS box_y, ix//4 AS box_x, t, iy%4 AS y, ix%4 AS x, v-avg(v) OVER g AS z, count(*) OVER g AS n FROM sf WINDOW g AS (PARTITION BY model, iy//4, ix//4, t)),
bw AS (SELECT model, box_y, box_x, t, u, k, max(n) AS n, sum(z*cos(pi()*(k*x+u*y)/2)) AS re, sum(z*sin(pi()*(k*x+u*y)/2)) AS im
 FROM bz, (SELECT unnest(range(4)) AS u), (SELECT unnest(range(4)) AS k) WHERE u<>2 AND k<>2 AND u+k>0 GROUP BY ALL),
be AS (SELECT model, box_y, box_x, t, CASE WHEN max(n)>=4 THEN avg((re*re+im*im)/(16*n)) END AS energy FROM bw GROUP BY model, box_y, box_x, t),
bm AS (SELECT box_y, box_x, t, max(energy) FILTER (model='M4') AS m, max(energy) FILTER (model='obs') AS j, max(energy) FILTER (model='prior') AS w FROM be GROUP BY box_y, box_x, t),
bh AS (SELECT box_y, box_x, median(CASE WHEN abs(w-j)>1e-6*(SELECT median(w) FROM bm WHERE w>0) THEN (m-j)/(w-j) END) AS hfi FROM bm GROUP BY box_y, box_x),
ba AS (SELECT box_y, box_x, hfi, aridity FROM bh JOIN (SELECT iy//4 AS box_y, ix//4 AS box_x, median(aridity) AS aridity FROM fx_cells GROUP BY ALL) USING (box_y, box_x)),
br AS (SELECT {sql_rank("hfi")} AS a, {sql_rank("aridity")} AS b FROM ba WHERE hfi IS NOT NULL AND aridity IS NOT NULL)"""


@query(
    "spc_box_hfi",
    "box_y:i box_x:i hfi:f aridity:f rho:f",
    f"WITH {BOX_SQL}\n--\nSELECT box_y, box_x, hfi, aridity, (SELECT {sql_corr('a', 'b')} FROM br) AS rho FROM ba",
)
def box_hfi(fx: Fixtures):
    boxes = _box_shares(fx).groupBy("by", "bx").agg(F.percentile("hfi", F.lit(0.5)).alias("hfi"))
    dry = fx.cells.groupBy(
        F.floor(F.col("iy") / 4).cast("int").alias("by"), F.floor(F.col("ix") / 4).cast("int").alias("bx")
    ).agg(F.percentile("aridity", F.lit(0.5)).alias("aridity"))
    joined = pinned(boxes.join(dry, ["by", "bx"]))
    rho = spearman(joined, [], "hfi", "aridity").select("rho")
    return joined.withColumn("rho", scalar(rho)).withColumnsRenamed({"by": "box_y", "bx": "box_x"})


SIZE, STRIDE = 6, 4
TILE_SQL = """ty AS (SELECT unnest([0,4,6]) AS y0), tx AS (SELECT unnest([0,4,8,12,16,18]) AS x0),
ad AS (SELECT t, y0, x0, count(*) FILTER (valid)/36.0e0 AS valid_fraction, count(*) FILTER (land)/36.0e0 AS land_fraction FROM fx_valid, ty, tx
 WHERE iy BETWEEN y0 AND y0+5 AND ix BETWEEN x0 AND x0+5 GROUP BY t, y0, x0)"""


@query("tile_enumerate", "t:d y0:i x0:i", f"WITH {TILE_SQL}\n--\nSELECT t, y0, x0 FROM fx_split, ty, tx")
def tile_enumerate(fx: Fixtures):
    return tiles.enumerate_tiles(fx.split, fx.grid, SIZE, STRIDE)


def _admitted(fx: Fixtures):
    return tiles.admit(fx.valid, fx.grid, SIZE, STRIDE, "valid", "land")


ADMIT = "WHERE valid_fraction>=.05e0 AND land_fraction>=.05e0"


@query(
    "tile_admit", "t:d y0:i x0:i valid_fraction:f land_fraction:f", f"WITH {TILE_SQL}\n--\nSELECT * FROM ad {ADMIT}"
)
def tile_admit(fx: Fixtures):
    return _admitted(fx)


@query(
    "tile_stitch",
    "t:d iy:i ix:i value:f",
    f"WITH {TILE_SQL}\n--\nSELECT t, iy, ix, avg(CASE WHEN valid THEN value+y0*.25e0-x0*.125e0 END) AS value FROM fx_pred, ty, tx "
    "WHERE iy BETWEEN y0 AND y0+5 AND ix BETWEEN x0 AND x0+5 GROUP BY t, iy, ix",
)
def tile_stitch(fx: Fixtures):
    rows = tiles.on_tiles(fx.pred, fx.grid, SIZE, STRIDE)
    per_tile = rows.withColumn("value", F.col("value") + F.col("y0") * 0.25 - F.col("x0") * 0.125)
    return tiles.stitch(per_tile, ["t"], "value", "valid")


@query(
    "tile_even_sample",
    "t:d y0:i x0:i idx:i",
    f"""WITH {TILE_SQL},
o AS (SELECT t, y0, x0, row_number() OVER (ORDER BY t, y0, x0)-1 AS idx FROM ad {ADMIT}),
s AS (SELECT DISTINCT CAST(floor(j*((SELECT max(idx) FROM o)/CAST(47 AS DOUBLE))) AS BIGINT) AS idx FROM (SELECT unnest(range(0,48)) AS j))
--
SELECT t, y0, x0, idx FROM o JOIN s USING (idx)""",
)
def tile_even_sample(fx: Fixtures):
    return tiles.even_sample(pinned(_admitted(fx)), fx.grid, 48)
