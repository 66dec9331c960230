"""Skill metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from isopleth.functions.stats import ecdf, exact_median, pearson, rmse, spearman
from isopleth.operators import conserve, masks, neighbours, skill, temporal
from isopleth.plans.fixtures import MODELS, Fixtures, sql_corr, sql_harmonics, sql_rank
from isopleth.plans.registry import query
from isopleth.session import pinned
from isopleth.plans.time_series import ALPHA_SQL, BETA_SQL, STRATA_SQL, _alpha, _beta

CELLS = ["iy", "ix"]
TEMPORAL_SQL = f"""tm AS (SELECT model, cy, cx, count(*) AS n_months, sqrt(avg((value-ref)**2)) AS rmse, avg(abs(value-ref)) AS mae,
 avg(value-ref) AS bias, {sql_corr("value", "ref", 1)} AS pcc, 1-avg((value-ref)**2)/var_pop(ref) AS nse
 FROM fx_coarse_eval WHERE variant='corrected' GROUP BY model, cy, cx HAVING count(*)>=24)"""


def _corrected(fx: Fixtures):
    return fx.coarse_eval.where("variant = 'corrected'")


def _cell_skill(fx: Fixtures):
    """The cell skill as a written table: its readers go over it several times."""
    return pinned(_temporal(fx))


def _temporal(fx: Fixtures):
    return skill.temporal_skill(_corrected(fx), ["model", "cy", "cx"], "value", "ref", 24)


@query(
    "met_temporal",
    "model:s cy:i cx:i n_months:i rmse:f mae:f bias:f pcc:f nse:f",
    f"WITH {TEMPORAL_SQL}\n--\nSELECT * FROM tm",
)
def temporal_skill(fx: Fixtures):
    return _temporal(fx)


#: Cell metrics whose medians the full table gives.
MEDIANS = ("rmse", "mae", "bias", "pcc", "nse")

MONTHLY = """SELECT model, variant, t, sqrt(avg((value-ref)**2)) AS rmse, avg(abs(value-ref)) AS mae, avg(value-ref) AS bias
 FROM fx_coarse_eval GROUP BY model, variant, t"""


@query("met_monthly_spatial", "model:s variant:s t:d rmse:f mae:f bias:f", MONTHLY)
def monthly_spatial(fx: Fixtures):
    return skill.monthly_skill(fx.coarse_eval, ["model", "variant"], "value", "ref")


@query(
    "met_coarse_full",
    "variant:s model:s rmse:f mae:f bias:f " + " ".join(f"median_{c}:f" for c in MEDIANS) + " trend_mae:f annual_mae:f semiannual_mae:f",
    f"""WITH tm AS (SELECT variant, model, cy, cx, sqrt(avg((value-ref)**2)) AS rmse, avg(abs(value-ref)) AS mae,
 avg(value-ref) AS bias, {sql_corr("value", "ref", 1)} AS pcc, 1-avg((value-ref)**2)/var_pop(ref) AS nse
 FROM fx_coarse_eval GROUP BY variant, model, cy, cx HAVING count(*)>=24),
rf AS (SELECT * FROM fx_coarse_eval WHERE model='M0' AND variant='corrected'),
{sql_harmonics("hv", "fx_coarse_eval", "variant, model, cy, cx", "value")},
{sql_harmonics("hr", "rf", "cy, cx", "ref")},
mo AS (SELECT variant, model, avg(rmse) AS rmse, avg(mae) AS mae, avg(bias) AS bias FROM ({MONTHLY}) GROUP BY variant, model),
ce AS (SELECT variant, model, {", ".join(f"median({c}) AS median_{c}" for c in MEDIANS)} FROM tm GROUP BY variant, model),
gp AS (SELECT v.variant, v.model, avg(abs(v.trend-r.trend)) AS trend_mae, avg(abs(v.annual-r.annual)) AS annual_mae, avg(abs(v.semiannual-r.semiannual)) AS semiannual_mae
 FROM hv v JOIN hr r USING (cy, cx) GROUP BY v.variant, v.model)
--
SELECT * FROM mo JOIN ce USING (variant, model) JOIN gp USING (variant, model)""",
)
def coarse_full(fx: Fixtures):
    """Per variant: mean of monthly errors, medians of the cell skill, harmonic differences."""
    rows, by, keys = fx.coarse_eval, ["variant", "model"], ["cy", "cx"]
    months = skill.monthly_skill(rows, by, "value", "ref").groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("rmse", "mae", "bias")]
    )
    cells = pinned(skill.temporal_skill(rows, [*by, *keys], "value", "ref", 24))
    terms = ["trend", "annual", "semiannual"]
    own = temporal.harmonics(rows, [*by, *keys], "value", 24)
    ref = temporal.harmonics(rows.where("model = 'M0' AND variant = 'corrected'"), keys, "ref", 24)
    gaps = own.join(ref.select(*keys, *[F.col(c).alias(f"r_{c}") for c in terms]), keys)
    diffs = gaps.groupBy(*by).agg(*[F.avg(F.abs(F.col(c) - F.col(f"r_{c}"))).alias(f"{c}_mae") for c in terms])
    medians = [exact_median(cells, by, c, f"median_{c}") for c in MEDIANS]
    return reduce(lambda a, b: a.join(b, by), [months, *medians, diffs])


@query(
    "met_spatial_corr",
    "model:s t:d corr:f n:i",
    f"SELECT model, t, {sql_corr('value', 'obs')} AS corr, count(*) AS n FROM fx_fine_eval WHERE variant='corrected' GROUP BY model, t",
)
def spatial_corr(fx: Fixtures):
    rows = fx.fine_eval.where("variant = 'corrected'")
    return skill.spatial_correlation(rows, ["model", "t"], "value", "obs")


@query(
    "met_basic_corr",
    "iy:i ix:i corr:f n:i",
    f"SELECT iy, ix, {sql_corr('prior', 'obs')} AS corr, count(*) AS n FROM fx_field GROUP BY iy, ix",
)
def basic_corr(fx: Fixtures):
    return skill.spatial_correlation(fx.field, CELLS, "prior", "obs")


@query(
    "met_weighted_corr_clip",
    "model:s corr:f",
    """WITH s AS (SELECT model, t, covar_pop(value,prior)*count(*)/greatest(sqrt(greatest(var_pop(value)*count(*),1e-6))
 *sqrt(greatest(var_pop(prior)*count(*),1e-6)),1e-6) AS r FROM fx_fine_eval WHERE variant='corrected' GROUP BY model, t)
--
SELECT model, greatest(0,least(1,avg(r))) AS corr FROM s GROUP BY model""",
)
def weighted_corr_clip(fx: Fixtures):
    rows = fx.fine_eval.where("variant = 'corrected'")
    return skill.clipped_mean_correlation(rows, ["model"], "t", "value", "prior")


DIFF_SQL = """p AS (SELECT {k} t, iy, ix, value, prior FROM {src}),
gx AS (SELECT {a} a.t, abs((b.value-a.value)-(b.prior-a.prior)) AS e FROM p a JOIN p b ON {j} a.t=b.t AND a.iy=b.iy AND b.ix=a.ix+1),
gy AS (SELECT {a} a.t, abs((b.value-a.value)-(b.prior-a.prior)) AS e FROM p a JOIN p b ON {j} a.t=b.t AND a.ix=b.ix AND b.iy=a.iy+1),
g AS (SELECT {k} t, coalesce((x+y)/2,x,y) AS gradient_mae FROM (SELECT {k} t, avg(e) AS x FROM gx GROUP BY ALL)
 FULL JOIN (SELECT {k} t, avg(e) AS y FROM gy GROUP BY ALL) USING ({k} t))"""


def _diff(keys: str, src: str) -> str:
    names = [k for k in keys.split() if k]
    return DIFF_SQL.format(
        k="".join(f"{n}, " for n in names),
        a="".join(f"a.{n}, " for n in names),
        j="".join(f"a.{n}=b.{n} AND " for n in names),
        src=src,
    )


@query(
    "met_gradient_mae",
    "model:s t:d gradient_mae:f",
    f"WITH {_diff('model', 'fx_fine_eval').replace('FROM fx_fine_eval', 'FROM fx_fine_eval WHERE variant=\'corrected\'')}\n--\n"
    "SELECT * FROM (SELECT DISTINCT model, t FROM fx_fine_eval WHERE variant='corrected') LEFT JOIN g USING (model, t)",
)
def gradient_mae(fx: Fixtures):
    rows = fx.fine_eval.where("variant = 'corrected'")
    diffs = neighbours.forward_difference(rows, ["model", "t"], ["value", "prior"])
    return neighbours.gradient_mae(diffs, ["model", "t"], "value", "prior")


INTERNAL_SQL = f"""{_diff('variant model', 'fx_fine_eval')},
f AS (SELECT variant, model, t, sqrt(avg((value-obs)**2)) AS fine_rmse, avg(abs(value-obs)) AS fine_mae, avg(value-obs) AS fine_bias,
 {sql_corr("value", "obs")} AS fine_corr, sqrt(avg((value-prior)**2)) AS prior_rmse, {sql_corr("value", "prior")} AS prior_corr,
 count(*)/288.0e0 AS valid_fraction FROM fx_fine_eval GROUP BY variant, model, t),
c AS (SELECT variant, model, t, sqrt(avg((value-ref)**2)) AS coarse_rmse, avg(abs(value-ref)) AS coarse_mae, avg(value-ref) AS coarse_bias,
 {sql_corr("value", "ref")} AS coarse_corr FROM fx_coarse_eval GROUP BY variant, model, t),
im AS (SELECT * FROM f JOIN c USING (variant, model, t) LEFT JOIN g USING (variant, model, t))"""
INTERNAL = (
    "fine_rmse fine_mae fine_bias fine_corr prior_rmse prior_corr coarse_rmse coarse_mae coarse_bias coarse_corr "
    "gradient_mae valid_fraction"
).split()


def _internal(fx: Fixtures):
    """Before and after correction: every metric of the fine rows in one aggregation, the coarse ones in another."""
    keys = ["variant", "model", "t"]
    gap = F.col("value") - F.col("obs")
    fine = fx.fine_eval.groupBy(*keys).agg(
        rmse("value", "obs").alias("fine_rmse"),
        F.avg(F.abs(gap)).alias("fine_mae"),
        F.avg(gap).alias("fine_bias"),
        pearson("value", "obs").alias("fine_corr"),
        rmse("value", "prior").alias("prior_rmse"),
        pearson("value", "prior").alias("prior_corr"),
        (F.count("*") / F.lit(float(fx.grid.size))).alias("valid_fraction"),
    )
    coarse = fx.coarse_eval.groupBy(*keys).agg(
        rmse("value", "ref").alias("coarse_rmse"),
        F.avg(F.abs(F.col("value") - F.col("ref"))).alias("coarse_mae"),
        F.avg(F.col("value") - F.col("ref")).alias("coarse_bias"),
        pearson("value", "ref").alias("coarse_corr"),
    )
    diffs = neighbours.forward_difference(fx.fine_eval, keys, ["value", "prior"])
    slopes = neighbours.gradient_mae(diffs, keys, "value", "prior")
    return fine.join(coarse, keys).join(slopes, keys, "left")


@query(
    "met_internal_monthly",
    "variant:s model:s t:d " + " ".join(f"{c}:f" for c in INTERNAL),
    f"WITH {INTERNAL_SQL}\n--\nSELECT * FROM im",
)
def internal_monthly(fx: Fixtures):
    return _internal(fx)


@query(
    "met_internal_summary",
    "variant:s model:s n_months:i " + " ".join(f"{c}:f" for c in INTERNAL) + " trend_diff:f season_diff:f",
    f"""WITH {INTERNAL_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY variant, model, cy, cx ORDER BY t) AS k FROM fx_coarse_eval),
td AS (SELECT variant, model, avg(abs(a-b)) AS trend_diff FROM (SELECT variant, model, cy, cx, regr_slope(value,k) AS a, regr_slope(ref,k) AS b FROM k
 GROUP BY variant, model, cy, cx HAVING count(*)>=3) GROUP BY variant, model),
sd AS (SELECT variant, model, avg(abs(a-b)) AS season_diff FROM (SELECT variant, model, cy, cx, (max(v)-min(v))/2 AS a, (max(r)-min(r))/2 AS b FROM
 (SELECT variant, model, cy, cx, month(t) AS m, avg(value) AS v, avg(ref) AS r FROM k GROUP BY ALL) GROUP BY variant, model, cy, cx) GROUP BY variant, model)
--
SELECT variant, model, count(*) AS n_months, {", ".join(f"avg({c}) AS {c}" for c in INTERNAL)}, max(trend_diff) AS trend_diff, max(season_diff) AS season_diff
 FROM im JOIN td USING (variant, model) JOIN sd USING (variant, model) GROUP BY variant, model""",
)
def internal_summary(fx: Fixtures):
    """Means over months before and after correction; the coarse columns show the closure."""
    by = ["variant", "model"]
    months = _internal(fx).groupBy(*by).agg(F.count("*").alias("n_months"), *[F.avg(c).alias(c) for c in INTERNAL])
    rows, cell = fx.coarse_eval, [*by, "cy", "cx"]
    gap = F.avg(F.abs(F.col("value") - F.col("ref")))
    trend = temporal.trend_compact(rows, ["value", "ref"], cell).groupBy(*by).agg(gap.alias("trend_diff"))
    season = temporal.season_amplitude(rows, ["value", "ref"], cell).groupBy(*by).agg(gap.alias("season_diff"))
    return months.join(trend, by).join(season, by)


REGION_SRC = f"""(SELECT region, t, iy, ix, value, prior, obs FROM fx_pred JOIN {STRATA_SQL} WHERE valid)"""
REGION_COLS = "rmse mae bias corr prior_rmse prior_corr gradient_mae valid_fraction".split()


@query(
    "met_region",
    "region:s cell_count:i n_months:i " + " ".join(f"{c}:f" for c in REGION_COLS),
    f"""WITH rs AS {REGION_SRC},
n AS (SELECT region, count(*) AS cell_count FROM fx_cells JOIN {STRATA_SQL} GROUP BY region),
{_diff('region', 'rs')},
m AS (SELECT region, t, sqrt(avg((value-obs)**2)) AS rmse, avg(abs(value-obs)) AS mae, avg(value-obs) AS bias, {sql_corr("value", "obs")} AS corr,
 sqrt(avg((value-prior)**2)) AS prior_rmse, {sql_corr("value", "prior")} AS prior_corr, count(*) AS n FROM rs GROUP BY region, t HAVING count(*)>=9)
--
SELECT region, max(cell_count) AS cell_count, count(*) AS n_months, avg(n/cell_count) AS valid_fraction,
 {", ".join(f"avg({c}) AS {c}" for c in REGION_COLS[:-1])} FROM m JOIN n USING (region) LEFT JOIN g USING (region, t) GROUP BY region""",
)
def region_skill(fx: Fixtures):
    strata = masks.named_regions()
    rows = masks.explode_strata(fx.pred.where("valid"), strata)
    sizes = masks.explode_strata(fx.cells, strata).groupBy("region").agg(F.count("*").alias("cell_count"))
    keys = ["region", "t"]
    months = rows.groupBy(*keys).agg(
        rmse("value", "obs").alias("rmse"),
        F.avg(F.abs(F.col("value") - F.col("obs"))).alias("mae"),
        F.avg(F.col("value") - F.col("obs")).alias("bias"),
        pearson("value", "obs").alias("corr"),
        rmse("value", "prior").alias("prior_rmse"),
        pearson("value", "prior").alias("prior_corr"),
        F.count("*").alias("n"),
    ).where("n >= 9")
    diffs = neighbours.forward_difference(rows, keys, ["value", "prior"])
    slopes = neighbours.gradient_mae(diffs, keys, "value", "prior")
    joined = months.join(slopes, keys, "left").join(sizes, "region").withColumn(
        "valid_fraction", F.col("n") / F.col("cell_count")
    )
    return joined.groupBy("region").agg(
        F.max("cell_count").alias("cell_count"),
        F.count("*").alias("n_months"),
        *[F.avg(c).alias(c) for c in REGION_COLS],
    )


BASIN_SQL = f"""s AS (SELECT basin_id, t, avg(value) FILTER (valid) AS pred, avg(obs) FILTER (valid) AS obs, avg(prior) FILTER (valid) AS prior,
 avg(s1) FILTER (valid) AS s1, count(*) FILTER (valid) AS k FROM fx_pred WHERE basin_id>0 GROUP BY basin_id, t),
big AS (SELECT basin_id FROM s GROUP BY basin_id HAVING max(k)>=12),
bs AS (SELECT basin_id, {", ".join(f"{sql_corr('pred', r)} AS corr_{r}, sqrt(avg((pred-{r})**2)) AS rmse_{r}" for r in ("obs", "prior", "s1"))}
 FROM s WHERE basin_id IN (SELECT basin_id FROM big) AND k>0 GROUP BY basin_id)"""
BASIN_COLS = " ".join(f"corr_{r}:f rmse_{r}:f" for r in ("obs", "prior", "s1"))


def _basins(fx: Fixtures):
    renamed = fx.pred.withColumnRenamed("value", "pred")
    series = conserve.zone_series(renamed, "basin_id", ["pred", "obs", "prior", "s1"], "valid", 12)
    sizes = fx.cells.groupBy("basin_id").agg(F.count("*").alias("n_cells"))
    return skill.basin_skill(series, "basin_id", "pred", ["obs", "prior", "s1"], sizes)


@query(
    "met_basin",
    f"basin_id:i n_cells:i {BASIN_COLS}",
    f"""WITH {BASIN_SQL}
--
SELECT bs.*, (SELECT count(*) FROM fx_cells c WHERE c.basin_id=bs.basin_id) AS n_cells FROM bs""",
)
def basin(fx: Fixtures):
    return _basins(fx)


@query(
    "met_basin_summary",
    "n_basins:i mean_corr_obs:f median_corr_obs:f mean_corr_prior:f median_corr_prior:f",
    f"""WITH {BASIN_SQL}
--
SELECT count(*) AS n_basins, avg(corr_obs) AS mean_corr_obs, median(corr_obs) AS median_corr_obs, avg(corr_prior) AS mean_corr_prior,
 median(corr_prior) AS median_corr_prior FROM bs""",
)
def basin_summary(fx: Fixtures):
    b = pinned(_basins(fx))
    return b.agg(
        F.count("*").alias("n_basins"), F.avg("corr_obs").alias("mean_corr_obs"), F.avg("corr_prior").alias("mean_corr_prior")
    ).withColumns(
        {
            f"median_corr_{r}": exact_median(b, [], f"corr_{r}", "m").scalar() for r in ("obs", "prior")
        }
    )


Z_SQL = """z AS (SELECT model, t, iy, ix, value-avg(value) OVER c AS va, smap-avg(smap) OVER c AS sa,
 (value-avg(value) OVER c)/nullif(stddev_pop(value) OVER c,0) AS vz, (smap-avg(smap) OVER c)/nullif(stddev_pop(smap) OVER c,0) AS sz FROM fx_external
 WINDOW c AS (PARTITION BY model, iy, ix))"""


def _z(fx: Fixtures):
    return skill.anomaly_zscore(fx.external, ["model", "iy", "ix"], ["value", "smap"])


@query(
    "met_smap_anom_zscore",
    "model:s t:d iy:i ix:i value_anom:f value_z:f smap_anom:f smap_z:f",
    f"WITH {Z_SQL}\n--\nSELECT model, t, iy, ix, va AS value_anom, vz AS value_z, sa AS smap_anom, sz AS smap_z FROM z",
)
def smap_anom_zscore(fx: Fixtures):
    return _z(fx)


@query(
    "met_smap_monthly",
    "model:s t:d spatial_corr:f rmse_z:f valid_fraction:f",
    f"""WITH {Z_SQL}
--
SELECT model, t, {sql_corr("va", "sa")} AS spatial_corr, sqrt(avg((vz-sz)**2)) AS rmse_z, count(*)/288.0e0 AS valid_fraction FROM z GROUP BY model, t""",
)
def smap_monthly(fx: Fixtures):
    return skill.external_monthly(_z(fx), ["model"], "value", "smap", fx.grid.size)


PIXEL_SQL = f"""px AS (SELECT model, iy, ix, count(*) AS n_months, {sql_corr("value", "smap", 1)} AS pcc FROM fx_external GROUP BY model, iy, ix
 HAVING count(*)>=24)"""


def _pixels(fx: Fixtures):
    return pinned(skill.per_cell_correlation(fx.external, ["model", "iy", "ix"], "value", "smap", 24))


@query(
    "met_smap_pixel",
    "model:s mean:f median:f n:i",
    f"WITH {PIXEL_SQL}\n--\nSELECT model, avg(pcc) AS mean, median(pcc) AS median, count(pcc) AS n FROM px GROUP BY model",
)
def smap_pixel(fx: Fixtures):
    return skill.location_summary(_pixels(fx), ["model"], "pcc")


WIDE_SQL = f"""{PIXEL_SQL},
{BETA_SQL},
{ALPHA_SQL.replace("m AS (", "am AS (").replace("FROM m ", "FROM am ")},
ae AS (SELECT quantile_cont(1-disagreement, 1e0/3) AS a0, quantile_cont(1-disagreement, 2e0/3) AS a1 FROM fx_cells JOIN alpha USING (cy, cx) WHERE land),
be AS (SELECT quantile_cont(beta, 1e0/3) AS b0, quantile_cont(beta, 2e0/3) AS b1 FROM beta),
wide AS (SELECT iy, ix, {", ".join(f"max(pcc) FILTER (model='{m}') AS {m}" for m in MODELS)} FROM px WHERE pcc IS NOT NULL GROUP BY iy, ix HAVING count(*)=5),
frame AS (SELECT w.*, c.lat, c.lon, c.human, c.glacier, c.aridity, 1-a.disagreement AS alpha, b.beta,
 CASE WHEN 1-a.disagreement>a0 THEN 1 ELSE 0 END+CASE WHEN 1-a.disagreement>a1 THEN 1 ELSE 0 END AS alpha_bin,
 CASE WHEN b.beta>b0 THEN 1 ELSE 0 END+CASE WHEN b.beta>b1 THEN 1 ELSE 0 END AS beta_bin
 FROM wide w JOIN fx_cells c USING (iy, ix) JOIN alpha a USING (cy, cx) JOIN beta b USING (iy, ix), ae, be)"""


def frame(fx: Fixtures):
    """Per-model correlations on common cells with weights, their tertiles and covariates."""
    wide = skill.model_table(_pixels(fx), CELLS, MODELS)
    land = fx.cells.where("land").join(_alpha(fx).select("cy", "cx", "alpha"), ["cy", "cx"])
    land = pinned(land.join(_beta(fx).select(*CELLS, "beta"), CELLS))
    binned = masks.with_tertile(masks.with_tertile(land, "alpha", "alpha_bin"), "beta", "beta_bin")
    return wide.join(
        binned.select(*CELLS, "lat", "lon", "human", "glacier", "aridity", "alpha", "beta", "alpha_bin", "beta_bin"), CELLS
    )


@query(
    "met_smap_common_table",
    "iy:i ix:i " + " ".join(f"{m}:f" for m in MODELS) + " alpha:f beta:f alpha_bin:i beta_bin:i human:f glacier:f aridity:f",
    f"WITH {WIDE_SQL}\n--\nSELECT * FROM frame",
)
def smap_common_table(fx: Fixtures):
    return frame(fx)


@query(
    "met_model_summary",
    "model:s n:i median:f",
    f"WITH {PIXEL_SQL}\n--\nSELECT model, count(pcc) AS n, median(pcc) AS median FROM px GROUP BY model",
)
def model_summary(fx: Fixtures):
    return skill.location_summary(_pixels(fx), ["model"], "pcc")


@query(
    "met_spearman",
    "field:s rho:f n:i",
    f"""WITH j AS (SELECT l.field, l.value AS x, f.obs AS y FROM fx_field_long l JOIN fx_field f USING (t, iy, ix) WHERE field<>'obs'),
r AS (SELECT field, {sql_rank("x", "field")} AS rx, {sql_rank("y", "field")} AS ry FROM j)
--
SELECT field, {sql_corr("rx", "ry")} AS rho, count(*) AS n FROM r GROUP BY field""",
)
def spearman_fields(fx: Fixtures):
    long = fx.field.unpivot(["t", "iy", "ix", "obs"], ["prior", "s1", "s2", "s3"], "field", "value")
    return spearman(long, ["field"], "value", "obs")


ALPHA_RHO_SQL = f"""{ALPHA_SQL},
pd AS (SELECT c.*, CASE WHEN split=0 THEN 'train' ELSE 'test' END AS period FROM fx_coarse c JOIN fx_split USING (t) WHERE split<>1),
{sql_harmonics("ha", "pd", "period, cy, cx", "prior", 20)},
{sql_harmonics("hb", "pd", "period, cy, cx", "obs", 20)},
bs AS (SELECT period, cy, cx, {sql_corr("prior", "obs")} AS pcc, sqrt(avg((prior-obs)*(prior-obs)))/stddev_pop(obs) AS nrmse FROM pd GROUP BY period, cy, cx HAVING count(*)>=20),
dg AS (SELECT period, cy, cx, pcc, nrmse, abs(ha.trend-hb.trend) AS abs_trend_difference, abs(ha.annual-hb.annual) AS abs_annual_difference
 FROM bs JOIN ha USING (period, cy, cx) JOIN hb USING (period, cy, cx)),
dl AS (SELECT * FROM (UNPIVOT dg ON pcc, nrmse, abs_trend_difference, abs_annual_difference INTO NAME diagnostic VALUE value)),
da AS (SELECT period, diagnostic, 1-disagreement AS alpha, value FROM dl JOIN alpha USING (cy, cx) WHERE value IS NOT NULL),
dr AS (SELECT period, diagnostic, {sql_rank("alpha", "period, diagnostic")} AS a, {sql_rank("value", "period, diagnostic")} AS b FROM da)"""


@query(
    "met_alpha_spearman",
    "period:s diagnostic:s rho:f n:i",
    f"WITH {ALPHA_RHO_SQL}\n--\nSELECT period, diagnostic, {sql_corr('a', 'b')} AS rho, count(*) AS n FROM dr GROUP BY period, diagnostic",
)
def alpha_spearman_ranks(fx: Fixtures):
    return _alpha_spearman(fx)


@query("met_alpha_spearman_test", "period:s diagnostic:s rho:f n:i p_value:f")
def alpha_spearman_test(fx: Fixtures):
    """The same with its p-value, which SQL has no function for."""
    return _alpha_spearman(fx)


def _alpha_spearman(fx: Fixtures):
    """Rank correlation of alpha with block diagnostics in the training and test months."""
    cell = ["cy", "cx"]
    coarse = fx.coarse.join(fx.split, "t").where("split <> 1").withColumn(
        "period", F.when(F.col("split") == 0, "train").otherwise("test")
    )
    keys = ["period", *cell]
    base = skill.temporal_skill(coarse, keys, "prior", "obs", 20)
    spread = coarse.groupBy(*keys).agg(F.stddev_pop("obs").alias("sd"))
    terms = ["trend", "annual"]
    a = temporal.harmonics(coarse, keys, "prior", 20).select(*keys, *[F.col(c).alias(f"a_{c}") for c in terms])
    b = temporal.harmonics(coarse, keys, "obs", 20).select(*keys, *[F.col(c).alias(f"b_{c}") for c in terms])
    wide = base.join(spread, keys).join(a, keys).join(b, keys).select(
        *keys,
        "pcc",
        (F.col("rmse") / F.col("sd")).alias("nrmse"),
        *[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"abs_{c}_difference") for c in terms],
    )
    long = wide.unpivot(keys, ["pcc", "nrmse", "abs_trend_difference", "abs_annual_difference"], "diagnostic", "value")
    return skill.spearman_test(pinned(long.join(_alpha(fx), cell)), ["period", "diagnostic"], "alpha", "value")


@query(
    "met_ecdf",
    "model:s rmse:f fraction:f",
    f"""WITH {TEMPORAL_SQL}
--
SELECT model, rmse, row_number() OVER (PARTITION BY model ORDER BY rmse)/count(*) OVER (PARTITION BY model) AS fraction FROM tm""",
)
def ecdf_rmse(fx: Fixtures):
    return ecdf(_cell_skill(fx), ["model"], "rmse")


@query(
    "met_decile_medians",
    "bin:i n:i x_median:f y_median:f",
    """WITH e AS (SELECT quantile_cont(prior, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]) AS q FROM fx_field),
b AS (SELECT prior, obs-prior AS gain, i AS bin FROM fx_field, e, (SELECT unnest(range(0,10)) AS i) WHERE prior>=q[i+1] AND prior<=q[i+2])
--
SELECT bin, count(*) AS n, median(prior) AS x_median, median(gain) AS y_median FROM b GROUP BY bin""",
)
def decile_medians(fx: Fixtures):
    return skill.decile_medians(fx.field.withColumn("gain", F.col("obs") - F.col("prior")), "prior", "gain")


@query(
    "met_minmax_table",
    "model:s rmse:f mae:f",
    f"""WITH a AS (SELECT model, avg(rmse) AS rmse, avg(mae) AS mae FROM ({MONTHLY}) WHERE variant='corrected' GROUP BY model)
--
SELECT model, (rmse-min(rmse) OVER ())/(max(rmse) OVER ()-min(rmse) OVER ()) AS rmse,
 (mae-min(mae) OVER ())/(max(mae) OVER ()-min(mae) OVER ()) AS mae FROM a""",
)
def minmax_table(fx: Fixtures):
    rows = monthly_spatial(fx).where("variant = 'corrected'").groupBy("model").agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")
    )
    return skill.min_max_columns(rows, ["rmse", "mae"])


@query(
    "met_display_limits",
    "symmetric_limit:f n_clipped:i",
    """WITH d AS (SELECT obs-prior AS g FROM fx_field),
q AS (SELECT greatest(abs(quantile_cont(g,.02e0)), abs(quantile_cont(g,.98e0)), .001e0) AS m FROM d)
--
SELECT max(m) AS symmetric_limit, count(*) FILTER (abs(g)>m) AS n_clipped FROM d, q""",
)
def display_limits(fx: Fixtures):
    return skill.display_limit(fx.field.select((F.col("obs") - F.col("prior")).alias("g")), "g")


LIMITS = {"prior": (20.0, 80.0), "obs": (10.0, 90.0), "s1": (5.0, 45.0), "s2": (1.0, 7.0), "s3": (1.0, 9.0)}


@query(
    "met_value_range_audit",
    "field:s n_finite:i n_below:i n_above:i",
    f"""WITH l(field, lo, hi) AS (VALUES {", ".join(f"('{k}',{a}e0,{b}e0)" for k, (a, b) in LIMITS.items())})
--
SELECT field, count(value) AS n_finite, count(*) FILTER (value<lo) AS n_below, count(*) FILTER (value>hi) AS n_above
 FROM fx_field_long JOIN l USING (field) GROUP BY field""",
)
def value_range_audit(fx: Fixtures):
    return skill.range_audit(fx.field_long, ["field"], "value", LIMITS, "field")


@query(
    "met_best_epoch",
    "epoch:d loss:f improved:b best_epoch:d best_loss:f",
    """WITH h AS (SELECT CAST(ts AS DATE) AS epoch, avg(value) AS loss FROM events GROUP BY 1)
--
SELECT epoch, loss, loss<coalesce(min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1e300) AS improved,
 (SELECT arg_min(epoch, ROW(loss, epoch)) FROM h) AS best_epoch, (SELECT min(loss) FROM h) AS best_loss FROM h""",
)
def best_epoch(fx: Fixtures):
    history = fx.table("events").groupBy(F.col("ts").cast("date").alias("epoch")).agg(F.avg("value").alias("loss"))
    best = skill.best_epoch(history, "epoch", "loss").select(F.struct("best_epoch", "best_loss").alias("s"))
    return skill.improvements(history, "epoch", "loss").withColumn("_s", best.scalar()).select(
        "epoch", "loss", "improved", "_s.*"
    )
