"""Anomalies, trends, and disagreement weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions.stats import scalar
from isopleth.operators import masks, temporal, weights
from isopleth.plans.fixtures import BASE_END, BASE_START, TRAIN_END, Fixtures, sql_corr, sql_harmonics, sql_rank
from isopleth.plans.registry import query
from isopleth.session import pinned

BLOCK = ["cy", "cx"]
IN_BASE = "t BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


@query(
    "agg_anomaly",
    "t:d iy:i ix:i baseline:f anomaly:f",
    f"""SELECT t, iy, ix, avg(obs) FILTER ({IN_BASE}) OVER c AS baseline,
 obs-avg(obs) FILTER ({IN_BASE}) OVER c AS anomaly FROM fx_field WINDOW c AS (PARTITION BY iy, ix)""",
)
def anomaly(fx: Fixtures):
    return temporal.anomaly(fx.field, "obs", BASE_START, BASE_END)


@query(
    "agg_component_sum",
    "t:d iy:i ix:i storage:f",
    "SELECT t, iy, ix, s1*0.07e0*1000+s2*0.21e0*1000+s3 AS storage FROM fx_field",
)
def component_sum(fx: Fixtures):
    return fx.field.withColumn("storage", temporal.component_sum([("s1", 70.0), ("s2", 210.0), ("s3", 1.0)]))


@query(
    "agg_sign_detect",
    "t:d iy:i ix:i loss:f",
    """WITH e AS (SELECT t, iy, ix, s2-s1 AS evap FROM fx_field)
--
SELECT t, iy, ix, CASE WHEN (SELECT avg(evap) FROM e)<0 THEN -evap ELSE evap END AS loss FROM e""",
)
def sign_detect(fx: Fixtures):
    return temporal.loss_positive(fx.field.withColumn("evap", F.col("s2") - F.col("s1")), "evap", "loss")


@query(
    "win_cumulative_flux",
    "t:d iy:i ix:i storage:f anomaly:f",
    f"""WITH c AS (SELECT t, iy, ix, sum(coalesce(prior-s1-s3,0)) OVER (PARTITION BY iy, ix ORDER BY t) AS storage FROM fx_field)
--
SELECT t, iy, ix, storage, storage-avg(storage) FILTER ({IN_BASE}) OVER (PARTITION BY iy, ix) AS anomaly FROM c""",
)
def cumulative_flux(fx: Fixtures):
    summed = temporal.cumulative(fx.field, F.col("prior") - F.col("s1") - F.col("s3"), "storage")
    return temporal.anomaly(summed, "storage", BASE_START, BASE_END)


@query(
    "agg_season_amplitude",
    "iy:i ix:i obs:f prior:f",
    """SELECT iy, ix, (max(o)-min(o))/2 AS obs, (max(p)-min(p))/2 AS prior FROM
 (SELECT iy, ix, month(t) AS m, avg(obs) AS o, avg(prior) AS p FROM fx_field GROUP BY ALL) GROUP BY iy, ix""",
)
def season_amplitude(fx: Fixtures):
    return temporal.season_amplitude(fx.field, ["obs", "prior"])


@query(
    "agg_trend_compact",
    "iy:i ix:i obs:f s3:f",
    """WITH k AS (SELECT *, count(obs) OVER r AS ko, count(s3) OVER r AS k3 FROM fx_field
 WINDOW r AS (PARTITION BY iy, ix ORDER BY t))
--
SELECT iy, ix, regr_slope(obs, ko) AS obs, regr_slope(s3, k3) AS s3 FROM k GROUP BY iy, ix""",
)
def trend_compact(fx: Fixtures):
    return temporal.trend_compact(fx.field, ["obs", "s3"])


@query(
    "agg_trend_indexed",
    "iy:i ix:i obs:f s3:f",
    """WITH p AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM fx_field))
--
SELECT iy, ix, regr_slope(obs, k) AS obs, regr_slope(s3, k) AS s3 FROM fx_field JOIN p USING (t) GROUP BY iy, ix""",
)
def trend_indexed(fx: Fixtures):
    return temporal.trend_indexed(fx.field, ["obs", "s3"])


@query(
    "agg_trend_calendar",
    "iy:i ix:i obs:f s3:f",
    """SELECT iy, ix, regr_slope(obs, year(t)*12+month(t))*12 AS obs, regr_slope(s3, year(t)*12+month(t))*12 AS s3
 FROM fx_field GROUP BY iy, ix""",
)
def trend_calendar(fx: Fixtures):
    return temporal.trend_calendar(fx.field, ["obs", "s3"])


@query(
    "agg_harmonics",
    "field:s iy:i ix:i n:i trend:f annual:f semiannual:f",
    f"WITH {sql_harmonics('ha', 'fx_field_long', 'field, iy, ix', 'value')}\n--\nSELECT * FROM ha",
)
def harmonics(fx: Fixtures):
    return temporal.harmonics(fx.field_long, ["field", "iy", "ix"], "value", 24)


@query(
    "agg_consistency",
    "iy:i ix:i corr:f trend_diff:f season_amp_diff:f nrmse:f",
    """SELECT iy, ix, corr, trend_diff, season_amp_diff, nrmse FROM fx_consistency JOIN fx_cells USING (cy, cx)""",
)
def consistency(fx: Fixtures):
    return fx.cells.select("iy", "ix", "cy", "cx").join(fx.consistency, BLOCK)


TRAIN = "t <= DATE '1998-12-31'"
ALPHA_SQL = f"""m AS (SELECT cy, cx, prior-median(prior) OVER c AS a, obs-median(obs) OVER c AS b FROM fx_coarse
 WHERE {TRAIN} WINDOW c AS (PARTITION BY cy, cx)),
alpha AS (SELECT cy, cx, count(*) AS n_months, CASE WHEN sum(abs(a)+abs(b))>0 THEN sum(abs(a-b))/sum(abs(a)+abs(b)) ELSE 1 END
 AS disagreement FROM m GROUP BY cy, cx)"""


def _alpha(fx: Fixtures):
    train = fx.coarse.where(F.col("t") <= F.lit(TRAIN_END).cast("date"))
    return weights.alpha_disagreement(train, BLOCK, "prior", "obs")


@query(
    "agg_alpha_disagreement",
    "cy:i cx:i alpha:f disagreement:f n_months:i",
    f"WITH {ALPHA_SQL}\n--\nSELECT *, 1-disagreement AS alpha FROM alpha",
)
def alpha_disagreement(fx: Fixtures):
    return _alpha(fx)


@query(
    "agg_alpha_diagnostics",
    "cy:i cx:i pcc:f nrmse:f trend_difference:f annual_amplitude_difference:f n_months:i",
    f"""WITH p AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM fx_coarse)),
b AS (SELECT cy, cx, {sql_corr("prior", "obs")} AS pcc, sqrt(avg((prior-obs)*(prior-obs)))/stddev_pop(obs) AS nrmse,
 regr_slope(prior,k)-regr_slope(obs,k) AS trend_difference, count(*) AS n_months FROM fx_coarse JOIN p USING (t) GROUP BY cy, cx),
c AS (SELECT cy, cx, month(t) AS m, avg(prior) AS p, avg(obs) AS o FROM fx_coarse GROUP BY ALL),
s AS (SELECT cy, cx, (max(p)-min(p))/2-(max(o)-min(o))/2 AS annual_amplitude_difference FROM c GROUP BY cy, cx)
--
SELECT * FROM b JOIN s USING (cy, cx) WHERE n_months>=3""",
)
def alpha_diagnostics(fx: Fixtures):
    return weights.alpha_diagnostics(fx.coarse, BLOCK, "prior", "obs")


GRAD_SQL = f"""l AS (SELECT field, t, iy, ix, value FROM fx_field_long JOIN (SELECT t, iy, ix FROM fx_valid WHERE valid) USING (t, iy, ix)
  WHERE field <> 'obs' AND {TRAIN}),
g AS (SELECT l.field, l.t, l.iy, l.ix, x.value-l.value AS gx, y.value-l.value AS gy FROM l
 JOIN l x ON x.field=l.field AND x.t=l.t AND x.iy=l.iy AND x.ix=l.ix+1
 JOIN l y ON y.field=l.field AND y.t=l.t AND y.iy=l.iy+1 AND y.ix=l.ix),
q AS (SELECT field, median(sqrt(gx*gx+gy*gy)) AS q FROM g WHERE sqrt(gx*gx+gy*gy)>0 GROUP BY field),
u AS (SELECT field, t, iy, ix, gx/q AS x, gy/q AS y FROM g JOIN q USING (field)),
d AS (SELECT u.field, u.t, u.iy, u.ix, CASE WHEN sqrt(p.x**2+p.y**2)+sqrt(u.x**2+u.y**2)=0 THEN 0 ELSE
 least(1, sqrt((p.x-u.x)**2+(p.y-u.y)**2)/(sqrt(p.x**2+p.y**2)+sqrt(u.x**2+u.y**2))) END AS d
 FROM u JOIN u p USING (t, iy, ix) WHERE p.field='prior' AND u.field<>'prior')"""


def _vectors(fx: Fixtures):
    ok = fx.valid.where("valid").where(F.col("t") <= F.lit(TRAIN_END).cast("date"))
    long = ok.unpivot(["t", "iy", "ix"], ["prior", "s1", "s2", "s3"], "field", "value")
    return weights.gradient_vectors(long, "field", "value", F.col("value").isNotNull())


def _disagreements(fx: Fixtures):
    vectors = pinned(_vectors(fx))
    return weights.gradient_disagreement(vectors, weights.gradient_scales(vectors, "field"), "field", "prior")


@query("agg_gradient_scale", "field:s q:f", f"WITH {GRAD_SQL}\n--\nSELECT field, q FROM q")
def gradient_scale(fx: Fixtures):
    return weights.gradient_scales(_vectors(fx), "field")


@query("agg_gradient_disagreement", "field:s t:d iy:i ix:i d:f", f"WITH {GRAD_SQL}\n--\nSELECT field, t, iy, ix, d FROM d")
def gradient_disagreement(fx: Fixtures):
    return _disagreements(fx)


BETA_SQL = f"""{GRAD_SQL},
dm AS (SELECT t, iy, ix, median(d) AS d FROM d GROUP BY t, iy, ix),
bm AS (SELECT iy, ix, median(d) AS d, count(*) AS n FROM dm GROUP BY iy, ix),
beta AS (SELECT iy, ix, coalesce(1-d,0) AS beta, coalesce(d,1) AS disagreement, coalesce(n,0) AS n_months
 FROM fx_cells LEFT JOIN bm USING (iy, ix) WHERE land)"""


def _beta(fx: Fixtures):
    return weights.beta_on_land(weights.beta_from(_disagreements(fx), ["iy", "ix"]), fx.cells.where("land"), ["iy", "ix"])


@query("agg_beta_median", "iy:i ix:i beta:f disagreement:f n_months:i", f"WITH {BETA_SQL}\n--\nSELECT * FROM beta")
def beta_median(fx: Fixtures):
    return _beta(fx)


COVER = "cov AS (SELECT field, iy, ix, count(d) AS n_months, min(t) AS first_month, max(t) AS last_month FROM d GROUP BY ALL)"


@query(
    "agg_source_coverage",
    "field:s iy:i ix:i n_months:i first_month:d last_month:d",
    f"WITH {GRAD_SQL},\n{COVER}\n--\nSELECT * FROM cov",
)
def source_coverage(fx: Fixtures):
    return weights.source_coverage(_disagreements(fx), ["iy", "ix"], "field")


@query(
    "agg_source_comparisons",
    "field:s scale:f comparisons:i first_month:d last_month:d",
    f"""WITH {GRAD_SQL},
n AS (SELECT field, count(d) AS comparisons, min(t) AS first_month, max(t) AS last_month FROM d GROUP BY field)
--
SELECT n.field, q AS scale, comparisons, first_month, last_month FROM n JOIN q USING (field)""",
)
def source_comparisons(fx: Fixtures):
    """Valid comparisons, scale and span of each source."""
    vectors = pinned(_vectors(fx))
    scales = weights.gradient_scales(vectors, "field")
    compared = weights.gradient_disagreement(vectors, scales, "field", "prior")
    counts = weights.source_coverage(compared, [], "field").withColumnRenamed("n_months", "comparisons")
    return counts.join(scales.withColumnRenamed("q", "scale"), "field")


@query(
    "agg_source_histogram",
    "n_sources:i n_cells:i share:f",
    f"""WITH {GRAD_SQL},
{COVER},
h AS (SELECT iy, ix, coalesce(n,0) AS n_sources FROM fx_cells LEFT JOIN (SELECT iy, ix, count(*) AS n FROM cov
 WHERE n_months>0 GROUP BY iy, ix) USING (iy, ix) WHERE land)
--
SELECT n_sources, count(*) AS n_cells, count(*)/(SELECT count(*) FROM h) AS share FROM h GROUP BY n_sources""",
)
def source_histogram(fx: Fixtures):
    return weights.source_histogram(source_coverage(fx), fx.cells.where("land"), ["iy", "ix"])


@query(
    "agg_leave_one_out",
    "left_out:s mae:f rho:f n:i",
    f"""WITH {BETA_SQL},
o AS (SELECT o.o AS left_out, t, iy, ix, median(d) AS d FROM d, (SELECT unnest(['s1','s2','s3']) AS o) o WHERE d.field<>o.o GROUP BY ALL),
ob AS (SELECT left_out, iy, ix, 1-median(d) AS part FROM o GROUP BY ALL),
p AS (SELECT left_out, beta AS f, coalesce(part,0) AS p FROM beta CROSS JOIN (SELECT unnest(['s1','s2','s3']) AS left_out)
 LEFT JOIN ob USING (left_out, iy, ix)),
r AS (SELECT *, {sql_rank("f", "left_out")} AS rf, {sql_rank("p", "left_out")} AS rp FROM p)
--
SELECT left_out, avg(abs(p-f)) AS mae, {sql_corr("rf", "rp")} AS rho, count(*) AS n FROM r GROUP BY left_out""",
)
def leave_one_out(fx: Fixtures):
    return weights.leave_one_out(pinned(_disagreements(fx)), ["s1", "s2", "s3"], fx.cells.where("land"), ["iy", "ix"])


STRATA_SQL = """(VALUES ('global_land'),('arid'),('humid'),('glacier_influenced'),('non_glacier'),('high_human_activity'),
 ('low_human_activity'),('arid_glacier'),('arid_human')) r(region) ON land AND CASE region WHEN 'arid' THEN aridity>=.5
 WHEN 'humid' THEN aridity<=.1 WHEN 'glacier_influenced' THEN glacier>=.01 WHEN 'non_glacier' THEN glacier<.001
 WHEN 'high_human_activity' THEN human>=.05 WHEN 'low_human_activity' THEN human<=.001
 WHEN 'arid_glacier' THEN aridity>=.5 AND glacier>=.01 WHEN 'arid_human' THEN aridity>=.5 AND human>=.05 ELSE true END"""


@query(
    "agg_weight_strata",
    "region:s n_cells:i original:f adjusted:f",
    f"""WITH {ALPHA_SQL},
w AS (SELECT c.*, 1-disagreement AS original, (1-disagreement)*(1-least(.95, .5e0*glacier))*(1-least(.95e0, .3e0*greatest(0, (aridity-.5e0)/.5e0)))
 AS adjusted FROM fx_cells c JOIN alpha USING (cy, cx))
--
SELECT region, count(*) AS n_cells, avg(original) AS original, avg(adjusted) AS adjusted FROM w JOIN {STRATA_SQL}
 WHERE region IN ('global_land','arid','humid','glacier_influenced','high_human_activity','low_human_activity') GROUP BY region""",
)
def weight_strata(fx: Fixtures):
    joined = fx.cells.join(_alpha(fx).withColumnRenamed("alpha", "original"), BLOCK)
    adjusted = weights.regional_adjust(
        F.col("original"), F.col("glacier"), F.col("aridity"), F.col("human"), {"glacier": 0.5, "arid": 0.3}
    )
    six = ("global_land", "arid", "humid", "glacier_influenced", "high_human_activity", "low_human_activity")
    strata = {n: c for n, c in masks.named_regions().items() if n in six}
    return masks.explode_strata(joined.withColumn("adjusted", adjusted), strata).groupBy("region").agg(
        F.count("*").alias("n_cells"), F.avg("original").alias("original"), F.avg("adjusted").alias("adjusted")
    )


@query(
    "agg_field_profile",
    "field:s n_finite:i n_null:i n_inf:i low:f high:f mean:f median:f",
    """SELECT field, count(value) FILTER (NOT isinf(value)) AS n_finite, (SELECT count(*) FROM fx_field)-count(value) AS n_null,
 count(*) FILTER (isinf(value)) AS n_inf, min(value) AS low,
 max(value) AS high, avg(value) AS mean, median(value) AS median FROM fx_field_long GROUP BY field""",
)
def field_profile(fx: Fixtures):
    from isopleth.functions.stats import exact_median

    long = fx.field.unpivot(["t", "iy", "ix"], ["prior", "obs", "s1", "s2", "s3"], "field", "value")
    base = long.groupBy("field").agg(
        F.count_if(F.abs("value") < F.lit(float("inf"))).alias("n_finite"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if(F.abs("value") == F.lit(float("inf"))).alias("n_inf"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
    )
    return base.join(exact_median(long, ["field"], "value", "median"), "field")


@query(
    "agg_dataset_summary",
    "train_months:i val_months:i test_months:i first_month:d last_month:d valid_fraction:f basin_fraction:f",
    """SELECT (SELECT count(*) FROM fx_split WHERE split=0) AS train_months, (SELECT count(*) FROM fx_split WHERE split=1) AS val_months,
 (SELECT count(*) FROM fx_split WHERE split=2) AS test_months, min(t) AS first_month, max(t) AS last_month,
 avg(CASE WHEN valid THEN 1e0 ELSE 0 END) AS valid_fraction,
 (SELECT avg(CASE WHEN basin_id>0 THEN 1e0 ELSE 0 END) FROM fx_cells) AS basin_fraction FROM fx_valid""",
)
def dataset_summary(fx: Fixtures):
    months = fx.split.agg(
        *[F.count_if(F.col("split") == i).alias(n) for i, n in enumerate(["train_months", "val_months", "test_months"])]
    )
    counts = months.select(F.struct("*").alias("s"))
    basin = fx.cells.agg(F.avg((F.col("basin_id") > 0).cast("double")).alias("b"))
    return fx.valid.agg(
        F.min("t").alias("first_month"),
        F.max("t").alias("last_month"),
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"),
    ).withColumns({"_s": scalar(counts), "basin_fraction": scalar(basin)}).select("*", "_s.*")
