"""Within-block contrasts, bootstrap and stratified gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions import geo
from isopleth.operators import bootstrap, pairs, strata
from isopleth.plans.fixtures import MAIN_COMMON, MODELS, REPLICATES, SEED, Fixtures, sql_draw
from isopleth.plans.registry import query
from isopleth.plans.skill import WIDE_SQL, frame
from isopleth.session import pinned

PAIR_COLS = "block:i iy_i:i ix_i:i iy_j:i ix_j:i"
OTHERS = MODELS[:-1]
BEST = MODELS[-1]


@query(
    "pr_contrast_metrics",
    f"{PAIR_COLS} model:s variant:s n_common:i pearson_r:f spearman_rho:f sign_agreement:f",
    "SELECT * FROM fx_pair_metrics",
)
def contrast_metrics(fx: Fixtures):
    return fx.pair_metrics


@query(
    "pr_excluded",
    f"{PAIR_COLS} reason:s",
    """WITH c AS (SELECT DISTINCT block, iy, ix FROM fx_sites WHERE eligible),
p AS (SELECT a.block, a.iy AS iy_i, a.ix AS ix_i, b.iy AS iy_j, b.ix AS ix_j FROM c a JOIN c b ON a.block=b.block AND (a.iy<b.iy OR (a.iy=b.iy AND a.ix<b.ix))),
r AS (SELECT block, iy_i, ix_i, iy_j, ix_j, max(reason) AS reason, count(*) AS n FROM fx_pair_rows GROUP BY ALL)
--
SELECT p.*, CASE WHEN n IS NULL THEN 'insufficient_common_months' ELSE reason END AS reason FROM p LEFT JOIN r USING (block, iy_i, ix_i, iy_j, ix_j)
 WHERE n IS NULL OR reason IS NOT NULL""",
)
def excluded(fx: Fixtures):
    cells = fx.sites.where("eligible").select("block", "iy", "ix").distinct()
    return pairs.excluded(cells, fx.pair_rows)


@query(
    "pr_obs_zero_months",
    f"{PAIR_COLS} obs_zero:i beta_pair:f common_periods:s",
    "SELECT * FROM fx_pair_metrics WHERE model='M0' AND variant='corrected'",
)
def obs_zero_months(fx: Fixtures):
    return fx.pair_metrics.where("model = 'M0' AND variant = 'corrected'")


LEVELS = [12, 16, 20]


@query(
    "pr_threshold_views",
    "variant:s threshold:i n_blocks:i n_pairs:i n_cells:i n_sites:i",
    """WITH o AS (SELECT variant, k AS threshold, block, iy_i, ix_i, iy_j, ix_j FROM fx_pair_metrics, (SELECT unnest([12,16,20]) AS k) WHERE model='M0' AND n_common>=k),
c AS (SELECT DISTINCT variant, threshold, iy_i AS iy, ix_i AS ix FROM o UNION SELECT DISTINCT variant, threshold, iy_j, ix_j FROM o),
s AS (SELECT iy, ix, count(*) AS n FROM fx_sites WHERE eligible GROUP BY ALL),
q AS (SELECT variant, threshold, count(*) AS n_cells, sum(n) AS n_sites FROM c JOIN s USING (iy, ix) GROUP BY ALL)
--
SELECT variant, threshold, count(DISTINCT block) AS n_blocks, count(*) AS n_pairs, max(n_cells) AS n_cells, max(n_sites) AS n_sites FROM o JOIN q USING (variant, threshold) GROUP BY ALL""",
)
def threshold_views(fx: Fixtures):
    sites = fx.sites.where("eligible").groupBy("iy", "ix").agg(F.count("*").alias("n_total"))
    return pairs.thresholds(fx.pair_metrics, LEVELS, sites)


@query(
    "pr_block_summary",
    "block:i model:s n_pairs:i n_cells:i median_pcc:f median_spearman:f median_sign:f",
    "SELECT * FROM fx_block_medians",
)
def block_summary(fx: Fixtures):
    return fx.block_medians


GAIN_COLS = [f"{m}_gain_{o}" for m in ("pcc", "spearman", "sign") for o in OTHERS]


@query(
    "pr_block_gains",
    "block:i " + " ".join(f"{c}:f" for c in GAIN_COLS),
    "SELECT block, "
    + ", ".join(
        f"max(median_{m}) FILTER (model='M4')-max(median_{m}) FILTER (model='{o}') AS {m}_gain_{o}"
        for m in ("pcc", "spearman", "sign")
        for o in OTHERS
    )
    + " FROM fx_block_medians GROUP BY block",
)
def block_gains(fx: Fixtures):
    return pairs.gains(fx.block_medians, MODELS, BEST)


METRICS = ("pcc", "spearman", "sign")


def _series(fx: Fixtures):
    """One value per (metric, comparison, block): medians and gains."""
    medians = fx.block_medians.unpivot(
        ["block", "model"], [f"median_{m}" for m in METRICS], "metric", "value"
    ).select(F.regexp_replace("metric", "median_", "").alias("metric"), F.col("model").alias("comparison"), "block", "value")
    gains = block_gains(fx).unpivot(["block"], GAIN_COLS, "name", "value").select(
        F.split_part("name", F.lit("_gain_"), F.lit(1)).alias("metric"),
        F.concat(F.lit("M4-"), F.split_part("name", F.lit("_gain_"), F.lit(2))).alias("comparison"),
        "block",
        "value",
    )
    return pinned(medians.unionByName(gains))


SERIES_SQL = """lm AS (SELECT block, model, metric, value FROM (SELECT block, model, median_pcc AS pcc, median_spearman AS spearman, median_sign AS sign FROM fx_block_medians)
 UNPIVOT (value FOR metric IN (pcc, spearman, sign))),
sr AS (SELECT metric, model AS comparison, block, value FROM lm UNION ALL SELECT a.metric, 'M4-'||a.model, a.block, b.value-a.value FROM lm a JOIN lm b
 ON a.block=b.block AND a.metric=b.metric WHERE a.model<>'M4' AND b.model='M4')"""


def _cluster_sql(unit: str) -> str:
    return f"""WITH {SERIES_SQL},
u AS (SELECT unit, row_number() OVER (ORDER BY unit)-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} AS unit FROM sr)),
dr AS (SELECT b, {sql_draw("b", "idx", "n")} AS pick FROM u, (SELECT unnest(range(0,{REPLICATES})) AS b)),
rp AS (SELECT metric, comparison, b, median(value) AS md, avg(CASE WHEN value>0 THEN 1e0 ELSE 0 END) AS sh FROM dr JOIN u ON u.idx=pick JOIN sr ON {unit}=u.unit GROUP BY ALL),
ci AS (SELECT metric, comparison, quantile_cont(md,.025) AS median_lower, quantile_cont(md,.975) AS median_upper, quantile_cont(sh,.025) AS share_lower,
 quantile_cont(sh,.975) AS share_upper FROM rp GROUP BY ALL),
es AS (SELECT metric, comparison, median(value) AS median, avg(CASE WHEN value>0 THEN 1e0 ELSE 0 END) AS share, count(*) AS n_values, (SELECT max(n) FROM u) AS n_units FROM sr GROUP BY ALL)
--
SELECT metric, comparison, median, share, n_values, n_units, CASE WHEN n_units>1 THEN median_lower END AS median_lower, CASE WHEN n_units>1 THEN median_upper END AS median_upper,
 CASE WHEN n_units>1 THEN share_lower END AS share_lower, CASE WHEN n_units>1 THEN share_upper END AS share_upper FROM es JOIN ci USING (metric, comparison)"""


CLUSTER_COLS = "metric:s comparison:s median:f share:f n_values:i n_units:i median_lower:f median_upper:f share_lower:f share_upper:f"


@query("bs_cluster", CLUSTER_COLS, _cluster_sql("block"))
def cluster(fx: Fixtures):
    return bootstrap.cluster_statistics(_series(fx), ["metric", "comparison"], "block", REPLICATES, SEED)


@query("bs_block_of_blocks", CLUSTER_COLS, _cluster_sql("((block//8)//2*4+(block%8)//2)"))
def block_of_blocks(fx: Fixtures):
    rows = _series(fx).withColumn("quad", geo.quad_block_id("block", fx.grid.block_columns))
    return bootstrap.cluster_statistics(rows, ["metric", "comparison"], "block", REPLICATES, SEED, group="quad")


def _frame(fx: Fixtures):
    return pinned(frame(fx).withColumn("bin", geo.box_id("lat", "lon", 30.0)))


def _paired_sql(keys: str, src: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    on = "".join(f"a.{c.strip()}=p.{c.strip()} AND " for c in keys.split(",") if c.strip())
    using = f"USING ({keys})"
    return f"""df AS (SELECT {k}bin, d FROM {src}),
un AS (SELECT {k}bin, row_number() OVER ({part}ORDER BY bin)-1 AS idx, count(*) OVER ({part.strip()}) AS n FROM (SELECT DISTINCT {k}bin FROM df)),
dr AS (SELECT {k}b, {sql_draw("b", "idx", "n")} AS pick FROM un, (SELECT unnest(range(0,{REPLICATES})) AS b)),
rp AS (SELECT {"".join(f"p.{c.strip()}, " for c in keys.split(",") if c.strip())}b, median(d) AS s FROM dr p JOIN un a ON {on}a.idx=p.pick JOIN df x ON {on.replace("p.", "x.")}x.bin=a.bin GROUP BY ALL),
ci AS (SELECT {k}quantile_cont(s,.025) AS lower, quantile_cont(s,.975) AS upper FROM rp GROUP BY ALL),
nb AS (SELECT {k}max(n) AS n_blocks FROM un GROUP BY ALL),
es AS (SELECT {k}count(*) AS n_grid, median(d) AS median, avg(CASE WHEN d>0 THEN 1e0 ELSE 0 END) AS positive_fraction, avg(CASE WHEN d<0 THEN 1e0 ELSE 0 END) AS negative_fraction
 FROM df GROUP BY ALL),
fin AS (SELECT {k}n_grid, n_blocks, median, positive_fraction, negative_fraction, CASE WHEN n_blocks>1 THEN lower END AS lower, CASE WHEN n_blocks>1 THEN upper END AS upper
 FROM es JOIN ci {using} JOIN nb {using})"""


LONG_SQL = f"""fb AS (SELECT *, floor((lat+90)/30)*12+floor((lon+180)/30) AS bin FROM frame),
lg AS (SELECT alpha_bin, beta_bin, bin, 'M4-'||o AS comparison, M4-CASE o WHEN 'M0' THEN M0 WHEN 'M1' THEN M1 WHEN 'M2' THEN M2 ELSE M3 END AS d
 FROM fb, (SELECT unnest(['M0','M1','M2','M3']) AS o))"""
PAIRED_COLS = "n_grid:i n_blocks:i median:f positive_fraction:f negative_fraction:f lower:f upper:f"


@query(
    "bs_paired_blocks",
    f"comparison:s {PAIRED_COLS}",
    f"WITH {WIDE_SQL},\n{LONG_SQL},\n{_paired_sql('comparison', 'lg')}\n--\nSELECT * FROM fin",
)
def paired_blocks(fx: Fixtures):
    rows = pinned(strata.long_gains(_frame(fx), ["bin"], BEST, OTHERS))
    return bootstrap.paired_blocks(rows, ["comparison"], "best", "other", "bin", REPLICATES, SEED)


@query(
    "sg_joint_strata",
    f"alpha_bin:i beta_bin:i comparison:s {PAIRED_COLS}",
    f"WITH {WIDE_SQL},\n{LONG_SQL},\n{_paired_sql('alpha_bin, beta_bin, comparison', 'lg')}\n--\nSELECT * FROM fin",
)
def joint_strata(fx: Fixtures):
    rows = pinned(strata.long_gains(_frame(fx), ["bin", "alpha_bin", "beta_bin"], BEST, OTHERS))
    return bootstrap.paired_blocks(rows, ["alpha_bin", "beta_bin", "comparison"], "best", "other", "bin", REPLICATES, SEED)


@query("bs_beta_association", "statistic:s estimate:f lower:f upper:f n:i n_blocks:i status:s")
def beta_association(fx: Fixtures):
    kept = fx.pair_metrics.where(F.col("variant") == "corrected").where(F.col("n_common") >= MAIN_COMMON)
    wide = kept.groupBy(*pairs.PAIR).agg(
        F.max("beta_pair").alias("beta"),
        (
            F.max(F.when(F.col("model") == BEST, F.col("pearson_r")))
            - F.max(F.when(F.col("model") == "M0", F.col("pearson_r")))
        ).alias("gain"),
    )
    return bootstrap.association(wide, "block", "beta", "gain", REPLICATES, SEED)


@query(
    "sg_marginal_strata",
    "kind:s bin:i median:f n:i",
    f"""WITH {WIDE_SQL}
--
SELECT 'alpha' AS kind, alpha_bin AS bin, median(M4-M1) AS median, count(*) AS n FROM frame GROUP BY 2 UNION ALL SELECT 'beta', beta_bin, median(M4-M1), count(*) FROM frame GROUP BY 2""",
)
def marginal_strata(fx: Fixtures):
    from isopleth.functions.stats import exact_median

    classes = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_bin").alias("bin")) for k in ("alpha", "beta")]
    )
    rows = pinned(frame(fx).select((F.col(BEST) - F.col("M1")).alias("gain"), F.explode(classes).alias("c")).select("gain", "c.*"))
    keys = ["kind", "bin"]
    return exact_median(rows, keys, "gain", "median").join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)


REGION_SQL = f"""{WIDE_SQL},
bx AS (SELECT *, CAST(floor((lat+90)/45) AS INT) AS ry, CAST(floor((lon+180)/45) AS INT) AS rx FROM frame),
rg AS (SELECT ry, rx, count(*) AS n_cells, {", ".join(f"median(M4-{m}) AS gain_{m}" for m in OTHERS)}, median(alpha) AS median_alpha, median(beta) AS median_beta,
 median(human) AS median_human FROM bx GROUP BY ry, rx HAVING count(*)>=5),
rk AS (SELECT *, least({", ".join(f"gain_{m}" for m in OTHERS)}) AS s_min, row_number() OVER (ORDER BY least({", ".join(f"gain_{m}" for m in OTHERS)}) DESC, ry, rx) AS rank FROM rg),
sl AS ((SELECT * FROM rk WHERE s_min>0 ORDER BY rank LIMIT 2) UNION ALL (SELECT * FROM rk WHERE s_min<0 ORDER BY rank DESC LIMIT 1))"""


def _regions(fx: Fixtures):
    boxed = frame(fx).withColumns({"ry": geo.box_index("lat", -90.0, 45.0), "rx": geo.box_index("lon", -180.0, 45.0)})
    return strata.regions(boxed, ["ry", "rx"], BEST, OTHERS, ["alpha", "beta", "human"], 5)


REGION_COLS = "ry:i rx:i n_cells:i " + " ".join(f"gain_{m}:f" for m in OTHERS) + " s_min:f rank:i median_alpha:f median_beta:f median_human:f"


@query("sg_regions", REGION_COLS, f"WITH {REGION_SQL}\n--\nSELECT * FROM rk")
def regions(fx: Fixtures):
    return _regions(fx)


@query("sg_top_bottom", REGION_COLS, f"WITH {REGION_SQL}\n--\nSELECT * FROM sl")
def top_bottom(fx: Fixtures):
    return strata.top_and_bottom(pinned(_regions(fx)))


@query(
    "sg_case_series",
    "ry:i rx:i model:s t:d mean:f standardized:f",
    f"""WITH {REGION_SQL},
ex AS (SELECT CAST(floor((e.lat+90)/45) AS INT) AS ry, CAST(floor((e.lon+180)/45) AS INT) AS rx, model, t, value, smap FROM fx_external e JOIN frame f USING (iy, ix)),
al AS (SELECT ry, rx, model, t, value FROM ex UNION ALL SELECT ry, rx, 'external', t, smap FROM ex WHERE model='M0'),
mn AS (SELECT ry, rx, model, t, avg(value) AS mean FROM al JOIN sl USING (ry, rx) GROUP BY ALL)
--
SELECT *, (mean-avg(mean) OVER w)/nullif(stddev_pop(mean) OVER w,0) AS standardized FROM mn WINDOW w AS (PARTITION BY ry, rx, model)""",
)
def case_series(fx: Fixtures):
    chosen = strata.top_and_bottom(pinned(_regions(fx))).select("ry", "rx")
    cells = frame(fx).select("iy", "ix")
    rows = fx.external.join(cells, ["iy", "ix"], "left_semi").withColumns(
        {"ry": geo.box_index("lat", -90.0, 45.0), "rx": geo.box_index("lon", -180.0, 45.0)}
    ).join(chosen, ["ry", "rx"], "left_semi")
    own = rows.where("model = 'M0'").select("ry", "rx", F.lit("external").alias("model"), "t", F.col("smap").alias("value"))
    both = rows.select("ry", "rx", "model", "t", "value").unionByName(own)
    tagged = both.withColumn("region", F.struct("ry", "rx"))
    return strata.case_series(tagged, "region", "value").select("region.*", "model", "t", "mean", "standardized")


@query(
    "sg_case_subgrid",
    "ry:i rx:i local_y:i local_x:i gain:f",
    f"""WITH {REGION_SQL}
--
SELECT ry, rx, CAST(floor((lat-(ry*45-90))/15) AS INT) AS local_y, CAST(floor((lon-(rx*45-180))/15) AS INT) AS local_x, M4-M1 AS gain FROM bx SEMI JOIN sl USING (ry, rx)""",
)
def case_subgrid(fx: Fixtures):
    f = pinned(frame(fx))
    boxed = f.withColumns({"ry": geo.box_index("lat", -90.0, 45.0), "rx": geo.box_index("lon", -180.0, 45.0)})
    ranked = strata.regions(boxed, ["ry", "rx"], BEST, OTHERS, ["alpha", "beta", "human"], 5)
    chosen = strata.top_and_bottom(pinned(ranked)).select("ry", "rx")
    local = fx.grid
    return boxed.join(chosen, ["ry", "rx"], "left_semi").select(
        "ry",
        "rx",
        F.floor((F.col("lat") - (F.col("ry") * 45 - 90)) / local.dlat).alias("local_y"),
        F.floor((F.col("lon") - (F.col("rx") * 45 - 180)) / local.dlon).alias("local_x"),
        (F.col(BEST) - F.col("M1")).alias("gain"),
    )
