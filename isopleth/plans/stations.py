"""Station periods, eligibility, gridding and station skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions.stats import exact_median
from isopleth.operators import bootstrap, skill, stations
from isopleth.plans.fixtures import REPLICATES, SEED, Fixtures, sql_corr, sql_draw
from isopleth.plans.registry import query
from isopleth.session import pinned


@query(
    "st_site_month",
    "site:s t:d median:f mean:f lat:f lon:f n:i",
    """SELECT site, CAST(ts AS DATE) AS t, median(storage) AS median, avg(storage) AS mean, median(lat) AS lat, median(lon) AS lon, count(*) AS n
 FROM fx_station_qc WHERE reason='kept' GROUP BY ALL""",
)
def site_month(fx: Fixtures):
    kept = stations.qc_filter(fx.station_raw, "2024-01-01", "2024-12-31").where("reason = 'kept'")
    day = F.col("ts").cast("date")
    strict = stations.station_period(kept, day, "median").withColumnRenamed("value", "median")
    plain = stations.station_period(kept, day, "mean").select("site", "t", F.col("value").alias("mean"))
    return strict.join(plain, ["site", "t"]).withColumnRenamed("n_records", "n")


@query(
    "st_eligibility",
    "site:s lat:f lon:f n_periods:i sd:f iy:i ix:i block:i land:b inside_cell:b eligible:b",
    "SELECT * FROM fx_sites",
)
def eligibility(fx: Fixtures):
    return fx.sites


@query("st_standardize", "site:s t:d iy:i ix:i block:i z:f", "SELECT * FROM fx_site_z")
def standardize(fx: Fixtures):
    return fx.site_z


@query("st_grid_median", "block:i iy:i ix:i t:d obs:f n_sites:i", "SELECT * FROM fx_grid_obs")
def grid_median(fx: Fixtures):
    return fx.grid_obs


@query(
    "st_dense_calendar",
    "block:i iy:i ix:i t:d obs:f n_sites:i n_total:i",
    """WITH c AS (SELECT block, iy, ix, count(*) AS n_total FROM fx_sites WHERE eligible GROUP BY ALL),
d AS (SELECT c.*, u.t FROM c, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS t) u)
--
SELECT d.block, d.iy, d.ix, d.t, obs, coalesce(n_sites,0) AS n_sites, n_total FROM d LEFT JOIN fx_grid_obs g ON g.iy=d.iy AND g.ix=d.ix AND g.t=d.t""",
)
def dense_calendar(fx: Fixtures):
    return stations.dense_calendar(fx.grid_obs, fx.sites, "2024-01-01", "2024-01-31", "1 day")


DAYNUM = "date_diff('day', DATE '2000-01-01', t)"


def _day_number():
    return F.datediff("t", F.lit("2000-01-01").cast("date"))


def _joined(fx: Fixtures):
    """Site series next to every corrected model at the site's cell."""
    sites = fx.sites.select("site", "iy", "ix", "block")
    model = fx.station_model.where("variant = 'corrected'").select(
        "t", "iy", "ix", F.col("model").alias("source"), F.col("value").alias("m")
    )
    return fx.days.select("site", "t", F.col("value").alias("o")).join(sites, "site").join(model, ["t", "iy", "ix"])


JOINED_SQL = """jn AS (SELECT d.site, d.t, d.value AS o, s.iy, s.ix, s.block, m.model AS source, m.value AS m FROM fx_station_day d
 JOIN fx_sites s USING (site) JOIN fx_station_model m ON m.t=d.t AND m.iy=s.iy AND m.ix=s.ix WHERE variant='corrected')"""
SKILL_SQL = f"""{JOINED_SQL},
zz AS (SELECT *, count(*) OVER w AS n, (m-avg(m) OVER w)/nullif(stddev_pop(m) OVER w,0) AS zm, (o-avg(o) OVER w)/nullif(stddev_pop(o) OVER w,0) AS zo, {DAYNUM} AS dn
 FROM jn WINDOW w AS (PARTITION BY site, source)),
df AS (SELECT *, CASE WHEN dn-lag(dn) OVER w=1 THEN zm-lag(zm) OVER w END AS dm, CASE WHEN dn-lag(dn) OVER w=1 THEN zo-lag(zo) OVER w END AS do_
 FROM zz WHERE n>=12 WINDOW w AS (PARTITION BY site, source ORDER BY dn)),
fd AS (SELECT site, source, {sql_corr("dm", "do_")} AS fdr FROM df WHERE dm IS NOT NULL AND do_ IS NOT NULL GROUP BY site, source),
sk AS (SELECT site, source, min(block) AS block, min(iy*24+ix) AS cell, count(*) AS n_overlap, {sql_corr("zm", "zo")} AS pearson_r, regr_slope(zm, dn)*365 AS model_trend,
 regr_slope(zo, dn)*365 AS site_trend FROM df GROUP BY site, source),
ss AS (SELECT sk.*, CASE WHEN n_overlap>=4 THEN fdr END AS first_difference_r, CASE WHEN sign(model_trend)=sign(site_trend) THEN 1 ELSE 0 END AS trend_sign_match,
 'R'||(block%3) AS region FROM sk LEFT JOIN fd USING (site, source))"""


def _skill(fx: Fixtures):
    scored = stations.site_skill(_joined(fx), ["site", "source"], "m", "o", 12, _day_number(), 365.0)
    place = fx.sites.select(
        "site", (F.col("iy") * 24 + F.col("ix")).alias("cell"), F.concat(F.lit("R"), F.col("block") % 3).alias("region")
    )
    return pinned(scored.join(place, "site"))


@query(
    "st_site_skill",
    "site:s source:s n_overlap:i pearson_r:f first_difference_r:f model_trend:f site_trend:f trend_sign_match:i",
    f"WITH {SKILL_SQL}\n--\nSELECT * FROM ss",
)
def site_skill(fx: Fixtures):
    return _skill(fx)


@query(
    "st_first_diff_corr",
    "site:s source:s first_difference_r:f n:i",
    f"""WITH {JOINED_SQL},
df AS (SELECT *, CASE WHEN {DAYNUM}-lag({DAYNUM}) OVER w=1 THEN m-lag(m) OVER w END AS dm, CASE WHEN {DAYNUM}-lag({DAYNUM}) OVER w=1 THEN o-lag(o) OVER w END AS do_
 FROM jn WINDOW w AS (PARTITION BY site, source ORDER BY t)),
fd AS (SELECT site, source, {sql_corr("dm", "do_")} AS r FROM df WHERE dm IS NOT NULL GROUP BY site, source)
--
SELECT site, source, CASE WHEN n>=4 THEN r END AS first_difference_r, n FROM (SELECT site, source, count(*) AS n FROM df GROUP BY ALL) LEFT JOIN fd USING (site, source)""",
)
def first_diff_corr(fx: Fixtures):
    return stations.first_difference_corr(_joined(fx), ["site", "source"], "m", "o", _day_number())


CELL_SQL = """cs AS (SELECT region, source, cell, median(pearson_r) AS pearson_r, median(first_difference_r) AS first_difference_r,
 avg(trend_sign_match) AS trend_sign_match FROM (SELECT * FROM ss UNION ALL BY NAME SELECT * REPLACE ('ALL' AS region) FROM ss) GROUP BY ALL)"""


@query(
    "st_cell_summary",
    "region:s source:s n_sites:i n_cells:i median_pearson_r:f median_first_difference_r:f mean_sign_match:f",
    f"""WITH {SKILL_SQL},
{CELL_SQL},
ns AS (SELECT coalesce(region,'ALL') AS region, source, count(DISTINCT site) AS n_sites FROM ss GROUP BY GROUPING SETS ((region, source), (source)))
--
SELECT region, source, max(n_sites) AS n_sites, count(*) AS n_cells, median(pearson_r) AS median_pearson_r, median(first_difference_r) AS median_first_difference_r,
 avg(trend_sign_match) AS mean_sign_match FROM cs JOIN ns USING (region, source) GROUP BY region, source""",
)
def cell_summary(fx: Fixtures):
    return stations.region_summary(_skill(fx))


def _cell_interval_sql(name: str, column: str, seed: int) -> str:
    return f"""{name}_cv AS (SELECT region, source, cell, {column} AS v, row_number() OVER (PARTITION BY region, source ORDER BY cell)-1 AS idx, count(*) OVER (PARTITION BY region, source) AS n
 FROM cs WHERE {column} IS NOT NULL),
{name}_dr AS (SELECT region, source, b, {sql_draw("b", "idx", "n", seed)} AS pick FROM {name}_cv, (SELECT unnest(range(0,{REPLICATES})) AS b)),
{name}_rp AS (SELECT d.region, d.source, b, median(v) AS s FROM {name}_dr d JOIN {name}_cv c ON c.region=d.region AND c.source=d.source AND c.idx=d.pick GROUP BY ALL),
{name}_ci AS (SELECT region, source, quantile_cont(s,.025) AS lower, quantile_cont(s,.975) AS upper FROM {name}_rp GROUP BY ALL),
{name} AS (SELECT '{column}' AS statistic, region, source, n_cells, median, CASE WHEN n_cells>1 THEN lower END AS lower, CASE WHEN n_cells>1 THEN upper END AS upper
 FROM (SELECT region, source, count(*) AS n_cells, median(v) AS median FROM {name}_cv GROUP BY ALL) JOIN {name}_ci USING (region, source))"""


@query(
    "bs_cell_median",
    "statistic:s region:s source:s n_cells:i median:f lower:f upper:f",
    f"""WITH {SKILL_SQL},
{CELL_SQL},
{_cell_interval_sql("cell_pe", "pearson_r", SEED)},
{_cell_interval_sql("cell_fd", "first_difference_r", SEED + 1)}
--
SELECT * FROM cell_pe UNION ALL SELECT * FROM cell_fd""",
)
def cell_median(fx: Fixtures):
    """Intervals of both medians of the cell summary, with a seed each."""
    expanded = _skill(fx).withColumn("region", F.explode(F.array(F.col("region"), F.lit("ALL"))))
    keys = ["region", "source"]
    out = None
    for i, c in enumerate(("pearson_r", "first_difference_r")):
        cells = pinned(exact_median(expanded, [*keys, "cell"], c, c))
        part = bootstrap.cell_median(cells, keys, "cell", c, REPLICATES, SEED + i).withColumn("statistic", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "st_groundwater_grid",
    "iy:i ix:i model:s pcc:f n_sites:i",
    f"""WITH b AS (SELECT t, iy, ix, value AS total, value*0.4e0 AS part FROM fx_station_model WHERE model='M0' AND variant='raw'),
sp AS (SELECT d.site, s.iy, s.ix, m.model, m.value-(total-part) AS v, d.value AS o FROM fx_station_day d JOIN fx_sites s USING (site)
 JOIN fx_station_model m ON m.t=d.t AND m.iy=s.iy AND m.ix=s.ix JOIN b ON b.t=d.t AND b.iy=s.iy AND b.ix=s.ix WHERE variant='corrected'),
c AS (SELECT site, iy, ix, model, {sql_corr("v", "o", 1)} AS pcc FROM sp GROUP BY ALL HAVING count(*)>=12),
k AS (SELECT site FROM c WHERE pcc IS NOT NULL GROUP BY site HAVING count(*)=5)
--
SELECT iy, ix, model, median(pcc) AS pcc, count(*) AS n_sites FROM c SEMI JOIN k USING (site) GROUP BY iy, ix, model""",
)
def groundwater_grid(fx: Fixtures):
    base = fx.station_model.where("model = 'M0' AND variant = 'raw'").select(
        "t", "iy", "ix", F.col("value").alias("total"), (F.col("value") * 0.4).alias("part")
    )
    rows = _joined(fx).join(base, ["t", "iy", "ix"]).withColumn(
        "v", stations.separated(F.col("m"), F.col("total"), F.col("part"))
    )
    per = skill.per_cell_correlation(rows, ["site", "iy", "ix", "source"], "v", "o", 12)
    full = per.groupBy("site").agg(F.count("*").alias("n")).where("n = 5")
    kept = pinned(per.join(full, "site", "left_semi").withColumnRenamed("source", "model"))
    keys = ["iy", "ix", "model"]
    return exact_median(kept, keys, "pcc", "pcc").join(kept.groupBy(*keys).agg(F.count("*").alias("n_sites")), keys)
