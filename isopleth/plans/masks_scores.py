"""Masks, strata, scores, data contracts and observation quality control."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from isopleth.functions import time
from isopleth.operators import conserve, guards, masks, stations, weights
from isopleth.plans.fixtures import DIVISOR, GRID, TRAIN_END, Fixtures, dyadic
from isopleth.plans.registry import query
from isopleth.plans.time_series import ALPHA_SQL, STRATA_SQL, _alpha


@query("mask_valid_cell", "t:d iy:i ix:i valid:b", "SELECT t, iy, ix, valid FROM fx_valid")
def valid_cell(fx: Fixtures):
    return fx.valid


@query(
    "mask_zero_fill",
    "t:d iy:i ix:i dynamic:f static:f",
    """SELECT t, iy, ix, CASE WHEN valid THEN coalesce(s3,0) ELSE 0 END AS dynamic, CASE WHEN land THEN glacier ELSE 0 END AS static
 FROM fx_valid""",
)
def zero_fill(fx: Fixtures):
    return fx.valid.withColumns(
        {"dynamic": masks.zero_filled("s3", "valid"), "static": masks.zero_filled("glacier", "land")}
    )


@query(
    "mask_common_support",
    "t:d iy:i ix:i coarse_common:b",
    """WITH s AS (SELECT t, iy, ix FROM fx_model JOIN fx_valid USING (t, iy, ix) WHERE valid GROUP BY t, iy, ix
 HAVING count(DISTINCT model||variant)=10),
c AS (SELECT t, iy//3 AS cy, ix//3 AS cx FROM s GROUP BY ALL HAVING sum(cos(radians(-82.5e0+15*iy)))>1)
--
SELECT s.t, iy, ix, c.t IS NOT NULL AS coarse_common FROM s LEFT JOIN c ON s.t=c.t AND cy=iy//3 AND cx=ix//3""",
)
def common_support(fx: Fixtures):
    ok = fx.valid.where("valid").select("t", "iy", "ix")
    rows = fx.model.join(ok, ["t", "iy", "ix"], "left_semi")
    fine = masks.common_support(rows, ["t", "iy", "ix"], ["model", "variant"], "value", 10)
    weighted = conserve.with_block(fine, fx.grid).withColumn("w", F.cos(F.radians(fx.grid.lat())))
    coarse = weighted.groupBy("t", "cy", "cx").agg(F.sum("w").alias("w")).where("w > 1")
    return weighted.join(coarse.select("t", "cy", "cx", F.lit(True).alias("c")), ["t", "cy", "cx"], "left").withColumn(
        "coarse_common", F.coalesce("c", F.lit(False))
    )


@query(
    "mask_external_eval",
    "t:d n_cells:i obs:f",
    """SELECT t, count(*) AS n_cells, avg(obs) AS obs FROM fx_valid WHERE land AND glacier<=.05 AND human<=.5 GROUP BY t""",
)
def external_eval(fx: Fixtures):
    kept = fx.valid.where(masks.external_evaluation())
    return kept.groupBy("t").agg(F.count("*").alias("n_cells"), F.avg("obs").alias("obs"))


@query(
    "strata_named_regions",
    "region:s n_cells:i n_values:i obs:f",
    f"""SELECT region, count(DISTINCT iy*1000+ix) AS n_cells, count(*) AS n_values, avg(obs) AS obs FROM fx_valid JOIN {STRATA_SQL}
 GROUP BY region""",
)
def named_regions(fx: Fixtures):
    per_cell = fx.field.groupBy("iy", "ix").agg(F.count("*").alias("n"), F.sum("obs").alias("s"))
    tagged = masks.explode_strata(fx.grid.attach(per_cell, fx.cells), masks.named_regions())
    return tagged.groupBy("region").agg(
        F.count("*").alias("n_cells"), F.sum("n").alias("n_values"), (F.sum("s") / F.sum("n")).alias("obs")
    )


@query(
    "strata_tertiles",
    "iy:i ix:i value:f tertile:i",
    """WITH m AS (SELECT iy, ix, avg(obs) AS value FROM fx_valid WHERE land GROUP BY iy, ix),
e AS (SELECT quantile_cont(value, 1e0/3) AS e0, quantile_cont(value, 2e0/3) AS e1 FROM m)
--
SELECT iy, ix, value, CASE WHEN value>e0 THEN 1 ELSE 0 END + CASE WHEN value>e1 THEN 1 ELSE 0 END AS tertile FROM m, e""",
)
def tertiles(fx: Fixtures):
    means = fx.valid.where("land").groupBy("iy", "ix").agg(F.avg("obs").alias("value"))
    return masks.with_tertile(means, "value", "tertile")


@query(
    "score_minmax",
    "cy:i cx:i nrmse:f trend:f",
    """SELECT cy, cx, coalesce((nrmse-min(nrmse) OVER ())/(max(nrmse) OVER ()-min(nrmse) OVER ()),0) AS nrmse,
 coalesce((abs(trend_diff)-min(abs(trend_diff)) OVER ())/(max(abs(trend_diff)) OVER ()-min(abs(trend_diff)) OVER ()),0) AS trend
 FROM fx_consistency""",
)
def minmax(fx: Fixtures):
    return weights.min_max_score(
        fx.consistency.drop("corr").withColumnRenamed("nrmse", "raw"),
        {"nrmse": F.col("raw"), "trend": F.abs("trend_diff")},
    )


PENALTIES = {n: f"p_{n}" for n in ("trend", "season", "nrmse", "arid", "glacier", "human")}
ADAPTIVE_SQL = """f AS (SELECT iy, ix, land, corr, abs(trend_diff) AS a, abs(season_amp_diff) AS b, nrmse AS c, aridity, glacier, human
 FROM fx_cells JOIN fx_consistency USING (cy, cx)),
p AS (SELECT iy, ix, land, (greatest(-1,least(1,coalesce(corr,0)))+1)/2 AS s, (a-min(a) OVER ())/(max(a) OVER ()-min(a) OVER ()) AS a,
 (b-min(b) OVER ())/(max(b) OVER ()-min(b) OVER ()) AS b, (c-min(c) OVER ())/(max(c) OVER ()-min(c) OVER ()) AS c,
 (aridity-min(aridity) OVER ())/(max(aridity) OVER ()-min(aridity) OVER ()) AS d,
 (glacier-min(glacier) OVER ())/(max(glacier) OVER ()-min(glacier) OVER ()) AS g,
 (human-min(human) OVER ())/(max(human) OVER ()-min(human) OVER ()) AS h FROM f)"""


@query(
    "score_adaptive_weight",
    "iy:i ix:i alpha:f beta:f",
    f"""WITH {ADAPTIVE_SQL}
--
SELECT iy, ix, CASE WHEN land THEN greatest(.05e0,least(1,.05e0+.95e0*s*(1-.6e0*a)*(1-.4e0*b)*(1-.4e0*c)*(1-.35e0*d)*(1-.75e0*g)*(1-.5e0*h))) ELSE 0 END AS alpha,
 CASE WHEN land THEN greatest(.05e0,least(1,.1e0+.9e0*s*(1-.45e0*a)*(1-.35e0*b)*(1-.3e0*c)*(1-.25e0*d)*(1-.45e0*g)*(1-.35e0*h))) ELSE 0 END AS beta FROM p""",
)
def adaptive_weight(fx: Fixtures):
    joined = fx.cells.join(fx.consistency, ["cy", "cx"])
    scored = weights.min_max_score(
        joined,
        {
            "p_trend": F.abs("trend_diff"),
            "p_season": F.abs("season_amp_diff"),
            "p_nrmse": F.col("nrmse"),
            "p_arid": F.col("aridity"),
            "p_glacier": F.col("glacier"),
            "p_human": F.col("human"),
        },
    )
    return scored.withColumns({k: weights.adaptive_weight(k, "corr", PENALTIES, "land") for k in ("alpha", "beta")})


COARSE = replace(GRID, ny=10, nx=18, lat0=-90.0, lon0=-170.0, dlat=20.0, dlon=20.0)


@query(
    "score_optional_penalty",
    "iy:i ix:i temporal:f land:f",
    f"""WITH l AS (SELECT date_trunc('month', l_shipdate) AS t, l_partkey%10 AS y, l_orderkey%18 AS x, floor(avg(l_discount)*100000/{DIVISOR}e0*1048576e0)/1048576e0 AS v,
 floor(avg(l_quantity)/50*1048576e0)/1048576e0 AS share FROM lineitem GROUP BY ALL),
m AS (SELECT y, x, avg(v) AS v FROM l GROUP BY y, x), f AS (SELECT y, x, max(share) AS share FROM l WHERE t=(SELECT min(t) FROM l) GROUP BY y, x),
c AS (SELECT iy, ix, (-82.5e0+15*iy+90)/20 AS fy, (-172.5e0+15*ix+170)/20 AS fx FROM fx_cells),
n AS (SELECT iy, ix, CASE WHEN fx BETWEEN 0 AND 17 AND fy BETWEEN 0 AND 9 THEN CAST(ceil(fy-.5) AS INT) END AS y, CAST(ceil(fx-.5) AS INT) AS x FROM c),
r AS (SELECT iy, ix, v, share FROM n LEFT JOIN m USING (y, x) LEFT JOIN f USING (y, x))
--
SELECT iy, ix, coalesce((v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()),0) AS temporal, CASE WHEN share>=.5e0 THEN 1 ELSE 0 END AS land FROM r""",
)
def optional_penalty(fx: Fixtures):
    """Two layers on a coarser grid that does not reach as far: a penalty over all months, land from the first one."""
    lines = fx.table("lineitem").select(
        time.month_start("l_shipdate").alias("t"),
        (F.col("l_partkey") % 10).cast("int").alias("iy"),
        (F.col("l_orderkey") % 18).cast("int").alias("ix"),
        "l_discount",
        "l_quantity",
    )
    layer = lines.groupBy("t", "iy", "ix").agg(
        dyadic(F.avg("l_discount") * 100000 / F.lit(DIVISOR)).alias("v"), dyadic(F.avg("l_quantity") / 50).alias("share")
    )
    cells = fx.cells.select("iy", "ix")
    scored = weights.optional_penalty(cells, layer, "v", COARSE, fx.grid, "temporal")
    return weights.land_mask(scored, layer, "share", "t", COARSE, fx.grid)


@query(
    "score_aridity",
    "iy:i ix:i index:f penalty:f",
    """WITH m AS (SELECT iy, ix, month(t) AS m, floor(avg(s1)*900) AS v FROM fx_field GROUP BY ALL),
n AS (SELECT iy, ix, avg(CASE WHEN NOT (m=1 AND iy=3) AND v-15000*(ix%2) < 65535 THEN (v-15000*(ix%2))*1e-4 END) AS index FROM m GROUP BY iy, ix)
--
SELECT iy, ix, index, CASE WHEN index>0 THEN greatest(0,least(1,(.65e0-index)/.65e0)) ELSE 0 END AS penalty FROM n""",
)
def aridity(fx: Fixtures):
    months = fx.field.groupBy("iy", "ix", F.month("t").alias("m")).agg(F.floor(F.avg("s1") * 900).alias("v"))
    value = F.when((F.col("m") == 1) & (F.col("iy") == 3), 65535.0).otherwise(
        (F.col("v") - 15000 * (F.col("ix") % 2)).cast("double")
    )
    wide = months.withColumn("v", value).groupBy("iy", "ix").pivot("m", list(range(1, 13))).agg(F.max("v"))
    index, penalty = weights.aridity_penalty([F.col(str(m)) for m in range(1, 13)])
    return wide.select("iy", "ix", index.alias("index"), penalty.alias("penalty"))


@query(
    "score_human_composite",
    "iy:i ix:i human:f",
    """WITH a AS (SELECT iy, ix, avg(s1)*3 AS v FROM fx_field GROUP BY iy, ix),
b AS (SELECT iy, ix, count(*)*0.02e0-0.9e0 AS v FROM fx_field GROUP BY iy, ix)
--
SELECT iy, ix, least(1, .7e0*CASE WHEN a.v IS NULL THEN 0 ELSE greatest(0,least(1,a.v/100)) END+.3e0*CASE WHEN b.v IS NULL THEN 0 ELSE greatest(0,least(1,b.v)) END) AS human
 FROM a FULL JOIN b USING (iy, ix)""",
)
def human_composite(fx: Fixtures):
    a = fx.field.groupBy("iy", "ix").agg((F.avg("s1") * 3).alias("irrigated"))
    b = fx.field.groupBy("iy", "ix").agg((F.count("*") * 0.02 - 0.9).alias("reservoir"))
    return a.join(b, ["iy", "ix"], "full").withColumn(
        "human", weights.human_composite(F.col("irrigated"), F.col("reservoir"))
    )


@query(
    "score_regional_adjust",
    "iy:i ix:i adjusted:f floored:f",
    f"""WITH {ALPHA_SQL},
x AS (SELECT iy, ix, glacier, 1-disagreement AS a, (1-disagreement)*(1-least(.95e0,.6e0*glacier))*(1-least(.95e0,.4e0*greatest(0,(aridity-.5e0)/.5e0)))
 *(1-least(.95e0,.3e0*greatest(0,(human-.05e0)/.95e0)))*(1-least(.95e0,.2e0*greatest(0,(.1e0-aridity)/.1e0))) AS r
 FROM fx_cells JOIN alpha USING (cy, cx))
--
SELECT iy, ix, greatest(0,least(1,r)) AS adjusted, greatest(0,least(1,CASE WHEN glacier>0 THEN greatest(r, a*.8e0) ELSE r END)) AS floored FROM x""",
)
def regional_adjust(fx: Fixtures):
    joined = fx.cells.join(_alpha(fx), ["cy", "cx"])
    args = (F.col("alpha"), F.col("glacier"), F.col("aridity"), F.col("human"))
    strength = {"glacier": 0.6, "arid": 0.4, "human": 0.3, "humid": 0.2}
    return joined.withColumns(
        {
            "adjusted": weights.regional_adjust(*args, strength),
            "floored": weights.regional_adjust(*args, strength, glacier_floor=0.8),
        }
    )


@query(
    "score_channel_override",
    "field:s t:d iy:i ix:i value:f",
    "SELECT field, t, iy, ix, CASE WHEN field='s2' THEN 0.5e0 ELSE value END AS value FROM fx_field_long",
)
def channel_override(fx: Fixtures):
    return fx.field_long.withColumn("value", F.when(F.col("field") == "s2", 0.5).otherwise(F.col("value")))


@query(
    "dq_unit_interval",
    "cy:i cx:i value:f",
    f"""WITH {ALPHA_SQL}
--
SELECT cy, cx, CASE WHEN cx<>5 THEN greatest(0,least(1,(1-disagreement)+1e-6*(cx%2))) ELSE 0 END AS value FROM alpha""",
)
def unit_interval(fx: Fixtures):
    value = F.when(F.col("cx") != 5, F.col("alpha") + 1e-6 * (F.col("cx") % 2))
    return _alpha(fx).withColumn("value", F.coalesce(weights.unit_interval(value, "alpha"), F.lit(0.0)))


@query(
    "dq_train_leakage",
    "label:s n_times:i duplicate_months:i after_cutoff:i ok:b",
    """SELECT 'train' AS label, (SELECT count(*) FROM fx_split WHERE split=0) AS n_times, 0 AS duplicate_months, 0 AS after_cutoff, true AS ok
 UNION ALL SELECT 'all', count(*), 0, count(*) FILTER (t>DATE '1998-12-31'), false FROM fx_split
 UNION ALL SELECT 'lines', count(*), (SELECT count(*) FROM (SELECT t FROM fx_lines GROUP BY t HAVING count(*)>1)),
 (SELECT count(DISTINCT t) FROM fx_lines WHERE t>DATE '1998-12-31'), false FROM fx_lines""",
)
def train_leakage(fx: Fixtures):
    out = None
    for label, times, n in (
        ("train", fx.split.where("split = 0"), 48),
        ("all", fx.split, None),
        ("lines", fx.lines.select("t"), None),
    ):
        part = guards.train_leakage(times, "t", TRAIN_END, n).withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


ATTR_SQL = """attrs AS (SELECT field AS artefact, k AS key, CASE k WHEN 'fit_start_requested' THEN '1995-01-01' WHEN 'fit_end_requested' THEN '1998-12-31'
 WHEN 'fit_start_effective' THEN strftime(min(t),'%Y-%m-%d') WHEN 'fit_end_effective' THEN strftime(max(t),'%Y-%m-%d')
 WHEN 'fit_n_months' THEN CAST(count(DISTINCT t) AS VARCHAR) ELSE 'same' END AS value
 FROM fx_field_long, (SELECT unnest(['fit_start_requested','fit_end_requested','fit_start_effective','fit_end_effective','fit_n_months',
 'consistency_source_sha256']) AS k) WHERE NOT (field='s1' AND k='fit_n_months') GROUP BY field, k)"""


@query(
    "dq_provenance_keys",
    "artefact:s n_missing:i in_time:b one_source:b",
    f"""WITH {ATTR_SQL}
--
SELECT artefact, 6-count(DISTINCT key) AS n_missing, max(CASE WHEN key='fit_end_effective' THEN value END)<='1998-12-31' AS in_time,
 true AS one_source FROM attrs GROUP BY artefact""",
)
def provenance_keys(fx: Fixtures):
    facts = fx.field_long.groupBy(F.col("field").alias("artefact")).agg(
        F.min("t").cast("string").alias("fit_start_effective"),
        F.max("t").cast("string").alias("fit_end_effective"),
        F.count_distinct("t").cast("string").alias("fit_n_months"),
    ).withColumns(
        {
            "fit_start_requested": F.lit("1995-01-01"),
            "fit_end_requested": F.lit("1998-12-31"),
            "consistency_source_sha256": F.lit("same"),
        }
    )
    long = facts.unpivot(["artefact"], list(guards.FIT_KEYS), "key", "value")
    return guards.provenance_report(long.where("NOT (artefact = 's1' AND key = 'fit_n_months')"), TRAIN_END)


@query(
    "dq_banned_source",
    "name:s banned:b n:i",
    """SELECT source||'_'||lang AS name, regexp_matches(lower(source||' '||lang), 'smap|groundwater|well|wgms|glacier|grace|jpl|csr|gsfc') AS banned,
 count(*) AS n FROM documents GROUP BY source, lang
 UNION ALL SELECT 'GRACE_'||lang, true, count(*) FROM documents GROUP BY lang""",
)
def banned_source(fx: Fixtures):
    docs = fx.table("documents").select("source", "lang")
    both = docs.unionByName(docs.withColumn("source", F.lit("GRACE")))
    counts = both.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.select(
        F.concat_ws("_", "source", "lang").alias("name"), guards.is_banned(F.col("source"), F.col("lang")).alias("banned"), "n"
    )


@query(
    "dq_baseline_complete",
    "field:s n_months:i complete:b",
    """SELECT field, count(DISTINCT t) FILTER (t BETWEEN DATE '1999-01-01' AND DATE '2000-12-31') AS n_months,
 count(DISTINCT t) FILTER (t BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')>=24 AS complete FROM fx_field_long GROUP BY field""",
)
def baseline_complete(fx: Fixtures):
    return guards.baseline_complete(fx.field_long, ["field"], "t", "1999-01-01", "2000-12-31", 24)


AMPM = """SELECT event_id AS id, value/200-0.1e0 AS am, event_id%7 AS am_flag, (value%50)/40 AS pm, event_id%3 AS pm_flag FROM events"""


@query(
    "qc_retrieval_ampm",
    "id:i value:f",
    f"""WITH r AS ({AMPM}), g AS (SELECT id, CASE WHEN am BETWEEN 0 AND 1 AND am_flag=0 THEN am END AS a,
 CASE WHEN pm BETWEEN 0 AND 1 AND pm_flag=0 THEN pm END AS p FROM r)
--
SELECT id, coalesce((a+p)/2, a, p) AS value FROM g""",
)
def retrieval_ampm(fx: Fixtures):
    rows = fx.table("events").select(
        F.col("event_id").alias("id"),
        (F.col("value") / 200 - 0.1).alias("am"),
        (F.col("event_id") % 7).alias("am_flag"),
        ((F.col("value") % 50) / 40).alias("pm"),
        (F.col("event_id") % 3).alias("pm_flag"),
    )
    return rows.select("id", stations.half_day_mean("am", "am_flag", "pm", "pm_flag").alias("value"))


def _qc(fx: Fixtures):
    return stations.qc_filter(fx.station_raw, "2024-01-01", "2024-12-31", ["ts"])


@query(
    "qc_station_filter",
    "id:i site:s t:d storage:f lat:f lon:f",
    "SELECT id, site, ts AS t, storage, lat, lon FROM fx_station_qc WHERE reason='kept'",
)
def station_filter(fx: Fixtures):
    return _qc(fx).where("reason = 'kept'").withColumn("t", F.col("ts"))


@query(
    "qc_reject_report",
    "kind:s name:s n:i",
    """SELECT 'reason' AS kind, reason AS name, count(*) AS n FROM fx_station_qc GROUP BY reason
 UNION ALL SELECT 'qualifier', q, count(*) FROM (SELECT unnest(qualifiers) AS q FROM fx_station_raw) GROUP BY q
 UNION ALL SELECT 'total', 'retained_sites', count(DISTINCT site) FROM fx_station_day
 UNION ALL SELECT 'total', 'retained_records', sum(n_records) FROM fx_station_day
 UNION ALL SELECT 'total', 'sites_at_least_'||k, count(*) FILTER (n>=k) FROM (SELECT site, count(*) AS n FROM fx_station_day GROUP BY site),
 (SELECT unnest([12,18,24]) AS k) GROUP BY k""",
)
def reject_report(fx: Fixtures):
    totals = stations.retained_counts(
        stations.station_period(_qc(fx).where("reason = 'kept'"), F.col("ts").cast("date"), "mean"), [12, 18, 24]
    )
    long = totals.withColumn("kind", F.lit("total")).unpivot(
        ["kind"], [c for c in totals.columns], "name", "n"
    )
    return stations.reject_counts(_qc(fx)).unionByName(long)


GNSS = """SELECT 'S'||(user_id%40) AS station, date_diff('day', DATE '1858-11-17', CAST(ts AS DATE)) AS mjd, CAST(ts AS DATE) AS t, value/1000 AS up,
 (event_id%25)/1000e0 AS sigma, CASE WHEN event_id%90<>0 THEN value/9000 END AS load_a, value/7000 AS load_o FROM events"""


def _gnss(fx: Fixtures):
    v = F.col("value")
    return fx.table("events").select(
        F.concat(F.lit("S"), F.col("user_id") % 40).alias("station"),
        F.datediff("ts", F.lit("1858-11-17").cast("date")).alias("mjd"),
        F.col("ts").cast("date").alias("t"),
        (v / 1000).alias("up"),
        ((F.col("event_id") % 25) / 1000.0).alias("sigma"),
        F.when(F.col("event_id") % 90 != 0, v / 9000).alias("load_a"),
        (v / 7000).alias("load_o"),
    )


GNSS_SQL = f"""g AS ({GNSS}), k AS (SELECT station, mjd, t, min(ROW(up, sigma, load_a, load_o)) AS r FROM g WHERE sigma>0 AND sigma<=.02e0 AND load_a IS NOT NULL
 GROUP BY station, mjd, t), gm AS (SELECT station, date_trunc('month', t) AS month, median((r[1]-r[3]-r[4])*1000) AS up_mm, count(*) AS days
 FROM k GROUP BY ALL HAVING count(*)>=15)"""


@query("qc_gnss_monthly", "station:s month:d up_mm:f days:i", f"WITH {GNSS_SQL}\n--\nSELECT * FROM gm")
def gnss_monthly(fx: Fixtures):
    return stations.gnss_months(_gnss(fx))


@query(
    "qc_gnss_eligibility",
    "station:s valid_months:i n_steps:i exclude:s",
    f"""WITH {GNSS_SQL},
st AS (SELECT DISTINCT 'S'||user_id AS station, user_id%11=0 AS failed, user_id%13<>0 AS known FROM events),
c AS (SELECT station, count(*) AS n FROM gm GROUP BY station),
s AS (SELECT 'S'||user_id AS station, count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE value>300 GROUP BY user_id)
--
SELECT station, coalesce(c.n,0) AS valid_months, coalesce(s.n,0) AS n_steps, CASE WHEN failed THEN 'download_failed' WHEN NOT known THEN 'unknown_schema'
 WHEN coalesce(s.n,0)>0 THEN 'listed_test_step' WHEN coalesce(c.n,0)<1 THEN 'insufficient_months' ELSE '' END AS exclude
 FROM st LEFT JOIN c USING (station) LEFT JOIN s USING (station)""",
)
def gnss_eligibility(fx: Fixtures):
    name = F.concat(F.lit("S"), F.col("user_id")).alias("station")
    events = fx.table("events")
    listed = events.select(
        name, (F.col("user_id") % 11 == 0).alias("failed"), (F.col("user_id") % 13 != 0).alias("known_schema")
    ).distinct()
    code = F.upper(F.date_format("ts", "yyMMMdd"))
    steps = events.where("value > 300").select(name, time.step_code(code).alias("t"))
    return stations.gnss_eligibility(listed, stations.gnss_months(_gnss(fx)), steps, min_months=1)


@query(
    "comp_groundwater_separation",
    "t:d iy:i ix:i candidate:f target:f prior:f",
    """SELECT t, iy, ix, value-(prior-s1) AS candidate, obs-(prior-s1) AS target, s1 AS prior FROM fx_pred""",
)
def groundwater_separation(fx: Fixtures):
    total, part = F.col("prior"), F.col("s1")
    return fx.pred.select(
        "t",
        "iy",
        "ix",
        stations.separated(F.col("value"), total, part).alias("candidate"),
        stations.separated(F.col("obs"), total, part).alias("target"),
        part.alias("prior"),
    )
