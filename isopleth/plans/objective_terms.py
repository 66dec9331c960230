"""Objective terms on the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.operators import objective, skill
from isopleth.plans.filters import KERNEL, SOBEL_SQL
from isopleth.plans.fixtures import Fixtures
from isopleth.plans.registry import query

CONFIG = {"mass_weight": 1.0, "lambda_value": 0.2, "gradient_weight": 0.1, "spectral_weight": 0.5, "basin_weight": 0.05}
SCORED = "sc AS (SELECT *, 1-glacier AS alpha, aridity AS beta FROM fx_pred WHERE valid)"


def _scored(fx: Fixtures):
    return fx.pred.where("valid").withColumns({"alpha": 1 - F.col("glacier"), "beta": F.col("aridity")})


MEAN = "coalesce(sum(({v})*({w})),0)/greatest(coalesce(sum({w}),0),1e-6)"


def _mean(v: str, w: str) -> str:
    return MEAN.format(v=v, w=w)


@query(
    "obj_masked_mean",
    "t:d mean:f",
    f"WITH {SCORED}\n--\nSELECT t, {_mean('value', 'alpha*w')} AS mean FROM sc GROUP BY t",
)
def masked_mean(fx: Fixtures):
    return _scored(fx).groupBy("t").agg(objective.masked_mean(F.col("value"), F.col("alpha") * F.col("w")).alias("mean"))


BATCH = "(year(t)*12+month(t))//4"
TERMS = {
    "mass": f"SELECT {{b}} AS b, avg((p-o)**2) AS mass FROM (SELECT t, cy, cx, sum(value*w)/sum(w) AS p, sum(obs*w)/sum(w) AS o FROM sc GROUP BY t, cy, cx) GROUP BY 1",
    "fine": "SELECT {b} AS b, avg((value-obs)**2) AS fine FROM sc GROUP BY 1",
    "value_term": f"SELECT {{b}} AS b, {_mean('CASE WHEN abs(value-prior)<1 THEN .5e0*(value-prior)**2 ELSE abs(value-prior)-.5e0 END', 'alpha')} AS value_term FROM sc GROUP BY 1",
    "basin": "SELECT {b} AS b, avg(d*d) AS basin FROM (SELECT t, basin_id, avg(value)-avg(obs) AS d FROM sc WHERE basin_id>0 GROUP BY t, basin_id HAVING count(*)>=8) GROUP BY 1",
    "gradient": f"""SELECT coalesce(x.b,y.b) AS b, .5e0*(coalesce(x.v,0)+coalesce(y.v,0)) AS gradient FROM
 (SELECT {{a}} AS b, {_mean('abs((c.value-a.value)-(c.prior-a.prior))', '.5e0*(a.beta+c.beta)')} AS v FROM sc a JOIN sc c ON a.t=c.t AND a.iy=c.iy AND c.ix=a.ix+1 GROUP BY 1) x
 FULL JOIN (SELECT {{a}} AS b, {_mean('abs((c.value-a.value)-(c.prior-a.prior))', '.5e0*(a.beta+c.beta)')} AS v FROM sc a JOIN sc c ON a.t=c.t AND a.ix=c.ix AND c.iy=a.iy+1 GROUP BY 1) y
 ON x.b=y.b""",
}


def _term(name: str, by: str = "t") -> str:
    return TERMS[name].format(b=by, a=by.replace("(t)", "(a.t)") if "(" in by else f"a.{by}")


@query(
    "obj_coarse_mse",
    "t:d mass:f fine:f",
    f"WITH {SCORED}\n--\nSELECT b AS t, mass, fine FROM ({_term('mass')}) JOIN ({_term('fine')}) USING (b)",
)
def coarse_mse(fx: Fixtures):
    rows = _scored(fx)
    mass = objective.coarse_mse(
        rows.withColumn("sample", F.col("t")), ["t"], "sample", "value", "obs", fx.grid, "w"
    )
    return mass.join(objective.fine_mse(rows, ["t"], "value", "obs"), "t")


@query("obj_value_huber", "t:d value_term:f", f"WITH {SCORED}\n--\nSELECT b AS t, value_term FROM ({_term('value_term')})")
def value_huber(fx: Fixtures):
    return objective.value_huber(_scored(fx), ["t"], "value", "prior", "alpha")


@query(
    "obj_gradient_l1",
    "t:d gradient:f",
    f"WITH {SCORED}\n--\nSELECT t, coalesce(gradient, 0) AS gradient FROM (SELECT DISTINCT t FROM sc) LEFT JOIN ({_term('gradient')}) ON b=t",
)
def gradient_l1(fx: Fixtures):
    return objective.gradient_l1(_scored(fx), ["t"], "t", "value", "prior", "beta")


@query("obj_basin_mse", "t:d basin:f", f"WITH {SCORED}\n--\nSELECT b AS t, basin FROM ({_term('basin')})")
def basin_mse(fx: Fixtures):
    return objective.basin_mse(_scored(fx), ["t"], "t", "basin_id", "value", "obs", 8)


IDX = "(CASE WHEN abs(j+d)>{n}-1 THEN 2*({n}-1)-abs(j+d) ELSE abs(j+d) END)"
SPECTRAL_SQL = f"""{KERNEL},
bx AS (SELECT t, s.iy, j AS ix, sum(value*wt) AS a, sum(obs*wt) AS o, sum(prior*wt) AS p, sum(wt) AS w FROM sc s, (SELECT unnest(range(0,24)) AS j), k
 WHERE s.ix={IDX.format(n=24)} GROUP BY t, s.iy, j),
bz AS (SELECT t, j AS iy, s.ix, sum(a*wt) AS a, sum(o*wt) AS o, sum(p*wt) AS p, sum(w*wt) AS w FROM bx s, (SELECT unnest(range(0,12)) AS j), k
 WHERE s.iy={IDX.format(n=12)} GROUP BY t, s.ix, j),
bl AS (SELECT sc.t, sc.beta, (bz.a-bz.o)/greatest(bz.w,1e-6) AS lo, (value-bz.a/greatest(bz.w,1e-6))-(prior-bz.p/greatest(bz.w,1e-6)) AS hi
 FROM sc JOIN bz USING (t, iy, ix)),
sp AS (SELECT {{b}} AS b, {_mean('lo*lo', '1')} AS low, {_mean('hi*hi', 'beta')} AS high FROM bl GROUP BY 1)"""


@query(
    "obj_spectral",
    "t:d low:f high:f spectral:f",
    f"WITH {SCORED},\n{SPECTRAL_SQL.format(b='t')}\n--\nSELECT b AS t, low, high, .2e0*low+.1e0*high AS spectral FROM sp",
)
def spectral(fx: Fixtures):
    return objective.spectral(_scored(fx), ["t"], "t", "value", "obs", "prior", "beta", fx.grid)


def _terms(fx: Fixtures, keys: list[str], rows):
    return [
        objective.fine_mse(rows, keys, "value", "obs"),
        objective.coarse_mse(rows, keys, "sample", "value", "obs", fx.grid, "w"),
        objective.value_huber(rows, keys, "value", "prior", "alpha"),
        objective.gradient_l1(rows, keys, "sample", "value", "prior", "beta"),
        objective.spectral(rows, keys, "sample", "value", "obs", "prior", "beta", fx.grid),
        objective.basin_mse(rows, keys, "sample", "basin_id", "value", "obs", 8),
    ]


def _total_sql(by: str) -> str:
    joins = " ".join(f"LEFT JOIN ({_term(n, by)}) USING (b)" for n in ("mass", "value_term", "gradient", "basin"))
    return f"""WITH {SCORED},
{SPECTRAL_SQL.format(b=by)}
--
SELECT b, fine, mass, value_term, gradient, basin, .2e0*low+.1e0*high AS spectral,
 mass+.2e0*value_term+.1e0*coalesce(gradient,0)+.5e0*(.2e0*low+.1e0*high)+.05e0*coalesce(basin,0) AS total FROM ({_term('fine', by)}) {joins} LEFT JOIN sp USING (b)"""


@query(
    "obj_total",
    "t:d mode:s total:f",
    f"""WITH {SCORED},
{SPECTRAL_SQL.format(b="t")},
{SOBEL_SQL},
a AS ({_term("fine")}), m AS ({_term("mass")}), v AS ({_term("value_term")}), g AS ({_term("gradient")}), ba AS ({_term("basin")}),
st AS (SELECT b, mass+.2e0*value_term+.1e0*coalesce(gradient,0)+.5e0*(.2e0*low+.1e0*high)+.05e0*coalesce(basin,0) AS total FROM a JOIN m USING (b)
 JOIN v USING (b) LEFT JOIN g USING (b) LEFT JOIN ba USING (b) LEFT JOIN sp USING (b)),
hr AS (SELECT t AS b, avg((value-prior)**2) AS hr FROM sc GROUP BY t), se AS (SELECT t AS b, avg(.5e0*(sx*sx+sy*sy)) AS se FROM so GROUP BY t),
lm AS (SELECT t AS b, greatest(0,least(1,covar_pop(value,prior)*count(*)/greatest(sqrt(greatest(var_pop(value)*count(*),1e-6))*sqrt(greatest(var_pop(prior)*count(*),1e-6)),1e-6))) AS l FROM sc GROUP BY t),
pm AS (SELECT t AS b, avg((p-o)**2) AS pm FROM (SELECT t, cy, cx, avg(value) AS p, avg(obs) AS o FROM sc GROUP BY t, cy, cx) GROUP BY t)
--
SELECT b AS t, 'static' AS mode, total FROM st UNION ALL SELECT b, 'dynamic', l*pm+(1-l)*(hr+se) FROM lm JOIN pm USING (b) JOIN hr USING (b) JOIN se USING (b)""",
)
def total(fx: Fixtures):
    """Weighted static sum, and the dynamic mode with unweighted blocks."""
    rows = _scored(fx).withColumn("sample", F.col("t"))
    static = objective.total(_terms(fx, ["t"], rows), ["t"], CONFIG).select("t", F.lit("static").alias("mode"), "total")
    plain = objective.coarse_mse(rows.withColumn("one", F.lit(1.0)), ["t"], "sample", "value", "obs", fx.grid, "one")
    high = objective.fine_mse(rows, ["t"], "value", "prior").withColumnRenamed("fine", "hr")
    edges = objective.sobel_mse(rows, ["t"], "t", "value", "prior")
    share = skill.clipped_mean_correlation(rows, ["t"], "sample", "value", "prior").withColumnRenamed("corr", "share")
    joined = plain.join(high, "t").join(edges, "t").join(share, "t").withColumn("bound", F.col("hr") + F.col("sobel"))
    dynamic = objective.dynamic_total(joined, "mass", "bound", "share").select("t", F.lit("dynamic").alias("mode"), "total")
    return static.unionByName(dynamic)


GATE = "gt AS (SELECT t, least(1e0,prior/60) AS g, least(1e0,obs/60) AS y FROM fx_pred WHERE valid)"


@query(
    "obj_gate_calibration",
    "t:d supervision:f gate_mae:f gate_std:f saturated_share:f variance_penalty:f gate_mean:f gate_min:f gate_max:f gate:f",
    f"""WITH {GATE},
s AS (SELECT t, avg(-(y*ln(greatest(1e-6,least(1-1e-6,g)))+(1-y)*ln(1-greatest(1e-6,least(1-1e-6,g))))) AS supervision, avg(abs(g-y)) AS gate_mae,
 sqrt(greatest(var_pop(g),1e-12)) AS gate_std, avg(CASE WHEN g<=.02e0 OR g>=.98e0 THEN 1e0 ELSE 0 END) AS saturated_share, avg(g) AS gate_mean,
 min(g) AS gate_min, max(g) AS gate_max FROM gt GROUP BY t)
--
SELECT *, greatest(.1e0-gate_std,0)**2 AS variance_penalty, supervision+.5e0*greatest(.1e0-gate_std,0)**2 AS gate FROM s""",
)
def gate_calibration(fx: Fixtures):
    rows = fx.pred.where("valid").select(
        "t", F.least(F.lit(1.0), F.col("prior") / 60).alias("g"), F.least(F.lit(1.0), F.col("obs") / 60).alias("y")
    )
    return objective.gate_terms(rows, ["t"], "g", "y", variance_weight=0.5)


@query(
    "obj_batch_audit",
    "batch:i fine:f mass:f value_term:f gradient:f spectral:f basin:f total:f",
    _total_sql(BATCH).replace("SELECT b, fine", "SELECT b AS batch, fine"),
)
def batch_audit(fx: Fixtures):
    """Every term per batch of four months."""
    batch = F.floor((F.year("t") * 12 + F.month("t")) / 4).cast("long")
    rows = _scored(fx).withColumns({"sample": F.col("t"), "batch": batch})
    return objective.total(_terms(fx, ["batch"], rows), ["batch"], CONFIG)
