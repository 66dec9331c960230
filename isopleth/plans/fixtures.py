"""Input views over the supplied tables, in Spark and as SQL text.

Field values are floored to multiples of 2**-20.  Such numbers add, subtract
and average without rounding error, so ties, signs and thresholds come out the
same in both engines.  The divisor keeps values off the flooring boundary.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions import geo, time
from isopleth.grid import Grid

GRID = Grid(ny=12, nx=24, lat0=-82.5, lon0=-172.5, dlat=15.0, dlon=15.0, factor=3)
MODELS = ("M0", "M1", "M2", "M3", "M4")
TRAIN_END, VAL_END = "1998-12-31", "1999-12-31"
BASE_START, BASE_END = "1996-01-01", "1998-12-31"
DIVISOR = 997.123457
MIN_PERIODS, MIN_COMMON, MAIN_COMMON = 18, 12, 16
REPLICATES, SEED = 2000, 42


def dyadic(x: Column) -> Column:
    """Floor to a multiple of 2**-20."""
    return F.floor(x * F.lit(1048576.0)).cast("double") / F.lit(1048576.0)


def jackknife(divisor: float, sign: float = 1.0) -> Column:
    """Array of (model, value): the mean over all residues but one, from columns s0..s4 and n0..n4."""
    members = []
    for m in range(5):
        rest = [i for i in range(5) if i != m]
        total, count = F.lit(0.0), F.lit(0)
        for i in rest:
            total, count = total + F.col(f"s{i}"), count + F.col(f"n{i}")
        mean = F.try_divide(F.try_divide(F.lit(sign) * total, count), F.lit(divisor))
        members.append(F.struct(F.lit(f"M{m}").alias("model"), dyadic(mean).alias("value")))
    return F.array(*members)


class Fixtures:
    """Lazily built views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.grid = spark, sf_dir, GRID

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their month and grid cell."""
        return self.table("lineitem").select(
            time.month_start("l_shipdate").alias("t"),
            (F.col("l_partkey") % 12).cast("int").alias("iy"),
            (F.col("l_orderkey") % 24).cast("int").alias("ix"),
            "l_linenumber",
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"),
            F.col("l_tax").alias("tax"),
        )

    @cached_property
    def field(self) -> DataFrame:
        """Cube of a prior, an observation and three sources; s3 ends with 1999."""
        d = F.lit(DIVISOR)
        return self.lines.groupBy("t", "iy", "ix").agg(
            dyadic(F.avg("price") / d).alias("prior"),
            dyadic(F.avg(F.col("price") * (1 - F.col("disc")) * (1 + F.col("tax"))) / d).alias("obs"),
            dyadic(F.avg("qty") / (d / 1000)).alias("s1"),
            dyadic(F.avg("tax") * 100000 / d).alias("s2"),
            F.when(F.col("t") < F.lit("2000-01-01").cast("date"), dyadic(F.avg("disc") * 100000 / d)).alias("s3"),
        )

    @cached_property
    def field_long(self) -> DataFrame:
        """The cube with one row per (field, t, iy, ix)."""
        return self.field.unpivot(
            ["t", "iy", "ix"], ["prior", "obs", "s1", "s2", "s3"], "field", "value"
        ).where(F.col("value").isNotNull())

    @cached_property
    def raw_model(self) -> DataFrame:
        """Five jackknife models: model m leaves out the lines with ``l_linenumber % 5 = m``.

        Sums per residue come from one aggregation per cell; the models are
        put together from them afterwards.
        """
        r, net = F.col("l_linenumber") % 5, F.col("price") * (1 - F.col("disc"))
        sums = [F.sum(F.when(r == i, net).otherwise(0.0)).alias(f"s{i}") for i in range(5)]
        counts = [F.count_if(r == i).alias(f"n{i}") for i in range(5)]
        parts = self.lines.groupBy("t", "iy", "ix").agg(*sums, *counts)
        return parts.select("t", "iy", "ix", F.explode(jackknife(DIVISOR)).alias("m")).select(
            "t", "iy", "ix", "m.model", "m.value"
        ).where("value IS NOT NULL")

    @cached_property
    def model(self) -> DataFrame:
        """Raw models and their correction toward the observation, per variant."""
        from isopleth.operators.conserve import blend_correct

        raw = self.raw_model.join(self.field.select("t", "iy", "ix", "obs"), ["t", "iy", "ix"])
        both = blend_correct(raw, ["model", "t"], "value", "obs", self.grid, blend=0.05, cap=1.0)
        return both.select(
            "t",
            "iy",
            "ix",
            "model",
            F.explode(
                F.array(
                    F.struct(F.lit("raw").alias("variant"), F.col("value").alias("value")),
                    F.struct(F.lit("corrected").alias("variant"), dyadic(F.col("corrected")).alias("value")),
                )
            ).alias("v"),
        ).select("t", "iy", "ix", "model", "v.variant", "v.value")

    @cached_property
    def cells(self) -> DataFrame:
        """Cells that occur in the data, with static layers."""
        iy, ix, g = F.col("iy"), F.col("ix"), self.grid
        seen = self.table("lineitem").select(
            (F.col("l_partkey") % 12).cast("int").alias("iy"),
            (F.col("l_orderkey") % 24).cast("int").alias("ix"),
        ).distinct()
        return seen.select(
            "iy",
            "ix",
            g.lat().alias("lat"),
            g.lon().alias("lon"),
            geo.area_weight(g.lat()).alias("w"),
            ((7 * iy + 5 * ix) % 10 < 8).alias("land"),
            ((13 * iy + 7 * ix) % 100 / 100.0).alias("glacier"),
            ((17 * iy + 3 * ix) % 100 / 100.0).alias("human"),
            ((11 * iy + 19 * ix) % 100 / 100.0).alias("aridity"),
            (1 + F.floor(iy / 2) * 5 + F.floor(ix / 5)).cast("int").alias("zone_id"),
            ((24 * iy + ix) % 17).cast("int").alias("basin_id"),
            g.cy().alias("cy"),
            g.cx().alias("cx"),
        )

    @cached_property
    def polygons(self) -> DataFrame:
        """One quadrilateral per nation; upstream area from its suppliers."""
        area = self.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("a")
        )
        return self.table("nation").join(area, "n_nationkey", "left").select(
            F.col("n_nationkey").alias("poly_id"),
            F.col("n_nationkey").alias("seq"),
            (F.col("n_nationkey") * 10).alias("hybas_id"),
            (F.col("n_regionkey") + 1).alias("main_id"),
            F.coalesce("a", F.lit(0)).alias("up_area"),
        )

    @cached_property
    def polygon_edges(self) -> DataFrame:
        k = F.col("n_nationkey")
        x, y = -170.0 + 14 * k, -60.0 + 30 * (k % 5)
        corners = [(x, y), (x + 25, y + 3), (x + 22, y + 31), (x - 4, y + 27)]
        edges = F.array(
            *[
                F.struct(
                    corners[i][0].alias("x1"),
                    corners[i][1].alias("y1"),
                    corners[(i + 1) % 4][0].alias("x2"),
                    corners[(i + 1) % 4][1].alias("y2"),
                )
                for i in range(4)
            ]
        )
        return self.table("nation").select(k.alias("poly_id"), F.explode(edges).alias("e")).select("poly_id", "e.*")

    @cached_property
    def split(self) -> DataFrame:
        months = self.table("lineitem").select(time.month_start("l_shipdate").alias("t")).distinct()
        return months.withColumn("split", time.split_label("t", TRAIN_END, VAL_END))

    @cached_property
    def station_raw(self) -> DataFrame:
        """Point measurements with units, status and qualifiers, as delivered."""
        k = F.get_json_object("props", "$.k").cast("int")
        u, kind = F.col("user_id"), F.col("event_type")
        site_iy, site_ix = u % 12, F.floor(u / 12) % 6
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("S"), u).alias("site"),
            F.col("ts"),
            F.when(F.col("event_id") % 101 != 0, F.col("value")).alias("value"),
            F.when(kind.isin("view", "purchase"), "ft")
            .when(kind.isin("click", "error"), "m")
            .otherwise("cm")
            .alias("unit"),
            F.when(kind == "error", "Provisional").otherwise("Approved").alias("status"),
            F.when(k % 97 == 0, "72020").otherwise("72019").alias("parameter"),
            F.when(k % 10 == 0, F.array(F.lit("Dry")))
            .when(k % 10 == 1, F.array(F.lit("Static"), F.lit("Pumping")))
            .otherwise(F.array(F.lit("Static")))
            .alias("qualifiers"),
            (F.lit(-82.5) + 15 * site_iy + (u % 9 - 4) * 2.0).alias("lat"),
            (F.lit(-172.5) + 15 * site_ix + (u % 7 - 3) * 2.0).alias("lon"),
        )

    @cached_property
    def station_day(self) -> DataFrame:
        """Daily station proxy after quality control, with its grid cell."""
        from isopleth.operators.stations import qc_filter, station_period

        kept = qc_filter(self.station_raw, start="2024-01-01", end="2024-12-31").where("reason = 'kept'")
        return station_period(kept, F.col("ts").cast("date"), how="median")

    @cached_property
    def sites(self) -> DataFrame:
        """Station eligibility, written once: the later steps all read it."""
        from isopleth.operators.stations import eligibility
        from isopleth.session import pinned

        return pinned(eligibility(self.days, self.cells, self.grid, MIN_PERIODS))

    @cached_property
    def days(self) -> DataFrame:
        from isopleth.session import pinned

        return pinned(self.station_day)

    @cached_property
    def site_z(self) -> DataFrame:
        from isopleth.operators.stations import standardize

        return standardize(self.days, self.sites)

    @cached_property
    def grid_obs(self) -> DataFrame:
        """Median of the standardised sites per cell and day."""
        from isopleth.operators.stations import grid_median
        from isopleth.session import pinned

        return pinned(grid_median(pinned(self.site_z)))

    @cached_property
    def pair_rows(self) -> DataFrame:
        """Every pair with its metrics and, if it cannot be used, the reason."""
        from isopleth.operators import pairs
        from isopleth.session import pinned

        table = pairs.pair_table(pairs.contrasts(self.grid_obs, self.station_model, 2 * len(MODELS)))
        return pinned(pairs.judged(table, MIN_COMMON))

    @cached_property
    def pair_metrics(self) -> DataFrame:
        from isopleth.operators.pairs import usable

        return usable(self.pair_rows, self.cells.select("iy", "ix", F.col("aridity").alias("beta")))

    @cached_property
    def block_medians(self) -> DataFrame:
        """Corrected variant, pairs with enough common days."""
        from isopleth.operators.pairs import block_summary
        from isopleth.session import pinned

        kept = self.pair_metrics.where(F.col("variant") == "corrected").where(F.col("n_common") >= MAIN_COMMON)
        return pinned(block_summary(kept))

    @cached_property
    def station_model(self) -> DataFrame:
        """Five jackknife models of the raw measurements per cell and day."""
        g = self.grid
        u = F.col("user_id")
        lat = F.lit(-82.5) + 15 * (u % 12) + (u % 9 - 4) * 2.0
        lon = F.lit(-172.5) + 15 * (F.floor(u / 12) % 6) + (u % 7 - 3) * 2.0
        r = F.col("event_id") % 5
        cells = self.table("events").select(
            F.col("ts").cast("date").alias("t"), g.nearest_iy(lat).alias("iy"), g.nearest_ix(lon).alias("ix"), "event_id", "value"
        )
        parts = cells.groupBy("t", "iy", "ix").agg(
            *[F.sum(F.when(r == i, F.col("value")).otherwise(0.0)).alias(f"s{i}") for i in range(5)],
            *[F.count_if(r == i).alias(f"n{i}") for i in range(5)],
        )
        raw = parts.select("t", "iy", "ix", F.explode(jackknife(DIVISOR / 1000, -1.0)).alias("m")).where("m.value IS NOT NULL")
        shifted = dyadic(F.col("m.value") * 0.9 - F.col("iy") * 0.37 + F.dayofmonth("t") * 0.113)
        both = F.array(
            F.struct(F.lit("raw").alias("variant"), F.col("m.value").alias("value")),
            F.struct(F.lit("corrected").alias("variant"), shifted.alias("value")),
        )
        return raw.select("t", "iy", "ix", "m.model", F.explode(both).alias("v")).select(
            "t", "iy", "ix", "model", "v.variant", "v.value"
        )

    @cached_property
    def valid(self) -> DataFrame:
        """The cube with static layers and its validity mask."""
        from isopleth.operators.masks import valid_cells

        joined = self.grid.attach(self.field, self.cells)
        return joined.withColumn("valid", valid_cells(["prior", "obs", "s1", "s2"], "prior", 70.0, "land"))

    @cached_property
    def coarse(self) -> DataFrame:
        """Area-weighted block means of prior and observation on valid cells."""
        from isopleth.operators.conserve import block_mean

        return block_mean(self.valid.where("valid"), ["t"], ["prior", "obs"], self.grid, "w")

    @cached_property
    def common(self) -> DataFrame:
        """Valid cells at which all models have both variants."""
        from isopleth.operators.masks import common_support

        ok = self.valid.where("valid").select("t", "iy", "ix")
        rows = self.model.join(ok, ["t", "iy", "ix"], "left_semi")
        return common_support(rows, ["t", "iy", "ix"], ["model", "variant"], "value", 2 * len(MODELS))

    @cached_property
    def fine_eval(self) -> DataFrame:
        """Models next to the references on the common cells."""
        refs = self.valid.where("valid").select(
            "t", "iy", "ix", "lat", "lon", "w", "obs", "prior", "s1", "glacier", "human", "aridity", "basin_id"
        )
        return self.model.join(self.common, ["t", "iy", "ix"], "left_semi").join(refs, ["t", "iy", "ix"])

    @cached_property
    def coarse_eval(self) -> DataFrame:
        """Area-weighted block means of the models and the observation on the common cells."""
        from isopleth.operators.conserve import block_mean

        both = block_mean(self.fine_eval, ["model", "variant", "t"], ["value", "obs"], self.grid, "w")
        return both.withColumnRenamed("obs", "ref")

    @cached_property
    def external(self) -> DataFrame:
        """Corrected models against an external series (s1) on undisturbed cells."""
        from isopleth.operators.masks import external_evaluation

        kept = self.fine_eval.where("variant = 'corrected'").withColumn("land", F.lit(True))
        return kept.where(external_evaluation(max_human=0.9, max_glacier=0.9)).withColumnRenamed("s1", "smap")

    @cached_property
    def consistency(self) -> DataFrame:
        """Prior against observation on plain blocks, training months only."""
        from isopleth.operators.conserve import block_mean_plain
        from isopleth.operators.temporal import consistency

        train = self.field.where(F.col("t") <= F.lit(TRAIN_END).cast("date"))
        coarse = block_mean_plain(train, ["t"], ["obs", "prior"], self.grid)
        return consistency(coarse, "obs", "prior", ["cy", "cx"])

    @cached_property
    def pred(self) -> DataFrame:
        """The corrected M4 prediction next to the masked cube."""
        m4 = self.model.where("model = 'M4' AND variant = 'corrected'").select("t", "iy", "ix", "value")
        return self.valid.join(m4, ["t", "iy", "ix"])


# ---------------------------------------------------------------- SQL views
_LINES = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, CAST(l_partkey % 12 AS INT) AS iy,
 CAST(l_orderkey % 24 AS INT) AS ix, l_linenumber, l_quantity AS qty, l_extendedprice AS price,
 l_discount AS disc, l_tax AS tax FROM lineitem"""

_FIELD = f"""SELECT t, iy, ix,
 floor(avg(price)/{DIVISOR}e0*1048576e0)/1048576e0 AS prior,
 floor(avg(price*(1-disc)*(1+tax))/{DIVISOR}e0*1048576e0)/1048576e0 AS obs,
 floor(avg(qty)/({DIVISOR}e0/1000)*1048576e0)/1048576e0 AS s1,
 floor(avg(tax)*100000/{DIVISOR}e0*1048576e0)/1048576e0 AS s2,
 CASE WHEN t < DATE '2000-01-01' THEN floor(avg(disc)*100000/{DIVISOR}e0*1048576e0)/1048576e0 END AS s3
 FROM fx_lines GROUP BY t, iy, ix"""

_RAW = f"""SELECT t, iy, ix, 'M' || m AS model,
 floor(sum(price*(1-disc))/count(*)/{DIVISOR}e0*1048576e0)/1048576e0 AS value
 FROM fx_lines, (SELECT unnest(range(0,5)) AS m) WHERE l_linenumber % 5 <> m GROUP BY t, iy, ix, m"""

_MODEL = """SELECT t, iy, ix, model, 'raw' AS variant, value FROM fx_raw_model
 UNION ALL
 SELECT t, iy, ix, model, 'corrected' AS variant, floor((value + 0.05e0*greatest(-1e0, least(1e0,
   avg(obs) OVER b - avg(value) OVER b)))*1048576e0)/1048576e0
 FROM fx_raw_model JOIN (SELECT t, iy, ix, obs FROM fx_field) USING (t, iy, ix)
 WINDOW b AS (PARTITION BY model, t, iy // 3, ix // 3)"""

_CELLS = """SELECT iy, ix, -82.5e0+15*iy AS lat, -172.5e0+15*ix AS lon,
 greatest(0e0, cos(radians(-82.5e0+15*iy))) AS w, (7*iy+5*ix)%10 < 8 AS land,
 ((13*iy+7*ix)%100)/100.0e0 AS glacier, ((17*iy+3*ix)%100)/100.0e0 AS human,
 ((11*iy+19*ix)%100)/100.0e0 AS aridity, 1+(iy//2)*5+ix//5 AS zone_id, (24*iy+ix)%17 AS basin_id,
 iy//3 AS cy, ix//3 AS cx FROM (SELECT DISTINCT iy, ix FROM fx_lines)"""

_SPLIT = """SELECT t, CASE WHEN t <= DATE '1998-12-31' THEN 0 WHEN t <= DATE '1999-12-31' THEN 1 ELSE 2 END AS split
 FROM (SELECT DISTINCT t FROM fx_lines)"""

_STATION_RAW = """SELECT event_id AS id, 'S' || user_id AS site, ts,
 CASE WHEN event_id % 101 <> 0 THEN value END AS value,
 CASE WHEN event_type IN ('view','purchase') THEN 'ft' WHEN event_type IN ('click','error') THEN 'm' ELSE 'cm' END AS unit,
 CASE WHEN event_type = 'error' THEN 'Provisional' ELSE 'Approved' END AS status,
 CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) % 97 = 0 THEN '72020' ELSE '72019' END AS parameter,
 CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) % 10 = 0 THEN ['Dry']
  WHEN CAST(json_extract_string(props,'$.k') AS INT) % 10 = 1 THEN ['Static','Pumping'] ELSE ['Static'] END AS qualifiers,
 -82.5e0+15*(user_id%12)+(user_id%9-4)*2e0 AS lat, -172.5e0+15*((user_id//12)%6)+(user_id%7-3)*2e0 AS lon FROM events"""

_STATION_QC = """SELECT *, CASE WHEN parameter <> '72019' THEN 'parameter' WHEN status <> 'Approved' THEN 'not_approved'
 WHEN NOT list_contains(qualifiers,'Static') THEN 'not_explicitly_static'
 WHEN list_has_any(qualifiers, ['Pumping','NoMeasurement','Dry','Obstructed','GWSWAffected','ForeignSubstance','Flowing','Above','Below','Frozen','GWTideAffected'])
  THEN 'affected_or_censored'
 WHEN unit NOT IN ('ft','m') THEN 'unit' WHEN value IS NULL OR year(ts) <> 2024 THEN 'invalid' ELSE 'kept' END AS reason,
 CASE WHEN unit='ft' THEN -(value*0.3048e0) WHEN unit='m' THEN -value END AS storage FROM fx_station_raw"""

_STATION_DAY = """SELECT site, CAST(ts AS DATE) AS t, median(storage) AS value, median(lat) AS lat, median(lon) AS lon,
 count(*) AS n_records FROM fx_station_qc WHERE reason='kept' GROUP BY site, CAST(ts AS DATE)"""

_STATION_MODEL = f"""WITH e AS (SELECT CAST(ts AS DATE) AS t, event_id, value,
  greatest(0, least(11, CAST(ceil((-82.5e0+15*(user_id%12)+(user_id%9-4)*2e0+82.5e0)/15-0.5e0) AS INT))) AS iy,
  greatest(0, least(23, CAST(ceil((-172.5e0+15*((user_id//12)%6)+(user_id%7-3)*2e0+172.5e0)/15-0.5e0) AS INT))) AS ix FROM events),
 r AS (SELECT t, iy, ix, m, floor(-sum(value)/count(*)/({DIVISOR}e0/1000)*1048576e0)/1048576e0 AS raw
  FROM e, (SELECT unnest(range(0,5)) AS m) WHERE event_id % 5 <> m GROUP BY t, iy, ix, m)
 SELECT t, iy, ix, 'M' || m AS model, 'raw' AS variant, raw AS value FROM r UNION ALL
 SELECT t, iy, ix, 'M' || m, 'corrected', floor((raw*0.9e0 - iy*0.37e0 + day(t)*0.113e0)*1048576e0)/1048576e0 FROM r"""

_VALID = """SELECT f.t, f.iy, f.ix, prior, obs, s1, s2, s3, lat, lon, w, land, glacier, human, aridity, zone_id, basin_id,
 cy, cx, coalesce(abs(prior) <= 70 AND obs IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND land, FALSE) AS valid
 FROM fx_field f JOIN fx_cells USING (iy, ix)"""

_PRED = """SELECT v.*, value FROM fx_valid v JOIN fx_model m USING (t, iy, ix) WHERE model='M4' AND variant='corrected'"""

_COARSE = """SELECT t, cy, cx, sum(prior*w)/sum(w) AS prior, sum(obs*w)/sum(w) AS obs FROM fx_valid WHERE valid GROUP BY t, cy, cx"""


def sql_corr(a: str, b: str, n: int = 3) -> str:
    """SQL text of the guarded Pearson correlation of two columns without NULLs."""
    return (
        f"CASE WHEN count(*)>={n} AND stddev_pop({a})>0 AND stddev_pop({b})>0 "
        f"THEN covar_pop({a},{b})/(stddev_pop({a})*stddev_pop({b})) END"
    )


def sql_rank(x: str, partition: str = "") -> str:
    """SQL text of the average rank of ``x``."""
    p = f"PARTITION BY {partition} " if partition else ""
    q = f"PARTITION BY {partition}, {x}" if partition else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q})-1)/2.0e0)"


def sql_harmonics(name: str, source: str, keys: str, value: str, least: int = 24) -> str:
    """WITH items ending in ``name`` (keys, n, trend, annual, semiannual): normal equations, then Gauss-Jordan steps."""
    b = ["1e0", "x", "sin(2*pi()*x)", "cos(2*pi()*x)", "sin(4*pi()*x)", "cos(4*pi()*x)"]
    rows = ", ".join("[" + ", ".join([f"sum(({p})*({q}))" for q in b] + [f"sum(({p})*y)"]) + "]" for p in b)
    items = [
        f"{name}_s AS (SELECT {keys}, {value} AS y, (year(t)*12+month(t)-(SELECT min(year(t)*12+month(t)) FROM {source}))/12.0e0 AS x "
        f"FROM {source} WHERE {value} IS NOT NULL)",
        f"{name}_0 AS (SELECT {keys}, count(*) AS n, [{rows}] AS m FROM {name}_s GROUP BY {keys})",
    ]
    for k in range(1, 7):
        item = (
            f"[CASE WHEN i={k} THEN [q/m[{k}][{k}] for q in m[{k}]] ELSE [m[i][j]-m[i][{k}]*m[{k}][j]/m[{k}][{k}] for j in range(1,8)] END for i in range(1,7)]"
        )
        where = f" WHERE n>={least}" if k == 1 else ""
        items.append(f"{name}_{k} AS (SELECT {keys}, n, {item} AS m FROM {name}_{k - 1}{where})")
    items.append(
        f"{name} AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.n, z.m[2][7] AS trend, sqrt(z.m[3][7]**2+z.m[4][7]**2) AS annual, "
        f"sqrt(z.m[5][7]**2+z.m[6][7]**2) AS semiannual FROM {name}_0 a LEFT JOIN {name}_6 z USING ({keys}))"
    )
    return ",\n".join(items)


_CONSISTENCY = f"""WITH c AS (SELECT t, iy//3 AS cy, ix//3 AS cx, avg(obs) AS r, avg(prior) AS k FROM fx_field
  WHERE t <= DATE '1998-12-31' GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY t) AS pos FROM c),
 b AS (SELECT cy, cx, {sql_corr("k", "r", 2)} AS corr, sqrt(avg((k-r)*(k-r)))/stddev_pop(r) AS nrmse,
  regr_slope(k,pos)-regr_slope(r,pos) AS trend_diff FROM n GROUP BY cy, cx),
 m AS (SELECT cy, cx, month(t) AS mo, avg(r) AS r, avg(k) AS k FROM c GROUP BY ALL),
 a AS (SELECT cy, cx, (max(k)-min(k))/2-(max(r)-min(r))/2 AS season_amp_diff FROM m GROUP BY cy, cx)
 SELECT * FROM b JOIN a USING (cy, cx)"""

_COMMON = """SELECT t, iy, ix FROM fx_model JOIN (SELECT t, iy, ix FROM fx_valid WHERE valid) USING (t, iy, ix)
 GROUP BY t, iy, ix HAVING count(DISTINCT model||variant)=10"""

_FINE_EVAL = """SELECT m.*, v.lat, v.lon, v.w, v.obs, v.prior, v.s1, v.glacier, v.human, v.aridity, v.basin_id
 FROM fx_model m JOIN fx_common USING (t, iy, ix) JOIN fx_valid v USING (t, iy, ix)"""

_COARSE_EVAL = """SELECT model, variant, t, iy//3 AS cy, ix//3 AS cx, sum(value*w)/sum(w) AS value, sum(obs*w)/sum(w) AS ref
 FROM fx_fine_eval GROUP BY ALL"""

_EXTERNAL = "SELECT *, s1 AS smap FROM fx_fine_eval WHERE variant='corrected' AND glacier<=.9e0 AND human<=.9e0"

_POLYGONS = """SELECT n_nationkey AS poly_id, n_nationkey AS seq, n_nationkey*10 AS hybas_id, n_regionkey+1 AS main_id, coalesce(a,0) AS up_area
 FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, CAST(sum(CAST(round(s_acctbal*100) AS BIGINT)) AS BIGINT) AS a FROM supplier GROUP BY 1) USING (n_nationkey)"""

_EDGES = """WITH o AS (SELECT n_nationkey AS k, -170e0+14*n_nationkey AS x, -60e0+30*(n_nationkey%5) AS y FROM nation)
 SELECT k AS poly_id, x AS x1, y AS y1, x+25 AS x2, y+3 AS y2 FROM o UNION ALL SELECT k, x+25, y+3, x+22, y+31 FROM o
 UNION ALL SELECT k, x+22, y+31, x-4, y+27 FROM o UNION ALL SELECT k, x-4, y+27, x, y FROM o"""

_SITES = f"""WITH s AS (SELECT site, median(lat) AS lat, median(lon) AS lon, count(value) AS n_periods, stddev_pop(value) AS sd, avg(value) AS site_mean
  FROM fx_station_day GROUP BY site),
 p AS (SELECT *, greatest(0, least(11, CAST(ceil((lat+82.5e0)/15-0.5e0) AS INT))) AS iy, greatest(0, least(23, CAST(ceil((lon+172.5e0)/15-0.5e0) AS INT))) AS ix FROM s),
 q AS (SELECT p.*, (iy//3)*8+ix//3 AS block, coalesce(c.land, false) AS land, abs(p.lat-(-82.5e0+15*iy))<=7.5e0 AND abs(p.lon-(-172.5e0+15*ix))<=7.5e0 AS inside_cell
  FROM p LEFT JOIN (SELECT iy, ix, land FROM fx_cells) c USING (iy, ix))
 SELECT *, n_periods>={MIN_PERIODS} AND sd>0 AND land AND inside_cell AS eligible FROM q"""

_SITE_Z = """SELECT site, t, iy, ix, block, (value-site_mean)/sd AS z FROM fx_station_day d JOIN (SELECT site, iy, ix, block, site_mean, sd FROM fx_sites WHERE eligible) USING (site)"""

_GRID_OBS = "SELECT block, iy, ix, t, count(*) AS n_sites, median(z) AS obs FROM fx_site_z GROUP BY block, iy, ix, t"

_PAIR_ROWS = f"""WITH f AS (SELECT t, iy, ix FROM fx_station_model GROUP BY t, iy, ix HAVING count(*)=10),
 c AS (SELECT g.* FROM fx_grid_obs g JOIN f USING (t, iy, ix)),
 d AS (SELECT a.block, a.iy AS iy_i, a.ix AS ix_i, b.iy AS iy_j, b.ix AS ix_j, a.t, a.obs-b.obs AS obs_d FROM c a JOIN c b ON a.block=b.block AND a.t=b.t
  AND (a.iy<b.iy OR (a.iy=b.iy AND a.ix<b.ix))),
 l AS (SELECT d.*, x.model, x.variant, x.value-y.value AS model_d FROM d JOIN fx_station_model x ON x.t=d.t AND x.iy=iy_i AND x.ix=ix_i
  JOIN fx_station_model y ON y.t=d.t AND y.iy=iy_j AND y.ix=ix_j AND y.model=x.model AND y.variant=x.variant),
 r AS (SELECT *, {sql_rank("obs_d", "block, iy_i, ix_i, iy_j, ix_j, model, variant")} AS ro,
  {sql_rank("model_d", "block, iy_i, ix_i, iy_j, ix_j, model, variant")} AS rm FROM l),
 p AS (SELECT block, iy_i, ix_i, iy_j, ix_j, model, variant, count(*) AS n_common, {sql_corr("model_d", "obs_d", 1)} AS pearson_r, {sql_corr("rm", "ro", 1)} AS spearman_rho,
  avg(CASE WHEN sign(obs_d)=sign(model_d) THEN 1e0 ELSE 0 END) AS sign_agreement, count(*) FILTER (obs_d=0) AS obs_zero, stddev_pop(obs_d) AS so, stddev_pop(model_d) AS sm,
  string_agg(strftime(t,'%Y-%m-%d'), ';' ORDER BY t) AS common_periods FROM r GROUP BY ALL)
 SELECT *, CASE WHEN n_common<{MIN_COMMON} THEN 'insufficient_common_months' WHEN min(least(so, sm)) OVER (PARTITION BY block, iy_i, ix_i, iy_j, ix_j)=0
  THEN 'constant_difference_in_observation_or_model' END AS reason FROM p"""

_PAIR_METRICS = """SELECT p.*, a.aridity AS beta_i, b.aridity AS beta_j, (a.aridity+b.aridity)/2 AS beta_pair FROM fx_pair_rows p
 JOIN fx_cells a ON a.iy=iy_i AND a.ix=ix_i JOIN fx_cells b ON b.iy=iy_j AND b.ix=ix_j WHERE reason IS NULL"""

_BLOCK_MEDIANS = f"""WITH k AS (SELECT * FROM fx_pair_metrics WHERE variant='corrected' AND n_common>={MAIN_COMMON}),
 e AS (SELECT block, model, count(DISTINCT c) AS n_cells FROM (SELECT block, model, iy_i*24+ix_i AS c FROM k UNION ALL SELECT block, model, iy_j*24+ix_j FROM k) GROUP BY ALL)
 SELECT block, model, count(*) AS n_pairs, max(n_cells) AS n_cells, median(pearson_r) AS median_pcc, median(spearman_rho) AS median_spearman,
 median(sign_agreement) AS median_sign FROM k JOIN e USING (block, model) GROUP BY block, model"""


def sql_draw(b: str, k: str, n: str, seed: int = SEED) -> str:
    """SQL text of a hashed draw."""
    return f"(CAST('0x'||substr(md5(concat_ws('|','{seed}',CAST({b} AS VARCHAR),CAST({k} AS VARCHAR))),1,12) AS BIGINT) % {n})"


VIEWS = {
    "fx_lines": _LINES,
    "fx_field": _FIELD,
    "fx_field_long": "SELECT * FROM (UNPIVOT fx_field ON prior, obs, s1, s2, s3 INTO NAME field VALUE value)",
    "fx_raw_model": _RAW,
    "fx_model": _MODEL,
    "fx_cells": _CELLS,
    "fx_valid": _VALID,
    "fx_pred": _PRED,
    "fx_polygons": _POLYGONS,
    "fx_polygon_edges": _EDGES,
    "fx_sites": _SITES,
    "fx_site_z": _SITE_Z,
    "fx_grid_obs": _GRID_OBS,
    "fx_pair_rows": _PAIR_ROWS,
    "fx_pair_metrics": _PAIR_METRICS,
    "fx_block_medians": _BLOCK_MEDIANS,
    "fx_coarse": _COARSE,
    "fx_common": _COMMON,
    "fx_fine_eval": _FINE_EVAL,
    "fx_coarse_eval": _COARSE_EVAL,
    "fx_external": _EXTERNAL,
    "fx_consistency": _CONSISTENCY,
    "fx_split": _SPLIT,
    "fx_station_raw": _STATION_RAW,
    "fx_station_qc": _STATION_QC,
    "fx_station_day": _STATION_DAY,
    "fx_station_model": _STATION_MODEL,
}
