"""Coordinates, calendar and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from isopleth.functions import geo, time, units
from isopleth.functions.stats import scalar
from isopleth.operators import guards, temporal
from isopleth.plans.fixtures import TRAIN_END, VAL_END, Fixtures
from isopleth.plans.registry import query


@query(
    "geo_lon_wrap",
    "id:i lon:f",
    """WITH x AS (SELECT id, lon+180+400*(id%5-2) AS a FROM fx_station_raw)
--
SELECT id, a-360*floor(a/360)-180 AS lon FROM x""",
)
def lon_wrap(fx: Fixtures):
    return fx.station_raw.select("id", geo.wrap_longitude(F.col("lon") + 400 * (F.col("id") % 5 - 2)).alias("lon"))


@query(
    "geo_target_grid",
    "iy:i ix:i lat:f lon:f n:i",
    """SELECT iy, ix, -82.5e0+15*iy AS lat, -172.5e0+15*ix AS lon, coalesce(n,0) AS n
 FROM (SELECT unnest(range(0,12)) AS iy) CROSS JOIN (SELECT unnest(range(0,24)) AS ix)
 LEFT JOIN (SELECT iy, ix, count(*) AS n FROM fx_lines GROUP BY iy, ix) USING (iy, ix)""",
)
def target_grid(fx: Fixtures):
    counts = fx.lines.groupBy("iy", "ix").agg(F.count("*").alias("n"))
    return fx.grid.cells(fx.spark).join(counts, ["iy", "ix"], "left").fillna(0, ["n"])


@query(
    "geo_area_weight",
    "iy:i ix:i w:f w_norm:f km2:g",
    """SELECT iy, ix, w, greatest(w,1e-12)/(SELECT max(greatest(w,1e-12)) FROM fx_cells) AS w_norm,
 6371.0088e0**2*radians(15)*radians(15)*cos(radians(lat)) AS km2 FROM fx_cells""",
)
def area_weight(fx: Fixtures):
    top = fx.cells.agg(F.max(F.greatest("w", F.lit(1e-12))).alias("m"))
    return fx.cells.select(
        "iy",
        "ix",
        "w",
        (F.greatest("w", F.lit(1e-12)) / scalar(top)).alias("w_norm"),
        geo.cell_area_km2("lat", fx.grid.dlat, fx.grid.dlon).alias("km2"),
    )


@query(
    "geo_nearest_cell",
    "site:s iy_near:i ix_near:i iy_even:i ix_even:i iy_floor:i ix_floor:i",
    """SELECT DISTINCT site, greatest(0,least(11,ceil((lat+82.5e0)/15-0.5e0))) AS iy_near,
 greatest(0,least(23,ceil((lon+172.5e0)/15-0.5e0))) AS ix_near, round_even((lat+82.5e0)/15,0) AS iy_even,
 round_even((lon+172.5e0)/15,0) AS ix_even, floor((lat+90)/15) AS iy_floor, floor((lon+180)/15) AS ix_floor FROM fx_station_raw""",
)
def nearest_cell(fx: Fixtures):
    g = fx.grid
    return fx.station_raw.select(
        "site",
        g.nearest_iy().alias("iy_near"),
        g.nearest_ix().alias("ix_near"),
        geo.index_half_even("lat", g.lat0, g.dlat).alias("iy_even"),
        geo.index_half_even("lon", g.lon0, g.dlon).alias("ix_even"),
        geo.index_floor("lat", g.lat0, g.dlat).alias("iy_floor"),
        geo.index_floor("lon", g.lon0, g.dlon).alias("ix_floor"),
    ).distinct()


@query(
    "geo_block_membership",
    "iy:i ix:i block:i n:i",
    "SELECT iy, ix, (iy//3)*8+ix//3 AS block, count(*) AS n FROM fx_lines GROUP BY iy, ix",
)
def block_membership(fx: Fixtures):
    return fx.lines.groupBy("iy", "ix").agg(F.count("*").alias("n")).withColumn("block", fx.grid.block_id())


@query(
    "geo_bin_id",
    "site:s box3:i box5:i quad:i",
    """SELECT DISTINCT site, floor((lat+90)/3)*120+floor((lon+180)/3) AS box3, floor((lat+90)/5)*72+floor((lon+180)/5) AS box5,
 (greatest(0,least(11,CAST(ceil((lat+82.5e0)/15-0.5e0) AS INT)))//6)*4+greatest(0,least(23,CAST(ceil((lon+172.5e0)/15-0.5e0) AS INT)))//6
 AS quad FROM fx_station_raw""",
)
def bin_id(fx: Fixtures):
    g = fx.grid
    block = g.block_id(g.nearest_iy(), g.nearest_ix())
    return fx.station_raw.select(
        "site",
        geo.box_id("lat", "lon", 3.0).alias("box3"),
        geo.box_id("lat", "lon", 5.0).alias("box5"),
        geo.quad_block_id(block, g.block_columns).alias("quad"),
    ).distinct()


@query(
    "geo_grid_guard",
    "axis:s common:i only_left:i only_right:i cells:i ambiguous:i empty:i",
    """WITH a AS (SELECT DISTINCT u.axis, u.x FROM fx_field, LATERAL (VALUES ('lat', -82.5e0+15*iy), ('lon', -172.5e0+15*ix)) u(axis, x) WHERE obs IS NOT NULL),
b AS (SELECT DISTINCT u.axis, u.x FROM fx_field, LATERAL (VALUES ('lat', -82.5e0+15*iy+5e-9), ('lon', -172.5e0+15*ix+(CASE WHEN ix%3=0 THEN 5e-8 ELSE 0e0 END))) u(axis, x) WHERE s3 IS NOT NULL),
z AS (SELECT iy, ix, count(DISTINCT zone_id+(CASE WHEN iy=5 AND month(t)=2 THEN 1 ELSE 0 END)) FILTER (zone_id%7<>3) AS n FROM fx_field JOIN fx_cells USING (iy, ix) GROUP BY iy, ix)
--
SELECT axis, (SELECT count(*) FROM a WHERE a.axis=g.axis AND EXISTS (SELECT 1 FROM b WHERE b.axis=a.axis AND abs(a.x-b.x)<=1e-8)) AS common,
 (SELECT count(*) FROM a WHERE a.axis=g.axis AND NOT EXISTS (SELECT 1 FROM b WHERE b.axis=a.axis AND abs(a.x-b.x)<=1e-8)) AS only_left,
 (SELECT count(*) FROM b WHERE b.axis=g.axis AND NOT EXISTS (SELECT 1 FROM a WHERE b.axis=a.axis AND abs(a.x-b.x)<=1e-8)) AS only_right,
 (SELECT count(*) FROM z) AS cells, (SELECT count(*) FROM z WHERE n>1) AS ambiguous, (SELECT count(*) FROM z WHERE n=0) AS empty FROM (SELECT DISTINCT axis FROM a) g""",
)
def grid_guard(fx: Fixtures):
    """Two variables of the cube: one axis is off by less than the tolerance, one by more in every third place.

    The zone raster changes in one row of the grid in February and has no zone here and there.
    """
    g = fx.grid
    left = fx.field.where("obs IS NOT NULL").select(g.lat().alias("lat"), g.lon().alias("lon"))
    off = F.when(F.col("ix") % 3 == 0, 5e-8).otherwise(0.0)
    right = fx.field.where("s3 IS NOT NULL").select((g.lat() + 5e-9).alias("lat"), (g.lon() + off).alias("lon"))
    moved = F.when((F.col("iy") == 5) & (F.month("t") == 2), F.col("zone_id") + 1).otherwise(F.col("zone_id"))
    zones = g.attach(fx.field.select("t", "iy", "ix"), fx.cells.select("iy", "ix", "zone_id"))
    zones = zones.select("iy", "ix", F.when(F.col("zone_id") % 7 != 3, moved).alias("zone"))
    faults = guards.raster_faults(zones, ["iy", "ix"], "zone")
    axes = guards.axis_mismatch(left, right, ["lat", "lon"])
    one = faults.select(F.struct("cells", "ambiguous", "empty").alias("s"))
    return axes.withColumn("s", scalar(one)).select("axis", "common", "only_left", "only_right", "s.*")


@query(
    "time_month_start",
    "month:d n:i",
    "SELECT date_trunc('month', l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY 1",
)
def month_start(fx: Fixtures):
    return fx.table("lineitem").groupBy(time.month_start("l_shipdate").alias("month")).agg(F.count("*").alias("n"))


@query(
    "time_dup_month_mean",
    "t:d iy:i ix:i price:f qty:f",
    "SELECT t, iy, ix, avg(price) AS price, avg(qty) AS qty FROM fx_lines GROUP BY t, iy, ix",
)
def dup_month_mean(fx: Fixtures):
    return temporal.duplicate_month_mean(fx.lines, ["t", "iy", "ix"], ["price", "qty"])


ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
KEYS = """CAST(date_trunc('month', l_shipdate) AS DATE) AS t, l_partkey%12 AS iy, l_orderkey%24 AS ix"""


def _stamped(fx: Fixtures):
    return fx.table("lineitem").withColumns(
        {
            "t": time.month_start("l_shipdate"),
            "iy": F.col("l_partkey") % 12,
            "ix": F.col("l_orderkey") % 24,
            "v": F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")),
        }
    )


@query(
    "time_dup_month_first",
    "t:d iy:i ix:i v:f",
    f"""WITH s AS (SELECT {KEYS}, CASE WHEN l_linenumber<>3 THEN l_extendedprice END AS v, * FROM lineitem)
--
SELECT t, iy, ix, arg_min(v, ROW({", ".join(ORDER)}, v)) FILTER (v IS NOT NULL) AS v FROM s GROUP BY t, iy, ix""",
)
def dup_month_first(fx: Fixtures):
    return temporal.duplicate_month_first(_stamped(fx), ["t", "iy", "ix"], "v", ORDER)


@query(
    "time_dup_month_last",
    "t:d iy:i ix:i l_extendedprice:f n_removed:i",
    f"""SELECT {KEYS}, arg_max(l_extendedprice, ROW({", ".join(ORDER)}, l_extendedprice)) AS l_extendedprice,
 count(*)-1 AS n_removed FROM lineitem GROUP BY ALL""",
)
def dup_month_last(fx: Fixtures):
    return temporal.duplicate_month_last(_stamped(fx), ["t", "iy", "ix"], "l_extendedprice", ORDER)


@query(
    "time_right_edge_shift",
    "month:d n:i",
    """SELECT CASE WHEN o_orderkey%2=0 THEN date_trunc('month', o_orderdate - INTERVAL 20 DAY)
 ELSE date_trunc('month', o_orderdate) - INTERVAL 1 MONTH END AS month, count(*) AS n FROM orders GROUP BY 1""",
)
def right_edge_shift(fx: Fixtures):
    lower = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub("o_orderdate", 20))
    month = F.coalesce(time.month_start(lower), time.previous_month("o_orderdate"))
    return fx.table("orders").groupBy(month.alias("month")).agg(F.count("*").alias("n"))


@query(
    "time_slice",
    "inclusive:i month_end:i day_end:i",
    """SELECT count(*) FILTER (l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') AS inclusive,
 count(*) FILTER (l_shipdate>=DATE '1996-01-01' AND l_shipdate < DATE '1998-12-01' + INTERVAL 31 DAY) AS month_end,
 count(*) FILTER (l_shipdate>=DATE '1996-01-01' AND l_shipdate < DATE '1998-12-15' + INTERVAL 1 DAY) AS day_end FROM lineitem""",
)
def time_slice(fx: Fixtures):
    day = F.col("l_shipdate").cast("date")
    start = day >= F.lit("1996-01-01").cast("date")
    return fx.table("lineitem").agg(
        F.count_if(temporal.in_window("1996-01-01", "1998-12-31", "l_shipdate")).alias("inclusive"),
        F.count_if(start & (day < time.exclusive_end("1998-12"))).alias("month_end"),
        F.count_if(start & (day < time.exclusive_end("1998-12-15"))).alias("day_end"),
    )


@query(
    "time_split_label",
    "t:d split:i month:i n:i",
    """SELECT t, CASE WHEN t<=DATE '1998-12-31' THEN 0 WHEN t<=DATE '1999-12-31' THEN 1 ELSE 2 END AS split, month(t) AS month,
 count(*) AS n FROM fx_lines GROUP BY t""",
)
def split_label(fx: Fixtures):
    return fx.lines.groupBy("t").agg(F.count("*").alias("n")).withColumns(
        {"split": time.split_label("t", TRAIN_END, VAL_END), "month": F.month("t")}
    )


@query(
    "time_cyclic_encode",
    "t:d sin0:f cos0:f sin1:f cos1:f",
    """SELECT DISTINCT t, sin(2*pi()*(month(t)-1)/12) AS sin0, cos(2*pi()*(month(t)-1)/12) AS cos0,
 sin(2*pi()*month(t)/12) AS sin1, cos(2*pi()*month(t)/12) AS cos1 FROM fx_lines""",
)
def cyclic_encode(fx: Fixtures):
    (s0, c0), (s1, c1) = time.cyclic("t", True), time.cyclic("t", False)
    return fx.lines.select("t").distinct().select(
        "t", s0.alias("sin0"), c0.alias("cos0"), s1.alias("sin1"), c1.alias("cos1")
    )


@query(
    "time_missing_months",
    "month:d",
    """SELECT unnest(generate_series(DATE '1994-06-01', DATE '2002-06-01', INTERVAL 1 MONTH))::DATE AS month
 EXCEPT SELECT t FROM fx_lines""",
)
def missing_months(fx: Fixtures):
    return guards.missing_months(fx.spark, fx.lines, "t", "1994-06-01", "2002-06-01")


@query(
    "time_mjd",
    "id:i day:d step_day:d",
    """SELECT event_id AS id, DATE '1858-11-17' + CAST(date_diff('day', DATE '1858-11-17', CAST(ts AS DATE)) AS INT) AS day,
 CASE WHEN event_id%50<>0 THEN CAST(ts AS DATE) END AS step_day FROM events""",
)
def mjd(fx: Fixtures):
    code = F.upper(F.date_format("ts", "yyMMMdd"))
    return fx.table("events").select(
        F.col("event_id").alias("id"),
        time.from_mjd(F.datediff("ts", F.lit("1858-11-17").cast("date"))).alias("day"),
        time.step_code(F.when(F.col("event_id") % 50 != 0, code).otherwise("24JANX")).alias("step_day"),
    )


SPELL = """CASE event_type WHEN 'view' THEN 'mm' WHEN 'click' THEN ' kg m^-2' WHEN 'purchase' THEN 'Centimeters'
 WHEN 'signup' THEN 'cm equivalent_water height' ELSE 'kg/m²' END"""


def _spelled(fx: Fixtures):
    kind = F.col("event_type")
    unit = (
        F.when(kind == "view", "mm")
        .when(kind == "click", " kg m^-2")
        .when(kind == "purchase", "Centimeters")
        .when(kind == "signup", "cm equivalent_water height")
        .otherwise("kg/m²")
    )
    return fx.table("events").select(F.col("event_id").alias("id"), unit.alias("unit"), "value")


@query(
    "unit_canonical_mm",
    "id:i unit_name:s mm:f",
    f"""WITH u AS (SELECT event_id AS id, {SPELL} AS unit, value FROM events)
--
SELECT id, CASE WHEN unit ILIKE 'cm%' OR unit ILIKE 'centi%' THEN 'cm' WHEN unit='mm' THEN 'mm' ELSE 'kg_m-2' END AS unit_name,
 CASE WHEN unit ILIKE 'c%' THEN value*10 ELSE value END AS mm FROM u""",
)
def canonical_mm(fx: Fixtures):
    return _spelled(fx).select(
        "id", units.canonical("unit").alias("unit_name"), (F.col("value") * units.factor_to_mm("unit")).alias("mm")
    )


METRE_UNITS = "CASE event_id%6 WHEN 0 THEN 'mmEWH' WHEN 1 THEN 'cm EWH' WHEN 2 THEN 'm' WHEN 3 THEN 'kg m-2' WHEN 4 THEN 'Metre' ELSE 'ft' END"


@query(
    "unit_mm_with_metre",
    "id:i mm:f",
    """SELECT event_id AS id, value*CASE event_id%6 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 1000 WHEN 3 THEN 1 WHEN 4 THEN 1000 END AS mm
 FROM events""",
)
def mm_with_metre(fx: Fixtures):
    rows = fx.table("events").withColumn("unit", F.expr(METRE_UNITS))
    return rows.select(
        F.col("event_id").alias("id"), (F.col("value") * units.factor_to_mm_with_metre("unit")).alias("mm")
    )


HEUR = "CASE event_id%6 WHEN 0 THEN 'kg m**-2' WHEN 1 THEN 'MM' WHEN 2 THEN 'm of water' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Pa' END"


@query(
    "unit_mm_heuristic",
    "id:i mm:f",
    "SELECT event_id AS id, CASE WHEN event_id%6 IN (2,3,4) THEN value*1000 ELSE value END AS mm FROM events",
)
def mm_heuristic(fx: Fixtures):
    rows = fx.table("events").withColumn("unit", F.expr(HEUR))
    return rows.select(F.col("event_id").alias("id"), units.to_mm_by_substring("value", "unit").alias("mm"))


@query(
    "unit_ft_to_m_negate",
    "id:i strict:f lenient:f",
    """SELECT id, CASE unit WHEN 'ft' THEN -(value*0.3048e0) WHEN 'm' THEN -value END AS strict,
 CASE unit WHEN 'ft' THEN -(value*0.3048e0) ELSE -value END AS lenient FROM fx_station_raw""",
)
def ft_to_m_negate(fx: Fixtures):
    return fx.station_raw.select(
        "id",
        units.depth_to_storage("value", "unit").alias("strict"),
        units.depth_to_storage("value", "unit", strict=False).alias("lenient"),
    )
