"""Sources, sinks and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.operators import skill
from isopleth.plans.fixtures import Fixtures
from isopleth.plans.registry import query
from isopleth.plans.skill import TEMPORAL_SQL, _temporal
from isopleth.session import scratch
from isopleth.sources import provenance, readers, sinks, stores


def _folder(fx: Fixtures, name: str) -> str:
    """A new folder for a round trip."""
    return scratch(fx.spark, name)


@query("src_field_table", "field:s t:d iy:i ix:i value:f", "SELECT * FROM fx_field_long")
def field_table(fx: Fixtures):
    """Write the long table partitioned by field, read it back with its schema."""
    path = _folder(fx, "field")
    sinks.write_table(fx.field_long, path, ["field"])
    return readers.read_field(fx.spark, path)


@query(
    "src_alias_resolve",
    "lon:f lat:f time:d value:f",
    "SELECT lon, lat, CAST(ts AS DATE) AS time, value FROM fx_station_raw WHERE value IS NOT NULL",
)
def alias_resolve(fx: Fixtures):
    odd = fx.station_raw.select(
        F.col("lon").alias("Longitude"), F.col("lat").alias("y"), F.col("ts").alias("valid_time"), F.col("value").alias("TWS")
    )
    named = readers.canonical_columns(odd)
    value = readers.first_available(named, ["tws", "lwe_thickness"]).alias("value")
    return named.select("lon", "lat", "time", value).where("value IS NOT NULL")


@query(
    "src_variant_resolve",
    "wanted:s model:s t:d total:f",
    """WITH w AS (SELECT model, t, variant, value FROM fx_model)
--
SELECT 'corrected' AS wanted, model, t, sum(value) AS total FROM w WHERE variant='corrected' GROUP BY model, t UNION ALL
SELECT 'projected', model, t, sum(value) FROM w WHERE variant='raw' GROUP BY model, t UNION ALL SELECT 'auto', model, t, sum(value) FROM w WHERE variant='corrected' GROUP BY model, t""",
)
def variant_resolve(fx: Fixtures):
    """The projected variant is absent, so it falls back to the plain column."""
    wide = fx.model.groupBy("model", "t", "iy", "ix").agg(
        F.max(F.when(F.col("variant") == "raw", F.col("value"))).alias("predicted_twsa"),
        F.max(F.when(F.col("variant") == "corrected", F.col("value"))).alias("predicted_twsa_corrected"),
    )
    picks = F.array(
        *[
            F.struct(F.lit(v).alias("wanted"), F.col(readers.variant_column(wide.columns, v, "corrected")).alias("v"))
            for v in ("corrected", "projected", "auto")
        ]
    )
    return wide.select("model", "t", F.explode(picks).alias("p")).groupBy("p.wanted", "model", "t").agg(F.sum("p.v").alias("total"))


@query("src_csv", "t:d iy:i ix:i prior:f obs:f", "SELECT t, iy, ix, prior, obs FROM fx_field")
def csv_round_trip(fx: Fixtures):
    path = _folder(fx, "csv")
    sinks.write_report(fx.field.select("t", "iy", "ix", "prior", "obs"), path)
    schema = T.StructType(
        [
            T.StructField("t", T.DateType()),
            T.StructField("iy", T.IntegerType()),
            T.StructField("ix", T.IntegerType()),
            T.StructField("prior", T.DoubleType()),
            T.StructField("obs", T.DoubleType()),
        ]
    )
    return readers.read_csv(fx.spark, path, schema)


@query(
    "src_json_features",
    "id:s site:s parameter:s status:s n_qualifiers:i unit:s value:f day:d lon:f lat:f",
    """SELECT CAST(id AS VARCHAR) AS id, site, parameter, status, len(qualifiers) AS n_qualifiers, unit, value, ts AS day, lon, lat FROM fx_station_raw
 WHERE value IS NOT NULL""",
)
def json_features(fx: Fixtures):
    """Collections of at most 64 features, parsed back and exploded."""
    feature = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(
            F.col("site").alias("monitoring_location_id"),
            F.col("parameter").alias("parameter_code"),
            F.col("status").alias("approval_status"),
            F.col("qualifiers").alias("qualifier"),
            F.col("unit").alias("unit_of_measure"),
            F.coalesce(F.col("value").cast("string"), F.lit("n/a")).alias("value"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        ).alias("properties"),
        F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    pages = fx.station_raw.groupBy(F.floor(F.col("id") / 64).alias("page")).agg(
        F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("body")
    )
    return readers.features(pages, "body").withColumns({"n_qualifiers": F.size("qualifiers"), "day": F.col("ts")})


@query(
    "src_whitespace_text",
    "doc_id:i a:s b:s c:s n_fields:i complete:b",
    r"""WITH p AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ') AS p FROM documents)
--
SELECT doc_id, p[1] AS a, p[2] AS b, p[3] AS c, len(p) AS n_fields, len(p)=3 AS complete FROM p""",
)
def whitespace_text(fx: Fixtures):
    docs = fx.table("documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return readers.whitespace_fields(docs, "text", ["a", "b", "c"])


@query("src_multifile_union", "t:d iy:i ix:i s1:f s2:f", "SELECT t, iy, ix, s1, CASE WHEN t>=DATE '1998-01-01' THEN s2 END AS s2 FROM fx_field")
def multifile_union(fx: Fixtures):
    """Two parts of the record; the older one lacks a variable."""
    cut = F.lit("1998-01-01").cast("date")
    old = fx.field.where(F.col("t") < cut).select("t", "iy", "ix", "s1")
    new = fx.field.where(F.col("t") >= cut).select("t", "iy", "ix", "s1", "s2")
    return readers.union_files([old, new], ["t", "iy", "ix"])


@query(
    "src_variable_merge_exact",
    "t:d iy:i ix:i obs:f prior:f s1:f",
    "SELECT t, iy, ix, obs, prior, s1 FROM fx_field",
)
def variable_merge_exact(fx: Fixtures):
    keys = ["t", "iy", "ix"]
    return readers.merge_exact([(fx.field.select(*keys, v), v) for v in ("obs", "prior", "s1")], keys)


@query(
    "src_month_from_filename",
    "month:s n:i",
    "SELECT strftime(l_shipdate,'%Y-%m') AS month, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1",
)
def month_from_filename(fx: Fixtures):
    """Daily files named after their day; months outside the window are skipped."""
    name = F.concat(F.lit("field_L3_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_R19.h5"))
    months = fx.table("lineitem").select(readers.month_from_name(name).alias("month"))
    return months.where(F.col("month").between("1996-01", "1998-12")).groupBy("month").agg(F.count("*").alias("n"))


@query(
    "src_skip_unreadable",
    "day:i kind:s n_files:i n_rows:i n_reasons:i",
    """SELECT d AS day, CASE WHEN d<=20 THEN 'daily' ELSE 'broken' END AS kind, 1 AS n_files, CASE WHEN d<=20 THEN n END AS n_rows,
 CASE WHEN d<=20 THEN 0 ELSE 1 END AS n_reasons FROM (SELECT day(ts) AS d, count(*) AS n FROM events GROUP BY 1)
 UNION ALL SELECT DISTINCT 0, 'empty', 1, 0, 0 FROM events""",
)
def skip_unreadable(fx: Fixtures):
    """A file per day, of which the later ones are not what they claim to be, and one without rows."""
    root = _folder(fx, "daily")
    days = fx.table("events").select("event_id", "value", F.dayofmonth("ts").alias("d"))
    sinks.write_table(days.where("d <= 20").repartition("d"), f"{root}/kind=daily", ["d"])
    days.limit(0).drop("d").coalesce(1).write.parquet(f"{root}/kind=empty/d=0")
    text = days.where("d > 20").select("d", F.col("value").cast("string"))
    sinks.write_table(text.repartition("d"), f"{root}/kind=broken", ["d"], fmt="text")
    read = readers.file_report(fx.spark, root, "parquet", ["event_id", "value"], "part-*")
    kind, day = (F.regexp_extract("path", pattern, 1) for pattern in (r"kind=(\w+)/", r"/d=(\d+)/"))
    return read.groupBy(day.cast("int").alias("day"), kind.alias("kind")).agg(
        F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.count("reason").alias("n_reasons")
    )


@query(
    "src_link_extract",
    "page_id:i link:s pos:i name:s",
    r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1, 'i')) AS href, generate_subscripts(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1, 'i'), 1)-1 AS pos FROM pages),
a AS (SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href ELSE href END AS link FROM h)
--
SELECT page_id, link, min(pos) AS pos, regexp_extract(link, '([^/]*)$', 1) AS name FROM a WHERE lower(link) LIKE '%example%' AND (lower(link) LIKE '%e' OR lower(link) LIKE '%n')
 GROUP BY page_id, link""",
)
def link_extract(fx: Fixtures):
    found = readers.links(fx.table("pages").select("page_id", "url", "html"), "url", "html", ["example"], ["e", "n"])
    return found.withColumn("name", readers.file_name(F.col("link")))


@query("prov_sha256_manifest", "path:s bytes:i sha256:s")
def sha256_manifest(fx: Fixtures):
    return provenance.file_manifest(fx.spark, fx.dir, "*.parquet")


@query("prov_folder_hash", "sha256:s n_files:i")
def folder_hash(fx: Fixtures):
    """The folder of all tables as one hash of names and sizes."""
    files = stores.listed(fx.spark, fx.dir)
    return provenance.folder_digest(files.select(stores.below(fx.spark, fx.dir).alias("path"), "bytes"))


@query(
    "prov_inventory_verify",
    "path:s fault:s",
    """SELECT 'd'||doc_id AS path, CASE WHEN doc_id%10=0 THEN 'missing' WHEN doc_id%10=1 THEN 'size' ELSE 'hash' END AS fault FROM documents WHERE doc_id%10<3""",
)
def inventory_verify(fx: Fixtures):
    """Texts as files: some are gone, some changed length, some changed content."""
    docs = fx.table("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"),
        "doc_id",
        F.octet_length("text").cast("long").alias("bytes"),
        F.sha2("text", 256).alias("sha256"),
    )
    case = F.col("doc_id") % 10
    present = docs.where(case != 0).select(
        "path",
        F.when(case == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(case == 2, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return provenance.inventory_faults(docs.drop("doc_id"), present)


@query(
    "prov_inventory_upsert",
    "dataset_id:s status:s n:i notes:s",
    """SELECT source||'_'||lang AS dataset_id, CASE WHEN lang='en' THEN 'updated' ELSE 'ready' END AS status, count(*) AS n, CASE WHEN lang='en' THEN 'new' END AS notes
 FROM documents GROUP BY source, lang UNION ALL SELECT 'extra_en', 'updated', 0, 'new'""",
)
def inventory_upsert(fx: Fixtures):
    stock = fx.table("documents").groupBy(F.concat_ws("_", "source", "lang").alias("dataset_id")).agg(
        F.count("*").alias("n")
    ).withColumn("status", F.lit("ready"))
    renewed = stock.where(F.col("dataset_id").endswith("_en")).withColumns(
        {"status": F.lit("updated"), "notes": F.lit("new")}
    )
    extra = fx.spark.range(1).select(
        F.lit("extra_en").alias("dataset_id"), F.lit(0).cast("long").alias("n"), F.lit("updated").alias("status"), F.lit("new").alias("notes")
    )
    return provenance.upsert(stock, renewed.unionByName(extra), "dataset_id")


@query(
    "prov_store_extent",
    "field:s time_range:s lat_step:f lon_step:f",
    """SELECT field, strftime(min(t),'%Y-%m')||' to '||strftime(max(t),'%Y-%m') AS time_range, round(15e0*(max(iy)-min(iy))/(count(DISTINCT iy)-1),6) AS lat_step,
 round(15e0*(max(ix)-min(ix))/(count(DISTINCT ix)-1),6) AS lon_step FROM fx_field_long GROUP BY field""",
)
def store_extent(fx: Fixtures):
    return provenance.extent(fx.field_long, ["field"], fx.grid.lat(), fx.grid.lon())


@query(
    "prov_weight_reproduction",
    "value:s max_difference:f identical_gaps:b ok:b",
    """SELECT 'obs' AS value, max(abs(obs-prior)) AS max_difference, true AS identical_gaps, false AS ok FROM fx_field
 UNION ALL SELECT 's3', 0, bool_and((s3 IS NULL)=(s3 IS NULL OR iy=0)), false FROM fx_field UNION ALL SELECT 's1', 0, true, true FROM fx_field LIMIT 3""",
)
def weight_reproduction(fx: Fixtures):
    new = fx.field.select(
        "t", "iy", "ix", F.col("prior").alias("obs"), F.when(F.col("iy") != 0, F.col("s3")).alias("s3"), "s1"
    )
    return provenance.reproduction(fx.field, new, ["t", "iy", "ix"], ["obs", "s3", "s1"])


@query(
    "prov_metric_recheck",
    "n_rows:i max_rmse:f max_pcc:f",
    f"WITH {TEMPORAL_SQL}\n--\nSELECT count(*) AS n_rows, 0 AS max_rmse, 0 AS max_pcc FROM tm",
)
def metric_recheck(fx: Fixtures):
    """The cell skill recomputed from plain sums."""
    keys = ["model", "cy", "cx"]
    rows = fx.coarse_eval.where("variant = 'corrected'")
    v, r = F.col("value"), F.col("ref")
    n, sv, sr = F.count("*"), F.sum(v), F.sum(r)
    cov = F.sum(v * r) - sv * sr / n
    var = (F.sum(v * v) - sv * sv / n) * (F.sum(r * r) - sr * sr / n)
    again = rows.groupBy(*keys).agg(
        F.sqrt((F.sum(v * v) - 2 * F.sum(v * r) + F.sum(r * r)) / n).alias("rmse"), (cov / F.sqrt(var)).alias("pcc")
    )
    return provenance.metric_recheck(_temporal(fx), again, keys, ["rmse", "pcc"])


@query(
    "prov_table_equal",
    "matched:i only_first:i only_second:i differing:i",
    """SELECT (SELECT count(*) FROM fx_field WHERE iy<>11 AND ix<>0) AS matched, (SELECT count(*) FROM fx_field WHERE iy=11 AND ix<>0) AS only_first,
 (SELECT count(*) FROM fx_field WHERE ix=0 AND iy<>11) AS only_second, (SELECT count(*) FROM fx_field WHERE iy<>11 AND ix=5) AS differing""",
)
def table_equal(fx: Fixtures):
    keys = ["t", "iy", "ix"]
    first = fx.field.where("ix <> 0").select(*keys, "obs")
    second = fx.field.where("iy <> 11").select(*keys, F.when(F.col("ix") == 5, F.col("obs") + 1e-3).otherwise(F.col("obs")).alias("obs"))
    return provenance.tables_equal(first, second, keys, ["obs"], 1e-13, 1e-13)


@query(
    "sink_table",
    "turn:s field:s n_rows:i total:f",
    """SELECT 'kept' AS turn, field, count(*) AS n_rows, sum(value) AS total FROM fx_field_long GROUP BY field
 UNION ALL SELECT 'replaced', field, count(*), sum(value+value*iy) FROM fx_field_long WHERE iy>3 GROUP BY field""",
)
def sink_table(fx: Fixtures):
    """A second write without overwrite does nothing; one with it replaces the table that it reads."""
    path, other = _folder(fx, "sink"), _folder(fx, "sink")
    for place in (path, other):
        sinks.write_table(fx.field_long, place, ["field"])
        sinks.write_table(fx.field_long.where("iy = 0"), place, ["field"])
    stored = readers.read_field(fx.spark, other)
    sinks.write_table(stored.where("iy > 3").withColumn("value", F.col("value") * (1 + F.col("iy"))), other, ["field"], overwrite=True)
    turns = [readers.read_field(fx.spark, p).withColumn("turn", F.lit(t)) for p, t in ((path, "kept"), (other, "replaced"))]
    return turns[0].unionByName(turns[1]).groupBy("turn", "field").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))


@query(
    "sink_csv_json",
    "kind:s n_rows:i rmse:f",
    """WITH m AS (SELECT t, sqrt(avg((prior-obs)**2)) AS rmse FROM fx_field GROUP BY t)
--
SELECT kind, count(*) AS n_rows, avg(rmse) AS rmse FROM m, (VALUES ('csv'), ('json')) k(kind) GROUP BY kind""",
)
def sink_csv_json(fx: Fixtures):
    """Metrics as CSV and the summary as JSON, both read back."""
    table = skill.monthly_skill(fx.field, [], "prior", "obs")
    csv, js = _folder(fx, "metrics"), _folder(fx, "summary")
    sinks.write_report(table, csv)
    sinks.write_report(table.agg(F.count("*").alias("n_rows"), F.avg("rmse").alias("rmse")), js, "json")
    schema = T.StructType([T.StructField("t", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("rmse", "mae", "bias")])
    back = readers.read_csv(fx.spark, csv, schema).agg(
        F.lit("csv").alias("kind"), F.count("*").alias("n_rows"), F.avg("rmse").alias("rmse")
    )
    summary = fx.spark.read.schema("n_rows long, rmse double").json(js).select(F.lit("json").alias("kind"), "n_rows", "rmse")
    return back.unionByName(summary)
