"""Field, station and page sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.sources import stores

FIELD_SCHEMA = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("t", T.DateType()),
        T.StructField("iy", T.IntegerType()),
        T.StructField("ix", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Accepted names of the coordinates, in order of preference.
COORDINATES = {
    "lon": ("lon", "longitude", "x"),
    "lat": ("lat", "latitude", "y"),
    "time": ("time", "valid_time", "month", "date"),
}


def resolve(columns: Sequence[str], aliases: Sequence[str], preferred: str | None = None,
            single: bool = False) -> str:
    """First alias present: exact, then ignoring case, then the only column if ``single``."""
    if preferred and preferred in columns:
        return preferred
    lowered = {c.lower(): c for c in columns}
    for table in ({c: c for c in columns}, lowered):
        for a in aliases:
            key = a if table is not lowered else a.lower()
            if key in table:
                return table[key]
    if single and len(columns) == 1:
        return columns[0]
    raise KeyError(f"none of {list(aliases)} among {list(columns)}")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename coordinate columns to ``lon``, ``lat`` and ``time`` (time may be absent)."""
    names = {}
    for target, aliases in COORDINATES.items():
        try:
            names[resolve(df.columns, aliases)] = target
        except KeyError:
            if target != "time":
                raise
    return df.withColumnsRenamed(names)


def nan_free(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    none = F.lit(None)
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)).otherwise(none) for c in floats})


def read_field(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
               schema: T.StructType = FIELD_SCHEMA) -> DataFrame:
    """A field table from Parquet or CSV with a declared schema."""
    reader = spark.read.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    return nan_free(reader.option("header", True).csv(paths) if fmt == "csv" else reader.parquet(*paths))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def first_available(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The column of the first alias the table has."""
    return F.col(resolve(df.columns, aliases))


# Column of each prediction variant, and the fallback.
VARIANTS = {
    "raw": "predicted_twsa_raw",
    "corrected": "predicted_twsa_corrected",
    "projected": "predicted_twsa_projected",
}
COARSE_VARIANTS = {
    "raw": "predicted_twsa_coarse_raw",
    "corrected": "predicted_twsa_coarse_corrected",
    "projected": "predicted_twsa_coarse_projected",
}


def variant_column(columns: Sequence[str], variant: str = "auto", default: str = "raw", coarse: bool = False) -> str:
    """Column of a prediction variant; ``auto`` follows the stored default, except raw means the plain one."""
    table = COARSE_VARIANTS if coarse else VARIANTS
    plain = "predicted_twsa_coarse" if coarse else "predicted_twsa"
    wanted = table.get(variant) if variant != "auto" else table.get(default if default != "raw" else "")
    return wanted if wanted in columns else plain


def union_files(parts: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """Tables of several files as one; a column a file lacks is NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.sort(*order) if order else out


def merge_exact(tables: Sequence[tuple[DataFrame, str]], keys: Sequence[str]) -> DataFrame:
    """Join variables whose coordinates must be identical; any difference fails the query."""
    keys = list(keys)
    sides = [df.select(*keys, name, F.lit(1).alias(f"_has_{name}")) for df, name in tables]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), sides)
    gap = reduce(lambda a, b: a | b, [F.col(f"_has_{name}").isNull() for _, name in tables])
    first = tables[0][1]
    kind = dict(joined.dtypes)[first]
    checked = F.when(gap, F.raise_error(F.lit("coordinates differ between variables")).cast(kind)).otherwise(F.col(first))
    return joined.withColumn(first, checked).drop(*[f"_has_{name}" for _, name in tables])


def month_from_name(name: Column) -> Column:
    """``YYYY-MM`` from the first eight digits in a file name, NULL without them."""
    digits = F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit(""))
    return F.concat_ws("-", F.substring(digits, 1, 4), F.nullif(F.substring(digits, 5, 2), F.lit(""))).try_cast("string")


# Field names of the feature collections.
FEATURE_TYPE = (
    "struct<features:array<struct<id:string,properties:struct<monitoring_location_id:string,parameter_code:string,"
    "approval_status:string,qualifier:array<string>,unit_of_measure:string,value:string,time:string>,"
    "geometry:struct<coordinates:array<double>>>>>"
)


def features(df: DataFrame, text: str) -> DataFrame:
    """Features of JSON collections as rows; those without a number, a time or coordinates are dropped."""
    parsed = df.select(F.explode(F.from_json(text, FEATURE_TYPE)["features"]).alias("f"))
    p = "f.properties"
    rows = parsed.select(
        F.col("f.id").alias("id"),
        F.col(f"{p}.monitoring_location_id").alias("site"),
        F.col(f"{p}.parameter_code").alias("parameter"),
        F.col(f"{p}.approval_status").alias("status"),
        F.coalesce(f"{p}.qualifier", F.array().cast("array<string>")).alias("qualifiers"),
        F.col(f"{p}.unit_of_measure").alias("unit"),
        F.col(f"{p}.value").try_cast("double").alias("value"),
        F.try_to_timestamp(F.col(f"{p}.time")).alias("ts"),
        F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"),
        F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"),
    )
    return nan_free(rows).dropna(subset=["value", "ts", "lon", "lat"])


def whitespace_fields(df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Columns from blank-separated lines; lines with another number of fields are kept apart by ``complete``."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    return df.withColumn("_p", parts).select(
        *[c for c in df.columns if c != text],
        *[F.try_element_at("_p", F.lit(i + 1)).alias(n) for i, n in enumerate(names)],
        F.size("_p").alias("n_fields"),
        (F.size("_p") == len(names)).alias("complete"),
    )


def file_report(spark: SparkSession, folders: str | Sequence[str], fmt: str, columns: Sequence[str], pattern: str = "*") -> DataFrame:
    """``path, name, status, reason, n_rows`` of every file below the folders; nothing is passed over in silence.

    Each file is read to its end once (:func:`isopleth.sources.stores.read_attempts`):
    ``read`` with its rows, also if it has none, or ``skipped`` with the reason.
    """
    tried = stores.read_attempts(stores.listed(spark, folders, pattern), fmt, columns)
    return tried.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.when(F.col("reason").isNull(), "read").otherwise("skipped").alias("status"),
        "reason",
        "n_rows",
    )


def links(pages: DataFrame, url: str, html: str, contains: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Absolute links per page in order of first occurrence.

    A link must hold every token of ``contains`` and end with one of
    ``suffixes`` (case ignored).  The whole page text is searched.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    base = F.col(url)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    href = F.col("href")
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), href))
    )
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(found).alias("pos", "href")).withColumn("link", absolute)
    low = F.lower("link")
    for token in contains:
        rows = rows.where(low.contains(token.lower()))
    if suffixes:
        rows = rows.where(reduce(lambda a, b: a | b, [low.endswith(s.lower()) for s in suffixes]))
    return rows.groupBy(*rest, "link").agg(F.min("pos").alias("pos"))


def file_name(link: Column) -> Column:
    """Last path part of a URL, ``download.bin`` if empty."""
    path = F.regexp_extract(F.regexp_replace(link, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*)?$", 1)
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("download.bin"))
