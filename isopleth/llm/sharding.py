"""Shards of near equal size: sampled splitters cut the key order into ranges, overfull ranges are cut again."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.tables import if_small
from isopleth.llm.text import let, text_or_empty
from isopleth.session import written

#: A place in the order: hash of the key, hash of the row's id, salt of rows alike in both.
Place = tuple[int, int, int]
_PLACES = "array<struct<k:bigint,s:bigint,z:bigint>>"


def _place() -> Column:
    return F.struct(F.col("_k").alias("k"), F.col("_s").alias("s"), F.col("_z").alias("z"))


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def splitters(sample: Sequence[tuple[Place, int]], ranges: int) -> list[Place]:
    """Quantile boundaries of a sample of (place, weight): at most ``ranges`` - 1 places, ascending, none twice."""
    total = sum(w for _, w in sample)
    out, seen, at = [], 0, 1
    for place, weight in sorted(sample):
        seen += weight
        if at < ranges and seen * ranges >= at * total:
            out.append(place)
            at = seen * ranges // total + 1
    return out


def range_of(place: Column, bounds: Column, most: int) -> Column:
    """How many of the ascending ``bounds``, ``most`` at most, are at or below ``place``; found by bisection."""

    def halve(found: Column, step: Column) -> Column:
        probe = found + step
        fits = (probe <= F.size(bounds)) & (F.get(bounds, probe - 1) <= place)
        return F.when(fits, probe).otherwise(found)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), halve)


def _ranged(rows: DataFrame, total: int, ranges: int, sample_rows: int) -> DataFrame:
    """Rows with ``_r``: the range between splitters drawn in proportion to size.

    A row is drawn size / stride times on average, by a hash that recomputed
    tasks repeat; about ``sample_rows`` places come to the driver.
    """
    luck = F.xxhash64(F.lit(1), "_k", "_s", "_z") / F.lit(float(1 << 64)) + 0.5
    times = F.floor(F.col("_size") / F.lit(max(1.0, total / sample_rows)) + luck).cast("long")
    drawn = rows.select("_k", "_s", "_z", times.alias("w")).where("w > 0").collect()
    bounds = splitters([(tuple(r)[:3], r["w"]) for r in drawn], ranges)
    if not bounds:
        return rows.withColumn("_r", F.lit(0))
    # A constant expression: parsed once, when the plan is made.
    listed = F.from_json(F.lit(json.dumps([dict(zip("ksz", b)) for b in bounds])), _PLACES)
    return rows.withColumn("_r", let(listed, lambda b: range_of(_place(), b, len(bounds))))


def _subdivided(ranged: DataFrame, held: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with ``_b``: ranges of more than ``bucket_rows`` rows cut at splitters of their own, others whole.

    About 16 rows are drawn for each part to come, so what is gathered for a
    range is bounded by its parts.
    """
    parts = F.ceil(F.col("_rows") / F.lit(bucket_rows)).cast("int")
    full = written(held.where(F.col("_rows") > bucket_rows).select("_r", parts.alias("_parts")))
    most = full.agg(F.max("_parts")).first()[0]
    if most is None:
        return ranged.withColumn("_b", F.lit(0))
    drawn = F.pmod(F.xxhash64(F.lit(2), "_k", "_s", "_z"), F.lit(max(1, bucket_rows // 16))) == 0
    lists = ranged.where(drawn).join(if_small(full), "_r").groupBy("_r", "_parts").agg(F.sort_array(F.collect_list(_place())).alias("all"))
    nth = lambda i: F.get("all", F.floor(i * F.size("all") / F.col("_parts")).cast("int"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), nth))
    bounds = if_small(written(lists.select("_r", cuts.alias("_cuts"))), rows=4096)
    found = F.coalesce(range_of(_place(), F.col("_cuts"), most), F.lit(0))
    return ranged.join(bounds, "_r", "left").withColumn("_b", found).drop("_cuts")


def _ordered(rows: DataFrame, total: int, ranges: int, sample_rows: int, bucket_rows: int) -> DataFrame:
    """Rows with ``_rank`` and ``_at``: how many rows and bytes come before each in the whole order.

    Only buckets of about ``bucket_rows`` rows are put in order; where each
    begins comes from sums: over the ranges of at most ``ranges`` rows, and
    within a range over its buckets.
    """
    ranged = written(_ranged(rows, total, ranges, sample_rows))
    held = written(ranged.groupBy("_r").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes")))
    cut = written(_subdivided(ranged, held, bucket_rows))

    def before(c: str, window: Window) -> Column:
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    across, inside = Window.orderBy("_r"), Window.partitionBy("_r").orderBy("_b")
    starts = held.select("_r", before("_rows", across).alias("_r0"), before("_bytes", across).alias("_a0"))
    buckets = cut.groupBy("_r", "_b").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes"))
    buckets = buckets.select("_r", "_b", before("_rows", inside).alias("_r1"), before("_bytes", inside).alias("_a1"))
    begun = written(buckets.join(F.broadcast(starts), "_r").select("_r", "_b", (F.col("_r0") + F.col("_r1")).alias("_rank0"), (F.col("_a0") + F.col("_a1")).alias("_at0")))
    own = Window.partitionBy("_r", "_b").orderBy("_k", "_s", "_z")
    counted = cut.withColumns({"_i": F.row_number().over(own) - 1, "_a": before("_size", own)})
    rank, at = F.col("_rank0") + F.col("_i"), F.col("_at0") + F.col("_a")
    return counted.join(if_small(begun), ["_r", "_b"]).select(*rows.columns, rank.alias("_rank"), at.alias("_at"))


def _share(middle2: Column, total: int, shards: int) -> Column:
    """Shard that holds a place of the bytes, given as twice that place."""
    return F.least(F.call_function("div", middle2 * F.lit(shards), F.lit(2 * total)), F.lit(shards - 1)).cast("int")


def place(
    rows: DataFrame,
    size: Column,
    key: Column,
    row_id: Column,
    shards: int = 24,
    slack: float = 1 / 32,
    ranges: int = 1024,
    sample_rows: int = 16_384,
    bucket_rows: int = 8192,
) -> DataFrame:
    """The rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are ordered by the hashes of ``key`` and ``row_id`` and cut into
    shards of equal ``size``: a row goes where its middle lies.  Rows of equal
    key are neighbours and go together, where the middle of all of them lies,
    if all have at most ``slack`` of a shard's size; larger groups are split.
    A shard so differs from the mean by at most half of the rows, or of
    ``slack``, at each of its two ends.

    The order is found by sampled splitters: ``sample_rows`` places drawn in
    proportion to size give ``ranges`` quantile ranges, and ranges of more than
    ``bucket_rows`` rows are cut again at splitters of their own.  Samples
    settle how the work is dealt, never a row's shard.  Rows alike in key and
    id are salted, so they fill no range alone.

    Null keys and ids count as empty, null sizes as 0; repeated rows are rows
    of their own; columns named ``shard`` and ``slot`` are replaced, others
    pass through.  No rows give no rows; rows without any size go to shard 0.
    """
    passed = rows.drop("shard", "slot")
    # Struct fields cannot clash with the caller's columns.
    keyed = passed.select(
        F.struct("*").alias("_row"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("_size"),
        hash60(text_or_empty(key)).alias("_k"),
        hash60(text_or_empty(row_id.cast("string"))).alias("_s"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_z"),
    )
    # Written before the salt is used, so that every later task sees the same one.
    keyed = written(keyed)
    total = max(1, keyed.agg(F.sum("_size")).first()[0] or 0)
    ordered = written(_ordered(keyed, total, ranges, sample_rows, bucket_rows))
    # Rows that hold, or begin at, an edge between shards; their groups are the only ones on both sides.
    edge = lambda at: F.call_function("div", at * F.lit(shards), F.lit(total))
    torn = ordered.where(edge(F.col("_at") - 1) != edge(F.col("_at") + F.col("_size"))).select("_k").distinct()
    groups = ordered.join(if_small(written(torn)), "_k").groupBy("_k").agg(F.min("_at").alias("_g"), F.sum("_size").alias("_n"), F.count("*").alias("_c"))
    whole = written(groups.where((F.col("_c") > 1) & (F.col("_n") * shards <= slack * total)).select("_k", (2 * F.col("_g") + F.col("_n")).alias("_mid")))
    middle = F.coalesce("_mid", 2 * F.col("_at") + F.col("_size"))
    dealt = ordered.join(if_small(whole), "_k", "left").withColumn("_shard", _share(middle, total, shards))
    first = dealt.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    dealt = dealt.join(F.broadcast(first), "_shard")
    return dealt.select("_row.*", F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_first")).alias("slot"))


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in shards of near equal bytes, copies together."""
    text = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "text")
    # The text is read for its key and goes no further.
    keyed = rows.select("doc_id", "size", "text_crc32", F.md5(text_or_empty("text")).alias("key"))
    placed = place(keyed, F.col("size"), F.col("key"), F.col("doc_id"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
