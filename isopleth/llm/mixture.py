"""Mixing documents to target weights: budgets down a domain-language-source tree, prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.tables import if_small
from isopleth.llm.text import words
from isopleth.session import pinned

LEVELS = ("_domain", "_lang", "_source")


def _weight(key: Column, weights: Mapping[str, float]) -> Column:
    """The stated weight of a name, 1 where none is stated."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(key == name, F.lit(float(weight))).otherwise(out)
    return out


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``_given``: the parent's ``_budget`` split among its children by ``_weight``, none above its ``_cap``.

    What a child cannot take goes to its siblings in proportion to their
    weights, as often as needed.  In rising order of cap/weight, the level
    (tokens per weight) that the k-th child and its successors could share
    rises while children fill up and falls afterwards, so its maximum is the
    level at which all is given out.  A child is one row, however many
    documents it has.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("_fill"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(float("inf")))
    placed = (
        children.withColumn("_fill", fill)
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(after))
        .withColumn("_level", F.when(F.col("_rest") > 0, F.col("_left") / F.col("_rest")))
        .withColumn("_level", F.max("_level").over(Window.partitionBy(*parents)))
    )
    # Just above an integer is that integer: quotients of integers are not exact.
    given = F.least(F.col("_cap"), F.floor(F.col("_level") * F.col("_weight") + F.lit(1e-6)).cast("long"))
    return placed.withColumn("_given", F.greatest(F.lit(0).cast("long"), F.coalesce(given, F.lit(0).cast("long")))).drop(
        "_fill", "_left", "_rest", "_level"
    )


def leaf_budgets(
    leaves: DataFrame,
    budget: int | float | None,
    max_epochs: int,
    weights: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    """``_given`` tokens for each leaf (``_domain, _lang, _source, _tokens``).

    A subtree takes at most ``max_epochs`` times its tokens.  Weights go down
    the tree, so a shortage is met among siblings first and reaches the level
    above only when all of them are full.  ``budget`` None: all tokens there
    are.  Rounding down leaves less than one token per child unspent.
    """
    tree = leaves.withColumn("_cap", F.col("_tokens") * F.lit(max_epochs))
    everything = tree.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).cast("long").alias("t"))
    if budget is None:
        total = everything.scalar()
    elif isinstance(budget, float):
        total = everything.select(F.floor(F.col("t") * F.lit(budget)).cast("long")).scalar()
    else:
        total = F.lit(budget).cast("long")
    given = None
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = tree.groupBy(*parents, level).agg(F.sum("_cap").alias("_cap"))
        if given is None:
            nodes = nodes.withColumn("_budget", total)
        else:
            nodes = nodes.join(given, parents)
        nodes = nodes.withColumn("_weight", _weight(F.col(level), weights.get(level[1:], {})))
        given = shared_out(nodes, parents, level).select(*parents, level, F.col("_given").alias("_budget"))
    return given.withColumnRenamed("_budget", "_given")


def epoch_key(seed: int, epoch: Column, key: Column) -> Column:
    """Order of a document within an epoch: hex digits that differ between epochs."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def _place(order: Column, rows: Column, bucket_rows: int) -> Column:
    """Which of rows/bucket_rows equal shares of the key range a key lies in."""
    share = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.floor(share * F.ceil(rows / F.lit(bucket_rows))).cast("long")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    domain: Column,
    budget: int | float | None = None,
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    bucket_rows: int = 8192,
) -> DataFrame:
    """The input rows that the mixture takes, once per epoch, with ``mix_*`` columns.

    Tokens are words.  A leaf reads its documents in a seeded order, anew in
    each epoch, and takes the prefix whose tokens add up to its budget: whole
    epochs, then documents of the next one up to the one in which the budget
    ends (``mix_used`` of its ``mix_tokens`` count).  ``weights`` has maps for
    domain, lang and source; unstated names weigh 1, weight 0 takes nothing.
    ``budget`` is tokens, or a share of all tokens if a float.

    Null language, source or domain counts as the empty name, null text has no
    tokens; documents without tokens add nothing and come only with whole
    epochs or inside a prefix.  Repeated rows are rows of their own.  Columns
    named ``mix_*`` are replaced; others pass through.

    No leaf is ever ordered as a whole: tokens are summed per share of the key
    range, which settles in which share the budget ends, and only that share
    (about ``bucket_rows`` rows, however large the leaf) is put in order.
    """
    own = ["mix_domain", "mix_tokens", "mix_epoch", "mix_used"]
    docs = docs.drop(*own)
    # Struct fields cannot clash with the caller's columns, whatever their names.
    row = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(domain, F.lit("")).alias("_domain"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_key"),
        F.size(words(F.col(text_col))).cast("long").alias("_n"),
    )
    skinny = pinned(row.select(*LEVELS, "_key", "_n"))
    leaves = pinned(skinny.groupBy(*LEVELS).agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows")))
    budgets = leaf_budgets(leaves.where("_tokens > 0"), budget, max_epochs, weights)
    plan = pinned(
        leaves.join(budgets, [*LEVELS])
        .withColumn("_whole", F.floor(F.col("_given") / F.col("_tokens")).cast("long"))
        .withColumn("_part", F.col("_given") - F.col("_whole") * F.col("_tokens"))
    )
    # The share of the key range in which each partial epoch ends.
    keyed = skinny.join(if_small(plan.where("_part > 0")), [*LEVELS]).withColumn("_order", epoch_key(seed, F.col("_whole"), F.col("_key")))
    keyed = keyed.withColumn("_b", _place(F.col("_order"), F.col("_rows"), bucket_rows))
    up_to = Window.partitionBy(*LEVELS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        keyed.groupBy(*LEVELS, "_part", "_b")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(up_to), F.lit(0)))
        .where("_before < _part AND _before + _m >= _part")
        .select(*LEVELS, "_b", "_before")
    )
    # Rows alike in id and text share a key: they are counted first, however many they are.
    alike = keyed.join(if_small(pinned(ends)), [*LEVELS, "_b"]).groupBy(*LEVELS, "_order", "_n", "_part", "_before").agg(F.count("*").alias("_times"))
    inside = Window.partitionBy(*LEVELS).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_part") - F.col("_start")
    last = (
        alike.withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.col("_n") * F.col("_times")).over(inside), F.lit(0)))
        .where("_start < _part AND _start + _n * _times >= _part")
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("_order", F.call_function("div", left, F.col("_n")).alias("copies"), (left % F.col("_n")).alias("used"))).alias("_last"))
    )
    plan = pinned(plan.join(last, [*LEVELS], "left").select(*LEVELS, "_whole", "_last"))
    placed = row.join(if_small(plan), [*LEVELS]).withColumn("_o", epoch_key(seed, F.col("_whole"), F.col("_key")))
    # Whole epochs, and of the partial one the rows before the key in which the budget ends.
    before_end = F.col("_last").isNotNull() & (F.col("_o") < F.col("_last._order"))
    epochs = F.when((F.col("_whole") > 0) | before_end, F.sequence(F.lit(1).cast("long"), F.col("_whole") + before_end.cast("long")))
    taken = placed.withColumn("_epoch", F.explode(epochs)).withColumn("_used", F.col("_n"))
    # Rows of that key are numbered, each input partition on its own: whole copies, the rest of one, no more.
    tied = pinned(placed.where(F.col("_o") == F.col("_last._order")).withColumn("_mid", F.monotonically_increasing_id()))
    split = F.shiftright("_mid", 33)
    earlier = Window.partitionBy(*LEVELS).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    parts = tied.groupBy(*LEVELS, split.alias("_split")).agg(F.count("*").alias("_c"))
    parts = parts.select(*LEVELS, "_split", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_skip"))
    own_order = Window.partitionBy(*LEVELS, "_split").orderBy("_mid")
    numbered = tied.withColumn("_split", split).withColumn("_i", F.row_number().over(own_order) - 1).join(parts, [*LEVELS, "_split"])
    number = F.col("_skip") + F.col("_i")
    used = F.when(number < F.col("_last.copies"), F.col("_n")).when((number == F.col("_last.copies")) & (F.col("_last.used") > 0), F.col("_last.used"))
    ending = numbered.withColumns({"_used": used, "_epoch": F.col("_whole") + 1}).where("_used IS NOT NULL")
    taken = taken.select("_row", "_domain", "_n", "_epoch", "_used").unionByName(ending.select("_row", "_domain", "_n", "_epoch", "_used"))
    return taken.select(
        "_row.*",
        F.col("_domain").alias("mix_domain"),
        F.col("_n").alias("mix_tokens"),
        (F.col("_epoch") - 1).alias("mix_epoch"),
        F.col("_used").alias("mix_used"),
    )
